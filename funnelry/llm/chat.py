"""Chat formatting: a declarative template turns conversations into segments with loss flags.

A template names the marks around a turn, the roles whose text is learned, and a finite-state
machine over roles. The machine decides whether the order of turns is allowed; a conversation that
breaks it is formatted all the same and carries the place of its first wrong turn, so that the
caller decides. Control characters inside texts and roles are replaced by two-character codes, so
no mark can be forged by a text, and `parsed` gives the turns back exactly.

Edge cases: NULL texts and roles count as empty; turns are ordered by (turn, role, text) with NULL
first, repeated rows stay; rows with a NULL conversation id form one conversation; an empty table
gives an empty result. The turns of one conversation meet in one row, as its output does.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelry.llm.stores import pick

START, WRONG = "start", "wrong"


@dataclass(frozen=True)
class Template:
    """Marks, codes for control characters (the escape character first), roles and their order.

    Codes follow from the marks unless they are given: the first character of `begin` and the first
    of `end` that no other mark has get one in all texts, the first of `after_role` in roles. Marks
    or codes by which a text could hold a mark are an error.
    """

    begin: str = "### "
    after_role: str = "\n"
    end: str = "</turn>\n"
    codes: tuple[tuple[str, str], ...] | None = None
    role_codes: tuple[tuple[str, str], ...] | None = None
    learned: tuple[str, ...] = ("assistant",)
    steps: Mapping[tuple[str, str], str] = field(
        default_factory=lambda: {
            (START, "system"): "system",
            (START, "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )
    final: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        if not (self.end and self.after_role):
            raise ValueError("a turn needs a mark after its role and one at its end")
        others = self.begin + self.after_role
        told = next((c for c in self.end if c not in others and c != ESCAPE), None)
        if told is None:
            raise ValueError(f"the end mark {self.end!r} needs a character that no other mark has")
        marks = [*self.begin[:1], told]
        letters = [c for c in "bhlxyz" if c not in (*marks, self.after_role[0])]
        if self.codes is None:
            plain = dict.fromkeys((ESCAPE, *marks))
            codes = tuple((c, ESCAPE + letter) for c, letter in zip(plain, letters))
            object.__setattr__(self, "codes", codes)
        if self.role_codes is None:
            first = self.after_role[0]
            code = ESCAPE + ("n" if first != "n" and "n" not in marks else letters[-1])
            known = any(first == plain for plain, _ in self.codes)
            object.__setattr__(self, "role_codes", () if known else ((first, code),))
        both = self.codes + self.role_codes
        written = "".join(code for _, code in both)
        if self.codes[0][0] != ESCAPE or len({c for _, c in both}) < len(both):
            raise ValueError("the escape character has the first code, and codes differ")
        for mark, codes, beside in ((self.end, self.codes, others), (self.after_role, both, "")):
            if not any(c in mark and c not in written + beside for c, _ in codes):
                raise ValueError(f"the mark {mark!r} may occur in a text: none of its characters has a code")


ESCAPE = "\\"
CHAT = Template()


def escaped(text: Column, codes: tuple[tuple[str, str], ...]) -> Column:
    for plain, code in codes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column, codes: tuple[tuple[str, str], ...]) -> Column:
    """The escape character comes back last; until then each one left introduces a code."""
    for plain, code in reversed(codes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _machine(roles: Column, template: Template) -> Column:
    """Struct of the state after all roles and the number of roles before the first wrong one."""
    steps = {f"{state}>{role}": to for (state, role), to in template.steps.items()}
    table = F.create_map(*(F.lit(x) for pair in steps.items() for x in pair))

    def step(at: Column, role: Column) -> Column:
        to = F.try_element_at(table, F.concat(at["state"], F.lit(">"), role))
        to = F.coalesce(to, F.lit(WRONG))
        passed = at["passed"] + (to != WRONG).cast("long")
        return F.struct(to.alias("state"), passed.alias("passed"))

    begin = F.struct(F.lit(START).alias("state"), F.lit(0).cast("long").alias("passed"))
    return F.aggregate(roles, begin, step)


def formatted(conversations: DataFrame, template: Template = CHAT) -> DataFrame:
    """conv_id, segments (text, loss), formatted, valid, first_wrong_turn (NULL if none)."""
    rows = pick(conversations, conv_id="conv_id", turn="turn", role="role", text="text")
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in ("role", "text")})
    turns = F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull(), "turn", "role", "text")))
    talks = rows.groupBy("conv_id").agg(turns.alias("turns"))

    def segments(turn: Column) -> Column:
        role = escaped(turn["role"], template.codes + template.role_codes)
        texts = (
            F.concat(F.lit(template.begin), role, F.lit(template.after_role)),
            escaped(turn["text"], template.codes),
            F.lit(template.end),
        )
        learned = (F.lit(False), turn["role"].isin(*template.learned), F.lit(False))
        pairs = zip(texts, learned, strict=True)
        return F.array(*(F.struct(t.alias("text"), f.alias("loss")) for t, f in pairs))

    talks = talks.select(
        "conv_id",
        F.flatten(F.transform("turns", segments)).alias("segments"),
        F.size("turns").cast("long").alias("n"),
        _machine(F.transform("turns", lambda t: t["role"]), template).alias("end"),
    )
    wrong = F.when(F.col("end.state") == WRONG, F.col("end.passed"))
    return talks.select(
        "conv_id",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        F.col("end.state").isin(*template.final).alias("valid"),
        wrong.alias("first_wrong_turn"),
    )


def parsed(text: Column, template: Template = CHAT) -> Column:
    """The turns (role, text) of a formatted conversation."""

    def turn(piece: Column) -> Column:
        turn = F.substr(piece, F.lit(len(template.begin) + 1))
        role = F.substring_index(turn, template.after_role, 1)
        body = F.substr(turn, F.length(role) + len(template.after_role) + 1)
        return F.struct(
            unescaped(role, template.codes + template.role_codes).alias("role"),
            unescaped(body, template.codes).alias("text"),
        )

    quoted = "\\E\\\\E\\Q".join(template.end.split("\\E"))
    pieces = F.split(text, f"\\Q{quoted}\\E", -1)
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def learned_text(segments: Column, template: Template = CHAT) -> Column:
    """All text under the loss mask, as it was before escaping."""
    kept = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(kept, lambda s: unescaped(s["text"], template.codes)), "")
