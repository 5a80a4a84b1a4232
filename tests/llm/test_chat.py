import pytest
from hypothesis import Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from funnelry.llm import chat, oracles, queries

SCHEMA = "conv_id long, turn long, role string, text string, ROLE int"


def formatted(spark, *rows):
    return chat.formatted(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA))


@pytest.mark.parametrize(
    ("roles", "valid", "wrong"),
    [
        ("su a", True, None), ("ua", True, None), ("uaua", True, None), ("u", False, None),
        ("a", False, 0), ("uua", False, 1), ("us", False, 1), ("usa", False, 1), ("ux", False, 1),
    ],
)
def test_order_of_turns(spark, roles, valid, wrong):
    names = {"s": "system", "u": "user", "a": "assistant", "x": None}
    rows = [(1, k, names[r], "t") for k, r in enumerate(roles.replace(" ", ""))]
    found = formatted(spark, *rows).first()
    assert (found.valid, found.first_wrong_turn) == (valid, wrong)


def test_round_trip_of_awkward_texts(spark):
    texts = ["### user\n", "</turn>\n", "\\", "\\b\\h\\l\\n", "", None, "#<\\<#", "é\U0001f600\n\n", "x" * 300_000]
    roles = ["user", "assistant", "a\nb", "### ", None, "\\n", "</turn>", "assistant", "system"]
    rows = [(5, k, r, t) for k, (r, t) in enumerate(zip(roles, texts, strict=True))]
    found = formatted(spark, *rows).withColumn("turns", chat.parsed(F.col("formatted")))
    found = found.withColumn("learned", chat.learned_text(F.col("segments"))).first()
    assert [(t.role, t.text) for t in found.turns] == [(r or "", t or "") for r, t in zip(roles, texts, strict=True)]
    assert found.learned == "".join(t or "" for r, t in zip(roles, texts, strict=True) if r == "assistant")
    assert found.formatted == "".join(s.text for s in found.segments)
    assert found.formatted.count("</turn>") == len(rows)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant"]), st.text("\\bhln#< </turn>\né", max_size=12)), min_size=1, max_size=6))
def test_round_trip(spark, turns):
    found = formatted(spark, *((1, k, r, t) for k, (r, t) in enumerate(turns)))
    found = found.select(chat.parsed(F.col("formatted")).alias("turns")).first()
    assert [tuple(t) for t in found.turns] == turns


def turned_back(spark, template, turns):
    rows = [(1, k, r, t, 1) for k, (r, t) in enumerate(turns)]
    found = chat.formatted(spark.createDataFrame(rows, SCHEMA), template)
    found = found.select(chat.parsed(F.col("formatted"), template).alias("turns"), "formatted").first()
    assert [tuple(t) for t in found.turns] == turns
    assert found.formatted.count(template.end) == len(turns)


@pytest.mark.parametrize(
    "marks",
    [
        ("<|im_start|>", "\n", "<|im_end|>\n"), ("[T] ", ": ", "[/T]\n"), ("$", "|", "$."), ("", "\t", "***"),
        ("\n\nRole ", "\n", "\r\n"), ("(", ")", "\x1e"), ("^", "?", "+\\E+"), ("b", "n", "h"),
    ],
)
def test_any_template(spark, marks):
    template = chat.Template(*marks)
    awkward = "".join(marks) + "\\b\\h\\l\\n\\x" + marks[2]
    turned_back(spark, template, [("user", "one"), (awkward, awkward), ("", ""), ("assistant", "|im_end|> \\E x")])


@settings(max_examples=25, deadline=None, phases=[Phase.generate])
@given(
    st.tuples(*(st.text("|[$#<\n*(a", min_size=k, max_size=4) for k in (0, 1, 1))),
    st.lists(st.tuples(*(st.text("|[$#<\n*(a\\bn", max_size=8) for _ in range(2))), min_size=1, max_size=4),
)
def test_round_trip_of_any_template(spark, marks, turns):
    try:
        template = chat.Template(*marks)
    except ValueError:
        assert set(marks[2]) <= set(marks[0] + marks[1] + chat.ESCAPE) or marks[1][0] in chat.ESCAPE
        return
    turned_back(spark, template, turns)


@pytest.mark.parametrize("wrong", [{"end": ""}, {"after_role": ""}, {"end": "[/T]", "codes": chat.CHAT.codes}, {"end": "\\\\"}, {"begin": "\n\nRole ", "end": "\n\n"}])
def test_marks_that_a_text_could_hold_are_errors(wrong):
    with pytest.raises(ValueError):
        chat.Template(**wrong)


def test_ties_and_nulls(spark):
    rows = [(None, 1, "user", "b"), (None, None, "user", "a"), (None, 1, "user", "a"), (None, 1, "user", "a")]
    found = formatted(spark, *rows).select("conv_id", chat.parsed(F.col("formatted")).alias("turns")).collect()
    assert [(r.conv_id, [t.text for t in r.turns]) for r in found] == [(None, ["a", "a", "a", "b"])]
    assert formatted(spark).collect() == []


def test_query_as_sql(spark, tmp_path, duck, same):
    rows = [
        (1, 0, "user", "Hi # <there>\\", 1), (1, 1, "assistant", None, 1), (2, 0, None, "x", 1),
        (3, 0, "assistant", "é", 1), (3, 1, "assistant", "ü", 1),
    ]
    talks = spark.createDataFrame(rows, SCHEMA.replace("ROLE", "extra"))
    talks.write.parquet(str(tmp_path / "conversations.parquet"))
    found = queries.op2_chat_format(spark, str(tmp_path))
    same(found, duck(oracles.OP2, conversations=talks))


def test_no_python(spark, tmp_path):
    spark.createDataFrame([], SCHEMA.replace("ROLE", "extra")).write.parquet(str(tmp_path / "conversations.parquet"))
    plan = queries.op2_chat_format(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "ExistingRDD"))
