"""Spelling variants: words one edit apart, found by dynamic programming along the sorted vocabulary.

A word's near words differ from it by one inserted, deleted or replaced code point. An edit leaves
the first or the second half of the shorter word untouched, so the vocabulary is sorted twice, by
its words and by its words read backwards, and a pair needs only be met where both start alike.
Either list is cut into blocks of neighbouring words. Within a block, adjacent longest common
prefixes tell which rows of the edit matrix the next word shares with the one before: a row is a
band of three cells, computed once for each shared prefix and not once for each word, and a range
of words whose shared prefix is already more than one edit away from the searched word is left out
as a whole. Many searched words go down a block at the same time. A word whose range goes beyond
its own block also visits the neighbouring blocks, and of a very long range only those whose common
prefix is within one edit.

Memory: a task holds one block of the list and the words that visit it. The driver holds the first
and last word of each block (cut to BORDER code points), one row for some BLOCK_WORDS words.

Edge cases: NULL texts have no words; a NULL id counts as empty where a document's id is used;
repeated rows count each; texts of any length are cut at a border between words and read whole; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelry.llm.grouped import together, whole_groups
from funnelry.llm.stores import pick, stored

LEAST_POINTS = 5
LEAST_COUNT = 3
#: Words of a block of a sorted list, as aimed at; words that search a block together.
BLOCK_WORDS = 25_000
SEARCHED = 2_000
#: Code points of a border that the driver holds.
BORDER = 64
#: Different words that a task holds before it passes on their counts; code points that it splits at once.
HELD_WORDS = 100_000
PIECE = 1 << 20

LETTERS = "a-zÀ-ÿ"
_BREAK = re.compile(f"[^{LETTERS}]")
_LAST = "\U0010ffff"

#: Tells from the bytes of a document's id and a colon, and from a run, which word is meant.
Change = Callable[[bytes, str], str]


def one_dropped(every: int) -> Change:
    """Drops one code point of some runs of a document, one run in `every`, as a checksum tells."""

    def change(ident: bytes, run: str) -> str:
        h = zlib.crc32(run.encode(), zlib.crc32(ident))
        if h % every:
            return run
        at = h % len(run)
        return run[:at] + run[at + 1 :]

    return change


def counted(docs: DataFrame, change: Change | None = None, least_points: int = LEAST_POINTS) -> DataFrame:
    """(word, n): the runs of letters of all texts, A-Z in lower case, with their number."""
    rows = pick(docs, id="doc_id", text="text").select(F.col("id").cast("string"), "text")
    find = re.compile(f"[{LETTERS}]{{{least_points},}}").findall

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for ident, text in zip(ids, texts):
                if not text.is_valid:
                    continue
                start = (ident.as_py() or "").encode() + b":"
                for piece in _pieces(text.as_buffer().to_pybytes().lower().decode()):
                    for run, n in Counter(find(piece)).items():
                        word = change(start, run) if change else run
                        held[word] = held.get(word, 0) + n
                    if len(held) > HELD_WORDS:
                        yield _counts(held, least_points)
                        held = {}
        yield _counts(held, least_points)

    found = rows.mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        end = _BREAK.search(text, at + PIECE)
        to = end.start() if end else len(text)
        yield text[at:to]
        at = to


def _counts(held: dict[str, int], least_points: int) -> pa.RecordBatch:
    kept = {word: n for word, n in held.items() if len(word) >= least_points}
    return pa.record_batch({"word": pa.array(kept.keys(), pa.string()), "n": pa.array(kept.values(), pa.int64())})


def shared_part(points: int) -> int:
    """Code points that a word and a near one, as long or longer by one, share at one end at least."""
    return points // 2


@dataclass
class SortedList:
    """Different words in order, with the nodes of their shared prefixes.

    levels[t] holds, for each prefix of t code points, its first word and the end of its range.
    """

    words: list[str]
    points: np.ndarray
    first: np.ndarray
    length: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, words: list[str]) -> SortedList:
        length = np.array([len(w) for w in words], np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int32)
        first = np.concatenate([[0], np.cumsum(length)])[:-1]
        common = common_prefixes(points, first, length)
        levels, alive = [], np.arange(len(words))
        for t in range(int(length.max(initial=0)) + 1):
            alive = alive[length[alive] >= t]
            at = np.flatnonzero(common[alive] < t)
            levels.append((alive[at], alive[at] + np.diff(np.append(at, len(alive)))))
        return cls(words, points, first, length, levels)


def common_prefixes(points: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Longest common prefix of each word with the one before; -1 for the first."""
    common = np.zeros(len(first), np.int64)
    common[:1] = -1
    open_, t = np.arange(1, len(first)), 0
    while len(open_):
        open_ = open_[(length[open_] > t) & (length[open_ - 1] > t)]
        open_ = open_[points[first[open_] + t] == points[first[open_ - 1] + t]]
        t += 1
        common[open_] = t
    return common


def one_edit_pairs(found: SortedList, searched: list[str], shared: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the searched word, place in the list) of words exactly one edit apart.

    Only words that start with the first `shared` code points of the searched one and are as long
    or longer by one code point.
    """
    length = np.array([len(w) for w in searched], np.int64)
    starts = np.array(shared, np.int64)
    # Two code points that match nothing follow each searched word.
    points = np.frombuffer("\0\0".join([*searched, ""]).encode("utf-32-le"), np.uint32).astype(np.int32)
    first = np.concatenate([[0], np.cumsum(length + 2)])[:-1]
    place = np.full(len(searched), -1, np.int64)
    for i, (word, n) in enumerate(zip(searched, shared)):
        at = bisect_left(found.words, word[:n])
        if at < len(found.words) and found.words[at].startswith(word[:n]):
            place[i] = at
    none = np.zeros(0, np.int64)
    q, low, high = none, none, none
    a = b = c = none
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    last = min(len(found.levels) - 1, int(length.max(initial=0)) + 1)
    for t in range(int(starts.min(initial=0)), last):
        new = np.flatnonzero((starts == t) & (place >= 0))
        if len(new):
            begins, ends = found.levels[t]
            node = np.searchsorted(begins, place[new], "right") - 1
            zero, one = np.zeros(len(new), np.int64), np.ones(len(new), np.int64)
            q, low, high = np.append(q, new), np.append(low, begins[node]), np.append(high, ends[node])
            a, b, c = np.append(a, one), np.append(b, zero), np.append(c, one)
        if not len(q):
            if not (starts > t).any():
                break
            continue
        # One more code point of the list: each range falls into those of its longer prefixes.
        begins, ends = found.levels[t + 1]
        low, high = np.searchsorted(begins, low), np.searchsorted(begins, high)
        many = high - low
        row = np.repeat(np.arange(len(q)), many)
        node = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + low[row]
        q, a, b, c = q[row], a[row], b[row], c[row]
        low, high = begins[node], ends[node]
        x, at = found.points[found.first[low] + t], first[q] + t
        before = points[at - 1] if t else np.full(len(at), -1, np.int32)
        a = np.minimum(b + 1, a + (x != before))
        b = np.minimum(np.minimum(b + (x != points[at]), c + 1), a + 1)
        # A word that ends here: its distance stands in the searched word's last column.
        c = np.minimum(c + (x != points[np.minimum(at + 1, len(points) - 1)]), b + 1)
        ended = found.length[low] == t + 1
        hit = ended & (((length[q] == t + 1) & (b == 1)) | ((length[q] == t) & (a == 1)))
        if hit.any():
            pairs.append((q[hit], low[hit]))
        alive = (np.minimum(np.minimum(a, b), c) <= 1) & (length[q] > t)
        q, low, high, a, b, c = (v[alive] for v in (q, low, high, a, b, c))
    if not pairs:
        return none, none
    return tuple(np.concatenate(v) for v in zip(*pairs))


def within_one(word: str, prefix: str) -> bool:
    """Whether some word that starts with `prefix` may be one edit away from `word`."""
    row = [0, 1]
    for t, x in enumerate(prefix, 1):
        low = max(0, t - 1)
        new = []
        for j in range(low, min(len(word), t + 1) + 1):
            best = t if j == 0 else 9
            was = j - max(0, t - 2)
            if 0 <= was < len(row):
                best = min(best, row[was] + 1)
            if j and 0 <= was - 1 < len(row):
                best = min(best, row[was - 1] + (x != word[j - 1]))
            if new:
                best = min(best, new[-1] + 1)
            new.append(best)
        row = new
        if not row or min(row) > 1:
            return False
    return True


def _common(a: str, b: str) -> str:
    n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[:n]


def near_pairs(words: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(a, n_a, b, n_b): each pair of words one edit apart once, from different words with numbers.

    Words of a single code point have no half that stays and are left out.
    """
    words = words.where(F.length("word") >= 2)
    both = F.array(
        F.struct(F.concat(F.lit(">"), "word").alias("key"), "n"),
        F.struct(F.concat(F.lit("<"), F.reverse("word")).alias("key"), "n"),
    )
    entries = words.select(F.inline(both))
    blocks = max(1, -(-2 * words.count() // block_words))
    listed = entries.repartitionByRange(blocks, "key").withColumn("block", F.spark_partition_id())
    listed = stored(listed, "listed")
    cut = lambda f: F.substring(f("key"), 1, BORDER)
    ends = listed.groupBy("block").agg(cut(F.min).alias("low"), cut(F.max).alias("high"))
    ends = sorted((r.low, r.high, r.block) for r in ends.collect())  # a row for each block
    lows, highs = [e[0] for e in ends], [e[1] + _LAST * (len(e[1]) == BORDER) for e in ends]
    inside = [_common(low, high) for low, high, _ in ends]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, visitor, key, n = [], [], [], []
            for k, m, own in zip(*(batch.column(i).to_pylist() for i in range(3))):
                block.append(own), visitor.append(False), key.append(k), n.append(m)
                prefix = k[: 1 + shared_part(len(k) - 1)]
                for i in range(bisect_left(highs, prefix), bisect_right(lows, prefix + _LAST)):
                    if ends[i][2] != own and within_one(k, inside[i]):
                        block.append(ends[i][2]), visitor.append(True), key.append(k), n.append(m)
            columns = (pa.array(block, pa.int32()), pa.array(visitor, pa.bool_()), pa.array(key, pa.string()), pa.array(n, pa.int64()))
            yield pa.RecordBatch.from_arrays([*columns], ["block", "visitor", "key", "n"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, borders in whole_groups(batches, ["block"]):
            for low, high in zip(borders[:-1], borders[1:]):
                part = table.slice(low, high - low)
                keys, counts = part["key"].to_pylist(), part["n"].to_numpy()
                own = int(len(keys) - part["visitor"].to_numpy().sum())
                found = SortedList.of(keys[:own])
                for at in range(0, len(keys), SEARCHED):
                    yield _pairs(found, keys[at : at + SEARCHED], counts, at)

    sent = listed.select("key", "n", "block").mapInArrow(send, "block int, visitor boolean, key string, n long")
    ordered = together(sent, "block").sortWithinPartitions("block", "visitor", "key")
    return ordered.mapInArrow(search, "a string, n_a long, b string, n_b long")


def _pairs(found: SortedList, searched: list[str], counts: np.ndarray, at: int) -> pa.RecordBatch:
    shared = [shared_part(len(w) - 1) for w in searched]
    rows: list[tuple[str, int, str, int]] = []
    for i, j in zip(*(v.tolist() for v in one_edit_pairs(found, searched, [1 + n for n in shared]))):
        x, y, n = searched[i], found.words[j], shared[i]
        if len(x) == len(y) and x > y:
            continue  # met from the other side
        if x[0] == "<":
            if x[len(x) - n :] == y[len(y) - n :]:
                continue  # met in the list of the words read forwards
            x, y = x[:0:-1], y[:0:-1]
        else:
            x, y = x[1:], y[1:]
        rows.append((x, int(counts[at + i]), y, int(counts[j])))
    columns = list(zip(*rows)) or [()] * 4
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds)], ["a", "n_a", "b", "n_b"])


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of the forms from each word on, for rows (word, form) without cycles.

    Each round doubles the steps that a row stands for, so a chain of k forms takes log2(k) rounds.
    """
    step = stored(forms.toDF("word", "root"), "roots")
    while True:
        further = step.toDF("root", "next")
        joined = step.join(further, "root", "left")
        step = stored(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        step = step.select("word", "root")


def variants(
    docs: DataFrame,
    change: Change | None = None,
    least_points: int = LEAST_POINTS,
    least_count: int = LEAST_COUNT,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n): every word that is frequent enough with its variants.

    `form` is the near word of largest `n` (of several the first in code-point order) if that is at
    least twice the word's own, and `root` the end of the forms from the word on.
    """
    counts = counted(docs, change, least_points)
    words = stored(counts.where(F.col("n") >= least_count), "words")
    pairs = near_pairs(words, block_words)
    sides = F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")),
    )
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    near = pairs.select(F.inline(sides)).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    joined = words.join(near, "word", "left")
    often = -F.col("best.less")
    named = stored(
        joined.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(often >= 2 * F.col("n"), F.col("best.near")).alias("form"),
            F.when(often >= 2 * F.col("n"), often).alias("form_n"),
        ),
        "variants",
    )
    ends = roots(named.where("form IS NOT NULL").select("word", "form"))
    root = F.coalesce("root", "word").alias("root")
    return named.join(ends, "word", "left").select("word", "form", root, "n", "n_near", "form_n")
