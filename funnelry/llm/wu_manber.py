"""Benchmark decontamination: Wu-Manber search for many test strings over the words of documents.

The symbols are words. The strings of one length m share a shift table over blocks of two words (one
where m is 1): how far the window may move when its last block is this one. A window moves on
until its shift is 0; then the bucket of its last block names the strings that may end here, and a
direct comparison of all m words confirms them. Every document is cut into stretches of window ends
which move in step, so that one array operation moves thousands of windows.

Documents are not shuffled: the tables go to the tasks. The bytes that tables will take are counted
first, and items are taken in blocks of at most TABLE_BYTES; a longer item is cut into pieces that
share all but one word of a window. Each block but the last has a job of its own, which stores the
distinct texts with hits; its tables are given back before the next block is read, so a task and the
driver hold one block, however large the benchmark. The last pass adds the stored hits to its own.

Edge cases: NULL texts have no words; texts and items of any length are searched whole; an item
without words is never found; an item of fewer words than a window is one string; items that share a
string are all found; rows that repeat an item count once; an item without an id is called `null`;
without items nothing is found; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import string as letters
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from funnelry.llm.stores import MAX_BROADCAST_ROWS, pick, small_batches, stored
from funnelry.llm.text import LETTERS_AND_DIGITS, mix, slices, words_of

WINDOW = 13
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LETTERS = (letters.ascii_uppercase, letters.ascii_lowercase)
#: Hit words are at least one in so many for a document to be contaminated.
ONE_IN = 20
#: Strings and buckets that are sent to the tasks at once; shift tables add 2 MB for each length.
TABLE_BYTES = 64 << 20
#: Windows of a piece of an item: some 9 MB of tables for windows of 13 words.
PIECE = 1 << 16
#: Beside its words a string takes its bucket's hash and place, its item and where its items begin.
STRING_BYTES = 40
#: Stored hits that are sent to every executor.
MAX_BROADCAST_BYTES = 32 << 20
TABLE_BITS = 20
#: Window ends of a stretch.
STRETCH = 256

SPANS = T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("first", "last")]))
HITS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", SPANS),
    T.StructField("items", T.ArrayType(T.StringType())),
]


def _block(words: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """Numbers of the blocks that end at the given words."""
    number = words[end]
    if width > 1:
        number = mix(words[end - 1] * np.uint64(0x9E3779B97F4A7C15) + number)
    return number


def _entry(block: np.ndarray) -> np.ndarray:
    return block >> np.uint64(64 - TABLE_BITS)


def _gather(values: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[start[i]:start[i] + n[i]] one after the other, and the i of each."""
    owner = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    return values[start[owner] + inside], owner


@dataclass
class Strings:
    """The test strings of one length, with their tables."""

    words: np.ndarray  # strings x length, distinct
    first_item: np.ndarray  # items of string s: items[first_item[s]:first_item[s + 1]]
    items: np.ndarray
    shift: np.ndarray
    bucket: np.ndarray  # last blocks, sorted
    string: np.ndarray  # the string of each of them

    @property
    def length(self) -> int:
        return self.words.shape[1]

    @property
    def width(self) -> int:
        return min(2, self.length)


def strings(words: np.ndarray, items: np.ndarray) -> Strings:
    """From strings x length numbers and the item of each."""
    words, which = np.unique(words, axis=0, return_inverse=True)
    pairs = np.unique(np.stack([which.ravel(), items], 1), axis=0)
    first_item = np.searchsorted(pairs[:, 0], np.arange(len(words) + 1))
    length = words.shape[1]
    width = min(2, length)
    shift = np.full(1 << TABLE_BITS, length - width + 1, np.uint16)
    flat, start = words.ravel(), np.arange(len(words)) * length
    for end in range(width - 1, length):
        entry = _entry(_block(flat, start + end, width))
        shift[entry] = np.minimum(shift[entry], length - 1 - end)
    last = _block(flat, start + length - 1, width)
    order = np.argsort(last, kind="stable")
    return Strings(words, first_item, pairs[:, 1], shift, last[order], order)


def search(words: np.ndarray, first: np.ndarray, wanted: Strings) -> tuple[np.ndarray, np.ndarray]:
    """Ends (word places) and strings of all occurrences in texts with words first[r]:first[r + 1]."""
    m, width = wanted.length, wanted.width
    begin = first[:-1] + m - 1
    n = np.maximum(-(-(first[1:] - begin) // STRETCH), 0)
    owner = np.repeat(np.arange(len(n)), n)
    at = begin[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)) * STRETCH
    stop = np.minimum(at + STRETCH, first[1:][owner])
    found = []
    while len(at):
        block = _block(words, at, width)
        step = wanted.shift[_entry(block)].astype(np.int64)
        zero = step == 0
        if zero.any():
            ends, blocks = at[zero], block[zero]
            low = np.searchsorted(wanted.bucket, blocks)
            high = np.searchsorted(wanted.bucket, blocks, "right")
            candidate, which = _gather(wanted.string, low, high - low)
            end = ends[which]
            same = np.ones(len(end), bool)
            for k in range(m):
                same &= words[end - (m - 1) + k] == wanted.words[candidate, k]
            found.append((end[same], candidate[same]))
        at = at + np.maximum(step, 1)
        inside = at < stop
        at, stop = at[inside], stop[inside]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _tables(rows: list, window: int) -> tuple[list[str], list[Strings]]:
    """Names of the items and the strings of each length."""
    names = ["null" if row[0] is None else str(row[0]) for row in rows]
    words = words_of(pa.array([row[1] for row in rows], pa.string()), LETTERS_AND_DIGITS)
    by_length: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for item in range(len(rows)):
        own = words.number[words.first[item] : words.first[item + 1]]
        if length := min(window, len(own)):
            windows = np.lib.stride_tricks.sliding_window_view(own, length)
            by_length.setdefault(length, []).append((windows, np.full(len(windows), item)))
    joined = (map(np.concatenate, zip(*parts, strict=True)) for parts in by_length.values())
    return names, [strings(*parts) for parts in joined]


def _search_batch(part: pa.RecordBatch, names: list[str], tables: list[Strings]) -> list[pa.Array]:
    """n_words, spans and items of a batch with columns text, spans and items."""
    texts, spans, items = (part.column(part.schema.get_field_index(f"_{c}")) for c in ("text", "spans", "items"))
    words = words_of(texts, LETTERS_AND_DIGITS)
    row_of = words.row()
    change = np.zeros(len(words.number) + 1, np.int64)
    found = [set(x or ()) for x in items.to_pylist()]
    for row, known in enumerate(spans.to_pylist()):
        for span in known or ():
            change[words.first[row] + span["first"]] += 1
            change[words.first[row] + span["last"] + 1] -= 1
    for wanted in tables:
        end, string = search(words.number, words.first, wanted)
        np.add.at(change, end - wanted.length + 1, 1)
        np.add.at(change, end + 1, -1)
        n = wanted.first_item[string + 1] - wanted.first_item[string]
        item, which = _gather(wanted.items, wanted.first_item[string], n)
        for row, name in np.unique(np.stack([row_of[end[which]], item], 1), axis=0):
            found[row].add(names[name])
    hit = np.cumsum(change)[:-1] > 0
    inner = words.first[(words.first > 0) & (words.first < len(hit))]
    before, after = np.zeros(len(hit), bool), np.zeros(len(hit), bool)
    before[1:], after[:-1] = hit[:-1], hit[1:]
    before[inner], after[inner - 1] = False, False
    first, last = np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after)
    own = words.first[row_of[first]]
    kind = pa.struct([("first", pa.int32()), ("last", pa.int32())])
    runs = pa.StructArray.from_arrays(
        [pa.array(x - own, pa.int32()) for x in (first, last)], fields=list(kind)
    )
    place = pa.array(np.searchsorted(first, words.first), pa.int32())
    return [
        pa.array(np.diff(words.first), pa.int64()),
        pa.ListArray.from_arrays(place, runs),
        pa.array([sorted(x) for x in found], pa.list_(pa.string())),
    ]


def _searched(docs: DataFrame, names: list[str], tables: list[Strings]) -> tuple[DataFrame, Callable[[], None]]:
    """One pass over documents with the columns `_text`, `_spans` and `_items`; the second value gives
    the tables back."""
    sent = docs.sparkSession.sparkContext.broadcast((names, tables))
    own = [f for f in docs.schema if f.name not in ("_words", "_spans", "_items")]
    added = [T.StructField(f"_{n}", f.dataType) for n, f in zip(("words", "spans", "items"), HITS, strict=True)]

    def search_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, tables = sent.value
        for batch in batches:
            for part in slices(batch, "_text"):
                kept = [part.column(part.schema.get_field_index(f.name)) for f in own]
                columns = kept + _search_batch(part, names, tables)
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in [*own, *added]])

    return docs.mapInArrow(search_all, T.StructType([*own, *added])), sent.destroy


def pieces(items: DataFrame, window: int) -> DataFrame:
    """Distinct (item_id, text, n_bytes): items in pieces, and what their strings take in the tables."""
    rows = pick(items, item_id="item_id", text="text")
    words = F.regexp_extract_all(F.translate("text", *LETTERS), F.lit(WORD), F.lit(0))
    rows = rows.select("item_id", words.alias("words")).where(F.size("words") > 0)
    windows = F.greatest(F.size("words") - (window - 1), F.lit(1))
    starts = F.sequence(F.lit(0), F.ceil(windows / PIECE) - 1)
    cut = F.transform(
        starts, lambda k: F.slice("words", (k * PIECE + 1).cast("int"), PIECE + window - 1)
    )
    rows = rows.select("item_id", F.explode(cut).alias("words"))
    length = F.least(F.size("words"), F.lit(window))
    n_bytes = (F.size("words") - length + 1) * (8 * length + STRING_BYTES)
    return rows.select("item_id", F.array_join("words", " ").alias("text"), n_bytes.alias("n_bytes")).distinct()


def item_blocks(items: DataFrame, window: int = WINDOW) -> Iterator[list]:
    """The items as lists of rows (id, text) whose tables stay below TABLE_BYTES; a single piece may
    be larger only if TABLE_BYTES is set below what a piece takes."""
    found = pieces(items, window)
    sizes = found.agg(F.sum("n_bytes").alias("all"), F.max("n_bytes").alias("most")).first()
    if (sizes["all"] or 0) <= TABLE_BYTES:
        yield found.select("item_id", "text").collect()
        return
    found = stored(found, "pieces")
    bound, n = max(TABLE_BYTES, sizes["most"]), math.ceil(sizes["all"] / TABLE_BYTES)
    block = F.xxhash64("item_id", "text")
    while True:
        largest = found.groupBy(F.pmod(block, F.lit(n)).alias("k")).agg(F.sum("n_bytes").alias("b"))
        if largest.agg(F.max("b")).first()[0] <= bound:
            break
        n += math.ceil(n / 2)
    for k in range(n):
        yield found.where(F.pmod(block, F.lit(n)) == k).select("item_id", "text").collect()


def _known(texts: DataFrame, rows: list, window: int) -> DataFrame:
    """digest, spans and items of the distinct texts in which a block of items occurs, stored."""
    empty = texts.select(
        F.col("_text"), F.lit(None).cast(SPANS).alias("_spans"), F.lit(None).cast("array<string>").alias("_items")
    )
    found, give_back = _searched(empty, *_tables(rows, window))
    found = found.where(F.size("_items") > 0)
    found = found.select(F.sha2("_text", 256).alias("digest"), "_spans", "_items").dropDuplicates(["digest"])
    found = stored(found, "hits")
    give_back()
    return found


def _added(docs: DataFrame, known: list[DataFrame]) -> DataFrame:
    """Documents with the stored hits of their texts as `_spans` and `_items`."""
    hits = known[0]
    for more in known[1:]:
        hits = hits.unionByName(more)
    spans, names = F.flatten(F.collect_list("_spans")), F.flatten(F.collect_list("_items"))
    hits = stored(hits.groupBy("digest").agg(spans.alias("_spans"), names.alias("_items")), "hits")
    n_bytes = 72 + 16 * F.size("_spans") + F.octet_length(F.array_join("_items", ",")) + 16 * F.size("_items")
    size = hits.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(n_bytes), F.lit(0)).alias("b")).first()
    if size.n <= MAX_BROADCAST_ROWS and size.b <= MAX_BROADCAST_BYTES:
        hits = F.broadcast(hits)
    return docs.join(hits, F.sha2("_text", 256) == F.col("digest"), "left").drop("digest")


def _hits(docs: DataFrame, items: DataFrame, window: int, text_place: int) -> DataFrame:
    """Documents as `_0`, `_1`, ... with `_words`, `_spans` and `_items`."""
    small_batches(docs.sparkSession)
    numbered = docs.toDF(*(f"_{i}" for i in range(len(docs.columns))))
    found = numbered.withColumn("_text", F.col(f"_{text_place}"))
    known, last = [], None
    for rows in item_blocks(items, window):
        if last is not None:
            known.append(_known(found, last, window))
        last = rows
    if known:
        found = _added(found, known)
    else:
        found = found.withColumns({"_spans": F.lit(None).cast(SPANS), "_items": F.lit(None).cast("array<string>")})
    return _searched(found, *_tables(last, window))[0].drop("_text")


def _n_hit() -> Column:
    zero = F.lit(0).cast("long")
    return F.aggregate("_spans", zero, lambda n, s: n + s["last"] - s["first"] + F.lit(1).cast("long"))


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, spans (runs of hit words), items (sorted ids) and contaminated."""
    found = _hits(pick(docs, doc_id="doc_id", text="text"), items, window, 1)
    found = found.select(
        F.col("_0").alias("doc_id"),
        F.col("_words").alias("n_words"),
        _n_hit().alias("n_hit"),
        F.col("_spans").alias("spans"),
        F.col("_items").alias("items"),
    )
    return found.withColumn("contaminated", _contaminated(F.col("n_hit"), F.col("n_words")))


def _contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (ONE_IN * n_hit >= n_words)


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, with their columns."""
    found = _hits(docs, items, window, docs.columns.index("text"))
    found = found.where(~_contaminated(_n_hit(), F.col("_words")))
    return found.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)))
