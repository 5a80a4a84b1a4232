"""Language-model scores by stupid backoff, with n-gram counts of the whole corpus.

A word after a history scores count(history and word) / count(history); where that count is 0, the
history loses its first word and the score a factor of 0.4; a word that is not seen at all counts as
once. Counts are those of all other documents: a document's own n-grams are taken off, so it cannot
vouch for itself. A document's score is the sum of the logarithms over its words.

The texts are dealt over chunks of some 8 MB. Each chunk sends its distinct n-grams, by hash, to
partitions of the count table (sorted, as compressed differences), which add up what all chunks sent and answer each chunk with the
totals; the join of chunks and answers then scores every word. A frequent n-gram is one entry per
chunk, however often it occurs. N-grams are told apart by hashes of BITS bits: of 10**10 different
ones, one in 7 million shares its hash with another, of 10**13 (some 100 TB of text) one in 7,000.

Edge cases: NULL and empty texts have no words and score 0 with a NULL mean; the first words of a
text have shorter histories; rows that repeat id and text count as documents of their own, but travel
and are scored once with their number, so a row repeated without end is no hot key; texts of any
length are scored whole; a corpus of one document scores every word as unseen; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from funnelry.llm.grouped import together, whole_groups
from funnelry.llm.stores import MAX_BROADCAST_ROWS, pick, small_batches, stored
from funnelry.llm.text import BETWEEN_SPACES, mix, runs, slices, words_of

ORDER = 3
#: Sorted hashes are sent as differences, so every bit less is a bit less for each n-gram on disk.
BITS = 56
BACKOFF = 0.4
CHUNK_BYTES = 8 << 20
MIN_CHUNKS = 16
MIN_PARTITIONS = 64
#: Copies of a row that are put out at once.
COPIES = 1 << 16


def grams(texts: pa.Array, order: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words per row; for each n up to the order the rows and numbers of all n-grams, by last word.

    The n-gram of a word is at index `last word - n + 1` of its row's n-grams in order.
    """
    words = words_of(texts, BETWEEN_SPACES)
    row = words.row()
    out = []
    for n in range(1, order + 1):
        number = runs(words.number, n)
        inside = row[: len(number)] == row[n - 1 :]
        out.append((row[n - 1 :][inside], mix(number[inside] + np.uint64(n)) >> np.uint64(64 - BITS)))
    return np.diff(words.first), out


def chunk_grams(texts: list[pa.Array], order: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The same for texts in several arrays."""
    sizes, parts, base = [], [[] for _ in range(order)], 0
    for array in texts:
        n, found = grams(array, order)
        sizes.append(n)
        for part, (row, number) in zip(parts, found, strict=True):
            part.append((row + base, number))
        base += len(n)
    joined = [tuple(np.concatenate(x) for x in zip(*part, strict=True)) for part in parts]
    return np.concatenate(sizes), joined


def _sliced(table: pa.Table, column: str) -> list[pa.Array]:
    return [
        part.column(part.schema.get_field_index(column))
        for batch in table.to_batches()
        for part in slices(batch, column)
    ]


def packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on, byte place after byte place and compressed."""
    if not len(values) or values.max() < 1 << 32:
        values = values.astype(np.uint32)
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    head = len(values).to_bytes(4, "little") + values.itemsize.to_bytes(1, "little")
    return head + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n, size = int.from_bytes(data[:4], "little"), data[4]
    planes = pa.decompress(data[5:], n * size, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, n).T).reshape(-1).view(f"u{size}")


def _counted(found: list[tuple[np.ndarray, np.ndarray]], copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers in order and how often they occur, each row `copies` times."""
    numbers = np.concatenate([number for _, number in found])
    if (copies == 1).all():
        return np.unique(numbers, return_counts=True)
    number, which = np.unique(numbers, return_inverse=True)
    count = np.zeros(len(number), np.int64)
    np.add.at(count, which, copies[np.concatenate([row for row, _ in found])])
    return number, count


def _send(order: int, n_parts: int):
    """(part, chunk, words, numbers, counts): the distinct n-grams of a chunk for one partition."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for all_, borders in whole_groups(batches, ["chunk"]):
            for a, b in zip(borders[:-1], borders[1:], strict=True):
                table = all_.slice(a, b - a)
                sizes, found = chunk_grams(_sliced(table, "text"), order)
                copies = table["copies"].to_numpy()
                number, count = _counted(found, copies)
                part = ((number >> np.uint64(BITS - 32)) * np.uint64(n_parts) >> np.uint64(32)).astype(np.int64)
                first = np.searchsorted(part, np.arange(n_parts + 1))
                chunk = table["chunk"][0].as_py()
                # Words are counted once; every partition answers, also with nothing.
                words = np.zeros(n_parts, np.int64)
                words[0] = (sizes * copies).sum()
                for p in range(n_parts):
                    own = slice(first[p], first[p + 1])
                    row = (p, chunk, int(words[p]), packed(np.diff(number[own], prepend=np.uint64(0))), packed(count[own]))
                    types = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
                    arrays = [pa.array([x], t) for x, t in zip(row, types, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, ["part", "chunk", "words", "numbers", "counts"])

    return send


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, part, words, totals): for each n-gram that a chunk sent its count in all chunks."""
    for all_, borders in whole_groups(batches, ["part"]):
        for a, b in zip(borders[:-1], borders[1:], strict=True):
            table = all_.slice(a, b - a)
            sent = [np.cumsum(unpacked(x), dtype=np.uint64) for x in table["numbers"].to_pylist()]
            counts = np.concatenate([unpacked(x) for x in table["counts"].to_pylist()])
            distinct, which = np.unique(np.concatenate(sent), return_inverse=True)
            totals = np.bincount(which, counts, len(distinct)).astype(np.int64)[which]
            ends = np.cumsum([len(x) for x in sent])
            for k, end in enumerate(ends):
                one = table.slice(k, 1)
                values = pa.array([packed(totals[end - len(sent[k]) : end])])
                yield pa.RecordBatch.from_arrays(
                    [*(one[c].combine_chunks() for c in ("chunk", "part", "words")), values],
                    ["chunk", "part", "words", "totals"],
                )


def _in_other_rows(found: list[tuple[np.ndarray, np.ndarray]], totals: np.ndarray) -> np.ndarray:
    """For each n-gram, order after order, its total less its count in its own row.

    One stable sort brings equal numbers together, rows in order within each n; n-grams of different
    n never share a number but by accident, and then count as one.
    """
    row, number = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(number, kind="stable")
    number, row = number[order], row[order]
    change = np.ones(len(number), bool)
    change[1:] = number[1:] != number[:-1]
    total = totals[np.cumsum(change) - 1]
    change[1:] |= row[1:] != row[:-1]
    length = np.diff(np.append(np.flatnonzero(change), len(number)))
    out = np.empty(len(number), np.int64)
    out[order] = total - np.repeat(length, length)
    return out


def score_rows(
    sizes: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]], totals: np.ndarray, n_words: int
) -> tuple[np.ndarray, np.ndarray]:
    """Sum of log scores and number of words below the full order, for each row.

    `totals` belongs to the sorted distinct numbers of all orders.
    """
    order = len(found)
    first = np.cumsum(sizes) - sizes
    all_words = int(sizes.sum())
    elsewhere_of = _in_other_rows(found, totals)
    others: list[np.ndarray] = []  # by order and word: the n-gram's count elsewhere, 0 if too short
    begin = 0
    for n, (row, _) in enumerate(found, 1):
        count = np.zeros(all_words, np.int64)
        per_row = np.maximum(sizes - n + 1, 0)
        last = np.repeat(first + n - 1 - np.cumsum(per_row) + per_row, per_row) + np.arange(len(row))
        count[last] = elsewhere_of[begin : begin + len(row)]
        begin += len(row)
        others.append(count)
    row_of = np.repeat(np.arange(len(sizes)), sizes)
    elsewhere = (n_words - sizes)[row_of].astype(np.float64)
    score = np.log(np.maximum(others[0], 1) / np.maximum(elsewhere, 1))
    seen_at = np.where(others[0] > 0, 1, 0)
    for n in range(2, order + 1):
        # The history of a word is the (n - 1)-gram that ends at the word before.
        history = np.concatenate([[0], others[n - 2][:-1]])
        longer = others[n - 1] > 0
        place = np.arange(all_words) - np.repeat(first, sizes)
        possible = place >= n - 1
        full = np.log(np.where(longer, others[n - 1], 1) / np.where(longer, history, 1))
        score = np.where(longer, full, np.where(possible, score + math.log(BACKOFF), score))
        seen_at = np.where(longer, n, seen_at)
    wanted = np.minimum(np.arange(all_words) - np.repeat(first, sizes) + 1, order)
    backed_off = seen_at < wanted
    total = np.bincount(row_of, score, len(sizes))
    return total, np.bincount(row_of, backed_off, len(sizes)).astype(np.int64)


def _once(rows: DataFrame) -> tuple[DataFrame, int, bool]:
    """Distinct rows with `hash` and their `copies`, the bytes of their texts, and whether any repeat.

    Only rows whose hash occurs more than once are grouped, and shuffled, by their columns.
    """
    rows = rows.withColumn("hash", F.xxhash64("doc_id", "text"))
    counts = rows.groupBy("hash").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.octet_length("text")).alias("bytes")
    )
    found = counts.agg(F.sum("bytes").alias("bytes"), F.count_if(F.col("n") > 1).alias("repeated")).first()
    single = rows.withColumn("copies", F.lit(1).cast("long"))
    if not found.repeated:
        return single, found.bytes or 0, False
    marks = stored(counts.where("n > 1").select("hash"), "marks")
    if found.repeated <= MAX_BROADCAST_ROWS:
        again = rows.join(F.broadcast(marks), "hash", "left_semi")
        rest = single.join(F.broadcast(marks), "hash", "left_anti")
    else:
        again, rest = rows, None
    again = again.groupBy("hash", "doc_id", "text").agg(F.count(F.lit(1)).alias("copies"))
    again = stored(again, "copies")
    return (again if rest is None else rest.unionByName(again)), found.bytes, True


def _all_copies(found: DataFrame) -> DataFrame:
    """Each row as often as `copies` says, without the column."""
    left = F.col("copies") - F.lit(1)
    blocks = found.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(left / COPIES))))
    last = F.least(left - F.col("_block") * COPIES, F.lit(COPIES - 1))
    each = blocks.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return each.drop("copies", "_block", "_copy")


def scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, n_words, log_score, n_backed_off and mean_log_score of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = pick(docs, doc_id="doc_id", text="text")
    rows, total, repeated = _once(rows.withColumn("text", F.coalesce("text", F.lit(""))))
    chunks = max(MIN_CHUNKS, math.ceil(total / CHUNK_BYTES))
    n_parts = max(MIN_PARTITIONS, chunks)
    rows = rows.withColumn("chunk", F.pmod("hash", F.lit(chunks)).cast("int")).drop("hash")
    schema = "part int, chunk int, words long, numbers binary, counts binary"
    sent = together(rows.select("chunk", "text", "copies"), "chunk").mapInArrow(_send(order, n_parts), schema)
    answers = together(sent, "part").mapInArrow(_answer, "chunk int, part int, words long, totals binary")
    answers = stored(answers, "counts")
    n_words = answers.agg(F.sum("words")).first()[0] or 0
    result = T.StructType(
        [
            T.StructField("doc_id", rows.schema["doc_id"].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("log_score", T.DoubleType()),
            T.StructField("n_backed_off", T.LongType()),
            T.StructField("copies", T.LongType()),
        ]
    )
    types = [pa.int64(), pa.float64(), pa.int64()]

    def score(texts: pa.Table, totals: pa.Table) -> pa.Table:
        totals = totals.sort_by("part")["totals"].to_pylist()
        totals = np.concatenate([unpacked(x) for x in totals]).astype(np.int64)
        sizes, found = chunk_grams(_sliced(texts.select(["text"]), "text"), order)
        total, backed_off = score_rows(sizes, found, totals, n_words)
        values = [pa.array(x, t) for x, t in zip((sizes, total, backed_off), types, strict=True)]
        return pa.table([texts["doc_id"], *values, texts["copies"]], names=result.names)

    grouped = rows.groupBy("chunk").cogroup(answers.select("chunk", "part", "totals").groupBy("chunk"))
    found = grouped.applyInArrow(score, result)
    found = _all_copies(found) if repeated else found.drop("copies")
    mean = F.col("log_score") / F.nullif("n_words", F.lit(0))
    return found.withColumn("mean_log_score", mean)
