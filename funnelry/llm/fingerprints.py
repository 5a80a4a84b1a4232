"""Fingerprints of documents: a randomised embedding of edit distance into Hamming distance.

A walk reads a text from its start. At each step it looks at one code point and either stays or goes
on by one, as a random bit says that depends on the step and the code point and is the same for all
texts. Two texts walk together as long as they agree; after an edit they walk apart and, by chance,
fall into step again, so texts with few edits are at the same place at most steps.

A fingerprint samples the walk at fixed steps: SAMPLES of the first SAMPLES steps and of each range
twice as long as the one before, four bits each, taken from a hash of the CONTEXT code points where
the walk stands. It is a string of hexadecimal digits whose length tells how far the walk came.
`likeness` weighs each digit with the steps that it stands for and takes off what agrees by chance.

`near_groups` finds documents of like fingerprints: bands of sampled digits bring candidates
together, and the likeness of whole fingerprints verifies them.

Edge cases: a NULL text counts as empty, and an empty one has an empty fingerprint; equal texts have
equal ones; texts of any length are walked to their end; repeated rows each have a result; an empty
table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelry.llm.components import components
from funnelry.llm.stores import pick, stored

SAMPLES = 64
CONTEXT = 8
#: Code points that are walked together, and texts below which each is walked alone.
SLICE_POINTS = 1 << 21
FEW = 64
CHECK_EVERY = 256

_RANDOM = np.random.default_rng(20_260_311)
#: The walk's bits repeat after so many steps; a code point counts as one of CLASSES.
PERIOD, CLASSES = 1 << 16, 62
_BITS = _RANDOM.integers(0, 1 << CLASSES, PERIOD, dtype=np.int64)
_BIT_LIST: list[int] = []
_CLASS = np.uint64(_RANDOM.integers(1, 1 << 63, dtype=np.int64) | 1)
_WEIGHTS = _RANDOM.integers(1, 1 << 63, CONTEXT, dtype=np.uint64) | np.uint64(1)
_SCALES = 40


def _sampled_steps() -> np.ndarray:
    steps = [np.arange(SAMPLES)]
    for s in range(_SCALES):
        low = SAMPLES << s
        # One step of each of SAMPLES equal parts of the range from low to 2 * low.
        steps.append(low + np.arange(SAMPLES) * (1 << s) + _RANDOM.integers(0, 1 << s, SAMPLES))
    return np.concatenate(steps)


_STEPS = _sampled_steps()
#: Steps that each sample stands for.
_SHARE = np.repeat(np.concatenate([[1.0], 2.0 ** np.arange(_SCALES)]), SAMPLES)
_SHARES = np.concatenate([[0.0], np.cumsum(_SHARE)])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _walk(classes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Places of the sampled steps, a row for each; the end of the text where its walk is over.

    The class after each text stands for its end and has no bit, so a walk stays there.
    """
    n = len(start)
    rows: list[np.ndarray] = []
    lanes, at, step, k = np.flatnonzero(start < end), start[start < end], 0, 0
    while len(lanes) >= FEW:
        for j in range(step, step + CHECK_EVERY):
            if j == _STEPS[k]:
                row = end.copy()
                row[lanes] = at
                rows.append(row)
                k += 1
            at = at + ((_BITS[j % PERIOD] >> classes[at]) & 1)
        step += CHECK_EVERY
        left = at < end[lanes]
        lanes, at = lanes[left], at[left]
    if not _BIT_LIST:
        _BIT_LIST.extend(_BITS.tolist())
    tails = {lane: _walk_alone(classes[i : end[lane]].astype(np.uint8).tobytes(), step, k) for lane, i in zip(lanes.tolist(), at.tolist())}
    further = max((len(t) for t in tails.values()), default=0)
    out = np.concatenate([np.array(rows, np.int64).reshape(-1, n), np.broadcast_to(end, (further, n))])
    for lane, i in zip(lanes.tolist(), at.tolist()):
        out[k : k + len(tails[lane]), lane] = np.array(tails[lane], np.int64) + i
    return out


def _walk_alone(text: bytes, step: int, k: int) -> list[int]:
    found, bits, i, n = [], _BIT_LIST, 0, len(text)
    mask = PERIOD - 1
    while i < n:
        target = int(_STEPS[k])
        while step < target and i < n:
            i += bits[step & mask] >> text[i] & 1
            step += 1
        if i < n:
            found.append(i)
            k += 1
    return found


def prints(texts: list[str]) -> list[str]:
    """The fingerprint of each text."""
    points = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    length = np.array([len(t) for t in texts], np.int64)
    start = np.concatenate([[0], np.cumsum(length + 1)])[:-1]
    end = start + length
    classes = ((points + np.uint64(1)) * _CLASS >> np.uint64(32)) % np.uint64(CLASSES)
    classes = classes.astype(np.int64)
    classes[end] = 63
    places = _walk(classes, start, end)
    inside = places < end
    sample, lane = np.nonzero(inside)
    at, stop = places[inside], end[lane]
    context = np.zeros(len(at), np.uint64)
    for k in range(CONTEXT):
        here = np.minimum(at + k, stop)
        context += np.where(here < stop, points[here] + np.uint64(1), np.uint64(0)) * _WEIGHTS[k]
    digits = np.full(places.shape, ord("-"), np.uint8)
    value = _mixed(context + np.uint64(0x632BE59BD9B4E019) * sample.astype(np.uint64)) >> np.uint64(60)
    digits[inside] = np.frombuffer(b"0123456789abcdef", np.uint8)[value.astype(np.int64)]
    known = inside.sum(axis=0)
    return [digits[:n, i].tobytes().decode() for i, n in enumerate(known.tolist())]


def likeness(a: str, b: str) -> float:
    """1 for equal fingerprints, about 0 for those of unrelated texts."""
    if a == b:
        return 1.0
    both = min(len(a), len(b))
    x, y = (np.frombuffer(f[:both].encode(), np.uint8) for f in (a, b))
    chance = _SHARES[both] / 16
    same = float(_SHARE[:both][x == y].sum())
    return max(0.0, (same - chance) / (float(_SHARES[max(len(a), len(b))]) - chance))


def edited(text: str, follower: str) -> str:
    """The last half of the text replaced by the first as many code points of another."""
    half = len(text) // 2
    return text[: len(text) - half] + follower[:half]


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every document."""
    rows = pick(docs, id="doc_id", text="text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str]] = []
        points = 0
        for batch in batches:
            for ident, text in zip(batch.column(0), batch.column(1)):
                held.append((ident.as_py(), text.as_py() or ""))
                points += len(held[-1][1])
                if points > SLICE_POINTS:
                    yield _printed(held)
                    held, points = [], 0
        yield _printed(held)

    return rows.mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def _printed(rows: list[tuple[int | None, str]]) -> pa.RecordBatch:
    texts = [text for _, text in rows]
    return pa.record_batch(
        {
            "doc_id": pa.array([ident for ident, _ in rows], pa.int64()),
            "n_chars": pa.array(map(len, texts), pa.int64()),
            "fingerprint": pa.array(prints(texts), pa.string()),
        }
    )


def with_followers(docs: DataFrame) -> DataFrame:
    """Every document beside its edited text and the document that follows in descending order of id.

    Columns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    Rows that repeat an id go by a hash of their text, rows without id come last, and the last row is
    followed by the first.

    Texts move once, to blocks of neighbouring ids. Where the blocks begin is found before, from ids
    and hashes alone: a row for each block comes to the driver. The first row of a block also goes
    to the one before it, whose last row it follows. The table is read twice and must give its rows
    in the same places; read it from files.
    """
    texts = pick(docs, id="doc_id", text="text")
    order = [F.col("id").isNull().alias("none"), (-1 - F.col("id").cast("long")).alias("down")]
    order += [F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("place")]
    keys = ["none", "down", "h", "place"]
    blocks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = texts.select(*order).repartitionByRange(blocks, *keys)
    least = F.min(F.struct(*keys)).alias("least")
    firsts = ranged.groupBy(F.spark_partition_id()).agg(least).collect()  # a row for each block
    begins = sorted(_order(*r.least) for r in firsts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in keys))
            place, take, first = [], [], []
            for i, row in enumerate(rows):
                key = _order(*row)
                block = bisect_right(begins, key) - 1
                place.append(block), take.append(i), first.append(False)
                if begins[block] == key:
                    place.append((block or len(begins)) - 1), take.append(i), first.append(True)
            dealt = batch.take(pa.array(take, pa.int64()))
            columns = [pa.array(place, pa.int32()), pa.array(first, pa.bool_()), *dealt.columns]
            yield pa.RecordBatch.from_arrays([*columns], ["block", "follows", *dealt.schema.names])

    kinds = "none boolean, down long, h long, place long, id long, text string"
    sent = texts.select(*order, F.col("id").cast("long").alias("id"), "text")
    sent = sent.mapInArrow(deal, f"block int, follows boolean, {kinds}")
    near = sent.repartitionById(max(1, len(begins)), "block").sortWithinPartitions("block", "follows", *keys)
    result = "doc_id long, n_chars long, edited_sha256 string, fingerprint string"
    result += ", edited_fingerprint string, near_edited double, near_next double"
    return near.select("block", "follows", "id", "text").mapInArrow(_compare, result)


def _order(none: bool, down: int | None, h: int, place: int) -> tuple[bool, int, int, int]:
    return none, down or 0, h, place


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int | None, str]] = []
    points, at = 0, None
    for batch in batches:
        for block, follows, ident, text in zip(*(batch.column(i) for i in range(4))):
            text, here = text.as_py() or "", block.as_py()
            if here != at:
                if held:
                    raise ValueError("the rows of the table have changed places between two reads")
                at = here
            if held and (follows.as_py() or points > SLICE_POINTS):
                yield _compared(held, text)
                held, points = [], 0
            if not follows.as_py():
                held.append((ident.as_py(), text))
                points += len(text)
    if held:
        raise ValueError("the rows of the table have changed places between two reads")


def _compared(rows: list[tuple[int | None, str]], follower: str) -> pa.RecordBatch:
    texts = [text for _, text in rows] + [follower]
    changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
    found = prints(texts + changed)
    own, other = found[: len(texts)], found[len(texts) :]
    return pa.record_batch(
        {
            "doc_id": pa.array([ident for ident, _ in rows], pa.int64()),
            "n_chars": pa.array(map(len, texts[:-1]), pa.int64()),
            "edited_sha256": pa.array([sha256(t.encode()).hexdigest() for t in changed], pa.string()),
            "fingerprint": pa.array(own[:-1], pa.string()),
            "edited_fingerprint": pa.array(other, pa.string()),
            "near_edited": pa.array(map(likeness, own, other), pa.float64()),
            "near_next": pa.array(map(likeness, own, own[1:]), pa.float64()),
        }
    )


BANDS, WIDTH = 32, 6
NEAR = 0.8


def near_groups(docs: DataFrame, at_least: float = NEAR) -> DataFrame:
    """(doc_id, group_id): documents whose fingerprints are alike, by the smallest id of the group.

    A band is WIDTH sampled digits. In each bucket of a band the smallest id leads; the likeness of
    whole fingerprints verifies who is near it, and the others play again without it, until no
    bucket holds two. Equal fingerprints are one entry whatever their number, a bucket is never
    paired with itself, and groups that share a document are one. A document without text, or
    without id, is alone.
    """
    found = stored(fingerprints(docs), "prints")
    kinds = found.where("fingerprint <> '' AND doc_id IS NOT NULL")
    kinds = kinds.groupBy("fingerprint").agg(F.min("doc_id").alias("id"))
    open_ = stored(kinds.mapInArrow(_bands, "bucket long, id long, fingerprint string"), "bands")
    links = found.join(kinds, "fingerprint").select("doc_id", "id")
    while not open_.isEmpty():
        leader = F.min(F.struct("id", "fingerprint")).alias("leader")
        leaders = open_.groupBy("bucket").agg(leader, F.count(F.lit(1)).alias("n")).where("n > 1")
        pairs = open_.join(leaders, "bucket").where(F.col("id") != F.col("leader.id"))
        flat = pairs.select("bucket", "id", "fingerprint", F.col("leader.id").alias("to"), F.col("leader.fingerprint").alias("other"))
        judged = stored(flat.mapInArrow(_judge(at_least), "bucket long, id long, fingerprint string, to long, near boolean"), "judged")
        links = links.union(judged.where("near").select("id", "to"))
        open_ = stored(judged.where("NOT near").select("bucket", "id", "fingerprint"), "bands")
    named = components(links)
    joined = found.join(named.toDF("doc_id", "group_id"), "doc_id", "left")
    return joined.select("doc_id", F.coalesce("group_id", "doc_id").alias("group_id"))


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets of a fingerprint: bands over its full ranges of steps, and over all but the last."""
    for batch in batches:
        buckets, ids, texts = [], [], []
        for text, ident in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            whole = len(text) // SAMPLES * SAMPLES
            places = {n for n in (whole, whole - SAMPLES) if n > 0} or {len(text)}
            for n in sorted(places):
                share = _SHARE[:n] / _SHARE[:n].sum()
                for band in range(BANDS):
                    chosen = np.random.default_rng([n, band]).choice(n, min(WIDTH, n), replace=False, p=share)
                    key = "".join(text[i] for i in sorted(chosen.tolist()))
                    digest = sha256(f"{n}|{band}|{key}".encode()).digest()[:8]
                    buckets.append(int.from_bytes(digest, "big", signed=True)), ids.append(ident), texts.append(text)
        columns = (pa.array(buckets, pa.int64()), pa.array(ids, pa.int64()), pa.array(texts, pa.string()))
        yield pa.RecordBatch.from_arrays([*columns], ["bucket", "id", "fingerprint"])


def _judge(at_least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(2).to_pylist(), batch.column(4).to_pylist())
            near = pa.array([likeness(a, b) >= at_least for a, b in pairs], pa.bool_())
            columns = [*(batch.column(i) for i in range(4)), near]
            yield pa.RecordBatch.from_arrays([*columns], ["bucket", "id", "fingerprint", "to", "near"])

    return run
