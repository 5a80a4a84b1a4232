"""Trie of conversation prefixes from sorted conversations, by range minima over shared prefixes.

Each turn becomes a 128-bit mark of its role and text, a conversation the string of its marks, its
path. Paths are sorted over all machines. Members of a prefix then stand next to each other: with
the longest common prefix of each pair of neighbours, and a sparse table of minima over it, every
prefix of every conversation finds the left and the right end of its members by two binary searches
of its own. No stack is carried from row to row, so all prefixes of a block are searched at once,
and sums over subtrees are differences of running sums over the interval.

A block is a run of neighbouring conversations within a task. A prefix whose members reach over the
end of a block is found in each of them, and Spark adds up its parts by the digest of the prefix;
what two blocks count twice is taken back where they meet, from the last row of one and the first of
the next. A group of equal conversations of any size is split over blocks in this way.

Edge cases: rows without a conversation id take no part; a NULL role or text counts as empty; turns
go by their number, NULL first, and equal ones by their mark; repeated rows are turns of their own;
a conversation without turns is a member of the root alone; an empty table gives an empty result.
A conversation is one row of some 24 bytes a turn, however long its texts are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelry.llm.stores import pick, stored

MARK = 16
#: Turns of a block; a longer conversation is a block alone.
BLOCK_TURNS = 1 << 18
SPACED = r"[^\x20\x09-\x0D]+"
ROOT = bytes(MARK)

_NODE = "part int, kind int, key binary, parent binary, depth long, conv_id long, n_convs long"
_NODE += ", n_children long, n_leaves long, saved_tokens long, first_end long, ends string"
_EDGE = ", path binary, words array<bigint>"
NODE, CORRECTION, ENDS, FIRST, LAST = range(5)


def mark(role: Column, text: Column) -> Column:
    """128 bits of a turn as hexadecimal digits; the length keeps role and text apart."""
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.sha2(whole.cast("binary"), 256), 1, 2 * MARK)


def conversations(talks: DataFrame, *together: Column) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, as marks and numbers of words.

    `together` names further expressions of `conv_id` that are kept as columns g0, g1, ...; rows
    are then dealt out by the first of them, so that a later step by it need not move them again.
    """
    rows = pick(talks, conv_id="conv_id", turn="turn", role="role", text="text").where("conv_id IS NOT NULL")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    groups = [g.alias(f"g{i}") for i, g in enumerate(together)]
    words = F.regexp_count(text, F.lit(SPACED)).cast("long").alias("words")
    slim = rows.select("conv_id", *groups, F.struct("turn", mark(role, text).alias("mark"), words).alias("t"))
    if groups:
        slim = slim.repartition("g0")
    by = [*(f"g{i}" for i in range(len(groups))), "conv_id"]
    ordered = F.sort_array(F.collect_list("t"))
    turns = F.transform(ordered, lambda t: F.struct(t["mark"].alias("mark"), t["words"].alias("words")))
    return slim.groupBy(*by).agg(turns.alias("turns"))


def nodes(convs: DataFrame) -> DataFrame:
    """The trie of conversations (conv_id, turns), one row for each different prefix.

    key and parent are digests (the root has no parent); conv_id is the smallest member and depth
    the number of turns, so they name the prefix itself; n_convs counts members, n_children and
    n_leaves children and childless nodes below; saved_tokens adds up, over the node and all below,
    the words of the last turn for each member but one; ends_sha256 is the digest of the ids that
    end here, joined by commas in numeric order.
    """
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["mark"]), ""))
    words = F.transform("turns", lambda t: t["words"])
    paths = convs.select("conv_id", path.alias("path"), words.alias("words"))
    ordered = paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    placed = ordered.withColumn("part", F.spark_partition_id())
    found = stored(placed.mapInArrow(_search, _NODE + _EDGE), "prefixes")

    edges = found.where(F.col("kind") >= FIRST)  # two rows for each partition
    met = edges.repartition(1).sortWithinPartitions("part", "kind").mapInArrow(_meet, _NODE)
    parts = found.where(F.col("kind") <= CORRECTION).drop("path", "words").unionByName(met)
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    least = F.min("conv_id").alias("conv_id")
    whole = stored(parts.groupBy("key", "parent", "depth").agg(least, *sums), "nodes")

    ends = found.where(F.col("kind") == ENDS).select("key", "first_end", "ends")
    ends = ends.repartition("key").sortWithinPartitions("key", "first_end")
    digests = ends.mapInArrow(_digest, "key binary, ends_sha256 string")
    above = whole.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    named = whole.join(above, "parent", "left").join(digests, "key", "left")
    return named.withColumn("ends_sha256", F.coalesce("ends_sha256", none))


@dataclass
class Block:
    """Neighbouring conversations: ids, marks one after the other, running words."""

    ids: np.ndarray
    paths: list[bytes]
    marks: np.ndarray
    first: np.ndarray
    length: np.ndarray
    upto: np.ndarray  # words before each turn, within all of the block
    words: list[np.ndarray]

    @classmethod
    def of(cls, table: pa.Table) -> Block:
        paths = table["path"].to_pylist()
        length = np.array([len(p) // MARK for p in paths], np.int64)
        marks = np.frombuffer(b"".join(paths), np.uint64).reshape(-1, MARK // 8)
        first = np.concatenate([[0], np.cumsum(length)])
        words = [np.array(w or [], np.int64) for w in table["words"].to_pylist()]
        flat = np.concatenate([np.zeros(0, np.int64), *words])
        upto = np.concatenate([[0], np.cumsum(flat)])
        return cls(table["conv_id"].to_numpy(), paths, marks, first, length, upto, words)

    def tokens(self, row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Words of the first `depth` turns."""
        return self.upto[self.first[row] + depth] - self.upto[self.first[row]]

    def common(self) -> np.ndarray:
        """Turns shared with the conversation before; -1 for the first."""
        out = np.zeros(len(self.ids), np.int64)
        out[:1] = -1
        open_, t = np.arange(1, len(out)), 0
        while len(open_):
            open_ = open_[(self.length[open_] > t) & (self.length[open_ - 1] > t)]
            here, before = self.marks[self.first[open_] + t], self.marks[self.first[open_ - 1] + t]
            open_ = open_[(here == before).all(axis=1)]
            t += 1
            out[open_] = t
        return out


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """Level k holds the minimum of 2**k values from each place on."""
    levels = [values]
    while 2 << (len(levels) - 1) <= len(values):
        half, below = 1 << (len(levels) - 1), levels[-1]
        levels.append(np.minimum(below[:-half], below[half:]))
    return levels


def extents(levels: list[np.ndarray], row: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last row that share `depth` turns with a row, each by a binary search of its own."""
    n = len(levels[0])
    left, right = row.copy(), row.copy()
    for k in range(len(levels) - 1, -1, -1):
        table, step = levels[k], 1 << k
        # rows right+1 .. right+step all share that much with the row before them
        at = np.minimum(right + 1, len(table) - 1)
        right += step * ((right + step < n) & (table[at] >= depth))
        at = np.maximum(left - step + 1, 0)
        left -= step * ((left - step >= 0) & (table[np.minimum(at, len(table) - 1)] >= depth))
    return left, right


def least(levels: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of the values from low to high, both included."""
    k = np.frexp((high - low + 1).astype(float))[1] - 1
    out = np.empty(len(low), levels[0].dtype)
    for level, table in enumerate(levels):
        at = k == level
        out[at] = np.minimum(table[low[at]], table[high[at] - (1 << level) + 1])
    return out


def _key(parent: bytes, turn: bytes) -> bytes:
    return hashlib.sha256(parent + turn).digest()[:MARK]


def _keys(path: bytes, known: list[bytes]) -> list[bytes]:
    """Digests of all prefixes of a path; `known` are those of its first turns."""
    keys = known or [ROOT]
    for at in range((len(keys) - 1) * MARK, len(path), MARK):
        keys.append(_key(keys[-1], path[at : at + MARK]))
    return keys


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    before: tuple | None = None
    part = 0
    for batch in batches:
        for table in _blocks(batch):
            block = Block.of(table)
            part = table["part"][0].as_py()
            row = lambda i: (block.paths[i], block.words[i])  # noqa: E731, B023
            if before is None:
                yield _edge(part, FIRST, *row(0))
            else:
                yield _correction(part, before, row(0))
            yield from _prefixes(part, block)
            before = row(-1)
    if before is not None:
        yield _edge(part, LAST, *before)


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.Table]:
    turns = np.cumsum(pc.binary_length(batch["path"]).to_numpy(zero_copy_only=False) // MARK)
    at = 0
    while at < len(batch):
        done = turns[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(turns, done + BLOCK_TURNS, "right")))
        yield pa.Table.from_batches([batch.slice(at, to - at)])
        at = to


def _prefixes(part: int, block: Block) -> Iterator[pa.RecordBatch]:
    n, length, common = len(block.ids), block.length, block.common()
    shared, ids = sparse_table(common), sparse_table(block.ids)
    row = np.repeat(np.arange(n), length + 1)
    depth = np.arange(len(row)) - np.repeat(block.first[:-1] + np.arange(n), length + 1)
    low, high = extents(shared, row, depth)
    once = low == row  # all members find the same ends; the first of them reports
    row, depth, low, high = row[once], depth[once], low[once], high[once]

    after = np.append(common[1:], -1)
    leaves = np.concatenate([[0], np.cumsum(after < length)])
    pairs = block.tokens(np.arange(n), np.maximum(common, 0))
    pairs = np.concatenate([[0], np.cumsum(pairs)])  # words shared by neighbours
    above = block.tokens(row, np.maximum(depth - 1, 0))
    saved = pairs[high + 1] - pairs[low + 1] - (high - low) * above
    # Conversations equal to the first member, if that ends here, come first.
    equal = np.zeros(n, bool)
    equal[1:] = (common[1:] == length[1:]) & (length[1:] == length[:-1])
    run_end = np.append(np.flatnonzero(~equal), n)
    run_end = run_end[np.searchsorted(run_end, np.arange(n), "right")]
    ended = np.where(length[low] == depth, run_end[low] - low, 0)
    begins = low + ended
    at_depth = np.sort((common + 1) * (n + 1) + np.arange(n))
    between = lambda start, stop: np.searchsorted(at_depth, (depth + 1) * (n + 1) + stop) - np.searchsorted(
        at_depth, (depth + 1) * (n + 1) + start
    )
    children = np.where(begins <= high, 1 + np.maximum(between(begins + 1, high + 1), 0), 0)

    known: list[bytes] = []
    keys, parents = [], []
    of_row = np.searchsorted(row, np.arange(n + 1))
    for i in range(n):
        known = _keys(block.paths[i], known[: common[i] + 1])
        for d in depth[of_row[i] : of_row[i + 1]].tolist():
            keys.append(known[d])
            parents.append(known[d - 1] if d else None)
    yield _batch(
        part, NODE, keys, parents, depth,
        conv_id=least(ids, low, high), n_convs=high - low + 1, n_children=children,
        n_leaves=leaves[high + 1] - leaves[low], saved_tokens=saved,
    )
    some = np.flatnonzero(ended)
    lists = [block.ids[low[i] : low[i] + ended[i]] for i in some]
    yield _batch(
        part, ENDS, [keys[i] for i in some], [None] * len(some), depth[some],
        first_end=np.array([x[0] for x in lists], np.int64), ends=[",".join(map(str, x.tolist())) for x in lists],
    )


def _correction(part: int, before: tuple, after: tuple) -> pa.RecordBatch:
    """What two blocks that meet between two rows count twice or not at all."""
    (path, _), (next_path, words) = before, after
    shorter = min(len(path), len(next_path)) // MARK
    same = 0
    while same < shorter and path[same * MARK : (same + 1) * MARK] == next_path[same * MARK : (same + 1) * MARK]:
        same += 1
    keys = _keys(next_path[: same * MARK], [])
    depth = np.arange(same + 1)
    upto = np.concatenate([[0], np.cumsum(words[:same])])
    return _batch(
        part, CORRECTION, keys, [None, *keys[:-1]], depth,
        n_convs=np.zeros(same + 1, np.int64), n_children=-(depth < same).astype(np.int64),
        n_leaves=np.full(same + 1, -int(same * MARK == len(path))), saved_tokens=upto[same] - upto[np.maximum(depth - 1, 0)],
    )


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corrections where the last row of a partition meets the first of the next."""
    before: tuple | None = None
    for batch in batches:
        for row in batch.select(["kind", "path", "words"]).to_pylist():
            here = (row["path"], np.array(row["words"] or [], np.int64))
            if row["kind"] == FIRST and before is not None:
                yield _correction(0, before, here).select(pa.schema(_fields(_NODE)).names)
            before = here


def _fields(ddl: str) -> list[pa.Field]:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64())}
    return [pa.field(name, kinds[kind]) for name, kind in (c.split(" ") for c in ddl.split(", "))]


def _batch(part: int, kind: int, keys: list, parents: list, depth: np.ndarray, **columns) -> pa.RecordBatch:
    n = len(keys)
    known = {"part": [part] * n, "kind": [kind] * n, "key": keys, "parent": parents, "depth": depth, **columns}
    fields = _fields(_NODE + _EDGE)
    arrays = [pa.array(known[f.name], f.type) if f.name in known else pa.nulls(n, f.type) for f in fields]
    return pa.RecordBatch.from_arrays(arrays, schema=pa.schema(fields))


def _edge(part: int, kind: int, path: bytes, words: np.ndarray) -> pa.RecordBatch:
    return _batch(part, kind, [None], [None], [None], path=[path], words=[words.tolist()])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of all ids that end at a node, read in order and never held together."""
    key, state = None, hashlib.sha256()
    for batch in batches:
        keys, digests = [], []
        for k, ends in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if k == key:
                state.update(b"," + ends.encode())
                continue
            if key is not None:
                keys.append(key), digests.append(state.hexdigest())
            key, state = k, hashlib.sha256(ends.encode())
        yield pa.record_batch({"key": pa.array(keys, pa.binary()), "ends_sha256": pa.array(digests, pa.string())})
    if key is not None:
        yield pa.record_batch({"key": pa.array([key], pa.binary()), "ends_sha256": pa.array([state.hexdigest()], pa.string())})

