import hashlib
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from funnelry.llm import oracles, prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, TEXT int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def trie(paths):
    """Rows by brute force from {conv_id: [(role, text), ...]}."""
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    rows = []
    for node, convs in members.items():
        below = [m for m in members if m[: len(node)] == node]
        ends = ",".join(str(c) for c in sorted(convs) if len(paths[c]) == len(node))
        child = lambda m: [x for x in members if len(x) == len(m) + 1 and x[: len(m)] == m]
        rows.append(
            {
                "conv_id": min(convs), "depth": len(node), "parent_conv_id": min(members[node[:-1]]) if node else None,
                "n_convs": len(convs), "n_children": len(child(node)), "n_leaves": sum(not child(m) for m in below),
                "saved_tokens": sum((len(members[m]) - 1) * len(WORD.findall(m[-1][1])) for m in below if m),
                "ends_sha256": hashlib.sha256(ends.encode()).hexdigest(),
            }
        )
    return rows


def rebuilt(rows):
    talks = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            talks[c].append((turn is not None, turn or 0, role or "", text or ""))
    talks = {c: [t[2:] for t in sorted(v)] for c, v in talks.items()}
    out = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = talks.get(c - c % 20, [])[:h] + own[h:]
    return out


def rows_of_talks(n):
    texts = ["hello there", "", None, "a b c", "\tx  y\n", "é"]
    for c in range(n):
        for t in range(c % 7):
            yield c, (t if c % 11 or t else None), ("user", "assistant", None)[t % 3], texts[(c % 20 // 7 + t * (c % 3)) % 6]


def checked(df):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return df.select(*names)


@pytest.mark.parametrize("block_turns", [1, 7, 1 << 18])
def test_query_by_brute_force(spark, tmp_path, same, duck, block_turns, monkeypatch):
    rows = [*rows_of_talks(130), (None, 0, "user", "lost"), (4, None, "user", "a b c"), (64, 9, "user", "end")]
    talks = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA.replace("TEXT", "extra"))
    talks.repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    monkeypatch.setattr(prefix_trie, "BLOCK_TURNS", block_turns)
    found = queries.op12_prefix_trie(spark, str(tmp_path))
    same(found, trie(rebuilt(rows)))
    if block_turns == 7:
        same(found, duck(oracles.OP12, conversations=talks))


def plain(spark, paths):
    rows = [(c, t, *turn, 1) for c, path in paths.items() for t, turn in enumerate(path)]
    return prefix_trie.conversations(spark.createDataFrame(rows, SCHEMA))


@pytest.mark.parametrize("partitions", [1, 5])
def test_equal_and_nested_conversations(spark, same, partitions):
    a, b, c = ("user", "one two"), ("assistant", "three"), ("user", "")
    paths = {k: [[a], [a, b], [a, b, c], [b], [a, b]][k % 5] for k in range(-40, 60)}
    convs = plain(spark, paths)
    with_none = convs.union(convs.where("conv_id = 3").select(F.lit(99).cast("long"), F.slice("turns", 1, 0)))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        same(checked(prefix_trie.nodes(with_none)), trie({**paths, 99: []}))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_long_conversation(spark, same):
    path = [("user", f"word {k % 3}") for k in range(300)]
    same(checked(prefix_trie.nodes(plain(spark, {1: path, 2: path[:299], 3: path[:150]}))), trie({1: path, 2: path[:299], 3: path[:150]}))


def test_role_and_text_are_told_apart(spark):
    found = prefix_trie.nodes(plain(spark, {1: [("a", "bc")], 2: [("ab", "c")], 3: [("a", "bc")]}))
    assert sorted((r.depth, r.n_convs) for r in found.collect()) == [(0, 3), (1, 1), (1, 2)]


def test_empty_table(spark):
    assert prefix_trie.nodes(plain(spark, {})).collect() == []


def test_repeated_and_tied_rows_have_one_order(spark):
    rows = [(1, 0, "user", t, 1) for t in "bacb"]
    forward, backward = (
        prefix_trie.conversations(spark.createDataFrame(r, SCHEMA)).first().turns for r in (rows, rows[::-1])
    )
    assert forward == backward and len(forward) == 4
