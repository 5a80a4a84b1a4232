import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from funnelry.llm import oracles, queries, threshold_topk

SCHEMA = "vec_id long, embedding array<float>, EMBEDDING int"


def vectors(spark, *rows):
    return spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)


def brute(rows, k, every):
    out = []
    usable = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    whole = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in usable]
    for q, a in whole:
        if q % every:
            continue
        scores = [(-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in whole if i != q and len(b) == len(a)]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("dims", [2, 3, 16])
def test_as_brute_force(spark, monkeypatch, dims):
    monkeypatch.setattr(threshold_topk, "CANDIDATES", 120)
    monkeypatch.setattr(threshold_topk, "QUERIES", 10)
    pick = random.Random(dims)
    rows = [(i, [round(pick.uniform(-1, 1), 1) for _ in range(dims)]) for i in range(500)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)]
    result = threshold_topk.top_k(vectors(spark, *rows), F.col("vec_id") % 20 == 0, k=7).collect()
    assert sorted(map(tuple, result)) == brute(rows, 7, 20)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5]), (20, [0.0, 0.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]),
        (5, [1.0, 0.5]), (6, [0.5]), (40, [2.0]), (None, [9.0, 9.0]), (7, [-1.0, -1.0]), (8, []), (60, []),
        (9, [1e15, -1e15]), (10, [1e13, 3e12]),
    ]
    result = threshold_topk.top_k(vectors(spark, *rows), F.col("vec_id") % 20 == 0).collect()
    assert sorted(map(tuple, result)) == brute(rows, 20, 20)
    assert [r.vec_id for r in result if r.query_id == 20] == [0, 5, 7, 9, 10]
    assert [r.vec_id for r in result if r.query_id == 0] == [9, 10, 5, 20, 7]
    assert threshold_topk.top_k(vectors(spark), F.col("vec_id") % 20 == 0).collect() == []


def test_large_components_keep_their_value(spark):
    rows = [(0, [1.0]), (1, [600_000.0]), (2, [700_000.0])]
    result = threshold_topk.top_k(vectors(spark, *rows), F.col("vec_id") == 0).collect()
    assert sorted(map(tuple, result)) == [(0, 1, 2, 2_867_200_000), (0, 2, 1, 2_457_600_000)]


def test_only_scores_beyond_a_long_are_errors(spark):
    huge = [(0, [1e9, 1e9]), (1, [1e9, -1e9]), (2, [-1e9, 1e9])]  # products are no longs, their sums are
    result = threshold_topk.top_k(vectors(spark, *huge), F.col("vec_id") == 0).collect()
    assert sorted(map(tuple, result)) == brute(huge, 20, 20)
    for far in ([1e30, 0.0], [1e16, 0.0]):
        with pytest.raises(Exception, match="too large"):
            threshold_topk.top_k(vectors(spark, (0, [1e5, 0.0]), (1, far)), F.col("vec_id") == 0).collect()


@pytest.mark.parametrize(("shape", "share"), [("long tails", 1.0), ("even", 0.9)])
def test_queries_end_by_the_bound(shape, share):
    pick = np.random.default_rng(4)
    given = (pick.pareto(1.5, (4_000, 3)) if shape == "long tails" else pick.uniform(-1, 1, (4_000, 8))) * 64
    given, reached = np.floor(given).astype(np.int64), []
    threshold_topk.search_block(np.arange(50), given[:50], np.arange(4_000), given, 20, reached)
    assert np.mean(np.array(reached) < 4_000) >= share


def test_repeated_rows(spark):
    rows = [(0, [1.0]), (0, [1.0]), (1, [1.0]), (1, [1.0]), (2, [0.5])]
    result = threshold_topk.top_k(vectors(spark, *rows), F.col("vec_id") == 0).collect()
    assert [tuple(r) for r in sorted(result, key=lambda r: r.rank)] == [(0, 1, 1, 4096), (0, 2, 1, 4096), (0, 3, 2, 2048)]


def test_stops_early():
    """Long tails: the bound falls below the best results after a few entries of each list."""
    pick = np.random.default_rng(1)
    given = (pick.pareto(1.5, (4_000, 3)) * 100).astype(np.int64)
    asked = np.abs(pick.integers(1, 5, (5, 3)))
    ids = np.arange(4_000)
    query, found, score = threshold_topk.search_block(10_000 + np.arange(5), asked, ids, given, 10)
    for n, q in enumerate(asked):
        all_ = given @ q
        order = np.lexsort((ids, -all_))[:10]
        own = query == 10_000 + n
        assert found[own].tolist() == order.tolist() and score[own].tolist() == all_[order].tolist()


def test_query_as_sql(spark, tmp_path, duck, same):
    pick = random.Random(3)
    rows = [(i, [round(pick.uniform(-1, 1), 3) for _ in range(8)]) for i in range(300)] + [(301, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    table.write.parquet(str(tmp_path / "embeddings.parquet"))
    same(queries.op9_threshold_topk(spark, str(tmp_path)), duck(oracles.OP9, embeddings=table))
