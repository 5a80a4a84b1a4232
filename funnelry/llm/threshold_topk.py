"""Exact search for the largest inner products with Fagin's threshold algorithm, in blocks.

Candidates and queries are dealt into blocks of bounded size, and each pair of a candidate and a
query block is one task's work. Within it every dimension has its list of candidates, sorted by
component. A query reads all lists from the end that raises its score, scores every candidate that
it meets, and stops at the depth where the bound on all unread ones, the inner product with the
last components read, is below its k-th result; equal scores may still win by their id, so a bound
that equals the k-th result does not stop it. The best k of each block are merged per query.

Scores are inner products of whole numbers, floor(scale * component). Edge cases: vectors that are
NULL or hold NULL or non-finite components, and rows without id, take no part; only vectors of the
query's length are its candidates; a number or a score that is no long is an error, and larger steps
on the way to one that is are taken in whole numbers of any size; equal scores go to the smaller id; rows with the query's own id are no candidates
of it, other repeated rows each are; no rows give no result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelry.llm.stores import pick, stored

SCALE = 64
K = 20
CANDIDATES = 4096
QUERIES = 1024
#: The bound is tested at the first depth and at depths that grow by this factor.
FIRST_DEPTH, DEEPER = 4, 1.2
LONG = 1 << 63


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    def number(x: Column) -> Column:
        wide = F.lit(float(scale)) * x.cast("double")
        far = F.raise_error(F.lit("a component is too large for a whole number")).cast("long")
        return F.when(F.abs(wide) < F.lit(float(LONG)), F.floor(wide)).otherwise(far)

    return F.transform(vector, number)


def usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & F.forall(vector, finite)


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    values = column.combine_chunks()
    values = values.flatten() if isinstance(values, pa.ListArray) else values
    return values.to_numpy(zero_copy_only=False).reshape(n, -1)


def best(score: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k largest scores in order, equal ones by place."""
    if len(score) > k:
        near = np.flatnonzero(score >= np.partition(score, -k)[-k])
    else:
        near = np.arange(len(score))
    if score.dtype == object:
        return near[sorted(range(len(near)), key=lambda i: (-score[near[i]], place[near[i]]))][:k]
    return near[np.lexsort((place[near], -score[near]))][:k]


def search_block(
    query_ids: np.ndarray,
    queries: np.ndarray,
    ids: np.ndarray,
    vectors: np.ndarray,
    k: int,
    reached: list[int] | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score) of each query's k best in this block.

    `reached` gets the depth at which each query has stopped; the length of the lists if the bound
    never fell below its k-th result.
    """
    by_id = np.argsort(ids, kind="stable")
    ids, vectors = ids[by_id], vectors[by_id]
    n, dims = vectors.shape
    size = lambda x: max((abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))))
    most = size(queries) * size(vectors) * max(dims, 1)
    kind = np.float64 if most < 1 << 53 else np.int64 if most < LONG else object
    vectors, queries = vectors.astype(kind), queries.astype(kind)
    lists = np.argsort(vectors, axis=0, kind="stable")
    ordered = np.take_along_axis(vectors, lists, 0)
    rank = np.empty(lists.shape, np.int16 if n < 1 << 15 else np.int64)
    np.put_along_axis(rank, lists, np.arange(n, dtype=rank.dtype)[:, None], 0)
    rank = np.ascontiguousarray(rank.T)
    steps = math.ceil(math.log(max(n, 2)) / math.log(DEEPER))
    depths = np.unique([min(n, int(FIRST_DEPTH * DEEPER**i)) for i in range(steps + 1)] + [n])
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    bounds = up @ ordered[n - depths].T + down @ ordered[depths - 1].T
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(len(queries)):
        step = 0
        while True:
            depth = int(depths[step])
            # Met: among the last entries of a list that raises the score, or the first of one that lowers it.
            low = np.where(queries[at] < 0, depth, 0).astype(rank.dtype)[:, None]
            high = np.where(queries[at] > 0, n - depth, n).astype(rank.dtype)[:, None]
            seen = ((rank < low) | (rank >= high)).any(axis=0) | (depth == n)
            met = np.flatnonzero(seen & (ids != query_ids[at]))
            score = vectors[met] @ queries[at] if 2 * len(met) < n else (vectors @ queries[at])[met]
            if depth == n:
                break
            below = np.zeros(0, np.int64)
            if len(score) >= k:
                below = np.flatnonzero(bounds[at] < np.partition(score, -k)[-k])
                if len(below) and below[0] <= step:
                    break
            # The k-th result can only rise, so the first depth with a lower bound is enough.
            step = int(below[0]) if len(below) else step + 1 if len(score) < k else len(depths) - 1
        if reached is not None:
            reached.append(int(depth))
        top = best(score, met, k)
        if kind is object and any(abs(x) >= LONG for x in score[top]):
            raise OverflowError("a score is too large for a long")
        out.append((np.full(len(top), query_ids[at]), ids[met[top]], score[top].astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def top_k(
    vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE
) -> DataFrame:
    """query_id, rank, vec_id, score; `is_query` is a condition on `vec_id`."""
    rows = pick(vectors, vec_id="vec_id", vector="embedding")
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    rows = rows.select("vec_id", F.size("vector").alias("dims"), whole_numbers(F.col("vector"), scale).alias("x"))
    rows = stored(rows, "vectors")
    counts = rows.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    n, m = (max(1, math.ceil(c / size)) for c, size in zip(counts, (CANDIDATES, QUERIES), strict=True))
    block = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(n)).cast("int")
    query_block = F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(m)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    candidates = rows.select("vec_id", "dims", "x", block.alias("b")).withColumn("q", every(m))
    queries = rows.where(is_query).dropDuplicates(["vec_id", "x"])
    queries = queries.select("vec_id", "dims", "x", query_block.alias("q")).withColumn("b", every(n))
    schema = "query_id long, vec_id long, score long"

    def search(asked: pa.Table, given: pa.Table) -> pa.Table:
        found = (np.zeros(0, np.int64),) * 3
        if len(asked) and len(given):
            sides = [(t["vec_id"].to_numpy(), _matrix(t["x"], len(t))) for t in (asked, given)]
            found = search_block(*sides[0], *sides[1], k)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    keys = ("b", "q", "dims")
    found = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(search, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
