"""Equal-size tiles over one global order, without a global sort (WIN-1, AGG-4).

`NTILE` over an unpartitioned window sends every row through one task. Tiles are contiguous in
the order, so all that is needed are the keys at which a new tile starts: `tiles - 1` of them.
They are found in two scans, however the values are spread. The first merges quantile sketches of
the leading column, of bounded size, and counts the rows; each border then lies, up to the sketch's
error, between two known values. The second counts exactly what lies between all those values and
picks out the rows near a border, about MARGIN of all: a small number comes to the driver, counted
by key; a larger one is stored with its order columns only and searched in the same way again, never
the input. Assigning tiles is then a comparison with literals: no join, no shuffle, no window.

A value that very many rows share (one price on a third of the table) is a range of its own, which
is then searched by the next column. If rows tie in the whole order they are interchangeable, and a
tile border inside such a group is described by counts instead of numbering its rows. Sketches only
say where to look: all counts are exact, and a border that the sketch has missed is looked for where
the counts say that it is, which costs another scan.

The input is read several times and must give the same rows each time; read it from a table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from funnelry.sources.shared import shared_path

# Size of a quantile sketch; its rank error falls nearly in proportion.
SKETCH = 4096
# Sketches are merged in so many tasks before they meet in one.
MERGERS = 64
# Rows near the borders that may come to the driver, counted by key.
COLLECTED = 50_000
# Rows made by one generator call when copies are written out.
CHUNK = 100_000


@dataclass(frozen=True)
class Border:
    """The key of the first row of a tile.

    `rank` is that row's position, `before` the number of rows with a smaller key, `ties` the
    number of rows with exactly this key; the tile starts `rank - before` rows into them.
    """

    key: tuple[Any, ...]
    rank: int
    before: int
    ties: int

    @property
    def splits_ties(self) -> bool:
        return self.rank > self.before


def tile_borders(df: DataFrame, order_by: Sequence[str], tiles: int) -> list[Border]:
    """First key of tiles 2, 3, ... in ascending order; fewer if there are fewer rows than tiles.

    `order_by` names numeric columns. A NULL has no place in this order and is an error.
    """
    missing = F.raise_error(F.lit(f"NULL in the order of tiles: {', '.join(order_by)}"))
    known = " AND ".join(f"`{c}` IS NOT NULL" for c in order_by)
    keys = df.select(*order_by)
    checked = keys.where(F.when(F.expr(known), True).otherwise(missing.cast("boolean")))
    total, sketch = _sketched(checked, order_by[0])
    ranks = [r for r in _first_ranks(total, tiles) if r < total]
    return sorted(_found(keys, order_by, (), 0, total, sketch, ranks), key=lambda b: b.rank)


def margin() -> float:
    """How far a sketch's rank may be off, as a share of the rows, with some room."""
    return 2.5 * 2.296 / SKETCH**0.9021


def tile_bounds(order_by: Sequence[str], borders: Sequence[Border]) -> tuple[Column, Column]:
    """Lowest and highest tile of the rows with a row's key; they differ only if ties are split."""
    low, high = ["1"], ["1"]
    for b in borders:
        after, at = _after(order_by, b.key), _equal(order_by, b.key)
        high.append(f"int({after} OR {at})")
        low.append(f"int({after})" if b.splits_ties else high[-1])
    return F.expr(" + ".join(low)), F.expr(" + ".join(high))


def with_tiles(
    df: DataFrame,
    order_by: Sequence[str],
    tiles: int,
    name: str,
    borders: Sequence[Border] | None = None,
) -> DataFrame:
    """Adds the tile; a row whose ties are split over tiles appears once in each of them.

    Right for anything that asks which keys a tile holds (extremes, flags), as long as rows that
    tie in `order_by` also agree in what is asked. To count rows use `ntile`. `borders` are those
    of the same rows, if they have been found before.
    """
    if borders is None:
        borders = tile_borders(df, order_by, tiles)
    low, high = tile_bounds(order_by, borders)
    if not any(b.splits_ties for b in borders):
        return df.withColumn(name, low)
    return df.withColumn(name, F.explode(F.sequence(low, high)))


def ntile(df: DataFrame, order_by: Sequence[str], tiles: int, name: str) -> DataFrame:
    """The `order_by` columns of every row with its tile, one output row per input row."""
    borders = tile_borders(df, order_by, tiles)
    low, high = tile_bounds(order_by, borders)
    keys = df.select(*order_by)
    split = [b for b in borders if b.splits_ties]
    if not split:
        return keys.withColumn(name, low)
    at_split = " OR ".join(_equal(order_by, b.key) for b in split)
    whole = keys.where(f"NOT ({at_split})").withColumn(name, low)
    shares = keys.sparkSession.createDataFrame(
        _shares(borders, tiles), keys.schema.simpleString()[7:-1] + f",{name}:int,copies:bigint"
    )
    return whole.unionByName(_repeated(shares, "copies"))


def _first_ranks(total: int, tiles: int) -> list[int]:
    """Position of the first row of tiles 2..n: sizes differ by one, the larger tiles first."""
    size, larger = divmod(total, tiles)
    return [i * size + min(i, larger) for i in range(1, tiles)]


def _sketched(keys: DataFrame, column: str) -> tuple[int, Callable[..., list]]:
    """Rows, and a function from shares of the rows to values and back: one scan.

    The sketches of all tasks are merged in MERGERS tasks first.
    """
    whole = not isinstance(keys.schema[column].dataType, (T.FloatType, T.DoubleType))
    kind = "bigint" if whole else "double"
    build, merge, quantile, rank = (
        getattr(F, name)
        for name in (
            f"kll_sketch_agg_{kind}",
            f"kll_merge_agg_{kind}",
            f"kll_sketch_get_quantile_{kind}",
            f"kll_sketch_get_rank_{kind}",
        )
    )
    size = F.lit(SKETCH)
    parts = keys.groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGERS))).agg(
        F.count(F.lit(1)).alias("n"), build(F.col(column).cast(kind), size).alias("sketch")
    )
    found = parts.agg(F.sum("n").alias("n"), merge("sketch", size).alias("sketch")).first()
    spark = keys.sparkSession

    def asked(read, values: Sequence) -> list:
        listed = F.array(*(F.lit(v).cast(kind if read is rank else "double") for v in values))
        one = spark.sql("SELECT 1").select(read(F.lit(bytes(found.sketch)), listed))
        return list(one.first()[0]) if values else []

    def look(shares: Sequence[float] = (), values: Sequence = ()) -> list:
        return asked(quantile, shares) if shares else asked(rank, values)

    return found.n or 0, look


def _found(
    keys: DataFrame,
    order_by: Sequence[str],
    fixed: tuple[Any, ...],
    before: int,
    total: int,
    look: Callable[..., list],
    ranks: Sequence[int],
) -> list[Border]:
    """The borders at these ranks, all of them among the `total` rows of `keys`.

    The rows agree in the leading columns, `fixed`, and `before` rows lie before them.
    """
    if not ranks:
        return []
    column, error = order_by[len(fixed)], margin() + 1 / total
    middle = [(r - before + 0.5) / total for r in ranks]
    shares = [min(1.0, max(0.0, m + e)) for m in middle for e in (-error, error)]
    ends = look(shares=shares)
    cuts = sorted(set(ends))
    near = set()  # segments around the borders
    for low, high in zip(ends[::2], ends[1::2]):
        near.update(range(2 * cuts.index(low) + 1, 2 * cuts.index(high) + 2))
    at = look(values=[x for c in cuts for x in (_below(c), c)])
    rows = total * (sum(at[1::2]) - sum(at[::2]) + 2 * error * len(ranks))
    segment = _segment(column, cuts)
    spark, borders = keys.sparkSession, []
    path = shared_path(spark, "borders") if rows > COLLECTED else None
    if rows <= COLLECTED:
        inside = _counted(keys, order_by, segment, near)
        sizes = {s: sum(n for _, n in found) for s, found in inside.items()}
    elif path:
        sizes = _kept(keys, segment, near, path, 2 * len(cuts) + 1)
        place = T.StructField("_segment", T.IntegerType())
        kept = spark.read.schema(T.StructType([*keys.schema, place])).parquet(path)
    else:
        counts = keys.groupBy(F.expr(segment).alias("s")).agg(F.count(F.lit(1)).alias("n"))
        sizes = {r.s: r.n for r in counts.collect()}
    start = before
    for s in sorted(sizes):
        own = [r for r in ranks if start <= r < start + sizes[s]]
        if own and s in near and rows <= COLLECTED:
            borders += _walked(inside[s], start, own)
        elif own:
            source = kept if path and s in near else keys.withColumn("_segment", F.expr(segment))
            part = source.where(F.col("_segment") == s).drop("_segment")
            value = (*fixed, cuts[s // 2]) if s % 2 else fixed
            if len(value) == len(order_by):
                borders += [Border(value, r, start, sizes[s]) for r in own]
            else:
                n, further = _sketched(part, order_by[len(value)])
                borders += _found(part, order_by, value, start, n, further, own)
        start += sizes[s]
    return borders


def _below(value: float | int) -> float | int:
    return value - 1 if isinstance(value, int) and value > -(2**63) else math.nextafter(value, -math.inf)


def _segment(column: str, cuts: Sequence[Any]) -> str:
    """2 * i + 1 for the value cuts[i], 2 * i for values between it and the one before."""
    cases = [
        f"WHEN `{column}` {op} {_literal(c)} THEN {2 * i + odd}"
        for i, c in enumerate(cuts)
        for odd, op in enumerate(("<", "="))
    ]
    return f"CASE {' '.join(cases)} ELSE {2 * len(cuts)} END"


def _counted(
    keys: DataFrame, order_by: Sequence[str], segment: str, near: Iterable[int]
) -> dict[int, list[tuple[tuple, int]]]:
    """Keys of the near segments with their rows, in order; of the others only the rows: one scan."""
    placed = keys.select(F.expr(segment).alias("_segment"), *order_by)
    own = F.col("_segment").isin(*near)
    grouped = placed.groupBy("_segment", *(F.when(own, F.col(c)).alias(c) for c in order_by))
    found: dict[int, list[tuple[tuple, int]]] = {}
    for row in grouped.agg(F.count(F.lit(1)).alias("_rows")).collect():
        found.setdefault(row["_segment"], []).append((tuple(row)[1:-1], row["_rows"]))
    return {s: sorted(rows) if s in near else rows for s, rows in found.items()}


def _kept(
    keys: DataFrame, segment: str, near: Iterable[int], path: str, segments: int
) -> dict[int, int]:
    """Stores the rows of the near segments and counts those of each: one scan.

    Rows are counted in the stage that writes, so a task that is run again is counted once.
    """
    seen = Observation("segments")
    placed = keys.withColumn("_segment", F.expr(segment))
    counts = [F.count_if(F.col("_segment") == s).alias(f"s{s}") for s in range(segments)]
    placed.observe(seen, *counts).where(F.col("_segment").isin(*near)).write.parquet(path)
    return {s: seen.get[f"s{s}"] for s in range(segments)}


def _walked(rows: Sequence[tuple[tuple, int]], before: int, ranks: Sequence[int]) -> list[Border]:
    """The borders at these ranks, from sorted keys with their numbers of rows."""
    borders = []
    for key, ties in rows:
        borders += [Border(key, r, before, ties) for r in ranks if before <= r < before + ties]
        before += ties
    return borders


def _equal(order_by: Sequence[str], key: Sequence[Any]) -> str:
    return "(" + " AND ".join(f"`{c}` = {_literal(v)}" for c, v in zip(order_by, key)) + ")"


def _after(order_by: Sequence[str], key: Sequence[Any]) -> str:
    """Lexicographically greater than the key."""
    cases = []
    for i, (c, v) in enumerate(zip(order_by, key)):
        greater = f"`{c}` > {_literal(v)}"
        cases.append(f"{_equal(order_by[:i], key[:i])} AND {greater}" if i else greater)
    return "(" + " OR ".join(f"({c})" for c in cases) + ")"


def _literal(value: float | int) -> str:
    if isinstance(value, int):
        return f"{value}L"
    return f"double('{value!r}')" if math.isinf(value) else f"{value!r}D"


def _shares(borders: Sequence[Border], tiles: int) -> list[tuple]:
    """(key, tile, copies) for every key whose ties are split over tiles."""
    rows = []
    for key, first in {b.key: b for b in borders if b.splits_ties}.items():
        end = first.before + first.ties
        starts = [first.before, *(b.rank for b in borders if first.before < b.rank < end), end]
        lowest = 1 + sum(b.rank <= first.before for b in borders)
        rows += [
            (*key, lowest + i, stop - start)
            for i, (start, stop) in enumerate(zip(starts, starts[1:]))
        ]
    return rows


def _repeated(df: DataFrame, times: str) -> DataFrame:
    """Each row `times` times; long runs are spread over tasks in chunks."""
    chunks = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(times) - 1) / CHUNK))
    size = F.least(F.lit(CHUNK), F.col(times) - F.col("_chunk") * CHUNK)
    return (
        df.withColumn("_chunk", F.explode(chunks))
        .repartition("_chunk")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), size)))
        .drop(times, "_chunk", "_copy")
    )
