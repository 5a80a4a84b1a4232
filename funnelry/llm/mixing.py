"""Mixing sources to target weights: capped water-filling, then seeded repetitions of documents.

Every source gets a share of all words by its weight. A source can give its words at most
`max_epochs` times; what it cannot give is dealt to the others by weight, until no target is above
its cap. A target of 2.3 epochs takes each document of the source twice and draws documents for
the remaining 0.3: documents are put in the order of a seeded digest and taken from the front until
the words drawn are as near to the target as that order allows. The border is found by three
histograms of 256 digest ranges per source, so no window or task holds more of a source than that,
however large it is; reruns take the same documents.

Edge cases: NULL or empty texts have size 0; a NULL source is a source of its own, last in order;
a source without words has target 0 and its documents are not taken; rows that repeat id and text
share a digest and are drawn together; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelry.llm.stores import MAX_BROADCAST_ROWS, pick, stored

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"
DIGEST_BITS = 24
LEVEL_BITS = 8


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place_in_draw(id_: Column, text: Column, seed: str) -> Column:
    """The first 24 bits of a seeded digest of a document."""
    parts = (F.coalesce(x.cast("string"), F.lit("")) for x in (id_, text))
    digest = F.md5(F.concat_ws("|", F.lit(seed), *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, DIGEST_BITS // 4), 16, 10).cast("long")


def _sent(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MAX_BROADCAST_ROWS else df


def numbered(df: DataFrame, column: str) -> DataFrame:
    """Adds `position`, from 0, in the order of a column with NULL last, without a single task."""
    order = F.col(column).asc_nulls_last()
    ranged = df.repartitionByRange(order).sortWithinPartitions(order)
    ranged = stored(ranged.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    joined = ranged.join(F.broadcast(starts), part == F.col("_part"))
    return joined.withColumn("position", F.col("_start") + inside).drop("_at", "_part", "_start", "_n")


def targets(sizes: DataFrame, weights: Sequence[int], max_epochs: int) -> DataFrame:
    """Adds `weight` and `target` to a table of (source, source_size)."""
    sources = numbered(sizes, "source")
    deal = F.array(*(F.lit(w) for w in weights))
    turn = (F.col("position") % len(weights)).cast("int")
    cap = F.col("source_size") * max_epochs
    sources = stored(sources.select("source", "source_size", deal[turn].alias("weight")), "sources")
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, capped = 0.0, -1
    while True:
        above = cap < F.col("weight") * F.lit(level)
        found = sources.agg(
            F.count_if(above).alias("n"),
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0)).alias("given"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)).alias("rest"),
        ).first()
        if found.n == capped or not found.rest:
            break
        capped, left, rest = found.n, total - found.given, found.rest
        level = left / rest
    if capped < 0:
        return sources.withColumn("target", F.lit(0.0))
    # As longs: a number of words that fits into an integer would be one, and its product might not fit.
    fair = (F.col("weight").cast("long") * F.lit(left)).cast("double") / F.lit(rest)
    return sources.withColumn("target", F.when(above, cap.cast("double")).otherwise(fair))


def draw(slim: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """Adds `whole` repetitions and `below`, the digest that ends the partial one."""
    size = F.col("source_size")
    whole = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long")
    sources = sources.withColumn("whole", whole)
    state = sources.select(
        F.col("source").alias("s"),
        (F.col("target") - F.col("whole") * size).alias("need"),
        F.lit(0).cast("long").alias("range"),
    )
    for shift in range(DIGEST_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        in_range = F.shiftright("place", shift + LEVEL_BITS) == F.col("range")
        rows = slim.join(_sent(state, n_sources), F.col("source").eqNullSafe(F.col("s")) & in_range)
        sums = rows.groupBy("s", F.shiftright("place", shift).alias("range")).agg(
            F.sum("size").alias("words"), F.first("need").alias("need")
        )
        upto = F.sum("words").over(Window.partitionBy("s").orderBy("range"))
        left = F.col("need") - F.col("upto") + F.col("words")
        border = sums.withColumn("upto", upto).where((left >= 0) & (F.col("need") < F.col("upto")))
        state = stored(border.select("s", "range", "words", left.alias("need")), "border")
    nearer = F.col("words") - F.col("need") < F.col("need")
    below = state.select("s", (F.col("range") + nearer.cast("long")).alias("below"))
    same = F.col("source").eqNullSafe(F.col("s"))
    joined = sources.join(_sent(below, n_sources), same, "left")
    return joined.select(
        "source", "source_size", "target", "whole", F.coalesce("below", F.lit(0)).alias("below")
    )


def mixture(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """All rows and columns of `docs` inside the struct `row`, with size, source_size, target,
    repetitions and taken (words, repetitions counted)."""
    place = {name: i for i, name in reversed(list(enumerate(docs.columns)))}
    base = docs.toDF(*(f"_{i}" for i in range(len(docs.columns))))
    id_, text, source = (
        F.col(f"_{place[name]}") for name in (id_column, text_column, source_column)
    )
    own = {"size": word_count(text), "place": place_in_draw(id_, text, seed)}
    slim = stored(base.select(source.alias("source"), *(c.alias(n) for n, c in own.items())), "sizes")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = stored(targets(sizes, weights, max_epochs), "targets")
    n_sources = sources.count()
    plan = stored(draw(slim, sources, n_sources), "draw").withColumnRenamed("source", "s")
    joined = base.withColumns(own).join(_sent(plan, n_sources), source.eqNullSafe(F.col("s")))
    repetitions = F.col("whole") + (F.col("place") < F.col("below")).cast("long")
    repetitions = F.when(F.col("source_size") > 0, repetitions).otherwise(0)
    return joined.select(
        F.struct(*(F.col(f"_{i}") for i in range(len(docs.columns)))).alias("row"),
        "size",
        "source_size",
        "target",
        repetitions.alias("repetitions"),
        (F.col("size") * repetitions).alias("taken"),
    )


def mixed_report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    slim = pick(docs, doc_id="doc_id", text="text", source="source")
    found = mixture(slim, **how)
    return found.select(
        F.col("row._0").alias("doc_id"), "size", "source_size", "target", "taken", "repetitions"
    )


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents that the mix takes, with their columns and `mix_*` columns; the number of
    repetitions stands in a column instead of repeated rows."""
    found = mixture(docs, **how).where("repetitions > 0")
    own = [F.col(f"row._{i}").alias(name) for i, name in enumerate(docs.columns)]
    more = ("size", "source_size", "target", "repetitions", "taken")
    return found.select(*own, *(F.col(c).alias(f"mix_{c}") for c in more))
