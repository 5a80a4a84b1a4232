"""The corpus pipeline: documents through five operators, each stage written and read again.

Edge cases are those of the operators. A NULL or empty text is accepted, has no duplicates, passages
or benchmark words, and weighs nothing in the mix, which therefore leaves it out. Of repeated rows one
stays after the near-duplicate stage, also of those without an id that have words; texts of any length
are read whole; further columns, also those whose names differ only in case, go through unchanged; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from funnelry.llm import chosen_path, mixing, ordinal, queries, suffix_ranks, wu_manber
from funnelry.llm.stores import new_path


#: Near copies of the stage, in hundredths of similarity, and trees that lose few of them at that bound.
SIMILAR = 80
TREES = 14


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that are more likely toxic than not; the model learns from all labels."""
    labelled = queries.table(spark, sf_dir, "documents")
    return ordinal.accepted(docs, ordinal.fit(labelled, queries.grades(spark, sf_dir)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, from a similarity of 0.8 on."""
    return chosen_path.deduplicated(docs, trees=TREES, similar=SIMILAR)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that also stand in a document with a smaller id."""
    return suffix_ranks.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents with benchmark passages."""
    return wu_manber.decontaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with their repetitions."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("mix", mix),
]

#: The classifier of the first stage is not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
