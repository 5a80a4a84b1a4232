from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Documents from (id, text) or (id, text, source), with a column whose name differs in case."""

    def build(*rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None) for r in rows]
        return spark.createDataFrame(full, DOCS).select("*", F.lit(None).cast("int").alias("TEXT"))

    return build


@pytest.fixture
def duck():
    """Rows of a SQL query over DataFrames given by name."""

    def run(sql, **tables):
        found = duckdb.connect()
        for name, df in tables.items():
            keep = [i for i, c in enumerate(df.columns) if c == c.lower()]
            numbered = df.toDF(*(f"_{i}" for i in range(len(df.columns))))
            plain = numbered.select(*(F.col(f"_{i}").alias(df.columns[i]) for i in keep)).toArrow()
            found.register(name, plain)
        cursor = found.execute(sql)
        names = [c[0] for c in cursor.description]
        return [dict(zip(names, row, strict=True)) for row in cursor.fetchall()]

    return run


@pytest.fixture
def same():
    """Compares rows of a DataFrame and dictionaries without regard to order."""

    def check(df, expected):
        order = lambda rows: sorted(rows, key=lambda r: [(v is None, str(v)) for _, v in sorted(r.items())])
        assert order([r.asDict() for r in df.collect()]) == order(expected)

    return check
