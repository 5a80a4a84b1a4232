"""Raw event files to the event table's rows (SRC-1, SRC-3..9, SRC-16)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from funnelry.fixed_values import NA_WORDS, TARGET_EVENTS
from funnelry.functions.sampling import keep_buckets_for, sample_users
from funnelry.functions.times import epoch_seconds
from funnelry.schema import EVENT_COLUMNS, RAW_COLUMNS, RAW_SCHEMA, REQUIRED_COLUMNS
from funnelry.sources.csv_records import headers, parsed, records

# Quotes are doubled inside quoted fields. A record is one line unless asked otherwise, which keeps
# files splittable. A file whose header is not the one that its columns are read by is an error.
CSV_OPTIONS = {"header": True, "escape": '"', "mode": "PERMISSIVE", "enforceSchema": False}


def schema_of(names: Sequence[str], path: str) -> T.StructType:
    """Columns in a file's own order, ours typed, any others as text."""
    missing = [c for c in RAW_COLUMNS if c not in names]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    known = {f.name: f for f in RAW_SCHEMA}
    return T.StructType([known.get(n, T.StructField(n, T.StringType())) for n in names])


def file_schema(spark: SparkSession, path: str) -> T.StructType:
    """The columns of files that share one header. Only a header is read."""
    return schema_of(spark.read.options(**CSV_OPTIONS).csv(path).columns, path)


def files_by_header(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """The files of a path by their header. Files are listed, and all first lines read in one job."""
    listed = spark.read.format("binaryFile").load(path).where("length > 0").select("path")
    paths = sorted(r.path for r in listed.collect())  # names, not contents
    found: dict[tuple[str, ...], list[str]] = {}
    for file, names in sorted(headers(spark, paths).items() if paths else ()):
        found.setdefault(names, []).append(file)
    return found


def read_raw_csv(
    spark: SparkSession, path: str, na_words: bool = True, multi_line: bool = False
) -> DataFrame:
    """The eight raw columns, by name, of one or many CSV files with headers of any order.

    Empty fields are NULL, and with `na_words` so are the usual words for a missing value.
    Numbers that cannot be read are NULL. With `multi_line`, quoted fields may hold line breaks;
    files are then read twice, still by as many tasks as they have splits.
    """
    groups = files_by_header(spark, path)
    if not groups:
        return spark.createDataFrame([], RAW_SCHEMA).select(*RAW_COLUMNS)

    def read(names: tuple[str, ...], files: list[str]) -> DataFrame:
        schema = schema_of(names, files[0])
        if multi_line:
            return parsed(records(spark, files), schema, {"escape": '"', "mode": "PERMISSIVE"})
        return spark.read.options(**CSV_OPTIONS).schema(schema).csv(files)

    parts = (read(names, files).select(*RAW_COLUMNS) for names, files in groups.items())
    return blank_to_null(reduce(DataFrame.unionByName, parts), na_words)


def blank_to_null(raw: DataFrame, na_words: bool = True) -> DataFrame:
    words = NA_WORDS if na_words else ("",)
    clean = {
        f.name: F.when(~F.col(f.name).isin(*words), F.col(f.name))
        for f in RAW_SCHEMA
        if isinstance(f.dataType, T.StringType)
    }
    price = F.when(~F.isnan("price"), F.col("price"))
    return raw.withColumns({**clean, "price": price})


def normalise(raw: DataFrame) -> DataFrame:
    """Adds the epoch, drops rows that belong to no journey, fixes the column order."""
    return (
        raw.withColumn("event_ts", epoch_seconds(F.col("event_time")))
        .dropna(subset=list(REQUIRED_COLUMNS))
        .select(*EVENT_COLUMNS)
    )


def rejected_rows(raw: DataFrame) -> DataFrame:
    """One row: raw rows, and those that `normalise` drops because a required field is missing.

    A record that was torn at a line break inside quotes ends up here, once per line.
    """
    known = epoch_seconds(F.col("event_time")).isNotNull()
    known &= F.col("user_id").isNotNull() & F.col("user_session").isNotNull()
    return raw.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~known).alias("rejected"))


def events_from_csv(
    spark: SparkSession,
    path: str,
    keep_buckets: int | None = None,
    na_words: bool = True,
    multi_line: bool = False,
) -> DataFrame:
    """Event rows of the kept users: scan, filter and projection in one stage, no shuffle."""
    raw = read_raw_csv(spark, path, na_words, multi_line)
    return normalise(raw if keep_buckets is None else sample_users(raw, keep_buckets))


def calibration(rows: DataFrame, target_events: int = TARGET_EVENTS) -> DataFrame:
    """(rows, keep_buckets) from a one-row table of the exact number of rows (SRC-5)."""
    return rows.select("rows", keep_buckets_for(F.col("rows"), target_events).alias("keep_buckets"))


def calibrate_keep_buckets(
    spark: SparkSession, path: str, target_events: int = TARGET_EVENTS
) -> int:
    """How many hash buckets of users to keep to end up near the target.

    Counts the rows of all files: one scan without a shuffle, right for lines of any length and for
    compressed files.
    """
    rows = read_raw_csv(spark, path).agg(F.count(F.lit(1)).alias("rows"))
    return calibration(rows, target_events).first()["keep_buckets"]
