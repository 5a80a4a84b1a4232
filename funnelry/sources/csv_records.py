"""Headers of many CSV files in one job, and records with line breaks from many tasks (SRC-1).

A quoted field may hold line breaks, so a line tells only together with all lines before it whether
it begins a record. Each split of a file is therefore read twice. First it tells, for either case,
inside or outside quotes at its start, in which it ends; running through the splits of a file in
order, one row each, these answers give the state at the start of every split. Then every split puts
its records together on its own; the pieces of a record that goes over the end of a split are joined
by the split in which it begins. Neither step needs a file in one task.

Quotes follow the rules of the reader: only one at the start of a field opens, a doubled one is a
quote, and after any other one that is not before a comma or the end of the line the field goes on
without quotes. Fields are parted by commas, lines end in a line feed, with or without a carriage
return before it. Blank lines outside quotes are left out, as the reader does.
"""

from __future__ import annotations

import csv
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Splits whose state is sent to all tasks, three numbers each: some 64 TB in splits of 128 MB.
MAX_SPLITS = 500_000
#: Larger than any file: one task for each, which reads its first lines only.
WHOLE_FILE = 1 << 40
_STATE = "file long, block long, inside boolean, owner long, open boolean"


def headers(spark: SparkSession, paths: Sequence[str]) -> dict[str, tuple[str, ...]]:
    """The column names of each file, from its first line that is not blank: one job for all files."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {name: spark.conf.get(name) for name in names}
    try:
        for name in names:
            spark.conf.set(name, str(WHOLE_FILE))
        lines = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("file"), "value")
        found = lines.where("value <> ''").mapInArrow(_first, lines.schema).collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return {r.file: _named(next(csv.reader([r.value.rstrip("\r")]))) for r in found}


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            yield batch.slice(0, 1)
            return


def _named(cells: Sequence[str]) -> tuple[str, ...]:
    """Names as the reader gives them: a place for a missing name, and beside one that is repeated."""
    low = [c.lower() for c in cells]
    return tuple(
        f"_c{i}" if not c else f"{c}{i}" if low.count(c.lower()) > 1 else c
        for i, c in enumerate(cells)
    )


def inside_after(line: str, inside: bool) -> bool:
    """Whether a line ends inside quotes, if it starts inside quotes or, else, with a new field."""
    at = 0
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line[at + 1 : at + 2] == '"':
                at += 2
                continue
            inside = False
        elif line[at : at + 1] == '"':
            inside, at = True, at + 1
            continue
        at = line.find(",", at)
        if at < 0:
            return False
        at += 1


def _lines(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(list(files))
    file = F.xxhash64("_metadata.file_path").alias("file")
    return lines.select(file, F.col("_metadata.file_block_start").alias("block"), "value")


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[list]]]:
    """The rows of each split, which come one after the other."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    held: list = []

    def same(key: tuple) -> Iterator:
        yield held.pop()
        for row in rows:
            if row[:2] != key:
                held.append(row)
                return
            yield row

    for row in rows:
        held.append(row)
        while held:
            key = held[-1][:2]
            part = same(key)
            yield key, part
            for _ in part:
                pass


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, outside, inside, closes): how a split ends from either state, and whether a
    record that goes on from before it comes to its end in it."""
    for (file, block), rows in _splits(batches):
        outside, inside, closes = False, True, False
        for _, _, line in rows:
            if line is not None:
                outside, inside = inside_after(line, outside), inside_after(line, inside)
            closes = closes or not inside
        yield pa.record_batch(
            {"file": [file], "block": [block], "outside": [outside], "inside": [inside], "closes": [closes]}
        )


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, inside, owner, open): the state at the start of each split, the split where a
    record that goes on into it begins, and whether a record goes on after it."""
    at, state, owner = None, False, 0
    for batch in batches:
        out = []
        for file, block, outside, inside, closes in zip(*(c.to_pylist() for c in batch.columns)):
            if file != at:
                at, state, owner = file, False, block
            after = inside if state else outside
            out.append((file, block, state, owner, after))
            if after and (closes or not state):
                owner = block
            state = after
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_())
        columns = zip(*out) if out else ((),) * 5
        names = ["file", "block", "inside", "owner", "open"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _records(pieces: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Whole records of the splits or, with `pieces`, those that go over an end of a split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (file, block), rows in _splits(batches):
            held: list[str] = []
            going, first, owner, seen = False, block == 0, block, False
            for _, _, line, inside, before in rows:
                if inside is None:
                    raise ValueError("the files have been split in another way than before")
                if not seen:
                    seen, going, owner = True, inside, before if inside else block
                if not going and not held and not line.rstrip("\r"):
                    continue
                held.append(line)
                going = inside_after(line, going)
                if going:
                    continue
                if (owner != block) == pieces:
                    out.append((file, owner, block, first, "\n".join(held)))
                held, first, owner = [], False, block
                if len(out) >= 1000:
                    yield _batch(out)
                    out = []
            if held and pieces:
                out.append((file, owner, block, first, "\n".join(held)))
        yield _batch(out)

    return run


def _batch(rows: Sequence[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
    columns = zip(*rows) if rows else ((),) * 5
    names = ["file", "owner", "block", "first", "record"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def records(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """The records of the files, without their first ones, the headers."""
    lines = _lines(spark, files)
    quoted = F.when(F.contains("value", F.lit('"')), F.col("value"))
    ends = lines.select("file", "block", quoted.alias("value")).mapInArrow(
        _ends, "file long, block long, outside boolean, inside boolean, closes boolean"
    )
    ordered = ends.repartition("file").sortWithinPartitions("file", "block")
    states = ordered.mapInArrow(_starts, _STATE).limit(MAX_SPLITS + 1).collect()  # one row a split
    if len(states) > MAX_SPLITS:
        raise ValueError("too many splits; raise spark.sql.files.maxPartitionBytes")
    known = spark.createDataFrame(states, _STATE)
    kind = "file long, owner long, block long, first boolean, record string"
    columns = ("file", "block", "value", "inside", "owner")

    def read(some: DataFrame, how: str, pieces: bool) -> DataFrame:
        placed = lines.join(F.broadcast(some), ["file", "block"], how).select(*columns)
        return placed.mapInArrow(_records(pieces), kind)

    whole = read(known, "left", False).select("first", "record")
    parts = read(known.where("inside OR open"), "inner", True)
    joined = F.transform(F.sort_array(F.collect_list(F.struct("block", "record"))), lambda p: p["record"])
    parts = parts.groupBy("file", "owner").agg(
        F.max("first").alias("first"), F.array_join(joined, "\n").alias("record")
    )
    return whole.unionByName(parts.select("first", "record")).where("NOT first").select("record")


def parsed(rows: DataFrame, schema: T.StructType, options: Mapping[str, object]) -> DataFrame:
    """Records as columns."""
    text = F.regexp_replace(F.regexp_replace("record", "\r$", ""), "\r\n", "\n")
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema)
    told = {k: str(v) for k, v in options.items()}
    return rows.select(F.from_csv(text, ddl, told).alias("row")).select("row.*")
