"""Records with line breaks in quotes, put together by many tasks (SRC-1)."""

import csv
import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from funnelry.sources import csv_events, csv_records

NAMES = ["event_time", "note", "event_type", "product_id", "category_code", "brand", "price", "user_id", "user_session"]


def written(rows, line_end="\n"):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=line_end)
    writer.writerows([NAMES, *rows])
    return out.getvalue()


def some_rows(n, seed):
    draw = random.Random(seed)
    texts = ["a", 'say ""\n"x"', "two\nlines", "\n\n\n", "a,b", "", "long " * 40 + "\n" + "tail," * 9, '"', "é\n"]
    for i in range(n):
        yield ["2019-11-01 00:00:07 UTC", draw.choice(texts), "view", i, draw.choice(texts), draw.choice(texts), i / 4, 7, f"s{i}"]


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    for name in names:
        spark.conf.set(name, "300")
    yield
    for name in names:
        spark.conf.unset(name)


def in_one_task(spark, files):
    schema = csv_events.schema_of(NAMES, files[0])
    reader = spark.read.options(**csv_events.CSV_OPTIONS, multiLine=True).schema(schema)
    return csv_events.blank_to_null(reader.csv(files).select(*csv_events.RAW_COLUMNS))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("line_end", ["\n", "\r\n"])
def test_same_rows_as_in_one_task(spark, tmp_path, small_splits, line_end):
    files = []
    for k in range(2):
        file = tmp_path / f"{k}.csv"
        file.write_bytes(written(some_rows(120, k), line_end).encode())
        files.append(str(file))
    found = csv_events.read_raw_csv(spark, str(tmp_path), multi_line=True)
    assert found.rdd.getNumPartitions() > 20
    assert rows_of(found) == rows_of(in_one_task(spark, files))
    assert found.count() == 240


def test_a_record_over_many_splits_and_one_without_end(spark, tmp_path, small_splits):
    row = ["2019-11-01 00:00:07 UTC", "x\n" * 900, "view", 1, "c", "b", 1.0, 7, "s"]
    text = written([row, row]) + "\n\n2019-11-01 00:00:08 UTC,n,view,2,c,b,1.0,8,\"never\nclosed"
    (tmp_path / "a.csv").write_text(text)
    found = csv_events.read_raw_csv(spark, str(tmp_path), multi_line=True).collect()
    assert sorted((r.product_id, r.user_session.strip()) for r in found) == [(1, "s"), (1, "s"), (2, "never\nclosed")]


def test_headers_of_many_files_in_one_job(spark, tmp_path):
    for k in range(12):
        names = NAMES if k % 3 else NAMES[::-1]
        lines = [",".join(f'"{n}"' if k % 2 else n for n in names)] + ["1," * 8 + "1"] * (20_000 if k == 1 else 3)
        (tmp_path / f"{k}.csv").write_text("\n" * (k % 4) + "\n".join(lines) + "\n")
    group = spark.sparkContext.setJobGroup
    group("headers", "headers")
    paths = [f"file://{p}" for p in sorted(map(str, tmp_path.glob("*.csv")))]
    found = csv_records.headers(spark, paths)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("headers")
    group("", "")
    assert len(jobs) == 1 and len(found) == 12
    assert {f.rsplit("/", 1)[1]: n for f, n in found.items()} == {
        f"{k}.csv": tuple(NAMES if k % 3 else NAMES[::-1]) for k in range(12)
    }


def test_names_as_the_reader_gives_them(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,,"b ""c""",A,d\n')
    names = spark.read.options(**csv_events.CSV_OPTIONS).csv(str(tmp_path)).columns
    assert list(csv_records.headers(spark, [str(tmp_path / "a.csv")]).values()) == [tuple(names)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.text('a",\n', max_size=6), min_size=2, max_size=3), min_size=1, max_size=5))
def test_state_follows_quotes(rows):
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(rows)
    inside, ends = False, 0
    for line in out.getvalue().split("\n")[:-1]:
        inside = csv_records.inside_after(line, inside)
        ends += not inside
    assert not inside and ends == len(rows)


@pytest.mark.parametrize(("line", "outside", "inside"), [
    ('a"b,c', False, False), ('"a"b,"c', True, True), ('x","y', True, True), ('""', False, True),
    ('a', False, True), ('"', True, False), ('","', False, True), ('b",c', False, False),
])
def test_odd_quotes(line, outside, inside):
    assert csv_records.inside_after(line, False) == outside
    assert csv_records.inside_after(line, True) == inside
