"""Raw files to the stored table (SRC-1..16) and the load in steps."""

import gzip
import hashlib
import time

import pytest
from pyspark.sql import functions as F

from funnelry.fixed_values import HASH_SPACE
from funnelry.functions.numbers import quartile_label, round_to
from funnelry.functions.sampling import keep_buckets_for, keep_buckets_of, sample_users, user_bucket
from funnelry.functions.times import display_time, epoch_seconds
from funnelry.schema import EVENT_COLUMNS, EVENT_SCHEMA
from funnelry.sources import csv_events, event_table
from funnelry.streaming.ingest import append_events, load_progress, stream_events, stream_name

HEADER = "event_time,extra,event_type,product_id,category_code,brand,price,user_id,user_session"
LINES = [
    "2019-11-01 00:00:07 UTC,x,view,10,electronics.phone,acme,4.5,520088904,s1",
    "2019-11-01 00:00:08,x,cart,11,,NaN,,520088904,s1",
    'bad,x,view,10,"a ""b"", c",acme,4.5,520088904,s1',
    ",x,view,10,a,acme,4.5,520088904,s1",
    '2019-11-01 00:00:09 UTC,x,cart,zz,"a ""b"", c",n/a,NaN,500000001,s2',
    "2019-11-01 00:00:10 UTC,x,cart,12,a,acme,1.0,,s2",
    "2019-11-01 00:00:11 UTC,x,cart,12,a,acme,1.0,500000001,None",
]
EXPECTED = {
    ("2019-11-01 00:00:07 UTC", 1572566407, "view", 10, "electronics.phone", "acme", 4.5, 520088904, "s1"),
    ("2019-11-01 00:00:08", 1572566408, "cart", 11, None, None, None, 520088904, "s1"),
    ("2019-11-01 00:00:09 UTC", 1572566409, "cart", None, 'a "b", c', None, None, 500000001, "s2"),
}


@pytest.fixture
def raw(tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    (folder / "a.csv").write_text("\n".join([HEADER, *LINES]) + "\n")
    return folder


def test_csv_to_events(spark, raw):
    df = csv_events.events_from_csv(spark, str(raw))
    assert df.schema.simpleString() == EVENT_SCHEMA.simpleString()
    assert {tuple(r) for r in df.collect()} == EXPECTED


def test_unused_columns_are_not_read(spark, raw):
    plan = csv_events.events_from_csv(spark, str(raw))._jdf.queryExecution().executedPlan().toString()
    assert "extra" not in plan.split("ReadSchema", 1)[1]
    assert "Exchange" not in plan


def test_words_for_missing_values_are_optional(spark, raw):
    df = csv_events.read_raw_csv(spark, str(raw), na_words=False)
    assert "n/a" in {r.brand for r in df.collect()}


def test_missing_column_is_an_error(spark, tmp_path):
    (tmp_path / "b.csv").write_text("event_time,user_id\n")
    with pytest.raises(ValueError, match="price"):
        csv_events.read_raw_csv(spark, str(tmp_path))


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_times_ignore_the_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        texts = ["2024-03-10 02:30:00 UTC", "1969-12-31 23:59:59"]
        texts += ["2024-02-30 00:00:00", "x", "", "2024-01-01", "2024-01-01T00:00:00"]
        texts += ["2024-01-01 24:00:00", "2024-01-01 00:00:60", "2024-01-01 00:00:00.5"]
        texts += ["2024-1-1 00:00:00", "2024-01-01 00:00:00\n", " 2024-01-01 00:00:00"]
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        seconds = epoch_seconds(F.col("t"))
        found = [tuple(r) for r in df.select(seconds, display_time(seconds)).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert found[0] == (1710037800, "2024-03-10 02:30:00 UTC")
    assert found[1] == (-1, "1969-12-31 23:59:59 UTC")
    assert found[2:] == [(None, None)] * 11


def test_user_bucket_is_the_md5_of_the_id(spark):
    ids = [0, 1, 500000001, 520088904, 2**40]
    df = spark.createDataFrame([(i,) for i in ids], "user_id bigint")
    found = [r[0] for r in df.select(user_bucket()).collect()]
    assert found == [int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) % HASH_SPACE for i in ids]
    assert found[2] == 3480


def test_users_are_kept_whole_and_always_the_same(spark):
    a = spark.range(3000).select((F.col("id") % 300).alias("user_id"), "id")
    b = spark.range(300).select(F.col("id").alias("user_id"), F.lit(-1).alias("id"))
    kept = {r.user_id: r["count"] for r in sample_users(a, 2500).groupBy("user_id").count().collect()}
    assert set(kept.values()) == {10} and 40 < len(kept) < 110
    assert {r.user_id for r in sample_users(b, 2500).collect()} == set(kept)
    assert set(kept) <= {r.user_id for r in sample_users(b, 5000).collect()}


def test_missing_user_is_never_kept(spark):
    df = spark.createDataFrame([(None,), (1,)], "user_id bigint")
    assert [r.user_id for r in sample_users(df, HASH_SPACE).collect()] == [1]


@pytest.mark.parametrize("fraction, buckets", [(0, 1), (0.02, 200), (1, 10_000), (2, 20_000), (0.00025, 2)])
def test_fraction_by_hand(fraction, buckets):
    assert keep_buckets_of(fraction) == buckets


@pytest.mark.parametrize("rows, target, buckets", [(10050, 2000, 1990), (0, 5, 10_000), (10**12, 1, 1), (10, 20, 10_000), (40_000, 10, 2)])
def test_fraction_by_target(spark, rows, target, buckets):
    found = spark.range(1).select(keep_buckets_for(F.lit(rows).cast("bigint"), target)).first()[0]
    assert found == buckets


def test_calibration_counts_rows(spark, raw):
    # The reader drops no line, not even one that the load rejects later.
    assert csv_events.calibrate_keep_buckets(spark, str(raw), 2) == 2857


@pytest.mark.parametrize("gz", [False, True])
def test_calibration_with_uneven_lines(spark, tmp_path, gz):
    short = "2019-11-01 00:00:07 UTC,x,view,1,a,b,1.0,3,s"
    text = "\n".join([HEADER, *[short] * 20_001, *[short + "x" * 300] * 19_999]) + "\n"
    data = gzip.compress(text.encode()) if gz else text.encode()
    (tmp_path / ("a.csv.gz" if gz else "a.csv")).write_bytes(data)
    assert csv_events.calibrate_keep_buckets(spark, str(tmp_path), 4_000) == 1_000


def test_columns_are_found_by_name_in_every_file(spark, raw):
    names = HEADER.split(",")[::-1]
    values = "s7,520088904,2.5,acme,a.b,10,cart,x,2019-11-01 00:00:12 UTC"
    (raw / "b.csv").write_text(",".join(names) + "\n" + values + "\n")
    (raw / "c.csv").write_text("")
    found = {tuple(r) for r in csv_events.events_from_csv(spark, str(raw)).collect()}
    assert found == EXPECTED | {
        ("2019-11-01 00:00:12 UTC", 1572566412, "cart", 10, "a.b", "acme", 2.5, 520088904, "s7")
    }


def test_torn_records_are_counted_or_read(spark, tmp_path):
    record = '2019-11-01 00:00:07 UTC,x,view,10,"a\nb",acme,4.5,520088904,s1'
    (tmp_path / "a.csv").write_text("\n".join([HEADER, LINES[0], record]) + "\n")
    torn = csv_events.read_raw_csv(spark, str(tmp_path))
    assert tuple(csv_events.rejected_rows(torn).first()) == (3, 2)
    whole = csv_events.read_raw_csv(spark, str(tmp_path), multi_line=True)
    assert tuple(csv_events.rejected_rows(whole).first()) == (2, 0)
    assert "a\nb" in {r.category_code for r in whole.collect()}


def test_write_replaces_and_reports(spark, raw, tmp_path):
    path = str(tmp_path / "events")
    df = csv_events.events_from_csv(spark, str(raw))
    event_table.write_events(df, path)
    assert event_table.write_events(df, path) == {"events": 3, "users": 2}
    stored = event_table.read_events(spark, path)
    assert stored.columns == EVENT_COLUMNS
    assert {tuple(r) for r in stored.collect()} == EXPECTED
    assert tuple(event_table.load_report(stored).first()) == (3, 2)


def test_compact_write_leaves_few_files(spark, tmp_path, events):
    many = events(*((i, "s", i, "view") for i in range(64))).repartition(32)
    sizes = {}
    for compact in (False, True):
        path = tmp_path / str(compact)
        assert event_table.write_events(many, str(path), compact) == {"events": 64, "users": 64}
        sizes[compact] = len(list(path.rglob("*.parquet")))
    assert sizes[True] < 4 < sizes[False]


def test_layout_keeps_rows_and_splits_a_hot_user(spark, tmp_path, events):
    copies = [(7, "s", 5, "view")] * 600 + [(i, "t", i, "view") for i in range(300)]
    path = str(tmp_path / "events")
    event_table.write_events(events(*copies).coalesce(1), path)
    stored = event_table.read_events(spark, path)
    laid = event_table.clustered(stored, 4).withColumn("part", F.spark_partition_id())
    parts = {}
    for r in laid.collect():
        parts.setdefault(r.part, []).append((r.user_id, r.event_ts))
    assert sum(map(len, parts.values())) == 900
    assert all(found == sorted(found) for found in parts.values())
    assert sum(any(user == 7 for user, _ in found) for found in parts.values()) > 1


def test_table_with_statistics(spark, events):
    event_table.save_as_table(events((1, "s", 1, "view"), (2, "t", 2, "cart")), "shop_events")
    assert spark.table("shop_events").count() == 2
    told = spark.sql("DESCRIBE EXTENDED shop_events user_id").collect()
    assert {r.info_name: r.info_value for r in told}["distinct_count"] == "2"


def test_load_in_steps(spark, raw, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for name in (None, "b.csv"):
        if name:
            (raw / name).write_text(f"{HEADER}\n2019-11-02 00:00:00 UTC,x,view,1,a,b,1.0,3,s9\n")
        stream = stream_events(spark, str(raw), HASH_SPACE, 1)
        append_events(stream, str(raw), out, checkpoint).awaitTermination()
    found = {tuple(r) for r in event_table.read_events(spark, out).collect()}
    assert found == EXPECTED | {
        ("2019-11-02 00:00:00 UTC", 1572652800, "view", 1, "a", "b", 1.0, 3, "s9")
    }
    assert event_table.read_events(spark, out).count() == 4


def test_load_in_steps_uses_the_sessions_checkpoint_folder(spark, raw, tmp_path):
    out = str(tmp_path / "out")
    for _ in range(2):
        append_events(stream_events(spark, str(raw), HASH_SPACE), str(raw), out).awaitTermination()
    assert event_table.read_events(spark, out).count() == 3


def appended(spark, source, out):
    append_events(stream_events(spark, str(source), HASH_SPACE), str(source), out).awaitTermination()
    return event_table.read_events(spark, out).count()


def test_steps_add_to_a_written_table(spark, raw, tmp_path, events):
    out = str(tmp_path / "out")
    event_table.write_events(events(*((i, "s", i, "view") for i in range(5))), out)
    assert appended(spark, raw, out) == 8


def test_two_sources_fill_one_table(spark, raw, tmp_path):
    other = tmp_path / "other"
    other.mkdir()
    (other / "b.csv").write_text(f"{HEADER}\n2019-11-02 00:00:00 UTC,x,view,1,a,b,1.0,3,s9\n")
    out = str(tmp_path / "out")
    assert appended(spark, raw, out) == 3 and appended(spark, other, out) == 4


def test_tables_with_like_names_have_progress_of_their_own(spark, raw, tmp_path):
    assert appended(spark, raw, str(tmp_path / "o/a_b")) == 3
    assert appended(spark, raw, str(tmp_path / "o/a/b")) == 3
    assert ":" not in stream_name("hdfs://x:1/a", "s3://b/c")


def test_a_batch_that_is_run_again_counts_once(spark, raw, tmp_path):
    out = str(tmp_path / "out")
    for checkpoint in ("one", "two"):  # the second knows nothing of the first
        stream = stream_events(spark, str(raw), HASH_SPACE)
        append_events(stream, str(raw), out, str(tmp_path / checkpoint)).awaitTermination()
    assert event_table.read_events(spark, out).count() == 3


def broken(events, after):
    """The rows, and an error in place of the last of them."""
    return events.where(F.when(F.col("event_ts") < after, True).otherwise(F.raise_error(F.lit("broken")).cast("boolean")))


def test_a_failed_load_leaves_the_table_as_it_was(spark, tmp_path, events):
    out = str(tmp_path / "out")
    with pytest.raises(Exception, match="broken"):
        event_table.write_events(broken(events(*((i, "s", i, "view") for i in range(50))), 49), out)
    assert event_table.read_events(spark, out).collect() == []
    event_table.write_events(events((1, "s", 1, "view")), out)
    many = events(*((i, "s", i, "view") for i in range(50))).repartitionByRange(5, "event_ts")
    with pytest.raises(Exception, match="broken"):
        event_table.write_events(broken(many, 49), out)
    assert [r.user_id for r in event_table.read_events(spark, out).collect()] == [1]
    assert event_table.write_events(many, out)["events"] == 50
    assert event_table.read_events(spark, out).count() == 50


def test_a_load_may_read_the_table_that_it_replaces(spark, tmp_path, events):
    out = str(tmp_path / "out")
    event_table.write_events(events(*((i, "s", i, "view") for i in range(9))), out)
    reader = event_table.read_events(spark, out)
    for kept in (6, 3):
        table = event_table.read_events(spark, out)
        event_table.write_events(table.where(F.col("user_id") < kept), out)
        assert event_table.read_events(spark, out).count() == kept
        assert kept == 3 or reader.count() == 9  # the load before the present one can still be read
    assert len(event_table.loads(spark, out)) == 2


def test_a_reload_keeps_what_was_streamed(spark, raw, tmp_path, events):
    out = str(tmp_path / "out")
    event_table.write_events(events((1, "s", 1, "view")), out)
    assert appended(spark, raw, out) == 4
    event_table.write_events(events((2, "s", 1, "view"), (3, "s", 1, "view")), out)
    assert appended(spark, raw, out) == 5  # the stream has nothing new
    assert {tuple(r) for r in event_table.read_events(spark, out).collect()} >= EXPECTED


def test_unfinished_batches_are_not_read(spark, raw, tmp_path):
    out = tmp_path / "out"
    assert appended(spark, raw, str(out)) == 3
    (next(out.glob("stream-*/batch-*")) / "_SUCCESS").unlink()
    assert event_table.read_events(spark, str(out)).collect() == []


def test_a_plain_folder_is_a_table(spark, tmp_path, events):
    out = str(tmp_path / "out")
    events((1, "s", 1, "view")).write.parquet(out)
    assert event_table.read_events(spark, out).count() == 1
    event_table.write_events(events((2, "s", 1, "view")), out)
    assert [r.user_id for r in event_table.read_events(spark, out).collect()] == [2]


def batch_line(user, second):
    return f"2019-11-02 00:00:{second:02d} UTC,x,view,1,a,b,1.0,{user},s9"


def test_running_counts_equal_a_recount(spark, tmp_path):
    source, out = tmp_path / "source", str(tmp_path / "out")
    source.mkdir()
    batches = [[1, 2, 2, 3], [2, 3, 3], [4, 1, 5, 4], [6]]
    for number, users in enumerate(batches):
        lines = [batch_line(u, i) for i, u in enumerate(users)] + ["bad,x,view,1,a,b,1.0,99,s9"]
        (source / f"{number}.csv").write_text("\n".join([HEADER, *lines]) + "\n")
        if number % 2:  # a run takes two files, one at a time
            stream = stream_events(spark, str(source), HASH_SPACE, 1)
            append_events(stream, str(source), out).awaitTermination()
        time.sleep(0.05)  # files are taken by age
    found = [tuple(r)[1:] for r in load_progress(spark, out).orderBy("batch").collect()]
    events, known, expected = 0, set(), []
    for number, users in enumerate(batches):
        new, events = set(users) - known, events + len(users)
        known |= new
        expected.append((number, len(users), len(new), events, len(known)))
    assert found == expected
    stored = event_table.read_events(spark, out)
    assert tuple(event_table.load_report(stored).first()) == expected[-1][3:]


def test_a_repeated_batch_changes_no_running_count(spark, tmp_path):
    source, out, checkpoint = tmp_path / "source", str(tmp_path / "out"), tmp_path / "checkpoint"
    source.mkdir()
    for number, users in enumerate([[1, 2], [2, 3]]):
        lines = [batch_line(u, 1) for u in users]
        (source / f"{number}.csv").write_text("\n".join([HEADER, *lines]) + "\n")
        stream = stream_events(spark, str(source), HASH_SPACE)
        append_events(stream, str(source), out, str(checkpoint)).awaitTermination()
    before = load_progress(spark, out).collect()
    # As after a crash between the last batch and the note that it is done.
    (checkpoint / "commits" / "1").unlink()
    (checkpoint / "commits" / ".1.crc").unlink(missing_ok=True)
    stream = stream_events(spark, str(source), HASH_SPACE)
    append_events(stream, str(source), out, str(checkpoint)).awaitTermination()
    assert load_progress(spark, out).collect() == before
    assert [tuple(r)[1:] for r in before] == [(0, 2, 2, 2, 2), (1, 2, 1, 4, 3)]
    assert event_table.read_events(spark, out).count() == 4


def test_a_table_without_streams_has_no_progress(spark, tmp_path):
    assert load_progress(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("value, digits, found", [(1.005, 2, 1.01), (0.285, 2, 0.29), (2.675, 2, 2.68), (-0.5, 0, -1.0), (1e35, 2, 1e35), (None, 2, None)])
def test_rounding(spark, value, digits, found):
    assert spark.range(1).select(round_to(F.lit(value).cast("double"), digits)).first()[0] == found


def test_quartile_label_rounds_half_to_even(spark):
    label = quartile_label(F.lit(3), F.lit(14.5), F.lit(370.49))
    assert spark.range(1).select(label).first()[0] == "Q3 ($14–$370)"
