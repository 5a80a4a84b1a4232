"""Tiles without a global sort against a plain NTILE (WIN-1)."""

import random
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from funnelry.operators import ntile as nt
from funnelry.plans import inference, reports

ORDER = ["p", "i"]
draw = random.Random(3)
INPUTS = {
    "spread": [(round(draw.lognormvariate(3, 1), 2), draw.randrange(10**12)) for _ in range(900)],
    "one price on most rows": [
        (9.99 if draw.random() < 0.6 else draw.random() * 100, draw.randrange(40))
        for _ in range(900)
    ],
    "copies over several tiles": [(5.0, 7)] * 700
    + [(draw.random() * 9, draw.randrange(-(2**63), 2**63)) for _ in range(200)],
    "extremes": [(float("inf"), 1)] * 90
    + [(1.7e308, 2), (-1.7e308, 3), (5e-324, 4), (0.0, 5), (1.79e308, 6)]
    + [(draw.random(), 7) for _ in range(100)],
    "all the same": [(1.0, 1)] * 50,
}


@pytest.fixture(params=[150, 50_000])
def few_ranges(monkeypatch, request):
    """A coarse sketch; rows near a border are stored and searched again, or counted at once."""
    monkeypatch.setattr(nt, "SKETCH", 256)
    monkeypatch.setattr(nt, "COLLECTED", request.param)
    monkeypatch.setattr(nt, "CHUNK", 100)


def compare(spark, values, tiles):
    df = spark.createDataFrame(values, "p double, i bigint")
    plain = df.withColumn("t", F.ntile(tiles).over(Window.orderBy(*ORDER)))
    expected = Counter(tuple(r) for r in plain.select("p", "i", "t").collect())
    found = Counter(tuple(r) for r in nt.ntile(df, ORDER, tiles, "t").collect())
    assert found == expected
    kept = nt.with_tiles(df, ORDER, tiles, "t").select("p", "i", "t").distinct()
    assert {tuple(r) for r in kept.collect()} == set(expected)


@pytest.mark.parametrize("name", INPUTS)
def test_equals_ntile(spark, few_ranges, name):
    compare(spark, INPUTS[name], 4)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 6, 7, 8, 9])
def test_few_rows(spark, n):
    compare(spark, [(draw.choice([1.0, 2.0]), i) for i in range(n)], 4)


@pytest.mark.parametrize("tiles", [1, 2, 7])
def test_other_numbers_of_tiles(spark, few_ranges, tiles):
    compare(spark, INPUTS["one price on most rows"], tiles)


def test_without_a_shared_folder_the_input_is_searched_again(spark, few_ranges, monkeypatch):
    monkeypatch.setattr(nt, "shared_path", lambda spark, what: None)
    compare(spark, INPUTS["copies over several tiles"], 4)


SPREADS = {
    "log scale": lambda i: 10.0 ** (i % 600 - 300) * (1 + i / 7919),
    "clusters": lambda i: [1e-9, 1.0, 1e9][i % 3] + (i * 7919 % 10_007) * 1e-12,
    "two prices": lambda i: 1.0 if i % 10 else 1e300,
    "evenly": lambda i: float(i * 7919 % 10_007),
}


@pytest.mark.parametrize("collected", [300, 50_000])
@pytest.mark.parametrize("name", SPREADS)
def test_two_scans_however_the_values_are_spread(spark, tmp_path, monkeypatch, name, collected):
    values = [(SPREADS[name](i), i) for i in range(20_000)]
    path = str(tmp_path / "keys")
    spark.createDataFrame(values, "p double, i bigint").write.parquet(path)
    monkeypatch.setattr(nt, "COLLECTED", collected)
    scans = []
    for step in ("_sketched", "_counted", "_kept"):
        def counted(keys, *rest, step=getattr(nt, step)):
            if path in str(keys.inputFiles()):
                scans.append(step.__name__)
            return step(keys, *rest)

        monkeypatch.setattr(nt, step, counted)
    borders = nt.tile_borders(spark.read.parquet(path), ORDER, 4)
    ordered = sorted(values)
    assert [(b.key, b.rank) for b in borders] == [(ordered[r], r) for r in (5000, 10_000, 15_000)]
    assert scans == ["_sketched", "_kept" if collected == 300 else "_counted"]


def test_a_border_that_the_sketch_missed_is_found(spark, monkeypatch):
    monkeypatch.setattr(nt, "margin", lambda: 0.0)
    monkeypatch.setattr(nt, "SKETCH", 8)
    values = [(float(i * 7919 % 10_007), i) for i in range(5000)]
    for collected in (500, 50_000):
        monkeypatch.setattr(nt, "COLLECTED", collected)
        borders = nt.tile_borders(spark.createDataFrame(values, "p double, i bigint"), ORDER, 4)
        assert [b.key for b in borders] == [sorted(values)[r] for r in (1250, 2500, 3750)]


def test_sizes_differ_by_one(spark):
    df = spark.range(11).select(F.col("id").cast("double").alias("p"), F.col("id").alias("i"))
    sizes = nt.ntile(df, ORDER, 4, "t").groupBy("t").count().orderBy("t").collect()
    assert [r["count"] for r in sizes] == [3, 3, 3, 2]


@pytest.mark.parametrize("row", [(None, 1), (1.0, None)])
def test_missing_key_is_an_error(spark, row):
    df = spark.createDataFrame([(1.0, 1), row, (2.0, 2)], "p double, i bigint")
    with pytest.raises(Exception, match="NULL in the order of tiles"):
        nt.ntile(df, ORDER, 2, "t")


def test_borders_found_once_serve_all_price_statistics(spark, events, rows):
    df = events(*((i, "s", 1, "view", {"price": float(i % 7 + 1)}) for i in range(60)))
    borders = reports.price_borders(df)
    apart = rows(inference.price_segments(df).orderBy("position"))
    assert rows(inference.price_segments(df, borders=borders).orderBy("position")) == apart
    tests = inference.segment_tests(df, inference.PRICE, "view → cart", borders=borders)
    assert rows(tests) == rows(inference.segment_tests(df, inference.PRICE, "view → cart"))


def test_report_ignores_unpriced_rows(events, rows):
    prices = [None, 0.0, -1.0, float("nan"), 1.0, 2.0, 3.0, 4.0, 5.0]
    df = events(*((i, "s", 1, "view", {"price": p}) for i, p in enumerate(prices)))
    found = rows(reports.funnel_by_price_quartile(df))
    assert [r[:4] for r in found] == [(1, 1.0, 2.0, 2), (2, 3.0, 3.0, 1), (3, 4.0, 4.0, 1), (4, 5.0, 5.0, 1)]


def test_report_with_one_price(events, rows):
    df = events(*((i, "s", 1, "view") for i in range(6)))
    assert [r[3] for r in rows(reports.funnel_by_price_quartile(df))] == [2, 2, 1, 1]


def test_report_counts_copies_on_a_border_in_both_quartiles(events, rows):
    df = events(*((1, "s", 1, "view") for _ in range(8)))
    assert [r[3] for r in rows(reports.funnel_by_price_quartile(df))] == [1, 1, 1, 1]


def test_report_places_missing_users_first(events, rows):
    df = events(*((u, "s", 1, kind) for u in (None, 1, 2, 3) for kind in ("view", "cart")))
    found = rows(reports.funnel_by_price_quartile(df))
    assert [r[3:] for r in found] == [(1, 1, 0)] * 4
