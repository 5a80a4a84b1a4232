import pytest

from funnelry.llm import oracles, queries, warc

SCHEMA = "page_id long, url string, html string, HTML int"
BIG, SMALL = "<p>é" + "x" * 200, "<p>small"
ROWS = [
    (5, "http://a/5", BIG, 1), (3, "http://a/3", BIG, 1), (3, "http://a/3", BIG, 1), (9, None, BIG, 1),
    (None, "http://a/n", BIG, 1), (1, "http://a/\r\nX: 1", SMALL, 1), (2, "u", SMALL, 1), (4, "u", None, 1),
    (6, "u", "", 1), (None, None, "y" * 150, 1), (None, None, "y" * 150, 1), (7, "u", "z" * 2_000_000, 1),
]


@pytest.fixture
def archive(spark, tmp_path):
    def build(rows):
        folder = str(tmp_path / f"archive-{len(rows)}")
        warc.write(spark.createDataFrame(rows, SCHEMA), folder)
        return folder

    return build


def test_pages_come_back(spark, archive):
    folder = archive(ROWS)
    pages = warc.read_pages(spark, folder).collect()
    assert sorted((str(p.page_id), p.payload.decode()) for p in pages) == sorted((str(r[0]), r[2] or "") for r in ROWS)
    kinds = {(p.page_id, p.record_type, p.refers_to) for p in pages}
    assert kinds == {
        (3, "response", None), (5, "revisit", 3), (9, "revisit", 3), (None, "revisit", 3), (1, "response", None),
        (2, "response", None), (4, "response", None), (6, "response", None), (None, "response", None),
        (7, "response", None),
    }
    stored = spark.read.parquet(f"{folder}/payloads")
    assert stored.count() == stored.select("digest").distinct().count() == 5


def test_records_are_whole(spark, archive):
    for row in warc.read_records(spark, archive(ROWS)).collect():
        head, _, rest = bytes(row.record).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1" and all(": " in x for x in lines[1:])
        fields = dict(x.split(": ", 1) for x in lines[1:])
        assert len(rest) == int(fields["Content-Length"]) + 4 and rest.endswith(b"\r\n\r\n")
        assert (fields["WARC-Type"] == "revisit") == ("WARC-Refers-To" in fields)
        assert "X" not in fields


def test_damage_is_seen(spark, archive):
    folder = archive(ROWS)
    spark.read.parquet(f"{folder}/payloads").selectExpr(
        "digest", "IF(length(payload) > 1000, unhex('00'), payload) AS payload", "first_id"
    ).write.parquet(f"{folder}-2/payloads")
    spark.read.parquet(f"{folder}/records").write.parquet(f"{folder}-2/records")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_pages(spark, f"{folder}-2").collect()


def test_query_as_sql(spark, tmp_path, duck, same):
    rows = [r for r in ROWS if r[0] is not None]
    pages = spark.createDataFrame(rows, SCHEMA.replace("HTML", "extra"))
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    same(queries.op3_warc_archive(spark, str(tmp_path)), duck(oracles.OP3, pages=pages))


def test_no_pages(spark, archive):
    assert warc.read_pages(spark, archive([])).collect() == []
