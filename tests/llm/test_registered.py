"""The registered queries over the smallest given tables: as SQL where there is SQL."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from funnelry.llm.oracles import all_oracles
from funnelry.llm.queries import all_queries

FOLDER = Path("/root/testdata/sf0.001")


def test_all_queries():
    assert sorted(int(name[2:].split("_")[0]) for name in all_queries()) == list(range(1, 14))
    assert {*all_queries(), "pipeline"} <= set(entry.queries())
    assert set(all_oracles()) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", all_oracles())
def test_same_rows(spark, duck, same, name):
    tables = {file.stem: spark.read.parquet(str(file)) for file in FOLDER.glob("*.parquet")}
    wanted = {t: df for t, df in tables.items() if t in all_oracles()[name]}
    same(all_queries()[name](spark, str(FOLDER)), duck(all_oracles()[name], **wanted))


def test_schemas_do_not_change(spark):
    for name in ("op5_backoff_scores", "op7_toxicity", "op8_licences"):
        found = all_queries()[name](spark, str(FOLDER))
        assert found.count() > 0 or name == "op8_licences"
        assert found.columns[0] == "doc_id"
