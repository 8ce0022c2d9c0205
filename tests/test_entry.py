import duckdb
import pytest

import __spark_entry__ as entry
from timberline import queries as base

SMALL = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(base.oracle_sql()))
def test_against_sql(spark, name):
    for t in ("events", "orders", "documents", "conversations", "pages"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = duckdb.sql(base.oracle_sql()[name])
    got = entry.queries()[name](spark, SMALL)
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    assert sorted(map(repr, map(tuple, got.select(*cols).collect()))) == sorted(map(repr, want.select(", ".join(cols)).fetchall()))


@pytest.mark.parametrize("name", sorted(set(base.queries()) - set(base.oracle_sql())))
def test_runs(spark, name):
    assert entry.queries()[name](spark, SMALL).count() > 0
