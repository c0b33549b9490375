"""The entry points, and a sample of queries against their SQL twins in DuckDB."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from check import table  # noqa: E402
from tablework.plans.queries import TABLES  # noqa: E402


def test_catalogue():
    assert set(oracle_sql()) <= set(queries())
    assert len(queries()) > 100


def test_flagship(spark):
    df = entry(spark)
    assert df.columns == ["status", "key", "left_seq", "right_seq", "conflict_columns"]
    assert {r["status"] for r in df.select("status").distinct().collect()} == {"matched", "conflict", "left_only", "right_only"}


@pytest.mark.parametrize("name", ["reconcile_ledgers", "two_key_rate", "stack_grids", "pivot_totals", "url_safety"])
def test_equals_sql(spark, sf, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries()[name](spark, sf)
    cur = db.execute(oracle_sql()[name])
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table([d[0] for d in cur.description], cur.fetchall())


def test_fingerprints_of_a_growing_table_equal_sql(spark, sf):
    test_equals_sql(spark, sf, "fingerprint_document_files")
