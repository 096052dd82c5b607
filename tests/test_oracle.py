"""Registered queries against DuckDB on the smallest tables (all of them with ALL_QUERIES=1)."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from check_oracle import TABLES, tidy  # noqa: E402

import oracle  # noqa: E402
from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "bar_validity", "feature_panel", "long_flat_curve", "stage_means", "fresh_market_caps", "filing_evidence",
    "list_price_payloads", "event_outcomes", "curated_evidence", "case_routes", "positions", "executions", "stream_event_log",
)
CHOSEN = tuple(oracle.all_sql()) if os.environ.get("ALL_QUERIES") else SAMPLE


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, database, name):
    left, right = tidy(queries()[name](spark, SF).toPandas()), tidy(database.execute(oracle_sql()[name]).df())
    assert list(left.columns) == list(right.columns) and len(left) == len(right)
    if len(left):
        for column in left.columns:
            same = (left[column] == right[column]) | (left[column].isna() & right[column].isna())
            assert same.all(), column


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry_runs(spark):
    rows = entry(spark).collect()
    assert {r["candidate"] for r in rows} == {"buy_and_hold", "cash", "momentum_5", "momentum_10", "momentum_21"}
