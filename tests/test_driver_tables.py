"""Adapters of the driver's tables against SQL on rows where engines differ: half cents and equal trade keys."""

from __future__ import annotations

from datetime import datetime

import duckdb

from oracle.fixtures import with_
from tidemark.plans import driver_tables, streaming_queries

ITEM = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_tax double, l_returnflag string, l_shipdate timestamp_ntz"


def tables(spark, folder, items):
    spark.createDataFrame(items, ITEM).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(1, "Brand#1"), (2, "Brand#1")], "p_partkey bigint, p_brand string").write.parquet(f"{folder}/part.parquet")
    connection = duckdb.connect()
    for table in ("lineitem", "part"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    return str(folder), connection


def test_prices_and_first_trades_are_those_of_sql(spark, tmp_path):
    monday = datetime(1997, 3, 3)
    # Half cents that lie a bit below, and two parts under one order line whose prices alone tell them apart, both ways round.
    items = [(k, 1, 1, 1, 3.0, price, 0.0, "N", monday) for k, price in ((5, 47_595.0), (6, 72_675.0))]
    items += [(1, part, 1, 1, 1.0, price, 0.0, "N", monday) for part, price in ((1, 9_000.0), (2, 4_000.0), (1, 7_000.0))]
    items += [(9, part, 1, 1, 1.0, price, 0.0, "N", monday) for part, price in ((1, 3_000.0), (2, 8_000.0), (1, 5_000.0))]
    folder, sql = tables(spark, tmp_path, items)
    prices = [r["px"] for r in driver_tables.trades(spark, folder).orderBy("px").collect()]
    assert prices == [row[0] for row in sql.execute(with_("trades", "SELECT px FROM trades ORDER BY px")).fetchall()]
    assert 65.86 in prices and 74.22 in prices
    (bar,) = driver_tables.bars(spark, folder).select("open", "high", "low", "close").collect()
    assert tuple(bar) == (54.0, 74.22, 53.0, 58.0) == sql.execute(with_("bars", "SELECT open, high, low, close FROM bars")).fetchone()


def test_a_late_bar_does_not_delay_its_session(spark, tmp_path):
    from oracle import all_sql

    # Thirteen trades make a bar late by ten days; the session itself closed on its Friday.
    items = [(k, 1, 1, 1, 1.0, 1_000.0, 0.0, "N", datetime(1997, 3, 3)) for k in range(13)]
    items += [(99, 1, 1, 1, 1.0, 1_000.0, 0.0, "N", datetime(1997, 3, 24))]
    folder, sql = tables(spark, tmp_path, items)
    found = streaming_queries.stream_completeness(spark, folder).collect()
    assert [tuple(r) for r in found] == sql.execute(all_sql()["stream_session_completeness"]).fetchall()
    assert [(r["session"].isoformat(), r["seen"]) for r in found] == [("1997-03-03", 1)]
