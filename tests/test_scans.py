"""Running aggregates give the same result whether or not hot groups are split."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import scans


def rows(n=400, hot=0.6, seed=3):
    rng = random.Random(seed)
    return [("hot" if rng.random() < hot else f"k{rng.randrange(5)}", i, rng.randrange(-9, 10),
             None if rng.random() < 0.5 else f"v{rng.randrange(100)}") for i in rng.sample(range(10_000), n)]


def brute(data, reverse, exclusive):
    out = {}
    for key in {row[0] for row in data}:
        group = sorted((row for row in data if row[0] == key), key=lambda row: row[1], reverse=reverse)
        for k, row in enumerate(group):
            seen = group[: k if exclusive else k + 1]
            last = [r[3] for r in seen if r[3] is not None]
            out[(key, row[1])] = (
                sum(r[2] for r in seen) if seen else None, max((r[2] for r in seen), default=None),
                min((r[2] for r in seen), default=None), last[-1] if last else None)
    return out


@pytest.mark.parametrize("limit", [1_000_000, 25])
@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("exclusive", [False, True])
def test_running_matches_brute_force(spark, limit, reverse, exclusive):
    data = rows()
    df = spark.createDataFrame(data, "k string, t int, x int, v string")
    group = scans.ordered(df, ["k"], ["t"], limit)
    assert group.split == (limit == 25)
    result = scans.running(group, {
        "s": ("sum", "x"), "hi": ("max", "x"), "lo": ("min", "x"), "seen": ("last", "v")}, exclusive, reverse).result()
    found = {(r["k"], r["t"]): (r["s"], r["hi"], r["lo"], r["seen"]) for r in result.collect()}
    assert found == brute(data, reverse, exclusive)


def test_numbering_is_dense_over_the_whole_table(spark):
    df = spark.createDataFrame([(i * 7 % 1000,) for i in range(300)], "t int")
    for limit in (1_000_000, 20):
        got = scans.numbered(df, ["t"], max_group_rows=limit).collect()
        assert sorted(r["sequence"] for r in got) == list(range(1, 301))
        assert [r["t"] for r in sorted(got, key=lambda r: r["sequence"])] == sorted(r["t"] for r in got)


def test_no_task_numbers_many_rows(spark):
    rows = 3 * scans.NUMBERED_ROWS
    got = scans.numbered(spark.range(rows).selectExpr("id * 7919 % 1500007 as t"), ["t"])
    parts = got.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    assert parts <= 1.3 * scans.NUMBERED_ROWS
    assert tuple(got.agg(F.min("sequence"), F.max("sequence"), F.count_distinct("sequence")).first()) == (1, rows, rows)
    assert got.where("sequence > 1").count() == rows - 1


def test_groups_that_count_together_only_split(spark, monkeypatch):
    """Groups are counted by hashes of their keys; where two share one, the table is split and results stay."""
    data = rows()
    df = spark.createDataFrame(data, "k string, t int, x int, v string")
    largest = df.groupBy("k").count().agg(F.max("count")).first()[0]
    assert not scans.ordered(df, ["k"], ["t"], largest).split
    monkeypatch.setattr(scans, "SLOTS", 1)
    group = scans.ordered(df, ["k"], ["t"], largest)
    assert group.split
    found = scans.running(group, {"s": ("sum", "x"), "hi": ("max", "x"), "lo": ("min", "x"), "seen": ("last", "v")}).result().collect()
    assert {(r["k"], r["t"]): (r["s"], r["hi"], r["lo"], r["seen"]) for r in found} == brute(data, False, False)
