"""Index-membership history files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import provider_symbol

HEADER = ["date", "tickers"]


def read_membership_csv(spark: SparkSession, path: str) -> DataFrame:
    """(date, symbol) rows of a two-column history; any other header is an error.

    The header is read as data first, because it may carry a byte-order mark.
    """
    head = spark.read.text(path).limit(1).first()
    names = [name.strip().strip('"') for name in (head[0] if head else "").lstrip("﻿").split(",")]
    if names != HEADER:
        raise ValueError(f"unexpected membership header: {names}")
    rows = spark.read.csv(path, header=True, schema="date string, tickers string", enforceSchema=True)
    return expand_members(rows.withColumn("date", F.to_date("date")))


def expand_members(records: DataFrame) -> DataFrame:
    """One row per (date, symbol): tickers split, spelled the provider's way, without repeats."""
    return records.select("date", F.explode(F.split("tickers", ",")).alias("ticker")).select(
        "date", provider_symbol("ticker").alias("symbol")).distinct()
