"""Small price tables for the tests."""

from __future__ import annotations

from datetime import date, datetime, timedelta

START = date(2020, 1, 1)
BAR = (
    "symbol string, session date, open double, high double, low double, close double, adjusted_close double, "
    "volume bigint, dividend double, split_coefficient double, observed_at timestamp_ntz, published_at timestamp_ntz, "
    "available_to_strategy_at timestamp_ntz, retrieved_at timestamp_ntz, vintage string, quality string"
)


def day(i: int) -> date:
    return START + timedelta(days=i)


def close_of(session: date) -> datetime:
    return datetime(session.year, session.month, session.day, 21)


def bar(symbol, i, close, open_=None, volume=1_000_000, dividend=0.0, split=1.0, available=None, quality="PASS"):
    opened = close if open_ is None else open_
    seen = close_of(day(i)) if available is None else available
    return (symbol, day(i), float(opened), float(max(opened, close)), float(min(opened, close)), float(close), float(close),
            volume, float(dividend), float(split), close_of(day(i)), close_of(day(i)), seen, seen, "v1", quality)


def bars(spark, rows):
    return spark.createDataFrame(rows, BAR)


def series(symbol, closes):
    return [bar(symbol, i, c) for i, c in enumerate(closes)]
