"""Declared table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

PRICE = T.DecimalType(20, 8)

BARS = T.StructType([
    T.StructField("symbol", T.StringType(), False),
    T.StructField("session", T.DateType(), False),
    *[T.StructField(name, PRICE, False) for name in ("open", "high", "low", "close", "adjusted_close")],
    T.StructField("volume", T.LongType(), False),
    T.StructField("dividend", PRICE, False),
    T.StructField("split_coefficient", PRICE, False),
    T.StructField("source", T.StringType(), False),
    *[
        T.StructField(name, T.TimestampNTZType(), False)
        for name in ("observed_at", "published_at", "available_to_strategy_at", "retrieved_at")
    ],
    T.StructField("vintage", T.StringType(), False),
    T.StructField("quality", T.StringType(), False),
])

# Items of responses as texts; their fields are typed and judged one by one.
LIST_PRICE = (
    "struct<date:string,open:string,high:string,low:string,close:string,volume:string,"
    "divCash:string,splitFactor:string,adjClose:string>"
)
LIST_CAP = "struct<date:string,marketCap:string>"
MAP_PRICES = "struct<`Time Series (Daily)`:map<string,string>>"
COMPANY_FACTS = "struct<facts:struct<`us-gaap`:map<string,struct<units:map<string,array<string>>>>>>"
FILING = "struct<val:string,form:string,filed:string,`end`:string>"
TICKER = "struct<cik_str:string,ticker:string>"

# The names of the enumerations used in the tables.
QUALITY = ("PASS", "STALE", "CONFLICT", "MISSING")
SIDES = ("BUY", "SELL")
ROLES = ("BUSINESS_CHANGE", "CATALYST_EVENT", "FAILURE_MODE", "PORTFOLIO_CONTEXT")
STANCES = ("SUPPORT", "CONCERN", "NEUTRAL")
SEVERITIES = ("LOW", "MEDIUM", "HIGH")
VERDICTS = ("SUPPORT", "CONCERN", "ABSTAIN")
JOB_STATUSES = ("PENDING", "RUNNING", "SUCCEEDED", "DEAD")

# Accounting concepts read from filings, in claim order, and the forms accepted.
CONCEPTS = (
    "Revenues",
    "RevenueFromContractWithCustomerExcludingAssessedTax",
    "NetIncomeLoss",
    "OperatingIncomeLoss",
    "Assets",
    "Liabilities",
    "CashAndCashEquivalentsAtCarryingValue",
)
FORMS = ("10-Q", "10-K")

# Allowed moves of the position lifecycle, (from, to).
LIFECYCLE_MOVES = (
    ("CASH_OR_SPY", "CANDIDATE"),
    ("CANDIDATE", "APPROVED"),
    ("CANDIDATE", "BLOCKED_DATA"),
    ("CANDIDATE", "BLOCKED_RISK"),
    ("APPROVED", "ORDER_PENDING"),
    ("APPROVED", "BLOCKED_RISK"),
    ("ORDER_PENDING", "OPEN"),
    ("ORDER_PENDING", "BLOCKED_RISK"),
    ("OPEN", "ADD_ALLOWED"),
    ("OPEN", "REDUCE_REQUIRED"),
    ("OPEN", "EXIT_REQUIRED"),
    ("ADD_ALLOWED", "ORDER_PENDING"),
    ("ADD_ALLOWED", "OPEN"),
    ("REDUCE_REQUIRED", "ORDER_PENDING"),
    ("EXIT_REQUIRED", "ORDER_PENDING"),
    ("CLOSED", "CANDIDATE"),
    ("BLOCKED_DATA", "CANDIDATE"),
    ("BLOCKED_RISK", "CANDIDATE"),
    ("BLOCKED_RISK", "OPEN"),
)
