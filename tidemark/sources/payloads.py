"""Parsers for landed provider payloads: one text column per response, parsed with declared schemas.

Each parser returns plain rows. Responses that are provider errors or cut off never become data and are listed
by ``quarantine`` instead; items of good responses whose fields do not hold are left out by the parser and listed, field
by field, by the ``rejected_...`` function beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions.columns import session_close
from tidemark.sources.fields import FAULTS, Field, accepted, judged, rejected

# Keys that mark an error response, in order of precedence.
MAP_ERRORS = ("Error Message", "Note", "Information")
LIST_ERRORS = ("detail", "message")
SERIES = "Time Series (Daily)"


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """Landed files as (path, payload), one row per file."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload"))


#: Items are taken as texts first, so that one of the wrong form spoils no other.
TEXTS = "array<string>"
#: Where a rejected field stands: symbol of the response, and the item's number or key in it.
PLACE = ("symbol", "place")
_PRICES = ("open", "high", "low", "close")


def _stamps(retrieved: Column, prefix: str) -> list[Column]:
    closed = session_close("session")
    vintage = F.concat(F.lit(prefix), F.date_format(retrieved, "yyyy-MM-dd'T'HH:mm:ss"))
    return [
        closed.alias("observed_at"), closed.alias("published_at"), closed.alias("available_to_strategy_at"),
        retrieved.alias("retrieved_at"), vintage.alias("vintage"), F.lit("PASS").alias("quality"),
    ]


def _is_list(payload: str = "payload") -> Column:
    return F.ltrim(payload).startswith("[")


def _list_bars(responses: DataFrame) -> DataFrame:
    items = responses.filter(list_error().isNull()).select(
        F.upper("symbol").alias("symbol"), "retrieved_at", F.posexplode(F.from_json("payload", TEXTS)).alias("position", "text"))
    items = items.withColumns({"bar": F.from_json("text", schemas.LIST_PRICE), "place": F.col("position").cast("string")})
    return judged(items, [
        Field("session", F.col("bar.date"), "stamp"), *[Field(n, F.col(f"bar.{n}"), "price") for n in _PRICES],
        Field("volume", F.col("bar.volume"), "count", False, 0), Field("dividend", F.col("bar.divCash"), "price", False, 0),
        Field("split_coefficient", F.col("bar.splitFactor"), "price", False, 1)], ["symbol", "retrieved_at", "place"])


def parse_list_prices(responses: DataFrame) -> DataFrame:
    """Array-of-objects price payloads: raw close kept as adjusted close, missing actions filled in."""
    return accepted(_list_bars(responses)).select(
        "symbol", "session", *_PRICES, F.col("close").alias("adjusted_close"), "volume", "dividend", "split_coefficient",
        F.lit("Tiingo").alias("source"), *_stamps(F.col("retrieved_at"), "raw:retrieved:"))


def rejected_list_prices(responses: DataFrame) -> DataFrame:
    return rejected(_list_bars(responses), PLACE)


def _map_bars(responses: DataFrame, adjusted: bool) -> DataFrame:
    series = F.from_json("payload", schemas.MAP_PRICES).getField(SERIES)
    items = responses.filter(map_error().isNull()).select(
        F.upper("symbol").alias("symbol"), "retrieved_at", F.explode(series).alias("place", "text"))
    items = items.withColumn("bar", F.from_json("text", "map<string,string>"))
    found = [Field("session", F.col("place"), "date"), *[Field(n, _quoted(f"{k}. {n}"), "price") for k, n in enumerate(_PRICES, start=1)]]
    if adjusted:
        found += [Field("adjusted_close", _quoted("5. adjusted close"), "price"), Field("volume", _quoted("6. volume"), "whole"),
                  Field("dividend", _quoted("7. dividend amount"), "price"), Field("split_coefficient", _quoted("8. split coefficient"), "price")]
    else:
        found.append(Field("volume", _quoted("5. volume"), "whole"))
    return judged(items, found, ["symbol", "retrieved_at", "place"])


def _quoted(key: str) -> Column:
    return F.try_element_at(F.col("bar"), F.lit(key))


def parse_map_prices(responses: DataFrame, adjusted: bool = True) -> DataFrame:
    """Date-keyed price payloads with numbered string fields, adjusted or raw form."""
    rows = accepted(_map_bars(responses, adjusted))
    if not adjusted:
        rows = rows.withColumns({"adjusted_close": F.col("close"), "dividend": F.lit(0).cast(schemas.PRICE), "split_coefficient": F.lit(1).cast(schemas.PRICE)})
    return rows.select(
        "symbol", "session", *_PRICES, "adjusted_close", "volume", "dividend", "split_coefficient", F.lit("Alpha Vantage").alias("source"),
        *_stamps(F.col("retrieved_at"), "retrieved:" if adjusted else "raw:retrieved:"))


def rejected_map_prices(responses: DataFrame, adjusted: bool = True) -> DataFrame:
    return rejected(_map_bars(responses, adjusted), PLACE)


def _field(key: str) -> Column:
    return F.get_json_object("payload", f"$['{key}']")


def map_error() -> Column:
    """Reason a date-keyed response holds no data, or null."""
    message = F.coalesce(*[_field(key) for key in MAP_ERRORS])
    series = F.from_json("payload", schemas.MAP_PRICES).getField(SERIES)
    return F.coalesce(message, F.when(series.isNull(), F.lit("daily series missing")))


def list_error() -> Column:
    """Reason an array response holds no data or cannot be parsed whole, or null."""
    message = F.coalesce(*[_field(key) for key in LIST_ERRORS], F.col("payload"))
    return F.when(F.col("payload").isNull(), "no response").when(~_is_list(), message).when(
        ~_whole(), "not valid JSON")


def facts_error() -> Column:
    """Reason a filings response holds no data or cannot be parsed whole, or null."""
    facts = F.get_json_object("payload", "$.facts")
    return F.when(F.col("payload").isNull(), "no response").when(~_whole(), "not valid JSON").when(
        facts.isNull(), "facts missing")


def object_error(*parts: str) -> Column:
    """Reason a response is not one whole JSON object with these parts, or null."""
    missing = [F.when(F.get_json_object("payload", f"$.{part}").isNull(), F.lit(f"{part} missing")) for part in parts]
    return F.when(F.col("payload").isNull(), "no response").when(~_whole(), "not valid JSON").when(
        ~F.ltrim("payload").startswith("{"), F.lit("not an object")).otherwise(F.coalesce(*missing, F.lit(None).cast("string")))


def universe_error() -> Column:
    return object_error("as_of", "count", "symbols")


def _whole() -> Column:
    """Whether the whole text is one JSON value: cut off responses are not."""
    return F.try_variant_get(F.try_parse_json("payload"), "$", "variant").isNotNull()


def quarantine(responses: DataFrame, error: Column) -> DataFrame:
    return responses.withColumn("reason", error).filter("reason IS NOT NULL")


def _caps(responses: DataFrame) -> DataFrame:
    items = responses.filter(list_error().isNull()).select(
        F.upper("symbol").alias("symbol"), "retrieved_at", F.posexplode(F.from_json("payload", TEXTS)).alias("position", "text"))
    items = items.withColumns({"cap": F.from_json("text", schemas.LIST_CAP), "place": F.col("position").cast("string")})
    # An object without a value is no fault; what is no object is.
    items = items.filter("cap.marketCap IS NOT NULL OR NOT coalesce(startswith(ltrim(text), '{'), false)")
    return judged(items, [Field("observed_date", F.col("cap.date"), "stamp"), Field("market_cap", F.col("cap.marketCap"), "amount")],
                  ["symbol", "retrieved_at", "place"])


def parse_market_caps(responses: DataFrame) -> DataFrame:
    """Market capitalisations; null values are dropped, available at the observed day's close."""
    return accepted(_caps(responses)).select(
        "symbol", "observed_date", session_close("observed_date").alias("available_to_strategy_at"), "market_cap",
        F.lit("Tiingo Fundamentals").alias("source"),
        F.concat(F.lit("retrieved:"), F.date_format("retrieved_at", "yyyy-MM-dd'T'HH:mm:ss")).alias("vintage"))


def rejected_market_caps(responses: DataFrame) -> DataFrame:
    return rejected(_caps(responses), PLACE)


def _facts(responses: DataFrame) -> DataFrame:
    concepts = F.from_json("payload", schemas.COMPANY_FACTS).getField("facts").getField("us-gaap")
    by_concept = responses.filter(facts_error().isNull()).select("symbol", F.explode(concepts).alias("concept", "fact")).filter(
        F.col("concept").isin(*schemas.CONCEPTS))
    by_unit = by_concept.select("symbol", "concept", F.explode("fact.units").alias("unit", "filings"))
    items = by_unit.select("symbol", "concept", "unit", F.posexplode("filings").alias("position", "text"))
    items = items.withColumn("filing", F.from_json("text", schemas.FILING)).filter(
        F.col("filing.form").isin(*schemas.FORMS) & F.col("filing.filed").isNotNull())
    items = items.withColumn("place", F.concat_ws("/", "concept", "unit", F.col("position").cast("string")))
    return judged(items, [Field("filed", F.col("filing.filed"), "date"), Field("end_date", F.col("filing.end"), "date", False),
                          Field("val", F.col("filing.val"), "number")], ["symbol", "concept", "unit", "place", "filing"])


def parse_company_facts(responses: DataFrame) -> DataFrame:
    """Nested filings flattened: known concepts, all units, periodic reports with a filing date."""
    return accepted(_facts(responses)).select("symbol", "concept", "unit", "filed", "filing.end", "val", "filing.form")


def rejected_company_facts(responses: DataFrame) -> DataFrame:
    return rejected(_facts(responses), PLACE)


def _tickers(responses: DataFrame) -> DataFrame:
    items = responses.filter(object_error().isNull()).select(F.explode(F.from_json("payload", "map<string,string>")).alias("place", "text"))
    items = items.withColumn("entry", F.from_json("text", schemas.TICKER))
    items = items.withColumn("symbol", F.replace(F.upper("entry.ticker"), F.lit("."), F.lit("-")))
    return judged(items, [Field("ticker", F.col("entry.ticker"), "text"), Field("cik", F.col("entry.cik_str"), "whole")], ["symbol", "place"])


def parse_ticker_map(responses: DataFrame) -> DataFrame:
    return accepted(_tickers(responses)).select("symbol", "cik")


def rejected_tickers(responses: DataFrame) -> DataFrame:
    return rejected(_tickers(responses), PLACE)


def _universes(responses: DataFrame) -> DataFrame:
    items = responses.filter(universe_error().isNull()).select(
        F.from_json("payload", "struct<as_of:string,count:string,symbols:array<string>>").alias("u"),
        F.sha2("payload", 256).alias("place"))
    items = items.withColumn("symbol", F.lit(None).cast("string"))
    checked = judged(items, [Field("as_of", F.col("u.as_of"), "date"), Field("count", F.col("u.count"), "whole")], ["symbol", "place", "u"])
    listed = F.struct(F.lit("symbols").alias("field"), F.lit(None).cast("string").alias("value"), F.lit("not a list of names").alias("reason"))
    odd = F.col("u.symbols").isNull() | F.exists("u.symbols", lambda x: x.isNull())
    return checked.withColumn(FAULTS, F.when(odd, F.array_append(FAULTS, listed)).otherwise(F.col(FAULTS)))


def parse_universe_snapshot(responses: DataFrame) -> DataFrame:
    """Universe definitions with the checks: the stated count holds and no symbol repeats."""
    symbols = F.col("u.symbols")
    return accepted(_universes(responses)).select(
        "as_of", F.col("count").cast("int").alias("count"), symbols.alias("symbols"),
        ((F.size(symbols) == F.col("count")) & (F.size(F.array_distinct(symbols)) == F.size(symbols))).alias("valid"))


def rejected_universes(responses: DataFrame) -> DataFrame:
    """Faults of universe definitions, whose place is the SHA-256 of the response."""
    return rejected(_universes(responses), PLACE)
