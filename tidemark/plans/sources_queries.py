"""Registered queries: payload parsing, stored ranges, snapshot hashes and the event log.

Payloads are built from the bars with to_json and parsed back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.columns import r
from tidemark.operators import metrics
from tidemark.plans import driver_tables as d
from tidemark.plans.curves_queries import points, rounded_metrics
from tidemark.session import scratch_path
from tidemark.sources import payloads, stores

RETRIEVED = "2002-01-01 00:00:00"


def retrieved():
    return F.lit(RETRIEVED).cast("timestamp_ntz")


def number():
    return F.regexp_extract("symbol", r"(\d+)$", 1).cast("int")


def list_payloads(bars):
    """One array response per symbol (its bars are bounded by the calendar); some fields are missing."""
    item = F.struct(
        F.concat(F.col("session").cast("string"), F.lit("T00:00:00.000Z")).alias("date"),
        *[F.col(n) for n in ("open", "high", "low", "close")],
        F.when(F.col("volume") % 6 > 0, F.col("volume")).alias("volume"),
        F.when(F.col("dividend") > 0, F.col("dividend")).alias("divCash"),
        F.when(F.col("split_coefficient") > 1, F.col("split_coefficient")).alias("splitFactor"),
        (F.col("close") / 2).alias("adjClose"))
    error = F.when(number() % 6 == 1, F.lit('{"detail": "not found"}')).when(
        number() % 6 == 2, F.lit('{"message": "slow down"}')).when(number() % 6 == 3, F.lit('{"other": 1}'))
    return bars.groupBy(F.lower("symbol").alias("symbol")).agg(F.to_json(F.collect_list(item)).alias("payload")).select(
        "symbol", F.coalesce(error, F.col("payload")).alias("payload"), retrieved().alias("retrieved_at"))


def map_payloads(bars, adjusted):
    text = lambda c: c.cast("string")
    fields = [("1. open", "open"), ("2. high", "high"), ("3. low", "low"), ("4. close", "close")]
    values = [x for key, name in fields for x in (F.lit(key), text(F.col(name)))]
    if adjusted:
        values += [F.lit("5. adjusted close"), text(F.col("close") / 2), F.lit("6. volume"), text(F.col("volume")),
                   F.lit("7. dividend amount"), text(F.col("dividend")),
                   F.lit("8. split coefficient"), text(F.col("split_coefficient"))]
    else:
        values += [F.lit("5. volume"), text(F.col("volume"))]
    day = F.struct(F.col("session").cast("string").alias("day"), F.create_map(*values).alias("bar"))
    body = F.to_json(F.struct(F.map_from_entries(F.collect_list(day)).alias(payloads.SERIES)))
    error = (
        F.when(number() % 7 == 1, F.lit('{"Note": "rate limit"}'))
        .when(number() % 7 == 2, F.lit('{"Error Message": "bad symbol"}'))
        .when(number() % 7 == 3, F.lit('{"Information": "key"}')).when(number() % 7 == 4, F.lit('{"Meta Data": {}}')))
    return bars.groupBy("symbol").agg(body.alias("payload")).select(
        F.lower("symbol").alias("symbol"), F.coalesce(error, F.col("payload")).alias("payload"),
        retrieved().alias("retrieved_at"))


def parsed(rows):
    prices = ("open", "high", "low", "close", "adjusted_close", "dividend", "split_coefficient")
    return rows.select(
        "symbol", "session", *[F.col(n).cast("double").alias(n) for n in prices], "volume", "source",
        "available_to_strategy_at", "vintage", "quality")


def list_prices(spark, sf):
    return parsed(payloads.parse_list_prices(list_payloads(d.bars(spark, sf))))


def map_prices(adjusted):
    def query(spark, sf):
        return parsed(payloads.parse_map_prices(map_payloads(d.bars(spark, sf), adjusted), adjusted))
    return query


def quarantined_payloads(spark, sf):
    bars = d.bars(spark, sf)
    lists = payloads.quarantine(list_payloads(bars), payloads.list_error()).withColumn("form", F.lit("list"))
    maps = payloads.quarantine(map_payloads(bars, False), payloads.map_error()).withColumn("form", F.lit("map"))
    return lists.unionByName(maps).select("symbol", "form", "reason")


def market_cap_payloads(spark, sf):
    item = F.struct(
        F.concat(F.col("observed_date").cast("string"), F.lit("T00:00:00Z")).alias("date"),
        F.when(F.month("observed_date") != 4, F.col("market_cap").cast("decimal(28,4)")).alias("marketCap"))
    landed = d.market_caps(spark, sf).groupBy(F.lower("symbol").alias("symbol")).agg(
        F.to_json(F.collect_list(item)).alias("payload")).withColumn("retrieved_at", retrieved())
    return payloads.parse_market_caps(landed).select(
        "symbol", "observed_date", "available_to_strategy_at", r(F.col("market_cap").cast("double"), 2).alias("market_cap"),
        "source", "vintage")


def ticker_map(spark, sf):
    entries = d.bars(spark, sf).select("symbol").distinct().select(
        number().cast("string").alias("k"),
        F.struct((number() * 1000 + 7).alias("cik_str"), F.replace(F.lower("symbol"), F.lit("-"), F.lit(".")).alias("ticker"))
        .alias("v"))
    landed = entries.groupBy().agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "v")))).alias("payload"))
    return payloads.parse_ticker_map(landed)


def universe_snapshot(spark, sf):
    yearly = d.bars(spark, sf).groupBy(F.year("session").alias("y")).agg(F.collect_set("symbol").alias("s"))
    symbols = F.when(F.col("y") % 3 == 0, F.concat("s", F.array(F.lit("Brand-1")))).otherwise(F.col("s"))
    body = F.to_json(F.struct(
        F.concat(F.col("y").cast("string"), F.lit("-12-31")).alias("as_of"),
        F.when(F.col("y") % 4 == 0, F.size("s") + 1).otherwise(F.size(symbols)).alias("count"), symbols.alias("symbols")))
    return payloads.parse_universe_snapshot(yearly.select(body.alias("payload"))).select(
        "as_of", "count", F.size("symbols").alias("listed"), "valid")


def covering_ranges(spark, sf):
    """Stored yearly and half-history files of each symbol against requests of odd lengths."""
    span = d.bars(spark, sf).groupBy("symbol", F.year("session").alias("y")).agg(
        F.min("session").alias("cached_start"), F.max("session").alias("cached_end"))
    long = span.groupBy("symbol", (F.col("y") < 1998).alias("early")).agg(
        F.min("cached_start").alias("cached_start"), F.max("cached_end").alias("cached_end"))
    cached = span.select("symbol", "cached_start", "cached_end").unionByName(
        long.select("symbol", "cached_start", "cached_end"))
    requests = span.select(
        "symbol", F.date_add("cached_start", 30).alias("start"),
        F.date_add("cached_start", F.when(F.col("y") % 2 == 0, 200).otherwise(400)).alias("end"))
    return stores.covering_range(requests, cached)


def stored_range_read(spark, sf):
    from tidemark.session import scratch_path

    path = scratch_path(spark, "bars-by-year")
    stores.write_bars(d.bars(spark, sf), path)
    return stores.read_bars(spark, path, "1996-03-01", "1997-06-30").select("symbol", "session", "close", "volume")


def snapshot_hashes(spark, sf):
    return stores.symbol_digests(d.bars(spark, sf)).select("symbol", "digest", "rows")


def snapshot_root(spark, sf):
    return stores.snapshot_digest(d.bars(spark, sf))


def stored_events(spark, sf):
    """Two thirds of the first deliveries are in the store already."""
    log = d.event_log(spark, sf)
    return stores.with_payload_hash(log.filter("delivery = 0 AND n % 3 > 0"))


def event_outcomes(spark, sf):
    log = d.event_log(spark, sf)
    return stores.classify_events(log, stored_events(spark, sf)).select(
        "event_id", "payload", "payload_hash", "contradicts", "outcome")


def appended_events(spark, sf):
    log = d.event_log(spark, sf)
    new = stores.append_events(log, stored_events(spark, sf))
    return stores.sequenced(new).select(
        F.col("sequence"), "event_id", "occurred_at", "event_type", "entity_id", "payload", "payload_hash")


def entity_events(spark, sf):
    log = stores.sequenced(stores.append_events(d.event_log(spark, sf)))
    return stores.entity_events(log, "42").select("sequence", "event_id", "event_type", "payload_hash")


def report_documents(spark, sf):
    rows = metrics.performance_metrics(points(spark, sf), ["symbol", "candidate"])
    return stores.report_lines(rows.select(*[
        r(c).alias(c) if c not in ("symbol", "candidate") else F.col(c) for c in rows.columns]))


def stored_reports(spark, sf):
    """The metrics written as documents and read back: every number survives."""
    keys = ["symbol", "candidate"]
    rows = metrics.performance_metrics(points(spark, sf), keys)
    path = scratch_path(spark, "report")
    stores.write_report(rows, path)
    return rounded_metrics(stores.read_report(spark, path, rows.schema), keys)


# ------------------------------------------------------------------ responses with faults

def listed(rows, key, item):
    """One array response per symbol, its items in order of a key (bounded by the calendar)."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), item.alias("v"))))
    return rows.groupBy(F.lower("symbol").alias("symbol")).agg(F.to_json(F.transform(entries, lambda x: x["v"])).alias("payload")).withColumn(
        "retrieved_at", retrieved())


def faulty_responses(spark, sf):
    """Responses of six forms: bad dates, prices, volumes, values, ids and counts among good ones.

    They are made from stored bars and caps: over lazy ones, what judges a response made of keys alone (years, symbols) would
    be pushed below the aggregation and run once per trade."""
    bars = d.stored_bars(spark, sf)
    text = lambda c: F.col(c).cast("string")
    bad = lambda n, value, good: F.when(F.col("volume") % n == 0, value).otherwise(good)
    prices = listed(bars, "session", F.struct(
        bad(31, "2001-13-45", F.concat(text("session"), F.lit("T00:00:00.000Z"))).alias("date"), *[text(n).alias(n) for n in ("open", "high", "low")],
        bad(37, "1O1", text("close")).alias("close"), bad(41, "n/a", text("volume")).alias("volume")))
    day = F.struct(bad(43, F.concat(text("session"), F.lit("x")), text("session")).alias("day"), F.create_map(
        *[x for k, n in enumerate(("open", "high", "low"), start=1) for x in (F.lit(f"{k}. {n}"), text(n))],
        F.lit("4. close"), bad(47, "", text("close")), F.lit("5. volume"), text("volume")).alias("bar"))
    maps = bars.groupBy("symbol").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(day)).alias(payloads.SERIES))).alias("payload")).withColumn(
        "retrieved_at", retrieved())
    month = F.month("observed_date")
    caps = listed(d.stored_market_caps(spark, sf), "observed_date", F.struct(
        F.when(month == 5, "n/a").otherwise(text("observed_date")).alias("date"), F.when(month == 6, "12b").otherwise(text("market_cap")).alias("marketCap")))
    years = bars.select("symbol", F.year("session").alias("y")).distinct()
    filing = F.struct(F.lit("7").alias("val"), F.lit("10-K").alias("form"),
                      F.concat(text("y"), F.when(F.col("y") % 2 == 0, "-02-30").otherwise("-02-28")).alias("filed"))
    facts = listed(years, "y", filing).withColumn("payload", F.concat(F.lit('{"facts":{"us-gaap":{"Assets":{"units":{"USD":'), "payload", F.lit("}}}}}")))
    entry = F.struct(number().cast("string").alias("k"), F.struct(
        F.concat(F.when(number() % 5 == 0, "x").otherwise(""), number().cast("string")).alias("cik_str"), F.col("symbol").alias("ticker")).alias("v"))
    tickers = bars.select("symbol").distinct().groupBy().agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("payload"))
    universes = years.select("y").distinct().select(F.to_json(F.struct(
        F.concat(text("y"), F.when(F.col("y") % 2 == 0, "-13-45").otherwise("-12-31")).alias("as_of"),
        F.when(F.col("y") % 3 == 0, "many").otherwise("1").alias("count"), F.array(F.lit("A")).alias("symbols"))).alias("payload"))
    return {"list": prices, "map": maps, "caps": caps, "facts": facts, "tickers": tickers, "universe": universes}


def rejected_fields(spark, sf):
    found = faulty_responses(spark, sf)
    parts = {"list": payloads.rejected_list_prices(found["list"]), "map": payloads.rejected_map_prices(found["map"], adjusted=False),
             "caps": payloads.rejected_market_caps(found["caps"]), "facts": payloads.rejected_company_facts(found["facts"]),
             "tickers": payloads.rejected_tickers(found["tickers"]),
             "universe": payloads.rejected_universes(found["universe"]).withColumn("place", F.lit("definition"))}
    return union([rows.withColumn("form", F.lit(form)).select("form", F.upper("symbol").alias("symbol"), "place", "field", "value", "reason")
                  for form, rows in parts.items()])


def accepted_items(spark, sf):
    """What is left of the same responses, counted by symbol."""
    found = faulty_responses(spark, sf)
    universes = payloads.parse_universe_snapshot(found["universe"]).withColumn("symbol", F.lit(None).cast("string"))
    parts = {"list": payloads.parse_list_prices(found["list"]), "map": payloads.parse_map_prices(found["map"], adjusted=False),
             "caps": payloads.parse_market_caps(found["caps"]), "facts": payloads.parse_company_facts(found["facts"]),
             "tickers": payloads.parse_ticker_map(found["tickers"]), "universe": universes}
    return union([rows.groupBy(F.upper("symbol").alias("symbol")).agg(F.count("*").alias("items")).withColumn("form", F.lit(form))
                  for form, rows in parts.items()])


def union(parts):
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def quarantined_responses(spark, sf):
    """Errors, cut-off texts and missing answers among caps, filings and universe responses."""
    symbols = d.stored_bars(spark, sf).select("symbol").distinct()
    good = {"caps": '[{"date":"2001-01-31","marketCap":5}]', "facts": '{"facts":{"us-gaap":{}}}', "universe": '{"as_of":"2001-01-31","count":0,"symbols":[]}'}
    errors = {"caps": payloads.list_error(), "facts": payloads.facts_error(), "universe": payloads.universe_error()}
    answer = lambda whole: F.when(number() % 4 == 1, '{"detail":"no plan"}').when(number() % 4 == 2, whole[:-3]).when(number() % 4 != 3, whole)
    return union([payloads.quarantine(symbols.withColumn("payload", answer(whole)), errors[form]).select("symbol", F.lit(form).alias("form"), "reason")
                  for form, whole in good.items()])


# ------------------------------------------------------------------ stores that commit once

def continued_event_log(spark, sf):
    """Two appends and a repeat of the second: numbers go on from the first, and ids are stored once."""
    log, path = d.event_log(spark, sf), scratch_path(spark, "event-log")
    stores.append_log(log.filter("delivery = 0 AND n % 3 > 0"), path)
    stores.append_log(log, path)
    stores.append_log(log, path)
    return stores.read_log(spark, path).select("sequence", "event_id", "payload_hash")


def frozen_snapshot(spark, sf):
    """Bars frozen twice, refused with other content, and read back verified."""
    as_of, path = "1997-12-31 23:59:59", scratch_path(spark, "snapshots")
    bars = d.stored_bars(spark, sf).filter(F.col("available_to_strategy_at") <= F.lit(as_of).cast("timestamp_ntz"))
    digests = {stores.freeze_snapshot(rows, path, "close-of-1997", as_of) for rows in (bars, bars.orderBy("close"))}
    try:
        stores.freeze_snapshot(bars.withColumn("close", F.col("close") + 1), path, "close-of-1997", as_of)
        refused = False
    except stores.SnapshotConflict:
        refused = True
    rows = stores.read_snapshot(spark, path, "close-of-1997")
    return rows.select("symbol", "session", "close", F.lit(refused and len(digests) == 1).alias("frozen_once"))


QUERIES = {
    "list_price_payloads": list_prices,
    "map_price_payloads_adjusted": map_prices(True),
    "map_price_payloads_raw": map_prices(False),
    "quarantined_payloads": quarantined_payloads,
    "market_cap_payloads": market_cap_payloads,
    "ticker_map": ticker_map,
    "universe_snapshot": universe_snapshot,
    "covering_ranges": covering_ranges,
    "stored_range_read": stored_range_read,
    "snapshot_symbol_hashes": snapshot_hashes,
    "snapshot_root_hash": snapshot_root,
    "event_outcomes": event_outcomes,
    "appended_events": appended_events,
    "entity_events": entity_events,
    "report_documents": report_documents,
    "stored_reports": stored_reports,
    "rejected_fields": rejected_fields,
    "accepted_items": accepted_items,
    "quarantined_responses": quarantined_responses,
    "continued_event_log": continued_event_log,
    "frozen_snapshot": frozen_snapshot,
}
