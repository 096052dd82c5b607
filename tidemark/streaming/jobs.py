"""Streaming versions of ingest, event log, completeness, lifecycle, positions and counters.

Ingest, log, completeness, lifecycle and positions run the batch operators on each micro-batch and keep
what they need in batch folders: repeats are recognised, late rows take their place or are listed as late.
Counters use event-time windows with a watermark.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window as W

from tidemark.operators import ledger, quality, scans
from tidemark.session import through_table
from tidemark.sources import stores
from tidemark.streaming.seen import SeenIds
from tidemark.streaming.sinks import put_batch, put_state, read_batches, read_state, start_batches

KEY = ("symbol", "session", "vintage")


def ingest_bars(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Valid bars once per (symbol, session, vintage) to out/bars, invalid ones to out/quarantine.

    Repeats are dropped inside the batch and against what is stored for the same sessions; only the
    stored files of the batch's session range are read. A bar that comes again with other content goes
    to out/conflicts; the one stored first stays, and within a batch the least.
    """
    schema = stream.schema

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        valid, invalid = quality.split_valid(batch, quality.bar_violations())
        body = [c for c in valid.columns if c not in KEY]
        content = F.xxhash64(*body)
        once = valid.groupBy(*KEY).agg(F.min(F.struct(*body)).alias("bar")).select(*KEY, "bar.*")
        low, high = once.agg(F.min("session"), F.max("session")).first()
        known = read_batches(spark, f"{out}/bars", schema, number).filter(
            F.col("session").between(F.lit(low), F.lit(high)))
        first = known.select(*KEY, content.alias("held")).unionByName(
            once.join(known.select(*KEY), [*KEY], "left_anti").select(*KEY, content.alias("held")))
        clash = valid.withColumn("came", content).join(first, [*KEY]).filter("came <> held").drop("came", "held")
        put_batch(clash.distinct(), f"{out}/conflicts", number)
        put_batch(once.join(known.select(*KEY), [*KEY], "left_anti"), f"{out}/bars", number)
        put_batch(invalid.distinct(), f"{out}/quarantine", number)

    return start_batches(stream, handle, checkpoint)


def append_event_log(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Events once per id to out/events; ids that come again with another payload to out/conflicts.

    Ids are looked up by way of their filters (see ``SeenIds``), so a batch of new ids reads no stored one."""
    seen = SeenIds(f"{out}/ids")

    def handle(batch: DataFrame, number: int) -> None:
        found = seen.find(batch.select(F.col("event_id").alias("id")), number)
        stored = found.stored.select(F.col("id").alias("event_id"), F.col("content").alias("payload_hash"))
        rows = through_table(stores.classify_events(batch, stored), "classified-events")
        new = rows.filter("outcome = 'NEW'")
        put_batch(new.drop("outcome", "contradicts", "delivery"), f"{out}/events", number)
        clash = rows.filter("outcome = 'CONFLICT' OR contradicts").select("event_id", "payload_hash", "outcome")
        put_batch(clash, f"{out}/conflicts", number)
        seen.add(new.select(F.col("event_id").alias("id"), F.col("payload_hash").alias("content")), number, found)

    return start_batches(stream, handle, checkpoint)


def session_completeness(
    stream: DataFrame, universe: DataFrame, out: str, checkpoint: str, delay_days: int = 14,
) -> StreamingQuery:
    """Symbols seen and missing per session, once bars ``delay_days`` newer than it have come.

    ``stream`` has symbol, session and observed_at (timestamp); bars of a session may come in any batch.
    ``universe`` (session, closed_at, symbols array) is a static table with one row per session: the report
    starts from it, so a session without any bar is reported too. What comes for a session already
    reported goes to out/late. The newest time seen is one stored row, and stored pairs lie by session: a
    batch reads the pairs of the sessions that it reports, once each, and no others.
    """
    pairs, report = "symbol string, session date", "session date, seen int, missing string"
    due_after = F.to_date("closed_at") + F.make_dt_interval(F.lit(1 + delay_days))

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = read_batches(spark, f"{out}/report", report, number).select("session")
        fresh = through_table(batch.groupBy("symbol", "session").agg(F.max("observed_at").alias("observed_at")), "fresh-pairs")
        put_batch(fresh.join(done, "session", "left_semi"), f"{out}/late", number)
        fresh.select("symbol", "session").repartition("session").write.mode("overwrite").partitionBy("session").parquet(f"{out}/seen/batch={number}")
        mark = read_state(spark, f"{out}/mark", "mark int, newest timestamp_ntz", ["mark"], number)
        newest = mark.select("newest").unionByName(fresh.select(F.col("observed_at").cast("timestamp_ntz").alias("newest"))).agg(
            F.max("newest").alias("newest")).first()["newest"]
        put_state(mark, spark.createDataFrame([(0, newest)], mark.schema), f"{out}/mark", ["mark"], number)
        due = through_table(universe.join(done, "session", "left_anti").filter(due_after <= F.lit(newest).cast("timestamp_ntz")), "due-sessions")
        # Sessions are trading days: as many as the calendar has since the last report.
        days = [row["session"] for row in due.select("session").distinct().collect()]
        seen = read_batches(spark, f"{out}/seen", pairs, number + 1).filter(F.col("session").isin(days))
        held = seen.select("session", "symbol").distinct().groupBy("session").agg(F.collect_set("symbol").alias("held"))
        rows = due.join(held, "session", "left").withColumn("held", F.coalesce("held", F.array().cast("array<string>")))
        put_batch(rows.select(
            "session", F.size("held").alias("seen"),
            F.array_join(F.array_sort(F.array_except("symbols", "held")), ",").alias("missing")), f"{out}/report", number)
        put_batch(spark.createDataFrame([(len(days),)], "sessions int"), f"{out}/reads", number)

    return start_batches(stream, handle, checkpoint)


def completeness_report(spark, out: str) -> DataFrame:
    return read_batches(spark, f"{out}/report", "session date, seen int, missing string").drop("batch")


def lifecycle_monitor(
    stream: DataFrame, entity: str, order: Sequence[str], out: str, checkpoint: str,
) -> StreamingQuery:
    """Transition audit per micro-batch, continued from the last state of each entity.

    The stored last state enters a batch as the entity's earliest row. Rows older than it are marked
    late, kept, and do not move the state.
    """
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    state_schema = ", ".join(f"`{c}` {kinds[c]}" for c in (entity, *order, "state"))

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = read_state(spark, f"{out}/state", state_schema, [entity], number)
        touched = batch.select(entity).distinct()
        before = known.join(touched, entity, "left_semi").withColumn("carried", F.lit(True))
        last = before.select(entity, F.struct(*order).alias("last_place"))
        rows = batch.join(last, entity, "left").withColumn(
            "late", F.coalesce(F.struct(*order) <= F.col("last_place"), F.lit(False))).drop("last_place")
        fresh = rows.filter("NOT late").drop("late").withColumn("carried", F.lit(False))
        group = scans.ordered(before.unionByName(fresh), [entity], order)
        seen = scans.running(group, {"previous": ("last", "state")}, exclusive=True).result()
        audited = ledger.with_legality(seen.filter("NOT carried").drop("carried")).withColumn("late", F.lit(False))
        late = rows.filter("late").withColumn("previous", F.lit(None).cast("string")).withColumn("legal", F.lit(False))
        put_batch(audited.unionByName(late.select(*audited.columns)), f"{out}/audit", number)
        newest = F.max_by("state", F.struct(*order)).alias("state")
        places = [F.max(F.struct(*order))[c].alias(c) for c in order]
        changed = before.drop("carried").unionByName(fresh.drop("carried")).groupBy(entity).agg(*places, newest)
        put_state(known, changed, f"{out}/state", [entity], number)

    return start_batches(stream, handle, checkpoint)


POSITION_STATE = (
    "portfolio string, symbol string, fills bigint, quantity double, cost_basis double, realized_pnl double, "
    "oversold_by string"
)
#: The state with closings: what a position was after its last fill of some days, enough to go on from there.
CLOSING_LIST = (
    "array<struct<day: bigint, fills: bigint, quantity: decimal(38,9), cost_basis: double, realized_pnl: double, "
    "oversold_by: string>>"
)
HELD_STATE = f"{POSITION_STATE}, closings {CLOSING_LIST}"
#: Closings kept per position; a fill older than all of them has its position computed anew from its first fill.
CLOSINGS = 12
#: Stored fills lie by bucket of position and by span of some periods of days, and in a file by day.
FILL_BUCKETS, PERIOD_DAYS, SPAN_PERIODS = 4, 91, 4


def _day(stream: DataFrame, column: str) -> Column:
    """Number of the day of a fill's first order column; where that is a number, the number itself."""
    kind = stream.schema[column].dataType.typeName()
    day = F.unix_date(F.to_date(column)) if kind in ("date", "timestamp", "timestamp_ntz") else F.floor(column)
    return F.coalesce(day.cast("bigint"), F.lit(-(1 << 40)))


def running_positions(stream: DataFrame, order: Sequence[str], out: str, checkpoint: str) -> StreamingQuery:
    """Positions after each micro-batch, equal to the batch result over the first content of each fill id.

    A fill id that comes again with the same content changes nothing; with other content it goes to out/conflicts, and the
    one stored first stays (within a batch the least). A position keeps what it was at the end of some days. A batch goes
    on from the last of these before its earliest fill: it reads the fills since then, in the folders of its own buckets and
    later spans and there by day, and closings that a late fill has overtaken are dropped. Average cost makes what a fill adds depend on
    what was held before it, so days after a late fill are computed again; days before it are not read. A closing that is
    oversold stays as it is. Nothing older than the periods named in out/reads is read.

    Whole rows move twice: by id, where they are judged and written, and by position, then without their id; the one that
    a position is oversold by is looked up by its place. A batch's shuffle files go as each step ends.
    """
    names = list(stream.columns)
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", day bigint, clashes boolean, bucket int, span bigint"
    keys = ["portfolio", "symbol"]
    known_ids = SeenIds(f"{out}/ids")
    # 72 bits of a SHA-256, in letters: only contents of one id are compared.
    digest = F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256)
    content = F.base64(F.unhex(F.substring(digest, 1, 18)))

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
        # One shuffle by id, of nothing but the rows, serves repeats, the least content and what is held; what it judges is
        # written once, as the stored fills, from which conflicts, ids and positions are read.
        found = known_ids.find(batch.select(F.col("fill_id").alias("id")), number)
        came = batch.select(*names).repartition("fill_id").withColumn("content", content).distinct()
        least = F.min("content").over(W.partitionBy("fill_id"))
        held = found.read.select(F.col("id").alias("fill_id"), F.col("content").alias("held"))
        first = F.coalesce("held", "least")
        judged = came.withColumn("least", least).join(held, "fill_id", "left").select(
            *names, (F.col("content") != first).alias("clashes"), F.col("held").isNull().alias("new")).filter("clashes OR new")
        bucket = F.pmod(F.xxhash64(*keys), F.lit(FILL_BUCKETS)).cast("int")
        placed = judged.select(*names, _day(stream, order[0]).alias("day"), "clashes", bucket.alias("bucket")).withColumn(
            "span", F.floor(F.col("day") / (PERIOD_DAYS * SPAN_PERIODS)))
        placed.sortWithinPartitions("clashes", "bucket", "span", "day", *order).write.mode("overwrite").partitionBy(
            "clashes", "bucket", "span").option("compression", "zstd").parquet(f"{out}/fills/batch={number}")
        stored = read_batches(spark, f"{out}/fills", schema, number + 1)
        put_batch(stored.filter(F.col("clashes") & (F.col("batch") == number)).select(*names), f"{out}/conflicts", number)
        fills = stored.filter("NOT clashes")
        fresh = fills.filter(F.col("batch") == number)
        known = read_state(spark, f"{out}/state", HELD_STATE, keys, number)
        touched = fresh.groupBy(*keys).agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.min("bucket").alias("bucket"))
        before = F.filter("closings", lambda c: c["day"] < F.col("first_day"))
        opened = through_table(touched.join(known.select(*keys, "closings"), keys, "left").withColumn(
            "closings", F.coalesce(before, F.array().cast(CLOSING_LIST))).withColumn(
            "opening", F.try_element_at("closings", F.lit(-1))), "opened-positions")
        # One row per bucket: the first period that its positions need.
        needs = {row["bucket"]: row["period"] for row in opened.filter("opening.oversold_by IS NULL").groupBy("bucket").agg(
            F.when(F.bool_and(F.col("opening").isNotNull()), F.floor(F.min(F.col("opening.day") + 1) / PERIOD_DAYS)).alias("period")).collect()}
        wanted = F.lit(False)
        for place, period in needs.items():
            since = F.lit(True) if period is None else (F.col("span") >= period // SPAN_PERIODS) & (F.col("day") >= period * PERIOD_DAYS)
            wanted = wanted | ((F.col("bucket") == place) & since)
        earlier = fills.filter((F.col("batch") < number) & wanted)
        going = opened.filter("opening.oversold_by IS NULL").select(*keys, "opening")
        later = F.col("opening").isNull() | (F.col("day") > F.col("opening.day"))
        work = earlier.select(*names, "day").unionByName(fresh.select(*names, "day")).join(going, keys).filter(later)
        last = work.groupBy(*keys).agg(F.max("day").alias("day"))
        # What was held comes first, as one purchase at its cost.
        carried = {"side": F.lit("BUY"), "quantity": F.col("opening.quantity").cast("double"), "fee": F.lit(0.0),
                   "price": F.col("opening.cost_basis") / F.col("opening.quantity").cast("double"), **{k: F.col(k) for k in keys}}
        carries = going.filter("opening.quantity > 0").select(*[carried.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in names])
        parts = list(dict.fromkeys([*keys, *order, "side", "quantity", "price", "fee"]))
        summed = through_table(ledger.positions(work.select(*parts).unionByName(carries.select(*parts)), order, keys, fill_id=None), "summed-positions")
        short = summed.filter("first_short IS NOT NULL").select(*[F.col(k).alias(f"_{k}") for k in keys], "first_short")
        at = reduce(Column.__and__, [F.col(k) == F.col(f"_{k}") for k in keys], F.struct(*order).eqNullSafe(F.col("first_short")))
        oversold = work.join(short, at).groupBy(*keys).agg(F.min(F.struct("fill_id"))["fill_id"].alias("oversold_by"))
        moved = summed.join(oversold, keys, "left").join(last, keys).join(going, keys)
        then = lambda c: F.coalesce(F.col(f"opening.{c}"), F.lit(0))
        moved = moved.select(
            *keys, (F.col("fills") + then("fills") - (then("quantity") > 0).cast("bigint")).alias("fills"), "quantity", "cost_basis",
            (F.col("realized_pnl") + then("realized_pnl")).alias("realized_pnl"), "oversold_by", "day")
        still = opened.filter("opening.oversold_by IS NOT NULL").select(
            *keys, "opening.fills", F.col("opening.quantity").cast("double").alias("quantity"), "opening.cost_basis", "opening.realized_pnl", "opening.oversold_by",
            F.greatest("opening.day", "last_day").alias("day"))
        closing = F.struct("day", "fills", F.col("quantity").cast("decimal(38,9)").alias("quantity"), "cost_basis", "realized_pnl", "oversold_by")
        moved = moved.unionByName(still).join(opened.select(*keys, "closings"), keys).withColumn(
            "closings", F.slice(F.array_append("closings", closing), F.greatest(F.lit(1), F.size("closings") + 2 - CLOSINGS), CLOSINGS))
        put_state(known, moved, f"{out}/state", keys, number)
        known_ids.add(fresh.select(F.col("fill_id").alias("id"), content.alias("content")), number, found)
        reads = [(place, None if period is None else int(period)) for place, period in sorted(needs.items())]
        put_batch(spark.createDataFrame(reads, "bucket int, from_period bigint"), f"{out}/reads", number)

    return start_batches(stream, handle, checkpoint)


def status_counters(stream: DataFrame, out: str, checkpoint: str, width: str = "1 day", watermark: str = "2 days") -> StreamingQuery:
    """Jobs per status and time window; each batch writes the counts it changed."""
    counts = stream.withWatermark("updated_at", watermark).groupBy(F.window("updated_at", width), "status").agg(
        F.count("*").alias("jobs")).select(F.col("window.start").alias("window_start"), "status", "jobs")

    def handle(batch: DataFrame, number: int) -> None:
        put_batch(batch, out, number)

    return counts.writeStream.outputMode("update").foreachBatch(handle).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


COUNTERS = "window_start timestamp, status string, jobs bigint"


def latest_counters(spark, out: str) -> DataFrame:
    """Newest count per window and status over all batches."""
    return read_batches(spark, out, COUNTERS).groupBy("window_start", "status").agg(
        F.max_by("jobs", "batch").alias("jobs"))


def latest_state(spark, out: str, schema, keys: Sequence[str]) -> DataFrame:
    """State after the newest batch; an empty table where no batch ran."""
    newest = read_batches(spark, f"{out}/state", schema).agg(F.max("batch")).first()[0]
    return read_state(spark, f"{out}/state", schema, keys, 0 if newest is None else newest + 1)
