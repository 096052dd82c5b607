"""Registered queries: streaming jobs run over table parts that arrive one after another.

Each query writes a part, drains the stream, writes the next part, restarts from the checkpoint and
drains again; the result equals the batch result over all parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import joined, r, settled
from tidemark.plans import driver_tables as d
from tidemark.plans.prices_queries import with_faults
from tidemark.session import scratch_path
from tidemark.streaming import jobs
from tidemark.streaming.sinks import read_batches


def drain(spark, parts: list[DataFrame], start: Callable[[DataFrame, str, str], object]) -> str:
    """Land the parts in turn and run the job after each; returns the output path."""
    def land(part: DataFrame) -> Callable[[str], None]:
        return lambda landing: part.write.mode("append").option("compression", "zstd").parquet(landing)

    return _drained(spark, [(part.schema, land(part)) for part in parts], start)


def drain_deliveries(spark, rows: DataFrame, parts: int, start: Callable[[DataFrame, str, str], object]) -> str:
    """Like ``drain`` for the rows of the parts 0, 1, ... named in column ``part``: all are written at once, by part, and a
    part's files move to the landing folder in their turn."""
    waiting = scratch_path(spark, "deliveries")
    rows.write.partitionBy("part").option("compression", "zstd").parquet(waiting)
    hadoop = spark._jvm.org.apache.hadoop.fs

    def move(part: int) -> Callable[[str], None]:
        def arrive(landing: str) -> None:
            folder, to = hadoop.Path(f"{waiting}/part={part}"), hadoop.Path(landing)
            files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
            files.mkdirs(to)
            for status in files.listStatus(folder) if files.exists(folder) else ():
                if not files.rename(status.getPath(), hadoop.Path(to, f"{part}-{status.getPath().getName()}")):
                    raise OSError(f"{status.getPath()} did not move to {landing}")
        return arrive

    schema = rows.drop("part").schema
    return _drained(spark, [(schema, move(part)) for part in range(parts)], start)


def _drained(spark, arrivals: list, start: Callable[[DataFrame, str, str], object]) -> str:
    landing, out, checkpoint = (scratch_path(spark, name) for name in ("landing", "stream-out", "stream-checkpoint"))
    for schema, arrive in arrivals:
        arrive(landing)
        stream = spark.readStream.schema(schema).parquet(landing)
        start(stream, out, checkpoint).awaitTermination()
    return out


def streamed_bars(spark, sf):
    bars = with_faults(d.stored_bars(spark, sf))
    parts = [bars.filter("volume % 2 = 0").unionByName(bars.filter("volume % 10 = 0")), bars.filter("volume % 2 = 1 OR volume % 10 = 0")]
    return drain(spark, parts, jobs.ingest_bars), bars.schema


def stream_ingest(spark, sf):
    out, schema = streamed_bars(spark, sf)
    good = read_batches(spark, f"{out}/bars", schema)
    quarantine = f"{jobs_ddl(schema)}, violations array<string>"
    bad = read_batches(spark, f"{out}/quarantine", quarantine)
    return good.select("symbol", "session", "close", F.lit("").alias("violations")).unionByName(
        bad.select("symbol", "session", "close", joined("violations").alias("violations")).distinct())


def jobs_ddl(schema) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def stream_event_log(spark, sf):
    log = d.event_log(spark, sf)
    first = log.filter("delivery = 0 AND n % 3 = 0")
    out = drain(spark, [first, log.filter("NOT (delivery = 0 AND n % 3 = 0)")], jobs.append_event_log)
    schema = f"{jobs_ddl([f for f in log.schema if f.name != 'delivery'])}, payload_hash string"
    stored = read_batches(spark, f"{out}/events", schema).select("event_id", "payload_hash", F.lit("STORED").alias("outcome"))
    clash = read_batches(spark, f"{out}/conflicts", "event_id string, payload_hash string, outcome string")
    return stored.unionByName(clash.select("event_id", "payload_hash", F.lit("CLASH").alias("outcome")))


def stream_completeness(spark, sf):
    bars = d.stored_bars(spark, sf)
    rows = bars.select("symbol", "session", F.col("observed_at").cast("timestamp").alias("observed_at"), "available_to_strategy_at")
    cut = F.lit("1998-07-01 00:00:00").cast("timestamp_ntz")
    # One listed symbol never traded.
    listed = bars.select("symbol").distinct().groupBy().agg(
        F.array_append(F.array_sort(F.collect_set("symbol")), F.lit("Brand-99")).alias("symbols"))
    universe = bars.groupBy("session").agg(F.max("observed_at").alias("closed_at")).withColumn("symbols", listed.scalar())
    # The last ten days of the first part come in two batches: a session is complete only over both.
    split = F.col("available_to_strategy_at") >= cut - F.make_dt_interval(F.lit(10))
    first = (F.col("available_to_strategy_at") < cut) & ~(split & (F.pmod(F.xxhash64("symbol"), F.lit(3)) == 0))
    parts = [rows.filter(first).drop("available_to_strategy_at"), rows.filter(~first).drop("available_to_strategy_at")]
    out = drain(spark, parts, lambda stream, path, checkpoint: jobs.session_completeness(stream, universe, path, checkpoint))
    return jobs.completeness_report(spark, out)


def stream_lifecycle(spark, sf):
    states = d.lifecycle(spark, sf)
    cut = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    out = drain(spark, [states.filter(F.col("ts") < cut), states.filter(F.col("ts") >= cut)],
                lambda stream, path, checkpoint: jobs.lifecycle_monitor(stream, "user_id", ("ts", "event_id"), path, checkpoint))
    return read_batches(
        spark, f"{out}/audit", "user_id bigint, event_id bigint, previous string, state string, legal boolean").drop("batch")


def streamed_fills(spark, sf):
    """Fills in two overlapping parts that come out of order: repeats, late fills, and fills whose price has changed."""
    fills = d.fills(spark, sf)
    cut = F.lit("1998-07-01").cast("date")
    third = F.pmod(F.xxhash64("fill_id"), F.lit(3))
    after, price = F.col("executed_on") >= cut, F.col("price")
    copy = lambda when, part, price: F.when(when, F.struct(F.lit(part).alias("part"), price.alias("price")))
    copies = F.array_compact(F.array(
        copy(after | (third == 0), 0, price), copy((F.col("executed_on") < cut) | (third == 1), 1, price),
        copy(after & (F.col("l_orderkey") % 50 == 0), 1, price + 1)))
    rows = fills.withColumn("copy", F.explode(copies)).select(*[F.col("copy.price") if c == "price" else F.col(c) for c in fills.columns], "copy.part")
    return drain_deliveries(spark, rows, 2, lambda stream, path, checkpoint: jobs.running_positions(stream, d.FILL_ORDER, path, checkpoint)), fills.schema


def stream_positions(spark, sf):
    out, _ = streamed_fills(spark, sf)
    return jobs.latest_state(spark, out, jobs.HELD_STATE, ("portfolio", "symbol")).select(
        "portfolio", "symbol", "fills", r("quantity").alias("quantity"), settled("cost_basis").alias("cost_basis"),
        settled("realized_pnl").alias("realized_pnl"), "oversold_by")


def stream_fill_conflicts(spark, sf):
    """Fills that came again with another price; the positions keep the first."""
    out, schema = streamed_fills(spark, sf)
    return read_batches(spark, f"{out}/conflicts", schema).select("fill_id", r("price").alias("price"))


def stream_counters(spark, sf):
    rows = d.jobs(spark, sf).withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    cut = F.lit("2024-01-15 12:00:00").cast("timestamp")
    out = drain(spark, [rows.filter(F.col("updated_at") < cut), rows.filter(F.col("updated_at") >= cut)], jobs.status_counters)
    return jobs.latest_counters(spark, out).select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"), "status", "jobs")


QUERIES = {
    "stream_bar_ingest": stream_ingest,
    "stream_event_log": stream_event_log,
    "stream_session_completeness": stream_completeness,
    "stream_lifecycle_monitor": stream_lifecycle,
    "stream_running_positions": stream_positions,
    "stream_fill_conflicts": stream_fill_conflicts,
    "stream_status_counters": stream_counters,
}
