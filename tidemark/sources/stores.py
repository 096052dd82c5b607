"""Stored tables: bars by year, frozen snapshots, audited results, the event log, reports."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import quote
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import canonical, scaled, sha, sorted_list_hash
from tidemark.operators.scans import numbered, ordered, running
from tidemark.session import through_table
from tidemark.sources.commits import create_once, is_written, listed, read_commit


class SnapshotConflict(ValueError):
    """A stored identifier was used again with different content."""


# ------------------------------------------------------------------ bars

def write_bars(bars: DataFrame, path: str) -> None:
    """Bars as parquet by year; ranges read later touch only the years they need.

    Stored rows of the years that ``bars`` holds are merged with it and those years replaced, so writing
    the same bars again changes nothing."""
    merged = bars.withColumn("year", F.year("session"))
    years = [row["year"] for row in merged.select("year").distinct().collect()]
    stored = _stored(bars.sparkSession, path)
    if stored is not None:
        merged = merged.unionByName(stored.filter(F.col("year").isin(years)))
    through_table(merged.dropDuplicates(), "merged-bars").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)


def read_bars(spark, path: str, start: str, end: str) -> DataFrame:
    low, high = F.to_date(F.lit(start)), F.to_date(F.lit(end))
    years = F.col("year").between(int(start[:4]), int(end[:4]))
    return spark.read.parquet(path).filter(years & F.col("session").between(low, high)).drop("year")


#: Bits of a day number, counted from DAY_ZERO: some eleven thousand years.
DAY_BITS, DAY_ZERO = 22, 719_528


def covering_range(requests: DataFrame, cached: DataFrame) -> DataFrame:
    """Stored range that answers each request: the exact one, else the narrowest that covers it.

    Both tables hold one row per symbol and range. Nothing pairs requests with ranges: a range that ends on or after a
    request's end shares exactly one prefix of its end's bits with one of the request's (the bits above the highest that
    differs), so both are placed at those prefixes, and at each a running minimum over starts finds the narrowest range that
    starts early enough. A symbol with n ranges and m requests takes (n + m) x DAY_BITS rows at most, in split scans.
    """
    end = lambda c: F.unix_date(c) + F.lit(DAY_ZERO)
    level = F.col("level")
    bit = lambda day: F.call_function("shiftright", day, level)
    levels = F.explode(F.sequence(F.lit(0), F.lit(DAY_BITS - 1))).alias("level")
    width = F.struct(F.datediff("cached_end", "cached_start").alias("days"), "cached_start", "cached_end")
    held = cached.where("cached_end >= cached_start").select("symbol", F.col("cached_start").alias("from"), F.lit(0).alias("asked"), F.lit(None).cast("date").alias("start"),
                                                             F.lit(None).cast("date").alias("end"), width.alias("range"), end("cached_end").alias("day"), levels)
    held = held.where(bit(F.col("day")) % 2 == 1).withColumn("node", bit(F.col("day")))
    wanted = requests.select("symbol", "start", "end").distinct()
    asked = wanted.select("symbol", F.col("start").alias("from"), F.lit(1).alias("asked"), "start", "end",
                          F.lit(None).cast(held.schema["range"].dataType).alias("range"), (end("end") - 1).alias("day"), levels)
    asked = asked.where(bit(F.col("day")) % 2 == 0).withColumn("node", bit(F.col("day")) + 1)
    order = ("from", "asked", "range", "end")
    swept = running(ordered(held.unionByName(asked).drop("day"), ("symbol", "level", "node"), order), {"best": ("min", "range")}).result()
    found = swept.where("asked = 1").groupBy("symbol", "start", "end").agg(F.min("best").alias("best"))
    return requests.join(found, ["symbol", "start", "end"], "left").select(
        "symbol", "start", "end", "best.cached_start", "best.cached_end", F.col("best").isNotNull().alias("covered"))


# ------------------------------------------------------------------ snapshots

def bar_row_text() -> Column:
    return canonical([
        F.col("symbol"), F.col("session"), *[scaled(n) for n in ("open", "high", "low", "close")], F.col("volume"),
        scaled("dividend"), scaled("split_coefficient"),
        F.date_format("available_to_strategy_at", "yyyy-MM-dd HH:mm:ss"), F.col("quality")])


def symbol_digests(bars: DataFrame) -> DataFrame:
    """SHA-256 per symbol over its sorted row hashes (a symbol's rows are bounded by the calendar)."""
    line = F.concat_ws(":", F.col("session").cast("string"), sha(bar_row_text()))
    return bars.groupBy("symbol").agg(sorted_list_hash(line).alias("digest"), F.count("*").alias("rows"))


def snapshot_digest(bars: DataFrame) -> DataFrame:
    """Root hash over the per-symbol hashes: one short text per symbol reaches the last step."""
    return symbol_digests(bars).groupBy().agg(
        sorted_list_hash(F.concat_ws(":", "symbol", "digest")).alias("digest"),
        F.sum("rows").alias("rows"))


def _stored(spark, path: str) -> DataFrame | None:
    """The table at a path, or nothing where none was written yet."""
    try:
        return spark.read.parquet(path)
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def freeze_snapshot(bars: DataFrame, path: str, snapshot_id: str, as_of: str) -> str:
    """Store bars once under an id. The same content again changes nothing; other content is an error.

    Rows go to a folder named by their digest, and the snapshot exists once its commit file does, which is created without
    overwriting: of two writers of one id, one is first and the other finds its content equal or is refused. Rows whose
    commit never came are no snapshot, and a repeated freeze goes on from them."""
    spark = bars.sparkSession
    late = bars.filter(F.col("available_to_strategy_at") > F.lit(as_of).cast("timestamp_ntz"))
    if not late.isEmpty():
        raise ValueError(f"some bars became available only after {as_of}")
    digest = snapshot_digest(bars).first()["digest"]
    commit, content = _snapshot_commit(path, snapshot_id), {"as_of": as_of, "digest": digest, "snapshot_id": snapshot_id}
    known = read_commit(spark, commit)
    if known is None:
        folder = f"{path}/rows/digest={digest}"
        if not is_written(spark, folder):
            bars.write.mode("overwrite").parquet(folder)
        if create_once(spark, commit, content):
            return digest
        known = read_commit(spark, commit)
    if known != content:
        raise SnapshotConflict(f"snapshot {snapshot_id} exists with different inputs")
    return digest


def _snapshot_commit(path: str, snapshot_id: str) -> str:
    return f"{path}/snapshots/{quote(snapshot_id, safe='')}.json"


def read_snapshot(spark: SparkSession, path: str, snapshot_id: str) -> DataFrame:
    """Rows of a frozen snapshot, after their digest was computed again and found to be the committed one."""
    known = read_commit(spark, _snapshot_commit(path, snapshot_id))
    if known is None:
        raise KeyError(f"no snapshot {snapshot_id}")
    rows = spark.read.parquet(f"{path}/rows/digest={known['digest']}")
    found = snapshot_digest(rows).first()["digest"]
    if found != known["digest"]:
        raise SnapshotConflict(f"rows of snapshot {snapshot_id} are not what was frozen")
    return rows


def hashed_results(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Result rows with the SHA-256 of their content columns in name order."""
    content = sorted(c for c in results.columns if c not in keys)
    return results.withColumn("payload_hash", sha(canonical([F.col(c) for c in content])))


def result_conflicts(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Each incoming result against the store: NEW, SAME (no-op) or CONFLICT."""
    known = stored.select(key, F.col("payload_hash").alias("stored_hash"))
    return incoming.join(known, key, "left").withColumn(
        "outcome",
        F.when(F.col("stored_hash").isNull(), "NEW")
        .when(F.col("stored_hash") == F.col("payload_hash"), "SAME").otherwise("CONFLICT")).drop("stored_hash")


def verify_results(stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored rows whose content no longer matches their hash."""
    content = sorted(c for c in stored.columns if c not in (*keys, "payload_hash"))
    return stored.filter(sha(canonical([F.col(c) for c in content])) != F.col("payload_hash"))


# ------------------------------------------------------------------ event log

def with_payload_hash(events: DataFrame) -> DataFrame:
    return events.withColumn("payload_hash", sha(F.col("payload")))


def classify_events(events: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """One row per incoming event id: NEW, SAME or CONFLICT with the store.

    The delivery with the lowest number counts; ``contradicts`` marks ids delivered with different
    payloads. Ids are reduced with map-side combine, so an id delivered very often stays cheap.
    ``events`` has delivery, event_id, payload and the other log columns.
    """
    hashed = with_payload_hash(events)
    first = F.struct("delivery", *[c for c in hashed.columns if c not in ("delivery", "event_id")])
    rows = hashed.groupBy("event_id").agg(
        F.min(first).alias("first"), (F.min("payload_hash") != F.max("payload_hash")).alias("contradicts"),
    ).select("event_id", "first.*", "contradicts")
    if stored is None:
        return rows.withColumn("outcome", F.lit("NEW"))
    known = stored.select("event_id", F.col("payload_hash").alias("stored_hash"))
    return rows.join(known, "event_id", "left").withColumn(
        "outcome",
        F.when(F.col("stored_hash").isNull(), "NEW")
        .when(F.col("stored_hash") == F.col("payload_hash"), "SAME").otherwise("CONFLICT")).drop("stored_hash")


def append_events(events: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Events to append: ids the store does not hold, once each, the first delivery counting."""
    return classify_events(events, stored).filter("outcome = 'NEW'").drop("contradicts", "outcome", "delivery")


def sequenced(events: DataFrame, after: int = 0) -> DataFrame:
    """Log with dense sequence numbers in (occurred_at, event_id) order, going on after a number."""
    return numbered(events, ("occurred_at", "event_id")).withColumn("sequence", F.col("sequence") + F.lit(after).cast("bigint"))


class ConcurrentAppend(RuntimeError):
    """Another writer appended to the log in between; the append can be repeated."""


LOG = "event_id string, occurred_at timestamp_ntz, event_type string, entity_id string, payload string, payload_hash string, sequence bigint"


def _log_commits(spark: SparkSession, path: str) -> list[dict]:
    return [read_commit(spark, f"{path}/commits/{name}") for name in listed(spark, f"{path}/commits")]


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Committed events; an empty table where none were appended."""
    folders = [f"{path}/rows/{commit['folder']}" for commit in _log_commits(spark, path)]
    return spark.read.schema(LOG).parquet(*folders) if folders else spark.createDataFrame([], LOG)


def append_log(events: DataFrame, path: str) -> int:
    """Append events whose ids the log does not hold, numbered on from its last number; returns how many.

    ``events`` has delivery and the columns of the log but payload_hash and sequence. Rows and numbers count once the commit
    file named by the append's own number is created, which only one writer can do: another raises ConcurrentAppend. Without
    new ids nothing is written, so an append that is repeated changes nothing."""
    spark = events.sparkSession
    commits = _log_commits(spark, path)
    last = commits[-1]["last"] if commits else 0
    new = append_events(events, read_log(spark, path))
    folder = uuid4().hex
    columns = [c.split(" ")[0] for c in LOG.split(", ")]
    sequenced(new, last).select(*columns).write.mode("errorifexists").parquet(f"{path}/rows/{folder}")
    found = spark.read.schema(LOG).parquet(f"{path}/rows/{folder}").agg(F.count(F.lit(1)).alias("rows")).first()["rows"]
    if found and not create_once(spark, f"{path}/commits/{len(commits):08d}.json", {"folder": folder, "first": last + 1, "last": last + found}):
        raise ConcurrentAppend(path)
    return found


def entity_events(log: DataFrame, entity_id: str) -> DataFrame:
    return log.filter(F.col("entity_id") == entity_id).orderBy("sequence")


# ------------------------------------------------------------------ reports

def report_lines(metrics: DataFrame) -> DataFrame:
    """One JSON document per row with its fields in name order."""
    return metrics.select(F.to_json(F.struct(*sorted(metrics.columns))).alias("value"))


def write_report(metrics: DataFrame, path: str) -> None:
    report_lines(metrics).write.mode("errorifexists").text(path)


def read_report(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows of a written report; a field that a document lacks is null."""
    return spark.read.text(path).select(F.from_json("value", schema).alias("row")).select("row.*")
