"""Mix sources to target weights by weighted random order; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import through_table

#: Fixed by the query contract: what separates words.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Characters that lower a document's sampling weight.
JUNK = "#%$&*!|<>{}"
#: Rows that one ordered range of keys of a source is expected to hold at most.
BUCKET_ROWS = 4096
#: A table of sources is broadcast up to this many rows (about 100 bytes each).
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """Square of the share of characters that are no junk: above 0 and at most 1."""
    text = F.coalesce(text, F.lit(""))
    kept = (F.length(F.translate(text, JUNK, "")) + 1) / (F.length(text) + 1)
    return kept * kept


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, epochs: float) -> DataFrame:
    """Adds `target` to one row per source (no_source, source_key, source_size, source_rows).

    Weights repeat over the sources in code point order, null last. Capped proportional shares: with sources ordered by
    cap / weight, a source is capped as long as its cap is below its share of what the sources before it left."""
    ordered = Window.orderBy("no_source", "source_key")
    place = F.row_number().over(ordered) - 1
    rows = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                                   (place % len(weights) + 1).cast("int")))
    rows = rows.withColumn("cap", F.col("source_size") * epochs)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "no_source", "source_key")
    before, all_rows = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rows = (rows.withColumn("left_size", F.sum("source_size").over(all_rows) * share
                            - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
            .withColumn("left_weight", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
            .withColumn("open", F.col("cap") * F.col("left_weight") > F.col("weight") * F.col("left_size")))
    # The first open source fixes the level for all open ones.
    level = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), "no_source", "source_key",
                                                 "left_size", "left_weight"))).over(all_rows)
    rows = rows.withColumn("level", level)
    return rows.withColumn("target", F.when(
        F.col("open"), F.col("weight") * F.col("level.left_size") / F.col("level.left_weight")).otherwise(F.col("cap")))


def mixed_sizes(docs: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), share: float = 1.5, epochs: float = 2.0,
                whole: bool = False, carry: bool = False, seed: str = "mix") -> DataFrame:
    """One row per row of `docs`: doc_id, size, source_size, target, taken; with `carry` also `row`, all its columns.

    Every document gets the key -ln(u) / quality with u from a hash of its id (Efraimidis and Spirakis), so a source in key
    order is a weighted sample without replacement. A source with target t and size s is taken floor(t / s) times whole;
    the documents first in key order fill the rest. The last one is taken in part, or, with `whole`, once more only if
    that leaves the sum nearer to the target. Repeated ids follow each other, larger texts last; equal rows are interchangeable.
    Null sources form the last source, null texts have size 0 and are never taken. An empty table gives no row.

    No task orders a whole source: key ranges of at most about BUCKET_ROWS rows are summed first, and only rows within one range
    are ordered together. Ids, sizes and sources move, texts only with `carry`."""
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10)
         .cast("double") + 0.5) / float(1 << 52)
    carried = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    narrow = docs.select(
        F.col("doc_id"), F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source_key"),
        word_count(F.col("text")).alias("size"), (-F.log(u) / quality_weight(F.col("text"))).alias("key"),
        *carried)
    narrow = through_table(narrow, "mix-sizes")
    source = ["no_source", "source_key"]
    sizes = narrow.groupBy(source).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    targets = source_targets(sizes, weights, share, epochs).select(
        *source, "source_size", "source_rows", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).alias("full"))
    targets = through_table(targets.withColumn("rest", F.round(F.col("target") - F.col("full") * F.col("source_size")).cast("long")),
                            "mix-targets")
    known = F.broadcast(targets) if targets.count() <= BROADCAST_SOURCES else targets
    # log2 of an exponential key has a density of at most ln 2 / e = 0.26, and a quality only shifts it: whatever the
    # qualities of a source, no range holds more of it than that share of the range's width.
    keyed = narrow.join(known, source).withColumn(
        "bucket", F.floor(F.log2("key") * F.ceil(0.26 * F.col("source_rows") / BUCKET_ROWS)))
    buckets = keyed.groupBy(*source, "bucket").agg(F.sum("size").alias("bucket_size"))
    before = Window.partitionBy(source).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = through_table(buckets.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
                            .drop("bucket_size"), "mix-buckets")
    placed = keyed.join(buckets, [*source, "bucket"])
    inside = Window.partitionBy(*source, "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("rest") - F.col("bucket_start") - F.coalesce(F.sum("size").over(inside), F.lit(0))
    part = F.least(F.greatest(room, F.lit(0)), F.col("size"))
    if whole:
        part = F.when(2 * room >= F.col("size"), F.col("size")).otherwise(0)
    return placed.select("doc_id", "size", "source_size", "target",
                         (F.col("full") * F.col("size") + part).cast("long").alias("taken"),
                         *(["row"] if carry else []))


def mixed_documents(docs: DataFrame, **parameters: object) -> DataFrame:
    """The mix itself: every row of `docs` as often as the mix takes it whole, with its own columns."""
    rows = mixed_sizes(docs, whole=True, carry=True, **parameters).where("taken > 0")
    copies = rows.select("row", F.explode(F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int"))))
    return copies.select("row.*")
