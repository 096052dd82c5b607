"""Running aggregates over ordered groups of any size.

A window puts a whole group into one task. That is right while groups are small, so the size of the
largest group is checked first. Beyond the bound the rows are range-partitioned by (keys, order): a
hot group then spans many tasks. Each task scans its own stretch, the stretch totals (one row per
group and stretch) are scanned, and what came before a stretch is added to its rows. Sums are taken
over integers and decimals only, so adding in stretches gives the same values as adding in a row;
floating point columns are refused.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.session import materialize

MAX_GROUP_ROWS = 4_000_000
#: Rows of a whole table that one task numbers; more are numbered in stretches of half as many.
NUMBERED_ROWS = 500_000
#: Groups are counted by this many hashes of their keys, so that counting moves no keys.
SLOTS = 1 << 16
BUCKET = "_stretch"
KINDS = ("sum", "max", "min", "last")


@dataclass(frozen=True)
class Ordered:
    """Rows with their grouping keys, total order, and whether groups are split into stretches."""

    rows: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    split: bool

    def with_rows(self, rows: DataFrame) -> Ordered:
        """Same grouping and order on derived rows; they must keep the stretch column."""
        return replace(self, rows=rows)

    def result(self) -> DataFrame:
        return self.rows.drop(BUCKET)


def ordered(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], max_group_rows: int = MAX_GROUP_ROWS,
) -> Ordered:
    """Prepare rows for scans. ``order`` must be total inside a group.

    Runs one counting job with map-side combine; only oversized inputs are written and split. Groups that share a slot
    count together, which can only split a table whose groups come near the bound: results are the same.
    """
    slot = F.pmod(F.xxhash64(*keys), F.lit(SLOTS))
    size = rows.groupBy(slot.alias("slot")).agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    largest, total = (size[0] or 0), (size[1] or 0)
    if largest <= max_group_rows:
        return Ordered(rows, tuple(keys), tuple(order), False)
    stretches = max(2, ceil(2 * total / max_group_rows))
    ranged = rows.repartitionByRange(stretches, *keys, *order).withColumn(BUCKET, F.spark_partition_id())
    return Ordered(materialize(ranged), tuple(keys), tuple(order), True)


def _window_value(kind: str, value: Column, window) -> Column:
    if kind == "last":
        return F.last(value, ignorenulls=True).over(window)
    return getattr(F, kind)(value).over(window)


def running(
    group: Ordered, columns: Mapping[str, tuple[str, str | Column]], exclusive: bool = False,
    reverse: bool = False,
) -> Ordered:
    """Adds running sum, max, min or last non-null value per group, up to and with each row.

    ``exclusive`` leaves the row itself out; ``reverse`` runs from the end of the group.
    """
    turn = (lambda c: F.col(c).desc()) if reverse else (lambda c: F.col(c).asc())
    order = [turn(c) for c in group.order]
    end = -1 if exclusive else 0
    values = {name: (kind, F.col(c) if isinstance(c, str) else c) for name, (kind, c) in columns.items()}
    for name, (kind, value) in values.items():
        if kind == "sum" and group.rows.select(value).schema[0].dataType.typeName() in ("double", "float"):
            raise TypeError(f"running sum {name} needs an exact type; cast it to a decimal")
    if not group.split:
        window = W.partitionBy(*group.keys).orderBy(*order).rowsBetween(W.unboundedPreceding, end)
        return group.with_rows(group.rows.select(
            "*", *[_window_value(kind, value, window).alias(name) for name, (kind, value) in values.items()]))

    keys = [*group.keys, BUCKET]
    local = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, end)
    scanned = group.rows.select("*", *[
        _window_value(kind, value, local).alias(f"_in_{name}") for name, (kind, value) in values.items()])
    position = F.struct(*group.order)
    pick = F.min_by if reverse else F.max_by
    totals = group.rows.groupBy(*keys).agg(*[
        (pick(value, F.when(value.isNotNull(), position)) if kind == "last" else getattr(F, kind)(value)).alias(f"_all_{name}")
        for name, (kind, value) in values.items()])
    before = W.partitionBy(*group.keys).orderBy(turn(BUCKET)).rowsBetween(W.unboundedPreceding, -1)
    # Rows of a null key are a group as in a window, so keys meet null-safely.
    carried = totals.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *[
        _window_value(kind, F.col(f"_all_{name}"), before).alias(f"_before_{name}")
        for name, (kind, _) in values.items()])
    joined = scanned.join(carried, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    return group.with_rows(joined.select(*group.rows.columns, *[
        _combine(kind, F.col(f"_before_{name}"), F.col(f"_in_{name}")).alias(name)
        for name, (kind, _) in values.items()]))


def _combine(kind: str, before: Column, inside: Column) -> Column:
    if kind == "last":
        return F.coalesce(inside, before)
    if kind == "sum":
        return F.when(before.isNull(), inside).when(inside.isNull(), before).otherwise(before + inside)
    return (F.greatest if kind == "max" else F.least)(before, inside)


def numbered(rows: DataFrame, order: Sequence[str], name: str = "sequence", max_group_rows: int = NUMBERED_ROWS) -> DataFrame:
    """Dense numbers 1, 2, ... over the whole table in the given total order.

    A larger table is range-partitioned once into sorted stretches and stored; a row's number is its place in its stretch after
    the rows of earlier stretches, whose counts (one row per stretch) are broadcast."""
    total = rows.count()
    if total <= max_group_rows:
        whole = Ordered(rows.withColumn("_all", F.lit(0)), ("_all",), tuple(order), False)
        return running(whole, {name: ("sum", F.lit(1).cast("bigint"))}).result().drop("_all")
    ranged = rows.repartitionByRange(ceil(2 * total / max_group_rows), *order).sortWithinPartitions(*order)
    # The id holds the stretch above 33 bits and the place in it below.
    placed = materialize(ranged.withColumn("_id", F.monotonically_increasing_id())).withColumn(BUCKET, F.shiftright("_id", 33))
    earlier = W.orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)
    counts = placed.groupBy(BUCKET).agg(F.count("*").alias("_rows")).select(
        BUCKET, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(F.broadcast(counts), BUCKET).select(*rows.columns, (F.col("_before") + place).alias(name))
