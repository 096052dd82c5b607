"""Consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import through_table

#: Virtual nodes per shard.
VIRTUAL_NODES = 128


def position(text: Column) -> Column:
    """Place on the ring: 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def ring(shards: Sequence[int], virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """(position, shard) in clockwise order; a shard's points don't depend on which others there are."""
    return sorted((int(hashlib.md5(f"shard {s} node {v}".encode()).hexdigest()[:13], 16), s)
                  for s in shards for v in range(virtual_nodes))


def spill_clockwise(loads: Sequence[int], owners: Sequence[int], capacity: dict[int, int]) -> list[tuple[int, int, int, int]]:
    """(arc, start, end, shard): which rows of each arc go where.

    In turns, every arc offers what it still holds to the next point clockwise; a shard takes, arc by arc, until it is
    full. So a shard fills with its own arcs first and only what overflows moves on."""
    room, held = dict(capacity), list(loads)
    placed, start = [], [0] * len(loads)
    for step in range(len(loads)):
        if not any(held):
            break
        for arc in range(len(loads)):
            shard = owners[(arc + step) % len(owners)]
            if take := min(held[arc], room[shard]):
                placed.append((arc, start[arc], start[arc] + take, shard))
                start[arc] += take
                held[arc] -= take
                room[shard] -= take
    return placed


def row_capacity(total: int, shards: Sequence[int]) -> dict[int, int]:
    """Capacities that sum to `total` and differ by one at most."""
    return {s: total // len(shards) + (k < total % len(shards)) for k, s in enumerate(sorted(shards))}


def shard_rows(docs: DataFrame, shards: Sequence[int], virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """One row per row of `docs`: doc_id, size, text_crc32, shard, slot (gapless from 0 in its shard).

    A row's place on the ring is the hash of its id and text checksum; its shard is the first one clockwise that still has
    room, where the rooms differ by one row at most. Rows of an arc overflow in order of place, id, checksum, size. Equal
    rows are counted, not moved, so one repeated row that holds a third of the table is no hot key: its run of ranks is cut
    into shards by arithmetic. Null texts have size 8 and checksum 0; null ids are placed like the empty id. An empty table
    gives no row.

    The driver sees one count per virtual node, len(shards) * virtual_nodes numbers, whatever the table holds."""
    points = ring(shards, virtual_nodes)
    places, owners = [p for p, _ in points], [s for _, s in points]
    edges = np.array(places)

    @F.pandas_udf("int")
    def arc_of(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, at.to_numpy(), side="left") % len(edges))

    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    counted = narrow.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    at = position(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32").cast("string")))
    counted = through_table(counted.withColumn("at", at).withColumn("arc", arc_of("at")), "shard-rows")
    loads = [0] * len(points)
    for row in counted.groupBy("arc").agg(F.sum("copies").alias("n")).collect():
        loads[row["arc"]] = row["n"]
    pieces, slots = [], dict.fromkeys(shards, 0)
    for arc, start, end, shard in spill_clockwise(loads, owners, row_capacity(sum(loads), shards)):
        pieces.append((arc, start, end, shard, slots[shard] - start))
        slots[shard] += end - start
    spark = docs.sparkSession
    table = spark.createDataFrame(pieces, "arc int, piece_start long, piece_end long, shard int, slot_shift long")
    before = Window.partitionBy("arc").orderBy("at", "doc_id", "text_crc32", "size").rowsBetween(
        Window.unboundedPreceding, -1)
    ranked = counted.withColumn("rank", F.coalesce(F.sum("copies").over(before), F.lit(0)))
    # At most len(shards) pieces an arc; the table has about as many rows as the ring has points.
    cut = ranked.join(F.broadcast(table), "arc").withColumn("first", F.greatest("rank", "piece_start")).withColumn(
        "last", F.least(F.col("rank") + F.col("copies"), "piece_end") - 1).where("first <= last")
    return cut.select("doc_id", "size", "text_crc32", "shard", F.explode(F.sequence("first", "last")).alias("rank"),
                      "slot_shift").select("doc_id", "size", "text_crc32", "shard",
                                           (F.col("rank") + F.col("slot_shift")).alias("slot"))


def moved_share(points: Sequence[tuple[int, int]], grown: Sequence[tuple[int, int]], samples: int = 100_000) -> float:
    """Share of the ring whose first shard changes between two rings, overflow aside."""
    def owner(of: Sequence[tuple[int, int]], at: int) -> int:
        return of[bisect.bisect_left(of, (at, -1)) % len(of)][1]
    step = (1 << 52) // samples
    return sum(owner(points, k * step) != owner(grown, k * step) for k in range(samples)) / samples
