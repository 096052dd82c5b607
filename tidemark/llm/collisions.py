"""Nearest neighbours by collision counting: windows around a query in sorted projections, widened until its best are settled."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.llm.embeddings import rotation, usable
from tidemark.session import through_table

NEAREST = 20
#: Sorted arrays of a block, fewer than 256; half a window per unit of the search radius; deviations by which the collisions of a vector at
#: exactly the radius may fall short of their mean. Each array holds such a vector with probability `HELD`.
ARRAYS, HALF_WINDOW, DEVIATIONS = 128, 1.0, 3.0
HELD = math.erf(HALF_WINDOW / math.sqrt(2))
COLLISIONS = math.floor(ARRAYS * HELD - DEVIATIONS * math.sqrt(ARRAYS * HELD * (1 - HELD)))
#: Virtual rehashing: the first radius between unit vectors, and its growth.
FIRST_RADIUS, GROWTH = 0.3, 3.0
#: Rows of a block on average, queries handled at once in it.
BLOCK_ROWS, QUERY_ROWS = 2048, 1024
#: Rows of the sample that gives every query a first bound, and its most bytes.
SAMPLE_ROWS, SAMPLE_BYTES = 2048, 16 << 20
#: Bytes of the queries that every task holds at once; more queries take more passes.
PASS_BYTES = 64 << 20


def inner_products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added dimension by dimension: equal rows have equal products wherever they lie."""
    return np.add.accumulate(rows * query, axis=1)[:, -1]


class Block:
    """Some vectors of one length with their sorted projections.

    With M the largest length, x becomes (x, sqrt(M^2 - |x|^2)) / M and q becomes (q, 0) / |q|: two unit vectors at squared
    distance 2 - 2 qx / (|q| M), so that the nearest have the largest inner products."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        self.ids, self.rows = ids, rows
        length = np.sqrt((rows * rows).sum(axis=1))
        self.most = float(length.max())
        self.turn = rotation(rows.shape[1] + 1, ARRAYS, 41) * math.sqrt(rows.shape[1] + 1)
        rest = np.sqrt(np.maximum(0.0, 1 - (length / self.most) ** 2))
        places = (np.column_stack([rows / self.most, rest]) @ self.turn).T
        order = np.argsort(places, axis=1, kind="stable")
        self.sorted = np.take_along_axis(places, order, axis=1)
        self.rank = np.empty(places.shape, np.uint16 if len(rows) < 1 << 16 else np.uint32)
        np.put_along_axis(self.rank, order, np.arange(len(rows), dtype=self.rank.dtype)[None, :], axis=1)

    def radius_of(self, score: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Distance at which a query meets this score; below 0 where no vector of the block can reach it."""
        squared = 2 - 2 * score / (length * self.most)
        return np.where(squared < -1e-9, -1.0, np.sqrt(np.clip(squared, 0, 4)) + 1e-9)

    def windows(self, at: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and length, in ranks, of the window of each array and query."""
        low, high = at - HALF_WINDOW * radius, at + HALF_WINDOW * radius
        start = np.stack([np.searchsorted(s, x) for s, x in zip(self.sorted, low, strict=True)])
        end = np.stack([np.searchsorted(s, x, side="right") for s, x in zip(self.sorted, high, strict=True)])
        return start.astype(self.rank.dtype), (end - start).astype(self.rank.dtype)

    def nearest(self, queries: np.ndarray, floors: np.ndarray, count: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, ids, scores) of the block's `count` best rows per query that reach the query's floor.

        A radius grows from FIRST_RADIUS. At each radius, rows within the window in COLLISIONS arrays or more are verified
        by their inner product; a query is settled once the radius covers its `count`-th best score so far, or its floor."""
        length = np.sqrt((queries * queries).sum(axis=1))
        at = ((queries / length[:, None]) @ self.turn[:-1]).T
        bound = floors.copy()
        seen = np.zeros((len(queries), len(self.rows)), bool)
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        moved, inside = np.empty_like(self.rank), np.empty(self.rank.shape, bool)
        radius, open_ = FIRST_RADIUS, np.arange(len(queries))
        while len(open_):
            target = self.radius_of(bound[open_], length[open_])
            open_, target = open_[target >= 0], target[target >= 0]
            reach = np.minimum(radius, target)
            start, width = self.windows(at[:, open_], reach)
            for k, query in enumerate(open_):
                if reach[k] >= 2:
                    fresh = ~seen[query]
                else:
                    # Ranks below the window wrap around and are too large as well.
                    np.subtract(self.rank, start[:, k, None], out=moved)
                    np.less(moved, width[:, k, None], out=inside)
                    held = np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint8)
                    fresh = (held >= COLLISIONS) & ~seen[query]
                new = np.flatnonzero(fresh)
                seen[query] |= fresh
                rough = self.rows[new] @ queries[query]
                low = max(bound[query], np.partition(rough, -count)[-count]) if len(new) > count else bound[query]
                new = new[rough >= low - 1e-9 * length[query] * self.most]
                if not len(new):
                    continue
                scores = inner_products(self.rows[new], queries[query])
                ids, scores = np.concatenate([found[query][0], self.ids[new]]), np.concatenate([found[query][1], scores])
                best = np.lexsort((ids, -scores))[:count]
                found[query] = ids[best], scores[best]
                if len(best) == count:
                    bound[query] = max(bound[query], scores[best[-1]])
            open_ = open_[self.radius_of(bound[open_], length[open_]) > radius]
            radius *= GROWTH
        for query, (ids, scores) in enumerate(found):
            if len(ids):
                yield query, ids, scores


def _stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.float64)


def floors(queries: DataFrame, sample: dict[int, np.ndarray], count: int) -> DataFrame:
    """`queries` with `floor`: the `count`-th best score in the sample, which no better row lies below."""
    shared = queries.sparkSession.sparkContext.broadcast(sample)

    def bound(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            floor = np.full(len(vectors), -np.inf)
            size = vectors.map(len).to_numpy()
            for dim, rows in shared.value.items():
                of_size = np.flatnonzero(size == dim)
                for start in range(0, len(of_size) if len(rows) >= count else 0, QUERY_ROWS):
                    at = of_size[start:start + QUERY_ROWS]
                    asked = _stacked(vectors.iloc[at])
                    slack = 1e-9 * np.sqrt((asked * asked).sum(1)) * np.sqrt((rows * rows).sum(1).max())
                    floor[at] = np.partition(asked @ rows.T, -count, axis=1)[:, -count] - slack
            yield pd.Series(floor)

    return queries.withColumn("floor", F.pandas_udf(bound, "double")("vector"))


def nearest(vectors: DataFrame, asked: Column, count: int = NEAREST, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The `count` rows of `vectors` (vec_id, embedding) with the largest inner products for each row for which `asked` holds,
    but the row itself: query_id, rank (from 1), vec_id, score; fewer where there are fewer. Ties go to the smaller vec_id.

    Every row lies in one block, dealt by hash, and every block is searched for all queries (see Block), which tasks hold in
    passes of `pass_bytes`. Found rows may miss a neighbour with small probability, and their scores are exact in double
    precision on the vectors as they are. A sample of at most SAMPLE_ROWS rows gives each query a bound to start from and
    leaves no row out. Equal vectors are asked once, and as candidates only the `count` + 1 smallest ids of a vector are kept:
    no other can be among the best.

    Null ids, and vectors that are null, zero or hold null or non-finite components, take no part; vectors of another length
    than the query's are no candidates. A repeated id stands for the least of its vectors. An empty table gives no row, and
    other columns play no part."""
    spark = vectors.sparkSession
    best = count + 1
    rows = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(asked, F.lit(False)).alias("asked"), F.col("embedding").alias("vector"))
    # -0.0 and 0.0 are one value.
    rows = rows.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0).cast("byte")))
    rows = rows.groupBy("vec_id").agg(F.min("vector").alias("vector"), F.max("asked").alias("asked"))
    rows = through_table(rows.withColumns({"k1": F.xxhash64("vector"), "k2": F.xxhash64(F.lit("second"), "vector")}), "searched-vectors")
    total = rows.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], schema)

    longest = rows.agg(F.max(F.size("vector"))).first()[0]
    share = min(1.0, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * longest)) / total)
    drawn = F.pmod(F.xxhash64(F.lit("sample"), "vec_id"), F.lit(1 << 30)) < int(share * (1 << 30))
    sample: dict[int, list] = {}
    for row in rows.where(drawn).select("vector").collect():
        sample.setdefault(len(row["vector"]), []).append(row["vector"])
    sample = {dim: np.array(found, np.float64) for dim, found in sample.items()}
    queries = rows.where("asked").groupBy("k1", "k2").agg(F.first("vector").alias("vector"))
    passes = max(1, math.ceil(rows.where("asked").count() * 8 * longest / pass_bytes))
    queries = through_table(floors(queries, sample, best).withColumn("turn", F.pmod(F.xxhash64("k1"), F.lit(passes)).cast("int")), "vector-queries", ("turn",))

    blocks = math.ceil(total / BLOCK_ROWS)
    copies = F.row_number().over(W.partitionBy("k1", "k2").orderBy("vec_id"))
    index = rows.withColumn("copy", copies).where(F.col("copy") <= best).select(
        "vec_id", "vector", F.size("vector").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
    index = index if passes == 1 else through_table(index, "vector-blocks")

    def searched(turn: int) -> DataFrame:
        held: dict[int, tuple[list, list, list]] = {}
        # At most about pass_bytes of vectors.
        for row in queries.where(F.col("turn") == turn).select("k1", "k2", "vector", "floor").collect():
            keys, rows_, low = held.setdefault(len(row["vector"]), ([], [], []))
            keys.append((row["k1"], row["k2"]))
            rows_.append(row["vector"])
            low.append(row["floor"])
        shared = spark.sparkContext.broadcast({dim: (np.array(k, np.int64), np.array(v, np.float64), np.array(f)) for dim, (k, v, f) in held.items()})

        def search(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            out = {"k1": [], "k2": [], "block": [], "cost": [], "vec_id": []}
            if key[0] in shared.value:
                keys, asked, low = shared.value[key[0]]
                block = Block(frame["vec_id"].to_numpy(), _stacked(frame["vector"]))
                for start in range(0, len(asked), QUERY_ROWS):
                    end = start + QUERY_ROWS
                    for query, ids, scores in block.nearest(asked[start:end], low[start:end], best):
                        out["k1"].append(keys[start + query, 0])
                        out["k2"].append(keys[start + query, 1])
                        out["block"].append(key[1])
                        out["cost"].append(-scores)
                        out["vec_id"].append(ids)
            return pd.DataFrame({name: pd.Series(values, dtype=object if name in ("cost", "vec_id") else np.int64) for name, values in out.items()})

        found = index.groupBy("dim", "block").applyInPandas(search, "k1 long, k2 long, block int, cost array<double>, vec_id array<long>")
        return found.select("k1", "k2", "block", F.arrays_zip("cost", "vec_id").alias("found"))

    parts = [searched(turn) for turn in range(passes)]
    found = parts[0] if passes == 1 else through_table(parts[0], "found-vectors")
    for part in parts[1:]:
        found = found.unionByName(through_table(part, "found-vectors"))
    # Two steps, so that no group holds more lists than the root of the number of blocks.
    merged = F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, best).alias("found")
    found = found.groupBy("k1", "k2", F.pmod("block", F.lit(math.ceil(math.sqrt(blocks)))).alias("share")).agg(merged).groupBy("k1", "k2").agg(merged)
    named = rows.where("asked").select(F.col("vec_id").alias("query_id"), "k1", "k2").join(found, ["k1", "k2"])
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, count)
    named = named.select("query_id", F.posexplode(others).alias("place", "one"))
    return named.select("query_id", (F.col("place") + 1).alias("rank"), F.col("one.vec_id").alias("vec_id"), (-F.col("one.cost")).alias("score"))
