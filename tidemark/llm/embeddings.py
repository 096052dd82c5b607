"""Near-duplicate embeddings: randomly rotated binary codes with correction factors decide which pairs are recomputed."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.graph import components
from tidemark.session import through_table

THRESHOLD = 0.9
#: Bits of a code, and deviations of the estimate that count as its confidence bound.
CODE_BITS = 256
DEVIATIONS = 4.0
#: Chance that a pair at the threshold meets in some table, and rows of an average bucket.
RECALL = 0.998
BUCKET_ROWS = 2048
#: Larger buckets are compared block against block; rows that a task's group holds on average.
BLOCK_ROWS = 4096
GROUP_ROWS = 16_384
#: Large buckets are found from one row in so many; only their cutting depends on it.
SIZE_SHARE = 16
#: Large buckets up to which their table (30 bytes a row) is broadcast.
BROADCAST_ROWS = 200_000
#: Simulated pairs behind the tables of a dimension.
SIMULATED = 20_000


def rotation(dim: int, columns: int, seed: int) -> np.ndarray:
    """dim x columns, made of random rotations side by side."""
    rng = np.random.default_rng([seed, dim])
    parts = [np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(-(-columns // dim))]
    return np.concatenate(parts, axis=1)[:, :columns]


@functools.lru_cache(maxsize=256)
def corner_agreement(dim: int, width: int, threshold: float) -> float:
    """Chance that two vectors at the threshold have the same corner (largest of `width` rotated coordinates and its
    sign), from simulated pairs and less two standard errors."""
    rng, hits, part = np.random.default_rng([5, dim, width]), 0, 1000
    row = np.arange(part)
    for _ in range(SIMULATED // part):
        first, side = (unit_rows(rng.normal(size=(part, dim))) for _ in range(2))
        side -= (side * first).sum(1)[:, None] * first
        side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-12)
        second = threshold * first + math.sqrt(1 - threshold ** 2) * side
        a, b = np.abs(first[:, :width]).argmax(1), np.abs(second[:, :width]).argmax(1)
        hits += int(((a == b) & (first[row, a] * second[row, b] > 0)).sum())
    share = hits / SIMULATED
    return min(0.999, max(0.05, share - 2 * math.sqrt(share * (1 - share) / SIMULATED)))


@functools.lru_cache(maxsize=256)
def table_shape(rows: int, dim: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int, int]:
    """(coordinates per corner, corners per key, tables): buckets keep their size as rows grow, the tables follow from the
    wanted recall, and of the ways to get that many buckets the one with fewest tables is taken."""
    cells = rows / BUCKET_ROWS
    if cells <= 1:
        return 1, 0, 1
    ways = []
    for corners in range(1, 9):
        width = max(1, math.ceil(cells ** (1 / corners) / 2))
        if width <= min(dim, 256) or corners == 8:
            width = min(width, dim, 256)
            both = corner_agreement(min(dim, 256), width, threshold) ** corners
            ways.append((math.ceil(math.log(1 - recall) / math.log(1 - both)), width, corners))
    tables, width, corners = min(ways)
    return width, corners, tables


def bucket_cells(unit: np.ndarray, spin: np.ndarray | None, shape: tuple[int, int, int]) -> np.ndarray:
    """One bucket per row and table, as a number that names its table and the dimension too."""
    width, corners, tables = shape
    keys = np.zeros((len(unit), tables), np.int64)
    if corners:
        turned = (unit @ spin).reshape(len(unit), tables, corners, width)
        at = np.abs(turned).argmax(3)
        positive = np.take_along_axis(turned, at[..., None], 3)[..., 0] >= 0
        keys = (2 * at + positive) @ ((2 * width) ** np.arange(corners, dtype=np.int64))
    return (keys * tables + np.arange(tables)) ^ _dimension_mark(unit.shape[1])


def _dimension_mark(dim: int) -> int:
    return (dim & 0x1FFF) << 50


def unit_rows(raw: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision; scaled first, so that no square over- or underflows."""
    raw = raw.astype(np.float64)
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


class Codes:
    """Sign codes of rotated unit vectors. The inner product of a code with a rotated vector, divided by the stored
    correction factor (code times own vector), estimates the inner product of the vectors without bias; its deviation is
    sqrt((1 - f^2) / f^2 / (D - 1))."""

    def __init__(self, unit: np.ndarray, turn: np.ndarray) -> None:
        self.rotated = (unit @ turn).astype(np.float32)
        self._set(self.rotated >= 0, None)

    @classmethod
    def stored(cls, unit: np.ndarray, turn: np.ndarray, packed: pd.Series, factor: np.ndarray) -> Codes:
        """The same from packed codes and their factors."""
        codes = cls.__new__(cls)
        codes.rotated = (unit @ turn).astype(np.float32)
        bits = np.frombuffer(b"".join(packed), np.uint8).reshape(len(unit), -1)
        codes._set(np.unpackbits(bits, axis=1, count=turn.shape[1]).astype(bool), factor)
        return codes

    def _set(self, positive: np.ndarray, factor: np.ndarray | None) -> None:
        size = positive.shape[1]
        self.signs = np.where(positive, np.float32(1 / math.sqrt(size)), np.float32(-1 / math.sqrt(size)))
        self.factor = np.maximum((self.signs * self.rotated).sum(1), 1e-6) if factor is None else factor
        self.bound = DEVIATIONS * np.sqrt((1 - np.minimum(self.factor ** 2, 1)) / self.factor ** 2 / (size - 1))

    def packed(self) -> list[bytes]:
        return [row.tobytes() for row in np.packbits(self.signs > 0, axis=1)]

    def may_reach(self, other: Codes, threshold: float, rows: slice = slice(None)) -> np.ndarray:
        estimate = self.signs[rows] @ other.rotated.T / self.factor[rows, None]
        return estimate + self.bound[rows, None] >= threshold


def code_turn(dim: int, size: int = CODE_BITS) -> np.ndarray:
    """The first `dim` rows of a rotation of `size` dimensions: shorter vectors are padded with zeros."""
    size = max(size, dim)
    return np.linalg.qr(np.random.default_rng([29, dim, size]).normal(size=(size, size)))[0][:dim]


def most_differing(size: int, threshold: float) -> int:
    """Bits in which the codes of two vectors at the threshold may differ: expected ones and DEVIATIONS deviations."""
    share = math.acos(threshold) / math.pi
    return math.floor(size * share + DEVIATIONS * math.sqrt(size * share * (1 - share)))


def close_members(words: np.ndarray, own: np.ndarray, cross: bool, most: int) -> np.ndarray:
    """Rows whose code differs from another row's (of the other block, if `cross`) in at most `most` bits."""
    close = np.zeros(len(words), bool)
    for start in range(0, len(words), 256):
        differing = np.zeros((min(256, len(words) - start), len(words)), np.uint16)
        for word in range(words.shape[1]):
            differing += np.bitwise_count(words[start:start + 256, None, word] ^ words[None, :, word])
        near = differing <= most
        rows = np.arange(len(near))
        near[rows, start + rows] = False
        if cross:
            near &= own[start:start + 256, None] != own[None, :]
        close[start:start + 256] |= near.any(1)
        close |= near.any(0)
    return close


def joined_roots(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest index that each index reaches once the links x-y are added to the components `root`."""
    while True:
        a, b = root[x], root[y]
        apart = a != b
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (root[root] != root).any():
            root = root[root]


def usable(vector: F.Column) -> F.Column:
    """Not null, not zero, no null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per row of `vectors` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Links join vectors of equal length with cosine >= threshold in double precision. Equal vectors are one row with a
    count until the end. Every vector's code, its correction factor and its buckets, one per table, are computed once and
    stored; a bucket is named by the largest of a few rotated coordinates, several times. Only codes (32 bytes and a
    number) move to the buckets, where the bits in which two codes differ decide whether the vectors may be near. Vectors
    with such a partner are fetched once per bucket; the unbiased estimate from the stored code and factor rejects pairs
    whose upper bound is below the threshold, and all others are recomputed, so none below it is linked. A pair counts in
    the first table in which it meets. Buckets give a count per vector and one edge to the smallest member of its local
    component, never the pairs. Large buckets are cut into blocks and each pair of blocks is a task's work.

    Vectors that are null, zero or hold null or non-finite components link with nothing; a repeated vec_id is a vector of
    its own for each row; a null vec_id has a null component and is not kept. Other columns, whatever their names, are
    not read. An empty table gives no row."""
    wide = vectors.select("vec_id", F.col("embedding").alias("vector"))
    precise = "float" not in vectors.schema["embedding"].dataType.simpleString()
    if precise:
        wide = wide.withColumn("vector", F.col("vector").cast("array<double>"))
    rows = wide.withColumn("usable", usable(F.col("vector")))
    keyed = through_table(rows.where("usable").select(
        "vec_id", "vector", F.xxhash64("vector").alias("k1"), F.xxhash64(F.lit("second"), "vector").alias("k2"),
        F.monotonically_increasing_id().alias("number")), "vectors")
    total, widest = keyed.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    tables = table_shape(total, widest, threshold, recall)[2]

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, tuple] = {}
        for batch in batches:
            for dim, part in batch.groupby(batch["vector"].map(len)):
                if dim not in known:
                    shape = table_shape(total, dim, threshold, recall)
                    width, corners, many = shape
                    turns = [rotation(dim, width, 1000 + k) for k in range(many * corners)]
                    known[dim] = code_turn(dim), shape, np.concatenate(turns, axis=1) if turns else None
                turn, shape, spin = known[dim]
                for start in range(0, len(part), 1024):
                    piece = part.iloc[start:start + 1024]
                    unit = unit_rows(np.stack(piece["vector"].to_list()))
                    codes = Codes(unit, turn)
                    yield pd.DataFrame({
                        **{c: piece[c].to_numpy() for c in ("k1", "k2", "number")},
                        "code": codes.packed(), "factor": codes.factor.astype(np.float32),
                        "cells": list(bucket_cells(unit, spin, shape))})

    narrow = keyed.select("k1", "k2", "number", "vector").mapInPandas(
        coded, "k1 long, k2 long, number long, code binary, factor float, cells array<long>")
    distinct = through_table(narrow.groupBy("k1", "k2").agg(
        F.count(F.lit(1)).alias("copies"), F.min("number").alias("number"),
        F.first("code").alias("code"), F.first("factor").alias("factor"), F.first("cells").alias("cells")), "distinct-vectors")

    placed = distinct.select("number", "code", F.explode("cells").alias("cell"))
    counts = distinct.where(F.pmod(F.xxhash64("number"), F.lit(SIZE_SHARE)) == 0).select(
        F.explode("cells").alias("cell")).groupBy("cell").agg((F.count(F.lit(1)) * SIZE_SHARE).alias("n"))
    counts = through_table(counts.where(F.col("n") > BLOCK_ROWS), "large-buckets")
    large = F.broadcast(counts) if counts.count() <= BROADCAST_ROWS else counts
    blocks = placed.join(large, "cell", "left").withColumn("blocks", F.ceil(F.coalesce("n", F.lit(1)) / BLOCK_ROWS).cast("int"))
    blocks = blocks.withColumn("own", F.pmod(F.xxhash64("number"), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    blocks = blocks.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    key = ["cell", "low", "high"]
    groups = max(1, math.ceil(total * tables / GROUP_ROWS))
    blocks = blocks.select(*key, "own", "number", "code").withColumn("group", F.pmod(F.xxhash64(*key), F.lit(groups)))

    def sieve(frame: pd.DataFrame) -> pd.DataFrame:
        out = [frame.iloc[:0][[*key, "own", "number"]]]
        for (_, low, high, size), part in frame.groupby([*key, frame["code"].map(len)], sort=False):
            if len(part) > 1:
                words = np.frombuffer(b"".join(part["code"]), np.uint8).reshape(len(part), size)
                words = np.pad(words, ((0, 0), (0, -size % 8))).view(np.uint64)
                close = close_members(words, part["own"].to_numpy(), low != high, most_differing(8 * size, threshold))
                out.append(part.loc[close, [*key, "own", "number"]])
        return pd.concat(out)

    members = through_table(blocks.groupBy("group").applyInPandas(sieve, "cell long, low int, high int, own int, number long"),
                            "close-members")
    fetched = members.join(distinct.select("number", "copies", "code", "factor", "cells"), "number").join(
        keyed.select("number", "vector"), "number")
    groups = max(1, math.ceil(members.count() / BLOCK_ROWS))
    fetched = fetched.withColumn("group", F.pmod(F.xxhash64(*key), F.lit(groups)))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        turns: dict[int, np.ndarray] = {}
        for (cell, low, high, dim), part in frame.groupby([*key, frame["vector"].map(len)], sort=False):
            if len(part) < 2:
                continue
            if dim not in turns:
                turns[dim] = code_turn(dim)
            unit = unit_rows(np.stack(part["vector"].to_list()))
            codes = Codes.stored(unit, turns[dim], part["code"], part["factor"].to_numpy())
            cells = np.stack(part["cells"].to_list())
            table = int((cell ^ _dimension_mark(dim)) % cells.shape[1])
            own, copies = part["own"].to_numpy(), part["copies"].to_numpy()
            links, root = np.zeros(len(part), np.int64), np.arange(len(part))
            for start in range(0, len(part), 256):
                here = slice(start, start + 256)
                maybe = codes.may_reach(codes, threshold, here)
                maybe &= np.arange(len(part)) > np.arange(len(part))[here, None]
                if low != high:
                    maybe &= own[here, None] != own[None, :]
                a, b = np.nonzero(maybe)
                a += start
                for at in range(0, len(a), 65_536):
                    x, y = a[at:at + 65_536], b[at:at + 65_536]
                    reach = np.einsum("ij,ij->i", unit[x], unit[y]) >= threshold
                    x, y = x[reach], y[reach]
                    if table:
                        fresh = (cells[x, :table] != cells[y, :table]).all(1)
                        x, y = x[fresh], y[fresh]
                    np.add.at(links, x, copies[y])
                    np.add.at(links, y, copies[x])
                    root = joined_roots(root, x, y)
            hit = links > 0
            if hit.any():
                number = part["number"].to_numpy()
                out.append(pd.DataFrame({"number": number[hit], "links": links[hit], "top": number[root[hit]]}))
        return pd.concat(out) if out else pd.DataFrame({c: pd.Series([], dtype="int64") for c in ("number", "links", "top")})

    found = through_table(fetched.groupBy("group").applyInPandas(compare, "number long, links long, top long"), "vector-links")
    named = keyed.groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"))
    reps = through_table(distinct.select("number", "k1", "k2", "copies").join(named, ["k1", "k2"]), "vector-names")
    links = found.groupBy("number").agg(F.sum("links").alias("links"))
    tops = reps.select(F.col("number").alias("top"), F.col("rep").alias("root"))
    edges = found.where("number <> top").select("number", "top").distinct().join(
        reps.select("number", "rep"), "number").join(tops, "top")
    joined = components(edges, "rep", "root")
    reps = reps.join(links, "number", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    reps = through_table(reps.select("k1", "k2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                                     F.coalesce("component", "rep").alias("component_id")), "vector-classes")
    linked = keyed.select("vec_id", "k1", "k2").join(reps, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = linked.unionByName(alone)
    return both.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
