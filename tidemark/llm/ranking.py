"""Ranked lexical search by pipelined term partitioning: bundles of items pass the owners of their terms, rarest first."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.operators.scans import numbered
from tidemark.session import through_table

#: Bytes of terms are ASCII letters, digits and everything beyond ASCII; only A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
TOP = 10
#: Documents of a block and items of a bundle: one meeting of both holds 8 MB of scores.
BLOCK_DOCS, BUNDLE_ITEMS = 8192, 128
#: A term belongs to the first owner whose share of the documents it stays below; the last owner has the rest.
OWNER_SHARES = (1 / 1024, 1 / 64, 1 / 8)
#: Terms up to which every task holds the searched terms while it reads texts; beyond it all terms are indexed and joined.
KNOWN_BYTES = 32 << 20
#: More than any term adds per unit of its weight.
MOST = 1_000_000


def terms_of(text: str | None) -> list[bytes]:
    """All terms of a text, in order."""
    return text.encode("utf-8", "replace").translate(_BYTES).split() if isinstance(text, str) else []


def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, term): distinct terms of each item id, whose texts are pooled; items are numbered from 0."""
    text = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    found = items.select("item_id", F.explode(F.regexp_extract_all(text, F.lit(TERM), F.lit(0))).alias("term")).distinct()
    named = numbered(found.select("item_id").distinct(), ["item_id"], "item").withColumnRenamed("item_id", "named_id")
    return found.join(named, F.col("item_id").eqNullSafe(F.col("named_id"))).select((F.col("item") - 1).alias("item"), "item_id", "term")


def posting_blocks(docs: DataFrame, known: frozenset[bytes] | None) -> DataFrame:
    """One row per block of documents and term, and one per block with a null term.

    `data` has (place in the block, occurrences, terms of the document) of each document with the term; in the row of the
    block it has ids and a byte that tells which are null. `n_docs` counts documents with the term (any term), `n_terms` all
    terms of the block. With `known`, other terms are counted and not kept."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(known) if known is not None else None

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = shared.value if shared else None
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start in range(0, len(batch), BLOCK_DOCS):
                part = batch.iloc[start:start + BLOCK_DOCS]
                sizes = np.zeros(len(part), np.int32)
                entries: dict[bytes, list[int]] = {}
                for place, text in enumerate(part["text"]):
                    words = terms_of(text)
                    sizes[place] = len(words)
                    for term, times in Counter(words if wanted is None else [w for w in words if w in wanted]).items():
                        entries.setdefault(term, []).extend((place, times))
                missing = part["doc_id"].isna().to_numpy()
                ids = part["doc_id"].fillna(0).to_numpy(np.int64)
                rows = [(None, int((sizes > 0).sum()), int(sizes.sum(dtype=np.int64)), ids.tobytes() + missing.tobytes())]
                for term, flat in entries.items():
                    pairs = np.array(flat, np.int32).reshape(-1, 2)
                    rows.append((term.decode("utf-8"), len(pairs), 0, np.column_stack([pairs, sizes[pairs[:, 0]]]).tobytes()))
                frame = pd.DataFrame(rows, columns=["term", "n_docs", "n_terms", "data"])
                frame.insert(0, "block", number)
                yield frame
                number += 1

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Nullable ids reach pandas as objects, so that none is rounded.
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("decimal(20,0)"))
    return rows.mapInPandas(index, "block long, term string, n_docs long, n_terms long, data binary")


def term_weight(documents: int, holding: Column) -> Column:
    return F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * documents + 2)) / (2 * holding + 1).cast("double"))).cast("long")


def _owner(documents: int, holding: Column) -> Column:
    place = F.lit(len(OWNER_SHARES))
    for k in reversed(range(len(OWNER_SHARES))):
        place = F.when(holding < documents * OWNER_SHARES[k], k).otherwise(place)
    return place


def _scattered(packed: bytes) -> np.ndarray:
    scores = np.zeros((BUNDLE_ITEMS, BLOCK_DOCS), np.int64)
    entry = np.frombuffer(packed, [("at", np.int32), ("score", np.int64)])
    scores.reshape(-1)[entry["at"]] = entry["score"]
    return scores


def _gathered(scores: np.ndarray, kept: np.ndarray) -> bytes:
    at = np.flatnonzero(kept)
    entry = np.empty(len(at), [("at", np.int32), ("score", np.int64)])
    entry["at"], entry["score"] = at, scores.reshape(-1)[at]
    return entry.tobytes()


def _hopeful(scores: np.ndarray, rest: np.ndarray, top: int) -> np.ndarray:
    """Which accumulators can still be among the `top` of their item: the best sum that the later owners can bring reaches
    the `top`-th best sum of the block as it is now."""
    kept = scores > 0
    used = np.flatnonzero(kept.any(axis=1))
    least = np.partition(scores[used], -top, axis=1)[:, -top]
    kept[used] &= scores[used] + rest[used, None] >= least[:, None]
    return kept


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """The `top` highest-scoring documents of each item, with scores above 0: item_id, rank (from 1), doc_id, score.

    The score of a document sums w * ((10^9 tf) div (1000 tf + 8 m)) over the item's distinct terms, in 64-bit integers: see
    `term_weight` and `added`. Documents lie in blocks; a bundle of items visits every block with one sparse accumulator per
    item and document, and meets the block's postings of one term owner after another in a cogroup. Owners hold terms by
    document frequency, rarest first. After each owner, accumulators that cannot reach the block's best `top` even with the
    most that later terms can bring are let go; one that a later owner opens again stays below those, so results are exact.

    Equal scores rank by ascending doc_id, null last. Each row of `docs` is a document, also where ids repeat. Null texts
    and texts without terms match nothing and count neither in N nor in L; repeated rows of `items` count once, different
    texts of one item_id pool their terms, and a null item_id is an item. Empty tables give no row. Other columns of either
    table play no part."""
    spark = docs.sparkSession
    wanted = through_table(item_terms(items), "item-terms")
    size = wanted.select("term").distinct().agg(F.sum(F.octet_length("term")), F.count(F.lit(1))).first()
    schema = "item_id long, rank int, doc_id long, score long"
    if not size[1]:
        return spark.createDataFrame([], schema)
    known = None
    if size[0] <= KNOWN_BYTES:
        # At most KNOWN_BYTES of terms.
        known = frozenset(r["term"].encode("utf-8") for r in wanted.select("term").distinct().collect())
    blocks = through_table(posting_blocks(docs, known), "postings")
    documents, length = blocks.where("term is null").agg(F.sum("n_docs"), F.sum("n_terms")).first()
    if not length:
        return spark.createDataFrame([], schema)
    bundle, slot = F.floor(F.col("item") / BUNDLE_ITEMS).cast("int"), (F.col("item") % BUNDLE_ITEMS).cast("int")
    held = blocks.where("term is not null").groupBy("term").agg(F.sum("n_docs").alias("holding"))
    weighted = wanted.join(held, "term").select("item", "term", bundle.alias("bundle"), slot.alias("slot"),
                                                term_weight(documents, F.col("holding")).alias("w"), _owner(documents, F.col("holding")).alias("owner"))
    weighted = through_table(weighted, "term-weights")
    # At most BUNDLE_ITEMS slots in one row.
    asked = weighted.groupBy("term", "bundle", "w", "owner").agg(F.collect_list("slot").alias("slots"))
    owned = through_table(blocks.where("term is not null").join(asked, "term").select("block", "bundle", "owner", "w", "slots", "data"),
                          "owned-postings", ("owner",))
    owners = len(OWNER_SHARES) + 1
    later = [F.sum(F.when(F.col("owner") > k, F.col("w")).otherwise(0)) * MOST for k in range(owners)]
    rest = weighted.groupBy("bundle", "slot").agg(F.array(*later).alias("rest")).groupBy("bundle").agg(
        F.collect_list(F.struct("slot", "rest")).alias("rests"))
    rest = rest.select("bundle", F.col("rests.slot").alias("slots"), F.flatten("rests.rest").alias("rest"))
    bundles = int(wanted.agg(F.max("item")).first()[0]) // BUNDLE_ITEMS + 1
    every = F.explode(F.sequence(F.lit(0), F.lit(bundles - 1))).alias("bundle")
    visits = blocks.where("term is null").select("block", every).join(rest, "bundle").withColumn("sums", F.lit(b""))

    def added(sums: np.ndarray, postings: pd.DataFrame) -> None:
        for w, slots, data in zip(postings["w"], postings["slots"], postings["data"], strict=True):
            place, tf, n = np.frombuffer(data, np.int32).reshape(-1, 3).T.astype(np.int64)
            m = 10 + 90 * n * documents // length
            sums[np.ix_(np.asarray(slots), place)] += int(w) * (1_000_000_000 * tf // (1000 * tf + 8 * m))

    def met(owner: int):
        def run(key: tuple, visit: pd.DataFrame, postings: pd.DataFrame) -> pd.DataFrame:
            if visit.empty:
                return visit
            sums = _scattered(visit["sums"].iloc[0])
            added(sums, postings)
            rest = np.zeros(BUNDLE_ITEMS, np.int64)
            rest[np.asarray(visit["slots"].iloc[0])] = np.asarray(visit["rest"].iloc[0]).reshape(-1, owners)[:, owner]
            return visit.assign(sums=[_gathered(sums, _hopeful(sums, rest, top))])
        return run

    def last(key: tuple, visit: pd.DataFrame, postings: pd.DataFrame) -> pd.DataFrame:
        out = {"bundle": [], "slot": [], "doc_id": [], "score": []}
        if not visit.empty:
            sums = _scattered(visit["sums"].iloc[0])
            named = postings["w"].isna()
            added(sums, postings[~named])
            data = postings["data"][named].iloc[0]
            count = len(data) // 9
            ids, missing = np.frombuffer(data, np.int64, count), np.frombuffer(data, np.bool_, offset=8 * count)
            for row in np.flatnonzero(sums.any(axis=1)):
                at = np.flatnonzero(sums[row])
                at = at[np.lexsort((ids[at], missing[at], -sums[row][at]))[:top]]
                out["bundle"] += [key[1]] * len(at)
                out["slot"] += [int(row)] * len(at)
                out["doc_id"] += [None if missing[k] else int(ids[k]) for k in at]
                out["score"] += sums[row][at].tolist()
        return pd.DataFrame(out).astype({"doc_id": "Int64"})

    visit_schema = "block long, bundle int, slots array<int>, rest array<long>, sums binary"
    visits = visits.select("block", "bundle", "slots", "rest", "sums")
    key = ["block", "bundle"]
    for owner in range(owners):
        postings = owned.where(F.col("owner") == owner).select("block", "bundle", "w", "slots", "data")
        if owner < owners - 1:
            visits = visits.groupBy(key).cogroup(postings.groupBy(key)).applyInPandas(met(owner), visit_schema)
        else:
            names = blocks.where("term is null").select("block", every, F.lit(None).cast("long").alias("w"), F.array().cast("array<int>").alias("slots"), "data")
            found = visits.groupBy(key).cogroup(postings.unionByName(names).groupBy(key)).applyInPandas(
                last, "bundle int, slot int, doc_id long, score long")
    found = found.withColumn("item", F.col("bundle").cast("long") * BUNDLE_ITEMS + F.col("slot"))
    best = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return found.join(wanted.select("item", "item_id").distinct(), "item").select("item_id", "rank", "doc_id", "score")
