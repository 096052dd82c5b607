"""Near-duplicate texts: improved consistent weighted sampling over TF-IDF shingles, banded, then verified."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.graph import components
from tidemark.llm.text import cells, inverse_frequency, mixed, shingles, token_hashes, word_frequencies
from tidemark.session import through_table

#: Fixed by the contract for word shingles.
WIDTH, SIMILARITY = 5, 0.8
#: Samples are read in bands: BANDS x ROWS of them.
BANDS, ROWS = 11, 4
SAMPLES = BANDS * ROWS
#: Entries of the table of gamma and uniform draws, chosen by a shingle's hash.
DRAWS = 1 << 16
#: Shingles sampled at once, so that the arrays stay in the processor's cache.
PART = 1024
#: Equal samples below which a pair in one bucket is not verified: a pair at SIMILARITY has fewer once in about 10^6.
LEAST_EQUAL = math.floor(SAMPLES * (SIMILARITY - 4.7 * math.sqrt(SIMILARITY * (1 - SIMILARITY) / SAMPLES)))
#: Members of a bucket compared in one block, ids up to which a list (8 bytes a row) is broadcast.
BLOCK_ROWS = 256
BROADCAST_IDS = 500_000


class Sampler:
    """For each of SAMPLES draws, the shingle and level chosen with probability in proportion to its weight, alike for
    all texts: two texts agree in a draw with the probability of their weighted Jaccard similarity."""

    def __init__(self, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.r = rng.gamma(2, 1, DRAWS).astype(np.float32)
        self.ln_c = np.log(rng.gamma(2, 1, DRAWS)).astype(np.float32)
        self.beta = rng.random(DRAWS).astype(np.float32)
        self.salt = rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) | np.uint64(1)

    def __call__(self, features: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """One 64-bit value per draw; features must be sorted, so that ties go to the smallest."""
        best, chosen = np.full(SAMPLES, np.inf, np.float32), np.zeros(SAMPLES, np.uint64)
        ln_w = np.log(weights).astype(np.float32)
        lanes = np.arange(SAMPLES)
        for k in range(0, len(features), PART):
            part, w = features[k:k + PART], ln_w[k:k + PART, None]
            at = ((part[:, None] * self.salt) >> np.uint64(48)).astype(np.int32)
            r = self.r[at]
            level = np.floor(w / r + self.beta[at])
            cost = self.ln_c[at] - r * (level - self.beta[at] + np.float32(1))
            low = cost.argmin(axis=0)
            value = cost[low, lanes]
            better = value < best
            best[better] = value[better]
            steps = level[low, lanes].astype(np.int64).astype(np.uint64)
            chosen[better] = mixed(part[low] + mixed(steps + self.salt))[better]
        return chosen


def weighted_shingles(tokens: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles in order and their weights: occurrences times the mean inverse frequency of the words."""
    found = shingles(tokens, WIDTH)
    if not len(found):
        return found, np.zeros(0, np.float32)
    size = min(WIDTH, len(tokens))
    sums = np.cumsum(np.concatenate([[0.0], idf[cells(tokens)]]))
    means = (sums[size:] - sums[:-size]) / size
    features, first, counts = np.unique(found, return_index=True, return_counts=True)
    return features, (counts * np.round(means[first], 4)).astype(np.float32)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, x, y = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][x], b[1][y]).sum(dtype=np.float64)
    total = a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64) - shared
    return float(shared / total) if total else 0.0


def _key(tokens: np.ndarray) -> str:
    return xxhash.xxh3_128_hexdigest(tokens.tobytes())


def near_texts(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, class_id, kept.

    Texts with equal words (case and marks aside) are copies. Different texts link if the weighted Jaccard similarity of
    their five-word shingles is at least `similarity`; a class is what links and copies connect, named by its smallest
    doc_id, whose row is kept. Every text is a node of its own, so a repeated id joins nothing: its rows are placed by their
    own texts, and classes that start with the same id share its name. Of different texts of one class under its smallest
    id one is kept; rows equal in id and words are kept alike. A shingle weighs its occurrences times the mean inverse document frequency of its words,
    counted over all rows. Texts without a word (null, empty, marks only) and rows without an id are classes of their own;
    a null id has a null class and is kept. An empty table gives no row.

    Two rounds of verification: every member of a bucket against the smallest one; then, where members of a bucket are
    still in different classes, block by block all pairs whose samples agree often enough, until they are joined. Pairs
    never leave a task unless they link classes, and nothing is capped."""
    return _placed(docs, similarity).select("doc_id", "class_id", "kept")


def _placed(docs: DataFrame, similarity: float) -> DataFrame:
    """doc_id, copy (key of the words, null without any), class_id, kept of every row."""
    table, total = word_frequencies(docs)
    sparkContext = docs.sparkSession.sparkContext
    idf = sparkContext.broadcast(inverse_frequency(table, total))
    named = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("doc_id is not null")

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sampler, weights = Sampler(), idf.value
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                tokens = token_hashes(text)
                if not len(tokens):
                    out.append((doc_id, None, None, None))
                else:
                    drawn = sampler(*weighted_shingles(tokens, weights))
                    bands = drawn.reshape(BANDS, ROWS)
                    keys = np.zeros(BANDS, np.uint64)
                    for row in range(ROWS):
                        keys = mixed(keys + bands[:, row] + np.uint64(row))
                    out.append((doc_id, _key(tokens), drawn.astype(np.uint16).tobytes(), keys.view(np.int64)))
            yield pd.DataFrame(out, columns=["doc_id", "copy", "samples", "bands"])

    sketched = through_table(named.mapInPandas(sketch, f"doc_id {named.schema['doc_id'].dataType.simpleString()}, copy string, samples binary, bands array<long>"), "sketches")
    texts = sketched.where("copy is not null").groupBy("copy").agg(F.min(F.struct("doc_id", "samples", "bands")).alias("least"))
    # Numbers are drawn once, with the table.
    texts = through_table(texts.select("copy", F.col("least.doc_id").alias("least_id"), "least.samples", "least.bands",
                                       F.monotonically_increasing_id().alias("node")), "texts")

    spread = texts.select("node", F.posexplode("bands").alias("band", "bucket"))
    shared = through_table(spread.groupBy("band", "bucket").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n"))
                           .where("n > 1"), "shared-buckets")
    members = through_table(spread.join(shared, ["band", "bucket"]), "bucket-members")
    needed = through_table(texts.join(members.select("node").distinct(), "node").select(
        "node", "copy", F.col("least_id").alias("doc_id")), "needed")
    ids = needed.select("doc_id").distinct()
    ids = F.broadcast(ids) if needed.count() <= BROADCAST_IDS else ids

    def rekeyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["copy"] = [_key(token_hashes(t)) for t in batch["text"]]
            yield batch

    kind = named.schema["doc_id"].dataType.simpleString()
    bodies = named.join(ids, "doc_id", "left_semi")
    bodies = bodies.mapInPandas(rekeyed, f"doc_id {kind}, text string, copy string").dropDuplicates(["doc_id", "copy"])
    # A repeated id may have several texts: the copy key picks the one that was sketched.
    bodies = through_table(bodies.join(needed, ["doc_id", "copy"]).select("node", "text"), "bodies")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = idf.value
        last, held = None, None
        for batch in batches:
            linked = []
            for a_id, a, b_id, b in batch[["low", "low_text", "high", "high_text"]].itertuples(index=False):
                if a_id != last or held is None:
                    last, held = a_id, weighted_shingles(token_hashes(a), weights)
                if weighted_jaccard(held, weighted_shingles(token_hashes(b), weights)) >= similarity:
                    linked.append((a_id, b_id))
            yield pd.DataFrame(linked, columns=["low", "high"])

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        low = bodies.select(F.col("node").alias("low"), F.col("text").alias("low_text"))
        high = bodies.select(F.col("node").alias("high"), F.col("text").alias("high_text"))
        both = pairs.join(high, "high").join(low, "low")
        return through_table(both.mapInPandas(verify, "low long, high long"), name)

    def classed(edges: DataFrame) -> DataFrame:
        return components(edges, "low", "high")

    pairs = members.where("node > first").select(F.col("first").alias("low"), F.col("node").alias("high")).distinct()
    links = verified(pairs, "first-links")
    classes = classed(links)
    more = _links_across(members, classes, texts.select("node", "samples"), bodies, idf, similarity)
    if not more.isEmpty():
        classes = classed(links.unionByName(more))

    classes = through_table(texts.select("node", "copy", "least_id").join(classes, "node"), "linked-texts")
    least = classes.groupBy("component").agg(F.min(F.struct("least_id", "copy")).alias("least"))
    linked = classes.join(least, "component").select("copy", F.col("least.least_id").alias("class_id"), F.col("least.copy").alias("kept_copy"))
    text_class = texts.select("copy", "least_id").join(linked, "copy", "left").select(
        "copy", F.coalesce("class_id", "least_id").alias("class_id"), F.coalesce("kept_copy", "copy").alias("kept_copy"))
    text_class = through_table(text_class, "text-classes")
    placed = sketched.select("doc_id", "copy").join(text_class, "copy").select(
        "doc_id", "copy", "class_id", ((F.col("doc_id") == F.col("class_id")) & (F.col("copy") == F.col("kept_copy"))).alias("kept"))
    wordless = sketched.where("copy is null").select("doc_id").unionByName(docs.select("doc_id").where("doc_id is null"))
    return placed.unionByName(wordless.select("doc_id", F.lit(None).cast("string").alias("copy"), F.col("doc_id").alias("class_id"), F.lit(True).alias("kept")))


def _links_across(members: DataFrame, classes: DataFrame, samples: DataFrame, bodies: DataFrame, idf: Broadcast,
                  similarity: float) -> DataFrame:
    """Links (low, high) between members of one bucket that are in different classes so far.

    Tasks get the members with their texts, block against block, and return at most one link per merge; a pair is looked
    at in the first band that holds it and only while its members are still apart."""
    known = members.select("band", "bucket", "node").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    known = through_table(known, "bucket-classes")
    split = known.groupBy("band", "bucket").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count(F.lit(1)).alias("n"))
    split = through_table(split.where("a <> b").select("band", "bucket", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks")), "split-buckets")
    rows = through_table(known.join(split, ["band", "bucket"]), "split-members")
    groups = max(1, math.ceil((rows.agg(F.sum("blocks")).first()[0] or 0) / (2 * BLOCK_ROWS)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("left", F.least("own", "other")).withColumn("right", F.greatest("own", "other"))
    key = ["band", "bucket", "left", "right"]
    rows = rows.withColumn("group", F.pmod(F.xxhash64(*key), F.lit(groups))).drop("blocks", "other")
    rows = rows.join(samples, "node").join(bodies, "node")

    def link(frame: pd.DataFrame) -> pd.DataFrame:
        low, high = [], []
        for (band, _, left, right), part in frame.groupby(key, sort=False):
            part = part.drop_duplicates(["node", "text"])
            sample = np.frombuffer(b"".join(part["samples"]), np.uint16).reshape(len(part), SAMPLES)
            component, own, node, text = (part[c].to_numpy() for c in ("component", "own", "node", "text"))
            equal = np.zeros((len(part), len(part)), np.int16)
            good = component[:, None] < component[None, :]
            if left != right:
                good &= own[:, None] != own[None, :]
            for other in range(BANDS):
                draws = [sample[:, k, None] == sample[None, :, k] for k in range(other * ROWS, (other + 1) * ROWS)]
                equal += sum(d.astype(np.int16) for d in draws)
                if other < band:
                    good &= ~np.logical_and.reduce(draws)
            a, b = np.nonzero(good & (equal >= LEAST_EQUAL))
            order = np.argsort(-equal[a, b], kind="stable")
            root = {c: c for c in component}
            features: dict[int, tuple] = {}

            def top(c, root=root):
                while root[c] != c:
                    root[c] = root[root[c]]
                    c = root[c]
                return c

            def of(k, features=features, text=text):
                if k not in features:
                    found = weighted_shingles(token_hashes(text[k]), idf.value)
                    features[k] = (*found, found[1].sum(dtype=np.float64))
                return features[k]

            for x, y in zip(a[order], b[order], strict=True):
                s, t = top(component[x]), top(component[y])
                if s == t:
                    continue
                p, q = of(x), of(y)
                # The lighter text is all that can be shared.
                if min(p[2], q[2]) >= similarity * max(p[2], q[2]) * (1 - 1e-6) and weighted_jaccard(p, q) >= similarity:
                    root[max(s, t)] = min(s, t)
                    low.append(min(node[x], node[y]))
                    high.append(max(node[x], node[y]))
        return pd.DataFrame({"low": low, "high": high})

    return through_table(rows.groupBy("group").applyInPandas(link, "low long, high long").distinct(), "more-links")


def drop_near_texts(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of `docs` that stand for their class, with their own columns. Rows that share an id are told apart by their
    words; of rows equal in both, that with the smallest text stays. Rows without an id or a word stay."""
    placed = through_table(_placed(docs, similarity).where("doc_id is not null"), "near-text-rows")
    by_id = placed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept")).where("kept")
    by_id = through_table(by_id.select("doc_id", "n"), "kept-ids")
    once, again = by_id.where("n = 1").select("doc_id"), by_id.where("n > 1").select("doc_id")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.join(F.broadcast(once) if by_id.count() <= BROADCAST_IDS else once, "doc_id", "left_semi").select(*columns)
    if not again.isEmpty():
        def key(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                found = [token_hashes(t) for t in batch]
                yield pd.Series([_key(t) if len(t) else None for t in found], dtype=object)

        keyed = docs.join(again, "doc_id", "left_semi").select(
            F.struct(*columns).alias("_row"), F.pandas_udf(key, "string")(F.col("text").cast("string")).alias("_copy"))
        keyed = through_table(keyed, "repeated-ids")
        least = keyed.where("_copy is not null").groupBy(F.col("_row.doc_id").alias("_id"), "_copy").agg(
            F.min_by("_row", F.coalesce("_row.text", F.lit(""))).alias("_row"))
        chosen = placed.where("kept and copy is not null").select(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy"))
        rows = rows.unionByName(least.join(chosen, ["_id", "_copy"], "left_semi").select("_row.*"))
        rows = rows.unionByName(keyed.where("_copy is null").select("_row.*"))
    return rows.unionByName(docs.where("doc_id is null").select(*columns))
