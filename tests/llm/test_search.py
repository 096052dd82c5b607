"""Ranked search and nearest neighbours against plain computations."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import collisions, ranking
from tidemark.llm.queries import ORACLE_SQL

SPLIT = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text):
    return SPLIT.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if text else []


def ranked(docs, items, top):
    counts = [(d, Counter(words(t)), len(words(t))) for d, t in docs]
    total, length = sum(n > 0 for *_, n in counts), sum(n for *_, n in counts)
    pooled = {}
    for item, text in items:
        pooled.setdefault(item, set()).update(words(text))
    out = set()
    for item, terms in pooled.items():
        scored = []
        for place, (doc, tf, n) in enumerate(counts):
            score = 0
            for term in terms & set(tf):
                df = sum(term in c for _, c, _ in counts)
                w = math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1)))
                score += w * (10**9 * tf[term] // (1000 * tf[term] + 8 * (10 + 90 * n * total // length)))
            if score:
                scored.append((-score, doc is None, doc or 0, place))
        out |= {(item, k + 1, None if none else doc, -score) for k, (score, none, doc, _) in enumerate(sorted(scored)[:top])}
    return out


@pytest.mark.parametrize("known, bundle, block", [(1 << 25, 128, 8192), (0, 2, 8192), (1 << 25, 3, 16)])
def test_ranked_search(spark, monkeypatch, known, bundle, block):
    monkeypatch.setattr(ranking, "KNOWN_BYTES", known)
    monkeypatch.setattr(ranking, "BUNDLE_ITEMS", bundle)
    monkeypatch.setattr(ranking, "BLOCK_DOCS", block)
    rng = random.Random(3)
    vocabulary = ["der", "Été", "x1", "Straße", "naïve", "the", "cat", "日本", "q"] + [f"w{k}" for k in range(60)]
    docs = [(k, rng.choice([" ", "-", "_", "\n"]).join(rng.choice(vocabulary) for _ in range(rng.randrange(40)))) for k in range(150)]
    docs += [(None, "the cat Été"), (None, "the cat Été"), (3, "the cat"), (900, None), (901, ""), (902, "?!"), (903, "THE cat w1"), (904, "cat THE w1")]
    docs += [(905, "w7 " * 20_000)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(12)))) for k in range(9)]
    items += [(1, "the w1"), (2, None), (3, ""), (None, "日本 ÉTÉ Été"), (50, "nothing-like this"), (4, "w1"), (4, "w1")]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, block int, term string").repartition(3)
    asked = spark.createDataFrame([(*i, 0.5) for i in items], "item_id long, text string, score double")
    found = [tuple(r) for r in ranking.ranked(frame, asked, 10).collect()]
    assert len(found) == len(set(found))
    assert set(found) == ranked(docs, items, 10)


def test_search_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, "..")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    for left, right in ((docs, items), (docs.limit(0), items), (docs, items.limit(0)), (items.select(F.col("item_id").alias("doc_id"), "text"), items.where("item_id > 5"))):
        assert ranking.ranked(left, right).collect() == []


def brute(rows, count):
    usable = {}
    for vec_id, vector in rows:
        if vec_id is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector) and any(vector):
            usable[vec_id] = min(usable.get(vec_id, vector), vector)
    out = {}
    for query, a in usable.items():
        if query % 20 == 0:
            scores = sorted((-float(np.add.accumulate(np.array(a) * np.array(b))[-1]), other) for other, b in usable.items() if other != query and len(a) == len(b))
            for rank, (score, other) in enumerate(scores[:count]):
                out[query, rank + 1] = (other, -score)
    return out


@pytest.mark.parametrize("shape", ["sphere", "lengths", "copies"])
def test_nearest_vectors(spark, monkeypatch, shape):
    monkeypatch.setattr(collisions, "BLOCK_ROWS", 256)
    monkeypatch.setattr(collisions, "SAMPLE_ROWS", 128)
    rng = np.random.default_rng(8)
    data = rng.normal(size=(1500, 24))
    if shape == "sphere":
        data /= np.linalg.norm(data, axis=1)[:, None]
    if shape == "lengths":
        data *= rng.lognormal(size=(1500, 1))
    if shape == "copies":
        data[:500] = data[0]
        data[500:800] = data[500] + rng.normal(size=(300, 24)) * 0.05
    rows = [(k, v.tolist()) for k, v in enumerate(data)]
    rows += [(2000, None), (2020, [0.0] * 24), (2040, [math.nan] * 24), (2060, [None] + [1.0] * 23), (2080, [1.0, 2.0]), (2081, [3.0, 1.0]), (2100, [1.0] * 5),
             (None, [1.0] * 24), (40, rows[41][1]), (40, rows[40][1]), (2120, [-0.0, 1.0]), (2121, [0.0, 1.0])]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, k1 int, rank int")
    found = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in collisions.nearest(frame, F.col("vec_id") % 20 == 0, 20, pass_bytes=4096).collect()}
    right = brute(rows, 20)
    assert set(found) == set(right)
    same = sum(found[k] == v for k, v in right.items())
    assert same >= 0.99 * len(right)
    scores = {(q, v): s for (q, _), (v, s) in right.items()}
    assert all(scores.get((q, v), s) == s for (q, _), (v, s) in found.items())


def test_no_vectors(spark):
    frame = spark.createDataFrame([(0, [0.0]), (None, [1.0])], "vec_id long, embedding array<float>")
    assert collisions.nearest(frame, F.col("vec_id") % 20 == 0).collect() == []
    assert collisions.nearest(frame.limit(0), F.col("vec_id") % 20 == 0).collect() == []
    alone = spark.createDataFrame([(0, [1.0, 0.5])], "vec_id long, embedding array<float>")
    assert collisions.nearest(alone, F.col("vec_id") % 20 == 0).collect() == []


def test_recall_on_the_given_vectors(spark):
    path = "/root/testdata/sf0.1"
    base = duckdb.connect()
    base.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet'")
    right = set(base.execute(ORACLE_SQL["op13_nearest_vectors"]).fetchall())
    found = {tuple(r) for r in collisions.nearest(spark.read.parquet(f"{path}/embeddings.parquet"), F.col("vec_id") % 20 == 0).collect()}
    assert len(found) == len(right)
    assert len(found & right) >= 0.99 * len(right)
