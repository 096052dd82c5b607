"""The registered queries on the smallest tables, against SQL, brute force or held-out labels."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tidemark.llm import duplicates, text, tokens
from tidemark.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
#: The smallest table has a handful of held-out labels; accuracies are taken on the next one.
LABELLED = "/root/testdata/sf0.01"
SPLIT = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def rows(spark):
    return {t: spark.read.parquet(f"{SF}/{t}.parquet").toPandas() for t in ("documents", "labels", "benchmark")}


def words_of(value):
    return re.findall("[\\w\u0080-\U0010ffff]+", value.lower()) if isinstance(value, str) else []


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    base = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark"):
        base.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    right = base.execute(ORACLE_SQL[name]).df()
    left = QUERIES[name](spark, SF).toPandas()[list(right.columns)]
    order = [c for c in (right.columns[0], "rank") if c in right.columns]
    left, right = left.sort_values(order, ignore_index=True), right.sort_values(order, ignore_index=True)
    assert len(left) == len(right)
    for column in right.columns:
        a, b = left[column], right[column]
        if column == "target":
            assert np.allclose(a.astype(float), b.astype(float), rtol=1e-9)
        else:
            assert ((a == b) | (a.isna() & b.isna())).all(), column


def test_token_rollup(spark, rows):
    import base64

    import tiktoken

    with open(tokens.VOCABULARY, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
    encoding = tiktoken.Encoding("t", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    first: dict = {}
    for d in rows["documents"].sort_values("doc_id").itertuples():
        first.setdefault(d.text, d.doc_id)
    truth: dict = defaultdict(lambda: [0, 0])
    for d in rows["documents"].itertuples():
        if first[d.text] != d.doc_id:
            continue
        clean = sum(any(c.isalpha() or c.isnumeric() for c in w) for w in SPLIT.findall(d.text))
        for version, n in (("whitespace-1", clean), ("byte-bpe-50k", len(encoding.encode_ordinary(d.text)))):
            truth[d.source, d.lang, version][0] += 1
            truth[d.source, d.lang, version][1] += n
    found = {(r["source"], r["lang"], r["tokenizer"]): [r["documents"], r["tokens"]] for r in QUERIES["op3_token_rollup"](spark, SF).collect()}
    assert found == dict(truth)


def test_token_rollup_of_repeated_ids_and_null_texts(spark, tmp_path):
    made = [(1, "a"), (2, "a"), (2, "b - c"), (3, None), (4, None)]
    spark.createDataFrame([(i, t, "s", "en") for i, t in made], "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["tokenizer"]: (r["documents"], r["tokens"]) for r in QUERIES["op3_token_rollup"](spark, str(tmp_path)).collect()}
    assert found["whitespace-1"] == (4, 3) and found["byte-bpe-50k"][0] == 4


@pytest.mark.parametrize(("name", "label", "least"), [("op4_toxicity", "toxic", 0.9), ("op6_quality", "quality", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    found = QUERIES[name](spark, LABELLED).toPandas()
    assert len(found) == spark.read.parquet(f"{LABELLED}/documents.parquet").count() and found["score"].between(0, 1).all()
    assert (found["held_out"] == found["doc_id"].map(held)).all()
    both = found[found["held_out"]].merge(spark.read.parquet(f"{LABELLED}/labels.parquet").toPandas(), on="doc_id")
    assert (both["predicted"] == both[label]).mean() >= least


def test_languages(spark):
    docs = spark.read.parquet(f"{LABELLED}/documents.parquet").toPandas()
    found = QUERIES["op9_language"](spark, LABELLED).toPandas()
    assert (found["held_out"] == found["doc_id"].map(held)).all()
    both = found[found["held_out"]].merge(docs, on="doc_id")
    assert len(found) == len(docs) and (both["lang_pred"] == both["lang"]).mean() > 0.95


def test_shards(spark, rows):
    found = QUERIES["op5_shards"](spark, SF).toPandas()
    docs = rows["documents"].set_index("doc_id")["text"].map(lambda t: (t or "").encode())
    assert sorted(found["doc_id"]) == sorted(docs.index)
    assert (found["size"] == found["doc_id"].map(docs).map(len) + 8).all() and (found["text_crc32"] == found["doc_id"].map(docs).map(zlib.crc32)).all()
    counts = Counter(found["shard"])
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) <= set(range(24))
    for shard, slots in found.groupby("shard")["slot"]:
        assert sorted(slots) == list(range(counts[shard]))
    again = QUERIES["op5_shards"](spark, SF).toPandas()
    assert set(zip(found["doc_id"], found["shard"], found["slot"], strict=True)) == set(zip(again["doc_id"], again["shard"], again["slot"], strict=True))


def test_near_texts(spark, rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    idf = text.inverse_frequency(*text.word_frequencies(docs))
    named = [(int(d.doc_id), duplicates.weighted_shingles(text.token_hashes(d.text), idf)) for d in rows["documents"].itertuples()]
    root = {i: i for i, _ in named}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, v) in enumerate(named):
        for j, w in named[:k]:
            if len(v[0]) and len(w[0]) and duplicates.weighted_jaccard(v, w) >= 0.8:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    found = {r["doc_id"]: r["class_id"] for r in QUERIES["op8_near_texts"](spark, SF).collect()}
    assert found == {i: top(i) for i in root}


def test_contaminated(spark, rows):
    items = [(int(b.item_id), words_of(b.text)) for b in rows["benchmark"].itertuples()]
    truth = set()
    for d in rows["documents"].itertuples():
        body = " " + " ".join(words_of(d.text)) + " "
        truth |= {(int(d.doc_id), i) for i, w in items if w and f" {' '.join(w)} " in body}
    found = {(r["doc_id"], r["item_id"]) for r in QUERIES["op10_contaminated"](spark, SF).collect()}
    assert truth and found >= truth and len(found - truth) <= 0.02 * len(rows["documents"])
