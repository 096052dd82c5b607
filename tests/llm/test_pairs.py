"""Near duplicates, components, decontamination and the pipeline against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import decontamination, duplicates, embeddings, text
from tidemark.llm.graph import components
from tidemark.session import through_table

WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "re", "so", "ta", "vu", "we", "zi") for b in ("bar", "del", "fon", "gim", "hop", "jus", "kel", "lir")]


def _roots(nodes, edges):
    root = {n: n for n in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(2)
    edges = {"path": [(k, k + 1) for k in range(60)], "star": [(0, k) for k in range(1, 200)] + [(300, 301), (None, 1), (5, 5)],
             "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(180)], "none": []}[shape]
    rng.shuffle(edges)
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    clean = [(a, b) for a, b in edges if a is not None and a != b]
    assert found == _roots({n for e in clean for n in e}, clean)


def _vectors():
    rng = np.random.default_rng(3)
    rows, center = [], rng.normal(size=(30, 24))
    for k in range(700):
        near = center[k % 30] + rng.normal(size=24) * rng.choice([0.05, 0.25, 0.45]) if k % 3 else rng.normal(size=24)
        rows.append((k, near.astype(np.float32).tolist()))
    rows += [(k, rows[1][1]) for k in range(2000, 2050)]
    return rows + [(3000, None), (3001, [0.0] * 24), (3002, [float("nan")] + [1.0] * 23), (3003, [None] + [1.0] * 23), (3004, [float("inf")] * 24),
                   (3005, [1.0, 0.0]), (3006, [2.0, 1e-3]), (3007, []), (1, rows[1][1]), (None, rows[4][1])]


@pytest.mark.parametrize(("block", "bucket"), [(16, 2048), (4096, 2048), (64, 200), (4096, 24)])
def test_embedding_links(spark, monkeypatch, block, bucket):
    monkeypatch.setattr(embeddings, "BLOCK_ROWS", block)
    monkeypatch.setattr(embeddings, "BUCKET_ROWS", bucket)
    embeddings.table_shape.cache_clear()
    rows = _vectors()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("links", F.lit("x")).withColumn("rep", F.lit(0))
    found = embeddings.near_vectors(frame, recall=0.99999).toPandas()
    assert len(found) == len(rows)
    usable = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {k: np.array(rows[k][1]) / np.linalg.norm(rows[k][1]) for k in usable}
    links = [(a, b) for a in usable for b in usable if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9]
    degree = np.bincount([x for e in links for x in e], minlength=len(rows))
    assert sorted(found["n_links"]) == sorted(degree)
    ids = [r[0] for r in rows]
    root = _roots(range(len(rows)), links)
    least: dict = {}
    for k, top in root.items():
        if ids[k] is not None:
            least[top] = min(ids[k], least.get(top, ids[k]))
    expected = sorted((ids[k], least[root[k]]) for k in range(len(rows)) if ids[k] is not None)
    got = found.dropna(subset=["vec_id"])
    assert sorted(zip(got["vec_id"].astype(int), got["component_id"].astype(int), strict=True)) == expected
    assert (got["kept"] == (got["vec_id"] == got["component_id"])).all()


def test_no_vectors(spark):
    found = embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, n_links string"))
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"] and found.count() == 0


@pytest.mark.parametrize("dim", [1, 2, 7, 64, 300])
def test_tables_meet_at_the_threshold(dim):
    rng = np.random.default_rng(8)
    shape = embeddings.table_shape(200_000, dim)
    width, corners, tables = shape
    spin = np.concatenate([embeddings.rotation(dim, width, 1000 + k) for k in range(tables * corners)], axis=1)
    a = embeddings.unit_rows(rng.normal(size=(4000, dim)))
    side = rng.normal(size=(4000, dim))
    side -= (side * a).sum(1)[:, None] * a
    length = np.linalg.norm(side, axis=1, keepdims=True)
    b = embeddings.unit_rows(a * 0.9 + np.sqrt(1 - 0.81) * side / np.maximum(length, 1e-9) * (length > 1e-9))
    met = (embeddings.bucket_cells(a, spin, shape) == embeddings.bucket_cells(b, spin, shape)).any(1)
    assert met.mean() > 0.995
    size = embeddings.code_turn(dim).shape[1]
    x, y = embeddings.Codes(a, embeddings.code_turn(dim)), embeddings.Codes(b, embeddings.code_turn(dim))
    differing = (x.signs != y.signs).sum(1)
    assert (differing <= embeddings.most_differing(size, 0.9)).mean() > 0.999


def test_stored_codes_estimate_alike():
    rng = np.random.default_rng(6)
    unit, turn = embeddings.unit_rows(rng.normal(size=(50, 32))), embeddings.code_turn(32)
    codes = embeddings.Codes(unit, turn)
    again = embeddings.Codes.stored(unit, turn, pd.Series(codes.packed()), codes.factor)
    assert (codes.signs == again.signs).all() and (codes.bound == again.bound).all()


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(5)
    a, b = embeddings.unit_rows(rng.normal(size=(300, 32))), embeddings.unit_rows(rng.normal(size=(300, 32)))
    b = embeddings.unit_rows(a + 0.4 * b)
    turn = embeddings.code_turn(32)
    x, y = embeddings.Codes(a, turn), embeddings.Codes(b, turn)
    estimate, exact = (x.signs @ y.rotated.T) / x.factor[:, None], a @ b.T
    assert abs((estimate - exact).mean()) < 0.01
    assert (np.abs(estimate - exact) <= x.bound[:, None]).mean() > 0.999
    assert x.may_reach(y, 0.9)[exact >= 0.9].all()


def _documents(seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(120):
        rows.append((k, " ".join(rng.choice(WORDS) for _ in range(rng.randint(40, 120)))))
    for k in range(120, 220):
        words = rows[k % 25][1].split()
        for _ in range(rng.choice([0, 1, 1, 2, 4])):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        rows.append((k, " ".join(words)))
    base = rows[3][1].split()
    for k in range(220, 300):  # a large group of copies that are near, but mostly not near enough to each other
        words = list(base)
        for _ in range(3):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        rows.append((k, " ".join(words)))
    rows += [(300 + k, rows[0][1].upper() + "!") for k in range(40)]
    return rows + [(400, None), (401, ""), (402, "..."), (403, "two words"), (404, "Two, words"), (405, "kabar " * 30_000), (None, rows[0][1]), (3, rows[3][1])]


@pytest.mark.parametrize("block", [16, 256])
def test_text_classes(spark, monkeypatch, block):
    monkeypatch.setattr(duplicates, "BLOCK_ROWS", block)
    rows = _documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rep", F.lit("r")).withColumn("bucket", F.lit(0))
    found = duplicates.near_texts(docs).toPandas()
    assert len(found) == len(rows)
    table, total = text.word_frequencies(docs)
    idf = text.inverse_frequency(table, total)
    named = [(i, duplicates.weighted_shingles(text.token_hashes(t), idf)) for i, t in rows if i is not None]
    named = [(i, v) for i, v in named if len(v[0])]
    links, near = [], 0
    for k, (i, v) in enumerate(named):
        for j, w in named[:k]:
            similar = duplicates.weighted_jaccard(v, w)
            links += [(i, j)] if similar >= 0.8 else []
            near += 0.79 < similar < 0.8
    root = _roots({i for i, _ in rows if i is not None}, links)
    got = {int(i): int(c) for i, c in zip(found["doc_id"], found["class_id"], strict=True) if i == i}
    wrong = sum(got[i] != root[i] for i in got)
    assert wrong == 0
    assert found[found["doc_id"].isna()]["kept"].all() and got[400] == 400 and got[401] == 401 and got[404] == 403


def test_samples_agree_as_often_as_weighted_jaccard():
    rng = np.random.default_rng(8)
    agree, similarity = [], []
    for _ in range(200):
        features = np.sort(text.mixed(rng.integers(1, 1 << 60, 120, dtype=np.uint64)))
        a, b = rng.gamma(2, 1, 120).astype(np.float32), rng.gamma(2, 1, 120).astype(np.float32)
        b[:90] = a[:90]
        sampler = duplicates.Sampler(int(rng.integers(1 << 30)))
        agree.append((sampler(features, a) == sampler(features, b)).mean())
        similarity.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(agree) - np.mean(similarity)) < 0.02


def test_one_of_each_class_stays(spark):
    docs = spark.createDataFrame(_documents(), "doc_id long, text string").withColumn("class_id", F.lit("own")).withColumn("n", F.lit(9))
    kept = duplicates.drop_near_texts(docs)
    classes = duplicates.near_texts(docs).where("kept").toPandas()["doc_id"]
    assert kept.columns == docs.columns
    assert sorted(kept.where("doc_id is not null").toPandas()["doc_id"]) == sorted(set(classes.dropna().astype(int)))
    assert kept.where("doc_id is null").count() == 1 and duplicates.drop_near_texts(docs.limit(0)).isEmpty()


def test_rows_that_repeat_an_id_are_judged_by_their_own_text(spark):
    rng = random.Random(4)
    one, two, three = (" ".join(rng.choice(WORDS) for _ in range(80)) for _ in range(3))
    near = one.split()
    near[40] = "other"
    item = " ".join(f"item{k}" for k in range(20))
    rows = [(1, one), (1, two), (1, two), (1, "..."), (2, " ".join(near)), (3, two.upper()), (4, three), (5, three), (5, item), (6, item), (6, one)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_row", F.lit("r"))
    kept = duplicates.drop_near_texts(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted([(1, one), (1, two), (1, "..."), (4, three), (5, item)])
    placed = sorted((r["doc_id"], r["class_id"], r["kept"]) for r in duplicates.near_texts(docs).collect())
    assert placed == sorted([(1, 1, True)] * 4 + [(2, 1, False), (3, 1, False), (4, 4, True), (5, 4, False), (5, 5, True), (6, 5, False), (6, 1, False)])
    clean = decontamination.drop_contaminated(docs, spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert clean.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in clean.collect()) == sorted(r for r in rows if r[1] != item)


def _common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[-1]))
        row = new
    return row[-1]


def test_common_subsequence():
    rng = random.Random(6)
    for _ in range(100):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 30))] for _ in range(2))
        assert decontamination.common_subsequence(a, b) == _common(a, b)


def test_planted_passages_are_found(spark):
    rng = random.Random(12)
    items = [(k, " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(rng.randint(12, 60)))) for k in range(30)]
    rows, truth = [], set()
    for k in range(200):
        body = [rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(rng.randint(10, 400))]
        if k % 10 == 0:
            item = rng.randrange(30)
            passage = items[item][1].split()
            if k % 20 == 0:  # a paraphrase: every ninth word is another
                passage = [w if j % 9 else "other" for j, w in enumerate(passage, 1)]
            place = rng.randrange(len(body))
            body[place:place] = passage
            truth.add((k, item))
        rows.append((k, " ".join(body)))
    rows += [(500, None), (501, ""), (502, items[4][1].upper()), (None, items[5][1]), (503, items[6][1] + " " + items[7][1]), (503, items[6][1])]
    truth |= {(502, 4), (503, 6), (503, 7), (None, 5)}
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(1)).withColumn("cosine", F.lit("c"))
    benchmark = spark.createDataFrame([*items, (90, None), (91, ""), (None, "kabar"), items[0]], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, benchmark).collect()}
    assert found == truth
    clean = decontamination.drop_contaminated(docs, benchmark)
    assert clean.columns == docs.columns and clean.count() == len(rows) - len([1 for i, _ in rows if i in {a for a, _ in truth}])
    assert decontamination.contaminated(docs, benchmark.limit(0)).isEmpty() and decontamination.contaminated(docs.limit(0), benchmark).isEmpty()


def test_benchmark_in_several_spaces(spark, monkeypatch):
    rng = random.Random(3)
    items = [(k, " ".join(rng.choice(WORDS) + str(rng.randrange(90)) for _ in range(20))) for k in range(25)]
    docs = spark.createDataFrame([(k, t) for k, t in items[::3]], "doc_id long, text string")
    monkeypatch.setattr(decontamination, "SPACE_PARTS", 7)
    monkeypatch.setattr(decontamination, "PASS_BYTES", 400)
    found = decontamination.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(k, k) for k, _ in items[::3]}


def test_spaces_are_fitted_on_every_part_and_no_sample(monkeypatch):
    """Products in the space are those of the TF-IDF vectors themselves, whatever words the documents repeat."""
    rng = np.random.default_rng(5)
    items = [(k, text.token_hashes(" ".join(f"w{j}" for j in rng.integers(0, 300, 30)))) for k in range(40)]
    table = np.zeros(1 << text.TABLE_BITS, np.int64)
    table[:] = rng.integers(0, 900, len(table))
    idf = text.inverse_frequency(table, 1000)
    monkeypatch.setattr(decontamination, "SPACE_PARTS", 16)
    parts = decontamination.item_parts(items, table, idf)
    spaces = decontamination.fitted_spaces(parts, idf)
    assert sum(len(s.parts) for s in spaces) == len(parts) == 40
    for space in spaces:
        exact = space.part_rows() * space.idf
        assert np.abs(space.latent @ space.words.T - exact).max() < 1e-5


@pytest.mark.parametrize("chunk", [120, 200_000])
def test_spaces_are_fitted_on_every_passage_of_every_document(spark, monkeypatch, chunk):
    """The sums over passages equal those of the matrix of all passages; what is left beside the parts is where documents vary."""
    monkeypatch.setattr(decontamination, "CHUNK", chunk)
    rng = random.Random(17)
    items = [(k, " ".join(rng.sample(WORDS, 20))) for k in range(3)]
    texts = [" ".join(rng.choice(WORDS + ["other", "more"]) for _ in range(n)) for n in (1, 5, 24, 25, 48, 49, 72, 73, 300, 777)] + ["none known"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None, ""])], "doc_id long, text string").repartition(3)
    table, total = text.word_frequencies(docs)
    idf = text.inverse_frequency(table, total)
    parts = decontamination.item_parts([(i, text.token_hashes(t)) for i, t in items], table, idf)
    bases = []
    monkeypatch.setattr(decontamination.Space, "project", lambda space, basis: bases.append(basis))
    monkeypatch.setattr(decontamination, "RANK", 6)
    monkeypatch.setattr(decontamination.fit_space, "__defaults__", (None, 6))
    space = decontamination.fitted_spaces(parts, idf, docs)[0]
    rows = []
    for body in texts:
        tokens = text.token_hashes(body)
        for start in range(0, max(1, len(tokens) - 24), 24):
            words, counts = np.unique(tokens[start:start + 48], return_counts=True)
            weight = counts * idf[text.cells(words)].astype(float)
            at = space.places(words)
            rows.append(np.zeros(len(space.vocabulary)))
            rows[-1][at[at >= 0]] = weight[at >= 0] / np.sqrt((weight ** 2).sum())
    matrix = np.stack(rows)
    passages = decontamination.passage_table(docs, [space], idf)
    assert passages.agg(F.sum("passages")).first()[0] == len(matrix)
    q = np.random.default_rng(2).normal(size=(len(space.vocabulary), 4))
    found = decontamination.gram_times(passages, np.arange(len(space.vocabulary)), q)
    assert np.abs(found - matrix.T @ (matrix @ q)).max() < 1e-4 * np.abs(found).max()
    basis = bases[0]
    assert basis.shape[1] == 6
    own = np.linalg.qr(space.part_rows().T)[0]
    assert np.abs(basis @ (basis.T @ own) - own).max() < 1e-4
    rest = matrix - (matrix @ own) @ own.T
    best = np.linalg.svd(rest)[1][:3] ** 2
    kept = ((rest @ basis) ** 2).sum()
    assert kept > 0.75 * best.sum()


def test_the_latent_space_selects_the_candidates(spark, monkeypatch):
    """Without directions in the space nothing is a candidate, in the query and in the stage."""
    rng = random.Random(3)
    items = [(k, " ".join(rng.choice(WORDS) + str(rng.randrange(90)) for _ in range(20))) for k in range(5)]
    docs = spark.createDataFrame(items, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert decontamination.drop_contaminated(docs, benchmark).isEmpty()
    monkeypatch.setattr(decontamination.Space, "project", lambda space, basis: None)
    assert decontamination.contaminated(docs, benchmark).isEmpty()
    assert decontamination.drop_contaminated(docs, benchmark).count() == 5


def test_an_item_in_a_third_of_the_documents_is_found(spark):
    """However common its own words become and however rare those around it are."""
    rng = random.Random(8)
    items = [(k, " ".join(f"item{k}w{j}" for j in range(20))) for k in range(3)]
    rows = []
    for k in range(600):
        body = [f"own{k}w{rng.randrange(10 ** 6)}" for _ in range(120)]
        if k % 3 == 0:
            body[60:60] = items[0][1].split()
        rows.append((k, " ".join(body)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, benchmark).collect()}
    assert found == {(k, 0) for k in range(0, 600, 3)}


def test_items_of_any_length_are_found_like_brute_force(spark, monkeypatch):
    """50 to 100 % of an item's words in order, inside longer texts, against checks of every region of every text."""
    monkeypatch.setattr(decontamination, "CHUNK", 700, raising=False)
    rng = random.Random(21)
    sizes = [2, 3, 4, 5, 8, 13, 17, 40, 60, 130, 270, 540, 1000]
    items = {k: [f"w{min(rng.randrange(4000), rng.randrange(4000), rng.randrange(4000))}" for _ in range(n)] for k, n in enumerate(sizes)}
    rows, planted = [], set()
    for share in (1.0, 0.7, 0.5):
        for k, item in items.items():
            for _ in range(2):
                answer = max(3, len(item) // 3)
                keep = math.ceil(share * len(item))
                places = range(len(item)) if share > 0.5 else range(max(0, len(item) - answer))
                # Half of the words count with the answer only.
                sure = set() if share > 0.5 else set(range(max(0, len(item) - answer), len(item)))
                sure |= set(rng.sample(places, max(0, keep - len(sure))))
                passage = [w if j in sure else "other" for j, w in enumerate(item)]
                body = [f"w{rng.randrange(40000)}" for _ in range(rng.randrange(1500))]
                at = rng.randrange(len(body) + 1)
                body[at:at] = passage
                planted.add((len(rows), k))
                rows.append((len(rows), " ".join(body)))
    truth = set()
    for i, body in rows:
        words = body.split()
        for k, item in items.items():
            step, size = max(1, len(item) // 2), len(item)
            answer = item[-max(3, size // 3):]
            for start in range(0, len(words), step):
                region = words[start:start + size + size // 2]
                share = decontamination.common_subsequence(item, region) / size
                if share >= 0.7 or (share >= 0.5 and decontamination.common_subsequence(answer, region) >= 0.8 * len(answer)):
                    truth.add((i, k))
                    break
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, benchmark).collect()}
    assert planted <= truth and found == truth


def test_pipeline_keeps_what_each_stage_keeps(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    held = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = through_table(stage(spark, docs, sf), name.replace(" ", "-"))
        assert docs.columns == columns
        held.append(docs.count())
    assert held[0] >= held[1] >= held[2] >= held[3]
    assert docs.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    final = corpus_pipeline.STAGES[-1][1](spark, docs, sf).toPandas()
    whole = corpus_pipeline.run(spark, sf).toPandas()
    key = ["doc_id", "size", "text_crc32", "law", "shard", "slot"]
    pd.testing.assert_frame_equal(final[key].sort_values(key, ignore_index=True), whole[key].sort_values(key, ignore_index=True))
    assert len(final) == held[-1]
