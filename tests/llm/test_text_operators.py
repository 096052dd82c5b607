"""Sources mix, shards, language, labels, tokens and archives against brute force, with odd rows."""

from __future__ import annotations

import gzip
import io
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language, mixing, quality, sharding, text, tokens, toxicity, training, warc
from tidemark.session import scratch_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    words = {"en": "the river runs under old stone bridges toward quiet towns".split(),
             "de": "der fluss fließt unter alten brücken zu stillen städten hin".split(),
             "fr": "la rivière coule sous des vieux ponts vers les villes calmes".split()}
    rows = []
    for k in range(240):
        lang = ("en", "de", "fr")[k % 3]
        body = " ".join(rng.choice(words[lang]) for _ in range(rng.randint(3, 60)))
        rows.append((k, body, lang, "hub" if k % 3 else f"s{k % 5}", len(body)))
    rows += [(900, None, "en", "hub", None), (901, "", None, None, 0), (902, "12 !! 34", "de", "hub", 8),
             (903, "the river " * 4000, "en", None, 40_000), (7, rows[7][1], "de", "hub", 1), (None, "old stone bridges", None, "hub", 3)]
    rows += [(905, rows[4][1], "en", "s1", 3)] * 3
    return spark.createDataFrame(rows, DOCS)


def clashing(frame):
    return frame.withColumns({"size": F.lit("x"), "target": F.lit(1), "key": F.lit(2), "row": F.lit("r"), "found": F.lit(True),
                              "copy": F.lit(1), "rep": F.lit(1), "at": F.lit(0), "shard": F.lit("z")})


def test_mix_reaches_targets(docs):
    found = mixing.mixed_sizes(docs).toPandas()
    assert len(found) == docs.count()
    assert (found["taken"] <= 2 * found["size"]).all() and (found["taken"] >= 0).all()
    rows = docs.toPandas()
    size = rows["text"].map(lambda t: len(t.split()) if t is not None and t == t else 0)
    sums = size.groupby(rows["source"], dropna=False).sum()
    assert math.isclose(found.drop_duplicates(["source_size", "target"])["target"].sum(), 1.5 * size.sum(), rel_tol=1e-9)
    assert sorted(found["source_size"].unique()) == sorted(sums.unique())
    for _, group in found.groupby(["source_size", "target"]):
        assert abs(group["taken"].sum() - group["target"].iloc[0]) <= 1


def test_mix_is_weighted_order_in_every_bucket(docs, monkeypatch):
    whole = mixing.mixed_sizes(docs).toPandas()
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 4)
    cut = mixing.mixed_sizes(docs).toPandas()
    order = ["doc_id", "size", "source_size", "taken"]
    pd.testing.assert_frame_equal(whole[order].sort_values(order, ignore_index=True), cut[order].sort_values(order, ignore_index=True))


def test_ranges_of_a_junk_source_are_split(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 100)
    kept = {}
    through = mixing.through_table
    monkeypatch.setattr(mixing, "through_table", lambda df, name: kept.setdefault(name, through(df, name)))
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("junk").alias("source"), F.lit("#" * 400).alias("text"))
    found = mixing.mixed_sizes(docs)
    assert found.count() == 6000 and found.agg(F.sum("taken")).first()[0] == 9000
    # Every document has one word, so the starts of ranges differ by their rows.
    starts = sorted(r["bucket_start"] for r in kept["mix-buckets"].collect()) + [6000]
    assert len(starts) > 60 and max(b - a for a, b in zip(starts, starts[1:], strict=False)) < 200


def test_mixed_documents_repeat_rows(docs):
    out = mixing.mixed_documents(clashing(docs))
    assert out.columns == clashing(docs).columns
    counts = out.groupBy("doc_id", "source").count().toPandas()
    assert counts["count"].max() <= 6 and 900 not in set(counts["doc_id"])


def test_mix_of_nothing(docs):
    assert mixing.mixed_sizes(docs.limit(0)).count() == 0
    assert mixing.mixed_documents(docs.where("doc_id in (900, 901)")).count() == 0


def test_shards_are_even_and_gapless(docs):
    found = sharding.shard_rows(clashing(docs), range(24)).toPandas()
    assert len(found) == docs.count()
    counts = found.groupby("shard")["slot"].agg(["count", "min", "max", "nunique"])
    assert counts["count"].max() - counts["count"].min() <= 1
    assert (counts["min"] == 0).all() and (counts["max"] + 1 == counts["count"]).all() and (counts["nunique"] == counts["count"]).all()
    assert sharding.shard_rows(docs.limit(0), range(3)).count() == 0


def test_one_repeated_row_is_spread(spark):
    same = spark.range(5000).select(F.lit(1).alias("doc_id"), F.lit("again").alias("text"))
    assert sharding.shard_rows(same, range(7)).groupBy("shard").count().toPandas()["count"].between(714, 715).all()


def test_overflow_goes_clockwise():
    placed = sharding.spill_clockwise([5, 1, 0, 2], [0, 1, 2, 0], {0: 3, 1: 3, 2: 2})
    assert sum(end - start for _, start, end, _ in placed) == 8
    # Shard 0 serves its own arcs first; arc 0 spills to shard 1, then 2.
    assert [p for p in placed if p[0] == 0] == [(0, 0, 3, 0), (0, 3, 5, 1)]
    assert [p for p in placed if p[0] == 3] == [(3, 0, 2, 2)] or sum(p[2] - p[1] for p in placed if p[0] == 3) == 2


def test_growth_moves_little():
    assert sharding.moved_share(sharding.ring(range(24)), sharding.ring(range(25))) < 2 / 25


def test_languages_are_told_apart(docs):
    contents = language.dictionaries(docs)
    assert set(contents) == {"en", "de", "fr"} and all(len(c) <= language.DICTIONARY_BYTES for c in contents.values())
    found = language.identify(clashing(docs), contents).toPandas()
    assert len(found) == docs.count()
    truth = docs.select("doc_id", "lang", F.col("text").rlike(r"\p{L}").alias("read")).toPandas().drop_duplicates("doc_id")
    both = found.drop_duplicates("doc_id").merge(truth.dropna(), on="doc_id")
    assert (both["lang_pred"] == both["lang"])[both["read"].astype(bool)].mean() > 0.95
    odd = found[found["doc_id"].isin([900, 901, 902])]
    assert (odd["lang_pred"] == "und").all() and (odd["score"] == 0).all() and odd["rejected"].all()


def test_narrow_margins_are_dropped(docs):
    kept = language.drop_unidentified(clashing(docs))
    assert kept.columns == clashing(docs).columns and kept.where("doc_id in (900, 901, 902)").isEmpty()
    assert kept.where("doc_id < 240").count() > 200
    assert language.drop_unidentified(docs.limit(0)).isEmpty()
    assert set(language.identify(docs, {}).toPandas()["lang_pred"]) == {"und"}


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    odds, moves = rng.normal(size=(2, 5)), rng.normal(size=(2, 2))
    used = np.array([[True] * 5, [True] * 3 + [False] * 2])
    toxic, expected = toxicity.forward_backward(odds, used, moves, pairs_too=True)
    total = np.zeros((2, 2))
    for c in range(2):
        n = used[c].sum()
        paths = [[(k >> t) & 1 for t in range(n)] for k in range(1 << n)]
        weight = np.array([math.exp(moves[0, p[0]] + sum(odds[c, t] for t in range(n) if p[t]) + sum(moves[p[t - 1], p[t]] for t in range(1, n))) for p in paths])
        weight /= weight.sum()
        for t in range(n):
            assert math.isclose(toxic[c, t], sum(w for w, p in zip(weight, paths, strict=True) if p[t]), abs_tol=1e-9)
        for w, p in zip(weight, paths, strict=True):
            for t in range(1, n):
                total[p[t - 1], p[t]] += w
    assert np.allclose(expected, total) and (toxic[~used] == 0).all()


@pytest.mark.parametrize("stay", [0.5, 4.0, 9.0])
def test_messages_pass_the_cuts_of_long_texts(stay):
    """Rows of 4 give the marginals of whole chains, also where states last for hundreds of tokens."""
    rng = np.random.default_rng(8)
    moves = np.array([[0.0, -stay], [-stay, 0.3]])
    texts = [rng.normal(scale=2, size=n) for n in (1, 4, 5, 8, 131, 402)]
    rows, used, goes_on = [], [], []
    for odds in texts:
        cut = [odds[k:k + 4] for k in range(0, len(odds), 4)]
        rows += [np.pad(part, (0, 4 - len(part))) for part in cut]
        used += [np.arange(4) < len(part) for part in cut]
        goes_on += [k > 0 for k in range(len(cut))]
    found = toxicity.forward_backward(np.array(rows), np.array(used), moves, goes_on=np.array(goes_on))[0][np.array(used)]
    whole = [toxicity.forward_backward(odds[None], np.ones((1, len(odds)), bool), moves)[0][0] for odds in texts]
    assert np.allclose(found, np.concatenate(whole), atol=1e-9)


def test_repeated_and_clashing_rows_are_tagged_each(spark):
    docs, labels = _labelled(spark, "vile")
    field = training.fitted(docs, labels, "toxic", toxicity.PER_CLASS, ("text",), toxicity.fit_frame)
    one = docs.where("doc_id = 4")
    twice = one.unionByName(one).withColumns({"score": F.lit("x"), "spans": F.lit(1), "predicted": F.lit(None)})
    found = toxicity.tag(twice, field).collect()
    assert len(found) == 2 and found[0] == found[1] and found[0]["predicted"] == 1


def _labelled(spark, bad: str):
    rng = random.Random(1)
    good = "the river runs under old stone bridges toward quiet towns".split()
    rows, labels = [], []
    for k in range(400):
        words = [rng.choice(good) for _ in range(30)]
        toxic = k % 4 == 0
        if toxic:
            words[rng.randrange(30)] = bad
        rows.append((k, " ".join(words), "en", "s", None))
        labels.append((k, int(not toxic), int(toxic)))
    rows += [(1000, None, None, None, None), (1001, "", None, None, 5), (1002, (bad + " fine ") * 5000, None, None, 1)]
    labels += [(0, 0, 1), (None, 1, 1), (3, None, None)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxic_spans_are_found(spark):
    docs, labels = _labelled(spark, "vile")
    field = training.fitted(docs, labels, "toxic", toxicity.PER_CLASS, ("text",), toxicity.fit_frame)
    found = toxicity.with_fold(toxicity.tag(docs, field)).toPandas().set_index("doc_id")
    held = found[found["held_out"] & (found.index < 400)]
    assert ((held.index % 4 == 0) == (held["predicted"] == 1)).mean() > 0.97
    assert found.loc[[1000, 1001], "predicted"].eq(0).all() and found.loc[1002, "predicted"] == 1
    texts = docs.toPandas().set_index("doc_id")["text"]
    for k in held.index[held["predicted"] == 1]:
        assert any(texts[k][s["start"]:s["end"]] == "vile" for s in found.loc[k, "spans"])
    assert toxicity.tag(docs.limit(0), field).isEmpty()


def test_without_labels_nothing_is_toxic(spark):
    docs, labels = _labelled(spark, "vile")
    field = training.fitted(docs, labels.limit(0), "toxic", toxicity.PER_CLASS, ("text",), toxicity.fit_frame)
    assert toxicity.tag(docs, field).agg(F.max("predicted")).first()[0] == 0


def test_factorisation_identity():
    machine = quality.Machine(np.zeros((len(quality.STATISTICS), quality.BINS - 1)))
    machine.linear[:] = np.random.default_rng(2).normal(size=len(machine.linear))
    found = quality.features("one two two three", 17.0, quality.Slots())
    places, values, starts = machine.rows([found])
    raw = machine.raw(places, values, starts)[0][0]
    pairs = sum(values[i] * values[j] * (machine.factors[places[i]] @ machine.factors[places[j]])
                for i in range(len(places)) for j in range(i))
    assert math.isclose(raw, machine.bias + machine.linear[places] @ values + pairs, rel_tol=1e-9)


def test_quality_is_learnt(spark):
    docs, labels = _labelled(spark, "$$$ ### %%%")
    machine = training.fitted(docs, labels, "quality", quality.PER_CLASS, ("text", "n_chars"), quality.fit_frame)
    found = toxicity.with_fold(quality.score(docs, machine)).toPandas()
    held = found[found["held_out"] & (found["doc_id"] < 400)]
    assert ((held["doc_id"] % 4 != 0) == (held["predicted"] == 1)).mean() > 0.97
    assert len(found) == docs.count() and found["score"].between(0, 1).all()
    assert quality.score(docs.drop("n_chars").limit(3), machine).count() == 3


def test_rollup_is_additive_and_idempotent(spark, docs):
    counted = tokens.piece_counts(docs.select("doc_id", "source", "lang", "text")).withColumn("fixed", F.col("pieces") + F.lit(1))
    rollup = tokens.Rollup(spark, scratch_path(spark, "rollup"))
    assert rollup.commit(0, tokens.inserts(counted, "v1", "pieces"))
    gone = tokens.deletes(counted.where("source = 'hub'"), "v1", "pieces")
    assert rollup.commit(1, gone) and not rollup.commit(1, gone)
    left = counted.where("source is null or source <> 'hub'")
    assert rollup.commit(2, tokens.revisions(left, "v1", "pieces", "fixed"))
    assert rollup.commit(3, gone.limit(0))
    key = ["source", "lang"]
    found = rollup.totals().toPandas().sort_values(key, ignore_index=True)
    truth = left.groupBy(*key).agg(F.count("*").alias("documents"), F.sum("fixed").alias("tokens")).toPandas().sort_values(key, ignore_index=True)
    assert found[[*key, "documents", "tokens"]].equals(truth)
    assert (found["tokenizer"] == "v1").all()


def test_archives_round_trip(spark):
    same = "<p>" + "x" * 200 + "</p>"
    rows = [(5, "https://a.b.org/x#top", same), (3, "http://B.org", same), (9, None, same), (4, "odd\r\nurl", "short"), (8, "http://b.org/é", "short"),
            (1, "http://b.org/", None), (2, "http://b.org/", ""), (None, "http://b.org/", "ü" * 60 + "\r\n\r\nWARC/1.1\r\n"), (7, "http://b.org/", "WARC/1.1\r\n\r\n" * 20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("bytes", F.lit(0)).withColumn("digest", F.lit("d"))
    found = warc.archive_round_trip(pages).toPandas().sort_values("position")
    assert len(found) == len(rows) and found["intact"].all() and list(found["position"]) == list(range(len(rows)))
    by_id = found.set_index(found["page_id"].fillna(-1).astype(int))
    assert by_id.loc[3, "record_type"] == "response" and {int(by_id.loc[k, "refers_to"]) for k in (5, 9)} == {3}
    assert (by_id.loc[[1, 2, 4, 8, 7, -1], "record_type"] == "response").all()
    assert by_id.loc[-1, "payload_bytes"] == len(("ü" * 60 + "\r\n\r\nWARC/1.1\r\n").encode())
    keys = list(zip(found["urlkey"], found["captured"], strict=True))
    assert keys == sorted(keys) and by_id.loc[5, "urlkey"] == "org,b,a)/x" and by_id.loc[3, "urlkey"] == "org,b)/"
    assert warc.archive_round_trip(pages.limit(0)).isEmpty()


def test_many_ranges_make_one_order(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_RECORDS", 40)
    pages = spark.range(900).select(F.col("id").alias("page_id"), F.when(F.col("id") % 3 == 0, "http://hot.org/").otherwise(
        F.concat(F.lit("http://h"), F.col("id") % 17, F.lit(".org/"))).alias("url"), F.lit("").alias("html"))
    path = scratch_path(spark, "many")
    warc.write_archives(pages, path)
    found = warc.merge_runs(warc.sorted_runs(spark, path), range_rows=64).toPandas().sort_values("position")
    keys = list(zip(found["urlkey"], found["captured"], found["page_id"], strict=True))
    assert keys == sorted(keys) and list(found["position"]) == list(range(900)) and found["run"].nunique() > 8


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_loser_tree_merges(k):
    rng = random.Random(k)
    runs = [sorted((rng.randrange(30),) for _ in range(rng.randrange(12))) for _ in range(k)]
    assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_an_archive_is_standard(spark):
    path = scratch_path(spark, "standard")
    warc.write_archives(spark.createDataFrame([(1, "http://a/", "<p>é</p>")], "page_id long, url string, html string").coalesce(1), path)
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).first()["content"]
    raw = gzip.decompress(bytes(content))
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and raw.endswith("<p>é</p>\r\n\r\n".encode())
    ((offset, length, header, block),) = warc.read_records(io.BytesIO(raw))
    assert offset == 0 and length == len(raw) - 4 and int(header["Content-Length"]) == len(block)


def test_word_hashes_depend_on_the_word_alone(monkeypatch):
    once = text.token_hashes("One two, ONE; drei-Öl öl _x9 two")
    assert once[0] == once[2] and once[1] == once[7] and once[4] == once[5] and len(set(once.tolist())) == 5
    long = "alpha beta gamma " * 500
    whole = text.token_hashes(long)
    monkeypatch.setattr(text, "PIECE", 37)
    assert (text.token_hashes(long) == whole).all() and len(text.token_hashes(None)) == len(text.token_hashes(" .,")) == 0


def test_a_rollup_counts_committed_batches_only(spark, tmp_path):
    path = str(tmp_path / "rollup")
    rollup = tokens.Rollup(spark, path, fold_every=3)
    change = lambda *rows: spark.createDataFrame([(s, "en", "t", d, n) for s, d, n in rows], "source string, lang string, tokenizer string, documents long, tokens long")
    assert rollup.totals().collect() == []
    for batch in range(8):
        assert rollup.commit(batch, change(("a", 1, batch), (None, 1, 10)))
    assert not rollup.commit(1, change(("a", 1, 0), (None, 1, 10), ("a", 0, 1)))
    with pytest.raises(ValueError, match="batch 1"):
        rollup.commit(1, change(("a", 1, 2), (None, 1, 10)))
    # A batch whose job did not end is no part of the totals.
    change(("a", 100, 100)).write.parquet(f"{path}/batch=9")
    (tmp_path / "rollup" / "batch=9" / "_SUCCESS").unlink()
    assert {(r["source"], r["documents"], r["tokens"]) for r in rollup.totals().collect()} == {("a", 8, 28), (None, 8, 80)}
    assert rollup._folded()["batches"] == list(range(6)) and rollup._pending(rollup._folded()) == [6, 7]


def test_a_sample_of_repeated_ids_stays_bounded(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(3000)] + [(k, f"other {k}") for k in range(2, 400)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1 if k == 1 else 0) for k in range(400)], "doc_id long, toxic int")
    sample = training.labelled_sample(docs, labels, "toxic", {0: 10, 1: 10}, ("text",)).toPandas()
    assert len(sample) <= 80


def test_a_dictionary_reads_across_its_texts():
    text = bytes(range(97, 123)) * 1000
    found = language.spread(text, 800)
    assert len(found) <= 820 and all(text[k:k + 100] in text for k in (0, len(text) - 100))
    long = b"a" * 9000 + b"b" * 9000 + b"c" * 9000
    assert {bytes([c]) for c in language.spread(long, 90)} >= {b"a", b"b", b"c"}
    assert language.spread(b"short", 800) == b"short"


def test_clean_chains_teach_wherever_they_stand(monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "CHAIN", 4)
    monkeypatch.setattr(toxicity, "traits", lambda word: seen.append(word) or (1,))
    texts = [" ".join(f"w{k}" for k in range(120)), "bad bad bad"]
    toxicity.fit(texts, np.array([0, 1]), rounds=1)
    places = sorted(int(w[1:]) // 4 for w in set(seen) if w.startswith("w"))
    assert len(set(places)) >= 9 and max(places) >= 25
