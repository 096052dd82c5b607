"""Quality by a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import CACHE_WORDS

#: Labelled documents per class that the machine is fitted on.
PER_CLASS = {0: 2500, 1: 2500}
WORD_BITS = 16
#: Bins of a statistic, by quantiles of the sample.
BINS = 10
FACTORS = 8
#: Words scored at once by a task.
BLOCK_WORDS = 400_000
_UPPER, _ODD, _DIGIT = re.compile(r"[^\W\d_a-zß-öø-ÿ]"), re.compile(r"[^\w\s]"), re.compile(r"\d")
STATISTICS = ("characters", "words", "word_length", "distinct", "top_word", "repeats", "upper", "odd", "digits", "lines", "line_repeats", "n_chars")


def statistics(text: str, words: list[str], counts: Counter, n_chars: float) -> list[float]:
    size, n = max(1, len(text)), max(1, len(words))
    lines = text.split("\n")
    return [
        np.log1p(len(text)), np.log1p(len(words)), len(text) / n, len(counts) / n, max(counts.values(), default=0) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, len(_UPPER.findall(text)) / size, len(_ODD.findall(text)) / size,
        len(_DIGIT.findall(text)) / size, len(lines) / n, 1 - len(set(lines)) / len(lines),
        -1.0 if n_chars is None or np.isnan(n_chars) else np.log1p(max(0.0, n_chars)),
    ]


class Slots(dict):
    """word -> its hashed feature."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = zlib.crc32(word.encode("utf-8", "replace")) & ((1 << WORD_BITS) - 1)
        return value


def features(text: str | None, n_chars: float, slots: Slots) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Hashed words, their values (unit length together) and the statistics; a null text is the empty one."""
    text = text if isinstance(text, str) else ""
    words = text.split()
    counts = Counter(words)
    place = np.fromiter(map(slots.__getitem__, counts), np.int64, len(counts))
    value = np.sqrt(np.fromiter(counts.values(), np.float64, len(counts)))
    norm = np.sqrt((value * value).sum())
    return place, value / norm if norm else value, statistics(text, words, counts, n_chars)


class Machine:
    """y = bias + sum w x + half of the sum over factors of (sum v x)^2 - sum (v x)^2: linear in the number of features."""

    def __init__(self, edges: np.ndarray, seed: int = 11) -> None:
        self.edges = edges
        size = (1 << WORD_BITS) + len(STATISTICS) * BINS
        self.bias, self.linear = 0.0, np.zeros(size)
        self.factors = np.random.default_rng(seed).normal(0, 0.02, (size, FACTORS))

    def bins(self, stats: list[float]) -> np.ndarray:
        return np.array([(1 << WORD_BITS) + k * BINS + int(np.searchsorted(self.edges[k], s)) for k, s in enumerate(stats)])

    def rows(self, found: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features of several texts end to end: places, values, first place of each."""
        places, values = [], []
        for place, value, stats in found:
            places += [self.bins(stats), place]
            values += [np.full(len(stats), 0.5), value]
        ends = np.cumsum([len(f[0]) + len(f[2]) for f in found])
        return np.concatenate(places), np.concatenate(values), np.concatenate([[0], ends[:-1]])

    def raw(self, places: np.ndarray, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = self.factors[places] * values[:, None]
        sums = np.add.reduceat(parts, starts)
        squares = np.add.reduceat(parts * parts, starts)
        return (self.bias + np.add.reduceat(self.linear[places] * values, starts) + 0.5 * (sums ** 2 - squares).sum(1)), parts, sums

    def score(self, found: list[tuple]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(*self.rows(found))[0], -30, 30)))


def fit(texts: list[str | None], n_chars: np.ndarray, label: np.ndarray, rounds: int = 8, batch: int = 128, rate: float = 0.1) -> Machine:
    """Logistic loss by AdaGrad; without labels of both classes every score is the only class's."""
    slots = Slots()
    found = [features(t, c, slots) for t, c in zip(texts, n_chars, strict=True)]
    stats = np.array([f[2] for f in found]) if found else np.zeros((0, len(STATISTICS)))
    cuts = np.arange(1, BINS) / BINS
    edges = np.quantile(stats, cuts, axis=0).T if len(stats) else np.zeros((len(STATISTICS), BINS - 1))
    machine = Machine(edges)
    if not len(label) or label.min() == label.max():
        machine.bias, machine.factors[:] = (30.0 if len(label) and label.min() else -30.0 if len(label) else 0.0), 0.0
        return machine
    order = np.random.default_rng(3)
    speed_w, speed_v, speed_b = np.full(len(machine.linear), 1e-4), np.full(machine.factors.shape, 1e-4), 1e-4
    for _ in range(rounds):
        shuffled = order.permutation(len(found))
        for k in range(0, len(found), batch):
            b = shuffled[k:k + batch]
            places, values, starts = machine.rows([found[i] for i in b])
            y, parts, sums = machine.raw(places, values, starts)
            wrong = label[b] - 1 / (1 + np.exp(-np.clip(y, -30, 30)))
            lengths = np.diff(np.append(starts, len(places)))
            each = np.repeat(wrong, lengths) * values
            used, back = np.unique(places, return_inverse=True)
            slope = np.bincount(back, each) / len(b) - 1e-5 * machine.linear[used]
            speed_w[used] += slope ** 2
            machine.linear[used] += rate * slope / np.sqrt(speed_w[used])
            pull = each[:, None] * (np.repeat(sums, lengths, axis=0) - parts)
            for f in range(FACTORS):
                slope = np.bincount(back, pull[:, f]) / len(b) - 1e-4 * machine.factors[used, f]
                speed_v[used, f] += slope ** 2
                machine.factors[used, f] += 0.5 * rate * slope / np.sqrt(speed_v[used, f])
            drift = wrong.mean()
            speed_b += drift ** 2
            machine.bias += rate * drift / np.sqrt(speed_b)
    return machine


def fit_frame(frame: pd.DataFrame) -> Machine:
    return fit(list(frame["text"]), frame["n_chars"].astype(float).to_numpy(), frame["label"].to_numpy().astype(int))


def score(docs: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted of every row, over the whole text.

    A null text counts as empty, a null n_chars is a bin of its own, and the column may be missing. An empty table gives no row."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine, slots = shared.value, Slots()
        for batch in batches:
            ids, found, size = [], [], 0
            for doc_id, text, n_chars in zip(batch["doc_id"], batch["text"], batch["n_chars"], strict=True):
                ids.append(None if pd.isna(doc_id) else int(doc_id))
                found.append(features(text, n_chars, slots))
                size += len(found[-1][0])
                if size >= BLOCK_WORDS:
                    yield pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "score": machine.score(found)})
                    ids, found, size = [], [], 0
            if ids:
                yield pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "score": machine.score(found)})

    n_chars = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), n_chars.alias("n_chars"))
    return rows.mapInPandas(run, "doc_id long, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
