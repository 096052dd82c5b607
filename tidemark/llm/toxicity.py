"""Toxic spans by a linear-chain conditional random field; its marginals give document scores."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.language import held_out
from tidemark.llm.text import CACHE_WORDS, WORD

#: Labelled documents per class that the field is fitted on; clean ones are the rule.
PER_CLASS = {0: 6000, 1: 2000}
BITS = 18
#: Tokens in one row of a task's arrays: a longer text takes consecutive rows, with messages over the cuts.
CHAIN = 128
#: Relative change below which a message counts as the same.
SAME = 1e-12
#: Tokens forwarded at once by a task.
BLOCK_TOKENS = 200_000
PREFIX, SUFFIX = 5, 4


def traits(word: str) -> tuple[int, ...]:
    """Hashed traits of a token: the word, its beginning and its end."""
    word = word.lower()
    found = [f"w:{word}"]
    if len(word) > PREFIX:
        found.append(f"p:{word[:PREFIX]}")
    if len(word) > SUFFIX:
        found.append(f"s:{word[-SUFFIX:]}")
    return tuple(zlib.crc32(t.encode("utf-8", "replace")) & ((1 << BITS) - 1) for t in found)


def as_chains(values: np.ndarray, fill: float) -> np.ndarray:
    """Rows of CHAIN values; the last is filled up."""
    rows = -(-len(values) // CHAIN)
    out = np.full(rows * CHAIN, fill, values.dtype)
    out[:len(values)] = values
    return out.reshape(rows, CHAIN)


def forward_ratios(emit: np.ndarray, psi: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Forward messages (length x chains) as the ratio toxic to clean; `before` is the ratio ahead of the first token."""
    out, ratio = np.empty_like(emit), before
    for t in range(len(emit)):
        ratio = out[t] = emit[t] * (psi[0, 1] + psi[1, 1] * ratio) / (psi[0, 0] + psi[1, 0] * ratio)
    return out


def backward_ratios(emit: np.ndarray, psi: np.ndarray, used: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Backward messages as ratios; `after` is the ratio behind the last place, 1 where the text ends."""
    out = np.empty_like(emit)
    out[-1] = after
    for t in range(len(emit) - 2, -1, -1):
        ahead = emit[t + 1] * out[t + 1]
        out[t] = np.where(used[t + 1], (psi[1, 0] + psi[1, 1] * ahead) / (psi[0, 0] + psi[0, 1] * ahead), 1.0)
    return out


def forward_backward(odds: np.ndarray, used: np.ndarray, moves: np.ndarray, pairs_too: bool = False,
                     goes_on: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """P(toxic) per token and, if asked for, the expected moves (2 x 2), for chains of log odds; unused places come last in a chain.

    `goes_on` flags rows that continue the row before, which is full. Messages then pass the cuts: rows whose message from
    outside changed are passed again until none changes, so a text cut into rows has the marginals of one chain. A row's
    first message forgets what lies far away, so this takes two or three passes."""
    psi, used_at = np.exp(moves), used.T
    emit = np.exp(np.clip(odds, -20, 20)).T
    n = emit.shape[1]
    forward = forward_ratios(emit, psi, np.zeros(n))
    back = backward_ratios(emit, psi, used_at, np.ones(n))
    if goes_on is not None and goes_on.any():
        later = np.flatnonzero(goes_on)
        before, after, todo = np.zeros(n), np.ones(n), later
        while len(todo):
            new = forward[-1, todo - 1]
            changed = np.abs(new - before[todo]) > SAME * new
            todo = todo[changed]
            before[todo] = new[changed]
            forward[:, todo] = forward_ratios(emit[:, todo], psi, before[todo])
            todo = todo[todo + 1 < n] + 1
            todo = todo[goes_on[todo]]
        todo = later - 1
        while len(todo):
            ahead = emit[0, todo + 1] * back[0, todo + 1]
            new = (psi[1, 0] + psi[1, 1] * ahead) / (psi[0, 0] + psi[0, 1] * ahead)
            changed = np.abs(new - after[todo]) > SAME * new
            todo = todo[changed]
            after[todo] = new[changed]
            back[:, todo] = backward_ratios(emit[:, todo], psi, used_at[:, todo], after[todo])
            todo = todo[goes_on[todo]] - 1
    both = forward * back
    toxic = (both / (1 + both)).T * used
    expected = np.zeros((2, 2))
    if not pairs_too:
        return toxic, expected
    now, ahead = forward[:-1], emit[1:] * back[1:]
    cells = (np.broadcast_to(psi[0, 0], now.shape), psi[0, 1] * ahead, psi[1, 0] * now, psi[1, 1] * now * ahead)
    share = used_at[1:] / (cells[0] + cells[1] + cells[2] + cells[3])
    return toxic, np.array([(cell * share).sum() for cell in cells]).reshape(2, 2)


def weak_tags(tokens: list[list[str]], label: np.ndarray) -> list[np.ndarray]:
    """Token labels from document labels: in a toxic document, tokens with a trait far commoner among toxic documents.

    A toxic document without any has its most suspicious token tagged."""
    seen = {0: Counter(), 1: Counter()}
    of_word: dict[str, tuple[int, ...]] = {}
    for words, toxic in zip(tokens, label, strict=True):
        found = set()
        for word in set(words):
            if word not in of_word:
                of_word[word] = traits(word)
            found.update(of_word[word])
        seen[int(toxic)].update(found)
    docs = np.bincount(label.astype(int), minlength=2)
    strength = {trait: np.log((n + 0.5) / (docs[1] + 1)) - np.log((seen[0][trait] + 0.5) / (docs[0] + 1))
                for trait, n in seen[1].items() if n >= 4 and n / (docs[1] + 1) > 8 * seen[0][trait] / (docs[0] + 1)}
    tags = []
    for words, toxic in zip(tokens, label, strict=True):
        if not toxic:
            tags.append(np.zeros(len(words)))
            continue
        score = np.array([max((strength.get(t, 0.0) for t in of_word[w][:2]), default=0.0) for w in words])
        tag = score >= 3.0
        if len(words) and not tag.any() and score.max() > 1:
            tag[score.argmax()] = True
        tags.append(tag.astype(np.float64))
    return tags


class Field:
    """Trait weights, a bias, moves between the two states and a logistic layer over document summaries."""

    def __init__(self) -> None:
        self.weights, self.bias = np.zeros(1 << BITS), 0.0
        self.moves = np.zeros((2, 2))
        self.layer, self.prior = np.zeros(4), 0.0

    def odds(self, word: str) -> float:
        return self.bias + float(sum(self.weights[t] for t in traits(word)))

    @staticmethod
    def summary(toxic: np.ndarray) -> np.ndarray:
        """Constant, largest marginal, log of the expected toxic tokens, and their share."""
        if not len(toxic):
            return np.array([1.0, 0.0, 0.0, 0.0])
        sure = np.where(toxic > 0.05, toxic, 0.0)
        return np.array([1.0, toxic.max(), np.log1p(sure.sum()), min(1.0, 20 * sure.mean())])

    def score(self, toxic: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.summary(toxic) @ self.layer, -30, 30))))


def fit(texts: list[str | None], label: np.ndarray, rounds: int = 7, batch: int = 256, rate: float = 0.2) -> Field:
    """Conditional likelihood of the weak tags by AdaGrad with a small L2 penalty; then the document layer by Newton steps."""
    field = Field()
    if not len(label) or label.min() == label.max():
        field.layer[0] = 30.0 if len(label) and label.min() else -30.0
        return field
    tokens = [WORD.findall(t) if isinstance(t, str) else [] for t in texts]
    chains, clean = [], 0
    for words, tag in zip(tokens, weak_tags(tokens, label), strict=True):
        for k in range(0, len(words), CHAIN):
            # All chains with a toxic token teach, and every third of the others, wherever in its text it stands.
            toxic = tag[k:k + CHAIN].any()
            clean += not toxic
            if toxic or clean % 3 == 1:
                chains.append((words[k:k + CHAIN], tag[k:k + CHAIN]))
    if not chains:
        field.layer[0] = -30.0
        return field
    order = np.random.default_rng(7)
    width = 3
    place = np.zeros((len(chains), CHAIN, width), np.int32)
    has = np.zeros((len(chains), CHAIN, width), bool)
    target, used = np.zeros((len(chains), CHAIN)), np.zeros((len(chains), CHAIN), bool)
    known: dict[str, tuple[int, ...]] = {}
    for c, (words, tag) in enumerate(chains):
        for k, word in enumerate(words):
            found = known.get(word) or known.setdefault(word, traits(word))
            place[c, k, :len(found)] = found
            has[c, k, :len(found)] = True
        target[c, :len(words)], used[c, :len(words)] = tag, True
    field.bias = -4.0
    speed, move_speed, bias_speed = np.full(1 << BITS, 1e-2), np.full((2, 2), 1e-2), 1e-2
    # A small sample takes more rounds to as many steps.
    for _ in range(max(rounds, -(-240 * batch // len(chains)))):
        shuffled = order.permutation(len(chains))
        for k in range(0, len(chains), batch):
            b = shuffled[k:k + batch]
            odds = (field.weights[place[b]] * has[b]).sum(2) + field.bias
            toxic, expected = forward_backward(odds, used[b], field.moves, pairs_too=True)
            wrong = (target[b] - toxic) * used[b]
            slope = np.bincount(place[b][has[b]], np.broadcast_to(wrong[:, :, None], has[b].shape)[has[b]], 1 << BITS)
            hit = slope != 0
            slope[hit] -= 1e-3 * field.weights[hit]
            speed[hit] += slope[hit] ** 2
            field.weights[hit] += rate * slope[hit] / np.sqrt(speed[hit])
            y = target[b].astype(int)
            pairs = used[b][:, 1:]
            seen = np.bincount((2 * y[:, :-1] + y[:, 1:])[pairs], minlength=4).reshape(2, 2)
            turn = (seen - expected) / len(b)
            move_speed += turn ** 2
            field.moves += rate * turn / np.sqrt(move_speed)
            drift = wrong.sum() / len(b)
            bias_speed += drift ** 2
            field.bias += rate * drift / np.sqrt(bias_speed)
    cache = {word: field.odds(word) for word in set().union(*tokens)}
    odds = [np.fromiter(map(cache.__getitem__, words), np.float64, len(words)) for words in tokens]
    x = np.array([field.summary(toxic) for toxic in marginals(odds, field)])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ field.layer, -30, 30)))
        bend = x.T @ (x * (p * (1 - p) + 1e-6)[:, None]) + 0.05 * np.eye(4)
        field.layer += np.linalg.solve(bend, x.T @ (label - p) - 0.05 * field.layer)
    return field


def fit_frame(frame: pd.DataFrame) -> Field:
    return fit(list(frame["text"]), frame["label"].to_numpy().astype(int))


def marginals(texts: list[np.ndarray], field: Field) -> Iterator[np.ndarray]:
    """Marginals of each text, passed BLOCK_TOKENS or more at a time; every text is one chain, however long."""
    held, size = [], 0
    for k, odds in enumerate(texts):
        held.append(odds)
        size += len(odds)
        if size < BLOCK_TOKENS and k < len(texts) - 1:
            continue
        rows = [as_chains(o, 0.0) for o in held]
        used = np.concatenate([as_chains(np.ones(len(o)), 0.0) for o in held]) > 0
        goes_on = np.concatenate([np.arange(len(r)) > 0 for r in rows])
        toxic = forward_backward(np.concatenate(rows), used, field.moves, goes_on=goes_on)[0] if size else np.zeros((0, CHAIN))
        at = 0
        for odds_of, r in zip(held, rows, strict=True):
            yield toxic[at:at + len(r)].reshape(-1)[:len(odds_of)]
            at += len(r)
        held, size = [], 0


class OddsCache(dict):
    def __init__(self, field: Field) -> None:
        super().__init__()
        self.field = field

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = self.field.odds(word)
        return value


def spans(text: str, toxic: np.ndarray) -> list[dict]:
    """Runs of tokens more likely toxic than not, as character offsets with their largest marginal."""
    found: list[dict] = []
    last = -2
    for k, match in enumerate(WORD.finditer(text)):
        if toxic[k] >= 0.5:
            if last == k - 1:
                found[-1]["end"], found[-1]["score"] = match.end(), max(found[-1]["score"], float(toxic[k]))
            else:
                found.append({"start": match.start(), "end": match.end(), "score": float(toxic[k])})
            last = k
    return found


def tag(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, score, predicted and the offending spans (character offsets) of every row, over the whole text.

    A null or empty text has the score of a text without toxic tokens and no span; repeated rows are scored each, a null id
    stays null, other columns of `docs` are not read. An empty table gives no row."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        field = shared.value
        cache = OddsCache(field)

        def flush(held: list[tuple]) -> pd.DataFrame:
            rows = []
            for (doc_id, text, _), own in zip(held, marginals([odds for _, _, odds in held], field), strict=True):
                score = field.score(own)
                rows.append((doc_id, score, int(score >= 0.5), spans(text, own) if len(own) and own.max() >= 0.5 else []))
            out = pd.DataFrame(rows, columns=["doc_id", "score", "predicted", "spans"])
            return out.astype({"doc_id": "Int64"})

        for batch in batches:
            held, size = [], 0
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                found = WORD.findall(text) if isinstance(text, str) else []
                held.append((None if pd.isna(doc_id) else int(doc_id), text, np.fromiter(map(cache.__getitem__, found), np.float64, len(found))))
                size += len(found)
                if size >= BLOCK_TOKENS:
                    yield flush(held)
                    held, size = [], 0
            if held:
                yield flush(held)

    schema = "doc_id long, score double, predicted int, spans array<struct<start:int,end:int,score:double>>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, schema)


def with_fold(scored: DataFrame) -> DataFrame:
    return scored.withColumn("held_out", held_out(F.col("doc_id")))
