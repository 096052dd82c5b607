"""Benchmark decontamination by latent semantic retrieval: a randomised SVD of the TF-IDF vectors of item parts and of all passages
of all documents gives the space in which candidate passages are found by cosine; longest common subsequences and answer checks
decide about them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import TABLE_BITS, cells, inverse_frequency, token_hashes, word_frequencies
from tidemark.session import through_table

#: Words from one passage of the fit to the next; a passage is two strides long.
STRIDE = 24
#: Passages whose word pairs a task sums in single precision before they are multiplied out.
GRAM_PASSAGES = 1 << 18
#: What an item part counts in the fit, against the mean of all passages.
ITEM_WEIGHT = 200.0
#: Item parts per latent space, and dimensions kept: more than parts, so that none is lost to others.
SPACE_PARTS = 256
RANK = 288
POWER_ROUNDS = 2
#: Most words of an item part, and the least share of a part's threshold that makes a word's product with it count.
PART_WORDS = 48
ASSOCIATED = 0.02
#: Least common subsequence by item length, alone and with a matching answer.
SUBSEQUENCE, WITH_ANSWER, ANSWER = 0.7, 0.5, 0.8
#: Words searched at once by a task; longer texts are read in stretches that overlap by the longest region.
CHUNK = 200_000
#: Bytes of benchmark text searched in one pass over the documents (some 300 MB of spaces); larger ones take more passes.
PASS_BYTES = 2 << 20


def _bits(item: list[int]) -> dict[int, int]:
    places: dict[int, int] = {}
    for k, word in enumerate(item):
        places[word] = places.get(word, 0) | (1 << k)
    return places


def _subsequence(hits: list[int], size: int) -> int:
    full = (1 << size) - 1
    row = full
    for places in hits:
        hit = row & places
        row = ((row + hit) | (row - hit)) & full
    return size - row.bit_count()


def common_subsequence(item: list[int], text: list[int]) -> int:
    """Length of the longest common subsequence; one big-integer step per word of `text`."""
    places = _bits(item)
    return _subsequence([places[word] for word in text if word in places], len(item))


class Items:
    """Benchmark items and the checks that decide about a region of a text."""

    def __init__(self, items: list[tuple[int, np.ndarray]]) -> None:
        self.ids = [i for i, _ in items]
        self.tokens = [t for _, t in items]
        size = np.array([len(t) for t in self.tokens])
        self.need = np.ceil(size * WITH_ANSWER).astype(np.int64)
        #: Regions start every half item and are one and a half items long.
        self.step, self.reach = np.maximum(1, size // 2), size + size // 2
        self.bits: dict[int, tuple[dict, dict]] = {}

    def check(self, item: int, region: list[int]) -> tuple[float, float] | None:
        """(share in the subsequence, share of the answer) where they are large enough, else None. The answer is the last
        third of the item, and its words must come in order too."""
        if item not in self.bits:
            if len(self.bits) >= 4096:
                self.bits.clear()
            words = self.tokens[item].tolist()
            self.bits[item] = _bits(words), _bits(words[-max(3, len(words) // 3):])
        words, answer = self.bits[item]
        hits = [word for word in region if word in words]
        if len(hits) < self.need[item]:
            return None
        size = len(self.tokens[item])
        share = _subsequence([words[word] for word in hits], size) / size
        if share < WITH_ANSWER:
            return None
        size = min(size, max(3, size // 3))
        replied = _subsequence([answer[word] for word in hits if word in answer], size) / size
        return (share, replied) if share >= SUBSEQUENCE or replied >= ANSWER else None


class Part:
    """A stretch of an item as a TF-IDF vector over its rarer words, and the product that a passage must reach.

    A region that is accepted holds `need` words of the part or more (WITH_ANSWER of it; of an item's parts, one does), so it
    holds `least` of the `size - need + least` rarest of them, whichever it lacks and however many others stand in it. Their
    least weights sum to the threshold: as a cosine, it is that sum over the lengths of part and passage. A passage is as long
    as the regions of a whole item, and twice a part where the item has several."""

    def __init__(self, item: int, tokens: np.ndarray, whole: bool, table: np.ndarray, idf: np.ndarray) -> None:
        size = len(tokens)
        self.item, self.passage = item, size + size // 2 if whole else 2 * size
        need = math.ceil(size * WITH_ANSWER)
        least = min(need, 1 + size // 8)
        rare = tokens[np.argsort(table[cells(tokens)], kind="stable")[:size - need + least]]
        self.words = np.unique(rare)
        self.threshold = float(np.sort(idf[cells(rare)].astype(np.float64) ** 2)[:least].sum())


def item_parts(items: list[tuple[int, np.ndarray]], table: np.ndarray, idf: np.ndarray) -> list[Part]:
    """Parts of equal length, at most PART_WORDS, of every item."""
    found = []
    for item, (_, tokens) in enumerate(items):
        parts = np.array_split(tokens, math.ceil(len(tokens) / PART_WORDS))
        found += [Part(item, part, len(parts) == 1, table, idf) for part in parts]
    return found


def _search(words: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    found = np.minimum(np.searchsorted(words, tokens), len(words) - 1)
    return np.where(words[found] == tokens, found, -1)


class Space:
    """Vocabulary of some item parts, their latent vectors and the projection of words."""

    def __init__(self, parts: list[Part], idf: np.ndarray) -> None:
        self.parts = parts
        self.vocabulary = np.unique(np.concatenate([p.words for p in parts]))
        self.idf = idf[cells(self.vocabulary)].astype(np.float64)
        self.lengths = np.array([_length(p.words, idf) for p in parts])
        self.words = np.zeros((len(self.vocabulary), 1), np.float32)
        self.latent = np.zeros((len(parts), 1), np.float32)

    def places(self, tokens: np.ndarray) -> np.ndarray:
        """Vocabulary place of each token, -1 for others."""
        return _search(self.vocabulary, tokens)

    def part_rows(self) -> np.ndarray:
        rows = np.zeros((len(self.parts), len(self.vocabulary)))
        for row, part, length in zip(rows, self.parts, self.lengths, strict=True):
            at = self.places(part.words)
            row[at] = self.idf[at] / length
        return rows

    def project(self, basis: np.ndarray) -> None:
        self.words = (basis * self.idf[:, None]).astype(np.float32)
        self.latent = (self.part_rows() @ basis).astype(np.float32)

    def cosine(self, part: int, region: np.ndarray, idf: np.ndarray) -> float:
        at = self.places(region)
        product = float(self.latent[part] @ self.words[at[at >= 0]].sum(axis=0)) / _length(region, idf)
        return max(0.0, min(1.0, product))


def _length(tokens: np.ndarray, idf: np.ndarray) -> float:
    """Length of the TF-IDF vector of some words."""
    _, first, counts = np.unique(tokens, return_index=True, return_counts=True)
    return math.sqrt(float(((counts * idf[cells(tokens[first])].astype(np.float64)) ** 2).sum()))


class Vocabulary:
    """Words of some spaces, and the passages of texts as TF-IDF vectors over them."""

    def __init__(self, spaces: list[Space], idf: np.ndarray) -> None:
        self.words, self.idf = np.unique(np.concatenate([s.vocabulary for s in spaces])), idf
        self.short = self.words >> np.uint64(20)
        self.place_of_cell = np.full(1 << TABLE_BITS, -1, np.int32)
        self.place_of_cell[cells(self.words)] = np.arange(len(self.words))

    def passages(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(known words of each passage that has any, their places in order, their weights, number of all passages) of stretches
        of texts, of fewer than 2^20 passages together. A passage starts every STRIDE words; weights are over its length as a vector
        of all its words. Words are told apart by 44 bits."""
        sizes = np.array([len(t) for t in texts])
        number = np.where(sizes > 0, np.maximum(1, -(-(sizes - STRIDE) // STRIDE)), 0)
        first = np.cumsum(number) - number
        stride = (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)) // STRIDE
        word = np.concatenate(texts) >> np.uint64(20)
        inside, before = stride < np.repeat(number, sizes), stride > 0
        place = np.repeat(first, sizes) + stride
        keys = np.concatenate([(place[inside].astype(np.uint64) << np.uint64(44)) | word[inside],
                               ((place[before] - 1).astype(np.uint64) << np.uint64(44)) | word[before]])
        keys.sort()
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        row, word = (keys[starts] >> np.uint64(44)).astype(np.int64), keys[starts] & np.uint64((1 << 44) - 1)
        cell = (word >> np.uint64(44 - TABLE_BITS)).astype(np.int32)
        weight = np.diff(np.append(starts, len(keys))) * self.idf[cell].astype(np.float64)
        length = np.sqrt(np.bincount(row, weight ** 2, int(number.sum())))
        at = self.place_of_cell[cell]
        maybe = np.flatnonzero(at >= 0)
        wrong = maybe[self.short[at[maybe]] != word[maybe]]
        at[wrong] = _search(self.short, word[wrong])
        known = at >= 0
        row, at = row[known], at[known]
        counts = np.bincount(row, minlength=int(number.sum()))
        return counts[counts > 0].astype(np.uint8), at.astype(np.int32), (weight[known] / length[row]).astype(np.float32), int(number.sum())


def passage_table(docs: DataFrame, spaces: list[Space], idf: np.ndarray) -> DataFrame:
    """The passages of all texts, whole, over the words of all spaces: written once, read by every round of every space."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(spaces, idf))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, held, size = shared.value, [], 0

        def rows() -> pd.DataFrame:
            counts, places, weights, passages = vocabulary.passages(held)
            return pd.DataFrame({"counts": [counts.tobytes()], "places": [places.tobytes()], "weights": [weights.tobytes()], "passages": [passages]})

        for batch in batches:
            for text in batch["text"]:
                tokens = token_hashes(text)
                # Stretches of a longer text share a stride, so that each passage is in one of them.
                step = CHUNK // STRIDE * STRIDE
                for start in range(0, max(1, len(tokens) - STRIDE), step) if len(tokens) else ():
                    held.append(tokens[start:start + step + STRIDE])
                    size += len(held[-1])
                    if size >= CHUNK:
                        yield rows()
                        held, size = [], 0
        if held:
            yield rows()

    texts = docs.select(F.col("text").cast("string").alias("text"))
    return through_table(texts.mapInPandas(run, "counts binary, places binary, weights binary, passages long"), "passages")


class Gram:
    """Products of words that stand in one passage, summed over passages: a square of the words of a space (at most 31 a part)."""

    def __init__(self, size: int) -> None:
        self.sums, self.passages = np.zeros((size, size), np.float32), 0

    def add(self, counts: np.ndarray, places: np.ndarray, weights: np.ndarray) -> None:
        """Passages of equal count together; places are in order, so that pairs fall on one side of the diagonal."""
        starts, size, sums = np.cumsum(counts) - counts, len(self.sums), self.sums.reshape(-1)
        self.passages += len(counts)
        for count in np.unique(counts[counts > 0]).tolist():
            at = starts[counts == count][:, None] + np.arange(count)
            place, weight = places[at], weights[at]
            for gap in range(count):
                np.add.at(sums, (place[:, :count - gap] * size + place[:, gap:]).reshape(-1), (weight[:, :count - gap] * weight[:, gap:]).reshape(-1))

    def times(self, basis: np.ndarray) -> np.ndarray:
        """The product with a basis; the sums begin anew."""
        found = self.sums @ basis + self.sums.T @ basis - np.diagonal(self.sums)[:, None] * basis
        self.sums[:], self.passages = 0, 0
        return found


def gram_times(passages: DataFrame, places: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A^T A Q for all passages A, with the words of a space at `places` of the vocabulary (-1: not in the space).

    Every task returns its passages' share in blocks of words, which are summed on executors; the driver gets a words x rank
    matrix, whose size depends on the benchmark alone."""
    shared, block = passages.sparkSession.sparkContext.broadcast((places, basis.astype(np.float32))), 128

    def share(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places, basis = shared.value
        gram, total = Gram(len(basis)), np.zeros(basis.shape)
        held: list[tuple[np.ndarray, ...]] = []

        def add() -> None:
            if held:
                gram.add(*(np.concatenate(part) for part in zip(*held, strict=True)))
                held.clear()

        for batch in batches:
            for row in batch.itertuples():
                counts = np.frombuffer(row.counts, np.uint8).astype(np.int64)
                at, weights = places[np.frombuffer(row.places, np.int32)], np.frombuffer(row.weights, np.float32)
                known = at >= 0
                held.append((np.bincount(np.repeat(np.arange(len(counts)), counts)[known], minlength=len(counts)), at[known], weights[known]))
                if sum(len(h[0]) for h in held) >= 1 << 16:
                    add()
                    if gram.passages >= GRAM_PASSAGES:
                        total += gram.times(basis)
        add()
        if gram.passages:
            total += gram.times(basis)
        if total.any():
            starts = range(0, len(total), block)
            yield pd.DataFrame({"block": list(starts), "part": [total[k:k + block].astype(np.float32).tobytes() for k in starts]})

    def summed(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = 0.0
        for batch in batches:
            for part in batch["part"]:
                total = total + np.frombuffer(part, np.float32).astype(np.float64)
        yield pd.DataFrame({"block": [key[0]], "part": [total.tobytes()]})

    schema = "block long, part binary"
    found = np.zeros(basis.shape)
    for row in passages.mapInPandas(share, schema).groupBy("block").applyInPandas(summed, schema).collect():
        part = np.frombuffer(row["part"], np.float64).reshape(-1, basis.shape[1])
        found[row["block"]:row["block"] + len(part)] = part
    return found


def fit_space(space: Space, passages: tuple[DataFrame, int, np.ndarray] | None = None, rank: int = RANK) -> None:
    """Randomised subspace iteration for the right singular vectors of the TF-IDF matrix of all parts of the space and of all
    passages (their table, number and vocabulary) of the documents.

    Parts outweigh the mean passage, and they are at most SPACE_PARTS, fewer than the dimensions kept: no part loses anything
    to the projection; the other dimensions are those in which the documents vary most."""
    parts, size = ITEM_WEIGHT * space.part_rows(), len(space.vocabulary)
    basis = np.linalg.qr(np.random.default_rng(13).normal(size=(size, min(rank, size))))[0]
    for _ in range(POWER_ROUNDS):
        product = parts.T @ (parts @ basis)
        if passages:
            table, number, words = passages
            product += gram_times(table, space.places(words).astype(np.int64), basis) / number
        basis = np.linalg.qr(product)[0]
    space.project(basis)


def read_items(benchmark: DataFrame) -> list[tuple[int, np.ndarray]]:
    """Items with words, in order of id; every task holds them."""
    rows = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct().collect()
    found = [(r["item_id"], token_hashes(r["text"])) for r in sorted(rows)]
    return [(i, t) for i, t in found if len(t)]


def fitted_spaces(parts: list[Part], idf: np.ndarray, docs: DataFrame | None = None) -> list[Space]:
    """A space for every SPACE_PARTS parts, fitted on all of them and on all passages of all rows of `docs`; without documents
    on the parts alone."""
    spaces = [Space(parts[k:k + SPACE_PARTS], idf) for k in range(0, len(parts), SPACE_PARTS)]
    passages = None
    if docs is not None:
        table = passage_table(docs, spaces, idf)
        number = table.agg(F.sum("passages")).first()[0]
        passages = (table, number, Vocabulary(spaces, idf).words) if number else None
    for space in spaces:
        fit_space(space, passages)
    return spaces


class Finder:
    """What a task needs to search texts: the items, the spaces and the word weights.

    The product of a passage with a part is the sum of its words' products, so each word is kept with its product with every
    part in the latent space; the smallest (ASSOCIATED) are left out and none is negative, which loses no sum that matters."""

    def __init__(self, items: Items, spaces: list[Space], idf: np.ndarray) -> None:
        self.items, self.spaces, self.idf = items, spaces, idf
        parts = [p for s in spaces for p in s.parts]
        self.item = np.array([p.item for p in parts])
        self.passage = np.array([p.passage for p in parts])
        self.bound = np.array([0.99 * p.threshold for p in parts])
        self.words = np.unique(np.concatenate([s.vocabulary for s in spaces]))
        word, part, weight, before = [], [], [], 0
        for space in spaces:
            products = (space.words @ space.latent.T).astype(np.float64) * space.lengths
            w, p = np.nonzero(products >= ASSOCIATED * self.bound[before:before + len(space.parts)])
            word.append(np.searchsorted(self.words, space.vocabulary[w]))
            part.append(p + before)
            weight.append(products[w, p])
            before += len(space.parts)
        word, part, weight = np.concatenate(word), np.concatenate(part), np.concatenate(weight)
        order = np.argsort(word, kind="stable")
        self.part, self.weight = part[order].astype(np.int32), weight[order]
        self.count = np.bincount(word, minlength=len(self.words))
        self.start = np.cumsum(self.count) - self.count
        self.place_of_cell = np.full(1 << TABLE_BITS, -1, np.int32)
        self.place_of_cell[cells(self.words)] = np.arange(len(self.words))

    def places(self, tokens: np.ndarray) -> np.ndarray:
        """Place in `words` of each token, -1 for others. Where two words share a cell, a search settles it."""
        at = self.place_of_cell[cells(tokens)]
        maybe = np.flatnonzero(at >= 0)
        wrong = maybe[self.words[at[maybe]] != tokens[maybe]]
        if len(wrong):
            at[wrong] = _search(self.words, tokens[wrong])
        return at

    def stretches(self, texts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(token, text, place in the text) of about CHUNK words at a time; no region is cut without being whole elsewhere."""
        overlap = int(self.items.reach.max())
        parts: list[tuple[int, int, int]] = []
        held = 0

        def joined() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return (np.concatenate([texts[k][a:b] for k, a, b in parts]), np.concatenate([np.full(b - a, k) for k, a, b in parts]),
                    np.concatenate([np.arange(a, b) for _, a, b in parts]))

        for k, tokens in enumerate(texts):
            for start in range(0, max(1, len(tokens)), CHUNK):
                end = min(len(tokens), start + CHUNK + overlap)
                parts.append((k, start, end))
                held += end - start
                if held >= CHUNK:
                    yield joined()
                    parts, held = [], 0
        if held:
            yield joined()

    def regions(self, tokens: np.ndarray, row: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, item, number of the region) around passages whose cosine with a part of the item reaches its threshold;
        `row` is the text of each token and `at` its place there.

        Per part, the words that have a product with it stand in order with a running sum. From each, the next at which the
        sum has grown by the threshold ends the shortest passage that reaches it; one longer than the part's passages is none."""
        place = self.places(tokens)
        known = np.flatnonzero(place >= 0)
        count = self.count[place[known]]
        ends = np.cumsum(count)
        token = np.repeat(known, count)
        posting = np.arange(len(token)) + np.repeat(self.start[place[known]] - ends + count, count)
        part = self.part[posting]
        order = np.argsort(part, kind="stable")
        part, token = part[order], token[order]
        total = np.concatenate([[0.0], np.cumsum(self.weight[posting][order])])
        last = np.searchsorted(total[1:], total[:-1] + self.bound[part] * (1 - 1e-9))
        first = np.flatnonzero(last < len(part))
        last = last[first]
        good = (part[first] == part[last]) & (row[token[first]] == row[token[last]])
        first, last = first[good], last[good]
        good = at[token[last]] - at[token[first]] < self.passage[part[first]]
        first, last, item = token[first[good]], token[last[good]], self.item[part[first[good]]]
        low = np.maximum(0, -((self.items.reach[item] - 1 - at[last]) // self.items.step[item]))
        high = at[first] // self.items.step[item]
        # One number per text and item, and one per region.
        pair, more = row[first].astype(np.int64) * len(self.items.ids) + item, high - low + 1
        ends = np.cumsum(more)
        number = np.arange(int(more.sum())) + np.repeat(low - ends + more, more)
        found = np.unique((np.repeat(pair, more) << 32) | number)
        pair, number = found >> 32, found & 0xFFFFFFFF
        yield from zip((pair // len(self.items.ids)).tolist(), (pair % len(self.items.ids)).tolist(), number.tolist(), strict=True)

    def matches(self, tokens: list[np.ndarray]) -> list[dict[int, tuple[float, float, int]]]:
        """Per text, place of an item -> (share of the item in its longest common subsequence, share of its answer, start) of
        the region where these shares are largest."""
        best: list[dict[int, tuple[float, float, int]]] = [{} for _ in tokens]
        for stretch in self.stretches(tokens):
            for text, item, number in self.regions(*stretch):
                start = number * int(self.items.step[item])
                values = self.items.check(item, tokens[text][start:start + int(self.items.reach[item])].tolist())
                if values and (item not in best[text] or values > best[text][item][:2]):
                    best[text][item] = (*values, start)
        return best

    def search(self, texts: list[str | None]) -> list[dict[int, tuple[float, float, float]]]:
        """Per text, place of an item -> (cosine, share of the item in its longest common subsequence, share of its answer)."""
        tokens = [token_hashes(text) for text in texts]
        return [{item: (self.cosine(item, own[start:start + int(self.items.reach[item])]), share, replied)
                 for item, (share, replied, start) in hits.items()} for own, hits in zip(tokens, self.matches(tokens), strict=True)]

    def cosine(self, item: int, region: np.ndarray) -> float:
        """Largest cosine of the region with a part of the item."""
        return max(s.cosine(k, region, self.idf) for s in self.spaces for k, p in enumerate(s.parts) if p.item == item)


def _finders(docs: DataFrame, benchmark: DataFrame) -> Iterator[Finder]:
    """One finder for each PASS_BYTES of the benchmark; none for a benchmark without words."""
    size = benchmark.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    passes = max(1, math.ceil(size / PASS_BYTES))
    table = None
    for turn in range(passes):
        part = benchmark.where(F.pmod(F.xxhash64(F.lit("pass"), "item_id"), F.lit(passes)) == turn) if passes > 1 else benchmark
        items = read_items(part)
        if items:
            if table is None:
                table, total = word_frequencies(docs)
                idf = inverse_frequency(table, total)
            yield Finder(Items(items), fitted_spaces(item_parts(items, table, idf), idf, docs), idf)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document row and benchmark item found in it: doc_id, item_id, cosine, subsequence, answer.

    An item, or each part of a longer one, is a vector of its rarer words in a latent space; the space comes from a randomised
    SVD of the TF-IDF vectors of all parts and of all passages of all rows of `docs`, with word weights from all rows. Every text is read, whole, and a
    passage whose cosine with a part reaches what an accepted region must have (see Part) is a candidate. Around it, regions of one and a half items that start every half item are checked: an item
    is found if a region has SUBSEQUENCE of its words in order, or WITH_ANSWER of them and ANSWER of its last third. `cosine`
    is that of the best region. Items of up to PART_WORDS words lose no region by the candidate search; longer ones could
    where all their insertions fall into one part. Null and empty texts and items match nothing; rows with a null or repeated
    id are judged by their own text; a repeated item counts once; an empty benchmark or table gives no row. Other columns play
    no part. A benchmark of more than PASS_BYTES is searched in several passes."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, cosine double, subsequence double, answer double"

    def found(finder: Finder) -> DataFrame:
        shared = spark.sparkContext.broadcast(finder)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            finder = shared.value
            for batch in batches:
                out = []
                for doc_id, hits in zip(batch["doc_id"], finder.search(list(batch["text"])), strict=True):
                    for item, values in hits.items():
                        out.append((None if pd.isna(doc_id) else int(doc_id), finder.items.ids[item], *values))
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "cosine", "subsequence", "answer"]).astype({"doc_id": "Int64"})

        # Decimals reach pandas as objects, so that a null among the ids rounds none.
        return docs.select(F.col("doc_id").cast("long").cast("decimal(20,0)").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, schema)

    return reduce(DataFrame.unionByName, [found(finder) for finder in _finders(docs, benchmark)], spark.createDataFrame([], schema))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` in which no benchmark item was found, by the same search; each is judged by its own text, also
    where its id is null or repeats."""
    def clean(docs: DataFrame, finder: Finder) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(finder)

        def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series([bool(hits) for hits in shared.value.matches([token_hashes(text) for text in texts])], dtype=bool)

        judged = F.pandas_udf(judge, "boolean")(F.col("text").cast("string"))
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), judged.alias("found"))
        return rows.where("not found").select("row.*")

    return reduce(clean, _finders(docs, benchmark), docs)
