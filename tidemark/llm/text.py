"""Words, hashes and bounded word-frequency tables shared by the text operators."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
#: Cells of a word-frequency table: its size never grows with the corpus.
TABLE_BITS = 20
#: A task's word cache is emptied beyond this many words.
CACHE_WORDS = 400_000
#: Bytes hashed at once; longer texts are cut between words.
PIECE = 1 << 20
#: ASCII letters, digits and underscores make words, and so does everything beyond ASCII.
_WORD_BYTE = np.array([b >= 128 or chr(b).isalnum() or b == ord("_") for b in range(256)])
_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
BLOCK = 1 << 14


def mixed(values: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values (a multiply-xorshift finaliser)."""
    values = values ^ (values >> np.uint64(31))
    values = values * np.uint64(0x9E3779B97F4A7C15)
    values = values ^ (values >> np.uint64(29))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(32))


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64, at least `size` of each."""
    if len(_powers[0]) < size:
        size = 1 << (size - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def _hash_words(data: np.ndarray) -> np.ndarray:
    word = np.zeros(len(data) + 2, np.int8)
    word[1:-1] = _WORD_BYTE[data]
    edges = np.flatnonzero(np.diff(word))
    starts, ends = edges[::2], edges[1::2]
    powers, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts])


def token_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash per word of the lower-cased text, in order: polynomial hashes taken from one running sum."""
    if not isinstance(text, str) or not text:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    if len(data) <= PIECE:
        return _hash_words(data)
    parts, start = [], 0
    while start < len(data):
        end = min(len(data), start + PIECE)
        while end < len(data) and _WORD_BYTE[data[end]] and _WORD_BYTE[data[end - 1]]:
            end += 1
        parts.append(_hash_words(data[start:end]))
        start = end
    return np.concatenate(parts)


def shingles(tokens: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` tokens; a shorter text is one run."""
    if not len(tokens):
        return tokens
    size = min(width, len(tokens))
    total = np.zeros(len(tokens) - size + 1, np.uint64)
    for place in range(size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + tokens[place:place + len(total)] + np.uint64(1)
    return mixed(total + np.uint64(size))


def cells(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - TABLE_BITS)).astype(np.int32)


def word_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """Documents per word cell, and documents with words, over all rows.

    Words share 2^TABLE_BITS cells, so a rare word's count is an upper bound. Every task sends its table in blocks of
    fixed size and the blocks are summed on executors; the driver gets one table of 4 MB whatever the corpus."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, total = np.zeros(1 << TABLE_BITS, np.int32), 0
        for batch in batches:
            for text in batch["text"]:
                found = token_hashes(text)
                if len(found):
                    total += 1
                    table[np.unique(cells(found))] += 1
        blocks = table.reshape(-1, BLOCK)
        used = np.flatnonzero(blocks.any(axis=1))
        if total:
            yield pd.DataFrame({"block": used, "counts": [blocks[b].tobytes() for b in used], "docs": 0})
            yield pd.DataFrame({"block": [-1], "counts": [b""], "docs": [total]})

    def add(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, total = np.zeros(BLOCK, np.int64), 0
        for batch in batches:
            total += int(batch["docs"].sum())
            for counts in batch["counts"]:
                if counts:
                    table += np.frombuffer(counts, np.int32)
        yield pd.DataFrame({"block": [key[0]], "counts": [table.tobytes()], "docs": [total]})

    schema = "block long, counts binary, docs long"
    partial = docs.select(F.col(text_col).cast("string").alias("text")).mapInPandas(count, schema)
    summed = partial.groupBy("block").applyInPandas(add, schema).collect()
    table, total = np.zeros((1 << TABLE_BITS) // BLOCK * BLOCK, np.int64), 0
    for row in summed:
        if row["block"] < 0:
            total = row["docs"]
        else:
            table[row["block"] * BLOCK:(row["block"] + 1) * BLOCK] = np.frombuffer(row["counts"], np.int64)
    return table, total


def inverse_frequency(table: np.ndarray, total: int) -> np.ndarray:
    """1 for a word of every document up to 2 for a word of none, so that copies of a passage don't fade it out."""
    return (1 + np.log((total + 1) / (np.minimum(table, total) + 1)) / np.log(total + 2)).astype(np.float32)
