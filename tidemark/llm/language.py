"""Language identification by compression with one dictionary per language."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of training text per language, and of all languages together: with more languages each has less.
DICTIONARY_BYTES, ALL_BYTES = 96 << 10, 48 << 20
#: Languages up to which their shares are broadcast (some 50 bytes each).
MOST_BROADCAST = 200_000
#: Documents drawn per language, the share of a dictionary that one of them fills at most, and the places it is read at.
DRAWN, SHARES, PLACES = 400, 32, 8
LEVEL = 9
#: Characters compressed at once: longer texts are cut, so that every part is judged by the dictionary and not by itself.
PIECE = 2000
#: Narrower relative margins between the two smallest encodings are rejected.
MARGIN = 0.002
UNDETERMINED = "und"
#: Case, digits and marks say little about the language and would fill the encodings.
_MARKS = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """Lower-case words, one space between them."""
    return _MARKS.sub(" ", text.lower())


def held_out(doc_id: Column) -> Column:
    """Fixed by the query contract: a fifth of the ids is never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def drawn(docs: DataFrame, key: str, number: int, values: list) -> DataFrame:
    """About `number` rows of each value of `key`, those with the lowest hash of id and text; equal rows count once.

    `values` has (value, rows): the share of rows drawn follows, so nothing is ordered and no value's rows meet in one task."""
    place = F.pmod(F.xxhash64(F.lit("draw"), "doc_id", "text"), F.lit(1 << 30))
    shares = docs.sparkSession.createDataFrame([(value, int(min(1.0, number / rows) * (1 << 30))) for value, rows in values], f"{key} string, _share long")
    # One short row per value, all of which the driver has counted.
    return docs.join(F.broadcast(shares) if len(values) <= MOST_BROADCAST else shares, key).where(place < F.col("_share")).drop("_share").distinct()


def spread(text: bytes, size: int) -> bytes:
    """`size` bytes of a text, taken at PLACES even distances over its whole length; a shorter text as it is."""
    if len(text) <= size:
        return text
    part = max(1, size // PLACES)
    starts = np.linspace(0, len(text) - part, max(1, size // part)).astype(int).tolist()
    return b" ".join(text[k:k + part] for k in starts)


def dictionaries(docs: DataFrame, size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Raw dictionary content per language, of about `size` bytes, less where all together would pass ALL_BYTES.

    A bounded sample of the labelled rows: about DRAWN documents a language are read in hash order until the dictionary is
    full, each for a bounded share of it that is taken across the whole text. Rows with a null lang or text and held-out ids
    teach nothing; equal rows teach once."""
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(
        "doc_id", "text", F.col("lang").cast("string").alias("lang"))
    known = [(r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()]
    size_of = max(PLACES, min(size, ALL_BYTES // max(1, len(known))))

    def fill(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        content, seen = [], 0
        for text in group.sort_values(["at", "doc_id", "text"])["text"].drop_duplicates():
            if seen >= size_of:
                break
            content.append(spread(letters(text).encode("utf-8", "replace"), max(PLACES, size_of // SHARES)))
            seen += len(content[-1]) + 1
        return pd.DataFrame({"lang": [key[0]], "content": [b" ".join(reversed(content))]})

    chosen = drawn(rows, "lang", DRAWN, known).withColumn("at", F.xxhash64(F.lit("order"), "doc_id", "text"))
    return {r["lang"]: bytes(r["content"]) for r in chosen.groupBy("lang").applyInPandas(fill, "lang string, content binary").collect()}


class Compressors:
    """Encoded sizes of a text under each language's dictionary."""

    def __init__(self, contents: dict[str, bytes]) -> None:
        self.langs = sorted(contents)
        plain = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.encoders = []
        for lang in self.langs:
            content = zstandard.ZstdCompressionDict(contents[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=plain)
            self.encoders.append(zstandard.ZstdCompressor(dict_data=content, compression_params=plain))

    def sizes(self, text: str) -> np.ndarray:
        text = letters(text)
        pieces = [text[k:k + PIECE].encode("utf-8", "replace") for k in range(0, len(text), PIECE)]
        return np.array([sum(len(e.compress(p)) for p in pieces) for e in self.encoders])


def _judged(docs: DataFrame, kept: list[str], contents: dict[str, bytes], margin: float) -> DataFrame:
    """(row: the kept columns, found: lang_pred, score, margin, rejected)."""
    shared = docs.sparkSession.sparkContext.broadcast(contents)

    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        compressors = Compressors(shared.value)
        for texts, readable in batches:
            found = []
            for text, letters in zip(texts, readable, strict=True):
                if not letters or not compressors.langs:
                    found.append((UNDETERMINED, 0.0, 0.0, True))
                    continue
                sizes = compressors.sizes(text)
                best = int(sizes.argmin())
                rest = np.delete(sizes, best)
                second = int(rest.min()) if len(rest) else 2 * int(sizes[best])
                saved = second - int(sizes[best])
                found.append((compressors.langs[best], 1 / (1 + 2.0 ** -min(saved, 60)), saved / second, saved < margin * second))
            yield pd.DataFrame(found, columns=["lang_pred", "score", "margin", "rejected"])

    judged = F.pandas_udf(judge, "lang_pred string, score double, margin double, rejected boolean")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col("text").cast("string").alias("text"),
                       F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("readable"))
    return rows.select("row", judged("text", "readable").alias("found"))


def identify(docs: DataFrame, contents: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """doc_id, lang_pred, score, margin and rejected of every row.

    The language whose dictionary gives the smallest encoding wins, ties go to the smaller name. `score` is the
    probability of the winner if every saved byte doubles the odds against the runner-up: 0.5 on a tie, near 1 beyond a
    few bytes. `rejected` marks margins below `margin` (relative to the runner-up) and texts without a letter. Null texts,
    texts without a letter, and all rows when no language is known are `und` with score 0. An empty table gives no row."""
    return _judged(docs, ["doc_id"], contents, margin).select("row.doc_id", "found.*")


def drop_unidentified(docs: DataFrame, margin: float = MARGIN) -> DataFrame:
    """The rows of `docs` whose language is clear, with their own columns."""
    return _judged(docs, docs.columns, dictionaries(docs), margin).where("not found.rejected").select("row.*")
