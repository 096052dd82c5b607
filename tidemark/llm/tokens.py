"""Token-count rollups kept current by signed batches."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.commits import create_once, is_written, listed, read_commit

#: Fixed by the tokenizer's description: how text is cut before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
KEYS = ("source", "lang", "tokenizer")


def piece_counts(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """`docs` with `pieces`, the tokens of the whole text under a byte-pair vocabulary (0 for a null text).

    The file must be readable on every executor, as installed packages are."""

    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        encoding = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in texts:
            yield batch.map(lambda t: len(encoding.encode_ordinary(t)) if isinstance(t, str) else 0).astype("int64")

    return docs.withColumn("pieces", F.pandas_udf(count, "long")(F.col("text").cast("string")))


def inserts(counted: DataFrame, tokenizer: str, tokens: str) -> DataFrame:
    """Signed changes that add every row once."""
    return counted.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(1).cast("long").alias("documents"),
                          F.col(tokens).cast("long").alias("tokens"))


def deletes(counted: DataFrame, tokenizer: str, tokens: str) -> DataFrame:
    """Signed changes that take every row back."""
    return inserts(counted, tokenizer, tokens).withColumns({"documents": -F.col("documents"), "tokens": -F.col("tokens")})


def revisions(counted: DataFrame, tokenizer: str, old: str, new: str) -> DataFrame:
    """Signed changes for rows whose count was wrong: only the difference moves."""
    changed = counted.where(~F.col(old).eqNullSafe(F.col(new)))
    return changed.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(0).cast("long").alias("documents"),
                          (F.coalesce(new, F.lit(0)) - F.coalesce(old, F.lit(0))).cast("long").alias("tokens"))


def _sums(changes: DataFrame) -> DataFrame:
    return changes.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))


class Rollup:
    """Additive totals by source, language and tokenizer version, in a folder with one table of sums per batch.

    A batch is summed before it is stored (partial sums per task first, so a source with a third of all rows moves a few
    rows), and it counts once its folder is written whole: a failed commit changes nothing, a repeated one neither, and one
    that repeats a number with other sums is refused. Every `fold_every` batches the totals so far are stored, so that they are
    kept and not summed again; the commit file of a total names the batches in it. Null sources and languages are keys like
    others; an empty batch commits and adds nothing; without batches the totals are empty."""

    def __init__(self, spark: SparkSession, path: str, fold_every: int = 16) -> None:
        self.spark, self.path, self.fold_every = spark, path.rstrip("/"), fold_every

    def _folded(self) -> dict:
        names = listed(self.spark, f"{self.path}/folds")
        return read_commit(self.spark, f"{self.path}/folds/{names[-1]}") if names else {"folder": None, "batches": []}

    def _pending(self, folded: dict) -> list[int]:
        """Committed batches that no stored total holds."""
        numbers = [int(name.split("=")[1]) for name in listed(self.spark, self.path) if name.startswith("batch=")]
        return [n for n in sorted(set(numbers) - set(folded["batches"])) if is_written(self.spark, f"{self.path}/batch={n}")]

    def _read(self, *folders: str) -> DataFrame:
        schema = "source string, lang string, tokenizer string, documents long, tokens long"
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def committed(self, batch: int) -> bool:
        return is_written(self.spark, f"{self.path}/batch={batch}")

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """False if the batch is already in the totals."""
        sums = _sums(changes)
        if self.committed(batch):
            stored = self._read(f"batch={batch}")
            sums = sums.select(*stored.columns)
            if not (stored.exceptAll(sums).isEmpty() and sums.exceptAll(stored).isEmpty()):
                raise ValueError(f"batch {batch} was committed with other changes")
            return False
        sums.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        self._fold()
        return True

    def _fold(self) -> None:
        folded = self._folded()
        pending = self._pending(folded)
        if len(pending) < self.fold_every:
            return
        folder = f"total-{uuid4().hex}"
        _sums(self._all(folded, pending)).write.parquet(f"{self.path}/{folder}")
        number = len(listed(self.spark, f"{self.path}/folds"))
        create_once(self.spark, f"{self.path}/folds/{number:08d}.json", {"folder": folder, "batches": sorted([*folded["batches"], *pending])})

    def _all(self, folded: dict, pending: list[int]) -> DataFrame:
        return self._read(*([folded["folder"]] if folded["folder"] else []), *[f"batch={n}" for n in pending])

    def totals(self) -> DataFrame:
        """Keys whose sums are not both zero."""
        folded = self._folded()
        return _sums(self._all(folded, self._pending(folded))).where("documents <> 0 or tokens <> 0")
