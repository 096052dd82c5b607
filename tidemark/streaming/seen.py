"""Identifiers that a stream has stored, with filters that tell which stored ones must be read at all.

Ids lie with their content hash in folders by generation and bucket. Each generation has a Bloom filter, kept as a table of
64-bit words; each batch writes the bits it adds: an id has all its bits in one word, so a lookup moves one row per id and
filter at most, and an id whose word lacks one of them was never stored. A batch of new ids so reads the filters, some eight bytes per
stored id, and few stored ids; ids that may be known read the folders of their own buckets. Where many are, a few words show it. A full generation is followed by
one of at least twice its size that the next batch fits in, so an id meets few filters however many ids are stored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.streaming import sinks
from tidemark.streaming.sinks import put_batch, read_batches

#: Size of the first filter, its share per id (half a word takes one), and bits that an id sets in its word: about one new id
#: in 3,000 is looked up in vain while no generation holds more ids than its size has shares.
FIRST_BITS, BITS_PER_ID, PROBES = 1 << 22, 16, 8
#: Folders of a generation, and new ids of a batch up to which each gets one file.
BUCKETS, GATHERED_IDS = 32, 1 << 20
#: One word in so many is asked first.
FIRST_OF = 64

IDS = "id string, content string, generation int, bucket int"
WORDS = "generation int, word bigint, bits bigint"
MADE = "generation int, ids bigint, folders int"


def _bits(generation: int) -> int:
    return FIRST_BITS << generation


def _probe(generation: int) -> Column:
    """(generation, word, mask) of an id in a generation's filter."""
    hashed = F.xxhash64(F.lit(1), "id")
    bits = [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright(hashed, 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(PROBES)]
    return F.struct(F.lit(generation).alias("generation"), F.pmod(F.xxhash64(F.lit(0), "id"), F.lit(_bits(generation) // (2 * BITS_PER_ID))).alias("word"),
                    reduce(Column.bitwiseOR, bits).alias("mask"))


@dataclass(frozen=True)
class Lookup:
    """(id, content) of asked ids that are stored, the number of stored folders read for them, ids stored per generation, and
    (id, content) of all ids in these folders, for who joins asked ids to them anyway."""

    stored: DataFrame
    folders: int
    generations: dict[int, int]
    read: DataFrame


class SeenIds:
    """Stored ids below a path, as left by earlier batches."""

    def __init__(self, path: str) -> None:
        self.path = path

    def _generations(self, spark, batch: int) -> dict[int, int]:
        """Ids stored per generation: a few rows, as sizes double."""
        made = read_batches(spark, f"{self.path}/made", MADE, batch).groupBy("generation").agg(F.sum("ids").alias("ids"))
        return {row["generation"]: row["ids"] for row in made.collect()}

    def find(self, ids: DataFrame, batch: int) -> Lookup:
        """Which of `ids` (id) earlier batches stored; a null id is never stored."""
        spark = ids.sparkSession
        generations = self._generations(spark, batch)
        empty = spark.createDataFrame([], "id string, content string")
        if not generations:
            return Lookup(empty, 0, generations, empty)
        asked = ids.where("id IS NOT NULL").select(F.col("id").cast("string").alias("id"))
        probes = asked.select(_bucket().alias("bucket"), F.explode(F.array(*[_probe(g) for g in generations])).alias("p")).select("bucket", "p.*")
        words = self._words(spark, batch)
        # Some of the words first: a bucket that they tell to read needs no others.
        few = F.pmod("word", F.lit(FIRST_OF)) == 0
        places = _hits(probes.where(few), words.where(few))
        if len(places) < BUCKETS * len(generations):
            rest = probes.where(~few)
            for generation, bucket in places:
                rest = rest.where((F.col("generation") != generation) | (F.col("bucket") != bucket))
            places |= _hits(rest, words.where(~few))
        if not places:
            return Lookup(empty, 0, generations, empty)
        by_generation: dict[int, list[int]] = {}
        for generation, bucket in sorted(places):
            by_generation.setdefault(generation, []).append(bucket)
        chosen = F.lit(False)
        for generation, buckets in by_generation.items():
            chosen = chosen | ((F.col("generation") == generation) & F.col("bucket").isin(buckets))
        read = read_batches(spark, f"{self.path}/ids", IDS, batch).where(chosen).select("id", "content")
        return Lookup(read.join(asked, "id", "left_semi"), len(places), generations, read)

    def _words(self, spark, batch: int) -> DataFrame:
        """Filter words as left by the batch before; each batch adds bits, and no bit goes."""
        since = (batch - 1) // sinks.WHOLE_EVERY * sinks.WHOLE_EVERY
        rows = read_batches(spark, f"{self.path}/words", WORDS).where(F.col("batch").between(since, batch - 1))
        return _merged(rows.select("generation", "word", "bits"))

    def add(self, fresh: DataFrame, batch: int, found: Lookup) -> None:
        """Store new ids (id, content), which no earlier batch holds by what `find` said for this one. Many are written by the
        tasks that hold them, each its share of every bucket; only a few are brought together by bucket first."""
        spark, generations = fresh.sparkSession, found.generations
        named = fresh.where("id IS NOT NULL").select(F.col("id").cast("string").alias("id"), F.col("content").cast("string").alias("content"))
        newest, count = max(generations, default=0), named.count()
        room = _bits(newest) // BITS_PER_ID
        if generations.get(newest, 0) >= room or generations.get(newest, 0) and generations[newest] + count > 2 * room:
            newest += 1
        while newest not in generations and count * BITS_PER_ID > _bits(newest):
            newest += 1
        placed = named.withColumns({"generation": F.lit(newest), "bucket": _bucket()})
        (placed if count > GATHERED_IDS else placed.repartition("bucket")).write.mode("overwrite").partitionBy("generation", "bucket").option(
            "compression", "zstd").parquet(f"{self.path}/ids/batch={batch}")
        # One row per id as it lies there, which needs no shuffle; whole tables have one per word.
        words = named.select(_probe(newest).alias("p")).select("p.generation", "p.word", F.col("p.mask").alias("bits"))
        if batch and batch % sinks.WHOLE_EVERY == 0:
            words = _merged(self._words(spark, batch).unionByName(words))
        words.sortWithinPartitions("generation", "word").write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/words/batch={batch}")
        made = named.agg(F.lit(newest).alias("generation"), F.count(F.lit(1)).alias("ids"), F.lit(found.folders).alias("folders"))
        put_batch(made, f"{self.path}/made", batch)

    def costs(self, spark) -> DataFrame:
        """Per batch: ids stored and folders of earlier ids read."""
        return read_batches(spark, f"{self.path}/made", MADE).select("batch", "ids", "folders")


def _bucket() -> Column:
    return F.pmod(F.xxhash64(F.lit("bucket"), "id"), F.lit(BUCKETS)).cast("int")


def _hits(probes: DataFrame, words: DataFrame) -> set[tuple[int, int]]:
    """(generation, bucket) of the probes that have all their bits."""
    rows = probes.join(words, ["generation", "word"]).where("bits & mask = mask").select("generation", "bucket").distinct().collect()
    return {(row["generation"], row["bucket"]) for row in rows}


def _merged(words: DataFrame) -> DataFrame:
    return words.groupBy("generation", "word").agg(F.bit_or("bits").alias("bits"))
