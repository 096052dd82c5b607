"""WARC archives, their capture index, and a k-way merge of locally sorted index runs."""

from __future__ import annotations

import gzip
import hashlib
import io
import math
import pickle
import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import scratch_path, through_table

#: Fixed by the query contract: smaller payloads are never revisits.
LEAST_SHARED = 100
#: Records per archive file, captures per merged range, and revisits up to which their table (40 bytes a row) is broadcast.
FILE_RECORDS = 20_000
RANGE_ROWS = 16_384
BROADCAST_ROWS = 500_000
#: Sampled keys that one task puts in order when ranges are cut.
STRETCH_MARKS = 65_536
#: Seconds since 1970 of page 0's capture, where no time is given.
EPOCH = 1_704_067_200
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_HOST = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)")
RUN_SCHEMA = ("run string, place long, urlkey string, captured string, page_id long, refers_to long, payload_bytes long, "
              "payload_digest string, record_type string, offset long, length long, intact boolean")


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload is held by a smaller page_id."""
    narrow = pages.select("page_id", "digest", "bytes").where(F.col("bytes") >= LEAST_SHARED)
    shared = through_table(narrow.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
                           .where("n > 1 and refers_to is not null").drop("n"), "shared-payloads")
    # One row per digest on the right: a digest with a third of all pages is split by the adaptive join.
    return narrow.join(shared, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select(
        "page_id", "digest", "refers_to").distinct()


def _line(name: str, value: F.Column | str) -> F.Column:
    value = F.lit(value) if isinstance(value, str) else value.cast("string")
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def records(pages: DataFrame) -> DataFrame:
    """`value`: one WARC record per page (page_id, url, html), without its closing empty lines.

    A null html is an empty payload, a null url has no target line, a null page_id no record id. Line breaks in a url are
    written as percent codes."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    held = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"),
                        F.octet_length(payload).cast("long").alias("bytes"))
    again = through_table(revisits(held), "revisits")
    if again.count() <= BROADCAST_ROWS:
        again = F.broadcast(again)
    rows = held.join(again, ["page_id", "digest"], "left")
    new = F.col("refers_to").isNull()
    block = F.concat(F.lit(HTTP_HEAD), F.when(new, F.col("payload")).otherwise(""))
    time = F.timestamp_seconds(F.lit(EPOCH) + F.coalesce(F.pmod("page_id", F.lit(1_000_000_000)), F.lit(0)))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    return rows.select(F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", F.when(new, "response").otherwise("revisit")),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))),
        _line("WARC-Target-URI", url), _line("WARC-Date", F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _line("WARC-Payload-Length", F.col("bytes")),
        _line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        _line("Content-Type", "application/http; msgtype=response"), _line("Content-Length", F.octet_length(block)),
        F.lit("\r\n"), block).alias("value"))


def write_archives(pages: DataFrame, path: str) -> None:
    """Gzipped archives; each task writes its own files, whole or not at all."""
    records(pages).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option(
        "maxRecordsPerFile", FILE_RECORDS).text(path)


def url_key(url: str | None) -> str:
    """Host labels in reverse, then path and query: pages of a domain sort together. Null is the empty key."""
    if url is None:
        return ""
    found = _HOST.match(url)
    if not found:
        return url
    rest = url[found.end():].split("#")[0]
    return ",".join(reversed(found[1].lower().split("."))) + ")" + (rest or "/")


def read_records(stream: io.BufferedIOBase) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, header, block) of each record of an archive, in file order."""
    at = 0
    while line := stream.readline():
        size, header = len(line), {}
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record at {at}")
        while (line := stream.readline()).strip(b"\r\n"):
            size += len(line)
            name, _, value = line.decode("utf-8").partition(":")
            header[name] = value.strip()
        size += len(line)
        block = stream.read(int(header["Content-Length"]))
        size += len(block)
        yield at, size, header, block
        at += size + len(stream.read(4))


def _page(urn: str | None) -> int | None:
    return int(urn[len("<urn:page:"):-1]) if urn else None


def sorted_runs(spark: SparkSession, path: str) -> DataFrame:
    """Index rows of the archives below `path`; each archive is one run, sorted by url key, time and page.

    `intact` is false where a response's payload doesn't have the digest and length that its header names."""

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows = []
                with gzip.open(io.BytesIO(content)) as raw, io.BufferedReader(raw, 1 << 20) as stream:
                    for offset, length, header, block in read_records(stream):
                        digest, size = header["WARC-Payload-Digest"][len("sha256:"):], int(header["WARC-Payload-Length"])
                        new = header["WARC-Type"] == "response"
                        payload = block[len(HTTP_HEAD):]
                        whole = not new or (len(payload) == size and hashlib.sha256(payload).hexdigest() == digest)
                        rows.append((url_key(header.get("WARC-Target-URI")), re.sub(r"\D", "", header["WARC-Date"]),
                                     _page(header.get("WARC-Record-ID")), _page(header.get("WARC-Refers-To")), size, digest,
                                     header["WARC-Type"], offset, length, whole))
                rows.sort(key=lambda r: (r[0], r[1], -1 if r[2] is None else r[2], r[7]))
                run = name.rsplit("/", 1)[1]
                frame = pd.DataFrame([(run, k, *r) for k, r in enumerate(rows)], columns=[c.split()[0] for c in RUN_SCHEMA.split(", ")])
                yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path)
    return files.select("path", "content").mapInPandas(index, RUN_SCHEMA)


class LoserTree:
    """Tournament over sorted sequences: each step replays one leaf-to-root path, log2(k) comparisons."""

    def __init__(self, runs: Sequence[Sequence[tuple]]) -> None:
        self.runs, self.at, self.k = runs, [0] * len(runs), len(runs)
        self.losers = [0] * max(1, self.k)
        winners = [0] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.losers[0] = winners[1] if self.k > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        if self.at[a] >= len(self.runs[a]):
            return False
        if self.at[b] >= len(self.runs[b]):
            return True
        return (self.runs[a][self.at[a]], a) < (self.runs[b][self.at[b]], b)

    def __iter__(self) -> Iterator[tuple]:
        while self.k:
            best = self.losers[0]
            if self.at[best] >= len(self.runs[best]):
                return
            yield self.runs[best][self.at[best]]
            self.at[best] += 1
            node = (best + self.k) // 2
            while node:
                if self._before(self.losers[node], best):
                    self.losers[node], best = best, self.losers[node]
                node //= 2
            self.losers[0] = best


def merge_runs(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The rows of all runs with `position`, their place in the global order by url key, time and page.

    Keys taken at regular distances from every run, put in order by a range shuffle, cut the key space into ranges of about
    `range_rows` captures; each task merges the pieces of the runs that fall into one range. As time, page, run and place
    belong to the key, one url with a third of all captures is many ranges. The driver sees one key and one count per range."""
    runs = through_table(runs, "runs")
    spark, total = runs.sparkSession, runs.count()
    step = max(1, range_rows // 16)
    key = ("urlkey", "captured", "page_id", "run", "place")
    marks = runs.where(F.pmod(F.col("place") + F.xxhash64("run"), F.lit(step)) == 0).select(
        *key).withColumn("page_id", F.coalesce("page_id", F.lit(-1)))
    marks = marks.repartitionByRange(max(1, math.ceil(total / step / STRETCH_MARKS)), *key).withColumn("stretch", F.spark_partition_id())
    nth = F.row_number().over(Window.partitionBy("stretch").orderBy(*key))
    cuts = marks.withColumn("nth", nth).where(F.col("nth") % max(1, range_rows // step) == 0).select(*key).collect()
    splits = spark.sparkContext.broadcast(sorted(tuple(r) for r in cuts))
    names = runs.columns

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sorted pieces: (range, rows), cut where the run or the range changes."""
        for batch in batches:
            out, held, last = [], [], None
            for row in batch.astype(object).where(batch.notna(), None).itertuples(index=False, name=None):
                order = (row[2], row[3], -1 if row[4] is None else row[4], row[0], row[1])
                now = (row[0], bisect_right(splits.value, order))
                if now != last and held:
                    out.append((last[1], len(held), pickle.dumps(held)))
                    held = []
                last = now
                held.append((order, row))
            if held:
                out.append((last[1], len(held), pickle.dumps(held)))
            yield pd.DataFrame(out, columns=["range", "n", "rows"])

    cut = through_table(runs.mapInPandas(pieces, "range long, n long, rows binary"), "pieces")
    bases, base = {}, 0
    for row in sorted(cut.groupBy("range").agg(F.sum("n").alias("n")).collect()):
        bases[row["range"]], base = base, base + row["n"]
    first = spark.sparkContext.broadcast(bases)

    def merge(group: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        start = first.value[group[0]]
        merged = LoserTree([pickle.loads(rows) for rows in frame["rows"]])
        out = pd.DataFrame([(*row, start + k) for k, (_, row) in enumerate(merged)], columns=[*names, "position"])
        return out.astype({"page_id": "Int64", "refers_to": "Int64"})

    return cut.groupBy("range").applyInPandas(merge, f"{RUN_SCHEMA}, position long")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages as archives, read them back and merge their index."""
    path = scratch_path(pages.sparkSession, "archives")
    write_archives(pages, path)
    return merge_runs(sorted_runs(pages.sparkSession, path))
