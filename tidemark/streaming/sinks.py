"""Idempotent batch outputs and versioned state tables for foreachBatch queries.

Every micro-batch writes to its own batch=N folder, replacing it on a retry, and reads the state
left by batch N-1: the last whole table and what changed since. A batch repeated after a lost executor or a restart gives the same tables.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def put_batch(rows: DataFrame, path: str, batch: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_batches(spark: SparkSession, path: str, schema, before: int | None = None) -> DataFrame:
    """All batch folders, or those before a batch; an empty table where nothing was written."""
    try:
        rows = spark.read.schema(f"{_ddl(schema)}, batch INT").parquet(path)
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], f"{_ddl(schema)}, batch INT")
    return rows if before is None else rows.filter(F.col("batch") < before)


def _ddl(schema) -> str:
    return schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


#: Batches from one whole state table to the next; those between hold only the rows they changed.
WHOLE_EVERY = 16


def _newest(rows: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Per key its row with the largest ``at``, which is left out."""
    columns = [f"`{c}`" for c in rows.columns if c != at]
    body = F.struct(*[F.col(f"`{c}`") for c in rows.columns if c not in (*keys, at)])
    return rows.groupBy(*keys).agg(F.max_by(body, at).alias("_newest")).select(*keys, "_newest.*").select(*columns)


def read_state(spark: SparkSession, path: str, schema, keys: Sequence[str], batch: int) -> DataFrame:
    """State as left by the batch before: per key its newest row since the last whole table. No older folder is read."""
    since = (batch - 1) // WHOLE_EVERY * WHOLE_EVERY
    return _newest(read_batches(spark, path, schema).filter(F.col("batch").between(since, batch - 1)), keys, "batch")


def put_state(known: DataFrame, changed: DataFrame, path: str, keys: Sequence[str], batch: int) -> None:
    """Writes the changed rows, one per key; every WHOLE_EVERY batches the unchanged ones too. Batch numbers have no gaps."""
    rows = changed.select(*[f"`{c}`" for c in known.columns])
    if batch % WHOLE_EVERY == 0:
        both = known.withColumn("_age", F.lit(0)).unionByName(rows.withColumn("_age", F.lit(1)))
        rows = _newest(both, keys, "_age")
    put_batch(rows, path, batch)


def start_batches(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True,
) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
