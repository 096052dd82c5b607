"""Small commit files that exist once: what they name is part of a store, and nothing else is."""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _file(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def create_once(spark: SparkSession, path: str, content: dict) -> bool:
    """Write a file that must not exist yet; of several writers one succeeds, the others are told so."""
    where, files = _file(spark, path)
    try:
        out = files.create(where, False)
    except Py4JJavaError as error:
        if "exist" in str(error.java_exception):
            return False
        raise
    out.write(bytearray(json.dumps(content, sort_keys=True).encode("utf-8")))
    out.close()
    return True


def read_commit(spark: SparkSession, path: str) -> dict | None:
    """Content of a commit file, or nothing where there is none."""
    where, files = _file(spark, path)
    if not files.exists(where):
        return None
    found = files.open(where)
    try:
        return json.loads(bytes(found.readAllBytes()).decode("utf-8"))
    finally:
        found.close()


def listed(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files in a folder, in order; none where it does not exist."""
    where, files = _file(spark, folder)
    return sorted(f.getPath().getName() for f in files.listStatus(where) if not f.getPath().getName().startswith(".")) if files.exists(where) else []


def is_written(spark: SparkSession, folder: str) -> bool:
    """Whether a job that wrote this folder came to its end."""
    where, files = _file(spark, f"{folder}/_SUCCESS")
    return files.exists(where)
