"""Classifiers fitted on bounded labelled samples."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.language import held_out
from tidemark.session import through_table


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: dict[int, int], columns: tuple[str, ...]) -> DataFrame:
    """(doc_id, columns, label) of about `per_class` labelled documents of classes 0 and 1.

    The bound is `per_class`: it limits what a classifier is fitted on, never what is scored. Where ids repeat so that the
    drawn ids have more than twice as many rows, rows are drawn from them by hash of id and text. Labels of held-out ids and
    null labels or ids teach nothing; an id labelled twice has the higher label; equal documents count once. Ids are drawn
    by hash from the label table, so texts of other documents are scanned but don't move."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("label"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = F.pmod(F.xxhash64(F.lit("labels"), "doc_id"), F.lit(1 << 30))
    share = F.lit(0)
    for value, n in counts.items():
        share = F.when(F.col("label") == value, int(min(1.0, per_class.get(value, 0) / n) * (1 << 30))).otherwise(share)
    # About as many ids as per_class names: bounded by the parameter.
    chosen = through_table(known.where(place < share), "labelled")
    found = docs.select("doc_id", *columns).join(F.broadcast(chosen), "doc_id")
    rows = {r["label"]: r["n"] for r in found.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    row_place = F.pmod(F.xxhash64(F.lit("rows"), "doc_id", *columns), F.lit(1 << 30))
    row_share = F.lit(1 << 30)
    for value, n in rows.items():
        row_share = F.when(F.col("label") == value, int(min(1.0, 2 * per_class.get(value, 0) / n) * (1 << 30))).otherwise(row_share)
    return found.where(row_place < row_share).distinct()


def fitted(docs: DataFrame, labels: DataFrame, label: str, per_class: dict[int, int], columns: tuple[str, ...],
           fit: Callable[[pd.DataFrame], object]) -> object:
    """The model that `fit` makes of the sample, in a fixed order of rows. One task fits, so the driver holds no texts;
    what the task reads is bounded by `per_class`. Without any label `fit` gets an empty frame."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ordered = frame.sort_values(["doc_id", "text"], na_position="first").reset_index(drop=True)
        return pd.DataFrame({"model": [pickle.dumps(fit(ordered))]})

    sample = labelled_sample(docs, labels, label, per_class, columns)
    found = sample.groupBy(F.lit(0).alias("all")).applyInPandas(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else fit(pd.DataFrame({c: [] for c in ("doc_id", *columns, "label")}))
