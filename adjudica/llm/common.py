"""Helpers shared by the corpus operators: stored intermediates, hold-outs, bounded training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adjudica.sources.tables import materialise, table

__all__ = ["materialise", "table", "remainder", "labelled", "training_sample"]


def remainder(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(n)).cast("int")


def training_sample(df: DataFrame, label: str, text: str, bound: int) -> DataFrame:
    """At most about `bound` distinct texts of every label, taken by a hash of the text -> (label, text).

    The share kept of a label is bound / rows of the label, so the size does not grow with the table. Copies of a text
    have the same hash and are one row. Labels are few (a classifier's classes)."""
    df = df.filter(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).alias("label"), F.col(text).alias("text"))
    sizes = {r["label"]: r["n"] for r in df.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1_000_000))
    keep = F.lit(False)
    for value, n in sizes.items():
        keep = keep | ((F.col("label") == F.lit(value)) & (draw < int(1_000_000 * min(1.0, bound / n)) + 1))
    return df.filter(keep).dropDuplicates(["label", "text"])



def labelled(docs: DataFrame, labels: DataFrame, column: str, bound: int = 12_000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, column) of labelled documents, from at most about `bound` rows of each label, drawn by a hash of the key.

    The drawn rows (key and label) are few by that bound and are sent to the documents, whose texts stay where they are."""
    rows = labels.filter(F.col(column).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("__key"), F.col(column).alias("__label"))
    sizes = {r["__label"]: r["n"] for r in rows.groupBy("__label").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64("__key", F.lit("labels")), F.lit(1_000_000))
    keep = F.lit(False)
    for value, n in sizes.items():
        keep = keep | ((F.col("__label") == F.lit(value)) & (draw < int(1_000_000 * min(1.0, bound / n)) + 1))
    drawn = F.broadcast(rows.filter(keep))
    return docs.select(F.col(key).alias("__doc"), F.col(text).alias(text)).join(drawn, F.col("__doc") == F.col("__key")).select(text, F.col("__label").alias(column))
