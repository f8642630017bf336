"""A training-data pipeline: language, toxicity, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next stage's docs. All but
the last return the columns of documents. Rows without a doc_id go through the filters and are never duplicates of anything. Documents with a
null or empty text have no language and go in the first stage. Rows that repeat a doc_id are each rated; of those that stay, one is kept, the one whose text comes first. A text of
any length is one row in every stage; the last cuts it in pieces. Ties are those of the operators. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adjudica.llm import language as lang
from adjudica.llm import neardup, packing
from adjudica.llm import toxicity as tox
from adjudica.llm.common import labelled, materialise, remainder

#: A document is rejected if less than this share of its letters lies in spans of its language.
LEAST_LANGUAGE = 0.3
LEAST_TOXIC = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a known language; those without letters, or whose letters fit no language, go."""
    model = lang.fit(docs.filter(remainder(F.col("doc_id"), 5) != 0), "text", "lang")
    columns = [F.col(f"d.`{c}`") for c in docs.columns]
    rated = docs.select(F.struct(*docs.columns).alias("d"), lang.label(F.col("text"), model).alias("r"))
    return rated.filter((F.col("r.lang") != "und") & (F.col("r.score") >= LEAST_LANGUAGE)).select(*columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that are likelier clean than toxic."""
    model = tox.fit(labelled(docs.filter(remainder(F.col("doc_id"), 5) != 0), spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic"), "text", "toxic", corpus=docs)
    columns = [F.col(f"d.`{c}`") for c in docs.columns]
    rated = docs.select(F.struct(*docs.columns).alias("d"), tox.score(F.col("text"), model, spark).alias("r"))
    return rated.filter(F.col("r") < LEAST_TOXIC).select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of every class of near-duplicates."""
    return neardup.deduplicated(docs, "doc_id", "text")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and their bins."""
    return packing.pack(docs, "doc_id", packing.blank_tokens(F.col("text")))


STAGES = [("language", language), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("best_fit_packing", best_fit_packing)]

#: Trained classifiers and signatures have no SQL form; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
