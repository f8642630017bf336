"""Registered queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adjudica.llm import bpe, conversations, language, licenses, merkle, neardup, neighbours, packing, quality, sql, tokenfiles, topk, toxicity, urls
from adjudica.llm.common import labelled, remainder, table


def op1_language(spark: SparkSession, base: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score and the number of language spans of every document."""
    docs = table(spark, base, "documents").select("doc_id", "text", "lang")
    held = remainder(F.col("doc_id"), 5) == 0
    model = language.fit(docs.filter(~held), "text", "lang")
    out = docs.select("doc_id", held.alias("held_out"), language.label(F.col("text"), model).alias("r"))
    return out.select("doc_id", "held_out", F.col("r.lang").alias("lang_pred"), F.col("r.score").alias("score"), F.size("r.spans").alias("n_spans"))


def op2_toxicity(spark: SparkSession, base: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    docs = table(spark, base, "documents").select("doc_id", "text")
    held = remainder(F.col("doc_id"), 5) == 0
    model = toxicity.fit(labelled(docs.filter(~held), table(spark, base, "labels"), "toxic"), "text", "toxic", corpus=docs)
    out = docs.select("doc_id", held.alias("held_out"), toxicity.score(F.col("text"), model, spark).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8_quality(spark: SparkSession, base: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    docs = table(spark, base, "documents").select("doc_id", "text")
    held = remainder(F.col("doc_id"), 4) == 2
    model = quality.fit(labelled(docs.filter(~held), table(spark, base, "labels"), "quality"), "text", "quality")
    out = quality.rate(docs, "text", model).select("doc_id", held.alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op3_licenses(spark: SparkSession, base: str) -> DataFrame:
    """Phrase places and license labels of every document."""
    return licenses.scan(table(spark, base, "documents"), "doc_id", "text")


def op4_top_k(spark: SparkSession, base: str) -> DataFrame:
    """The 5 best inner products of floor(256 x) for vectors with an id divisible by 50."""
    v = table(spark, base, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double") + x.cast("double") * 0).alias("v"))
    return topk.search(v, "vec_id", "v", F.col("id") % 50 == 0)


def op5_near_duplicates(spark: SparkSession, base: str) -> DataFrame:
    """doc_id and class_id (the smallest doc_id of its near-duplicates) of every document."""
    return neardup.classes(table(spark, base, "documents"), "doc_id", "text")


def op6_bpe(spark: SparkSession, base: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded bytes of every document."""
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.round_trip(table(spark, base, "documents"), "doc_id", "text", ranks, public_tokenizers.PATTERN)


def op7_urls(spark: SparkSession, base: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return urls.judge(table(spark, base, "pages"), "page_id", "url")


def op9_neighbours(spark: SparkSession, base: str) -> DataFrame:
    """The 10 nearest vectors found for vectors with an id divisible by 100."""
    return neighbours.search(table(spark, base, "embeddings"), "vec_id", "embedding", F.col("id") % 100 == 0)


def op10_packing(spark: SparkSession, base: str) -> DataFrame:
    """Every document's pieces and their bins; a token is a run of characters without white space."""
    return packing.pack(table(spark, base, "documents"), "doc_id", packing.blank_tokens(F.col("text")))


def damaged(df: DataFrame) -> DataFrame:
    """Conversations with seeded faults; a dropped row is only marked `gone`."""
    fault = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])) % 20
    d = df.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1)))
    return d.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fault") == 0).alias("gone"), times.alias("copy"))


def op11_conversations(spark: SparkSession, base: str) -> DataFrame:
    """Faults, cheapest repair and digest of the repaired rows of every damaged conversation."""
    return conversations.repair(damaged(table(spark, base, "conversations")), "conv_id", "turn", "role", "text", gone="gone")


def op12_merkle(spark: SparkSession, base: str) -> DataFrame:
    """Leaf, roots, digest of the proof, and the root recomputed from a tampered text, of every document."""
    docs = table(spark, base, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle.leaf([*[F.col(c) for c in fields[:-1]], lower]))
    m = merkle.manifest(docs, "doc_id", "lang", fields, tampered=tampered)
    m = m.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof_text(F.col("proof")), 256).alias("proof_sha256"), merkle.folded(F.coalesce("tampered", "leaf"), F.col("proof")).alias("folded_root"))
    return m.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_token_files(spark: SparkSession, base: str) -> DataFrame:
    """Place, length and checksum of every document's ids, as read back from the written files."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        tokenizer = f.read()
    return tokenfiles.round_trip(table(spark, base, "documents"), "doc_id", "text", tokenizer, end=1)


def pipeline(spark: SparkSession, base: str) -> DataFrame:
    """The stages of corpus_pipeline.py over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, base)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language, op2_toxicity, op3_licenses, op4_top_k, op5_near_duplicates, op6_bpe, op7_urls, op8_quality, op9_neighbours, op10_packing, op11_conversations, op12_merkle, op13_token_files, pipeline)}


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
