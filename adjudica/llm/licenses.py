"""License scans by diagonal voting, in DataFrame functions only.

All rolling pairs of words of every text are joined, by hash and then by the words themselves, to their positions in the phrase
templates. A match votes for a diagonal: the start that the phrase would have in the text. Votes are aggregated by diagonal,
neighbouring diagonals are merged (words left out or put in shift a phrase from one diagonal to the next), and a span is
verified by the share of the template's pairs that it holds.

Defined results: a null or empty text has 0 words and no span. Repeated rows each get a result row; equal rows are computed
once. Texts of one word cannot match, as each template has two words or more. A text of any length is cut into pairs in its row, and its hits
alone are aggregated. Of spans with equal coverage none is preferred: all are reported. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Places whose hits are the bits of one number.
BITS = 60
WORD = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"


@dataclass(frozen=True)
class Template:
    """A phrase of two or more lower-case words, up to a whole license text. exact: every place where the words stand consecutively, nothing less."""

    phrase: str
    label: str
    exact: bool = False


#: Labelled phrases of the contract, then the wording of well-known license notices.
BASE = (Template("mit license", "mit", True), Template("apache license", "apache", True), Template("general public license", "gpl", True))
NOTICES = (
    Template("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    Template("licensed under the apache license version 2 0", "apache"),
    Template("licensed under the gnu general public license version 3", "gpl"),
    Template("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    Template("redistribution and use in source and binary forms with or without modification are permitted provided that", "bsd"),
    Template("licensed under cc by nc 4 0", "cc-by-nc"),
    Template("licensed under cc by sa 4 0", "cc-by-sa"),
    Template("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    Template("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    Template("all rights reserved", "proprietary", True),
)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(1))


def pairs_table(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """(template, place, block, bit, a, b, h): every pair of neighbouring words of every template; places are bits of blocks of BITS. A literal table, as
    large as the templates' words."""
    if any(len(t.phrase.split()) < 2 for t in templates):
        raise ValueError("a template has two words or more")
    # template -1 is the pair of two empty words that marks every row
    rows = [F.struct(F.lit(i).alias("template"), F.lit(p).alias("phrase")) for i, p in [(-1, " "), *((i, " ".join(t.phrase.split())) for i, t in enumerate(templates))]]
    w = spark.range(1).select(F.inline(F.array(*rows))).select("template", F.split("phrase", " ").alias("w"))
    pairs = w.select("template", F.posexplode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, 2147483647).alias("b"))).alias("place", "p")).select("template", "place", "p.a", "p.b").filter("b is not null")
    bit = F.when(F.col("template") < 0, F.lit(0)).otherwise(F.expr(f"shiftleft(1L, place % {BITS})")).cast("long")
    return pairs.select("template", "place", F.floor(F.col("place") / BITS).cast("int").alias("block"), bit.alias("bit"), "a", "b", F.xxhash64("a", "b").alias("h"))


def votes(df: DataFrame, key: str, text: str, templates: tuple[Template, ...]) -> DataFrame:
    """(key, digest, n_words, template, block, diagonal, mask, copies): pairs of a block of a template found on a diagonal, as a bit mask.

    Every row of df also votes once for template -1, so that rows without a hit stay; copies counts equal rows."""
    spark = df.sparkSession
    w = df.select(F.col(key).alias("key"), F.xxhash64(text).alias("digest"), words(F.col(text)).alias("w"))
    mark = F.array(F.struct(F.lit("").alias("a"), F.lit("").alias("b")))
    pairs = F.concat(mark, F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, 2147483647).alias("b")))
    rolling = w.select("key", "digest", F.size("w").cast("long").alias("n_words"), F.posexplode(pairs).alias("at", "pair"))
    rolling = rolling.select("key", "digest", "n_words", "at", F.col("pair.a").alias("wa"), F.col("pair.b").alias("wb")).filter("wb is not null").withColumn("wh", F.xxhash64("wa", "wb"))
    t = F.broadcast(pairs_table(spark, templates))
    hits = rolling.join(t, (F.col("wh") == F.col("h")) & (F.col("wa") == F.col("a")) & (F.col("wb") == F.col("b")))
    # the mark stands at 0, so word number = at - 1
    diagonal = F.when(F.col("template") < 0, F.lit(0)).otherwise(F.col("at") - 1 - F.col("place"))
    return hits.withColumn("diagonal", diagonal).groupBy("key", "digest", "n_words", "template", "block", "diagonal").agg(
        F.bit_or("bit").alias("mask"), F.count(F.lit(1)).alias("copies"))


def spans(voted: DataFrame, templates: tuple[Template, ...], gap: int = 2, least: float = 0.7) -> DataFrame:
    """Verified spans (key, digest, template, label, exact, first_word, coverage); diagonals up to `gap` apart are one span."""
    info = F.create_map(*[x for i, t in enumerate(templates) for x in (F.lit(i), F.struct(F.lit(t.label).alias("label"), F.lit(t.exact).alias("exact"), F.lit(len(t.phrase.split()) - 1).alias("pairs")))])
    one = ["key", "digest", "template"]
    order = Window.partitionBy(*one).orderBy("diagonal", "block")
    v = voted.filter("template >= 0").withColumn("info", info[F.col("template")])
    step = F.col("diagonal") - F.lag("diagonal").over(order)
    far = step.isNull() | (step > F.when(F.col("info.exact"), 0).otherwise(gap))
    v = v.withColumn("far", far.cast("int")).withColumn("span", F.sum("far").over(order))
    s = v.groupBy(*one, "info", "span", "block").agg(F.min("diagonal").alias("first_word"), F.bit_or("mask").alias("mask"))
    s = s.groupBy(*one, "info", "span").agg(F.min("first_word").alias("first_word"), F.sum(F.bit_count("mask")).alias("found"))
    coverage = F.col("found") / F.col("info.pairs")
    return s.select(*one, F.col("info.label").alias("label"), F.col("info.exact").alias("exact"), F.greatest(F.col("first_word"), F.lit(0)).cast("long").alias("first_word"), coverage.alias("coverage")).filter(
        F.when(F.col("exact"), F.col("coverage") == 1).otherwise(F.col("coverage") >= least))


def scan(df: DataFrame, key: str, text: str, base: tuple[Template, ...] = BASE, notices: tuple[Template, ...] = NOTICES) -> DataFrame:
    """One row per row of df: key, n_words, n_base, first_word, last_word, base_labels, labels, score (the best coverage of a span)."""
    templates = base + notices
    voted = votes(df, key, text, templates)
    is_base = F.col("template") < len(base)
    found = spans(voted, templates).select("key", "digest", F.lit(None).cast("long").alias("n_words"), F.lit(0).cast("long").alias("copies"), "label", "first_word", "coverage", is_base.alias("is_base"))
    rows = voted.filter("template < 0").select("key", "digest", "n_words", "copies", F.lit(None).cast("string").alias("label"), F.lit(None).cast("long").alias("first_word"), F.lit(None).cast("double").alias("coverage"), F.lit(False).alias("is_base"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")  # noqa: E731  a few labels at most
    base_start = F.when(F.col("is_base"), F.col("first_word"))
    out = rows.unionByName(found).groupBy("key", "digest").agg(
        F.max("n_words").alias("n_words"), F.sum("copies").alias("copies"), F.count(base_start).alias("n_base"), F.min(base_start).alias("first_word"), F.max(base_start).alias("last_word"),
        joined(F.when(F.col("is_base"), F.col("label"))).alias("base_labels"), joined(F.col("label")).alias("labels"), F.coalesce(F.max("coverage"), F.lit(0.0)).alias("score"))
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return out.select(F.col("key").alias(key), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", again.alias("copy")).drop("copy")
