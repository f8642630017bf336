"""Sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from adjudica.functions.hashing import chance, u8
from adjudica.operators import sampling as S
from adjudica.operators.ranking import hash_bucket, with_rank
from adjudica.plans import views as V
from adjudica.plans.registry import query
from adjudica.sources.tables import spread, table


def RN(part: str, purpose: str, key: str) -> str:
    over = f"PARTITION BY {part} " if part else ""
    return f"row_number() OVER ({over}ORDER BY {V.U(purpose, key)}, {key})"


def docs(spark, base):
    return table(spark, base, "documents")


@query("cap_per_task", f"SELECT doc_id, source FROM (SELECT *, {RN('source', 'cap', 'doc_id')} AS rn FROM documents) WHERE rn <= 30")
def cap_per_task(spark, base):
    return S.cap_per_task(docs(spark, base).select("doc_id", "source"), ["source"], "doc_id", 30)


@query("holdout_split", f"""SELECT doc_id, CASE WHEN rn <= least(500, n // 10) THEN 'eval' ELSE 'train' END AS split FROM
  (SELECT doc_id, {RN('lang', 'holdout', 'doc_id')} AS rn, count(*) OVER (PARTITION BY lang) AS n FROM documents)""")
def holdout_split(spark, base):
    return S.holdout_split(docs(spark, base).select("doc_id", "lang"), ["lang"], "doc_id", 500, 10).select("doc_id", "split")


@query("stratified_cap", f"""WITH t AS (SELECT doc_id, toxic FROM (SELECT *, {RN('toxic', 'strata', 'doc_id')} AS rn FROM labels) WHERE rn <= 40)
SELECT doc_id, toxic, row_number() OVER (ORDER BY {V.U('reshuffle', 'doc_id')}, doc_id) AS pos FROM t""")
def stratified_cap(spark, base):
    """cap/2 toxic and cap/2 other rows, reshuffled."""
    t = S.stratified_cap(table(spark, base, "labels").select("doc_id", "toxic"), [], F.col("toxic"), "doc_id", F.lit(40), "strata")
    t = t.withColumn("u", u8("reshuffle", "doc_id"))
    return with_rank(t, [], hash_bucket(F.col("u")), [F.col("u"), F.col("doc_id")], "pos").select("doc_id", "toxic", "pos")


CALLED = V.BELOW(V.U("called", "p_partkey"), 0.75)


@query("call_mix", f"""WITH x AS (SELECT p_partkey, {CALLED} AS called FROM part), r AS (SELECT *, {RN('called', 'callmix', 'p_partkey')} AS rn FROM x)
SELECT p_partkey, called FROM r WHERE rn <= CASE WHEN called THEN 150 ELSE 50 END""")
def call_mix(spark, base):
    """Three quarters of the cap are calls, one quarter is not."""
    x = table(spark, base, "part").select("p_partkey", chance(u8("called", "p_partkey"), 0.75).alias("called"))
    return S.stratified_cap(x, [], F.col("called"), "p_partkey", F.when(F.col("called"), 150).otherwise(50), "callmix")


HELD = V.BELOW(V.U("heldout_task", "source"), 0.3)


@query("heldout_tasks", f"SELECT doc_id, source FROM documents WHERE NOT {HELD}")
def heldout_tasks(spark, base):
    d = docs(spark, base).select("doc_id", "source")
    dim = d.select("source").distinct().filter(chance(u8("heldout_task", "source"), 0.3))
    return S.drop_heldout(d, dim, "source")


@query("replay_sample", f"SELECT doc_id FROM (SELECT doc_id, {RN('', 'replay', 'doc_id')} AS rn FROM documents WHERE n_chars <= 6000) WHERE rn <= 200")
def replay_sample(spark, base):
    return S.replay_sample(docs(spark, base).select("doc_id", "n_chars"), "doc_id", 200, F.col("n_chars") <= 6000).select("doc_id")


@query("oversample_rare", """WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2), s AS (SELECT source, lang, n / sum(n) OVER (PARTITION BY source) AS share FROM c),
k AS (SELECT source, lang, CASE WHEN share >= 0.15 THEN 1 ELSE least(6, round_even(0.15 / greatest(share, 0.001), 0)) END AS copies FROM s)
SELECT doc_id, CAST(unnest(generate_series(1, CAST(copies AS BIGINT))) AS INTEGER) AS copy FROM documents JOIN k USING (source, lang)""")
def oversample_rare(spark, base):
    return S.oversample_rare(docs(spark, base).select("doc_id", "source", "lang"), ["source"], "lang").select("doc_id", "copy")


@query("class_repeat_cap", f"""WITH n AS (SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'), f AS (SELECT o_orderkey, o_orderstatus FROM (SELECT *, {RN('', 'filler', 'o_orderkey')} AS rn FROM orders WHERE o_orderstatus = 'P'), n WHERE rn <= n)
SELECT o_orderkey, o_orderstatus, 1 AS copy FROM f UNION ALL SELECT o_orderkey, o_orderstatus, CAST(unnest(generate_series(1, CASE WHEN o_orderstatus = 'F' THEN 4 ELSE 1 END)) AS INTEGER) FROM orders WHERE o_orderstatus <> 'P'""")
def class_repeat_cap(spark, base):
    o = table(spark, base, "orders").select("o_orderkey", "o_orderstatus")
    return S.class_repeat_cap(o, "o_orderstatus", "o_orderkey", "F", 4, "P")


def mixture(spark, base):
    d = docs(spark, base).select("doc_id")
    lab = table(spark, base, "labels").select("doc_id")
    replay = S.replay_sample(d, "doc_id", 200)
    capped = S.cap_per_task(docs(spark, base).select("doc_id", "source"), ["source"], "doc_id", 30).select("doc_id")
    return S.assemble_mixture({"general": (d, 1), "labelled": (lab, 3), "replay": (replay, 1), "capped": (capped, 2)}, ["doc_id"])


@query("mixture_report", f"""SELECT 'general' AS part, (SELECT count(*) FROM documents) AS n UNION ALL SELECT 'labelled', 3 * (SELECT count(*) FROM labels)
  UNION ALL SELECT 'replay', (SELECT least(200, count(*)) FROM documents) UNION ALL SELECT 'capped', 2 * (SELECT count(*) FROM (SELECT {RN('source', 'cap', 'doc_id')} AS rn FROM documents) WHERE rn <= 30)""")
def mixture_report(spark, base):
    return S.composition(mixture(spark, base))


@query("quota_per_set", f"""WITH n AS (SELECT 300 // count(DISTINCT source) AS q FROM documents) SELECT doc_id, source FROM (SELECT *, {RN('source', 'quota', 'doc_id')} AS rn FROM documents), n WHERE rn <= q""")
def quota_per_set(spark, base):
    d = docs(spark, base).select("doc_id", "source")
    n = d.select("source").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    return S.quota(d.withColumn("n", n), ["source"], "doc_id", F.floor(F.lit(300) / F.col("n"))).select("doc_id", "source")


@query("replay_quota", f"""SELECT doc_id, source FROM (SELECT *, {RN('source', 'replay_quota', 'doc_id')} AS rn FROM documents) WHERE rn <= CASE WHEN source IN ('src0', 'src1', 'src2') THEN 40 ELSE 10 END""")
def replay_quota(spark, base):
    """Named families get the larger quota, the rest is spread evenly."""
    d = docs(spark, base).select("doc_id", "source")
    dim = spark.createDataFrame([("src0", 40), ("src1", 40), ("src2", 40)], "source string, q int")
    d = d.join(F.broadcast(dim), "source", "left")
    return S.quota(d, ["source"], "doc_id", F.coalesce("q", F.lit(10)), "replay_quota").select("doc_id", "source")


NORM = r"trim(regexp_replace(lower({c}), '\s+', ' ', 'g'))"


@query("eval_overlap", f"""WITH e AS (SELECT DISTINCT c FROM (SELECT {NORM.format(c='l')} AS c FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM benchmark)) WHERE c <> ''),
t AS (SELECT doc_id, {NORM.format(c='l')} AS c FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents))
SELECT doc_id, count(*) FILTER (WHERE length(c) >= 40) AS n_long, count(*) FILTER (WHERE length(c) < 40) AS n_short FROM t WHERE c IN (SELECT c FROM e) GROUP BY doc_id""")
def eval_overlap(spark, base):
    """Contexts are the lines of the texts."""
    line = lambda d: d.withColumn("line", F.explode(F.split("text", "\n")))
    t = line(spread(docs(spark, base).select("doc_id", "text"))).select("doc_id", "line")
    return S.eval_overlap(t, "doc_id", "line", line(table(spark, base, "benchmark")), "line")


EVAL_DOC = V.BELOW(V.U("doc_split", "doc_id"), 0.2)


@query("leak_check", f"""WITH t AS (SELECT {NORM.format(c='text')} AS c, lang, {EVAL_DOC} AS ev FROM documents)
SELECT count(*) FILTER (WHERE ev) AS n_eval, count(*) FILTER (WHERE ev AND c IN (SELECT c FROM t WHERE NOT ev)) AS n_context_leaks, count(*) FILTER (WHERE ev AND (c, lang) IN (SELECT (c, lang) FROM t WHERE NOT ev)) AS n_question_leaks FROM t""")
def leak_check(spark, base):
    """Probe rows whose context, or context and question, also occur in training."""
    t = docs(spark, base).select(S.context_id(S.normalise_text(F.col("text"))).alias("h"), "lang", chance(u8("doc_split", "doc_id"), 0.2).alias("ev"))
    per = t.groupBy("h", "lang").agg(F.count_if("ev").alias("n_ev"), F.max((~F.col("ev")).cast("int")).alias("in_train"))
    by_context = per.groupBy("h").agg(F.sum("n_ev").alias("n_ev"), F.max("in_train").alias("in_train"), F.sum(F.col("n_ev") * F.col("in_train")).alias("q"))
    return by_context.agg(F.sum("n_ev").alias("n_eval"), F.sum(F.col("n_ev") * F.col("in_train")).alias("n_context_leaks"), F.sum("q").alias("n_question_leaks"))


T_SQL = "CAST(ceil(n_chars / CASE WHEN n_chars <= 2048 THEN 64 WHEN n_chars <= 8192 THEN 512 ELSE 2048 END) * CASE WHEN n_chars <= 2048 THEN 64 WHEN n_chars <= 8192 THEN 512 ELSE 2048 END AS BIGINT)"


@query("length_buckets", f"""WITH x AS (SELECT doc_id, n_chars, {T_SQL} AS t FROM documents), r AS (SELECT *, {RN('t', 'pack', 'doc_id')} AS rn FROM x),
b AS (SELECT t, n_chars, (rn - 1) // greatest(1, 8192 // t) AS batch FROM r)
SELECT t, count(*) AS n_rows, count(DISTINCT batch) AS batches, round(1 - sum(n_chars) / (sum(t) * 1.0), 6) AS waste FROM b GROUP BY t""")
def length_buckets(spark, base):
    b = S.pack_batches(docs(spark, base).select("doc_id", "n_chars"), "doc_id", "n_chars", 8192)
    return b.groupBy("t").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("batch").alias("batches"), F.round(1 - F.sum("n_chars") / F.sum("t"), 6).alias("waste"))


@query("bounded_batches", f"""WITH x AS (SELECT doc_id, n_chars, {T_SQL} AS t FROM documents), r AS (SELECT *, {RN('t', 'pack', 'doc_id')} AS rn FROM x),
b AS (SELECT t, (rn - 1) // least(8, greatest(1, 16384 // t)) AS batch FROM r), s AS (SELECT t, batch, count(*) AS n FROM b GROUP BY 1, 2)
SELECT max(n) AS max_rows, count(*) AS batches, count(*) FILTER (WHERE n > 8 OR (n > 1 AND n * t > 16384)) AS over_limit FROM s""")
def bounded_batches(spark, base):
    """At most 8 rows and 16,384 padded units per batch (a single longer row is its own batch)."""
    b = S.pack_batches(docs(spark, base).select("doc_id", "n_chars"), "doc_id", "n_chars", 16384, max_rows=8)
    s = b.groupBy("t", "batch").agg(F.count(F.lit(1)).alias("n"))
    over = (F.col("n") > 8) | ((F.col("n") > 1) & (F.col("n") * F.col("t") > 16384))
    return s.agg(F.max("n").alias("max_rows"), F.count(F.lit(1)).alias("batches"), F.count_if(over).alias("over_limit"))


@query("label_exemplars", f"""WITH r AS (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY {V.U('exemplar', 'doc_id')}, doc_id) AS rn FROM documents WHERE length(text) <= 1600)
SELECT source, lang, array_to_string(array_agg(doc_id ORDER BY rn), ',') AS exemplars FROM r WHERE rn <= 5 GROUP BY source, lang""")
def label_exemplars(spark, base):
    d = docs(spark, base).filter(F.length("text") <= 1600).select("source", "lang", "doc_id")
    e = S.exemplars(d, ["source", "lang"], "doc_id", 5)
    return e.select("source", "lang", F.array_join(F.transform("exemplars", lambda x: x.cast("string")), ",").alias("exemplars"))
