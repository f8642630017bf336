"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from adjudica.functions.hashing import chance, u8
from adjudica.operators import convert as C
from adjudica.plans import views as V
from adjudica.plans.registry import query
from adjudica.sources import tables as S
from adjudica.sources.tables import table


def doc_split(spark, base):
    split = F.when(chance(u8("doc_split", "doc_id"), 0.2), "eval").otherwise("train")
    return table(spark, base, "documents").withColumn("split", split)


DOC_SPLIT = f"CASE WHEN {V.BELOW(V.U('doc_split', 'doc_id'), 0.2)} THEN 'eval' ELSE 'train' END"


@query("scan_examples", f"SELECT doc_id, source, n_chars FROM (SELECT *, {DOC_SPLIT} AS split FROM documents) WHERE split = 'train' AND lang = 'en'")
def scan_examples(spark, base):
    return S.load_split(doc_split(spark, base), "train").filter(F.col("lang") == "en").select("doc_id", "source", "n_chars")


@query("split_slice", f"""SELECT doc_id, lang FROM (SELECT *, {DOC_SPLIT} AS split FROM documents) WHERE split = 'train' AND {V.BELOW(V.U('slice', 'doc_id'), 0.5)} ORDER BY {V.U('slice_cap', 'doc_id')}, doc_id LIMIT 150""")
def split_slice(spark, base):
    """Half of a split by hash, at most 150 rows of it."""
    return S.load_split(doc_split(spark, base), "train", key="doc_id", share=0.5, cap=150).select("doc_id", "lang")


@query("split_pair", "SELECT split, count(*) AS n, CAST(sum(length(t)) AS BIGINT) AS chars FROM (SELECT 'train' AS split, text AS t FROM documents UNION ALL SELECT 'eval', text FROM benchmark) GROUP BY split")
def split_pair(spark, base):
    """A training and an evaluation source as one table."""
    pair = S.split_pair(table(spark, base, "documents").select("text"), table(spark, base, "benchmark").select("text"))
    return pair.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("jsonl_limited", "SELECT least(count(*), 200) AS n, least(count(*), 200) AS known FROM events")
def jsonl_limited(spark, base):
    """The first rows of a JSON Lines folder: as many as asked for, all of them rows of the source. Which ones is up to the files."""
    path = S.shared_dir(spark) + "/events"
    e = table(spark, base, "events").select("event_id", "user_id")
    S.write_jsonl(e, path)
    read = S.read_jsonl(spark, path, e.schema, limit=200)
    return read.join(e.withColumn("known", F.lit(1)), ["event_id", "user_id"], "left").agg(F.count(F.lit(1)).alias("n"), F.count("known").alias("known"))


PROPS = T.StructType([T.StructField("k", T.IntegerType())])


@query("jsonl_scan", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def jsonl_scan(spark, base):
    good, _ = S.parse_json(table(spark, base, "events").select("event_id", "props"), "props", PROPS)
    return good.select("event_id", "rec.k")


CUT = V.BELOW(V.U("cut_line", "event_id"), 0.05)


@query("jsonl_rejects", f"""SELECT CASE WHEN {CUT} THEN 'not a JSON object of the expected form' ELSE 'ok' END AS reason, count(*) AS n,
  CAST(sum(CASE WHEN NOT {CUT} THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END) AS BIGINT) AS sum_k FROM events GROUP BY 1""")
def jsonl_rejects(spark, base):
    """Lines cut short in transit (chosen by hash) land in the rejects."""
    e = table(spark, base, "events").select("event_id", "props")
    damaged = e.withColumn("props", F.when(chance(u8("cut_line", "event_id"), 0.05), F.substring("props", 1, 5)).otherwise(F.col("props")))
    good, rejects = S.parse_json(damaged, "props", PROPS)
    both = good.select(F.lit("ok").alias("reason"), F.col("rec.k").alias("k")).unionByName(rejects.select("reason", F.lit(None).cast("int").alias("k")))
    return both.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("sum_k"))


@query("cache_roundtrip", f"SELECT lang AS task, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM (SELECT *, {DOC_SPLIT} AS split FROM documents) WHERE split = 'eval' GROUP BY lang")
def cache_roundtrip(spark, base):
    path = S.shared_dir(spark) + "/cache"
    S.write_cache(doc_split(spark, base).withColumn("task", F.col("lang")), path)
    return S.read_cache(spark, path, "eval").groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("jsonl_roundtrip", "SELECT conv_id, turn, role, md5(text) AS text_md5 FROM conversations")
def jsonl_roundtrip(spark, base):
    path = S.shared_dir(spark) + "/jsonl"
    conv = table(spark, base, "conversations")
    S.write_jsonl(conv, path)
    return S.read_jsonl(spark, path, conv.schema).select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@query("load_report", """SELECT 'customer' AS name, 'ok' AS status, (SELECT count(*) FROM customer) AS rows UNION ALL SELECT 'supplier', 'ok', (SELECT count(*) FROM supplier)
  UNION ALL SELECT 'renamed', 'failed: AnalysisException', CAST(0 AS BIGINT)""")
def load_report(spark, base):
    """Three sources of one task; one of them has lost a column."""
    loaders = {
        "customer": lambda: table(spark, base, "customer").select(F.lit("customer").alias("name"), F.col("c_acctbal").alias("value")),
        "supplier": lambda: table(spark, base, "supplier").select(F.lit("supplier").alias("name"), F.col("s_acctbal").alias("value")),
        "renamed": lambda: table(spark, base, "part").select(F.lit("renamed").alias("name"), F.col("p_balance").alias("value")),
    }
    data, report = S.load_all(loaders, ["name", "value"])
    rows = data.groupBy("name").agg(F.count(F.lit(1)).alias("rows"))
    r = spark.createDataFrame(report, "name string, status string")
    return r.join(rows, "name", "left").select("name", "status", F.coalesce("rows", F.lit(0)).alias("rows"))


@query("dataset_manifest", """SELECT lang, count(*) AS items, CAST(3 * count(*) AS BIGINT) AS questions, CAST(sum(n_chars) AS BIGINT) AS units,
  bit_xor(CAST('0x' || substr(md5(concat_ws('|', CAST(doc_id AS VARCHAR), text)), 1, 15) AS BIGINT)) AS fingerprint FROM documents GROUP BY lang""")
def dataset_manifest(spark, base):
    d = table(spark, base, "documents")
    return S.manifest(d, ["lang"], F.lit(3), F.col("n_chars"), [F.col("doc_id"), F.col("text")])


@query("concat_sources", """SELECT part, count(*) AS n, round(sum(balance), 2) AS balance FROM (SELECT 'buyers' AS part, c_acctbal AS balance FROM customer UNION ALL SELECT 'sellers', s_acctbal FROM supplier) GROUP BY part""")
def concat_sources(spark, base):
    a = table(spark, base, "customer").select(F.col("c_acctbal").alias("balance"))
    b = table(spark, base, "supplier").select(F.col("s_acctbal").alias("balance"))
    return S.concat_sources(("buyers", a), ("sellers", b)).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("balance"), 2).alias("balance"))


@query("single_image_rows", r"""WITH x AS (SELECT page_id, regexp_extract_all(html, '<br[^<]{0,20}') AS parts FROM pages)
SELECT page_id, CASE WHEN len(parts) = 1 THEN md5(parts[1]) END AS part_md5, CASE WHEN len(parts) <> 1 THEN len(parts) || ' parts, 1 is needed' END AS reason FROM x""")
def single_image_rows(spark, base):
    """A row is used when it has exactly one attached part (here a line break with what follows stands for the image); its bytes are carried, never decoded."""
    parts = F.transform(F.regexp_extract_all("html", F.lit("<br[^<]{0,20}"), F.lit(0)), lambda p: F.encode(p, "UTF-8"))
    good, rejects = C.single_part(table(spark, base, "pages").select("page_id", parts.alias("parts")), "parts", "part")
    none = F.lit(None).cast("string")
    return good.select("page_id", F.md5("part").alias("part_md5"), none.alias("reason")).unionByName(rejects.select("page_id", none.alias("part_md5"), "reason"))
