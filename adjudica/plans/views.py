"""Canonical views of the given tables and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adjudica.functions import dist as D
from adjudica.functions.hashing import SEED, chance, threshold, u8
from adjudica.operators import scoring as S
from adjudica.sources.tables import materialise, table

EMB_SCALE = 30.0


# ---- SQL pieces
def U(purpose: str, *keys: str) -> str:
    """SQL of hashing.u8."""
    return f"substr(md5(concat_ws('|', '{SEED}|{purpose}', {', '.join(f'CAST({k} AS VARCHAR)' for k in keys)})), 1, 8)"


def IDX(u: str, n) -> str:
    """SQL of hashing.pick_index (0-based)."""
    return f"(CAST('0x' || {u} AS BIGINT) % ({n}))"


def PLACE(purpose: str, n, *keys: str) -> str:
    """SQL of hashing.place modulo n."""
    return f"(CAST('0x' || substr(md5(concat_ws('|', '{SEED}|{purpose}', {', '.join(f'CAST({k} AS VARCHAR)' for k in keys)})), 1, 15) AS BIGINT) % ({n}))"


def BELOW(u: str, p: float) -> str:
    return f"({u} < '{threshold(p)}')"


ABSTAIN_SQL = r"regexp_matches(lower(regexp_replace({o}, '^\s+|\s+$', '', 'g')), '^(none of the above|none of these|not listed|no suitable|does not apply|cannot tell)|^(other|unsure|something else|neither of these|other / not covered)$')"


def SOFTMAX(z: str, t: str = "1.0") -> str:
    """SQL softmax of a list expression (a column name)."""
    e = f"list_transform({z}, lambda x: exp((x - list_max({z})) / {t}))"
    return f"list_transform({e}, lambda y: y / list_sum({e}))"


EMB_CTE = f"""
emb AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, label, CASE WHEN {BELOW(U('emb_split', 'vec_id'), 0.5)} THEN 0 ELSE 1 END AS fold FROM embeddings),
tr AS (SELECT fold, label, generate_subscripts(x, 1) AS i, unnest(x) AS v FROM emb),
cen AS (SELECT 1 - fold AS fold, label, array_agg(c ORDER BY i) AS c FROM (SELECT fold, label, i, avg(v) AS c FROM tr GROUP BY fold, label, i) GROUP BY fold, label),
lab AS (SELECT array_agg(label ORDER BY label) AS labels FROM (SELECT DISTINCT label FROM emb)),
fgrid AS (SELECT l.label, f.fold, cen.c FROM (SELECT unnest(labels) AS label FROM lab) l CROSS JOIN (VALUES (0), (1)) f(fold) LEFT JOIN cen ON cen.label = l.label AND cen.fold = f.fold),
zz AS (SELECT e.vec_id, e.label, array_agg(coalesce({EMB_SCALE} * list_dot_product(e.x, g.c), 0.0) ORDER BY g.label) AS za,
              array_agg(coalesce(8.0 * list_cosine_similarity(e.x, g.c), 0.0) ORDER BY g.label) AS zb
       FROM emb e JOIN fgrid g ON g.fold = e.fold GROUP BY e.vec_id, e.label),
pred AS (SELECT vec_id AS row_id, 'task_' || (vec_id % 5) AS task, (vec_id % 5) >= 3 AS heldout, CAST(vec_id % 3 AS INTEGER) AS qidx,
              CASE WHEN vec_id % 2 = 0 THEN 'choice' ELSE 'score' END AS type,
              CAST(list_position(labels, label) - 1 AS INTEGER) AS gold, za, zb FROM zz, lab),
pa AS (SELECT *, {SOFTMAX('za')} AS p FROM pred),
pb AS (SELECT *, {SOFTMAX('zb')} AS p FROM pred),
ra AS (SELECT *, list_max(p) AS conf, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS pred, p[gold + 1] AS pg FROM pa),
rb AS (SELECT *, list_max(p) AS conf, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS pred, p[gold + 1] AS pg FROM pb),
sa AS (SELECT *, CAST(pred = gold AS INTEGER) AS correct, -ln(greatest(pg, 1e-12)) AS nll,
              list_sum(list_transform(p, lambda v, i: power(v - CASE WHEN i - 1 = gold THEN 1.0 ELSE 0.0 END, 2))) AS brier, 1.0 / len(p) AS chance FROM ra),
sb AS (SELECT *, CAST(pred = gold AS INTEGER) AS correct, -ln(greatest(pg, 1e-12)) AS nll,
              list_sum(list_transform(p, lambda v, i: power(v - CASE WHEN i - 1 = gold THEN 1.0 ELSE 0.0 END, 2))) AS brier, 1.0 / len(p) AS chance FROM rb)
"""


#: Yes/no answers with a real gold: is a labelled document of low quality, judged by its length.
NOUL_CTE = """noul AS (SELECT d.doc_id AS row_id, d.lang AS task, [CAST(0.0 AS DOUBLE), 4.0 - 0.7 * ln(1 + d.n_chars)] AS z, CAST(1 - l.quality AS INTEGER) AS gold FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""


# ---- Spark views
def noul_pred(spark: SparkSession, base: str) -> DataFrame:
    """row_id, task, logits (no, yes) and gold of every labelled document."""
    d = table(spark, base, "documents").select("doc_id", "lang", "n_chars").join(table(spark, base, "labels").select("doc_id", "quality"), "doc_id")
    z = 4.0 - 0.7 * F.log(1 + F.col("n_chars"))
    return d.select(F.col("doc_id").alias("row_id"), F.col("lang").alias("task"), F.array(F.lit(0.0), z).alias("logits"), (1 - F.col("quality")).cast("int").alias("gold"))


def fold() -> Column:
    """Fold 0 or 1 of a vector: each is scored by the other."""
    return F.when(chance(u8("emb_split", "vec_id"), 0.5), 0).otherwise(1)


def embeddings(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "embeddings").withColumn("fold", fold())


def emb_model(spark: SparkSession, base: str) -> DataFrame:
    """The centroids of both folds as a stored model: the vectors are read once to fit it."""
    return materialise(S.fit_centroids(embeddings(spark, base), "label", "embedding", F.col("fold"), folds=2), "centroids")


def emb_scorer(model: DataFrame, run: str = "a"):
    """run a: scaled dot product; run b: cosine. A row is scored by the centroids of the rows outside its fold."""
    return S.centroid_scorer(model, "embedding", EMB_SCALE if run == "a" else 8.0, cosine=run == "b", fold=F.col("fold"), key="vec_id")


def _row() -> list[Column]:
    v = F.col("vec_id")
    return [
        v.alias("row_id"),
        F.concat(F.lit("task_"), (v % 5).cast("string")).alias("task"),
        (v % 5 >= 3).alias("heldout"),
        (v % 3).cast("int").alias("qidx"),
        F.when(v % 2 == 0, "choice").otherwise("score").alias("type"),
        (F.array_position("labels", F.col("label")) - 1).cast("int").alias("gold"),
    ]


def emb_pred(spark: SparkSession, base: str, run: str = "a") -> DataFrame:
    """Out-of-fold predictions of every embedding by the label centroids."""
    scored = S.score(embeddings(spark, base), emb_scorer(emb_model(spark, base), run))
    return scored.select(*_row(), "logits").withColumn("probs", D.softmax(F.col("logits")))


def stored_pred(spark: SparkSession, base: str, run: str = "a") -> DataFrame:
    """The predictions as a stored table: metrics that read them more than once do not score again."""
    return materialise(emb_pred(spark, base, run).drop("logits"), "predictions")


def emb_two_runs(spark: SparkSession, base: str) -> DataFrame:
    """Both runs on one row, scored in one pass: logits_a, logits_b, probs_a, probs_b."""
    model = emb_model(spark, base)
    a = S.score(embeddings(spark, base), emb_scorer(model)).withColumnRenamed("logits", "logits_a").drop("labels")
    b = S.score(a, emb_scorer(model, "b")).withColumnRenamed("logits", "logits_b")
    return b.select(*_row(), "logits_a", "logits_b", D.softmax(F.col("logits_a")).alias("probs_a"), D.softmax(F.col("logits_b")).alias("probs_b"))


def emb_runs(spark: SparkSession, base: str) -> DataFrame:
    """Both runs one below the other (column run), from one scoring pass."""
    t = emb_two_runs(spark, base)
    runs = F.array(*[F.struct(F.lit(r).alias("run"), F.col(f"logits_{r}").alias("logits"), F.col(f"probs_{r}").alias("probs")) for r in "ab"])
    return t.select(*[c for c in t.columns if c[-2:] not in ("_a", "_b")], F.inline(runs))
