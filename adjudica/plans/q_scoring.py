"""Scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from adjudica.functions import dist as D
from adjudica.operators import scoring as S
from adjudica.operators.convert import strings
from adjudica.plans import views as V
from adjudica.plans.q_answers import MICRO, micro
from adjudica.plans.registry import query
from adjudica.sources.tables import spread, table


@query("score_centroid", f"WITH {V.EMB_CTE} SELECT row_id AS vec_id, {MICRO('za')} AS logits FROM pred")
def score_centroid(spark, base):
    """Fold-out: every row is scored by the centroids of the other half."""
    return S.score(V.embeddings(spark, base), V.emb_scorer(V.emb_model(spark, base))).select("vec_id", micro(F.col("logits"), "logits"))


@query("score_wide", f"WITH {V.EMB_CTE} SELECT row_id AS vec_id, gold, {MICRO('zb')} AS logits FROM pred")
def score_wide(spark, base):
    """The same by a model in blocks of a few labels, as one of many labels is scored."""
    model = V.emb_model(spark, base)
    width = model.agg(F.max("i") + 1).first()[0] or 1
    scorer = S.centroid_scorer(model, "embedding", 8.0, cosine=True, fold=F.col("fold"), key="vec_id", cells=9 * width)
    s = S.score(V.embeddings(spark, base), scorer)
    pairs = F.array_sort(F.arrays_zip(F.col("labels").alias("label"), F.col("logits").alias("z")))
    s = s.withColumn("pairs", pairs)
    gold = F.array_position(F.transform("pairs", lambda p: p["label"]), F.col("label")) - 1
    return s.select("vec_id", gold.cast("int").alias("gold"), micro(F.transform("pairs", lambda p: p["z"]), "logits"))


LANG_OPTIONS = ("der die und das ist", "the of and to in", "el la de que y", "le la et les des")
W = r"list_distinct(list_filter(regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''))"


@query("score_lexical", f"""WITH x AS (SELECT doc_id, {W.format(c='text')} AS w FROM documents), y AS (SELECT doc_id, list_transform({list(LANG_OPTIONS)!r}, lambda o: len(list_intersect(w, string_split(o, ' ')))) AS s FROM x)
SELECT doc_id, array_to_string(list_transform(s, lambda v: CAST(v AS VARCHAR)), ',') AS overlaps, CAST(list_position(s, list_max(s)) - 1 AS INTEGER) AS pred FROM y""")
def score_lexical(spark, base):
    d = spread(table(spark, base, "documents").select("doc_id", "text")).select("doc_id", "text", strings(*LANG_OPTIONS).alias("options"))
    s = S.score(d, S.lexical_scorer("text", "options"))
    return s.select("doc_id", F.array_join(F.transform("logits", lambda v: v.cast("int").cast("string")), ",").alias("overlaps"), D.argmax(F.col("logits")).alias("pred"))


@query("score_custom", """SELECT doc_id, CAST(length(text) % 97 AS DOUBLE) AS z0, 3.0::DOUBLE AS z1 FROM documents""")
def score_custom(spark, base):
    """A user's Python model behind the scorer contract: loaded once per worker, fed Arrow batches."""

    def load():
        def model(contexts, options):
            return [[float(len(c) % 97) if i == 0 else float(len(o)) for i, o in enumerate(opts)] for c, opts in zip(contexts, options)]

        return model

    d = table(spark, base, "documents").select("doc_id", F.col("text").alias("context"), strings("no", "yes").alias("options"))
    s = S.score(d, S.python_scorer(load))
    return s.select("doc_id", F.col("logits")[0].alias("z0"), F.col("logits")[1].alias("z1"))


@query("score_trained")
def score_trained(spark, base):
    e = V.embeddings(spark, base)
    scorer = S.trained_scorer(e.filter("fold = 0"), "embedding", "label")
    rows = S.score(e.filter("fold = 1"), scorer)
    p = D.softmax(F.col("logits"))
    return rows.select("vec_id", "label", D.argmax(F.col("logits")).alias("pred"), F.round(F.array_max(p), 6).alias("conf"))


@query("train_loss", f"""WITH {V.EMB_CTE}, l AS (SELECT row_id, task, gold, list_transform(p, lambda v: ln(v)) AS lp, brier FROM sa)
SELECT task, round(avg(-0.95 * lp[gold + 1] - 0.05 * list_sum(lp) / len(lp) + 0.3 * brier), 6) AS loss FROM l GROUP BY task""")
def train_loss(spark, base):
    p = V.emb_pred(spark, base)
    return p.groupBy("task").agg(F.round(F.avg(S.train_loss(F.col("logits"), F.col("gold"), 0.05, 0.3)), 6).alias("loss"))
