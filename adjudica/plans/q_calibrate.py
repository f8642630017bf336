"""Calibration queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from adjudica.functions import dist as D
from adjudica.operators import calibrate as C
from adjudica.operators import metrics as M
from adjudica.plans import views as V
from adjudica.plans.registry import query
from adjudica.sources.tables import materialise, table

R6 = lambda c, name=None: F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name or c)
NAN, INF = "CAST('nan' AS DOUBLE)", "CAST('inf' AS DOUBLE)"


def records(spark, base):
    """Calibration records of three types: choice (logits), score (isolated level logits, yes = logit, no = 0)
    and noul (labelled documents, `views.noul_pred`)."""
    p = V.emb_pred(spark, base, "b")
    none_d, none_l = F.lit(None).cast("array<double>"), F.lit(None).cast("array<array<double>>")
    iso = F.transform("logits", lambda z: F.array(F.lit(0.0), z))
    is_score = F.col("type") == "score"
    main = p.select("row_id", "type", F.when(is_score, none_d).otherwise(F.col("logits")).alias("logits"), none_d.alias("probs"),
                    F.when(is_score, iso).alias("level_logits"), none_l.alias("level_probs"), "gold")
    noul = V.noul_pred(spark, base).select("row_id", F.lit("noul").alias("type"), "logits", none_d.alias("probs"),
                                           none_l.alias("level_logits"), none_l.alias("level_probs"), "gold")
    return main.unionByName(noul)


LSE = "(list_max({z}) / {t} + ln(list_sum(list_transform({z}, lambda x: exp((x - list_max({z})) / {t})))))"
REC_CTE = f"""{V.EMB_CTE}, {V.NOUL_CTE},
rec AS (SELECT row_id, type, CASE WHEN type = 'score' THEN NULL ELSE zb END AS z, CASE WHEN type = 'score' THEN zb END AS lv, gold FROM pred
        UNION ALL SELECT row_id, 'noul', z, NULL, gold FROM noul)"""


def NLL_SQL(t: str) -> str:
    flat = LSE.format(z="z", t=t) + f" - z[gold + 1] / {t}"
    lp = f"list_transform(lv, lambda y: y / {t} - (CASE WHEN y > 0 THEN y / {t} + ln(1 + exp(-y / {t})) ELSE ln(1 + exp(y / {t})) END))"
    iso = f"ln(list_sum(list_transform({lp}, lambda w: exp(w)))) - ({lp})[gold + 1]"
    return f"CASE WHEN lv IS NULL THEN {flat} ELSE {iso} END"


@query("nll_at_t", f"""WITH {REC_CTE} SELECT row_id, type, round({NLL_SQL('1.7')}, 6) AS nll FROM rec WHERE lv IS NULL""")
def nll_at_t(spark, base):
    return records(spark, base).filter(F.col("level_logits").isNull()).select("row_id", "type", R6(C.record_nll(1.7), "nll"))


@query("nll_isolated", f"""WITH {REC_CTE} SELECT row_id, round({NLL_SQL('1.7')}, 6) AS nll FROM rec WHERE lv IS NOT NULL""")
def nll_isolated(spark, base):
    return records(spark, base).filter(F.col("level_logits").isNotNull()).select("row_id", R6(C.record_nll(1.7), "nll"))


STEP = (math.log(C.GRID_HI) - math.log(C.GRID_LO)) / (C.GRID_N - 1)
GRID_SQL = f"exp(ln({C.GRID_LO}) + i * (ln({C.GRID_HI}) - ln({C.GRID_LO})) / {C.GRID_N - 1})"


@query("fit_temperature", f"""WITH {REC_CTE}, grid AS (SELECT {GRID_SQL} AS t FROM range({C.GRID_N}) r(i)),
v AS (SELECT type, t, count(*) AS n, avg({NLL_SQL('t')}) AS nll FROM rec, grid GROUP BY type, t)
SELECT type, max(n) AS n, round(arg_min(t, nll), 6) AS t, round(min(nll), 6) AS nll FROM v GROUP BY type""")
def fit_temperature(spark, base):
    """The grid pass of the fit."""
    return C.best_point(C.grid_pass(records(spark, base), "type"), "type").select("type", "n", R6("t"), R6("nll"))


def _refine(prev: str, step: float) -> str:
    lo, hi = f"greatest({C.GRID_LO}, t * {math.exp(-step)!r})", f"least({C.GRID_HI}, t * {math.exp(step)!r})"
    return f"""(SELECT type, arg_min(t, nll) AS t, min(nll) AS nll, max(n) AS n FROM (SELECT r.type, g.t, count(*) AS n, avg({NLL_SQL('g.t')}) AS nll
      FROM rec2 r JOIN (SELECT type, exp(ln({lo}) + i * (ln({hi}) - ln({lo})) / 100) AS t FROM {prev}, range(101) q(i)) g ON r.type = g.type GROUP BY r.type, g.t) GROUP BY type)"""


@query("fit_by_type", f"""WITH {REC_CTE}, rec2 AS (SELECT 'all' AS type, z, lv, gold FROM rec UNION ALL SELECT type, z, lv, gold FROM rec),
grid AS (SELECT {GRID_SQL} AS t FROM range({C.GRID_N}) r(i)),
b0 AS (SELECT type, arg_min(t, nll) AS t FROM (SELECT type, t, avg({NLL_SQL('t')}) AS nll FROM rec2, grid GROUP BY type, t) GROUP BY type),
b1 AS {_refine('b0', STEP)}, b2 AS {_refine('b1', 2 * STEP / 100)},
one AS (SELECT type, avg({NLL_SQL('1.0')}) AS nll FROM rec2 GROUP BY type)
SELECT b2.type, b2.n, round(b2.t, 3) AS temperature, round(one.nll, 4) AS nll_t1, round(b2.nll, 4) AS nll_fitted FROM b2 JOIN one ON b2.type = one.type WHERE b2.n >= 50 OR b2.type = 'all'""")
def fit_by_type(spark, base):
    return C.fit_by_type(materialise(records(spark, base)))  # every pass of the fit reads the records


SIMPLE_GRID = "CAST([" + ", ".join(f"'{t!r}'" for t in C.log_grid(C.SIMPLE_LO, C.SIMPLE_HI, C.SIMPLE_N)) + "] AS DOUBLE[])"


def SIMPLE_CTE(where: str) -> str:
    return f"""g AS (SELECT unnest({SIMPLE_GRID}) AS t), sv AS (SELECT t, avg(-ln(greatest(1e-12, q))) AS nll FROM
      (SELECT g.t, exp((ln(pg) - ln(list_max(p))) / g.t) / list_sum(list_transform(p, lambda x: exp((ln(x) - ln(list_max(p))) / g.t))) AS q FROM sa, g {where}) GROUP BY t),
      fs AS (SELECT arg_min(t, nll) AS t, min(nll) AS nll FROM sv)"""


@query("fit_simple", f"WITH {V.EMB_CTE}, {SIMPLE_CTE('')} SELECT round(t, 6) AS t, round(nll, 6) AS nll FROM fs")
def fit_simple(spark, base):
    return C.fit_simple(V.emb_pred(spark, base)).select(R6("t"), R6("nll"))


@query("apply_temperature", f"""WITH {V.EMB_CTE}, x AS (SELECT row_id, list_transform(p, lambda v: exp(ln(v) / 1.3)) AS e FROM sa)
SELECT row_id, round(list_max(e) / list_sum(e), 6) AS conf, round(e[1] / list_sum(e), 6) AS p_first FROM x""")
def apply_temperature(spark, base):
    q = V.emb_pred(spark, base).select("row_id", D.retemper(F.col("probs"), 1.3).alias("q"))
    return q.select("row_id", R6(F.array_max("q"), "conf"), R6(D.at(F.col("q"), 0), "p_first"))


@query("heldout_fitted", f"""WITH {V.EMB_CTE}, {SIMPLE_CTE('WHERE NOT heldout')},
x AS (SELECT task, gold, list_transform(p, lambda v: exp(ln(v) / fs.t)) AS e, fs.t FROM sa, fs WHERE heldout),
y AS (SELECT task, gold, t, list_transform(e, lambda v: v / list_sum(e)) AS q FROM x)
SELECT task, round(max(t), 6) AS t, count(*) AS n, round(avg(CAST(list_position(q, list_max(q)) - 1 = gold AS INTEGER)), 6) AS acc,
       round(avg(-ln(greatest(q[gold + 1], 1e-12))), 6) AS nll, round(avg(list_sum(list_transform(q, lambda v, i: power(v - CASE WHEN i - 1 = gold THEN 1.0 ELSE 0.0 END, 2)))), 6) AS brier
FROM y GROUP BY task""")
def heldout_fitted(spark, base):
    pred = V.emb_pred(spark, base)
    t = C.fit_simple(pred.filter(~F.col("heldout"))).select("t").scalar()
    held = pred.filter(F.col("heldout")).withColumn("t", t).withColumn("probs", D.retemper(F.col("probs"), F.col("t")))
    rows = M.per_row(held)
    return rows.groupBy("task").agg(R6(F.max("t"), "t"), F.count(F.lit(1)).alias("n"), R6(F.avg("correct"), "acc"), R6(F.avg("nll"), "nll"), R6(F.avg("brier"), "brier"))


@query("check_records", f"""WITH {V.EMB_CTE}, c AS (SELECT row_id, {V.IDX(V.U('malform', 'row_id'), 12)} AS k FROM pred)
SELECT CASE k WHEN 0 THEN 'type' WHEN 1 THEN 'fields' WHEN 2 THEN 'isolated levels on another type' WHEN 3 THEN 'shape' WHEN 4 THEN 'probabilities' WHEN 5 THEN 'logits'
  WHEN 6 THEN 'logits' WHEN 7 THEN 'noul options' WHEN 8 THEN 'no level fits' WHEN 9 THEN 'gold' WHEN 10 THEN 'gold' ELSE 'ok' END AS reason, count(*) AS n FROM c GROUP BY 1""")
def check_records(spark, base):
    """Every record of the table, each damaged in one of eleven ways or left whole (chosen by hash)."""
    from adjudica.functions.hashing import pick_index, u8

    p = V.emb_pred(spark, base).withColumn("k", pick_index(u8("malform", "row_id"), 12))
    k, z = F.col("k"), F.col("logits")
    pairs = F.transform(z, lambda x: F.array(F.lit(0.0), x))
    dead = F.transform(z, lambda x: F.array(F.lit(1.0), F.lit(0.0)))
    nan, ninf = F.lit(float("nan")), F.lit(float("-inf"))
    logits = (
        F.when(k.isin(2, 8), F.lit(None)).when(k == 4, F.lit(None)).when(k == 3, F.slice(z, 1, 1)).when(k == 5, F.array_append(z, nan))
        .when(k == 6, F.transform(z, lambda x: ninf)).otherwise(z)
    )
    probs = F.when(k == 1, F.col("probs")).when(k == 4, F.array_append("probs", F.lit(-0.1)))
    d = p.select(
        "row_id",
        F.when(k == 0, "rank").when(k == 7, "noul").when(k == 8, "score").otherwise("choice").alias("type"),
        logits.alias("logits"), probs.alias("probs"), F.when(k == 2, pairs).alias("level_logits"), F.when(k == 8, dead).alias("level_probs"),
        F.when(k == 9, 99).when(k == 10, F.lit(None).cast("int")).otherwise(F.col("gold")).alias("gold"),
    )
    return d.groupBy(F.coalesce(C.record_reason(), F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("collect_records", f"""WITH {V.EMB_CTE} SELECT row_id, type, gold, round(pg, 6) AS p_gold FROM sa""")
def collect_records(spark, base):
    """Predictions name their options; golds come from the source table as option names."""
    p = V.emb_pred(spark, base).withColumn("names", F.transform(F.sequence(F.lit(0), F.size("probs") - 1), lambda i: F.concat(F.lit("L"), i.cast("string")))).drop("gold")
    golds = table(spark, base, "embeddings").select(F.col("vec_id").alias("row_id"), F.concat(F.lit("L"), F.col("label").cast("string")).alias("gold_name"))
    rec = C.collect_records(p, golds, ["row_id"])
    return rec.select("row_id", "type", "gold", R6(D.at(F.col("probs"), F.col("gold")), "p_gold"))
