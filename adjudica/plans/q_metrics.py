"""Evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from adjudica.functions import dist as D
from adjudica.operators import metrics as M
from adjudica.plans import views as V
from adjudica.plans.registry import query

R6 = lambda c, name=None: F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name or c)

CURVE_CTE = """
dd AS (SELECT task, conf, count(*) AS m, sum(1 - correct) AS e FROM sa GROUP BY task, conf),
ww AS (SELECT *, coalesce(sum(m) OVER w, 0) AS n0, coalesce(sum(e) OVER w, 0) AS e0, sum(m) OVER (PARTITION BY task) AS total FROM dd
       WINDOW w AS (PARTITION BY task ORDER BY conf DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
kk AS (SELECT task, n0, e0, m, e, total, unnest(generate_series(1, m)) AS j FROM ww),
ss AS (SELECT task, avg((e0 + j * e / m) / (n0 + j)) AS aurc,
              sum(CASE WHEN n0 + j <= greatest(1, round_even(0.8 * total, 0)) THEN 1 - e / m ELSE 0 END) / max(greatest(1, round_even(0.8 * total, 0))) AS acc_at_80,
              sum(CASE WHEN n0 + j <= greatest(1, round_even(0.5 * total, 0)) THEN 1 - e / m ELSE 0 END) / max(greatest(1, round_even(0.5 * total, 0))) AS acc_at_50
       FROM kk GROUP BY task)
"""
ECE_SQL = """SELECT task, sum(abs(sc - sy)) / (SELECT count(*) FROM sa x WHERE x.task = b.task) AS ece
  FROM (SELECT task, least(15, greatest(1, ceil(conf * 15))) AS bin, sum(conf) AS sc, sum(correct) AS sy FROM sa WHERE conf > 0 GROUP BY 1, 2) b GROUP BY task"""


@query("eval_summary", f"""WITH {V.EMB_CTE}, {CURVE_CTE}, ee AS ({ECE_SQL})
SELECT a.task, a.n, round(a.acc, 6) AS acc, round(a.nll, 6) AS nll, round(a.brier, 6) AS brier, round(ee.ece, 6) AS ece, round(ss.aurc, 6) AS aurc,
       round(ss.acc_at_80, 6) AS acc_at_80, round(ss.acc_at_50, 6) AS acc_at_50, round(a.chance, 6) AS chance, round(a.mean_conf, 6) AS mean_conf
FROM (SELECT task, count(*) AS n, avg(correct) AS acc, avg(nll) AS nll, avg(brier) AS brier, avg(chance) AS chance, avg(conf) AS mean_conf FROM sa GROUP BY task) a
JOIN ss ON a.task = ss.task JOIN ee ON a.task = ee.task""")
def eval_summary(spark, base):
    s = M.summarize(V.stored_pred(spark, base), ["task"])
    return s.select("task", "n", *[R6(c) for c in ("acc", "nll", "brier", "ece", "aurc", "acc_at_80", "acc_at_50", "chance", "mean_conf")])


@query("ece", f"WITH {V.EMB_CTE}, ee AS ({ECE_SQL}) SELECT task, round(ece, 6) AS ece FROM ee")
def ece(spark, base):
    rows = M.per_row(V.emb_pred(spark, base))
    b = M.ece_bin(F.col("conf"))
    return M.ece(rows, ["task"], F.when(b > 0, b)).select("task", R6("ece"))


@query("ece10", f"""WITH {V.EMB_CTE}
SELECT task, round(sum(abs(sc - sy)) / sum(n), 6) AS ece10 FROM
  (SELECT task, least(9, floor(conf * 10)) AS bin, count(*) AS n, sum(conf) AS sc, sum(correct) AS sy FROM sa GROUP BY 1, 2) GROUP BY task""")
def ece10(spark, base):
    return M.ece(M.per_row(V.emb_pred(spark, base)), ["task"], M.ece_bin_floor(F.col("conf")), "ece10").select("task", R6("ece10"))


@query("aurc", f"WITH {V.EMB_CTE}, {CURVE_CTE} SELECT task, round(aurc, 6) AS aurc FROM ss")
def aurc(spark, base):
    blocks = M.confidence_blocks(M.per_row(V.stored_pred(spark, base)), ["task"])
    return M.aurc_and_selective(blocks, ["task"], {}).select("task", R6("aurc"))


@query("selective_acc", f"WITH {V.EMB_CTE}, {CURVE_CTE} SELECT task, round(acc_at_80, 6) AS acc_at_80, round(acc_at_50, 6) AS acc_at_50 FROM ss")
def selective_acc(spark, base):
    blocks = M.confidence_blocks(M.per_row(V.stored_pred(spark, base)), ["task"])
    out = M.aurc_and_selective(blocks, ["task"], {"acc_at_80": 0.8, "acc_at_50": 0.5})
    return out.select("task", R6("acc_at_80"), R6("acc_at_50"))


@query("per_question", f"WITH {V.EMB_CTE} SELECT task, qidx, count(*) AS n, round(avg(correct), 6) AS acc FROM sa GROUP BY task, qidx")
def per_question(spark, base):
    rows = M.per_row(V.emb_pred(spark, base))
    return rows.groupBy("task", "qidx").agg(F.count(F.lit(1)).alias("n"), R6(F.avg("correct"), "acc"))


@query("aggregate_split", f"""WITH {V.EMB_CTE}, t AS (SELECT heldout, task, avg(correct) AS acc, avg(nll) AS nll, avg(brier) AS brier FROM sa GROUP BY heldout, task)
SELECT heldout, count(*) AS tasks, round(avg(acc), 6) AS acc, round(avg(nll), 6) AS nll, round(avg(brier), 6) AS brier FROM t GROUP BY heldout""")
def aggregate_split(spark, base):
    rows = M.per_row(V.emb_pred(spark, base))
    per_task = M.summary_from_bins(M.bin_table(rows, ["heldout", "task"], M.ece_bin(F.col("conf"))), ["heldout", "task"])
    out = M.aggregate_split(per_task, ["heldout"], ["acc", "nll", "brier"])
    return out.select("heldout", "tasks", R6("acc"), R6("nll"), R6("brier"))


@query("macro_micro", f"""WITH {V.EMB_CTE}, t AS (SELECT heldout, task, count(*) AS n, sum(correct) AS c FROM sa GROUP BY heldout, task)
SELECT round(avg(c / n), 6) AS macro, round(sum(c) / sum(n), 6) AS micro, round(avg(CASE WHEN heldout THEN c / n END), 6) AS macro_untrained FROM t""")
def macro_micro(spark, base):
    t = M.per_row(V.emb_pred(spark, base)).groupBy("heldout", "task").agg(F.count(F.lit(1)).alias("n"), F.sum("correct").alias("c"))
    acc = F.col("c") / F.col("n")
    return t.agg(R6(F.avg(acc), "macro"), R6(F.sum("c") / F.sum("n"), "micro"), R6(F.avg(F.when(F.col("heldout"), acc)), "macro_untrained"))


@query("score_mae", f"""WITH {V.EMB_CTE}
SELECT task, count(*) AS n, round(avg(abs(list_sum(list_transform(p, lambda v, i: v * (i - 1))) - gold)), 6) AS mae FROM sa WHERE type = 'score' GROUP BY task""")
def score_mae(spark, base):
    p = V.emb_pred(spark, base).filter(F.col("type") == "score")
    return p.groupBy("task").agg(F.count(F.lit(1)).alias("n"), R6(F.avg(F.abs(D.expected_level(F.col("probs")) - F.col("gold"))), "mae"))


@query("total_variation", f"""WITH {V.EMB_CTE}
SELECT a.task, count(*) AS n, round(avg(0.5 * list_sum(list_transform(list_zip(a.p, b.p), lambda t: abs(t[1] - t[2])))), 6) AS tv,
       round(avg(CAST(a.pred = b.pred AS INTEGER)), 6) AS argmax_agreement FROM sa a JOIN sb b ON a.row_id = b.row_id GROUP BY a.task""")
def total_variation(spark, base):
    t = V.emb_two_runs(spark, base)
    p, q = F.col("probs_a"), F.col("probs_b")
    return t.groupBy("task").agg(
        F.count(F.lit(1)).alias("n"),
        R6(F.avg(D.total_variation(p, q)), "tv"),
        R6(F.avg((D.argmax(p) == D.argmax(q)).cast("int")), "argmax_agreement"),
    )


@query("kl_parent", f"""WITH {V.EMB_CTE}
SELECT b.task, round(avg(list_sum(list_transform(list_zip(b.p, a.p), lambda t: CASE WHEN t[1] > 0 THEN t[1] * (ln(t[1]) - ln(greatest(t[2], 1e-12))) ELSE 0 END))), 6) AS kl
FROM sa a JOIN sb b ON a.row_id = b.row_id GROUP BY b.task""")
def kl_parent(spark, base):
    t = V.emb_two_runs(spark, base)
    return t.groupBy("task").agg(R6(F.avg(D.kl(F.col("probs_b"), F.col("probs_a"))), "kl"))


@query("auroc", f"""WITH {V.EMB_CTE}, pairs AS (SELECT a.task, sum(CASE WHEN a.conf > b.conf THEN 1.0 WHEN a.conf = b.conf THEN 0.5 ELSE 0 END) AS wins, count(*) AS n
   FROM sa a JOIN sa b ON a.task = b.task AND a.correct = 1 AND b.correct = 0 GROUP BY a.task),
x AS (SELECT task, avg(CAST(round(pg, 4) IN (0, 1) AS INTEGER)) AS extreme_share FROM sa GROUP BY task)
SELECT pairs.task, round(wins / n, 6) AS auroc, round(extreme_share, 6) AS extreme_share FROM pairs JOIN x ON pairs.task = x.task""")
def auroc(spark, base):
    rows = M.per_row(V.stored_pred(spark, base))
    a = M.auroc(rows, ["task"], "conf", F.col("correct") == 1)
    served = F.round(D.at(F.col("probs"), F.col("gold")), 4)
    x = rows.groupBy("task").agg(F.avg(served.isin(0.0, 1.0).cast("int")).alias("extreme_share"))
    return a.join(x, "task").select("task", R6("auroc"), R6("extreme_share"))


@query("band_score", f"""WITH {V.NOUL_CTE}, x AS (SELECT task, gold, 1 / (1 + exp(-z[2] / t)) AS p, t FROM noul, (VALUES (0.05), (0.5), (1.0)) temps(t))
SELECT task, CAST(t AS DOUBLE) AS t, count(*) AS n, round(avg(CAST((p >= 0.5) = (gold = 1) AS INTEGER)), 6) AS acc, round(avg(CAST(CASE WHEN p >= 0.8 THEN gold = 1 WHEN p <= 0.2 THEN gold = 0 ELSE false END AS INTEGER)), 6) AS band_acc FROM x GROUP BY task, t""")
def band_score(spark, base):
    """Yes/no accuracy, and accuracy when a probability between 0.2 and 0.8 counts as wrong, at three temperatures."""
    d = V.noul_pred(spark, base).withColumn("t", F.explode(F.array(*[F.lit(t) for t in (0.05, 0.5, 1.0)])))
    d = d.withColumn("p", D.at(D.softmax(F.col("logits"), F.col("t")), 1))
    return d.groupBy("task", "t").agg(F.count(F.lit(1)).alias("n"), R6(F.avg(((F.col("p") >= 0.5) == (F.col("gold") == 1)).cast("int")), "acc"),
                                      R6(F.avg(M.band_correct(F.col("p"), F.col("gold"), 0.2, 0.8).cast("int")), "band_acc"))


@query("chance_corrected", f"WITH {V.EMB_CTE} SELECT task, round((avg(correct) - avg(chance)) / nullif(1 - avg(chance), 0), 6) AS score FROM sa GROUP BY task")
def chance_corrected(spark, base):
    rows = M.per_row(V.emb_pred(spark, base))
    acc, chance = F.avg("correct"), F.avg("chance")
    return rows.groupBy("task").agg(R6(F.try_divide(acc - chance, 1 - chance), "score"))


@query("unanimity", f"""WITH {V.EMB_CTE}, v AS (SELECT a.row_id, a.task, a.pred AS x, b.pred AS y,
   list_position(list_transform(list_zip(a.p, b.p), lambda t: t[1] + t[2]), list_max(list_transform(list_zip(a.p, b.p), lambda t: t[1] + t[2]))) - 1 AS z FROM sa a JOIN sb b ON a.row_id = b.row_id)
SELECT task, count(*) AS n, round(avg(CAST(x = y AND y = z AS INTEGER)), 6) AS unanimous FROM v GROUP BY task""")
def unanimity(spark, base):
    t = V.emb_two_runs(spark, base)
    mean = F.zip_with("probs_a", "probs_b", lambda a, b: a + b)
    picks = F.array(D.argmax(F.col("probs_a")), D.argmax(F.col("probs_b")), D.argmax(mean))
    same = (F.size(F.array_distinct(picks)) == 1).cast("int")
    return t.groupBy("task").agg(F.count(F.lit(1)).alias("n"), R6(F.avg(same), "unanimous"))


ACTIONS = "['fill', 'check', 'click', 'skip']"


@query("error_slices", f"""WITH {V.EMB_CTE}, x AS (SELECT *, {ACTIONS}[gold % 4 + 1] AS action, {ACTIONS}[pred % 4 + 1] AS pred_action FROM sa)
SELECT action, count(*) AS n, round(avg(correct), 6) AS acc, CAST(sum(CAST(correct = 0 AND action <> pred_action AS INTEGER)) AS BIGINT) AS wrong_action,
       CAST(sum(CAST(correct = 0 AND action = pred_action AS INTEGER)) AS BIGINT) AS wrong_target, round(avg(CAST(conf >= 0.3 AS INTEGER)), 6) AS coverage,
       round(sum(CASE WHEN conf >= 0.3 THEN correct ELSE 0 END) / greatest(1, sum(CAST(conf >= 0.3 AS INTEGER))), 6) AS selective_acc FROM x GROUP BY action""")
def error_slices(spark, base):
    names = F.array(*[F.lit(a) for a in ("fill", "check", "click", "skip")])
    x = M.per_row(V.emb_pred(spark, base)).withColumn("action", F.get(names, F.col("gold") % 4)).withColumn("pred_action", F.get(names, F.col("pred") % 4))
    wrong, same, sure = F.col("correct") == 0, F.col("action") == F.col("pred_action"), F.col("conf") >= 0.3
    return x.groupBy("action").agg(
        F.count(F.lit(1)).alias("n"),
        R6(F.avg("correct"), "acc"),
        F.count_if(wrong & ~same).alias("wrong_action"),
        F.count_if(wrong & same).alias("wrong_target"),
        R6(F.avg(sure.cast("int")), "coverage"),
        R6(F.sum(F.when(sure, F.col("correct")).otherwise(0)) / F.greatest(F.lit(1), F.count_if(sure)), "selective_acc"),
    )


@query("battery_report", f"""WITH {V.EMB_CTE}, x AS (SELECT *, ['generic', 'specific', 'catchall'][gold % 3 + 1] AS kind, list_sum(p[1:5]) AS yes, CAST(gold < 5 AS INTEGER) AS y FROM sa)
SELECT kind, count(*) AS n, round(avg(correct), 6) AS acc, round(avg(CAST((yes > 0.5) = (y = 1) AS INTEGER)), 6) AS noul_acc, round(avg(power(yes - y, 2)), 6) AS noul_brier,
       CAST(sum(CAST(gold >= 8 AND pred <= 3 AS INTEGER)) AS BIGINT) AS destructive_called_safe FROM x GROUP BY kind""")
def battery_report(spark, base):
    kind = F.get(F.array(F.lit("generic"), F.lit("specific"), F.lit("catchall")), F.col("gold") % 3)
    x = M.per_row(V.emb_pred(spark, base)).withColumn("kind", kind).withColumn("yes", D.asum(F.slice("probs", 1, 5))).withColumn("y", (F.col("gold") < 5).cast("int"))
    return x.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"),
        R6(F.avg("correct"), "acc"),
        R6(F.avg(((F.col("yes") > 0.5) == (F.col("y") == 1)).cast("int")), "noul_acc"),
        R6(F.avg(F.pow(F.col("yes") - F.col("y"), 2)), "noul_brier"),
        F.count_if((F.col("gold") >= 8) & (F.col("pred") <= 3)).alias("destructive_called_safe"),
    )


ENT = "-list_sum(list_transform({p}, lambda v: CASE WHEN v > 0 THEN v * ln(v) ELSE 0 END))"


@query("mean_entropy", f"""WITH {V.EMB_CTE}, x AS (SELECT 'a' AS run, type, za AS z, p FROM pa UNION ALL SELECT 'b', type, zb, p FROM pb),
y AS (SELECT run, type, p, {V.SOFTMAX('z', '1.4')} AS pt FROM x)
SELECT run, type, round(avg({ENT.format(p='p')}), 6) AS entropy_t1, round(avg({ENT.format(p='pt')}), 6) AS entropy_served FROM y GROUP BY run, type""")
def mean_entropy(spark, base):
    served = D.softmax(F.col("logits"), 1.4)
    return V.emb_runs(spark, base).withColumn("served", served).groupBy("run", "type").agg(
        R6(F.avg(D.entropy(F.col("probs"))), "entropy_t1"), R6(F.avg(D.entropy(F.col("served"))), "entropy_served"))


@query("belief_excess", f"""WITH {V.EMB_CTE}
SELECT a.task, round(avg(list_sum(list_transform(list_zip(a.p, b.p), lambda t: CASE WHEN t[1] > 0 THEN t[1] * (ln(t[1]) - ln(greatest(t[2], 1e-12))) ELSE 0 END))), 6) AS excess
FROM sa a JOIN sb b ON a.row_id = b.row_id GROUP BY a.task""")
def belief_excess(spark, base):
    """Mean log-score gap of the stated distribution (run b) to the exact law (run a)."""
    t = V.emb_two_runs(spark, base).select("task", F.col("probs_a").alias("law"), F.col("probs_b").alias("stated"))
    cross = -D.asum(F.zip_with("law", "stated", lambda p, q: F.when(p > 0, p * F.log(F.greatest(q, F.lit(1e-12)))).otherwise(0.0)))
    return t.groupBy("task").agg(R6(F.avg(cross - D.entropy(F.col("law"))), "excess"))
