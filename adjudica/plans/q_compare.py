"""Run comparison and serving statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from adjudica.functions import dist as D
from adjudica.functions.hashing import chance, u8
from adjudica.operators import answers as A
from adjudica.operators import compare as K
from adjudica.operators import metrics as M
from adjudica.operators import requests as R
from adjudica.plans import views as V
from adjudica.plans.registry import query
from adjudica.sources.tables import materialise, spread, table

R6 = lambda c, name=None: F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name or c)


def both_rows(spark, base):
    """Row metrics of both runs with a run column."""
    return M.per_row(V.emb_runs(spark, base))


TASK_METRICS = "tm AS (SELECT 'a' AS run, task, avg(correct) AS acc, avg(nll) AS nll FROM sa GROUP BY task UNION ALL SELECT 'b', task, avg(correct), avg(nll) FROM sb GROUP BY task)"


def task_metrics(spark, base):
    return both_rows(spark, base).groupBy("run", "task").agg(F.avg("correct").alias("acc"), F.avg("nll").alias("nll"))


@query("run_pivot", f"""WITH {V.EMB_CTE}, {TASK_METRICS} SELECT task, round(max(CASE WHEN run = 'a' THEN acc END), 6) AS a_acc, round(max(CASE WHEN run = 'a' THEN nll END), 6) AS a_nll,
  round(max(CASE WHEN run = 'b' THEN acc END), 6) AS b_acc, round(max(CASE WHEN run = 'b' THEN nll END), 6) AS b_nll FROM tm GROUP BY task""")
def run_pivot(spark, base):
    p = K.run_pivot(task_metrics(spark, base), "task", "run", ["a", "b"], ["acc", "nll"])
    return p.select("task", R6("a_acc"), R6("a_nll"), R6("b_acc"), R6("b_nll"))


@query("paired_bootstrap", f"""WITH {V.EMB_CTE}, {TASK_METRICS}, d AS (SELECT task, max(CASE WHEN run = 'b' THEN nll END) - max(CASE WHEN run = 'a' THEN nll END) AS delta FROM tm GROUP BY task),
arr AS (SELECT array_agg(delta ORDER BY task) AS d, count(*) AS n FROM d), rs AS (SELECT r.id, avg(d[1 + {V.IDX(V.U('bootstrap', 'r.id', 'q.j'), 'n')}]) AS m FROM arr, range(4000) r(id), range(n) q(j) GROUP BY r.id)
SELECT (SELECT n FROM arr) AS tasks, round((SELECT avg(delta) FROM d), 6) AS delta, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high FROM rs""")
def paired_bootstrap(spark, base):
    p = K.run_pivot(task_metrics(spark, base), "task", "run", ["a", "b"], ["acc", "nll"])
    d = p.select("task", (F.col("b_nll") - F.col("a_nll")).alias("delta"))
    return K.paired_bootstrap(spark, d, "task", "delta").select("tasks", R6("delta"), R6("ci_low"), R6("ci_high"))


ISO_CTE = """iso AS (SELECT task, gold, p AS lw, list_transform(zb, lambda x: 1 / (1 + exp(-x))) AS fit FROM pa),
isn AS (SELECT *, list_sum(fit) AS mass, list_transform(fit, lambda x: x / list_sum(fit)) AS ip FROM iso),
isr AS (SELECT task, 'listwise' AS reading, gold, lw AS p, CAST(NULL AS DOUBLE) AS mass FROM isn UNION ALL SELECT task, 'isolated', gold, ip, mass FROM isn),
isx AS (SELECT *, list_max(p) AS conf, list_position(p, list_max(p)) - 1 AS pred FROM isr)"""


@query("isolated_vs_listwise", f"""WITH {V.EMB_CTE}, {ISO_CTE},
e AS (SELECT reading, task, sum(abs(sc - sy)) / sum(n) AS ece FROM (SELECT reading, task, ceil(conf * 15) AS b, count(*) AS n, sum(conf) AS sc, sum(CAST(pred = gold AS INTEGER)) AS sy FROM isx GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT isx.reading, isx.task, count(*) AS n, round(avg(CAST(pred = gold AS INTEGER)), 6) AS acc, round(avg(-ln(greatest(p[gold + 1], 1e-12))), 6) AS nll, round(max(e.ece), 6) AS ece,
  round(avg(abs(list_sum(list_transform(p, lambda v, i: v * (i - 1))) - gold)), 6) AS mae, round(avg(mass), 6) AS mean_mass FROM isx JOIN e ON e.reading = isx.reading AND e.task = isx.task GROUP BY 1, 2""")
def isolated_vs_listwise(spark, base):
    j = V.emb_two_runs(spark, base).select("task", "gold", F.col("probs_a").alias("listwise"), F.transform("logits_b", lambda x: 1 / (1 + F.exp(-x))).alias("fit"))
    readings = F.array(
        F.struct(F.lit("listwise").alias("reading"), F.col("listwise").alias("probs"), F.lit(None).cast("double").alias("mass")),
        F.struct(F.lit("isolated").alias("reading"), A.combine_levels(F.col("fit")).alias("probs"), D.asum(F.col("fit")).alias("mass")),
    )
    r = M.per_row(j.select("task", "gold", F.inline(readings)))
    s = M.summary_from_bins(M.bin_table(r, ["reading", "task"], M.ece_bin(F.col("conf"))), ["reading", "task"])
    extra = r.groupBy("reading", "task").agg(
        F.avg(F.abs(D.expected_level(F.col("probs")) - F.col("gold"))).alias("mae"), F.avg("mass").alias("mean_mass"))
    return s.join(extra, ["reading", "task"]).select("reading", "task", "n", R6("acc"), R6("nll"), R6("ece"), R6("mae"), R6("mean_mass"))


@query("paired_bootstrap_rows", f"""WITH {V.EMB_CTE}, d AS (SELECT a.row_id, a.task, b.nll - a.nll AS delta FROM sa a JOIN sb b ON a.row_id = b.row_id),
h AS (SELECT *, md5('bootstrap_rows|' || row_id) AS m FROM d),
u AS (SELECT *, CAST('0x' || substr(m, 1, 8) AS BIGINT) % {K.PRIME} AS a, CAST('0x' || substr(m, 9, 8) AS BIGINT) % {K.PRIME} AS b FROM h),
w AS (SELECT task, delta, r, len(list_filter({list(K.POISSON)}, lambda c: (a + r * b) % {K.PRIME} >= c)) AS w FROM u, range(200) t(r)),
s AS (SELECT task, r, sum(w * delta) / sum(w) AS m FROM w GROUP BY task, r), n AS (SELECT task, count(*) AS n, avg(delta) AS delta FROM d GROUP BY task)
SELECT n.task, max(n) AS n, round(max(delta), 6) AS delta, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high FROM n JOIN s ON s.task = n.task GROUP BY n.task""")
def paired_bootstrap_rows(spark, base):
    """Difference of the two runs' losses per task, rows resampled."""
    t = V.emb_two_runs(spark, base)
    loss = lambda p: D.nll(F.get(F.col(p), F.col("gold")))
    d = t.select("row_id", "task", (loss("probs_b") - loss("probs_a")).alias("delta"))
    return K.paired_bootstrap_rows(d, ["task"], ["row_id"], "delta").select("task", "n", R6("delta"), R6("ci_low"), R6("ci_high"))


# Three questions whose texts hold words of each other's options: a reader that sees the earlier questions is drawn to them.
ORDER_QS = (("Is it about the sea or about the road?", ("the sea", "the road")), ("Which words fit the text best?", ("the of and", "der die und", "le la et", "el la de")), ("Is it the text of a child or of a poet?", ("of a child", "of a poet", "und")))
ORDER_LANGS = ("en", "de", "fr", "es")
WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''))"
ORDER_CTE = f"""docs AS (SELECT doc_id, lang, {WORDS.format(c='text')} AS w, [doc_id % 2, list_position({list(ORDER_LANGS)}, lang) - 1, doc_id % 3] AS golds FROM documents),
q(k, ask, options) AS (VALUES {', '.join(f"({k}, {WORDS.format(c=repr(t))}, [{', '.join(WORDS.format(c=repr(o)) for o in opts)}])" for k, (t, opts) in enumerate(ORDER_QS))}),
perms(variant, part, perm) AS (VALUES ('packed', 0, [0, 1, 2]), ('reversed', 0, [2, 1, 0]), ('alone', 0, [0]), ('alone', 1, [1]), ('alone', 2, [2])),
asked AS (SELECT variant, part, unnest(perm) AS k, unnest(range(len(perm))) AS j, perm FROM perms),
seen AS (SELECT variant, part, k, q.options, (SELECT coalesce(flatten(list(p.ask)), []::VARCHAR[]) FROM q p WHERE list_contains(perm[1:j], p.k)) AS earlier FROM asked JOIN q USING (k)),
z AS (SELECT doc_id, lang, golds[k + 1] AS gold, variant, part, k, list_transform(options, lambda o: len(list_intersect(o, list_concat(w, earlier)))::DOUBLE) AS z FROM docs, seen),
pr AS (SELECT * EXCLUDE (z), {V.SOFTMAX('z')} AS p FROM z)"""


def ordered_answers(spark, base):
    """The three questions of every document, scored in every order: each sees the document and the questions before it."""
    split = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    qs = F.array(*[F.struct(split(F.lit(t)).alias("ask"), F.array(*[split(F.lit(o)) for o in opts]).alias("options")) for t, opts in ORDER_QS])
    asked = spark.range(1).select(qs.alias("qs")).scalar()  # one value of all rows: literals are not split again in each
    langs = F.array(*[F.lit(x) for x in ORDER_LANGS])
    i = F.col("doc_id").cast("int")
    golds = F.array(i % 2, (F.array_position(langs, F.col("lang")) - 1).cast("int"), i % 3)
    # of a text only the words of some option can count: they are taken out before the rows are multiplied by the orders
    of_options = F.array_distinct(F.flatten(F.flatten(F.transform("qs", lambda q: q["options"]))))
    d = spread(table(spark, base, "documents").select("doc_id", "lang", "text")).withColumn("qs", asked)
    d = d.select("doc_id", "lang", golds.alias("golds"), F.array_intersect(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), of_options).alias("w"), "qs")
    d = R.order_variants(d)

    def probs(q, j):
        known = F.array_union(F.col("w"), F.flatten(F.transform(F.filter("qs", lambda _, i: i < j), lambda p: p["ask"])))
        return D.let(known, lambda k: D.let(F.transform(q["options"], lambda o: F.size(F.array_intersect(o, k)).cast("double")), lambda z: D.softmax(z)))

    return d.withColumn("p", F.transform("qs", probs)).select("doc_id", "lang", "golds", "variant", "perm", "p")


@query("question_orders", f"""WITH {ORDER_CTE}, t AS (SELECT doc_id, variant, array_to_string(list(array_to_string(list_transform(p, lambda v: CAST(CAST(round(v * 1e6) AS BIGINT) AS VARCHAR)), ',') ORDER BY k), ';') AS p FROM pr GROUP BY doc_id, variant)
SELECT doc_id, max(p) FILTER (variant = 'packed') AS packed, max(p) FILTER (variant = 'reversed') AS reversed, max(p) FILTER (variant = 'alone') AS alone FROM t GROUP BY doc_id""")
def question_orders(spark, base):
    """Probabilities of all orders, realigned to the order of the request."""
    a = R.realign(ordered_answers(spark, base), ["doc_id"], "p")
    text = lambda v: F.array_join(F.transform(v, lambda p: F.array_join(F.transform(p, lambda x: F.round(x * 1e6).cast("bigint").cast("string")), ",")), ";").alias(v)
    return a.select("doc_id", *[text(v) for v in R.VARIANTS])


@query("independence", f"""WITH {ORDER_CTE}, y AS (SELECT *, list_position(p, list_max(p)) - 1 AS pick FROM pr),
x AS (SELECT a.lang, a.gold, a.pick AS pa, b.pick AS pb, c.pick AS pc, list_max(list_transform(list_zip(a.p, b.p), lambda t: abs(t[1] - t[2]))) AS db, list_max(list_transform(list_zip(a.p, c.p), lambda t: abs(t[1] - t[2]))) AS dc
      FROM y a JOIN y b ON a.doc_id = b.doc_id AND a.k = b.k JOIN y c ON a.doc_id = c.doc_id AND a.k = c.k WHERE a.variant = 'packed' AND b.variant = 'reversed' AND c.variant = 'alone')
SELECT lang AS task, count(*) AS n, round(avg(CAST(pa = gold AS INTEGER)), 6) AS acc_packed, round(avg(CAST(pb = gold AS INTEGER)), 6) AS acc_reversed, round(avg(CAST(pc = gold AS INTEGER)), 6) AS acc_alone,
  round(avg(db), 6) AS dp_reversed_mean, round(quantile_cont(db, 0.95), 6) AS dp_reversed_p95, round(avg(CAST(pa <> pb AS INTEGER)), 6) AS flips_reversed,
  round(avg(dc), 6) AS dp_alone_mean, round(quantile_cont(dc, 0.95), 6) AS dp_alone_p95, round(avg(CAST(pa <> pc AS INTEGER)), 6) AS flips_alone FROM x GROUP BY lang""")
def independence(spark, base):
    scored = ordered_answers(spark, base)
    aligned = R.realign(scored, ["doc_id", "lang", "golds"], "p")
    out = K.independence(aligned.withColumnRenamed("lang", "task"), ["task"])
    return out.select("task", "n", *[R6(c) for c in out.columns if c not in ("task", "n")])


# Lost, failed and re-keyed replies of a replay happen at random: they are modelled by hash so that the report has all kinds to count.
RUNS_CTE = f"""A AS (SELECT row_id, CASE WHEN {V.BELOW(V.U('fail_a', 'row_id'), 0.04)} THEN 500 ELSE 200 END AS status, p, pred, row_id % 7 AS usage, false AS rekeyed FROM sa WHERE NOT {V.BELOW(V.U('lost_a', 'row_id'), 0.03)}),
B AS (SELECT row_id, CASE WHEN {V.BELOW(V.U('fail_b', 'row_id'), 0.04)} THEN 500 ELSE 200 END AS status, p, pred, CASE WHEN {V.BELOW(V.U('usage_b', 'row_id'), 0.1)} THEN 99 ELSE row_id % 7 END AS usage,
  {V.BELOW(V.U('rekey_b', 'row_id'), 0.05)} AS rekeyed FROM sb WHERE NOT {V.BELOW(V.U('lost_b', 'row_id'), 0.03)}),
j AS (SELECT coalesce(a.row_id, b.row_id) AS id, a.row_id IS NOT NULL AS ia, b.row_id IS NOT NULL AS ib, a.status AS s1, b.status AS s2, a.p AS p1, b.p AS p2, a.pred AS d1, b.pred AS d2, a.usage AS u1, b.usage AS u2, b.rekeyed FROM A a FULL JOIN B b ON a.row_id = b.row_id),
k AS (SELECT *, ia AND ib AND s1 = 200 AND s2 = 200 AS ok2 FROM j),
m AS (SELECT *, CASE WHEN ok2 AND NOT rekeyed THEN list_max(list_transform(list_zip(p1, p2), lambda t: abs(t[1] - t[2]))) END AS diff FROM k)"""


@query("run_compare", f"""WITH {V.EMB_CTE}, {RUNS_CTE}
SELECT count(*) FILTER (WHERE ia) AS requests_a, count(*) FILTER (WHERE ib) AS requests_b, count(*) FILTER (WHERE NOT (ia AND ib)) AS missing_ids, count(*) FILTER (WHERE ok2) AS compared_requests, count(*) FILTER (WHERE s1 <> s2) AS status_mismatches,
  count(*) FILTER (WHERE ok2 AND rekeyed) AS answer_key_mismatches, CAST(0 AS BIGINT) AS nonfinite_or_missing_probs, count(*) FILTER (WHERE ok2 AND NOT rekeyed AND d1 <> d2) AS argmax_mismatches, count(*) FILTER (WHERE diff > 0.001) AS prob_diffs_over_tol,
  round(max(diff), 6) AS max_abs_prob_diff, arg_max(id, diff) AS max_at, count(*) FILTER (WHERE ok2 AND u1 <> u2) AS usage_mismatches, false AS ok FROM m""")
def run_compare(spark, base):
    rid = F.col("row_id")
    names = F.transform(F.sequence(F.lit(0), F.size("probs") - 1), lambda i: F.concat(F.lit("L"), i.cast("string")))

    def side(run):
        status = F.when(chance(u8(f"fail_{run}", "row_id"), 0.04), 500).otherwise(200)
        p = V.emb_pred(spark, base, run).filter(~chance(u8(f"lost_{run}", "row_id"), 0.03))
        return p.withColumn("status", status).withColumn("names", names).withColumn("usage", (rid % 7).cast("int"))

    b = side("b").withColumn("usage", F.when(chance(u8("usage_b", "row_id"), 0.1), 99).otherwise(F.col("usage")))
    b = b.withColumn("names", F.when(chance(u8("rekey_b", "row_id"), 0.05), F.transform("names", lambda n: F.concat(F.lit("X"), n))).otherwise(F.col("names")))
    r = K.compare_runs(side("a"), b, "row_id")
    return r.withColumn("max_abs_prob_diff", F.round("max_abs_prob_diff", 6))


GATE_CTE = f"""cand AS (SELECT task, gold, 'a' AS run, p FROM pa UNION ALL SELECT task, gold, 'b', p FROM pb UNION ALL SELECT task, gold, 'sharp', {V.SOFTMAX('za', '0.45')} FROM pred
   UNION ALL SELECT pa.task, pa.gold, 'mix', list_transform(list_zip(pa.p, pb.p), lambda t: (t[1] + t[2]) / 2) FROM pa JOIN pb ON pa.row_id = pb.row_id),
ct AS (SELECT run, task, avg(CAST(list_position(p, list_max(p)) - 1 = gold AS INTEGER)) AS acc, avg(-ln(greatest(p[gold + 1], 1e-12))) AS nll FROM cand GROUP BY run, task),
cr AS (SELECT run, sum(acc * CASE task WHEN 'task_0' THEN 0.5 WHEN 'task_1' THEN 0.25 WHEN 'task_2' THEN 0.125 WHEN 'task_3' THEN 0.125 ELSE 0 END) AS win, avg(acc) AS acc, avg(nll) AS nll FROM ct GROUP BY run),
cg AS (SELECT c.run, c.win, c.acc, c.nll, c.nll <= s.nll + 0.005 AND c.acc >= s.acc - 0.02 AND c.win >= s.win - 0.02 AS eligible FROM cr c, cr s WHERE s.run = 'a' AND c.run <> 'a')"""


@query("gate_select", f"""WITH {V.EMB_CTE}, {GATE_CTE} SELECT run, round(win, 6) AS win, round(acc, 6) AS acc, round(nll, 6) AS nll, eligible,
  coalesce(run = (SELECT arg_max(run, {{'w': win, 'n': run}}) FROM cg WHERE eligible), false) AS selected FROM cg""")
def gate_select(spark, base):
    """Candidates against run a: every gate must hold, the best weighted win among them is selected."""
    both = V.emb_two_runs(spark, base).select("task", "gold", F.col("probs_a").alias("pa"), F.col("logits_a").alias("za"), F.col("probs_b").alias("pb"))
    runs = F.array(
        F.struct(F.lit("a").alias("run"), F.col("pa").alias("probs")),
        F.struct(F.lit("b").alias("run"), F.col("pb").alias("probs")),
        F.struct(F.lit("sharp").alias("run"), D.softmax(F.col("za"), 0.45).alias("probs")),
        F.struct(F.lit("mix").alias("run"), F.zip_with("pa", "pb", lambda x, y: (x + y) / 2).alias("probs")),
    )
    rows = M.per_row(both.select("task", "gold", F.inline(runs)))
    per_task = materialise(rows.groupBy("run", "task").agg(F.avg("correct").alias("acc"), F.avg("nll").alias("nll")))
    w = F.when(F.col("task") == "task_0", 0.5).when(F.col("task") == "task_1", 0.25).when(F.col("task").isin("task_2", "task_3"), 0.125).otherwise(0.0)
    per_run = per_task.groupBy("run").agg(F.sum(w * F.col("acc")).alias("win"), F.avg("acc").alias("acc"), F.avg("nll").alias("nll"))
    start = per_run.filter(F.col("run") == "a").select(F.struct("win", "acc", "nll").alias("s")).scalar()
    g = per_run.filter(F.col("run") != "a").withColumn("s", start)
    g = g.withColumn("eligible", (F.col("nll") <= F.col("s.nll") + 0.005) & (F.col("acc") >= F.col("s.acc") - 0.02) & (F.col("win") >= F.col("s.win") - 0.02))
    best = g.filter("eligible").agg(F.max(F.struct("win", "run")).alias("m")).select("m.run").scalar()
    return g.select("run", R6("win"), R6("acc"), R6("nll"), "eligible", F.coalesce(F.col("run") == best, F.lit(False)).alias("selected"))


@query("task_wins", f"""WITH {V.EMB_CTE}, {TASK_METRICS}, d AS (SELECT task, max(CASE WHEN run = 'b' THEN acc END) - max(CASE WHEN run = 'a' THEN acc END) AS delta FROM tm GROUP BY task)
SELECT task, round(delta, 6) AS delta, (SELECT count(*) FILTER (WHERE delta > 0) FROM d) AS wins, (SELECT count(*) FROM d) AS tasks FROM d ORDER BY abs(round(delta, 6)) DESC, task LIMIT 3""")
def task_wins(spark, base):
    p = K.run_pivot(task_metrics(spark, base), "task", "run", ["a", "b"], ["acc", "nll"])
    d = p.select("task", (F.col("b_acc") - F.col("a_acc")).alias("delta"))
    total = d.agg(F.struct(F.count_if(F.col("delta") > 0).alias("wins"), F.count(F.lit(1)).alias("tasks")).alias("t")).scalar()
    top = d.orderBy(F.abs(F.round("delta", 6)).desc(), "task").limit(3).withColumn("t", total)
    return top.select("task", R6("delta"), "t.wins", "t.tasks")


HOUR = "date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', date_trunc('hour', ts))"


@query("curve_compare", f"""WITH c AS (SELECT event_type, {HOUR} AS step, avg(value) AS loss, count(*) AS n FROM events GROUP BY 1, 2),
j AS (SELECT b.event_type AS curve, a.step, a.loss AS la, b.loss AS lb, a.n AS na, b.n AS nb FROM c a JOIN c b ON a.step = b.step AND a.event_type = 'click' AND b.event_type <> 'click')
SELECT curve, count(*) AS windows, round(avg(CAST(lb < la AS INTEGER)), 6) AS share_lower, round(avg(CASE WHEN step BETWEEN 100 AND 299 THEN la END), 6) AS mean_base, round(avg(CASE WHEN step BETWEEN 100 AND 299 THEN lb END), 6) AS mean,
  round(avg(na), 6) AS throughput_base, round(avg(nb), 6) AS throughput FROM j GROUP BY curve""")
def curve_compare(spark, base):
    """The logs of all event types as loss curves by hour, each against the clicks."""
    step = F.expr("CAST(floor(timestampdiff(SECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts) / 3600) AS BIGINT)")
    e = table(spark, base, "events").select("event_type", step.alias("step"), "value")
    c = K.compare_curves(e, "event_type", "step", "value", "click", F.col("step").between(100, 299))
    return c.select(F.col("event_type").alias("curve"), "windows", *[R6(x) for x in ("share_lower", "mean_base", "mean", "throughput_base", "throughput")])


@query("relative_gain", """WITH x AS (SELECT event_type AS game, CAST(day(ts) AS INTEGER) AS d, value FROM events), base AS (SELECT game, avg(value) AS b FROM x WHERE d <= 15 GROUP BY game),
r AS (SELECT d AS iteration, game, avg(value) AS res FROM x WHERE d > 15 GROUP BY 1, 2), s AS (SELECT iteration, sum((res - b) / (abs(b) + 1)) AS gain FROM r JOIN base ON r.game = base.game GROUP BY iteration)
SELECT iteration, round(gain, 6) AS gain, iteration = (SELECT arg_max(iteration, gain) FROM s) AS best FROM s""")
def relative_gain(spark, base):
    x = table(spark, base, "events").select(F.col("event_type").alias("game"), F.dayofmonth("ts").alias("d"), "value")
    start = x.filter("d <= 15").groupBy("game").agg(F.avg("value").alias("b"))
    res = x.filter("d > 15").groupBy(F.col("d").alias("iteration"), "game").agg(F.avg("value").alias("res"))
    s = res.join(start, "game").groupBy("iteration").agg(F.sum((F.col("res") - F.col("b")) / (F.abs("b") + 1)).alias("gain"))
    best = s.agg(F.max_by("iteration", "gain").alias("m")).scalar()
    return s.select("iteration", R6("gain"), (F.col("iteration") == best).alias("best"))


REPLAY = "rp AS (SELECT ts, value AS ms, CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 422 ELSE 200 END AS status, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'unsupported' ELSE 'ok' END AS kind, event_type FROM events)"


def replay(spark, base):
    t = F.col("event_type")
    return table(spark, base, "events").select(
        "ts", F.col("value").alias("ms"), F.when(t == "error", 500).when(t == "signup", 422).otherwise(200).alias("status"),
        F.when(t == "error", "error").when(t == "signup", "unsupported").otherwise("ok").alias("kind"), "event_type")


@query("latency_summary", f"""WITH {REPLAY}, o AS (SELECT * FROM rp WHERE status = 200)
SELECT (SELECT count(*) FROM o) AS ok, (SELECT count(*) FROM rp WHERE kind = 'unsupported') AS unsupported, (SELECT count(*) FROM rp WHERE kind = 'error') AS errors,
  round((SELECT count(*) FROM o) / (SELECT date_diff('second', min(ts), max(ts)) FROM rp), 6) AS throughput_rps, round(avg(ms), 6) AS mean_ms, max(ms) AS max_ms,
  quantile_cont(ms, 0.5) AS median_ms, quantile_disc(ms, 0.95) AS p95_ms, quantile_disc(ms, 0.99) AS p99_ms FROM o""")
def latency_summary(spark, base):
    r = K.latency_summary(replay(spark, base), "ms", "status", "kind", "ts")
    return r.withColumn("throughput_rps", F.round("throughput_rps", 6)).withColumn("mean_ms", F.round("mean_ms", 6))


@query("weighted_latency", f"""WITH {REPLAY}, x AS (SELECT ms, CASE event_type WHEN 'purchase' THEN 4 WHEN 'view' THEN 3 ELSE 2 END AS w FROM rp WHERE status = 200),
d AS (SELECT ms, sum(w) AS w FROM x GROUP BY ms), c AS (SELECT ms, sum(w) OVER (ORDER BY ms) AS cw, sum(w) OVER () AS tw FROM d)
SELECT min(CASE WHEN cw >= 0.5 * tw THEN ms END) AS median_ms, min(CASE WHEN cw >= 0.95 * tw THEN ms END) AS p95_ms FROM c""")
def weighted_latency(spark, base):
    t = F.col("event_type")
    w = F.when(t == "purchase", 4).when(t == "view", 3).otherwise(2)
    return K.weighted_quantiles(replay(spark, base).filter("status = 200"), [], "ms", w, {"median_ms": 0.5, "p95_ms": 0.95})


@query("bucket_histogram", """SELECT CAST(ceil(n_chars / CASE WHEN n_chars <= 2048 THEN 64 WHEN n_chars <= 8192 THEN 512 ELSE 2048 END) * CASE WHEN n_chars <= 2048 THEN 64 WHEN n_chars <= 8192 THEN 512 ELSE 2048 END AS BIGINT) AS length_bucket,
  source AS grp, count(*) AS n FROM documents GROUP BY 1, 2""")
def bucket_histogram(spark, base):
    from adjudica.operators.sampling import length_bucket

    return table(spark, base, "documents").groupBy(length_bucket(F.col("n_chars")).alias("length_bucket"), F.col("source").alias("grp")).agg(F.count(F.lit(1)).alias("n"))
