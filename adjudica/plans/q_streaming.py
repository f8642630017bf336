"""Streaming queries: drained with availableNow into a sink, then read as a batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from adjudica.functions import dist as D
from adjudica.functions.hashing import chance, pick_index, u8, u_int
from adjudica.operators import answers as A
from adjudica.operators import metrics as M
from adjudica.operators import requests as R
from adjudica.operators import scoring as S
from adjudica.plans import views as V
from adjudica.plans.q_answers import BY_TYPE, T_SQL
from adjudica.plans.q_requests import PLAN_SQL, planned
from adjudica.plans.registry import query
from adjudica.streaming import pipelines as P


def events(spark, base):
    return P.read_stream(spark, f"{base.rstrip('/')}/events.parquet")


def text(c, name):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(name)


def TEXT(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


@query("stream_plan", PLAN_SQL)
def stream_plan(spark, base):
    return P.run_once(planned(events(spark, base)))


LEN = "length(event_type) * CAST(json_extract_string(props, '$.k') AS INTEGER)"


@query("stream_limits", f"""WITH x AS (SELECT 1 + CAST(json_extract_string(props, '$.k') AS INTEGER) % 7 AS n, CAST({LEN} AS BIGINT) AS longest FROM events),
y AS (SELECT CASE WHEN n > 6 THEN 'too many questions: ' || n || ' rows, the limit is 6' WHEN longest > 500 THEN 'too many tokens: one row has ' || longest || ', the limit is 500' WHEN n * longest > 1500 THEN 'too many tokens: ' || n * longest || ' in all, the limit is 1500' END AS reason FROM x)
SELECT CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS verdict, reason, count(*) AS n FROM y GROUP BY 1, 2""")
def stream_limits(spark, base):
    k = F.get_json_object("props", "$.k").cast("int")
    n, longest = 1 + k % 7, (F.length("event_type") * k).cast("bigint")
    s = events(spark, base).select("event_id", R.limit_reason(n, longest, n * longest, 6, 500, 1500).alias("reason"))
    sink = P.run_batches(s, P.split_sink())
    read = lambda v: spark.read.schema("event_id long, reason string").parquet(f"{sink}/{v}").select(F.lit(v).alias("verdict"), "reason")
    return read("accepted").unionByName(read("rejected")).groupBy("verdict", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("stream_score", f"""WITH {V.EMB_CTE}, x AS (SELECT row_id, type, za, zb, {T_SQL.format(k='type')} AS t FROM pred),
y AS (SELECT *, list_transform(zb, lambda z: 1 / (1 + exp(-z / t))) AS fit FROM x),
p AS (SELECT *, list_sum(fit) AS mass, CASE type WHEN 'choice' THEN {V.SOFTMAX('za', 't')} ELSE list_transform(fit, lambda f: f / list_sum(fit)) END AS p FROM y)
SELECT row_id, type, CASE WHEN type = 'choice' THEN 'L' || (list_position(p, list_max(p)) - 1) END AS choice, CASE WHEN type = 'score' THEN round(list_sum(list_transform(p, lambda v, i: v * (i - 1))), 2) END AS score,
  round(list_max(p), 4) AS x_p_max, CASE WHEN type = 'score' THEN round(mass, 4) END AS fit_mass, CASE WHEN type = 'score' THEN round(fit[1], 4) END AS fit_0 FROM p""")
def stream_score(spark, base):
    """Rows stream through scoring, temperatures, isolated levels and answer formatting; one narrow pass, no state.

    The model is fitted and stored before the stream starts; a micro-batch reads its few rows, never the training vectors."""
    model = V.emb_model(spark, base)
    rows = P.read_stream(spark, f"{base.rstrip('/')}/embeddings.parquet").withColumn("fold", V.fold())
    a = S.score(rows, V.emb_scorer(model)).withColumnRenamed("logits", "z").drop("labels")
    b = S.score(a, V.emb_scorer(model, "b"))
    kind = F.when(F.col("vec_id") % 2 == 0, "choice").otherwise("score")
    d = b.select(F.col("vec_id").alias("row_id"), kind.alias("kind"), "z", F.col("logits").alias("levels"), F.transform("labels", lambda l: F.concat(F.lit("L"), l.cast("string"))).alias("names"))
    d = d.withColumn("t", A.resolve_temperature(F.col("kind"), F.lit("state_first"), F.size("z"), {"temperature_by_type": BY_TYPE}))
    d = d.withColumn("fit", F.when(F.col("kind") == "score", F.transform("levels", lambda x: 1 / (1 + F.exp(-x / F.col("t"))))))
    probs = F.when(F.col("kind") == "score", A.combine_levels(F.col("fit"))).otherwise(D.softmax(F.col("z"), F.col("t")))
    out = d.select("row_id", A.format_answer(F.col("kind"), F.col("names"), probs, F.col("names"), F.col("fit")).alias("a"))
    return P.run_once(out.select("row_id", "a.type", "a.choice", "a.score", "a.x_p_max", "a.fit_mass", F.col("a.level_fit")["0"].alias("fit_0")))


STATUS = "CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'unsupported' ELSE 'ok' END"


def status():
    t = F.col("event_type")
    return F.when(t == "error", "error").when(t == "signup", "unsupported").otherwise("ok")


@query("stream_stats", f"""WITH x AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS s, {STATUS} AS st FROM events), m AS (SELECT max(ts) AS mx FROM events)
SELECT {TEXT('s')} AS start, count(*) AS n, count(*) FILTER (WHERE st = 'ok') AS ok, count(*) FILTER (WHERE st = 'error') AS errors FROM x, m WHERE s + INTERVAL '1 hour' <= mx - INTERVAL '1 hour' GROUP BY s""")
def stream_stats(spark, base):
    s = P.window_stats(P.with_event_time(events(spark, base)), "ts", "1 hour", status())
    return P.run_once(s).select(text("start", "start"), "n", "ok", "errors")


@query("stream_latency", f"""WITH w AS (SELECT time_bucket(INTERVAL '2 hours', ts) - to_hours(o * 2) AS s, value FROM events, range(3) t(o)), m AS (SELECT max(ts) AS mx FROM events)
SELECT {TEXT('s')} AS start, count(*) AS n, quantile_disc(value, 0.5) AS median_ms, quantile_disc(value, 0.95) AS p95_ms FROM w, m WHERE s + INTERVAL '6 hours' <= mx - INTERVAL '1 hour' GROUP BY s""")
def stream_latency(spark, base):
    s = P.window_latency(P.with_event_time(events(spark, base)), "ts", "6 hours", "2 hours", "value")
    return P.run_once(s).select(text("start", "start"), "n", "median_ms", "p95_ms")


@query("stream_sessions", f"""WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '2 hours' THEN 0 ELSE 1 END AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT user_id, ts, sum(brk) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM x), m AS (SELECT max(ts) AS mx FROM events)
SELECT user_id, {TEXT('min(ts)')} AS start, {TEXT("max(ts) + INTERVAL '2 hours'")} AS "end", count(*) AS n FROM g, m GROUP BY user_id, sid HAVING max(ts) + INTERVAL '2 hours' <= max(mx) - INTERVAL '1 hour'""")
def stream_sessions(spark, base):
    s = P.bursts(P.with_event_time(events(spark, base)), "ts", "2 hours", "user_id")
    return P.run_once(s).select("user_id", text("start", "start"), text("end", "end"), "n")


@query("stream_repeat_schemas", """WITH x AS (SELECT event_type || ':' || json_extract_string(props, '$.k') AS schema FROM events) SELECT schema, CAST(2 AS BIGINT) AS seen FROM x GROUP BY schema HAVING count(*) >= 2""")
def stream_repeat_schemas(spark, base):
    e = events(spark, base).select("ts", F.concat_ws(":", "event_type", F.get_json_object("props", "$.k")).alias("schema"))
    return P.run_once(P.second_sights(e, "schema"))


@query("stream_dedup", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_dedup(spark, base):
    """One request in ten is sent twice (by hash)."""
    copies = F.when(chance(u8("retry", "event_id"), 0.1), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    s = P.with_event_time(events(spark, base).withColumn("attempt", F.explode(copies)))
    return P.run_once(P.dedup(s, ["event_id"]).select("event_id", "event_type")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


CONF = f"(CAST('0x' || {V.U('drift_conf', 'event_id')} AS BIGINT) / 4294967296.0)"
LATE = V.BELOW(V.U("gold_late", "event_id"), 0.2)
RIGHT = f"({V.IDX(V.U('drift_right', 'event_id'), 100)} < 60)"


@query("stream_drift", f"""WITH x AS (SELECT date_trunc('day', ts) AS d, {CONF} AS conf, CAST({RIGHT} AS INTEGER) AS correct FROM events WHERE NOT {LATE}),
b AS (SELECT d, ceil(conf * 15) AS bin, count(*) AS n, sum(conf) AS sc, sum(correct) AS sy FROM x GROUP BY 1, 2) SELECT {TEXT('d')} AS day, CAST(sum(n) AS BIGINT) AS n, round(sum(abs(sc - sy)) / sum(n), 6) AS ece FROM b GROUP BY d""")
def stream_drift(spark, base):
    """Answers joined with golds that arrive minutes later (a fifth arrives too late to count), ECE per day."""
    conf = u_int(u8("drift_conf", "event_id")) / F.lit(4294967296.0)
    a = events(spark, base).select("event_id", F.col("ts").cast("timestamp").alias("ts"), conf.alias("conf")).withWatermark("ts", "1 hour")
    delay = F.when(chance(u8("gold_late", "event_id"), 0.2), F.expr("INTERVAL 30 MINUTES")).otherwise(F.expr("INTERVAL 5 MINUTES"))
    g = events(spark, base).select(
        F.col("event_id").alias("gold_event_id"), (F.col("ts").cast("timestamp") + delay).alias("gold_ts"), (pick_index(u8("drift_right", "event_id"), 100) < 60).cast("int").alias("correct")).withWatermark("gold_ts", "1 hour")
    j = P.join_late_gold(a, g, "event_id", "ts", "gold_ts", "10 MINUTES").select("event_id", "ts", "conf", "correct")
    rows = P.run_once(j).filter(F.col("correct").isNotNull()).withColumn("day", F.date_trunc("day", "ts"))
    b = M.ece_bin(F.col("conf"))
    e = M.ece(rows, ["day"], F.when(b > 0, b))
    n = rows.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    return e.join(n, "day").select(text("day", "day"), "n", F.round("ece", 6).alias("ece"))
