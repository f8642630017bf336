"""Trajectory queries: a user's events are an episode, their values the rewards."""

from __future__ import annotations

from pyspark.sql import functions as F

from adjudica.operators import rollouts as R
from adjudica.plans.registry import query
from adjudica.sources.tables import materialise, table

GAMMA = 1 / 1.03


def seconds(col: str = "ts"):
    """Seconds since 1970 of a timestamp without time zone."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {col})")


def episodes(spark, base):
    e = table(spark, base, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return R.with_step(e, ["user_id"], F.floor(seconds() / 3600), [F.col("ts"), F.col("event_id")])


EP = "ep AS (SELECT event_id, user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t FROM events)"
RET = f"{EP}, rt AS (SELECT a.event_id, a.user_id, a.t, sum(b.value * power(CAST({GAMMA!r} AS DOUBLE), b.t - a.t)) AS g FROM ep a JOIN ep b ON a.user_id = b.user_id AND b.t >= a.t GROUP BY 1, 2, 3)"


@query("discounted_return", f"WITH {RET} SELECT event_id, user_id, t, round(g, 6) AS g FROM rt")
def discounted_return(spark, base):
    r = R.discounted_returns(episodes(spark, base), ["user_id"], "t", "value", GAMMA)
    return r.select("event_id", "user_id", "t", F.round("g", 6).alias("g"))


@query("advantages", f"""WITH {RET}, b AS (SELECT user_id % 3 AS game, t, avg(g) AS b FROM rt GROUP BY 1, 2), a AS (SELECT rt.event_id, rt.user_id % 3 AS game, rt.g - b.b AS a FROM rt JOIN b ON b.game = rt.user_id % 3 AND b.t = rt.t),
s AS (SELECT game, stddev_pop(a) AS sd FROM a GROUP BY game) SELECT event_id, a.game, round(a / (sd + 1e-6), 6) AS advantage FROM a JOIN s ON a.game = s.game""")
def advantages(spark, base):
    r = R.discounted_returns(episodes(spark, base), ["user_id"], "t", "value", GAMMA).withColumn("game", F.col("user_id") % 3)
    r = materialise(r.select("event_id", "game", "t", "g"))  # three uses follow
    return R.advantages(r, ["game"], "t", "g").select("event_id", "game", F.round("advantage", 6).alias("advantage"))


@query("loo_baseline", f"""WITH {EP}, u AS (SELECT user_id, sum(value) AS total, max(CASE WHEN t = 0 THEN event_type END) AS start FROM ep GROUP BY user_id), g AS (SELECT start, sum(total) AS s, count(*) AS n FROM u GROUP BY start)
SELECT user_id, u.start, round(CASE WHEN n > 1 THEN (s - total) / (n - 1) END, 6) AS baseline FROM u JOIN g ON u.start = g.start""")
def loo_baseline(spark, base):
    e = table(spark, base, "events")
    u = e.groupBy("user_id").agg(F.sum("value").alias("total"), F.min_by("event_type", F.struct("ts", "event_id")).alias("start"))
    return R.leave_one_out(u, ["start"], "total").select("user_id", "start", F.round("baseline", 6).alias("baseline"))
