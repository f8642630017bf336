"""Answer assembly queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from adjudica.functions import dist as D
from adjudica.functions.hashing import pick_index, u8, u_int
from adjudica.operators import answers as A
from adjudica.operators import requests as R
from adjudica.plans import views as V
from adjudica.plans.q_requests import LEVELS, REQ, requests_of
from adjudica.plans.registry import query
from adjudica.sources.tables import spread, table

R6 = lambda c, name=None: F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name or c)


def micro(arr, name):
    """A list of probabilities as text in millionths (compares exactly between engines)."""
    return F.array_join(F.transform(arr, lambda x: F.round(x * 1e6).cast("bigint").cast("string")), ",").alias(name)


def MICRO(lst: str) -> str:
    return f"array_to_string(list_transform({lst}, lambda mv: CAST(CAST(round(mv * 1e6) AS BIGINT) AS VARCHAR)), ',')"


NAMES = "list_transform(range(10), lambda k: 'L' || k)"


def names_col(n=10):
    return F.array(*[F.lit(f"L{k}") for k in range(n)])


BY_TYPE = {"choice": 1.2, "noul": 1.6, "score": 0.9}
T_SQL = "CAST(CASE {k} WHEN 'choice' THEN 1.2 WHEN 'noul' THEN 1.6 ELSE 0.9 END AS DOUBLE)"


@query("softmax_t", f"""WITH {V.EMB_CTE}, x AS (SELECT row_id, za, {T_SQL.format(k='type')} AS t FROM pred)
SELECT row_id, CAST(t AS DOUBLE) AS t, {MICRO(V.SOFTMAX('za', 't'))} AS p FROM x""")
def softmax_t(spark, base):
    p = V.emb_pred(spark, base)
    t = A.resolve_temperature(F.col("type"), F.lit("state_first"), F.size("logits"), {"temperature_by_type": BY_TYPE})
    return p.withColumn("t", t).select("row_id", "t", micro(D.softmax(F.col("logits"), F.col("t")), "p"))


EV_KIND = "CASE event_type WHEN 'click' THEN 'choice' WHEN 'view' THEN 'noul' WHEN 'purchase' THEN 'score' WHEN 'signup' THEN 'choice' ELSE 'noul' END"
EV_CTE = f"""ev AS (SELECT event_id, {EV_KIND} AS kind, CASE WHEN {V.BELOW(V.U('layout', 'event_id'), 0.5)} THEN 'schema_first' ELSE 'state_first' END AS layout,
  2 + CAST(json_extract_string(props, '$.k') AS INTEGER) % 20 AS n_options FROM events)"""


def ev_answers(spark, base):
    e = table(spark, base, "events")
    t = F.col("event_type")
    kind = F.when(t == "click", "choice").when(t == "view", "noul").when(t == "purchase", "score").when(t == "signup", "choice").otherwise("noul")
    k = F.get_json_object("props", "$.k").cast("int")
    lay = F.when(u8("layout", "event_id") < "80000000", "schema_first").otherwise("state_first")
    return e.select("event_id", kind.alias("kind"), lay.alias("layout"), (2 + k % 20).alias("n_options"))


@query("resolve_temperature", f"""WITH {EV_CTE}
SELECT kind, layout, CAST(CASE WHEN layout = 'schema_first' THEN CASE kind WHEN 'score' THEN 0.8 ELSE 0.95 END ELSE CASE kind WHEN 'choice' THEN 1.2 WHEN 'noul' THEN 1.6 ELSE 1.1 END END AS DOUBLE) AS t_map,
  CASE WHEN layout = 'schema_first' THEN 1.1 ELSE round(greatest(0.05, 6.0 - 1.75 * ln(greatest(n_options, 2))), 6) END AS t_options, CAST(0.9 AS DOUBLE) AS t_override, count(*) AS n FROM ev GROUP BY ALL""")
def resolve_temperature(spark, base):
    e = ev_answers(spark, base)
    k, lay, n = F.col("kind"), F.col("layout"), F.col("n_options")
    by_map = {"temperature": 1.1, "temperature_by_type": {"choice": 1.2, "noul": 1.6}, "temperature_schema_first": 0.95, "temperature_schema_first_by_type": {"score": 0.8}}
    by_opt = {"temperature": 1.1, "temperature_by_options": {"a": 6.0, "b": -1.75}}
    return (
        e.withColumn("t_map", A.resolve_temperature(k, lay, n, by_map))
        .withColumn("t_options", F.round(A.resolve_temperature(k, lay, n, by_opt), 6))
        .withColumn("t_override", A.resolve_temperature(k, lay, n, {"temperature_by_type": {"choice": 1.2}}, override=0.9))
        .groupBy("kind", "layout", "t_map", "t_options", "t_override").agg(F.count(F.lit(1)).alias("n"))
    )


@query("t_of_options", f"WITH {EV_CTE} SELECT n_options, round(greatest(0.05, 4.0 - 1.75 * ln(greatest(n_options, 2))), 6) AS t, count(*) AS n FROM ev GROUP BY ALL")
def t_of_options(spark, base):
    e = ev_answers(spark, base)
    return e.groupBy("n_options", R6(D.t_of_options(F.col("n_options"), 4.0, -1.75), "t")).agg(F.count(F.lit(1)).alias("n"))


LEVELS_CTE = f"""lv AS (SELECT o_orderkey, CAST(level AS INTEGER) AS level, (CAST('0x' || {V.U('fit', 'o_orderkey', 'level')} AS BIGINT) / 4294967296.0) * 0.5
    + CASE WHEN CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 = level THEN 0.5 ELSE 0.0 END AS p_yes FROM orders, range(5) r(level))"""


def order_levels(spark, base):
    """One row per order and level: P(the level fits)."""
    o = table(spark, base, "orders").select("o_orderkey", (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("gold"))
    d = o.withColumn("level", F.explode(F.array(*[F.lit(i) for i in range(5)])))
    p = u_int(u8("fit", "o_orderkey", "level")) / F.lit(4294967296.0) * 0.5 + F.when(F.col("gold") == F.col("level"), 0.5).otherwise(0.0)
    return d.withColumn("p_yes", p)


@query("combine_isolated", f"""WITH {LEVELS_CTE}, c AS (SELECT o_orderkey, array_agg(p_yes ORDER BY level) AS f, sum(p_yes) AS mass FROM lv GROUP BY o_orderkey)
SELECT o_orderkey, round(mass, 6) AS fit_mass, round(list_sum(list_transform(f, lambda v, i: v * (i - 1))) / mass, 6) AS score, {MICRO('list_transform(f, lambda v: v / mass)')} AS p FROM c""")
def combine_isolated(spark, base):
    c = A.combine_isolated(order_levels(spark, base), ["o_orderkey"])
    return c.select("o_orderkey", R6("fit_mass"), R6(D.expected_level(F.col("probs")), "score"), micro(F.col("probs"), "p"))


@query("choice_confidence", f"WITH {V.EMB_CTE} SELECT row_id, round((10 * conf - 1) / 9, 6) AS confidence FROM sa")
def choice_confidence(spark, base):
    return V.emb_pred(spark, base).select("row_id", R6(D.choice_confidence(F.col("probs")), "confidence"))


SCORE_CONF = "greatest(0.0, least(1.0, 1 - list_sum(list_transform(p, lambda v, i: v * abs(i - 1 - pred))) / 2.5))"


@query("score_confidence", f"WITH {V.EMB_CTE} SELECT row_id, round({SCORE_CONF}, 6) AS confidence FROM sa")
def score_confidence(spark, base):
    return V.emb_pred(spark, base).select("row_id", R6(D.score_confidence(F.col("probs")), "confidence"))


CERT = "greatest(0.0, 1 + list_sum(list_transform(p, lambda v: CASE WHEN v > 0 THEN v * ln(v) ELSE 0 END)) / ln(len(p)))"


@query("certainty", f"WITH {V.EMB_CTE} SELECT row_id, round({CERT}, 6) AS certainty FROM sa")
def certainty(spark, base):
    return V.emb_pred(spark, base).select("row_id", R6(D.certainty(F.col("probs")), "certainty"))


@query("format_answer", f"""WITH {V.EMB_CTE}, x AS (SELECT *, CASE WHEN row_id % 3 = 0 THEN 'noul' ELSE type END AS kind FROM sa),
y AS (SELECT row_id, kind, CASE WHEN kind = 'noul' THEN list_transform(p[1:2], lambda v: v / (p[1] + p[2])) ELSE p END AS p, pred, conf FROM x)
SELECT row_id, kind AS type, CASE WHEN kind = 'choice' THEN 'L' || pred END AS choice, CASE WHEN kind = 'noul' THEN round(p[2], 4) END AS noul,
  CASE WHEN kind = 'score' THEN round(list_sum(list_transform(p, lambda v, i: v * (i - 1))), 2) END AS score,
  CASE WHEN kind = 'choice' THEN round((10 * conf - 1) / 9, 4) WHEN kind = 'score' THEN round({SCORE_CONF}, 4) END AS confidence,
  CASE WHEN kind <> 'noul' THEN round(conf, 4) END AS x_p_max, CASE WHEN kind <> 'noul' THEN round({CERT}, 4) END AS certainty,
  CASE WHEN kind <> 'noul' THEN round(p[4], 4) END AS p_third FROM y""")
def format_answer(spark, base):
    p = V.emb_pred(spark, base).withColumn("kind", F.when(F.col("row_id") % 3 == 0, "noul").otherwise(F.col("type")))
    noul = F.col("kind") == "noul"
    names = F.when(noul, F.array(F.lit("false"), F.lit("true"))).otherwise(names_col())
    d = p.withColumn("names", names).withColumn("a", A.format_answer(F.col("kind"), F.col("names"), F.col("probs")))
    return d.select("row_id", "a.type", "a.choice", "a.noul", "a.score", "a.confidence", "a.x_p_max", "a.certainty", F.col("a.probabilities")["L3"].alias("p_third"))


ASM_CTE = f"""g AS (SELECT event_id, event_id // 4 AS req, 'q' || (event_id % 4) AS qid, type, type = 'score' AND isolated AS iso, CASE type WHEN 'choice' THEN ['buy', 'leave', 'other'] WHEN 'noul' THEN ['false', 'true'] ELSE ['0', '1', '2', '3'] END AS names FROM rq WHERE reason IS NULL),
v AS (SELECT *, list_transform(range(len(names)), lambda i: (({V.IDX(V.U('asm', 'event_id', 'i'), 1000)}) + 1 + 0.0123 * (i + 1)) / 1001.0) AS w FROM g),
s AS (SELECT *, list_sum(w) AS mass, list_transform(w, lambda x: x / list_sum(w)) AS p FROM v),
k AS (SELECT *, list_max(p) AS m, list_position(p, list_max(p)) - 1 AS j, len(p) AS n FROM s)"""


@query("assemble_answers", f"""WITH {REQ}, {ASM_CTE}
SELECT req, qid, type, CASE WHEN type = 'choice' THEN names[j + 1] END AS choice, CASE WHEN type = 'noul' THEN round(p[2], 4) END AS noul, CASE WHEN type = 'score' THEN round(list_sum(list_transform(p, lambda x, i: x * (i - 1))), 2) END AS score,
  CASE type WHEN 'choice' THEN round((n * m - 1) / (n - 1), 4) WHEN 'score' THEN round(greatest(0.0, 1 - list_sum(list_transform(p, lambda x, i: x * abs(i - 1 - j)))), 4) END AS confidence,
  CASE WHEN type = 'score' THEN array_to_string(list_transform({list(LEVELS)!r}, lambda l, i: (i - 1) || ':' || l), '|') END AS legend,
  CASE WHEN iso THEN array_to_string(list_transform(w, lambda x, i: (i - 1) || ':' || CAST(round(x * 10000) AS BIGINT)), '|') END AS level_fit, CASE WHEN iso THEN round(mass, 4) END AS fit_mass FROM k""")
def assemble_answers(spark, base):
    """Four events are one request; their scored rows, in any order, become one map of typed answers, shown here entry by entry."""
    good, _ = R.split_requests(requests_of(table(spark, base, "events")))
    rows = R.plan_rows(good).withColumn("req", F.floor(F.col("event_id") / 4)).withColumn("qid", F.concat(F.lit("q"), (F.col("event_id") % 4).cast("string")))
    draw = lambda i: (pick_index(u8("asm", "event_id", i), 1000) + 1 + 0.0123 * (i + 1)) / 1001.0
    fit = F.array(1 - draw(F.col("row_idx")), draw(F.col("row_idx")))
    probs = F.when(F.col("kind") == "iso", fit).otherwise(D.scale_to_one(F.transform("row.options", lambda _, i: draw(i))))
    scored = rows.select("req", "qid", "kind", "row_idx", F.col("rq.type").alias("type"), F.col("rq.names").alias("names"), F.col("rq.legend").alias("legend"), probs.alias("probs"))
    maps, _ = A.answer_maps(A.assemble(scored, ["req"], "qid"), ["req"], "qid", most=64)
    e = maps.select("req", F.explode("answers").alias("qid", "a"))
    text = lambda m, shown: F.when(m.isNotNull(), F.array_join(F.transform(F.map_entries(m), lambda x: F.concat(x["key"], F.lit(":"), shown(x["value"]))), "|"))
    return e.select("req", "qid", *[f"a.{c}" for c in ("type", "choice", "noul", "score", "confidence")], text(F.col("a.legend"), lambda v: v).alias("legend"),
                    text(F.col("a.level_fit"), lambda v: F.round(v * 10000).cast("bigint").cast("string")).alias("level_fit"), "a.fit_mass")


@query("expected_score", f"WITH {V.EMB_CTE} SELECT row_id, round(list_sum(list_transform(p, lambda v, i: v * (i * 2 - 5))), 6) AS score FROM sa")
def expected_score(spark, base):
    levels = F.array(*[F.lit(float(2 * i - 5)) for i in range(1, 11)])
    return V.emb_pred(spark, base).select("row_id", R6(D.expected_level(F.col("probs"), levels), "score"))


@query("abstain_below", f"WITH {V.EMB_CTE} SELECT row_id, CASE WHEN conf >= 0.22 THEN 'L' || pred END AS choice FROM sa")
def abstain_below(spark, base):
    return V.emb_pred(spark, base).select("row_id", A.abstain_below(names_col(), F.col("probs"), 0.22).alias("choice"))


@query("second_reading", f"""WITH {V.EMB_CTE}, f AS (SELECT row_id, zb, {V.SOFTMAX('za', '1.3')} AS p FROM pred),
g AS (SELECT row_id, p, list_transform(p, lambda v: 1.3 * ln(v)) AS l1, zb FROM f),
h AS (SELECT row_id, p, list_transform(list_zip(l1, zb), lambda t: (t[1] - ln(list_sum(list_transform(l1, lambda x: exp(x)))) + t[2] - ln(list_sum(list_transform(zb, lambda x: exp(x))))) / 2) AS m FROM g)
SELECT row_id, list_max(p) < 0.2 AS reread, CASE WHEN list_max(p) < 0.2 THEN {MICRO(V.SOFTMAX('m', 'greatest(0.05, 3.0 - 0.9 * ln(10))'))} ELSE {MICRO('p')} END AS p FROM h""")
def second_reading(spark, base):
    d = V.emb_two_runs(spark, base).select("row_id", D.softmax(F.col("logits_a"), 1.3).alias("p1"), F.reverse("logits_b").alias("rev"))
    out = A.second_reading(F.col("p1"), F.col("rev"), 1.3, 0.2, 3.0, -0.9)
    return d.select("row_id", (F.array_max("p1") < 0.2).alias("reread"), micro(out, "p"))


@query("join_slices", f"WITH {V.EMB_CTE} SELECT row_id, {MICRO('p')} AS p FROM sa")
def join_slices(spark, base):
    """Every row is cut into slices of four log-probabilities, joined back, then normalised."""
    p = V.emb_pred(spark, base).withColumn("lp", D.log_softmax(F.col("logits")))
    s = p.select("row_id", F.posexplode(F.transform(F.array(F.lit(1), F.lit(5), F.lit(9)), lambda i: F.slice("lp", i, 4))).alias("slice", "part"))
    return A.join_slices(s, ["row_id"], "slice", "part").select("row_id", micro(D.softmax(F.col("logits")), "p"))


@query("gated_routing", f"""WITH {V.EMB_CTE}
SELECT CASE WHEN conf < 0.15 THEN 'human' WHEN pred <= 2 THEN CASE WHEN conf > 0.25 THEN 'execute' ELSE 'confirm' END ELSE 'L' || pred END AS route, count(*) AS n FROM sa GROUP BY 1""")
def gated_routing(spark, base):
    policy = spark.createDataFrame([(f"L{k}", 0.25, "execute", "confirm") for k in range(3)], "choice string, needs double, action string, fallback string")
    p = V.emb_pred(spark, base).select("row_id", F.get(names_col(), D.argmax(F.col("probs"))).alias("choice"), F.array_max("probs").alias("p_max"))
    return A.gated_routing(p, F.broadcast(policy), "choice", "p_max", 0.15).groupBy("route").agg(F.count(F.lit(1)).alias("n"))


QS = ["urgency", "scope", "clarity"]
SC_CTE = f"""qs AS (SELECT * FROM (VALUES ('urgency', 0.5, 4), ('scope', 0.3, 3), ('clarity', 0.2, 6)) t(question, weight, levels)),
sc AS (SELECT o_orderkey, question, ({V.IDX(V.U('score', 'o_orderkey', 'question'), 201)}) / 100.0 AS score FROM orders, qs)"""


@query("composite_score", f"WITH {SC_CTE} SELECT o_orderkey, round(sum(weight * score / (levels - 1)), 6) AS priority FROM sc JOIN qs ON sc.question = qs.question GROUP BY o_orderkey")
def composite_score(spark, base):
    weights = spark.createDataFrame([("urgency", 0.5, 4), ("scope", 0.3, 3), ("clarity", 0.2, 6)], "question string, weight double, levels int")
    o = table(spark, base, "orders").select("o_orderkey", F.explode(F.array(*[F.lit(q) for q in QS])).alias("question"))
    s = o.withColumn("score", pick_index(u8("score", "o_orderkey", "question"), 201) / 100.0)
    return A.composite_score(s, F.broadcast(weights), ["o_orderkey"]).select("o_orderkey", R6("priority"))


def tree_edges(spark, base):
    """region -> nation -> market segment of the nation's customers."""
    r, n, c = (table(spark, base, t) for t in ("region", "nation", "customer"))
    top = r.select(F.lit("root").alias("parent"), F.col("r_name").alias("child"))
    mid = r.join(n, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("parent"), F.col("n_name").alias("child"))
    leaf = c.select("c_nationkey", "c_mktsegment").distinct().join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("parent"), F.concat("n_name", F.lit(":"), "c_mktsegment").alias("child"))
    return top.unionByName(mid).unionByName(leaf)


def _beam_level(prev: str, keep: int, first: bool = False) -> str:
    sep = "''" if first else "'/'"
    w = f"({V.IDX(V.U('beam', 's.c_custkey', 'e.child'), 1000)} + 1)"
    return f"""(SELECT c_custkey, child AS node, path || {sep} || child AS path, prob FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY prob DESC, child) AS r FROM
   (SELECT s.c_custkey, s.path, e.child, s.prob * {w} / sum({w}) OVER (PARTITION BY s.c_custkey, s.node) AS prob FROM {prev} s JOIN edges e ON e.parent = s.node)) WHERE r <= {keep})"""


@query("beam_classify", f"""WITH edges AS (SELECT 'root' AS parent, r_name AS child FROM region UNION ALL SELECT r_name, n_name FROM region JOIN nation ON r_regionkey = n_regionkey
   UNION ALL SELECT DISTINCT n_name, n_name || ':' || c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey),
l0 AS (SELECT c_custkey, 'root' AS node, '' AS path, CAST(1.0 AS DOUBLE) AS prob FROM customer), l1 AS {_beam_level('l0', 3, True)}, l2 AS {_beam_level('l1', 3)}, l3 AS {_beam_level('l2', 1)}
SELECT c_custkey, path, round(prob, 6) AS prob FROM l3""")
def beam_classify(spark, base):
    w = lambda k, child: pick_index(u8("beam", k, child), 1000) + 1
    out = A.beam_classify(spread(table(spark, base, "customer").select("c_custkey")), tree_edges(spark, base), "c_custkey", w, beam=3, depth=3)
    return out.select("c_custkey", "path", R6("prob"))


@query("format_schema_answer", f"""WITH {V.EMB_CTE}, x AS (SELECT *, CASE row_id % 3 WHEN 0 THEN 'bool' WHEN 1 THEN 'choice' ELSE 'scale' END AS kind FROM sa)
SELECT row_id, CASE kind WHEN 'bool' THEN 'noul' ELSE kind END AS type, CASE WHEN kind = 'choice' THEN CASE WHEN pred = 9 THEN 'None of the above' ELSE 'L' || pred END END AS choice,
  CASE WHEN kind = 'bool' THEN round(p[2] / (p[1] + p[2]), 4) END AS noul, CASE WHEN kind = 'scale' THEN round(list_sum(list_transform(p, lambda v, i: v * i)), 2) END AS score,
  CASE WHEN kind <> 'bool' THEN round(conf, 4) END AS confidence FROM x""")
def format_schema_answer(spark, base):
    from adjudica.operators.requests import neutralize, restore

    k = F.col("row_id") % 3
    p = V.emb_pred(spark, base).withColumn("kind", F.when(k == 0, "bool").when(k == 1, "choice").otherwise("scale"))
    options = F.array(*[F.lit(f"L{i}") for i in range(9)], F.lit("None of the above"))
    levels = F.array(*[F.lit(float(i)) for i in range(1, 11)])
    probs = F.when(F.col("kind") == "bool", D.scale_to_one(F.slice("probs", 1, 2))).otherwise(F.col("probs"))
    d = p.withColumn("original", options).withColumn("shown", neutralize(F.col("original"))).withColumn("q", probs)
    a = A.format_schema_answer(F.col("kind"), F.col("shown"), levels, F.col("q"))
    d = d.withColumn("a", a)
    return d.select("row_id", "a.type", restore(F.col("a.choice"), F.col("shown"), F.col("original")).alias("choice"), "a.noul", "a.score", "a.confidence")
