"""Request queries: events are requests, their type picks the question."""

from __future__ import annotations

from pyspark.sql import functions as F

from adjudica.functions.hashing import chance, pick_index, u8
from adjudica.operators import convert as C
from adjudica.operators import requests as R
from adjudica.plans import views as V
from adjudica.plans.q_convert import labelled
from adjudica.plans.registry import query
from adjudica.sources.tables import spread, table

LEVELS = ("cosmetic", "degraded", "blocking", "data loss")


def requests_of(e):
    """Requests from a table or stream of events."""
    e = e.select("event_id", "props", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    t, k = F.col("event_type"), F.col("k")
    none = F.lit(None).cast("array<string>")
    odd = k % 2 == 1
    return e.select(
        "event_id", F.col("props").alias("state"),
        F.when(t == "click", "choice").when(t == "view", "noul").when(t.isin("purchase", "signup"), "score").when(odd, "noul").otherwise("rank").alias("type"),
        F.when((t == "view") & odd, "").when((t == "error") & odd, "").otherwise(F.concat(F.lit("Judge "), t)).alias("instructions"),
        F.when(t == "click", F.when(k % 10 == 0, C.strings("only")).otherwise(C.strings("buy", "leave", "other"))).otherwise(none).alias("names"),
        F.when(t == "click", F.when(k % 10 == 0, F.array(F.lit("x"))).otherwise(F.array(F.lit("wants to buy"), F.lit(""), F.lit(None).cast("string"))))
        .when((t == "view") & odd, F.array(F.lit("a passer-by"), F.lit("a reader"))).when(t.isin("purchase", "signup"), C.strings(*LEVELS)).otherwise(none).alias("descs"),
        (t != "signup").alias("isolated"),
    )


REQ = """rq0 AS (SELECT event_id, event_type AS t, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
rq AS (SELECT event_id, CASE WHEN t = 'click' THEN 'choice' WHEN t = 'view' THEN 'noul' WHEN t IN ('purchase', 'signup') THEN 'score' WHEN k % 2 = 1 THEN 'noul' ELSE 'rank' END AS type, t <> 'signup' AS isolated,
  CASE WHEN t = 'error' AND k % 2 = 0 THEN 'unknown question type' WHEN t = 'error' THEN 'noul question without instructions: describe true or false' WHEN t = 'click' AND k % 10 = 0 THEN 'choice criteria: 2 to 255 options' END AS reason,
  CASE WHEN t = 'view' AND k % 2 = 1 THEN 'Which answer fits the context?' ELSE 'Judge ' || t END AS question,
  CASE t WHEN 'click' THEN ['buy: wants to buy', 'leave', 'other'] WHEN 'view' THEN CASE WHEN k % 2 = 1 THEN ['no: a passer-by', 'yes: a reader'] ELSE ['no', 'yes'] END ELSE ['0: cosmetic', '1: degraded', '2: blocking', '3: data loss'] END AS options FROM rq0)"""


@query("render_question", f"WITH {REQ} SELECT event_id, CASE WHEN reason IS NULL THEN question END AS question, CASE WHEN reason IS NULL THEN array_to_string(options, '|') END AS options, reason FROM rq")
def render_question(spark, base):
    good, bad = R.split_requests(requests_of(spread(table(spark, base, "events"))))
    a = good.select("event_id", F.col("rq.question").alias("question"), F.array_join("rq.options", "|").alias("options"), F.lit(None).cast("string").alias("reason"))
    return a.unionByName(bad.select("event_id", F.lit(None).cast("string").alias("question"), F.lit(None).cast("string").alias("options"), "reason"))


PLAN_SQL = f"""WITH {REQ}, g AS (SELECT *, type = 'score' AND isolated AS iso FROM rq WHERE reason IS NULL),
r AS (SELECT event_id, 'iso' AS kind, type AS row_type, 4 AS n_rows, l.i AS row_idx, question || chr(10) || 'Proposed answer: ' || {list(LEVELS)!r}[l.i + 1] || chr(10) || 'Does the proposed answer fit?' AS text, 'no|yes' AS options FROM g, range(4) l(i) WHERE iso
  UNION ALL SELECT event_id, 'list', type, 1, 0, question, array_to_string(options, '|') FROM g WHERE NOT iso)
SELECT event_id, kind, row_type, CAST(n_rows AS INTEGER) AS n_rows, CAST(row_idx AS INTEGER) AS row_idx, text, options FROM r"""


def planned(events):
    good, _ = R.split_requests(requests_of(events))
    return R.plan_rows(good).select("event_id", "kind", "row_type", "n_rows", "row_idx", F.col("row.text").alias("text"), F.array_join("row.options", "|").alias("options"))


@query("plan_rows", PLAN_SQL)
def plan_rows(spark, base):
    return planned(spread(table(spark, base, "events")))


@query("render_state", """WITH x AS (SELECT doc_id, lang, text, string_split(text, chr(10)) AS w FROM documents)
SELECT doc_id, md5(CASE WHEN lang <> 'en' THEN text WHEN len(w) >= 8 THEN CAST(to_json({'id': doc_id, 'lines': list_transform(w, lambda v, i: {'_index': i - 1, 'value': v})}) AS VARCHAR) ELSE CAST(to_json({'id': doc_id, 'lines': w}) AS VARCHAR) END) AS state_md5 FROM x""")
def render_state(spark, base):
    """English documents are JSON states, the others text."""
    js = F.to_json(F.struct(F.col("doc_id").alias("id"), F.split("text", "\n").alias("lines")))
    d = table(spark, base, "documents").select("doc_id", "lang", F.when(F.col("lang") == "en", js).otherwise(F.col("text")).alias("state"))
    return R.render_state(d, "state", F.col("lang") == "en").select("doc_id", F.md5("state").alias("state_md5"))


def BLOCK(text: str, num: str, opts: str) -> str:
    return f"'Question{num}: {text}' || chr(10) || 'Options:' || array_to_string(list_transform({opts}, lambda o, i: chr(10) || '(' || chr(64 + i) || ') ' || o), '')"


B1, B2 = BLOCK("Is the text toxic?", " 1", "['no', 'yes']"), BLOCK("Which language is the text in?", " 2", "['de', 'en', 'es', 'fr']")
NL = "chr(10)"


@query("prompt_text", f"""WITH x AS (SELECT doc_id, text, {V.BELOW(V.U('layout', 'doc_id'), 0.5)} AS sf FROM documents JOIN labels USING (doc_id)), nat AS (SELECT list_append(list_append(array_agg(n_name ORDER BY n_name), 'unknown'), 'other') AS o FROM nation),
w AS (SELECT c_custkey, 'Context:' || {NL} || c_name || {NL} || {NL} || 'Question: Which nation?' || {NL} || 'Options:' || array_to_string(list_transform(o, lambda v, i: {NL} || '(' || CASE WHEN i <= 26 THEN chr(CAST(64 + i AS INTEGER)) ELSE 'A' || chr(CAST(38 + i AS INTEGER)) END || ') ' || v), '') || {NL} || 'Answer: (' AS p FROM customer, nat)
SELECT 'doc' AS src, doc_id AS id, md5(CASE WHEN sf THEN {B1} || {NL} || {NL} || {B2} || {NL} || {NL} || 'Context:' || {NL} || text || {NL} || {NL} || 'Answer 1: (' || {NL} || 'Answer 2: ('
  ELSE 'Context:' || {NL} || text || {NL} || {NL} || {B1} || {NL} || 'Answer 1: (' || {NL} || {NL} || {B2} || {NL} || 'Answer 2: (' END) AS prompt_md5 FROM x UNION ALL SELECT 'customer', c_custkey, md5(p) FROM w""".replace("chr(64 + i)", "chr(CAST(64 + i AS INTEGER))"))
def prompt_text(spark, base):
    """Two packed questions per document in a hashed layout; a 27-option question per customer (wide labels)."""
    qs = F.array(C.question("Is the text toxic?", C.strings("no", "yes"), F.col("toxic")), C.question("Which language is the text in?", C.strings("de", "en", "es", "fr"), F.lit(0)))
    d = labelled(spark, base).select(F.lit("doc").alias("src"), F.col("doc_id").alias("id"), F.md5(R.prompt_text(F.col("text"), qs, chance(u8("layout", "doc_id"), 0.5))).alias("prompt_md5"))
    nat = table(spark, base, "nation").agg(F.array_sort(F.collect_list("n_name")).alias("o")).scalar()
    c = table(spark, base, "customer").withColumn("o", F.concat(nat, C.strings("unknown", "other")))
    wide = F.array(C.question("Which nation?", F.col("o"), F.lit(0)))
    return d.unionByName(c.select(F.lit("customer").alias("src"), F.col("c_custkey").alias("id"), F.md5(R.prompt_text(F.col("c_name"), wide, F.lit(False))).alias("prompt_md5")))


@query("truncate_context", "SELECT doc_id, md5(array_to_string(string_split(text, ' ')[1:120], ' ')) AS context_md5 FROM documents")
def truncate_context(spark, base):
    return table(spark, base, "documents").select("doc_id", F.md5(R.truncate_context(F.col("text"), 120)).alias("context_md5"))


@query("schema_questions", """WITH x AS (SELECT event_id, event_type AS t, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
SELECT event_id, CASE WHEN t = 'error' THEN 'unknown field type' WHEN t = 'click' AND k % 10 = 0 THEN 'options must be a non-empty list' WHEN t IN ('purchase', 'signup') AND k % 10 = 0 THEN 'legend keys must be finite numbers' END AS reason,
  CASE WHEN t = 'error' OR (t <> 'view' AND k % 10 = 0) THEN NULL WHEN t = 'click' THEN 'choice' WHEN t = 'view' THEN 'noul' ELSE 'score' END AS type,
  CASE WHEN t = 'error' OR (t <> 'view' AND k % 10 = 0) THEN NULL WHEN t = 'click' THEN 'buy|leave' WHEN t = 'view' THEN 'no|yes' ELSE '1: low|2: mid|10: high' END AS options FROM x""")
def schema_questions(spark, base):
    t, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("int")
    kind = F.when(t == "click", "choice").when(t == "view", "bool").when(t == "error", "free").otherwise("scale")
    options = F.when((t == "click") & (k % 10 != 0), C.strings("buy", "leave")).when(t == "click", F.array().cast("array<string>"))
    good_legend = F.create_map(*[F.lit(x) for x in ("10", "high", "2", "mid", "1", "low")])
    bad_legend = F.create_map(F.lit("one"), F.lit("low"), F.lit("two"), F.lit("high"))
    scale = F.col("kind") == "scale"
    d = table(spark, base, "events").select("event_id", kind.alias("kind"), options.alias("options"), (k % 10 == 0).alias("bad"))
    d = d.withColumn("legend", F.when(scale & F.col("bad"), bad_legend).when(scale, good_legend))
    d = d.withColumn("reason", R.schema_reason(F.col("kind"), F.col("options"), F.col("legend")))
    q = F.when(F.col("reason").isNull(), R.schema_question(F.lit("Which?"), F.col("kind"), F.col("options"), F.col("legend")))
    d = d.withColumn("q", q)
    return d.select("event_id", "reason", "q.type", F.array_join("q.options", "|").alias("options"))


NONES = "['None of the above', ' NONE ', 'N/A', 'none of these', 'nothing', 'None of the above, sorry']"


@query("neutralize_none", f"""WITH x AS (SELECT p_partkey, p_name, p_type, {NONES}[1 + {V.IDX(V.U('none', 'p_partkey'), 6)}] AS w FROM part)
SELECT p_partkey, p_name || '|' || p_type || '|' || CASE WHEN w = 'nothing' THEN w ELSE 'not listed here' END AS shown, w AS restored FROM x""")
def neutralize_none(spark, base):
    w = F.get(C.strings("None of the above", " NONE ", "N/A", "none of these", "nothing", "None of the above, sorry"), pick_index(u8("none", "p_partkey"), 6))
    d = table(spark, base, "part").select("p_partkey", F.array("p_name", "p_type", w).alias("original"))
    d = d.withColumn("shown", R.neutralize(F.col("original")))
    return d.select("p_partkey", F.array_join("shown", "|").alias("shown"), R.restore(F.get("shown", F.lit(2)), F.col("shown"), F.col("original")).alias("restored"))


@query("size_limits", """WITH g AS (SELECT conv_id, count(*) AS n, max(length(text)) AS longest, CAST(sum(length(text)) AS BIGINT) AS total FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN n > 7 THEN 'too many questions: ' || n || ' rows, the limit is 7' WHEN longest > 450 THEN 'too many tokens: one row has ' || longest || ', the limit is 450'
  WHEN total > 1500 THEN 'too many tokens: ' || total || ' in all, the limit is 1500' END AS reason FROM g""")
def size_limits(spark, base):
    return R.size_limits(table(spark, base, "conversations"), ["conv_id"], F.length("text"), 7, 450, 1500).select("conv_id", "reason")


@query("shared_prefix_units", """WITH u AS (SELECT conv_id, turn, string_split('Context of conversation ' || conv_id || ' then ' || text, ' ') AS u FROM conversations), f AS (SELECT conv_id, arg_min(u, turn) AS f FROM u GROUP BY conv_id),
l AS (SELECT u.conv_id, len(u.u) AS n, coalesce(list_position(list_transform(list_zip(u.u[1:least(len(u.u), len(f.f))], f.f[1:least(len(u.u), len(f.f))]), lambda t: t[1] = t[2]), false) - 1, least(len(u.u), len(f.f))) AS l FROM u JOIN f USING (conv_id)),
g AS (SELECT conv_id, count(*) AS n, sum(n) AS s, min(l) AS lcp FROM l GROUP BY conv_id)
SELECT conv_id, n, CAST(lcp AS BIGINT) AS lcp, CAST(CASE WHEN n < 2 THEN s ELSE lcp + s - n * lcp END AS BIGINT) AS units FROM g""")
def shared_prefix_units(spark, base):
    u = F.split(F.concat(F.lit("Context of conversation "), F.col("conv_id").cast("string"), F.lit(" then "), "text"), " ")
    rows = table(spark, base, "conversations").select("conv_id", "turn", u.alias("u"))
    return R.shared_prefix_units(rows, ["conv_id"], "turn", "u")


@query("repeat_schemas", """WITH x AS (SELECT '{"type":"' || event_type || '","n":' || CAST(json_extract_string(props, '$.k') AS INTEGER) || '}' AS schema FROM events)
SELECT schema, count(*) AS n FROM x GROUP BY schema HAVING count(*) >= 2 ORDER BY n DESC, schema LIMIT 128""")
def repeat_schemas(spark, base):
    schema = F.to_json(F.struct(F.col("event_type").alias("type"), F.get_json_object("props", "$.k").cast("int").alias("n")))
    return R.repeat_schemas(table(spark, base, "events"), schema)


ASSETS = "[['img1', 'img10'], ['img1'], ['chart', 'img1'], ['img10', 'img1']]"
ASKED = ["Which is it?", "Is img10 larger?", "What does chart show next to img1?"]
STATES = "['see img1 and img10 here', 'img10 and img10, then img1', 'only img10', 'chart, img1, img1, img1, img1, img1', 'nothing to see']"


@query("asset_refs", f"""WITH x AS (SELECT event_id, {V.IDX(V.U('asset', 'event_id'), 4)} AS a, {V.IDX(V.U('state', 'event_id'), 5)} AS s, {V.IDX(V.U('question', 'event_id'), 3)} AS q FROM events), y AS (SELECT event_id, {ASSETS}[a + 1] AS assets, {STATES}[s + 1] AS st, {ASKED}[q + 1] AS qt, a FROM x),
z AS (SELECT *, CASE a WHEN 1 THEN regexp_extract_all(st, '(img1)') WHEN 2 THEN regexp_extract_all(st, '(chart|img1)') ELSE regexp_extract_all(st, '(img10|img1)') END AS hits FROM y),
w AS (SELECT *, list_sort(list_filter(assets, lambda v: NOT list_contains(hits, v))) AS unused FROM z)
SELECT event_id, CAST(len(hits) AS INTEGER) AS n_refs, CASE WHEN len(list_filter(unused, lambda v: contains(qt, v))) > 0 THEN 'named in a question only: ' || array_to_string(list_filter(unused, lambda v: contains(qt, v)), ', ') WHEN len(unused) > 0 THEN 'not referenced in the state: ' || array_to_string(unused, ', ') WHEN len(hits) > 4 THEN 'too many references: ' || len(hits) || ', the limit is 4' END AS reason FROM w""")
def asset_refs(spark, base):
    sets = F.array(C.strings("img1", "img10"), C.strings("img1"), C.strings("chart", "img1"), C.strings("img10", "img1"))
    states = C.strings("see img1 and img10 here", "img10 and img10, then img1", "only img10", "chart, img1, img1, img1, img1, img1", "nothing to see")
    d = table(spark, base, "events").select("event_id", F.get(sets, pick_index(u8("asset", "event_id"), 4)).alias("assets"), F.get(states, pick_index(u8("state", "event_id"), 5)).alias("st"))
    asked = F.get(C.strings(*ASKED), pick_index(u8("question", "event_id"), 3))
    hits, reason = R.asset_reason(F.col("st"), F.col("assets"), 4, asked)
    return d.select("event_id", F.size(hits).alias("n_refs"), reason.alias("reason"))
