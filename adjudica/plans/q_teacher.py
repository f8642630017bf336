"""Teacher-record queries: events stand for written questions, users for records."""

from __future__ import annotations

from pyspark.sql import functions as F

from adjudica.functions.hashing import pick_index, u8, u_int
from adjudica.operators import sampling as S
from adjudica.operators import teacher as T
from adjudica.operators.convert import scale_options, strings
from adjudica.plans import views as V
from adjudica.plans.registry import query
from adjudica.sources.tables import table


def I(purpose: str, n: int, key: str = "event_id") -> str:  # noqa: E743
    return V.IDX(V.U(purpose, key), n)


def H(purpose: str, n: int, key: str = "event_id"):
    return pick_index(u8(purpose, key), n)


SEV = "['safe', 'caution', 'destructive']"
TQ = f"""tq AS (SELECT event_id, user_id, event_type, ['choice', 'noul', 'score'][1 + {I('t_kind', 3)}] AS kind, CASE WHEN {I('t_ins', 10)} = 0 THEN 'short' ELSE 'Question about ' || event_type END AS instructions,
  CASE WHEN {I('t_names', 12)} = 0 THEN ['safe'] ELSE {SEV} END AS names, 4 AS n_levels, CASE WHEN {I('t_bad', 9)} = 0 THEN 'unknown' ELSE {SEV}[1 + {I('t_ans', 3)}] END AS answer_str,
  CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 AS answer_int, CASE WHEN {I('t_null', 11)} = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS INTEGER) > 50 END AS answer_bool FROM events),
tv AS (SELECT *, CASE WHEN length(instructions) < 8 THEN 'instructions' WHEN kind = 'noul' AND answer_bool IS NULL THEN 'answer' WHEN kind = 'choice' AND len(names) < 2 THEN 'criteria' WHEN kind = 'choice' AND NOT list_contains(names, answer_str) THEN 'answer'
  WHEN kind = 'score' AND answer_int >= n_levels THEN 'answer' END AS reason FROM tq)"""


def questions(spark, base):
    e = table(spark, base, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    sev = strings(*T.SEVERITY)
    d = e.select(
        "event_id", "user_id", "event_type", F.get(strings("choice", "noul", "score"), H("t_kind", 3)).alias("kind"),
        F.when(H("t_ins", 10) == 0, "short").otherwise(F.concat(F.lit("Question about "), "event_type")).alias("instructions"),
        F.when(H("t_names", 12) == 0, strings("safe")).otherwise(sev).alias("names"), F.lit(4).alias("n_levels"),
        F.when(H("t_bad", 9) == 0, "unknown").otherwise(F.get(sev, H("t_ans", 3))).alias("answer_str"), (k % 5).alias("answer_int"),
        F.when(H("t_null", 11) != 0, k > 50).alias("answer_bool"))
    cols = ("kind", "instructions", "names", "n_levels", "answer_str", "answer_int", "answer_bool")
    return d.withColumn("reason", T.question_reason(*[F.col(c) for c in cols]))


@query("question_check", f"WITH {TQ} SELECT event_id, kind, coalesce(reason, 'ok') AS reason FROM tv")
def question_check(spark, base):
    return questions(spark, base).select("event_id", "kind", F.coalesce("reason", F.lit("ok")).alias("reason"))


@query("record_accept", f"""WITH {TQ} SELECT user_id, count(*) AS n, count(*) FILTER (WHERE reason IS NULL) AS n_valid, count(*) FILTER (WHERE reason IS NULL) >= 50 AS accepted,
  CASE WHEN count(*) FILTER (WHERE reason IS NULL) < 50 THEN count(*) FILTER (WHERE reason IS NULL) || ' valid questions, 50 needed' END AS reason FROM tv GROUP BY user_id""")
def record_accept(spark, base):
    return T.accept_records(questions(spark, base), ["user_id"], F.col("reason").isNull(), 50)


@query("record_bounds", f"""WITH x AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type AS t FROM events),
r AS (SELECT event_id, CASE t WHEN 'click' THEN 'routing' WHEN 'view' THEN 'command' WHEN 'error' THEN 'essay' ELSE 'situation' END AS recipe, repeat('x', k * 4 % 350) AS state, list_transform(range(k % 11), lambda i: 'o' || i) AS options,
  CASE t WHEN 'click' THEN 'o' || (k % 12) WHEN 'view' THEN ['safe', 'caution', 'destructive', 'odd'][1 + k % 4] ELSE CAST(k % 7 AS VARCHAR) END AS answer, k FROM x)
SELECT event_id, recipe, coalesce(CASE WHEN recipe = 'essay' THEN 'unknown recipe' WHEN recipe = 'routing' AND NOT (length(state) BETWEEN 3 AND 300) THEN 'state' WHEN recipe = 'routing' AND NOT (len(options) BETWEEN 3 AND 9) THEN 'options'
  WHEN recipe = 'command' AND NOT (length(state) BETWEEN 2 AND 300) THEN 'state' WHEN recipe = 'situation' AND length(state) < 1 THEN 'state' WHEN recipe = 'situation' AND NOT (len(options) BETWEEN 3 AND 6) THEN 'options'
  WHEN recipe = 'routing' AND NOT (list_contains(options, 'o' || (k % 5)) AND k % 5 <> 1) THEN 'generic and catch-all' WHEN recipe = 'routing' AND NOT list_contains(options, answer) THEN 'answer'
  WHEN recipe = 'command' AND answer = 'odd' THEN 'answer' WHEN recipe = 'command' AND k % 13 = 0 THEN 'outside' WHEN recipe = 'situation' AND NOT (CAST(answer AS INTEGER) < len(options)) THEN 'answer' END, 'ok') AS reason FROM r""")
def record_bounds(spark, base):
    """Three recipes of records and one that is unknown; sizes and answers follow from the event's number."""
    e = table(spark, base, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.col("event_type").alias("t"))
    k, t = F.col("k"), F.col("t")
    recipe = F.when(t == "click", "routing").when(t == "view", "command").when(t == "error", "essay").otherwise("situation")
    options = F.transform(F.slice(F.sequence(F.lit(0), F.lit(10)), F.lit(1), k % 11), lambda i: F.concat(F.lit("o"), i.cast("string")))
    answer = F.when(t == "click", F.concat(F.lit("o"), (k % 12).cast("string"))).when(t == "view", F.get(strings(*T.SEVERITY, "odd"), k % 4)).otherwise((k % 7).cast("string"))
    d = e.select("event_id", recipe.alias("recipe"), F.repeat(F.lit("x"), k * 4 % 350).alias("state"), options.alias("options"), answer.alias("answer"),
                 F.concat(F.lit("o"), (k % 5).cast("string")).alias("generic"), F.lit("o1").alias("catchall"), F.when(k % 13 != 0, k % 2 == 0).alias("outside"))
    reason = T.record_reason(*[F.col(c) for c in ("recipe", "state", "options", "answer", "generic", "catchall", "outside")])
    return d.select("event_id", "recipe", F.coalesce(reason, F.lit("ok")).alias("reason"))


RAW = "[' TRUE ', 'yes', 'No', 'maybe', ' 3 ', '3.5', '12', 'false']"


@query("coerce_answers", f"""WITH x AS (SELECT event_id, {RAW}[1 + {I('raw', 8)}] AS raw FROM events)
SELECT event_id, CASE WHEN lower(trim(raw)) IN ('true', 'yes') THEN true WHEN lower(trim(raw)) IN ('false', 'no') THEN false END AS as_bool, CASE WHEN regexp_matches(trim(raw), '^[0-9]+$') THEN CAST(trim(raw) AS INTEGER) END AS as_int, 'none|some|all' AS levels FROM x""")
def coerce_answers(spark, base):
    raw = F.get(strings(" TRUE ", "yes", "No", "maybe", " 3 ", "3.5", "12", "false"), H("raw", 8))
    legend = F.create_map(*[F.lit(x) for x in ("10", "all", "2", "some", "0", "none")])
    keys, _ = scale_options(legend)
    d = table(spark, base, "events").select("event_id", raw.alias("raw"))
    return d.select("event_id", T.coerce_bool(F.col("raw")).alias("as_bool"), T.coerce_int(F.col("raw")).alias("as_int"), F.array_join(F.transform(keys, lambda k: legend[k]), "|").alias("levels"))


W = r"list_filter(regexp_split_to_array(regexp_replace({c}, '^\s+|\s+$', '', 'g'), '\s+'), lambda w: w <> '')"
CT = f"""ct AS (SELECT conv_id, turn, text AS base, CASE k WHEN 0 THEN text WHEN 1 THEN array_to_string(list_reverse(string_split(text, ' ')), ' ') WHEN 2 THEN text || repeat(' more words', 9) ELSE replace(text, 'en', 'an') || ' today' END AS changed,
  CASE WHEN k = 4 THEN 'yes' ELSE 'no' END AS a2 FROM (SELECT *, {V.IDX(V.U('edit', 'conv_id', 'turn'), 6)} AS k FROM conversations))"""


def pairs(spark, base):
    """Turns and an edited copy: unchanged, reversed, much longer, or lightly edited (by hash)."""
    k = pick_index(u8("edit", "conv_id", "turn"), 6)
    t = F.col("text")
    changed = F.when(k == 0, t).when(k == 1, F.array_join(F.reverse(F.split(t, " ")), " ")).when(k == 2, F.concat(t, F.repeat(F.lit(" more words"), 9))).otherwise(F.concat(F.replace(t, F.lit("en"), F.lit("an")), F.lit(" today")))
    return table(spark, base, "conversations").select("conv_id", "turn", t.alias("base"), changed.alias("changed"), F.when(k == 4, "yes").otherwise("no").alias("a2"))


@query("contrastive_valid", f"""WITH {CT}, w AS (SELECT *, {W.format(c='base')} AS wa, {W.format(c='changed')} AS wb FROM ct),
s AS (SELECT *, len(list_filter(list_zip(wa[1:least(len(wa), len(wb))], wb[1:least(len(wa), len(wb))]), lambda t: t[1] = t[2])) AS same FROM w)
SELECT conv_id, turn, CASE WHEN base = changed THEN 'states' WHEN a2 = 'yes' THEN 'answers' WHEN abs(len(wa) - len(wb)) > 12 THEN 'length' WHEN same < 0.6 * least(len(wa), len(wb)) THEN 'words' ELSE 'ok' END AS reason FROM s""")
def contrastive_valid(spark, base):
    r = T.contrastive_reason(F.col("base"), F.col("changed"), F.lit("yes"), F.col("a2"))
    return pairs(spark, base).select("conv_id", "turn", F.coalesce(r, F.lit("ok")).alias("reason"))


FOCUS = "CASE WHEN conv_id % 3 = 0 THEN '\"' || substr(text, 5, 24) || '\"' WHEN conv_id % 3 = 1 THEN substr(text, 2, 6) ELSE 'a sentence that is not there' END"


@query("blank_focus", f"""WITH x AS (SELECT conv_id, turn, text, regexp_replace(regexp_replace({FOCUS}, '^\\s+|\\s+$', '', 'g'), '^"+|"+$', '', 'g') AS f FROM conversations)
SELECT conv_id, turn, CASE WHEN length(f) >= 8 AND strpos(text, f) > 0 THEN md5(substr(text, 1, strpos(text, f) - 1) || '[...]' || substr(text, strpos(text, f) + length(f))) END AS blanked_md5 FROM x""")
def blank_focus(spark, base):
    k = F.col("conv_id") % 3
    focus = F.when(k == 0, F.concat(F.lit('"'), F.substring("text", 5, 24), F.lit('"'))).when(k == 1, F.substring("text", 2, 6)).otherwise("a sentence that is not there")
    return table(spark, base, "conversations").select("conv_id", "turn", F.md5(T.blank_focus(F.col("text"), focus)).alias("blanked_md5"))


CHECK = f"""pr AS (SELECT event_id, {I('pred', 4)} AS pred FROM events), ag AS (SELECT tv.event_id, tv.user_id, tv.kind, tv.event_type, CASE WHEN kind = 'score' THEN abs(pred - answer_int) <= 1 ELSE pred % 3 = answer_int % 3 END AS ok FROM tv JOIN pr ON pr.event_id = tv.event_id)"""


def checked(spark, base):
    """Written answers joined with the checker's answers."""
    preds = table(spark, base, "events").select("event_id", H("pred", 4).alias("pred"))
    d = questions(spark, base).join(preds, "event_id")
    score = F.col("kind") == "score"
    p, g = F.when(score, F.col("pred")).otherwise(F.col("pred") % 3), F.when(score, F.col("answer_int")).otherwise(F.col("answer_int") % 3)
    return d.withColumn("ok", T.agrees(F.col("kind"), p, g))


@query("teacher_agree", f"""WITH {TQ}, {CHECK}, k AS (SELECT user_id FROM ag GROUP BY user_id HAVING count(*) FILTER (WHERE ok) >= least(2, count(*))) SELECT event_id, user_id, kind FROM ag WHERE ok AND user_id IN (SELECT user_id FROM k)""")
def teacher_agree(spark, base):
    return T.keep_agreed(checked(spark, base), ["user_id"], "ok").select("event_id", "user_id", "kind")


@query("agree_report", f"WITH {TQ}, {CHECK} SELECT kind, event_type AS grp, count(*) AS n, round(avg(CAST(ok AS INTEGER)), 6) AS rate FROM ag GROUP BY 1, 2")
def agree_report(spark, base):
    return checked(spark, base).groupBy("kind", F.col("event_type").alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("ok").cast("int")), 6).alias("rate"))


UNIT = "CAST('0x' || {u} AS BIGINT) / 4294967296.0"
MEM = f"""mm AS (SELECT event_id, m.member, CASE WHEN event_id % 2 = 0 THEN 'score' ELSE 'choice' END AS kind, {V.IDX(V.U('m_pred', 'event_id', 'm.member'), 3)} AS pred, {V.IDX(V.U('m_gold', 'event_id', 'm.member'), 3)} AS gold,
  {UNIT.format(u=V.U('m_p', 'event_id', 'm.member'))} AS p_gold FROM events, (SELECT unnest([0, 1, 2]) AS member) m WHERE m.member < 2 OR event_type <> 'view')"""


@query("pair_verify", f"""WITH {MEM}, g AS (SELECT event_id, max(kind) AS kind, max(CASE WHEN member = 0 THEN pred END) AS pa, max(CASE WHEN member = 0 THEN gold END) AS ga, max(CASE WHEN member = 0 THEN p_gold END) AS ca, max(CASE WHEN member = 1 THEN pred END) AS pb,
  max(CASE WHEN member = 1 THEN gold END) AS gb, max(CASE WHEN member = 1 THEN p_gold END) AS cb, max(CASE WHEN member = 2 THEN p_gold END) AS cz FROM mm GROUP BY event_id)
SELECT event_id, abs(pa - ga) <= CASE kind WHEN 'score' THEN 1 ELSE 0 END AND abs(pb - gb) <= CASE kind WHEN 'score' THEN 1 ELSE 0 END AND pa <> pb AND least(ca, cb) >= 0.5 AND coalesce(cz <= ca - 0.15, true) AS ok, cz <= ca - 0.15 AS removal_ok FROM g""")
def pair_verify(spark, base):
    members = F.when(F.col("event_type") == "view", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1), F.lit(2)))
    m = table(spark, base, "events").select("event_id", F.explode(members).alias("member"))
    key = ("event_id", "member")
    m = m.select(*key, F.when(F.col("event_id") % 2 == 0, "score").otherwise("choice").alias("kind"), pick_index(u8("m_pred", *key), 3).alias("pred"), pick_index(u8("m_gold", *key), 3).alias("gold"),
                 (u_int(u8("m_p", *key)) / F.lit(4294967296.0)).alias("p_gold"))
    return T.verify_pairs(m, ["event_id"]).select("event_id", "ok", "removal_ok")


RT = f"""rt AS (SELECT event_id AS seq, event_type, {I('terse', 2)} = 0 AS terse, CASE WHEN {I('grp', 3)} = 0 THEN 'generic' ELSE 'specific' END AS grp, ['support', 'billing', 'returns desk', 'parcels'][1 + {I('r_ans', 4)}] AS answer, {I('r_ok', 4)} = 0 AS teacher_ok,
  ['other', 'billing'][1 + {I('r_pred', 2)}] AS teacher_pred, 'other' AS catchall, user_id % 40 AS list_id FROM events),
nb AS (SELECT list_id, arg_max(answer, seq) AS bucket FROM rt WHERE terse AND grp = 'generic' GROUP BY list_id)"""


@query("routing_keep", f"""WITH {RT} SELECT seq, terse, grp FROM rt LEFT JOIN nb USING (list_id) WHERE (teacher_ok OR (grp = 'generic' AND teacher_pred = catchall)) AND (NOT terse OR coalesce(bucket IN ('support', 'returns desk'), false))""")
def routing_keep(spark, base):
    e = table(spark, base, "events")
    r = e.select(
        F.col("event_id").alias("seq"), (H("terse", 2) == 0).alias("terse"), F.when(H("grp", 3) == 0, "generic").otherwise("specific").alias("group"),
        F.get(strings("support", "billing", "returns desk", "parcels"), H("r_ans", 4)).alias("answer"), (H("r_ok", 4) == 0).alias("teacher_ok"),
        F.get(strings("other", "billing"), H("r_pred", 2)).alias("teacher_pred"), F.lit("other").alias("catchall"), (F.col("user_id") % 40).alias("list_id"))
    return T.routing_keep(r, ["list_id"], ("support", "desk", "general")).select("seq", "terse", F.col("group").alias("grp"))


@query("ordinal_keep", f"""WITH x AS (SELECT event_id, {I('o_pred', 4)} AS p, {I('o_ans', 3)} AS a FROM events) SELECT event_id, p = a OR (p < 3 AND abs(p - a) = 1) AS keep FROM x""")
def ordinal_keep(spark, base):
    sev = strings(*T.SEVERITY, "unknown")
    d = table(spark, base, "events").select("event_id", F.get(sev, H("o_pred", 4)).alias("p"), F.get(sev, H("o_ans", 3)).alias("a"))
    return d.select("event_id", T.ordinal_keep(F.col("p") == F.col("a"), F.col("p"), F.col("a")).alias("keep"))


@query("description_jobs", f"""WITH e AS (SELECT c_mktsegment AS label, c_name, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {V.U('exemplar', 'c_name')}, c_name) AS rn FROM customer),
x AS (SELECT label, array_agg(c_name ORDER BY rn) AS ex FROM e WHERE rn <= 5 GROUP BY label), l AS (SELECT array_agg(label ORDER BY label) AS labels FROM x)
SELECT label, 'Question: Which segment?' || chr(10) || 'Categories: ' || array_to_string(labels, ', ') || chr(10) || 'Describe: ' || label || chr(10) || 'Examples:' || chr(10) || array_to_string(list_transform(ex, lambda v: '- ' || v), chr(10)) AS prompt,
  length('Firms in ' || lower(label)) BETWEEN 10 AND 300 AS accepted FROM x, l""")
def description_jobs(spark, base):
    c = table(spark, base, "customer").select(F.col("c_mktsegment").alias("label"), "c_name")
    x = S.exemplars(c, ["label"], "c_name", 5)
    labels = c.select("label").distinct().orderBy("label").limit(41).agg(F.array_sort(F.collect_list("label")).alias("l")).scalar()  # one more than is shown
    x = x.withColumn("labels", labels)
    p = T.description_job(F.lit("Which segment?"), F.col("labels"), F.col("label"), F.col("exemplars"), most=40)
    return x.select("label", p.alias("prompt"), T.description_ok(F.concat(F.lit("Firms in "), F.lower("label")), F.lit("anything else")).alias("accepted"))


@query("flatten_members", f"""WITH {CT} SELECT conv_id, turn, 0 AS member, md5(base) AS state_md5, 'yes' AS answer FROM ct UNION ALL SELECT conv_id, turn, 1, md5(changed), a2 FROM ct""")
def flatten_members(spark, base):
    m = F.array(F.struct(F.lit(0).alias("member"), F.col("base").alias("state"), F.lit("yes").alias("answer")), F.struct(F.lit(1).alias("member"), F.col("changed").alias("state"), F.col("a2").alias("answer")))
    return pairs(spark, base).select("conv_id", "turn", F.inline(m)).select("conv_id", "turn", "member", F.md5("state").alias("state_md5"), "answer")


AXES = {"kind": ("an email", "a log line", "a chat"), "recipe": ("generic", "catchall", "mixed"), "tone": ("terse", "polite", "angry", "neutral")}


@query("prompt_grid", "SELECT doc_id, 'Write ' || " + "{0} || ' for a ' || {1} || ' list, ' || {2} AS prompt FROM documents".format(*[f"{list(v)!r}[1 + {V.IDX(V.U('axis_' + k, 'doc_id'), len(v))}]" for k, v in AXES.items()]))
def prompt_grid(spark, base):
    """One job per document: a hashed point of the kind x recipe x tone grid."""
    return table(spark, base, "documents").select("doc_id", T.prompt_job("doc_id", "Write %s for a %s list, %s", AXES).alias("prompt"))


@query("multi_answer_agree", f"""WITH a AS (SELECT event_id, {I('written', 3)} AS w, {V.IDX(V.U('second', 'event_id', 'r.i'), 3)} AS x FROM events, (SELECT unnest([1, 2]) AS i) r) SELECT event_id, count(*) FILTER (WHERE x = w) AS agree FROM a GROUP BY event_id HAVING count(*) FILTER (WHERE x = w) >= 2""")
def multi_answer_agree(spark, base):
    a = table(spark, base, "events").select("event_id", H("written", 3).alias("w"), F.explode(F.array(F.lit(1), F.lit(2))).alias("i"))
    a = a.withColumn("x", pick_index(u8("second", "event_id", "i"), 3))
    return T.independent_agreement(a, ["event_id"], "x", "w")
