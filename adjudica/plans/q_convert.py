"""Conversion queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from adjudica.functions import text as X
from adjudica.functions.hashing import chance, hash_sort, pick_index, place, u8
from adjudica.operators import convert as C
from adjudica.operators.ranking import hash_bucket, top_by_hash, with_rank
from adjudica.plans import views as V
from adjudica.plans.registry import query
from adjudica.sources.tables import materialise, table


def HASH_SORT(lst: str, purpose: str, key: str) -> str:
    """SQL of hashing.hash_sort."""
    u = f"substr(md5('7|{purpose}|' || {key} || '|' || hv), 1, 8)"
    return f"list_transform(list_sort(list_transform({lst}, lambda hv: {{'u': {u}, 'v': hv}})), lambda hs: hs.v)"


STRIP = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def labelled(spark, base):
    return table(spark, base, "documents").join(table(spark, base, "labels"), "doc_id")


@query("classify_convert", f"""SELECT doc_id, md5({STRIP.format(c='text')}) AS context_md5, quality AS gold, 'no|yes' AS options FROM documents LEFT JOIN labels USING (doc_id)
WHERE quality IS NOT NULL AND quality BETWEEN 0 AND 1 AND {STRIP.format(c='text')} <> ''""")
def classify_convert(spark, base):
    d = table(spark, base, "documents").join(table(spark, base, "labels"), "doc_id", "left")
    e = C.classify(d, F.col("text"), F.col("quality"), "Is the document of good quality?", C.strings("no", "yes"), "doc_quality")
    q = F.col("qs")[0]
    return e.select("doc_id", F.md5("context").alias("context_md5"), q["gold"].alias("gold"), F.array_join(q["options"], "|").alias("options"))


@query("label_vocab", """SELECT field, CAST(row_number() OVER (PARTITION BY field ORDER BY label) - 1 AS INTEGER) AS idx, label FROM
  (SELECT DISTINCT 'lang' AS field, lang AS label FROM documents UNION SELECT DISTINCT 'source', source FROM documents)""")
def label_vocab(spark, base):
    return C.label_vocabulary(table(spark, base, "documents"), ["lang", "source"])


@query("label_nice", r"""SELECT 'nation' AS field, n_name AS label, trim(replace(n_name, '_', ' ')) AS nice FROM nation
UNION ALL SELECT DISTINCT 'part', camel, lower(regexp_replace(camel, '([a-z])([A-Z])', '\1 \2', 'g')) FROM (SELECT list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', '') AS camel FROM part)""")
def label_nice(spark, base):
    n = table(spark, base, "nation").select(F.lit("nation").alias("field"), F.col("n_name").alias("label"), X.nice_label(F.col("n_name")).alias("nice"))
    camel = F.regexp_replace(F.initcap("p_name"), " ", "")
    p = table(spark, base, "part").select(F.lit("part").alias("field"), camel.alias("label")).distinct().withColumn("nice", X.camel_label(F.col("label")))
    return n.unionByName(p)


PAIRS = "pr AS (SELECT a.conv_id, a.turn, a.role AS r1, b.role AS r2, a.text AS t1, b.text AS t2 FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"


def turn_pairs(spark, base):
    """Consecutive turns; the join key holds the turn, so a long conversation is spread over its turns."""
    c = table(spark, base, "conversations")
    a = c.select("conv_id", "turn", F.col("role").alias("r1"), F.col("text").alias("t1"))
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("r2"), F.col("text").alias("t2"))
    return a.join(b, ["conv_id", "turn"])


@query("pair_convert", f"""WITH {PAIRS} SELECT conv_id, turn, md5('Text 1: ' || t1 || chr(10) || 'Text 2: ' || t2) AS context_md5, CAST(r2 = 'assistant' AS INTEGER) AS gold FROM pr""")
def pair_convert(spark, base):
    p = turn_pairs(spark, base)
    ctx = F.format_string("Text 1: %s\nText 2: %s", "t1", "t2")
    e = C.classify(p, ctx, (F.col("r2") == "assistant").cast("int"), "Is the second text a reply?", C.strings("no", "yes"), "pairs")
    return e.select("conv_id", "turn", F.md5("context").alias("context_md5"), F.col("qs")[0]["gold"].alias("gold"))


@query("multi_attribute", """SELECT doc_id, CAST(qidx AS INTEGER) AS qidx, q AS text, CAST(gold AS INTEGER) AS gold, CAST(n AS INTEGER) AS n_options FROM (
  SELECT doc_id, 0 AS qidx, 'Is the text toxic?' AS q, toxic AS gold, 2 AS n FROM documents JOIN labels USING (doc_id)
  UNION ALL SELECT doc_id, 1, 'Is the text of good quality?', quality, 2 FROM documents JOIN labels USING (doc_id)
  UNION ALL SELECT doc_id, 2, 'Which language is the text in?', list_position(['de', 'en', 'es', 'fr'], lang) - 1, 4 FROM documents JOIN labels USING (doc_id))""")
def multi_attribute(spark, base):
    langs = C.strings("de", "en", "es", "fr")
    yn = C.strings("no", "yes")
    e = labelled(spark, base).select("doc_id", F.array(
        C.question("Is the text toxic?", yn, F.col("toxic")),
        C.question("Is the text of good quality?", yn, F.col("quality")),
        C.question("Which language is the text in?", langs, F.array_position(langs, F.col("lang")) - 1),
    ).alias("qs"))
    return C.to_long(e, ["doc_id"]).select("doc_id", "qidx", "text", "gold", F.size("options").alias("n_options"))


MCQ_LETTER = f"substr('ABCDE', {V.IDX(V.U('mcq', 'p_partkey'), 5)} + 1, 1)"


@query("mcq_convert", f"""WITH x AS (SELECT p_partkey, p_name, {MCQ_LETTER} AS letter, CASE WHEN p_size % 5 = 0 THEN [p_type] WHEN p_size % 2 = 0 THEN [' ' || p_type, p_brand] ELSE [p_type, p_brand || ' ', p_name] END AS o FROM part)
SELECT p_partkey, CAST(ascii(letter) - 65 AS INTEGER) AS gold, array_to_string(list_transform(o, lambda v: trim(v)), '|') AS options FROM x WHERE len(o) >= 2 AND ascii(letter) - 65 < len(o)""")
def mcq_convert(spark, base):
    size, cat = F.col("p_size"), F.concat
    opts = F.when(size % 5 == 0, F.array("p_type")).when(size % 2 == 0, F.array(cat(F.lit(" "), "p_type"), "p_brand")).otherwise(F.array("p_type", cat("p_brand", F.lit(" ")), "p_name"))
    letter = F.substring(F.lit("ABCDE"), pick_index(u8("mcq", "p_partkey"), 5) + 1, F.lit(1))
    e = C.multiple_choice(table(spark, base, "part"), F.col("p_name"), opts, C.letter_index(letter), "Which option fits?", "parts")
    q = F.col("qs")[0]
    return e.select("p_partkey", q["gold"].alias("gold"), F.array_join(q["options"], "|").alias("options"))


@query("shuffle_options", f"""WITH x AS (SELECT doc_id, lang, {HASH_SORT("['de', 'en', 'es', 'fr']", 'shuffle', 'doc_id')} AS o FROM documents)
SELECT doc_id, array_to_string(o, '|') AS options, CAST(list_position(o, lang) - 1 AS INTEGER) AS gold FROM x""")
def shuffle_options(spark, base):
    langs = C.strings("de", "en", "es", "fr")
    d = table(spark, base, "documents")
    o, g = C.shuffle_options(langs, F.array_position(langs, F.col("lang")) - 1, "doc_id")
    return d.select("doc_id", F.array_join(o, "|").alias("options"), g.cast("int").alias("gold"))


@query("scale_convert", """SELECT o_orderkey, CAST(CASE substr(o_orderpriority, 1, 1) WHEN '5' THEN 0 WHEN '1' THEN 4 ELSE 5 - CAST(substr(o_orderpriority, 1, 1) AS INTEGER) END AS INTEGER) AS gold,
  '-2: low|-1: unspecified|0: medium|1: high|10: urgent' AS options FROM orders""")
def scale_convert(spark, base):
    """Legend keys sort by value, not as text."""
    legend = F.create_map(*[F.lit(x) for x in ("10", "urgent", "1", "high", "0", "medium", "-1", "unspecified", "-2", "low")])
    keys, opts = C.scale_options(legend)
    key_of = F.create_map(*[F.lit(x) for x in ("1", "10", "2", "1", "3", "0", "4", "-1", "5", "-2")])
    o = table(spark, base, "orders").withColumn("level", key_of[F.substring("o_orderpriority", 1, 1)])
    return o.select("o_orderkey", (F.array_position(keys, F.col("level")) - 1).cast("int").alias("gold"), F.array_join(opts, "|").alias("options"))


@query("threshold_label", """SELECT c_custkey, CAST(greatest(0, least(5, round_even(c_acctbal / 2000.0, 0))) AS INTEGER) AS level, CAST(c_acctbal >= 5000 AS INTEGER) AS flag FROM customer""")
def threshold_label(spark, base):
    level = F.greatest(F.lit(0), F.least(F.lit(5), F.bround(F.col("c_acctbal") / 2000.0, 0))).cast("int")
    return table(spark, base, "customer").select("c_custkey", level.alias("level"), (F.col("c_acctbal") >= 5000).cast("int").alias("flag"))


@query("clip_text", "SELECT doc_id, md5(CASE WHEN length(text) <= 500 THEN text ELSE substr(text, 1, 500) || ' ...' END) AS clipped, CAST(least(length(text), 504) AS BIGINT) AS n FROM documents")
def clip_text(spark, base):
    c = X.clip(F.col("text"), 500)
    return table(spark, base, "documents").select("doc_id", F.md5(c).alias("clipped"), F.least(F.length("text"), F.lit(504)).cast("bigint").alias("n"))


@query("single_label_only", """SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'quality' END AS label FROM labels WHERE toxic + quality = 1""")
def single_label_only(spark, base):
    flags = F.array_compact(F.array(F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic")))
    d = table(spark, base, "labels").withColumn("labels", flags).filter(F.size("labels") == 1)
    return d.select("doc_id", F.col("labels")[0].alias("label"))


@query("quality_filter", "SELECT doc_id, source FROM documents WHERE lang = 'en' AND text IS NOT NULL AND source IS NOT NULL AND n_chars >= 2 * 100")
def quality_filter(spark, base):
    d = table(spark, base, "documents")
    return d.filter((F.col("lang") == "en") & F.col("text").isNotNull() & F.col("source").isNotNull() & (F.col("n_chars") >= 200)).select("doc_id", "source")


TRIPLES = """tp AS (SELECT u.conv_id, u.turn, u.text AS ask, a.text AS chosen, r.text AS rejected FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  JOIN conversations r ON r.conv_id = u.conv_id AND r.turn = u.turn + 3 WHERE u.role = 'user' AND a.role = 'assistant' AND r.role = 'assistant')"""


def preference_rows(spark, base):
    """A question, its reply, and the next reply of the same conversation as the rejected one."""
    c = table(spark, base, "conversations")
    u = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("ask"))
    reply = c.filter("role = 'assistant'")
    a = reply.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("chosen"))
    r = reply.select("conv_id", (F.col("turn") - 3).alias("turn"), F.col("text").alias("rejected"))
    return u.join(a, ["conv_id", "turn"]).join(r, ["conv_id", "turn"])


@query("split_last_turn", f"""WITH {TRIPLES}, s AS (SELECT conv_id, turn, {STRIP.format(c="'Human: ' || ask")} AS p1, {STRIP.format(c='chosen')} AS c, {STRIP.format(c='rejected')} AS r FROM tp)
SELECT conv_id, turn, md5(p1) AS prefix_md5, md5(c) AS chosen_md5, md5(r) AS rejected_md5 FROM s WHERE c <> '' AND r <> '' AND c <> r""")
def split_last_turn(spark, base):
    """Two transcripts per row are split at their last assistant turn; prefixes must agree, replies must differ."""
    t = preference_rows(spark, base)
    talk = lambda c: F.format_string("\n\nHuman: %s\n\nAssistant: %s", F.col("ask"), F.col(c))
    p1, c = C.split_last(talk("chosen"), "\n\nAssistant:")
    p2, r = C.split_last(talk("rejected"), "\n\nAssistant:")
    d = t.select("conv_id", "turn", p1.alias("p1"), c.alias("c"), p2.alias("p2"), r.alias("r"))
    d = d.filter((F.col("p1") == F.col("p2")) & (F.col("c") != "") & (F.col("r") != "") & (F.col("c") != F.col("r")))
    return d.select("conv_id", "turn", F.md5("p1").alias("prefix_md5"), F.md5("c").alias("chosen_md5"), F.md5("r").alias("rejected_md5"))


FLIP = V.BELOW(V.U("flip", "conv_id", "turn"), 0.5)


@query("preference_pairs", f"""WITH {TRIPLES}, x AS (SELECT *, CASE WHEN chosen = rejected THEN 2 ELSE 0 END AS better FROM tp)
SELECT conv_id, turn, CAST(CASE WHEN better = 2 OR NOT {FLIP} THEN better ELSE 1 - better END AS INTEGER) AS gold,
  md5('Prompt:' || chr(10) || ask || chr(10) || chr(10) || 'Response A:' || chr(10) || CASE WHEN {FLIP} THEN rejected ELSE chosen END || chr(10) || chr(10) || 'Response B:' || chr(10) || CASE WHEN {FLIP} THEN chosen ELSE rejected END) AS context_md5 FROM x""")
def preference_pairs(spark, base):
    t = preference_rows(spark, base)
    better = F.when(F.col("chosen") == F.col("rejected"), 2).otherwise(0)
    a, b, gold = C.preference(better, F.col("chosen"), F.col("rejected"), "conv_id", "turn")
    ctx = F.format_string("Prompt:\n%s\n\nResponse A:\n%s\n\nResponse B:\n%s", F.col("ask"), a, b)
    return t.select("conv_id", "turn", gold.alias("gold"), F.md5(ctx).alias("context_md5"))


@query("graded_preference", f"""WITH h AS (SELECT conv_id, turn, array_to_string(array_agg(role || ': ' || text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), chr(10)) AS ctx FROM conversations)
SELECT conv_id, turn, md5(ctx) AS context_md5, CAST({V.IDX(V.U('grade', 'conv_id', 'turn'), 7)} - 3 AS INTEGER) AS preference, CAST({V.IDX(V.U('grade', 'conv_id', 'turn'), 7)} AS INTEGER) AS gold FROM h""")
def graded_preference(spark, base):
    """The last four turns as the context, a grade in -3..3 as an ordinal option."""
    c = table(spark, base, "conversations").withColumn("line", F.concat_ws(": ", "role", "text"))
    h = C.last_k(c, ["conv_id"], "turn", "line", 4, include_self=True)
    h = h.withColumn("preference", pick_index(u8("grade", "conv_id", "turn"), 7) - 3)
    legend = F.create_map(*[x for k in range(-3, 4) for x in (F.lit(k), F.lit(f"grade {k}"))])
    keys, _ = C.scale_options(legend)
    return h.select("conv_id", "turn", F.md5(F.array_join("history", "\n")).alias("context_md5"), "preference", (F.array_position(keys, F.col("preference")) - 1).cast("int").alias("gold"))


CALLED = V.BELOW(V.U("called", "p_partkey"), 0.75)


@query("tool_selection", f"""WITH pool AS (SELECT array_agg(n ORDER BY substr(md5('7|pool_order|' || n), 1, 8), n) AS p FROM (SELECT DISTINCT p_name AS n FROM part)),
x AS (SELECT p_partkey, p_name, p, {V.PLACE('pool', 'len(p)', 'p_partkey')} AS st FROM part, pool), y AS (SELECT p_partkey, p_name, list_filter(list_concat(p[st + 1:st + 6], p[1:6]), lambda v: v <> p_name) AS turned FROM x),
z AS (SELECT p_partkey, p_name, list_concat([p_name], list_filter(turned, lambda v, i: list_position(turned, v) = i))[1:5] AS names FROM y),
w AS (SELECT p_partkey, p_name, list_concat({HASH_SORT('names', 'tools', 'p_partkey')}, ['no function call needed']) AS o FROM z)
SELECT p_partkey, array_to_string(o, '|') AS options, CAST(CASE WHEN {CALLED} THEN list_position(o, p_name) - 1 ELSE len(o) - 1 END AS INTEGER) AS gold FROM w""")
def tool_selection(spark, base):
    """Requests for parts; the pool is the table's vocabulary of part names (names of functions, not rows)."""
    part = table(spark, base, "part").select("p_partkey", "p_name")
    d = C.pool_slice(part, "p_partkey", part.select(F.col("p_name").alias("n")).distinct(), "n", 6)
    called = F.when(chance(u8("called", "p_partkey"), 0.75), F.col("p_name"))
    o, g = C.tool_options(F.array("p_name"), F.col("picked"), called, 6, "p_partkey")
    return d.select("p_partkey", F.array_join(o, "|").alias("options"), g.alias("gold"))


@query("tool_call_extract", f"""WITH x AS (SELECT p_partkey, p_name, p_brand, {V.IDX(V.U('callkind', 'p_partkey'), 3)} AS k FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN p_name END AS gold, CAST(2 AS INTEGER) AS n_functions FROM x WHERE k <> 1""")
def tool_call_extract(spark, base):
    """A system text with two function objects and a reply that calls one, an unknown one (dropped) or none."""
    k = pick_index(u8("callkind", "p_partkey"), 3)
    system = F.format_string('You may call: {"name": "%s", "description": "make one"} and { "name": "%s", "description": "brand info"}', "p_name", "p_brand")
    reply = F.when(k == 0, F.format_string('<functioncall> {"name": "%s", "arguments": "{}"}', "p_name")).when(k == 1, F.lit('<functioncall> {"name": "unknown_tool"}')).otherwise(F.lit("Sure, I can help."))
    d = table(spark, base, "part").select("p_partkey", system.alias("system"), X.strip(reply).alias("reply"))
    rx = r'\{\s*"name":\s*"([^"]+)",\s*"description":\s*"([^"]*)"'
    d = d.withColumn("functions", F.regexp_extract_all("system", F.lit(rx), F.lit(1)))
    gold = F.when(F.col("reply").startswith("<functioncall>"), F.regexp_extract("reply", r'"name":\s*"([^"]+)"', 1))
    d = d.withColumn("gold", gold).filter((F.size("functions") > 0) & (F.col("gold").isNull() | F.array_contains("functions", F.col("gold"))))
    return d.select("p_partkey", "gold", F.size("functions").alias("n_functions"))


STEP_SQL = """st AS (SELECT conv_id, conv_id % 5 AS env, turn, substr(string_split(text, chr(10))[1], 1, 120) AS act, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS step, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE role = 'assistant'),
pl AS (SELECT env, act, row_number() OVER (PARTITION BY env ORDER BY substr(md5('7|apool|' || conv_id || '|' || turn), 1, 8), conv_id, turn) AS rn, count(*) OVER (PARTITION BY env) AS total FROM st),
tk AS (SELECT conv_id, arg_min(text, turn) AS t FROM conversations WHERE role = 'user' GROUP BY conv_id)"""


@query("next_action", f"""WITH {STEP_SQL}, hs AS (SELECT *, array_to_string(list_filter(array_agg(act) OVER (PARTITION BY conv_id ORDER BY step ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), lambda v: v IS NOT NULL), ', ') AS hist FROM st),
s AS (SELECT * FROM hs WHERE n >= 2 AND {V.BELOW(V.U('step', 'conv_id', 'turn'), 0.35)}), j AS (SELECT s.*, q.j FROM s, range(4) q(j)),
pr AS (SELECT j.conv_id, j.env, j.turn, j.act, j.hist, j.j, o.act AS own, pl.act AS other FROM j LEFT JOIN st o ON j.j < 3 AND o.conv_id = j.conv_id AND o.step = 1 + (j.step + {V.IDX(V.U('own', 'j.conv_id', 'j.turn', 'j.j'), 'j.n - 1')}) % j.n
   JOIN pl ON pl.env = j.env AND pl.rn = 1 + {V.PLACE('pool', 'pl.total', 'j.conv_id', 'j.turn', 'j.j')}),
ca AS (SELECT conv_id, env, turn, act, hist, list_concat(list_filter(array_agg(own ORDER BY j), lambda v: v IS NOT NULL), array_agg(other ORDER BY j)) AS c FROM pr GROUP BY ALL),
cf AS (SELECT conv_id, env, turn, act, hist, list_filter(c, lambda v: v <> act) AS c FROM ca), cd AS (SELECT conv_id, env, turn, act, hist, list_filter(c, lambda v, i: list_position(c, v) = i)[1:4] AS c FROM cf),
op AS (SELECT *, {HASH_SORT("list_concat([act], c)", 'acts', "conv_id || '|' || turn")} AS o FROM cd)
SELECT op.conv_id, op.turn, md5('Environment: env' || env || '.' || chr(10) || 'Task:' || chr(10) || coalesce(CASE WHEN length(t) <= 1500 THEN t ELSE substr(t, 1, 1500) || ' ...' END, '') || chr(10) || chr(10) || 'Recent actions: ' || CASE WHEN hist = '' OR hist IS NULL THEN 'none' ELSE hist END || chr(10) || 'Latest observation:' || chr(10) || coalesce(ob.text, '')) AS context_md5,
  CAST(len(o) AS INTEGER) AS n_options, CAST(list_position(o, act) - 1 AS INTEGER) AS gold FROM op LEFT JOIN tk ON tk.conv_id = op.conv_id LEFT JOIN conversations ob ON ob.conv_id = op.conv_id AND ob.turn = op.turn - 1""")
def next_action(spark, base):
    """Steps of a trajectory -> which action comes next, with the first request as its task. Conversations fall in five environments."""
    conv = table(spark, base, "conversations")
    act = F.substring(F.split("text", "\n")[0], 1, 120)
    env = F.col("conv_id") % 5
    steps = conv.filter("role = 'assistant'").select("conv_id", env.alias("env"), "turn", act.alias("act"))
    # Several uses of the steps below: they are stored once, so the texts are read once.
    st = materialise(with_rank(steps, ["conv_id"], F.floor(F.col("turn") / 64), [F.col("turn")], "step", "n"))
    ca = C.next_actions(st, ["conv_id", "turn"], "conv_id", "env", "act", own=3, others=4, want=4, keep=chance(u8("step", "conv_id", "turn"), 0.35))
    ca = ca.withColumn("options", hash_sort(F.concat(F.array("act"), "candidates"), "acts", "conv_id", "turn"))
    obs = conv.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("obs"))
    task = conv.filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("task"))
    hist = F.when(F.size("history") == 0, "none").otherwise(F.array_join("history", ", "))
    shown = F.coalesce(X.clip(F.col("task"), 1500), F.lit(""))
    ctx = F.format_string("Environment: env%d.\nTask:\n%s\n\nRecent actions: %s\nLatest observation:\n%s", F.col("env"), shown, hist, F.coalesce("obs", F.lit("")))
    return ca.join(task, "conv_id", "left").join(obs, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", F.md5(ctx).alias("context_md5"), F.size("options").alias("n_options"), (F.array_position("options", F.col("act")) - 1).cast("int").alias("gold"))


@query("element_choice", f"""WITH o AS (SELECT o_orderkey, o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS step FROM orders),
h AS (SELECT *, array_to_string(list_filter(array_agg(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY step ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), lambda v: v IS NOT NULL), '; ') AS hist FROM o),
rn AS (SELECT n_regionkey, array_agg(n_name ORDER BY n_name) AS all_n FROM nation GROUP BY n_regionkey),
x AS (SELECT h.o_orderkey, coalesce(nullif(h.hist, ''), 'none') AS hist, n.n_name AS pos, {HASH_SORT('list_filter(rn.all_n, lambda v: v <> n.n_name)', 'neg', 'h.o_orderkey')}[1:5] AS neg FROM h JOIN customer ON c_custkey = h.o_custkey JOIN nation n ON n.n_nationkey = c_nationkey JOIN rn ON rn.n_regionkey = n.n_regionkey),
y AS (SELECT *, {HASH_SORT('list_concat([pos], neg)', 'elements', 'o_orderkey')} AS o FROM x)
SELECT o_orderkey, hist, array_to_string(o, '|') AS options, CAST(list_position(o, pos) - 1 AS INTEGER) AS gold FROM y""")
def element_choice(spark, base):
    """Orders of a customer as steps: the element to pick is the customer's nation among those of its region."""
    nation = table(spark, base, "nation")
    home = table(spark, base, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("pos"), "n_regionkey")
    o = table(spark, base, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate").join(home, "o_custkey")
    # a day's orders are cut by their keys, so a busy day is no single bucket
    place = F.struct(F.col("o_orderdate").alias("day"), F.floor(F.col("o_orderkey") / 65_536).alias("keys"))
    o = with_rank(o, ["o_custkey"], place, [F.col("o_orderdate"), F.col("o_orderkey")], "step")
    h = C.last_k(o, ["o_custkey"], "step", "o_orderpriority", 4)
    per_region = nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_set("n_name")).alias("all_n"))
    x = h.join(per_region, "n_regionkey")
    neg = F.slice(hash_sort(F.array_remove("all_n", F.col("pos")), "neg", "o_orderkey"), 1, 5)
    x = x.withColumn("options", hash_sort(F.concat(F.array("pos"), neg), "elements", "o_orderkey"))
    hist = F.when(F.size("history") == 0, "none").otherwise(F.array_join("history", "; "))
    return x.select("o_orderkey", hist.alias("hist"), F.array_join("options", "|").alias("options"), (F.array_position("options", F.col("pos")) - 1).cast("int").alias("gold"))


@query("element_desc", "SELECT page_id, substr('a title=' || substr(url, 1, 40) || ' name=page ' || page_id || ' type=link id=' || page_id, 1, 120) AS element FROM pages")
def element_desc(spark, base):
    attrs = F.to_json(F.struct(F.col("page_id").cast("string").alias("id"), F.lit("link").alias("type"), F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("name"), F.col("url").alias("title"), F.lit("").alias("alt")))
    return table(spark, base, "pages").select("page_id", C.element_desc(F.lit("a"), attrs).alias("element"))


@query("relevance_pairs", f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey * 10 + l_linenumber AS item, l_returnflag = 'R' AS sel FROM lineitem),
a AS (SELECT l_orderkey, min(CASE WHEN sel THEN item END) AS pos, arg_min(CASE WHEN NOT sel THEN item END, CASE WHEN NOT sel THEN {V.U('unselected', 'l_orderkey', 'item')} || lpad(CAST(item AS VARCHAR), 12, '0') END) AS neg FROM x GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN {V.BELOW(V.U('relevant', 'l_orderkey'), 0.5)} OR neg IS NULL THEN pos ELSE neg END AS item, CAST({V.BELOW(V.U('relevant', 'l_orderkey'), 0.5)} OR neg IS NULL AS INTEGER) AS gold FROM a WHERE pos IS NOT NULL""")
def relevance_pairs(spark, base):
    x = table(spark, base, "lineitem").select("l_orderkey", (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("item"), "l_returnflag")
    return C.pick_relevant(x, ["l_orderkey"], "item", F.col("l_returnflag") == "R")


@query("pos_neg_balance", f"""WITH c AS (SELECT least(count(*) FILTER (WHERE toxic = 1), 120 // 3) AS n FROM labels), r AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY {V.U('balance', 'doc_id')}, doc_id) AS rn FROM labels)
SELECT doc_id, toxic FROM r, c WHERE rn <= CASE WHEN toxic = 1 THEN n ELSE 2 * n END""")
def pos_neg_balance(spark, base):
    d = table(spark, base, "labels").select("doc_id", "toxic")
    n = d.agg(F.least(F.count_if(F.col("toxic") == 1), F.lit(120 // 3)).alias("n")).scalar()
    d = d.withColumn("n", n)
    return top_by_hash(d, ["toxic"], "doc_id", "balance", F.when(F.col("toxic") == 1, F.col("n")).otherwise(2 * F.col("n"))).select("doc_id", "toxic")


@query("annotator_mean", """SELECT l_partkey, CAST(least(4, greatest(0, round_even(avg(l_quantity / 8.0), 0))) AS INTEGER) AS amount, CAST(least(4, greatest(0, round_even(avg(round(l_discount * 100) / 2), 0))) AS INTEGER) AS discount,
  CAST(least(4, greatest(0, round_even(avg(CASE WHEN l_returnflag <> 'A' THEN round(l_tax * 100) END), 0))) AS INTEGER) AS tax FROM lineitem GROUP BY l_partkey HAVING count(CASE WHEN l_returnflag <> 'A' THEN 1 END) > 0""")
def annotator_mean(spark, base):
    attrs = {"amount": F.col("l_quantity") / 8.0, "discount": F.round(F.col("l_discount") * 100) / 2, "tax": F.when(F.col("l_returnflag") != "A", F.round(F.col("l_tax") * 100))}
    return C.annotator_mean(table(spark, base, "lineitem"), "l_partkey", attrs, 0, 4)


@query("evidence_join", """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, '[' || l_partkey || '] ' || l_returnflag AS e, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) AS rn FROM lineitem)
SELECT l_orderkey, array_to_string(array_agg(e ORDER BY rn), chr(10)) AS evidence FROM r WHERE rn <= 4 GROUP BY l_orderkey""")
def evidence_join(spark, base):
    """The first four evidence lines of every claim; the rank limit is applied before the shuffle as well."""
    e = F.format_string("[%d] %s", "l_partkey", "l_returnflag")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_returnflag")
    r = table(spark, base, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", e.alias("e")).withColumn("rn", F.row_number().over(w)).filter("rn <= 4")
    return r.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "e"))), lambda s: s["e"]), "\n").alias("evidence"))


@query("letter_choice_parse", f"""WITH rn AS (SELECT n_regionkey, array_agg(n_name ORDER BY n_name) AS o FROM nation GROUP BY n_regionkey),
x AS (SELECT c_custkey, n_name, o, {V.IDX(V.U('letters', 'c_custkey'), 4)} AS k FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN rn USING (n_regionkey))
SELECT c_custkey, CASE k WHEN 0 THEN 'letter' WHEN 1 THEN 'yesno' WHEN 2 THEN 'comma' ELSE 'rejected' END AS form, CASE k WHEN 1 THEN 'no|yes' WHEN 3 THEN NULL ELSE array_to_string(o, '|') END AS options,
  CAST(CASE k WHEN 0 THEN list_position(o, n_name) - 1 WHEN 2 THEN list_position(o, n_name) - 1 WHEN 1 THEN c_custkey % 2 END AS INTEGER) AS gold FROM x""")
def letter_choice_parse(spark, base):
    """Texts in four forms: lettered lines, yes/no, a comma list, and lettered lines with a letter that is not offered."""
    nation = table(spark, base, "nation")
    per = nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_set("n_name")).alias("o"))
    x = table(spark, base, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(per, "n_regionkey").withColumn("k", pick_index(u8("letters", "c_custkey"), 4))
    lines = F.array_join(F.transform("o", lambda v, i: F.concat(F.char(i + 65), F.lit(". "), v, F.lit("."))), "\n")
    pos = F.array_position("o", F.col("n_name")).cast("int")
    k = F.col("k")
    user = F.when(k.isin(0, 3), F.concat(F.lit("Question: Which nation?\nChoices:\n"), lines, F.lit("\nAnswer with the letter."))).when(k == 1, "Is the customer foreign?").otherwise(
        F.concat(F.lit("Which nation?\nOptions: "), F.array_join("o", ", "), F.lit(".")))
    ans = F.when(k == 0, F.concat(F.lit("Answer: "), F.char(pos + 64))).when(k == 3, "Answer: J").when(k == 1, F.when(F.col("c_custkey") % 2 == 1, "Yes.").otherwise("No, not at all")).otherwise(F.concat(F.lower("n_name"), F.lit(".")))
    x = x.select("c_custkey", k.alias("k"), user.alias("user"), ans.alias("ans"))
    _, lo, lg = C.letter_choice(F.col("user"), F.col("ans"))
    co, cg = C.comma_choice(F.col("user"), F.col("ans"))
    x = x.withColumn("lo", lo).withColumn("lg", lg).withColumn("co", co).withColumn("cg", cg).withColumn("yg", C.yes_no_gold(F.col("ans")))
    form = F.when(F.col("lg").isNotNull(), "letter").when((F.col("k") == 1) & F.col("yg").isNotNull(), "yesno").when(F.col("cg").isNotNull(), "comma").otherwise("rejected")
    x = x.withColumn("form", form)
    opts = F.when(F.col("form") == "letter", F.array_join("lo", "|")).when(F.col("form") == "comma", F.array_join("co", "|")).when(F.col("form") == "yesno", "no|yes")
    gold = F.when(F.col("form") == "letter", F.col("lg")).when(F.col("form") == "comma", F.col("cg")).when(F.col("form") == "yesno", F.col("yg"))
    return x.select("c_custkey", "form", opts.alias("options"), gold.cast("int").alias("gold"))


SITUATION = "situation string, question string, options array<string>, answer int, danger boolean, domain string"


@query("situation_convert", """WITH x AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
SELECT event_id, 0 AS qidx, CAST(k % 3 AS INTEGER) AS gold, 'Setting: ' || event_type || '.' || chr(10) || 'k is ' || k AS context FROM x
UNION ALL SELECT event_id, 1, CAST(k > 50 AS INTEGER), 'Setting: ' || event_type || '.' || chr(10) || 'k is ' || k FROM x WHERE k % 2 = 0""")
def situation_convert(spark, base):
    """JSON situation records -> one question, and a second one where a danger flag is given."""
    k = F.get_json_object("props", "$.k").cast("int")
    rec = F.to_json(F.struct(
        F.concat(F.lit("k is "), k.cast("string")).alias("situation"), F.lit("What now?").alias("question"), C.strings("wait", "act", "leave").alias("options"),
        (k % 3).alias("answer"), F.when(k % 2 == 0, k > 50).alias("danger"), F.col("event_type").alias("domain")))
    r = table(spark, base, "events").select("event_id", F.from_json(rec, SITUATION).alias("r")).filter(F.col("r.situation").isNotNull())
    qs = F.array_compact(F.array(
        C.question(F.col("r.question"), F.col("r.options"), F.col("r.answer")),
        F.when(F.col("r.danger").isNotNull(), C.question("Is the agent in immediate danger?", C.strings("no", "yes"), F.col("r.danger").cast("int")))))
    ctx = F.format_string("Setting: %s.\n%s", F.coalesce("r.domain", F.lit("")), F.col("r.situation"))
    return C.to_long(r.select("event_id", ctx.alias("context"), qs.alias("qs")), ["event_id", "context"]).select("event_id", "qidx", "gold", "context")


WORDINGS = "[" + ", ".join(f"'{w}'" for w in X.ABSTAIN_WORDINGS) + "]"


@query("abstain_detect", f"""WITH x AS (SELECT p_partkey, [p_name, p_type, CASE WHEN p_size % 3 = 0 THEN ' ' || upper({WORDINGS}[1 + {V.IDX(V.U('wording', 'p_partkey'), 12)}]) ELSE 'another ' || p_name END] AS o FROM part)
SELECT p_partkey, len(list_filter(o, lambda v: {V.ABSTAIN_SQL.format(o='v')})) > 0 AS abstain FROM x""")
def abstain_detect(spark, base):
    w = F.get(C.strings(*X.ABSTAIN_WORDINGS), pick_index(u8("wording", "p_partkey"), 12))
    o = F.array("p_name", "p_type", F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" "), F.upper(w))).otherwise(F.concat(F.lit("another "), "p_name")))
    return table(spark, base, "part").select("p_partkey", F.exists(o, X.is_abstain).alias("abstain"))


@query("is_scale", """SELECT p_partkey, p_size % 2 = 0 AS scale FROM part""")
def is_scale(spark, base):
    o = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("-1: low"), F.concat(F.col("p_size").cast("string"), F.lit(": "), "p_type"))).otherwise(F.array(F.lit("0: low"), "p_name"))
    return table(spark, base, "part").select("p_partkey", X.is_scale(o).alias("scale"))


@query("base_offset", "SELECT p_partkey, CAST(p_size - (SELECT min(p_size) FROM part) AS INTEGER) AS gold FROM part")
def base_offset(spark, base):
    p = table(spark, base, "part")
    return p.select("p_partkey", (F.col("p_size") - p.agg(F.min("p_size").alias("m")).scalar()).cast("int").alias("gold"))
