"""Augmentation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from adjudica.functions import text as X
from adjudica.functions.hashing import chance, pick_index, u8
from adjudica.operators import augment as A
from adjudica.operators import convert as C
from adjudica.operators import sampling as S
from adjudica.plans import views as V
from adjudica.plans.q_convert import HASH_SORT, labelled
from adjudica.plans.registry import query
from adjudica.sources.tables import spread, table

WORDINGS = "[" + ", ".join(f"'{w}'" for w in X.ABSTAIN_WORDINGS) + "]"
PRIORITIES = ("1: urgent", "2: high", "3: medium", "4: not specified", "5: low")
Q_NATION, Q_PART, Q_URGENT = "Which nation is the customer from?", "Which type fits the part?", "How urgent is the order?"


def nation_options(spark, base):
    return table(spark, base, "nation").agg(F.array_sort(F.collect_list("n_name")).alias("o")).scalar()


def questions_long(spark, base):
    """Long form over three sources: fixed option lists (customers, orders) and changing ones (parts)."""
    cust = table(spark, base, "customer").join(table(spark, base, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("options", nation_options(spark, base))
    cust = cust.select(F.lit("customers").alias("task"), F.lit("train").alias("split"), F.lit(Q_NATION).alias("text"), "options", (F.array_position("options", F.col("n_name")) - 1).cast("int").alias("gold"))
    part = table(spark, base, "part").select(F.lit("parts").alias("task"), F.lit("train").alias("split"), F.lit(Q_PART).alias("text"), F.array("p_type", "p_brand", "p_name").alias("options"), F.lit(0).alias("gold"))
    orders = table(spark, base, "orders").select(F.lit("orders").alias("task"), F.lit("eval").alias("split"), F.lit(Q_URGENT).alias("text"), C.strings(*PRIORITIES).alias("options"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("gold"))
    return cust.unionByName(part).unionByName(orders)


LONG_CTE = f"""nat AS (SELECT array_agg(n_name ORDER BY n_name) AS o FROM nation),
lq AS (SELECT 'customers' AS task, 'train' AS split, '{Q_NATION}' AS text, nat.o AS options FROM customer, nat UNION ALL SELECT 'parts', 'train', '{Q_PART}', [p_type, p_brand, p_name] FROM part
  UNION ALL SELECT 'orders', 'eval', '{Q_URGENT}', {list(PRIORITIES)!r} FROM orders)"""


@query("fixed_label_sets", f"""WITH {LONG_CTE}, l AS (SELECT task, text, split, options, count(*) AS n FROM lq GROUP BY ALL), p AS (SELECT task, text, split, max(n) AS top, sum(n) AS total, arg_max(options, n) AS options FROM l GROUP BY ALL)
SELECT task, text, split, CAST(total AS BIGINT) AS n, array_to_string(options, '|') AS options FROM p WHERE top / total > 0.98 AND total >= 50""")
def fixed_label_sets(spark, base):
    s = A.fixed_label_sets(questions_long(spark, base))
    return s.select("task", "text", "split", "n", F.array_join("options", "|").alias("options"))


@query("label_pool", f"""WITH {LONG_CTE}, d AS (SELECT DISTINCT task, unnest(options) AS label FROM lq WHERE len(options) BETWEEN 3 AND 60)
SELECT task, count(*) AS n, array_to_string(array_agg(label ORDER BY label), '|') AS labels FROM d GROUP BY task HAVING count(*) BETWEEN 3 AND 200""")
def label_pool(spark, base):
    return A.label_pool(questions_long(spark, base)).select("task", "n", F.array_join("labels", "|").alias("labels"))


CUST_CTE = """nat AS (SELECT list_append(array_agg(n_name ORDER BY n_name), 'None of these') AS o FROM nation), cu AS (SELECT c_custkey, o, list_position(o, n_name) - 1 AS gold FROM customer JOIN nation ON c_nationkey = n_nationkey, nat)"""


def customers(spark, base):
    """Customers with the whole list of nations and an abstain option."""
    c = spread(table(spark, base, "customer")).join(table(spark, base, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("o", F.array_append(nation_options(spark, base), F.lit("None of these")))
    return c.select("c_custkey", "o", (F.array_position("o", F.col("n_name")) - 1).cast("int").alias("gold"))


def NARROW(cap: int) -> str:
    forced = f"(i - 1 = gold OR {V.ABSTAIN_SQL.format(o='v')})"
    u = "substr(md5('7|narrow|' || c_custkey || '|' || v), 1, 8)"
    return f"""tg AS (SELECT c_custkey, gold, list_sort(list_transform(o, lambda v, i: {{'free': CASE WHEN {forced} THEN 0 ELSE 1 END, 'u': {u}, 'i': i - 1, 'o': v}})) AS t FROM cu),
kp AS (SELECT c_custkey, gold, list_sort(list_transform(t[1:{cap}], lambda s: {{'i': s.i, 'o': s.o}})) AS k FROM tg)"""


@query("narrow_options", f"""WITH {CUST_CTE}, {NARROW(10)} SELECT c_custkey, array_to_string(list_transform(k, lambda s: s.o), '|') AS options, CAST(list_position(list_transform(k, lambda s: s.i), gold) - 1 AS INTEGER) AS gold FROM kp""")
def narrow_options(spark, base):
    c = customers(spark, base)
    o, g = A.narrow(F.col("o"), F.col("gold"), 10, "c_custkey")
    return c.select("c_custkey", F.array_join(o, "|").alias("options"), g.alias("gold"))


@query("wide_options", f"""WITH {CUST_CTE} SELECT c_custkey, array_to_string(o, '|') AS options, CAST(gold AS INTEGER) AS gold FROM cu""")
def wide_options(spark, base):
    c = customers(spark, base)
    o, g = A.narrow(F.col("o"), F.col("gold"), A.MAX_OPTIONS, "c_custkey")
    return c.select("c_custkey", F.array_join(o, "|").alias("options"), g.alias("gold"))


NPAD = f"CASE WHEN {V.BELOW(V.U('npad_kind', 'c_custkey'), 0.25)} THEN 100 + {V.IDX(V.U('npad_size', 'c_custkey'), 151)} ELSE floor(power(2.0, CAST('0x' || {V.U('npad_size', 'c_custkey')} AS BIGINT) / 4294967296.0 * 7.9)) END"


@query("pad_options", f"""WITH sg AS (SELECT array_agg(s ORDER BY s) AS o FROM (SELECT DISTINCT c_mktsegment AS s FROM customer)),
op AS (SELECT 'n_name' AS task, n_name AS v FROM nation UNION SELECT 'p_type', p_type FROM part UNION SELECT 'p_name', p_name FROM part), ot AS (SELECT DISTINCT v FROM op WHERE task IN (SELECT task FROM op GROUP BY task HAVING count(*) >= 4)),
pl AS (SELECT array_agg(v ORDER BY substr(md5('7|pool_order|segment|' || v), 1, 8), v) AS p FROM ot), x AS (SELECT c_custkey, c_mktsegment, sg.o, {V.PLACE('pad', 'len(pl.p)', 'c_custkey')} AS st, {NPAD} AS m FROM customer, sg, pl),
w AS (SELECT x.*, CAST(m AS BIGINT) + len(o) AS need, len(p) AS n, list_concat(p[st + 1:st + CAST(m AS BIGINT) + len(o)], p[1:greatest(0, least(CAST(m AS BIGINT) + len(o), len(p)) - (len(p) - st))]) AS nx FROM x, pl),
y AS (SELECT c_custkey, c_mktsegment, list_concat(o, list_filter(nx, lambda v: NOT list_contains(list_transform(o, lambda w: lower(w)), lower(v)))[1:CAST(least(m, 255 - len(o)) AS BIGINT)]) AS q FROM w)
SELECT c_custkey, CAST(len(q) AS INTEGER) AS n_options, CAST(list_position(q, c_mktsegment) - 1 AS INTEGER) AS gold, md5(array_to_string(q, '|')) AS options_md5 FROM y""")
def pad_options(spark, base):
    """Market segments padded with labels of other families (nations, part names and types)."""
    c, n, p = (table(spark, base, t) for t in ("customer", "nation", "part"))
    fam = lambda d, name, col: d.select(F.lit(col).alias("task"), F.lit(name).alias("family"), F.col(col).alias("label")).distinct()
    pool = fam(c, "segment", "c_mktsegment").unionByName(fam(n, "place", "n_name")).unionByName(fam(p, "part", "p_type")).unionByName(fam(p, "part", "p_name"))
    segments = c.select("c_mktsegment").distinct().agg(F.array_sort(F.collect_list("c_mktsegment")).alias("o")).scalar()
    d = c.select("c_custkey", "c_mktsegment", F.lit("segment").alias("family")).withColumn("o", segments)
    d = A.pad(d, "c_custkey", "family", "o", A.pad_count("c_custkey"), A.family_pools(pool, ["segment"]), "q")
    return d.select("c_custkey", F.size("q").alias("n_options"), (F.array_position("q", F.col("c_mktsegment")) - 1).cast("int").alias("gold"), F.md5(F.array_join("q", "|")).alias("options_md5"))


DESC_CTE = """ds AS (SELECT array_agg({'label': s, 'what': w, 'not_for': 'anything but ' || lower(s)} ORDER BY s) AS d FROM (SELECT s, CASE WHEN s = 'FURNITURE' THEN NULL ELSE 'Firms in ' || lower(s) || ', ' || n || ' of them' END AS w
  FROM (SELECT c_mktsegment AS s, count(*) AS n FROM customer GROUP BY 1)))"""


def DESCRIBE(key: str, mode: str) -> str:
    style = V.IDX(V.U("style", key), 3)
    nm = f"CASE WHEN {mode} LIKE 'opaque%' THEN CASE {style} WHEN 0 THEN 'c' || i WHEN 1 THEN 'option_' || i ELSE 'route_' || lpad(CAST(i AS VARCHAR), 2, '0') END ELSE x.label END"
    bare = f"(substr(md5('7|bare|' || {key} || '|' || x.label), 1, 8) < '{int(0.12 * 2**32):08x}')"
    prose = f"CASE {style} WHEN 0 THEN x.what WHEN 1 THEN x.what || ' Not for: ' || x.not_for ELSE x.what || ' (not: ' || x.not_for || ')' END"
    rub = "CAST(to_json({'what': x.what, 'not_for': x.not_for}) AS VARCHAR)"
    return f"""list_transform(d, lambda x, i: CASE WHEN {mode} = 'plain' THEN x.label WHEN x.what IS NULL THEN CASE WHEN {mode} LIKE 'opaque%' THEN {nm} || ': ' || x.label ELSE x.label END
      WHEN {mode} NOT LIKE 'opaque%' AND {bare} THEN {nm} ELSE {nm} || ': ' || CASE WHEN {mode} LIKE '%json' THEN {rub} ELSE {prose} END END)"""


def descriptions(spark, base):
    s = table(spark, base, "customer").groupBy(F.col("c_mktsegment").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    what = F.when(F.col("label") != "FURNITURE", F.format_string("Firms in %s, %d of them", F.lower("label"), F.col("n")))
    rows = s.select("label", what.alias("what"), F.concat(F.lit("anything but "), F.lower("label")).alias("not_for"))
    return rows.agg(F.array_sort(F.collect_list(F.struct("label", "what", "not_for"))).alias("d")).scalar()


MODE_LIST = ("named", "opaque", "named_json", "opaque_json")


@query("describe_options", f"""WITH {DESC_CTE}, x AS (SELECT c_custkey, d, {list(MODE_LIST)!r}[1 + {V.IDX(V.U('mode', 'c_custkey'), 4)}] AS mode FROM customer, ds)
SELECT c_custkey, mode, array_to_string({DESCRIBE('c_custkey', 'mode')}, '|') AS options FROM x""")
def describe_options(spark, base):
    mode = F.get(C.strings(*MODE_LIST), pick_index(u8("mode", "c_custkey"), 4))
    d = table(spark, base, "customer").select("c_custkey", mode.alias("mode")).withColumn("d", descriptions(spark, base))
    return d.select("c_custkey", "mode", F.array_join(A.describe(F.col("d"), F.col("mode"), "c_custkey"), "|").alias("options"))


KEY_SETS = (("covers", "leaves_out", "like"), ("meaning", "not_this", "cases"), ("use_for", "avoid_for", "seen"))
NAMINGS = ("c%d", "opt-%d", "#%d", "key_%03d")
RUBRIC_CTE = f"""{DESC_CTE}, ex AS (SELECT c_mktsegment AS label, c_name, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {V.U('exemplar', 'c_name')}, c_name) AS rn FROM customer),
el AS (SELECT label, array_agg(c_name ORDER BY rn) AS examples FROM ex WHERE rn <= 4 GROUP BY label), op AS (SELECT unnest(d) AS x FROM ds), ox AS (SELECT x.label AS label, x.what AS what, x.not_for AS not_for, examples, row_number() OVER (ORDER BY x.label) AS i FROM op JOIN el ON el.label = x.label),
rb AS (SELECT c_custkey, i, label, what, {V.IDX(V.U('key_set', 'c_custkey'), 3)} AS ks, {V.IDX(V.U('naming', 'c_custkey'), 4)} AS nm, CASE WHEN {V.BELOW(V.U('with_limits', 'c_custkey', 'label'), 0.6)} THEN not_for END AS lim,
  CASE WHEN {V.BELOW(V.U('with_examples', 'c_custkey', 'label'), 0.5)} THEN list_filter(examples, lambda e: e <> c_name)[1:1 + {V.IDX(V.U('n_examples', 'c_custkey', 'label'), 3)}] END AS exs FROM customer, ox)"""


@query("describe_with_examples", f"""WITH {RUBRIC_CTE}, rd AS (SELECT c_custkey, i, CASE nm WHEN 0 THEN 'c' || i WHEN 1 THEN 'opt-' || i WHEN 2 THEN '#' || i ELSE 'key_' || lpad(CAST(i AS VARCHAR), 3, '0') END || ': ' || CASE WHEN what IS NULL THEN label
  WHEN lim IS NULL AND (exs IS NULL OR len(exs) = 0) AND {V.BELOW(V.U('plain_rubric', 'c_custkey', 'label'), 0.3)} THEN what
  ELSE '{{"' || ['covers', 'meaning', 'use_for'][ks + 1] || '":' || CAST(to_json(what) AS VARCHAR) || CASE WHEN lim IS NULL THEN '' ELSE ',"' || ['leaves_out', 'not_this', 'avoid_for'][ks + 1] || '":' || CAST(to_json(lim) AS VARCHAR) END
    || CASE WHEN exs IS NULL OR len(exs) = 0 THEN '' ELSE ',"' || ['like', 'cases', 'seen'][ks + 1] || '":' || CAST(to_json(exs) AS VARCHAR) END || '}}' END AS o FROM rb)
SELECT c_custkey, array_to_string(array_agg(o ORDER BY i), '|') AS options FROM rd GROUP BY c_custkey""")
def describe_with_examples(spark, base):
    """Segments as rubrics with the names of other customers as examples."""
    from adjudica.operators.sampling import exemplars

    c = table(spark, base, "customer").select("c_custkey", "c_name", F.col("c_mktsegment").alias("label"))
    ex = exemplars(c.select("label", "c_name"), ["label"], "c_name", 4)
    d = c.select("label").distinct().withColumn("d", descriptions(spark, base)).select("label", F.element_at(F.filter("d", lambda x: x["label"] == F.col("label")), 1).alias("x"))
    opts = d.join(ex, "label").agg(F.array_sort(F.collect_list(F.struct("label", "x.what", "x.not_for", F.col("exemplars").alias("examples")))).alias("o")).scalar()
    r = c.select("c_custkey", "c_name").withColumn("o", opts)
    return r.select("c_custkey", F.array_join(A.rubric(F.col("o"), F.col("c_name"), KEY_SETS, NAMINGS, "c_custkey"), "|").alias("options"))


@query("mode_grid", f"""WITH {DESC_CTE}, r AS (SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY {V.U('mode_grid', 's_suppkey')}, s_suppkey) AS rn FROM supplier),
x AS (SELECT s_suppkey, d, m.mode FROM r, ds, (SELECT unnest(['plain', 'named', 'opaque', 'opaque_json']) AS mode) m WHERE rn <= 400)
SELECT s_suppkey, mode, array_to_string({DESCRIBE('s_suppkey', 'mode')}, '|') AS options FROM x""")
def mode_grid(spark, base):
    """Up to 400 probe rows per task, each in four renderings."""
    from adjudica.operators.ranking import top_by_hash

    s = top_by_hash(table(spark, base, "supplier").select("s_suppkey", "s_nationkey"), ["s_nationkey"], "s_suppkey", "mode_grid", 400)
    s = s.withColumn("mode", F.explode(C.strings("plain", "named", "opaque", "opaque_json"))).withColumn("d", descriptions(spark, base))
    return s.select("s_suppkey", "mode", F.array_join(A.describe(F.col("d"), F.col("mode"), "s_suppkey"), "|").alias("options"))


SHAPES = ("list", "list", "dict", "array", "nested")


@query("json_state", f"""WITH RECURSIVE r AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY {V.U('json', 'doc_id')}, doc_id) - 1 AS r FROM documents), g AS MATERIALIZED (SELECT source, r // 6 AS grp, r % 6 AS pos, doc_id, text, length(text) AS len FROM r),
f AS (SELECT source, grp, pos, doc_id, text, len AS chars, 1 AS n, 0 AS part FROM g WHERE pos = 0
  UNION ALL SELECT g.source, g.grp, g.pos, g.doc_id, g.text, CASE WHEN f.n >= 2 AND f.chars + g.len > 3000 THEN g.len ELSE f.chars + g.len END, CASE WHEN f.n >= 2 AND f.chars + g.len > 3000 THEN 1 ELSE f.n + 1 END,
    CASE WHEN f.n >= 2 AND f.chars + g.len > 3000 THEN f.part + 1 ELSE f.part END FROM f JOIN g ON g.source = f.source AND g.grp = f.grp AND g.pos = f.pos + 1),
a AS (SELECT source, grp, part, array_agg(text ORDER BY pos) AS t, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY pos) AS ids FROM f GROUP BY source, grp, part),
s AS (SELECT *, {list(SHAPES)!r}[1 + {V.IDX(V.U('shape', 'source', 'grp', 'part'), 5)}] AS shape, {V.IDX(V.U('path', 'source', 'grp', 'part'), 'len(t)')} AS j, {V.IDX(V.U('form', 'source', 'grp', 'part'), 3)} AS form FROM a),
l AS (SELECT *, CASE shape WHEN 'array' THEN CAST(to_json(t) AS VARCHAR) WHEN 'dict' THEN '{{"items":{{' || array_to_string(list_transform(t, lambda v, i: '"r' || i || '":' || CAST(to_json({{'text': v}}) AS VARCHAR)), ',') || '}}}}'
   WHEN 'nested' THEN CAST(to_json({{'case': {{'records': list_transform(t, lambda v, i: {{'id': i, 'text': v}})}}, 'note': 'imported'}}) AS VARCHAR) ELSE CAST(to_json({{'records': list_transform(t, lambda v, i: {{'id': i, 'text': v}})}}) AS VARCHAR) END AS state,
   '`' || CASE shape WHEN 'array' THEN '[' || j || ']' WHEN 'dict' THEN 'items.r' || (j + 1) || '.text' WHEN 'nested' THEN 'case.records[' || j || '].text' ELSE 'records[' || j || '].text' END || '`' AS p FROM s)
SELECT source, grp, part, ids, md5(state) AS state_md5, CASE form WHEN 0 THEN 'Is it toxic? (about ' || p || ')' WHEN 1 THEN 'For ' || p || ': Is it toxic?' ELSE p || ' - Is it toxic?' END AS question FROM l""")
def json_state(spark, base):
    d = table(spark, base, "documents").select("source", "doc_id", "text")
    g = A.json_groups(d, ["source"], "doc_id", "text", 6, 3000)
    shape = F.get(C.strings(*SHAPES), pick_index(u8("shape", "source", "grp", "part"), len(SHAPES)))
    g = g.withColumn("shape", shape)
    state, paths = A.json_state(F.col("recs"), F.col("shape"))
    path = F.get(paths, pick_index(u8("path", "source", "grp", "part"), F.size("recs")))
    ask = A.path_question(F.lit("Is it toxic?"), path, pick_index(u8("form", "source", "grp", "part"), 3))
    ids = F.array_join(F.transform("recs", lambda r: r["key"].cast("string")), ",")
    return g.select("source", "grp", "part", ids.alias("ids"), F.md5(state).alias("state_md5"), ask.alias("question"))


CONTAINERS, FIELDS, CHANNELS = ("cases", "rows", "mails"), ("text", "body"), ("mail", "web", "phone")
FORMS = ("%s (about %s)", "%2$s - %1$s", "For %2$s: %1$s", "%s Judge only %s.")
MIX_SQL = f"""r AS (SELECT doc_id, lang, n_chars, text, row_number() OVER (ORDER BY {V.U('json', 'doc_id')}, doc_id) - 1 AS r FROM documents), g AS MATERIALIZED (SELECT r // 5 AS grp, r % 5 AS pos, doc_id, lang, n_chars, text, length(text) AS len FROM r),
f AS (SELECT grp, pos, doc_id, len AS chars, 1 AS n, 0 AS part FROM g WHERE pos = 0
  UNION ALL SELECT g.grp, g.pos, g.doc_id, CASE WHEN f.n >= 2 AND f.chars + g.len > 4000 THEN g.len ELSE f.chars + g.len END, CASE WHEN f.n >= 2 AND f.chars + g.len > 4000 THEN 1 ELSE f.n + 1 END,
    CASE WHEN f.n >= 2 AND f.chars + g.len > 4000 THEN f.part + 1 ELSE f.part END FROM f JOIN g ON g.grp = f.grp AND g.pos = f.pos + 1),
m AS (SELECT f.grp, f.part, row_number() OVER (PARTITION BY f.grp, f.part ORDER BY f.pos) - 1 AS i, g.doc_id, g.lang, g.n_chars, g.text FROM f JOIN g ON g.grp = f.grp AND g.pos = f.pos),
s AS (SELECT DISTINCT grp, part, {list(SHAPES)!r}[1 + {V.IDX(V.U('mix_shape', 'grp', 'part'), 5)}] AS shape, {list(CONTAINERS)!r}[1 + {V.IDX(V.U('mix_cont', 'grp', 'part'), 3)}] AS cont, {list(FIELDS)!r}[1 + {V.IDX(V.U('mix_field', 'grp', 'part'), 2)}] AS fld FROM m),
o AS (SELECT m.*, s.shape, s.cont, s.fld, '{{' || CASE WHEN {V.BELOW(V.U('noise_id', 'doc_id'), 0.6)} THEN '"id":"r' || (i + 1) || '",' ELSE '' END || CASE WHEN {V.BELOW(V.U('noise_ts', 'doc_id'), 0.3)} THEN '"day":"' || strftime(DATE '2024-01-01' + CAST({V.IDX(V.U('noise_day', 'doc_id'), 365)} AS INTEGER), '%Y-%m-%d') || '",' ELSE '' END
  || CASE WHEN {V.BELOW(V.U('noise_channel', 'doc_id'), 0.25)} THEN '"channel":"' || {list(CHANNELS)!r}[1 + {V.IDX(V.U('channel', 'doc_id'), 3)}] || '",' ELSE '' END || '"' || fld || '":' || CAST(to_json(text) AS VARCHAR) || '}}' AS obj,
  CASE WHEN shape = 'array' THEN '[' || i || ']' ELSE CASE WHEN shape = 'nested' THEN 'batch.' ELSE '' END || cont || CASE WHEN shape = 'dict' THEN '.x' || (i + 1) ELSE '[' || i || ']' END || '.' || fld END AS path,
  CASE WHEN doc_id % 2 = 0 THEN 'Which language is it?' ELSE 'Is it long?' END AS ask, CASE WHEN doc_id % 2 = 0 THEN list_position(['de', 'en', 'es', 'fr'], lang) - 1 ELSE CAST(n_chars > 1000 AS INTEGER) END AS gold FROM m JOIN s ON s.grp = m.grp AND s.part = m.part),
t AS (SELECT grp, part, any_value(shape) AS shape, any_value(cont) AS cont, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY i) AS ids, '[' || string_agg(obj, ',' ORDER BY i) || ']' AS lst, '{{' || string_agg('"x' || (i + 1) || '":' || obj, ',' ORDER BY i) || '}}' AS dict, '[' || string_agg(CAST(to_json(text) AS VARCHAR), ',' ORDER BY i) || ']' AS arr FROM o GROUP BY grp, part),
q AS (SELECT grp, part, i, gold, doc_id, row_number() OVER (PARTITION BY grp, part ORDER BY {V.U('path_q', 'grp', 'part', 'doc_id')}, i) AS k, CASE {V.IDX(V.U('form', 'grp', 'part', 'doc_id'), 4)} WHEN 0 THEN ask || ' (about `' || path || '`)' WHEN 1 THEN '`' || path || '` - ' || ask WHEN 2 THEN 'For `' || path || '`: ' || ask ELSE ask || ' Judge only `' || path || '`.' END AS said FROM o),
qa AS (SELECT grp, part, string_agg(said, '|' ORDER BY k) AS questions, string_agg(CAST(gold AS VARCHAR), ',' ORDER BY k) AS golds FROM q WHERE k <= 3 GROUP BY grp, part)"""


@query("json_state_mixed", f"""WITH RECURSIVE {MIX_SQL}
SELECT t.grp, t.part, ids, md5(CASE shape WHEN 'array' THEN arr WHEN 'dict' THEN '{{"' || cont || '":' || dict || '}}' WHEN 'nested' THEN '{{"batch":{{"' || cont || '":' || lst || '}},"note":"imported"}}' ELSE '{{"' || cont || '":' || lst || '}}' END) AS state_md5, questions, golds FROM t JOIN qa ON qa.grp = t.grp AND qa.part = t.part""")
def json_state_mixed(spark, base):
    """Documents of two tasks share a state with noise fields; up to three questions name their record by its path."""
    even = F.col("doc_id") % 2 == 0
    langs = C.strings("de", "en", "es", "fr")
    gold = F.when(even, F.array_position(langs, F.col("lang")) - 1).otherwise((F.col("n_chars") > 1000).cast("int")).cast("int")
    d = table(spark, base, "documents").select("doc_id", "text", F.when(even, "Which language is it?").otherwise("Is it long?").alias("ask"), F.when(even, langs).otherwise(C.strings("no", "yes")).alias("options"), gold.alias("gold"))
    g = A.json_groups(d, [], "doc_id", "text", 5, 4000, carry=("ask", "options", "gold"))
    pick = lambda values, purpose: F.get(C.strings(*values), pick_index(u8(purpose, "grp", "part"), len(values)))
    g = g.withColumn("shape", pick(SHAPES, "mix_shape")).withColumn("cont", pick(CONTAINERS, "mix_cont")).withColumn("fld", pick(FIELDS, "mix_field"))
    state, paths = A.mixed_state(F.col("recs"), F.col("shape"), F.col("cont"), F.col("fld"), CONTAINERS, FIELDS, CHANNELS)
    g = g.withColumn("state", state).withColumn("paths", paths)
    g = g.withColumn("qs", A.path_questions(F.col("recs"), F.col("paths"), 3, FORMS, "grp", "part"))
    ids = F.array_join(F.transform("recs", lambda r: r["key"].cast("string")), ",")
    return g.select("grp", "part", ids.alias("ids"), F.md5("state").alias("state_md5"), F.array_join(F.transform("qs", lambda q: q["text"]), "|").alias("questions"), F.array_join(F.transform("qs", lambda q: q["gold"].cast("string")), ",").alias("golds"))


@query("json_wrap", f"""WITH x AS (SELECT doc_id, CAST(to_json({{'id': doc_id, 'lang': lang, 'text': text}}) AS VARCHAR) AS s, {V.BELOW(V.U('outer', 'doc_id'), 0.5)} AS o FROM documents)
SELECT doc_id, md5(CASE WHEN o THEN '{{"request":' || s || '}}' ELSE s END) AS state_md5 FROM x""")
def json_wrap(spark, base):
    rec = F.struct(F.col("doc_id").alias("id"), "lang", "text")
    s = F.when(chance(u8("outer", "doc_id"), 0.5), F.to_json(F.struct(rec.alias("request")))).otherwise(F.to_json(rec))
    return table(spark, base, "documents").select("doc_id", F.md5(s).alias("state_md5"))


@query("index_arrays", """WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents)
SELECT doc_id, CAST(len(w) AS INTEGER) AS n, md5(CASE WHEN len(w) >= 8 THEN CAST(to_json(list_transform(w, lambda v, i: {'_index': i - 1, 'value': v})) AS VARCHAR) ELSE CAST(to_json(w) AS VARCHAR) END) AS state_md5 FROM x""")
def index_arrays(spark, base):
    w = F.split("text", "\n")
    return table(spark, base, "documents").select("doc_id", F.size(w).alias("n"), F.md5(A.index_array(w)).alias("state_md5"))


@query("index_arrays_deep", """WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents)
SELECT doc_id, md5(CAST(CASE WHEN len(w) >= 8 THEN to_json({'doc': {'id': doc_id, 'lines': list_transform(w, lambda v, i: {'_index': i - 1, 't': v})}}) ELSE to_json({'doc': {'id': doc_id, 'lines': list_transform(w, lambda v, i: {'t': v})}}) END AS VARCHAR)) AS state_md5 FROM x""")
def index_arrays_deep(spark, base):
    """JSON of unknown shape, annotated at every level."""
    lines = F.transform(F.split("text", "\n"), lambda v: F.struct(v.alias("t")))
    d = table(spark, base, "documents").select("doc_id", F.to_json(F.struct(F.struct(F.col("doc_id").alias("id"), lines.alias("lines")).alias("doc"))).alias("state"))
    return A.index_json(d, "state").select("doc_id", F.md5("state").alias("state_md5"))


SEG = f"""sg AS (SELECT array_agg(s ORDER BY s) AS o FROM (SELECT DISTINCT c_mktsegment AS s FROM customer)),
pools(task, label) AS (SELECT DISTINCT 'segment', c_mktsegment FROM customer UNION ALL SELECT DISTINCT 'type', p_type FROM part UNION ALL SELECT DISTINCT 'brand', p_brand FROM part UNION ALL SELECT 'nation', n_name FROM nation),
rings AS (SELECT task, array_agg(label ORDER BY {V.U('foreign_order', 'task', 'label')}, label) AS f, count(*) AS n FROM pools GROUP BY task),
seg AS (SELECT c_custkey, c_mktsegment, o, list_transform(range(least(len(o), n)), lambda i: f[1 + ({V.PLACE('foreign', 'n', 'c_custkey')} + i) % n]) AS f, {WORDINGS}[1 + {V.IDX(V.U('wording', 'c_custkey'), 12)}] AS w
  FROM customer, sg, rings WHERE rings.task = ['brand', 'nation', 'type'][1 + {V.IDX(V.U('other_task', 'c_custkey'), 3)}])"""


@query("abstain_augment", f"""WITH {SEG}, x AS (SELECT *, CASE WHEN NOT {V.BELOW(V.U('abstain', 'c_custkey'), 0.5)} THEN 'keep' WHEN {V.BELOW(V.U('abstain_replace', 'c_custkey'), 0.25)} THEN 'replace' ELSE 'append' END AS kind FROM seg),
y AS (SELECT c_custkey, c_mktsegment, kind, CASE kind WHEN 'keep' THEN o WHEN 'append' THEN list_append(o, w) ELSE list_append(f, w) END AS q, o FROM x)
SELECT c_custkey, kind, array_to_string(q, '|') AS options, CAST(CASE kind WHEN 'replace' THEN len(q) - 1 ELSE list_position(o, c_mktsegment) - 1 END AS INTEGER) AS gold FROM y""")
def abstain_augment(spark, base):
    d = foreign_segments(spark, base)
    o, g, k = A.abstain_options(F.col("o"), F.col("gold"), F.col("f"), 0.5, 0.25, "c_custkey")
    return d.select("c_custkey", k.alias("kind"), F.array_join(o, "|").alias("options"), g.alias("gold"))


@query("offtopic_probe", f"""WITH {SEG}, x AS (SELECT *, {V.BELOW(V.U('offtopic', 'c_custkey'), 0.5)} AS off FROM seg)
SELECT c_custkey, array_to_string(list_append(CASE WHEN off THEN f ELSE o END, w), '|') AS options, CAST(CASE WHEN off THEN len(f) ELSE list_position(o, c_mktsegment) - 1 END AS INTEGER) AS gold FROM x""")
def offtopic_probe(spark, base):
    d = foreign_segments(spark, base)
    o, g = A.offtopic_probe(F.col("o"), F.col("gold"), F.col("f"), "c_custkey")
    return d.select("c_custkey", F.array_join(o, "|").alias("options"), g.alias("gold"))


def segments(spark, base):
    c = table(spark, base, "customer")
    o = c.select("c_mktsegment").distinct().agg(F.array_sort(F.collect_list("c_mktsegment")).alias("o")).scalar()
    return c.select("c_custkey", "c_mktsegment").withColumn("o", o).withColumn("gold", (F.array_position("o", F.col("c_mktsegment")) - 1).cast("int"))


def foreign_segments(spark, base):
    """Segment questions with labels of one of three other tasks."""
    c, p, n = (table(spark, base, t) for t in ("customer", "part", "nation"))
    pool = lambda task, d, label: d.select(F.lit(task).alias("task"), F.col(label).alias("label")).distinct()
    pools = pool("segment", c, "c_mktsegment").unionByName(pool("type", p, "p_type")).unionByName(pool("brand", p, "p_brand")).unionByName(pool("nation", n, "n_name"))
    return A.foreign_labels(segments(spark, base), "c_custkey", F.lit("segment"), F.size("o"), pools, "f")


@query("abstain_probe", f"""WITH {SEG}, x AS (SELECT c_custkey, c_mktsegment, o, {V.BELOW(V.U('abstain_probe', 'c_custkey'), 0.5)} AS gone FROM customer, sg),
y AS (SELECT c_custkey, c_mktsegment, gone, list_append(CASE WHEN gone THEN list_filter(o, lambda v: v <> c_mktsegment) ELSE o END, 'none of the above') AS q FROM x)
SELECT c_custkey, array_to_string(q, '|') AS options, CAST(CASE WHEN gone THEN len(q) - 1 ELSE list_position(q, c_mktsegment) - 1 END AS INTEGER) AS gold FROM y""")
def abstain_probe(spark, base):
    d = segments(spark, base)
    o, g = A.abstain_probe(F.col("o"), F.col("gold"), "c_custkey")
    return d.select("c_custkey", F.array_join(o, "|").alias("options"), g.alias("gold"))


@query("question_subset", f"""WITH x AS (SELECT doc_id, list_transform(list_sort(list_transform([0, 1, 2], lambda i: {{'u': substr(md5('7|subset|' || doc_id || '|' || i), 1, 8), 'i': i}})), lambda s: s.i) AS r,
  CASE WHEN {V.BELOW(V.U('subset_one', 'doc_id'), 0.6)} THEN 1 ELSE 1 + {V.IDX(V.U('subset_n', 'doc_id'), 3)} END AS n FROM labels)
SELECT doc_id, array_to_string(list_transform(list_sort(r[1:n]), lambda i: ['toxic', 'quality', 'lang'][i + 1]), '|') AS questions FROM x""")
def question_subset(spark, base):
    yn = C.strings("no", "yes")
    qs = F.array(C.question("toxic", yn, F.col("toxic")), C.question("quality", yn, F.col("quality")), C.question("lang", yn, F.lit(0)))
    d = table(spark, base, "labels").select("doc_id", A.question_subset(qs, "doc_id").alias("qs"))
    return d.select("doc_id", F.array_join(F.transform("qs", lambda q: q["text"]), "|").alias("questions"))


@query("isolated_rows", f"""SELECT o_orderkey, CAST(l.i AS INTEGER) AS level, '{Q_URGENT}' || chr(10) || 'Proposed answer: ' || ['urgent', 'high', 'medium', 'not specified', 'low'][l.i + 1] || chr(10) || 'Does the proposed answer fit?' AS text,
  CAST(CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 = l.i AS INTEGER) AS gold FROM orders, range(5) l(i)""")
def isolated_rows(spark, base):
    o = table(spark, base, "orders").select("o_orderkey", (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("g"))
    return A.isolated_rows(o, F.lit(Q_URGENT), C.strings(*PRIORITIES), F.col("g")).select("o_orderkey", "level", "text", "gold")


@query("part_repeat", "SELECT doc_id, CAST(unnest(generate_series(1, CASE WHEN toxic = 1 THEN 3 WHEN quality = 0 THEN 2 ELSE 1 END)) AS INTEGER) AS copy FROM labels")
def part_repeat(spark, base):
    n = F.when(F.col("toxic") == 1, 3).when(F.col("quality") == 0, 2).otherwise(1)
    return S.repeat_rows(table(spark, base, "labels"), n).select("doc_id", "copy")


@query("probe_routing", f"""WITH x AS (SELECT doc_id, toxic, quality, lang, {V.BELOW(V.U('held_domain', 'source'), 0.3)} AS held FROM documents JOIN labels USING (doc_id))
SELECT doc_id, CASE WHEN toxic = 1 THEN 'custom_choice' || CASE WHEN lang = 'en' THEN '_generic' ELSE '' END WHEN quality = 0 THEN 'routing_' || CASE WHEN lang = 'en' THEN '' ELSE 'terse_' END || 'specific' ELSE 'contrastive_noul' END AS probe FROM x WHERE held""")
def probe_routing(spark, base):
    """Records of held-out domains, sent to the probe set of their type, recipe and group."""
    d = labelled(spark, base).filter(chance(u8("held_domain", "source"), 0.3))
    en = F.col("lang") == "en"
    probe = F.when(F.col("toxic") == 1, F.concat(F.lit("custom_choice"), F.when(en, "_generic").otherwise(""))).when(
        F.col("quality") == 0, F.concat(F.lit("routing_"), F.when(en, "").otherwise("terse_"), F.lit("specific"))).otherwise("contrastive_noul")
    return d.select("doc_id", probe.alias("probe"))
