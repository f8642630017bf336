"""Rule-conditioned decision queries over orders joined with their customers and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from adjudica.functions.hashing import chance, pick_index, u8
from adjudica.operators import rules as R
from adjudica.plans import views as V
from adjudica.plans.registry import query
from adjudica.sources.tables import spread, table

STATUSES, FLAGS = ("F", "O", "P"), ("A", "N", "R")


def records(spark, base):
    """One record per order: numbers, enums, a flag, a name that may be empty, and a list."""
    o, c, l = (table(spark, base, t) for t in ("orders", "customer", "lineitem"))
    flags = l.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("flags"))
    d = spread(o).join(c, F.col("o_custkey") == F.col("c_custkey")).join(flags, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return d.select(
        F.col("o_orderkey").alias("id"),
        F.floor("o_totalprice").cast("int").alias("total"),
        F.floor("c_acctbal").cast("int").alias("balance"),
        F.col("o_orderstatus").alias("status"),
        F.col("c_mktsegment").alias("segment"),
        (F.col("o_custkey") % 2 == 0).alias("gift"),
        F.when(chance(u8("empty", "o_orderkey"), 0.15), "").otherwise(F.col("c_name")).alias("name"),
        F.coalesce("flags", F.array().cast("array<string>")).alias("flags"),
    )


REC = f"""rec AS (SELECT o_orderkey AS id, CAST(floor(o_totalprice) AS INTEGER) AS total, CAST(floor(c_acctbal) AS INTEGER) AS balance, o_orderstatus AS status, c_mktsegment AS segment, o_custkey % 2 = 0 AS gift,
  CASE WHEN {V.BELOW(V.U('empty', 'o_orderkey'), 0.15)} THEN '' ELSE c_name END AS name, coalesce(f.flags, CAST([] AS VARCHAR[])) AS flags FROM orders JOIN customer ON o_custkey = c_custkey
  LEFT JOIN (SELECT l_orderkey, array_agg(DISTINCT l_returnflag ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY l_orderkey) f ON f.l_orderkey = o_orderkey)"""


def arr(*v):
    return F.array(*[F.lit(x) for x in v])


THRESHOLDS = [(0, "total", "at least", 250000), (1, "total", "more than", 100000), (2, "balance", "below", 3000), (3, "balance", "at most", 5000)]
TH_VALUES = "(VALUES " + ", ".join(f"({i}, '{f}', '{o}', {t})" for i, f, o, t in THRESHOLDS) + ") th(rule_id, field, op, t)"


def with_threshold_rule(spark, d):
    rules = spark.createDataFrame(THRESHOLDS, "rule_id int, field string, op string, t int")
    d = d.withColumn("rule_id", pick_index(u8("rule", "id"), len(THRESHOLDS))).join(F.broadcast(rules), "rule_id")
    return d.withColumn("v", R.field_value(F.col("field"), {"total": F.col("total"), "balance": F.col("balance")}))


TH_CTE = f"""thr AS (SELECT rec.*, th.rule_id, th.field, th.op, th.t, CASE field WHEN 'total' THEN total ELSE balance END AS v FROM rec JOIN {TH_VALUES} ON th.rule_id = {V.IDX(V.U('rule', 'id'), 4)}),
tht AS (SELECT *, CASE op WHEN 'at least' THEN v >= t WHEN 'more than' THEN v > t WHEN 'below' THEN v < t ELSE v <= t END AS test FROM thr)"""


@query("rule_threshold", f"WITH {REC}, {TH_CTE} SELECT id, rule_id, test AS holds, CASE WHEN test THEN 'approve' ELSE 'reject' END AS outcome FROM tht")
def rule_threshold(spark, base):
    d = with_threshold_rule(spark, records(spark, base)).withColumn("holds", R.threshold(F.col("v"), F.col("op"), F.col("t")))
    return d.select("id", "rule_id", "holds", F.when(F.col("holds"), "approve").otherwise("reject").alias("outcome"))


NEG = V.BELOW(V.U("negate", "id"), 0.5)


@query("rule_presence", f"WITH {REC} SELECT id, (name = '') = {NEG} AS holds FROM rec")
def rule_presence(spark, base):
    return records(spark, base).select("id", R.presence(F.col("name"), chance(u8("negate", "id"), 0.5)).alias("holds"))


@query("rule_boolean", f"WITH {REC} SELECT id, gift = {NEG} AS holds FROM rec")
def rule_boolean(spark, base):
    return records(spark, base).select("id", R.boolean(F.col("gift"), chance(u8("negate", "id"), 0.5)).alias("holds"))


@query("rule_membership", f"WITH {REC} SELECT id, list_contains(['F', 'P'], status) <> {NEG} AS holds FROM rec")
def rule_membership(spark, base):
    return records(spark, base).select("id", R.membership(F.col("status"), arr("F", "P"), chance(u8("negate", "id"), 0.5)).alias("holds"))


@query("rule_contains", f"WITH {REC} SELECT id, list_contains(flags, 'R') <> {NEG} AS holds FROM rec")
def rule_contains(spark, base):
    return records(spark, base).select("id", R.contains(F.col("flags"), F.lit("R"), chance(u8("negate", "id"), 0.5)).alias("holds"))


@query("rule_count", f"WITH {REC} SELECT id, CASE WHEN {NEG} THEN len(flags) >= 2 ELSE len(flags) < 2 END AS holds FROM rec")
def rule_count(spark, base):
    op = F.when(chance(u8("negate", "id"), 0.5), "at least").otherwise("fewer than")
    return records(spark, base).select("id", R.count(F.col("flags"), op, F.lit(2)).alias("holds"))


@query("rule_compare", f"WITH {REC} SELECT id, CASE WHEN {NEG} THEN total > balance * 40 ELSE total < balance * 40 END AS holds FROM rec")
def rule_compare(spark, base):
    op = F.when(chance(u8("negate", "id"), 0.5), "greater than").otherwise("less than")
    return records(spark, base).select("id", R.compare(F.col("total"), F.col("balance") * 40, op).alias("holds"))


@query("rule_compound", f"""WITH {REC}, x AS (SELECT id, total >= 200000 AS a, list_contains(flags, 'R') AS b, ['and', 'or', 'unless'][1 + {V.IDX(V.U('kind', 'id'), 3)}] AS kind FROM rec)
SELECT id, kind, CASE kind WHEN 'and' THEN a AND b WHEN 'or' THEN a OR b ELSE a AND NOT b END AS holds FROM x""")
def rule_compound(spark, base):
    d = records(spark, base).withColumn("kind", F.get(arr("and", "or", "unless"), pick_index(u8("kind", "id"), 3)))
    a = R.threshold(F.col("total"), F.lit("at least"), F.lit(200000))
    return d.select("id", "kind", R.compound(F.col("kind"), a, R.contains(F.col("flags"), F.lit("R"), F.lit(False))).alias("holds"))


def precedence_tests():
    return [(F.col("total") >= 350000, "expedite"), (F.col("balance") < 1500, "hold"), (F.array_contains("flags", "R"), "flag")]


PREC = "CASE WHEN total >= 350000 THEN 'expedite' WHEN balance < 1500 THEN 'hold' WHEN list_contains(flags, 'R') THEN 'flag' ELSE 'do nothing' END"
PREC_REV = "CASE WHEN list_contains(flags, 'R') THEN 'flag' WHEN balance < 1500 THEN 'hold' WHEN total >= 350000 THEN 'expedite' ELSE 'do nothing' END"


@query("rule_precedence", f"WITH {REC} SELECT id, {PREC} AS outcome, {PREC} AS outcome_joined FROM rec")
def rule_precedence(spark, base):
    """As one expression, and as matched rule rows with min_by over the priority."""
    r = records(spark, base)
    hits = F.array_compact(F.array(*[F.when(t, F.struct(F.lit(i).alias("priority"), F.lit(n).alias("outcome_joined"))) for i, (t, n) in enumerate(precedence_tests())]))
    rows = r.select("id", F.inline(hits))
    joined = R.first_match_joined(rows, ["id"], "outcome_joined", "priority")
    d = r.select("id", R.first_match(precedence_tests(), "do nothing").alias("outcome")).join(joined, "id", "left")
    return d.select("id", "outcome", F.coalesce("outcome_joined", F.lit("do nothing")).alias("outcome_joined"))


PFIELDS = ("status", "segment", "total", "balance")
PTARGET = f"{['status', 'segment', 'total', 'name']!r}[1 + {V.IDX(V.U('pointer', 'id'), 4)}]"


@query("rule_pointer", f"""WITH {REC}, x AS (SELECT *, ['status: ' || status, 'segment: ' || segment, 'total: ' || total, 'balance: ' || balance, 'none of these'] AS o, {PTARGET} AS tgt FROM rec)
SELECT id, tgt AS target, CAST(CASE tgt WHEN 'status' THEN 0 WHEN 'segment' THEN 1 WHEN 'total' THEN 2 ELSE 4 END AS INTEGER) AS gold, array_to_string(o, '|') AS options FROM x""")
def rule_pointer(spark, base):
    d = records(spark, base).withColumn("target", F.get(arr("status", "segment", "total", "name"), pick_index(u8("pointer", "id"), 4)))
    d = d.withColumn("options", R.pointer_options({k: F.col(k) for k in PFIELDS}))
    v = R.field_value(F.col("target"), {k: F.col(k).cast("string") for k in ("status", "segment", "total", "name")})
    return d.select("id", "target", R.pointer_gold(F.col("options"), F.col("target"), v).alias("gold"), F.array_join("options", "|").alias("options"))


@query("rule_select", f"""WITH {REC}, r AS (SELECT total >= 380000 AS test, row_number() OVER (ORDER BY {V.U('select', 'id')}, id) - 1 AS r FROM rec), g AS (SELECT r // 4 AS grp, count(*) AS n, count(*) FILTER (WHERE test) AS hits, CAST(max(CASE WHEN test THEN r % 4 END) AS INTEGER) AS gold FROM r GROUP BY 1)
SELECT grp, n, gold FROM g WHERE hits = 1""")
def rule_select(spark, base):
    return R.select_groups(records(spark, base), "id", F.col("total") >= 380000, 4)


@query("form_decision", f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, ['Edit', 'CheckBox', 'Button', 'Pane'][1 + l_linenumber % 4] AS role, ['', 'filled', 'stale value'][1 + {V.IDX(V.U('value', 'l_orderkey', 'l_partkey'), 3)}] AS value,
  l_returnflag = 'A' AS checked, l_linestatus = 'O' AS required, CASE WHEN l_quantity > 25 THEN 'Submit Form' ELSE 'Cancel' END AS label, o_orderpriority AS entity FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus <> 'P')
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN role = 'Edit' AND entity IS NOT NULL AND value IN ('', 'stale value') THEN 'fill ' || entity WHEN role = 'CheckBox' AND required AND NOT checked THEN 'check'
  WHEN role = 'Button' AND label LIKE 'Submit%' THEN 'click' ELSE 'skip' END AS action FROM x""")
def form_decision(spark, base):
    """Lines as form elements, open or finished orders as the document entities that can fill them."""
    l = table(spark, base, "lineitem")
    e = table(spark, base, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("entity"))
    role = F.get(arr("Edit", "CheckBox", "Button", "Pane"), F.col("l_linenumber") % 4)
    value = F.get(arr("", "filled", "stale value"), pick_index(u8("value", "l_orderkey", "l_partkey"), 3))
    label = F.when(F.col("l_quantity") > 25, "Submit Form").otherwise("Cancel")
    d = l.join(e, "l_orderkey", "left")
    act = R.form_decision(role, value, F.col("l_returnflag") == "A", F.col("l_linestatus") == "O", label, F.col("entity"))
    return d.select("l_orderkey", "l_linenumber", "l_partkey", act.alias("action"))


FAMS = ("threshold", "presence", "boolean", "membership", "contains", "count", "compare")
TWIN_CTE = f"""{REC}, fam AS (SELECT *, {list(FAMS)!r}[1 + {V.IDX(V.U('family', 'id'), 7)}] AS family FROM rec),
tw AS (SELECT *, CASE family WHEN 'threshold' THEN total >= 250000 WHEN 'presence' THEN name = '' WHEN 'boolean' THEN gift WHEN 'membership' THEN status IN ('F', 'P') WHEN 'contains' THEN list_contains(flags, 'R') WHEN 'count' THEN len(flags) >= 2 ELSE total > balance * 40 END AS test,
 CASE family WHEN 'threshold' THEN CAST(CASE WHEN total >= 250000 THEN 249999 ELSE 250000 END AS VARCHAR) WHEN 'presence' THEN CASE WHEN name = '' THEN 'Dana Rui' ELSE '' END WHEN 'boolean' THEN CAST(NOT gift AS VARCHAR)
  WHEN 'membership' THEN CASE WHEN status IN ('F', 'P') THEN 'O' ELSE ['F', 'P'][1 + {V.IDX(V.U('enter', 'id'), 2)}] END
  WHEN 'contains' THEN array_to_string(CASE WHEN list_contains(flags, 'R') THEN list_filter(flags, lambda f: f <> 'R') ELSE list_append(flags, 'R') END, ',')
  WHEN 'count' THEN array_to_string(CASE WHEN len(flags) >= 2 THEN flags[1:1] ELSE list_concat(flags, list_filter(['A', 'N', 'R'], lambda f: NOT list_contains(flags, f)))[1:2] END, ',')
  ELSE CAST(balance * 40 + CASE WHEN total > balance * 40 THEN -1 ELSE 1 END AS VARCHAR) END AS edit FROM fam)"""


def twins(spark, base):
    """Base test, the minimal edit of one attribute, and the test after the edit, for a hashed family per record."""
    d = records(spark, base).withColumn("family", F.get(arr(*FAMS), pick_index(u8("family", "id"), len(FAMS))))
    f, total, b40 = F.col("family"), F.col("total"), F.col("balance") * 40
    ge, gt, t = F.lit("at least"), F.lit("greater than"), F.lit(250000)
    pool, vals, no, yes = arr(*FLAGS), arr("F", "P"), F.lit(False), F.lit(True)

    def test(name, status, gift, flags, tot):
        return (
            F.when(f == "threshold", R.threshold(tot, ge, t)).when(f == "presence", R.presence(name, yes)).when(f == "boolean", R.boolean(gift, yes))
            .when(f == "membership", R.membership(status, vals, no)).when(f == "contains", R.contains(flags, F.lit("R"), no)).when(f == "count", R.count(flags, ge, F.lit(2)))
            .otherwise(R.compare(tot, b40, gt))
        )

    d = d.withColumn("test", test(F.col("name"), F.col("status"), F.col("gift"), F.col("flags"), total))
    d = d.withColumn("t_total", F.when(f == "threshold", R.threshold_twin(total, ge, t)).when(f == "compare", R.compare_twin(total, b40, gt)).otherwise(total))
    d = d.withColumn("t_name", F.when(f == "presence", R.presence_twin(F.col("name"), F.lit("Dana Rui"))).otherwise(F.col("name")))
    d = d.withColumn("t_gift", F.when(f == "boolean", ~F.col("gift")).otherwise(F.col("gift")))
    d = d.withColumn("t_status", F.when(f == "membership", R.membership_twin(F.col("status"), vals, arr(*STATUSES), "id")).otherwise(F.col("status")))
    d = d.withColumn("t_flags", F.when(f == "contains", R.contains_twin(F.col("flags"), F.lit("R"))).when(f == "count", R.count_twin(F.col("flags"), ge, F.lit(2), pool)).otherwise(F.col("flags")))
    d = d.withColumn("twin_test", test(F.col("t_name"), F.col("t_status"), F.col("t_gift"), F.col("t_flags"), F.col("t_total")))
    edit = (
        F.when(f.isin("threshold", "compare"), F.col("t_total").cast("string")).when(f == "presence", F.col("t_name")).when(f == "boolean", F.col("t_gift").cast("string"))
        .when(f == "membership", F.col("t_status")).otherwise(F.array_join("t_flags", ","))
    )
    return d.withColumn("edit", edit).filter(F.col("test") != F.col("twin_test"))


@query("state_twin", f"WITH {TWIN_CTE} SELECT id, family, test AS gold, NOT test AS twin_gold, edit FROM tw")
def state_twin(spark, base):
    return twins(spark, base).select("id", "family", F.col("test").alias("gold"), F.col("twin_test").alias("twin_gold"), "edit")


FAMS3 = ("compound", "precedence", "pointer")
KIND = f"['and', 'or', 'unless'][1 + {V.IDX(V.U('kind', 'id'), 3)}]"


def COMPOUND(a: str, b: str) -> str:
    return f"CASE WHEN CASE kind WHEN 'and' THEN {a} AND {b} WHEN 'or' THEN {a} OR {b} ELSE {a} AND NOT {b} END THEN 'yes' ELSE 'no' END"


def FIRST(total: str, balance: str, flag: str) -> str:
    return f"CASE WHEN {total} >= 350000 THEN 'expedite' WHEN {balance} < 1500 THEN 'hold' WHEN {flag} THEN 'flag' ELSE 'do nothing' END"


def TRIES(base: str, *tries: tuple[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {o} <> {base} THEN {{'edit': '{e}', 'outcome': {o}}}" for e, o in tries) + " END"


TWIN3_CTE = f"""{REC}, f3 AS (SELECT *, {list(FAMS3)!r}[1 + {V.IDX(V.U('family3', 'id'), 3)}] AS family, {KIND} AS kind, total >= 200000 AS a, list_contains(flags, 'R') AS b, ['status', 'segment', 'total', 'balance'][1 + {V.IDX(V.U('pointer3', 'id'), 4)}] AS target,
  CASE WHEN total >= 350000 THEN 349999 ELSE 350000 END AS t2, CASE WHEN balance < 1500 THEN 1500 ELSE 1499 END AS b2 FROM rec),
o3 AS (SELECT *, {COMPOUND('a', 'b')} AS oc, {FIRST('total', 'balance', 'b')} AS op, CAST(list_position(['status', 'segment', 'total', 'balance'], target) - 1 AS VARCHAR) AS ot FROM f3),
x3 AS (SELECT id, family, CASE family WHEN 'compound' THEN oc WHEN 'precedence' THEN op ELSE ot END AS gold, CASE family
  WHEN 'compound' THEN {TRIES('oc', ('total', COMPOUND('NOT a', 'b')), ('flags', COMPOUND('a', 'NOT b')), ('total+flags', COMPOUND('NOT a', 'NOT b')))}
  WHEN 'precedence' THEN {TRIES('op', ('total', FIRST('t2', 'balance', 'b')), ('balance', FIRST('total', 'b2', 'b')), ('flags', FIRST('total', 'balance', 'NOT b')), ('total+balance', FIRST('t2', 'b2', 'b')), ('total+flags', FIRST('t2', 'balance', 'NOT b')), ('balance+flags', FIRST('total', 'b2', 'NOT b')))}
  ELSE {{'edit': target, 'outcome': '4'}} END AS twin FROM o3)"""


def rule_twins(spark, base):
    """Records under rules of several clauses, and pointer questions: outcome, and the smallest edit of the record that changes it."""
    d = records(spark, base).withColumn("family", F.get(arr(*FAMS3), pick_index(u8("family3", "id"), 3))).withColumn("kind", F.get(arr("and", "or", "unless"), pick_index(u8("kind", "id"), 3)))
    d = d.withColumn("target", F.get(arr(*PFIELDS), pick_index(u8("pointer3", "id"), 4)))
    fields = ("total", "balance", "flags", "status", "segment")
    record = {f: F.col(f) for f in fields}
    at_least, below, no = F.lit("at least"), F.lit("below"), F.lit(False)
    has = lambda r: R.contains(r["flags"], F.lit("R"), no)
    flag_edit = ("flags", "flags", R.contains_twin(F.col("flags"), F.lit("R")))

    both = lambda r: F.when(R.compound(F.col("kind"), R.threshold(r["total"], at_least, F.lit(200000)), has(r)), "yes").otherwise("no")
    compound = R.first_flip(record, R.clause_edits([("total", "total", R.threshold_twin(F.col("total"), at_least, F.lit(200000))), flag_edit]), both)

    ranked = lambda r: R.first_match([(R.threshold(r["total"], at_least, F.lit(350000)), "expedite"), (R.threshold(r["balance"], below, F.lit(1500)), "hold"), (has(r), "flag")], "do nothing")
    clauses = [("total", "total", R.threshold_twin(F.col("total"), at_least, F.lit(350000))), ("balance", "balance", R.threshold_twin(F.col("balance"), below, F.lit(1500))), flag_edit]
    precedence = R.first_flip(record, R.clause_edits(clauses), ranked)

    options = R.pointer_options({k: F.col(k) for k in PFIELDS})  # those of the record as it was
    pointed = lambda r: R.pointer_gold(options, F.col("target"), R.field_value(F.col("target"), {k: r[k].cast("string") for k in PFIELDS})).cast("string")
    segments = arr("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    new = {"status": R.pointer_twin(F.col("status"), arr(*STATUSES), "id"), "segment": R.pointer_twin(F.col("segment"), segments, "id"), "total": R.pointer_twin(F.col("total"), None), "balance": R.pointer_twin(F.col("balance"), None)}
    pointer = R.first_flip(record, [(k, {k: v}) for k, v in new.items()], pointed)
    f = F.col("family")
    pick = lambda a, b, c: F.when(f == "compound", a).when(f == "precedence", b).otherwise(c)
    return d.select("id", "family", pick(both(record), ranked(record), pointed(record)).alias("gold"), pick(compound, precedence, pointer).alias("twin"))


@query("state_twin_rules", f"WITH {TWIN3_CTE} SELECT id, family, gold, twin.outcome AS twin_gold, twin.edit AS edit FROM x3")
def state_twin_rules(spark, base):
    return rule_twins(spark, base).select("id", "family", "gold", F.col("twin.outcome").alias("twin_gold"), F.col("twin.edit").alias("edit"))


@query("twin_audit_rules", f"WITH {TWIN3_CTE} SELECT family, count(*) AS n, count(*) FILTER (WHERE twin IS NULL OR twin.outcome = gold) AS unflipped, count(*) FILTER (WHERE contains(twin.edit, '+')) AS two_fields FROM x3 GROUP BY family")
def twin_audit_rules(spark, base):
    """No twin keeps its outcome; how many needed two fields."""
    t = rule_twins(spark, base)
    kept = F.coalesce(F.col("twin.outcome") == F.col("gold"), F.lit(True))
    return t.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.count_if(kept).alias("unflipped"), F.count_if(F.contains("twin.edit", F.lit("+"))).alias("two_fields"))


YES_FIRST = V.BELOW(V.U("yes_first", "id"), 0.5)


@query("rule_twin", f"""WITH {REC}, {TH_CTE} SELECT id, 'threshold' AS family, CAST(CASE WHEN test = {YES_FIRST} THEN 0 ELSE 1 END AS INTEGER) AS gold, CAST(CASE WHEN (NOT test) = {YES_FIRST} THEN 0 ELSE 1 END AS INTEGER) AS twin_gold FROM tht
UNION ALL SELECT id, 'precedence', CAST(list_position(['expedite', 'hold', 'flag', 'do nothing'], {PREC}) - 1 AS INTEGER), CAST(list_position(['expedite', 'hold', 'flag', 'do nothing'], {PREC_REV}) - 1 AS INTEGER) FROM rec WHERE {PREC} <> {PREC_REV}""")
def rule_twin(spark, base):
    """The same record under the inverted rule: swapped outcomes, or the priority order reversed."""
    r = records(spark, base)
    first = chance(u8("yes_first", "id"), 0.5)
    th = with_threshold_rule(spark, r).withColumn("t", R.threshold(F.col("v"), F.col("op"), F.col("t")))
    a = th.select("id", F.lit("threshold").alias("family"), R.outcome_index(F.col("t"), first).alias("gold"), R.outcome_index(F.col("t"), first, inverted=True).alias("twin_gold"))
    opts = arr("expedite", "hold", "flag", "do nothing")
    idx = lambda c: (F.array_position(opts, c) - 1).cast("int")
    b = r.select("id", F.lit("precedence").alias("family"), idx(R.first_match(precedence_tests(), "do nothing")).alias("gold"), idx(R.first_match(precedence_tests()[::-1], "do nothing")).alias("twin_gold"))
    return a.unionByName(b).filter(F.col("gold") != F.col("twin_gold"))


@query("rule_decoy", f"""WITH {REC}, x AS (SELECT id, list_filter(list_concat([name, status, segment], flags), lambda v: v <> '') AS vals FROM rec)
SELECT id, 'send to ' || vals[1 + {V.IDX(V.U('decoy', 'id'), 'len(vals)')}] AS decoy FROM x""")
def rule_decoy(spark, base):
    vals = F.concat(F.array("name", "status", "segment"), "flags")
    return records(spark, base).select("id", R.decoy(vals, "id").alias("decoy"))


@query("render_record", f"""WITH {REC}, x AS (SELECT *, {V.U('render', 'id')} AS u FROM rec)
SELECT id, CASE WHEN u < '{int(0.55 * 2**32):08x}' THEN CAST(to_json({{'order_total': total, 'gift': gift, 'name': name}}) AS VARCHAR)
  WHEN u < '{int(0.8 * 2**32):08x}' THEN 'order_total: ' || total || chr(10) || 'gift: ' || gift || chr(10) || 'name: ' || name
  ELSE 'Order total: ' || total || chr(10) || 'Gift: ' || CASE WHEN gift THEN 'yes' ELSE 'no' END || chr(10) || 'Name: ' || CASE name WHEN '' THEN '(empty)' ELSE name END END AS context FROM x""")
def render_record(spark, base):
    u = u8("render", "id")
    mode = F.when(chance(u, 0.55), "json").when(chance(u, 0.8), "lines").otherwise("prose")
    r = records(spark, base)
    return r.select("id", R.render_record({"order_total": F.col("total"), "gift": F.col("gift"), "name": F.col("name")}, mode).alias("context"))


@query("twin_audit", f"""WITH {TWIN_CTE}, r AS (SELECT id, family, CAST(test AS INTEGER) AS gold FROM tw UNION ALL SELECT id, family, CAST(NOT test AS INTEGER) FROM tw),
g AS (SELECT family, id, count(*) AS n, count(DISTINCT gold) AS d, count(*) FILTER (WHERE gold = 0) AS z FROM r GROUP BY 1, 2)
SELECT count(*) AS groups, round(avg(CAST(d > 1 AS INTEGER)), 6) AS disagree, round((SELECT least(sum(z) / sum(n), 1 - sum(z) / sum(n)) FROM g), 6) AS balance FROM g WHERE n > 1""")
def twin_audit(spark, base):
    t = twins(spark, base)
    rows = t.select("id", "family", F.explode(F.array(F.col("test").cast("int"), F.col("twin_test").cast("int"))).alias("gold"))
    a = R.twin_audit(rows, ["family", "id"], "gold")
    return a.select("groups", F.round("disagree", 6).alias("disagree"), F.round("balance", 6).alias("balance"))


@query("rule_probe_grid", f"""WITH {TWIN_CTE} SELECT CASE WHEN segment = 'FURNITURE' AND family IN ('compare', 'count') THEN 'rules_held_both' WHEN segment = 'FURNITURE' THEN 'rules_held_domain' WHEN family IN ('compare', 'count') THEN 'rules_held_family' ELSE 'train' END AS probe, count(*) AS n FROM tw GROUP BY 1""")
def rule_probe_grid(spark, base):
    p = R.probe_set(F.col("segment") == "FURNITURE", F.col("family").isin(*R.HELD_FAMILIES))
    return twins(spark, base).groupBy(p.alias("probe")).agg(F.count(F.lit(1)).alias("n"))
