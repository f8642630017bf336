"""Rule-conditioned decisions: conditions, their minimal edits, outcomes and renderings as column expressions.

A rule is data (family, field, op, value, outcomes). Records meet their rule in an equi join on the rule id and
the condition is evaluated as an expression, so any table of records can be asked any table of rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adjudica.functions.hashing import pick_index, u8
from adjudica.operators.ranking import hash_bucket, with_rank

HELD_FAMILIES = ("compare", "count")


def field_value(field: Column, cols: dict[str, Column]) -> Column:
    """The value of the field a rule names."""
    out = F.lit(None)
    for name, c in cols.items():
        out = F.coalesce(out, F.when(field == name, c))
    return out


# ---- conditions and the smallest edit that flips them
def threshold(v: Column, op: Column, t: Column) -> Column:
    return F.when(op == "at least", v >= t).when(op == "more than", v > t).when(op == "below", v < t).when(op == "at most", v <= t)


def threshold_twin(v: Column, op: Column, t: Column) -> Column:
    inside = F.when(op == "more than", t + 1).when(op == "below", t - 1).otherwise(t)
    outside = F.when(op == "at least", t - 1).when(op == "at most", t + 1).otherwise(t)
    return F.when(threshold(v, op, t), outside).otherwise(inside)


def presence(s: Column, empty: Column) -> Column:
    return (F.coalesce(s, F.lit("")) == "") == empty


def presence_twin(s: Column, fill: Column) -> Column:
    return F.when(F.coalesce(s, F.lit("")) == "", fill).otherwise("")


def boolean(b: Column, want: Column) -> Column:
    return b == want


def membership(x: Column, vals: Column, negated: Column) -> Column:
    return F.array_contains(vals, x) != negated


def membership_twin(x: Column, vals: Column, pool: Column, *key) -> Column:
    outside = F.array_except(pool, vals)
    one = lambda a, p: F.get(a, pick_index(u8(p, *key), F.size(a)))
    return F.when(F.array_contains(vals, x), one(outside, "leave")).otherwise(one(vals, "enter"))


def contains(arr: Column, v: Column, negated: Column) -> Column:
    return F.array_contains(arr, v) != negated


def contains_twin(arr: Column, v: Column) -> Column:
    return F.when(F.array_contains(arr, v), F.array_remove(arr, v)).otherwise(F.array_append(arr, v))


def count(arr: Column, op: Column, t: Column) -> Column:
    return F.when(op == "at least", F.size(arr) >= t).otherwise(F.size(arr) < t)


def count_twin(arr: Column, op: Column, t: Column, pool: Column) -> Column:
    n = F.when((op == "at least") != count(arr, op, t), t).otherwise(t - 1)
    return F.slice(F.concat(arr, F.array_except(pool, arr)), F.lit(1), n)


def compare(a: Column, b: Column, op: Column) -> Column:
    return F.when(op == "greater than", a > b).otherwise(a < b)


def compare_twin(a: Column, b: Column, op: Column) -> Column:
    up = (op == "greater than") != compare(a, b, op)
    return b + F.when(up, 1).otherwise(-1)


def first_flip(record: dict[str, Column], edits: list[tuple[str, dict[str, Column]]], outcome: Callable[[dict[str, Column]], Column]) -> Column:
    """STRUCT<edit, outcome> of the first edit under which the record has another outcome; NULL where none has.

    An edit is a name and the fields that it changes; put the smallest first (one field before two). All are tried in the row, their number is that of the rule's
    clauses, so a twin of any rule that is a function of the record costs a projection."""
    base = outcome(record)
    tried = F.array(*[F.struct(F.lit(name).alias("edit"), outcome(record | changed).alias("outcome")) for name, changed in edits])
    return F.get(F.filter(tried, lambda t: t["outcome"] != base), F.lit(0))


def clause_edits(clauses: list[tuple[str, str, Column]], pairs: bool = True) -> list[tuple[str, dict[str, Column]]]:
    """Edits for a rule of several clauses (name, field, minimal edit of the field): each clause's own, then, with `pairs`, every two together."""
    one = [(name, {field: new}) for name, field, new in clauses]
    two = [(f"{a[0]}+{b[0]}", {a[1]: a[2], b[1]: b[2]}) for i, a in enumerate(clauses) for b in clauses[i + 1:] if a[1] != b[1]]
    return one + (two if pairs else [])


def pointer_twin(value: Column, pool: Column | None, *key) -> Column:
    """Another value of the field a pointer question names: the next number, or another value of its pool."""
    if pool is None:
        return value + 1
    rest = F.array_remove(pool, value)
    return F.get(rest, pick_index(u8("pointer_twin", *key), F.size(rest)))


def compound(kind: Column, a: Column, b: Column) -> Column:
    return F.when(kind == "and", a & b).when(kind == "or", a | b).when(kind == "unless", a & ~b)


# ---- outcomes
def first_match(tests: list[tuple[Column, str]], default: str) -> Column:
    """The outcome of the first rule that holds."""
    return F.coalesce(*[F.when(t, F.lit(name)) for t, name in tests], F.lit(default))


def first_match_joined(matches: DataFrame, key: list[str], outcome: str, priority: str) -> DataFrame:
    """The same for rules kept as rows: matched (record, rule) rows -> the outcome of the lowest priority."""
    return matches.groupBy(*key).agg(F.min_by(outcome, priority).alias(outcome))


def outcome_index(test: Column, yes_first: Column, inverted: bool = False) -> Column:
    """Index of the chosen outcome among the two options; the inverted rule swaps the outcomes."""
    says_yes = ~test if inverted else test
    return F.when(says_yes == yes_first, 0).otherwise(1)


def decoy(values: Column, *key) -> Column:
    """A wrong outcome named after a value that occurs in the record."""
    vals = F.filter(values, lambda v: v != "")
    return F.when(F.size(vals) > 0, F.concat(F.lit("send to "), F.get(vals, pick_index(u8("decoy", *key), F.size(vals)))))


def pointer_options(fields: dict[str, Column]) -> Column:
    """'field name: value' options and "none of these"."""
    opts = [F.concat(F.lit(k.replace("_", " ") + ": "), v.cast("string")) for k, v in fields.items()]
    return F.array(*opts, F.lit("none of these"))


def pointer_gold(options: Column, field: Column, value: Column) -> Column:
    pos = F.array_position(options, F.concat(F.regexp_replace(field, "_", " "), F.lit(": "), value.cast("string")))
    return F.when(pos > 0, pos - 1).otherwise(F.size(options) - 1).cast("int")


def select_groups(records: DataFrame, key: str, test: Column, k: int, purpose: str = "select") -> DataFrame:
    """Groups of k records of which exactly one satisfies the rule -> grp, n, gold (its place)."""
    d = records.withColumn("_t", test).withColumn("_u", u8(purpose, key))
    d = with_rank(d, [], hash_bucket(F.col("_u")), [F.col("_u"), F.col(key)], "_r")
    d = d.withColumn("grp", F.floor((F.col("_r") - 1) / k)).withColumn("pos", F.pmod(F.col("_r") - 1, F.lit(k)))
    g = d.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_t")).alias("hits"), F.max(F.when(F.col("_t"), F.col("pos"))).cast("int").alias("gold"))
    return g.filter("hits = 1").drop("hits")


def form_decision(role: Column, value: Column, checked: Column, required: Column, label: Column, entity: Column) -> Column:
    """fill an empty or stale field whose entity exists, check a required unchecked box, click submit, else skip."""
    return (
        F.when((role == "Edit") & entity.isNotNull() & value.isin("", "stale value"), F.concat(F.lit("fill "), entity))
        .when((role == "CheckBox") & required & ~checked, "check")
        .when((role == "Button") & label.startswith("Submit"), "click")
        .otherwise("skip")
    )


# ---- rendering
def render_record(fields: dict[str, Column], mode: Column) -> Column:
    """json / lines / prose rendering of scalar fields (strings, numbers, booleans)."""
    js = F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))
    lines = F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), c.cast("string")) for k, c in fields.items()])

    def spoken(c: Column) -> Column:
        s = c.cast("string")
        return F.when(s == "true", "yes").when(s == "false", "no").when(s == "", "(empty)").otherwise(s)

    prose = F.concat_ws("\n", *[F.concat(F.lit(k.replace("_", " ").capitalize() + ": "), spoken(c)) for k, c in fields.items()])
    return F.when(mode == "json", js).when(mode == "lines", lines).otherwise(prose)


def probe_set(domain_held: Column, family_held: Column) -> Column:
    return F.when(domain_held & family_held, "rules_held_both").when(domain_held, "rules_held_domain").when(family_held, "rules_held_family").otherwise("train")


def twin_audit(rows: DataFrame, key: list[str], gold: str) -> DataFrame:
    """Share of groups whose members disagree and the share of the rarer gold."""
    g = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(gold).alias("d"), F.count_if(F.col(gold) == 0).alias("zero"))
    pairs = g.filter("n > 1").agg(F.count(F.lit(1)).alias("groups"), F.avg((F.col("d") > 1).cast("int")).alias("disagree"))
    share = g.agg((F.sum("zero") / F.sum("n")).alias("s"))
    return pairs.withColumn("s", share.scalar()).select("groups", "disagree", F.least(F.col("s"), 1 - F.col("s")).alias("balance"))


