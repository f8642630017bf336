"""Augmentations: new input shapes derived from existing examples."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adjudica.functions import text as X
from adjudica.functions.hashing import chance, hash_sort, pick_index, place, u8, u_int
from adjudica.operators.ranking import hash_bucket, ring_blocks, ring_slice, with_rank

MAX_OPTIONS = 255
ANNOTATE_MIN = 8
# Fixed value: the question of one level on its own.
ISOLATED = "%s\nProposed answer: %s\nDoes the proposed answer fit?"


# ---- label sets
def fixed_label_sets(long: DataFrame, min_n: int = 50, share: float = 0.98, skip: list[str] | None = None) -> DataFrame:
    """(task, text) whose most frequent option list covers more than `share` of at least min_n questions.

    Training rows decide where a question has any. Two aggregations, both combined map-side."""
    d = long if not skip else long.filter(~F.col("task").isin(skip))
    lists = d.groupBy("task", "text", "split", "options").agg(F.count(F.lit(1)).alias("n"))
    per = lists.groupBy("task", "text", "split").agg(F.max(F.struct("n", "options")).alias("top"), F.sum("n").alias("total"))
    best = per.groupBy("task", "text").agg(F.max(F.struct((F.col("split") == "train").alias("is_train"), "split", "top", "total")).alias("b"))
    out = best.select("task", "text", F.col("b.top.options").alias("options"), F.col("b.split").alias("split"), F.col("b.total").alias("n"), (F.col("b.top.n") / F.col("b.total")).alias("share"))
    return out.filter((F.col("share") > share) & (F.col("n") >= min_n))


def label_pool(long: DataFrame) -> DataFrame:
    """Distinct options per task, over questions of 3..60 options, for pools of 3..200 labels."""
    d = long.filter(F.size("options").between(3, 60) & ~F.col("task").contains("+"))
    labels = d.select("task", F.explode("options").alias("label")).distinct()
    fits = labels.groupBy("task").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n").between(3, 200))  # only these are gathered
    return labels.join(fits, "task").groupBy("task", "n").agg(F.array_sort(F.collect_set("label")).alias("labels"))


# ---- option lists
def narrow(options: Column, gold: Column, cap: int, *key) -> tuple[Column, Column]:
    """At most `cap` options: the gold and abstain options stay, others are drawn by hash; the order is kept."""
    tagged = F.transform(options, lambda o, i: F.struct(((i != gold) & ~X.is_abstain(o)).cast("int").alias("free"), u8("narrow", *key, o).alias("u"), i.alias("i"), o.alias("o")))
    forced = F.size(F.filter(tagged, lambda t: t["free"] == 0))
    keep = F.slice(F.array_sort(tagged), 1, F.greatest(F.lit(cap), forced))
    kept = F.array_sort(F.transform(keep, lambda t: F.struct(t["i"].alias("i"), t["o"].alias("o"))))
    few = F.size(options) <= cap
    opts = F.when(few, options).otherwise(F.transform(kept, lambda t: t["o"]))
    return opts, F.when(few, gold).otherwise(F.array_position(F.transform(kept, lambda t: t["i"]), gold.cast("int")) - 1).cast("int")


def pad_count(*key) -> Column:
    """Distractors to add: log-uniform, a quarter of the time 100..250."""
    u = u8("npad_size", *key)
    heavy = 100 + pick_index(u, 151)
    light = F.floor(F.pow(F.lit(2.0), u_int(u) / F.lit(4294967296.0) * 7.9)).cast("int")
    return F.when(chance(u8("npad_kind", *key), 0.25), heavy).otherwise(light)


def family_pools(pool: DataFrame, families: list[str]) -> DataFrame:
    """(family, label): for each of the named families the distinct labels of all other families. Columns of `pool`: task, family, label.

    Tasks of at least 4 distinct labels take part, unless their labels are the levels of a scale; abstain labels do not."""
    d = pool.distinct()
    tasks = d.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.min((F.col("label").rlike(X.SCALE_RE)).cast("int")).alias("levels")).filter("n >= 4 and levels = 0")
    labels = d.filter(~X.is_abstain(F.col("label"))).join(tasks.select("task"), "task", "left_semi").groupBy("label").agg(F.collect_set("family").alias("of"))
    asked = labels.withColumn("family", F.explode(F.array(*[F.lit(f) for f in families])))
    return asked.filter(F.exists("of", lambda f: f != F.col("family"))).select("family", "label")


def pad(df: DataFrame, key: str, family: str, options: str, m: Column, pools: DataFrame, into: str = "padded") -> DataFrame:
    """Append up to m labels of other families, 255 options in all: those of the next m + size(options) labels of the
    family's pool (family, label), in a circular hashed order from a hashed start, that are not present in any letter case.

    A family without a pool adds nothing. Pools of any size are met by equi joins (`ranking.ring_slice`)."""
    ring = ring_blocks(pools.withColumnRenamed("family", "_family"), ["_family"], "label", "pool_order")
    d = df.withColumn("_family", F.col(family)).withColumn("_m", m)
    d = ring_slice(d, key, ["_family"], ring, place("pad", key), F.col("_m") + F.size(options), "_next")
    have = F.transform(options, F.lower)
    fresh = F.filter("_next", lambda o: ~F.array_contains(have, F.lower(o)))
    return d.withColumn(into, F.concat(options, F.slice(fresh, F.lit(1), F.greatest(F.lit(0), F.least(F.col("_m"), F.lit(MAX_OPTIONS) - F.size(options)))))).drop("_family", "_m", "_next")


def opaque_name(i: Column, style: Column) -> Column:
    n = (i + 1).cast("string")
    return F.when(style == 0, F.concat(F.lit("c"), n)).when(style == 1, F.concat(F.lit("option_"), n)).otherwise(F.concat(F.lit("route_"), F.lpad(n, 2, "0")))


def describe(labels: Column, mode: Column, *key) -> Column:
    """Render ARRAY<STRUCT<label, what, not_for>> options.

    named: 'label: what'; opaque: 'c1: what'; the *_json modes write a JSON rubric. An undescribed label of a
    named list stays bare, and so do 12% of the described ones; an opaque name never hides an undescribed label."""
    style = pick_index(u8("style", *key), 3)
    opaque, as_json = mode.startswith("opaque"), mode.endswith("json")

    def one(x: Column, i: Column) -> Column:
        name = F.when(opaque, opaque_name(i, style)).otherwise(x["label"])
        bare = x["what"].isNull() | (~opaque & chance(u8("bare", *key, x["label"]), 0.12))
        rubric = F.to_json(F.struct(x["what"].alias("what"), x["not_for"].alias("not_for")))
        prose = F.when(style == 0, x["what"]).when(style == 1, F.concat(x["what"], F.lit(" Not for: "), x["not_for"])).otherwise(F.concat(x["what"], F.lit(" (not: "), x["not_for"], F.lit(")")))
        full = F.concat(name, F.lit(": "), F.when(as_json, rubric).otherwise(prose))
        undescribed = F.when(opaque, F.concat(name, F.lit(": "), x["label"])).otherwise(x["label"])
        return F.when(mode == "plain", x["label"]).when(x["what"].isNull(), undescribed).when(bare, name).otherwise(full)

    return F.transform(labels, one)


def rubric(options: Column, context: Column, key_sets: tuple[tuple[str, str, str], ...], namings: tuple[str, ...], *key) -> Column:
    """Render ARRAY<STRUCT<label, what, not_for, examples ARRAY<STRING>>> options under opaque names, each as a JSON rubric.

    The keys of a list's rubrics are one of `key_sets` (all names different), its names one of `namings` (formats of the place). 60% of the rubrics say what they are not
    for; half of those that can give up to three examples, never the row's own context, so that an option does not hold the answer. A rubric of one key
    is its plain text in 30%. An option without a description keeps its label behind the name."""
    which, naming = pick_index(u8("key_set", *key), len(key_sets)), pick_index(u8("naming", *key), len(namings))

    def one(x: Column, i: Column) -> Column:
        name = F.get(F.array(*[F.format_string(f, i + 1) for f in namings]), naming)
        others = F.filter(F.coalesce(x["examples"], F.array().cast("array<string>")), lambda e: ~e.eqNullSafe(context))
        some = F.slice(others, F.lit(1), 1 + pick_index(u8("n_examples", *key, x["label"]), 3))
        some = F.when(chance(u8("with_examples", *key, x["label"]), 0.5) & (F.size(some) > 0), some)
        limits = F.when(chance(u8("with_limits", *key, x["label"]), 0.6), x["not_for"])
        plain = limits.isNull() & some.isNull() & chance(u8("plain_rubric", *key, x["label"]), 0.3)
        fields = [F.when(which == j, v).alias(k) for j, names in enumerate(key_sets) for k, v in zip(names, (x["what"], limits, some))]  # to_json leaves nulls out
        body = F.when(x["what"].isNull(), x["label"]).when(plain, x["what"]).otherwise(F.to_json(F.struct(*fields)))
        return F.concat(name, F.lit(": "), body)

    return F.transform(options, one)


# ---- JSON states
def json_groups(df: DataFrame, task: list[str], key: str, text: str, k: int, budget: int, purpose: str = "json", carry: tuple[str, ...] = ()) -> DataFrame:
    """Groups of at most k records under a character budget (two records are always kept), of one task each, or of mixed tasks where `task` is empty.
    Columns in `carry` stay with their record.

    k consecutive places of the hashed order form a block (task, grp) of bounded size, whatever the size of the task. A block is cut
    in parts: a record that would exceed the budget of a part of two or more starts the next part. Every record is in exactly one part.
    -> task, grp, part, recs ARRAY<STRUCT<pos, key, text>> in order."""
    d = df.withColumn("_u", u8(purpose, key))
    d = with_rank(d, task, hash_bucket(F.col("_u")), [F.col("_u"), F.col(key)], "_r")
    d = d.withColumn("grp", F.floor((F.col("_r") - 1) / k)).withColumn("pos", F.pmod(F.col("_r") - 1, F.lit(k)))
    d = d.groupBy(*task, "grp").agg(F.array_sort(F.collect_list(F.struct(F.col("pos"), F.col(key).alias("key"), F.col(text).alias("text"), *carry))).alias("_all"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("chars"), F.array().cast("array<int>").alias("parts"))

    def step(s: Column, r: Column) -> Column:
        size = F.coalesce(F.length(r["text"]), F.lit(0))
        new = (s["n"] >= 2) & (s["chars"] + size > budget)
        last = F.coalesce(F.get(s["parts"], F.size(s["parts"]) - 1), F.lit(0))
        return F.struct(F.when(new, 1).otherwise(s["n"] + 1).alias("n"), F.when(new, size).otherwise(s["chars"] + size).alias("chars"),
                        F.array_append(s["parts"], last + new.cast("int")).alias("parts"))

    d = d.withColumn("_p", F.aggregate("_all", start, step, lambda s: s["parts"]))
    d = d.withColumn("part", F.explode(F.array_distinct("_p")))
    return d.withColumn("recs", F.filter("_all", lambda r, i: F.get("_p", i) == F.col("part"))).drop("_all", "_p")


def json_state(recs: Column, shape: Column) -> tuple[Column, Column]:
    """-> (JSON context, path of every record). Shapes: list, array, dict, nested."""
    as_list = F.transform(recs, lambda r, i: F.struct((i + 1).alias("id"), r["text"].alias("text")))
    texts = F.transform(recs, lambda r: r["text"])
    as_map = F.map_from_entries(F.transform(recs, lambda r, i: F.struct(F.concat(F.lit("r"), (i + 1).cast("string")).alias("k"), F.struct(r["text"].alias("text")).alias("v"))))
    state = (
        F.when(shape == "array", F.to_json(texts))
        .when(shape == "dict", F.to_json(F.struct(as_map.alias("items"))))
        .when(shape == "nested", F.to_json(F.struct(F.struct(as_list.alias("records")).alias("case"), F.lit("imported").alias("note"))))
        .otherwise(F.to_json(F.struct(as_list.alias("records"))))
    )
    paths = F.transform(recs, lambda r, i: F.when(shape == "array", F.concat(F.lit("["), i.cast("string"), F.lit("]")))
                        .when(shape == "dict", F.concat(F.lit("items.r"), (i + 1).cast("string"), F.lit(".text")))
                        .otherwise(F.concat(F.when(shape == "nested", "case.").otherwise(""), F.lit("records["), i.cast("string"), F.lit("].text"))))
    return state, paths


def mixed_state(recs: Column, shape: Column, container: Column, field: Column, containers: tuple[str, ...], fields: tuple[str, ...], channels: tuple[str, ...], top: str = "batch") -> tuple[Column, Column]:
    """-> (JSON context, path of every record's text) of records (key, text, ...) of any tasks, with noise fields beside the text.

    Shapes: array (of texts), dict (record names as keys), nested (under `top`), list. `container` and `field` are one of `containers` and `fields`. Noise is hashed per record: an
    id in 60%, a day in 30%, a channel in 25%. to_json leaves fields that are null out, so records differ in shape."""

    def record(r: Column, i: Column) -> Column:
        day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), pick_index(u8("noise_day", r["key"]), 365)), "yyyy-MM-dd")
        noise = [
            F.when(chance(u8("noise_id", r["key"]), 0.6), F.concat(F.lit("r"), (i + 1).cast("string"))).alias("id"),
            F.when(chance(u8("noise_ts", r["key"]), 0.3), day).alias("day"),
            F.when(chance(u8("noise_channel", r["key"]), 0.25), F.get(F.array(*[F.lit(c) for c in channels]), pick_index(u8("channel", r["key"]), len(channels)))).alias("channel"),
        ]
        return F.struct(*noise, *[F.when(field == f, F.coalesce(r["text"], F.lit(""))).alias(f) for f in fields])

    held = lambda value: [F.when(container == c, value).alias(c) for c in containers]
    name = lambda i: F.concat(F.lit("x"), (i + 1).cast("string"))
    as_list = F.transform(recs, record)
    as_map = F.map_from_entries(F.transform(recs, lambda r, i: F.struct(name(i).alias("k"), record(r, i).alias("v"))))
    state = (
        F.when(shape == "array", F.to_json(F.transform(recs, lambda r: F.coalesce(r["text"], F.lit("")))))
        .when(shape == "dict", F.to_json(F.struct(*held(as_map))))
        .when(shape == "nested", F.to_json(F.struct(F.struct(*held(as_list)).alias(top), F.lit("imported").alias("note"))))
        .otherwise(F.to_json(F.struct(*held(as_list))))
    )

    def path(i: Column) -> Column:
        place = F.concat(F.lit("["), i.cast("string"), F.lit("]"))
        inside = F.concat(F.when(shape == "nested", f"{top}.").otherwise(""), container, F.when(shape == "dict", F.concat(F.lit("."), name(i))).otherwise(place), F.lit("."), field)
        return F.when(shape == "array", place).otherwise(inside)

    return state, F.transform(recs, lambda r, i: path(i))


def path_questions(recs: Column, paths: Column, n: int, forms: tuple[str, ...], *key) -> Column:
    """Up to n questions about different records of a state, in hashed order: ARRAY<STRUCT<place, text, options, gold>>.

    recs carry their question as `ask`, `options`, `gold`; forms are formats of (question, path)."""
    order = F.array_sort(F.transform(recs, lambda r, i: F.struct(u8("path_q", *key, r["key"]).alias("u"), i.alias("i"))))
    chosen = F.transform(F.slice(order, 1, n), lambda o: o["i"])

    def one(i: Column) -> Column:
        r, p = F.get(recs, i), F.concat(F.lit("`"), F.get(paths, i), F.lit("`"))
        said = F.get(F.array(*[F.format_string(f, r["ask"], p) for f in forms]), pick_index(u8("form", *key, r["key"]), len(forms)))
        return F.struct(i.alias("place"), said.alias("text"), r["options"].alias("options"), r["gold"].alias("gold"))

    return F.transform(chosen, one)


def path_question(ask: Column, path: Column, form: Column) -> Column:
    p = F.concat(F.lit("`"), path, F.lit("`"))
    return F.when(form == 0, F.concat(ask, F.lit(" (about "), p, F.lit(")"))).when(form == 1, F.concat(F.lit("For "), p, F.lit(": "), ask)).otherwise(F.concat(p, F.lit(" - "), ask))


def index_array(arr: Column, min_len: int = ANNOTATE_MIN) -> Column:
    """JSON of a scalar array; from min_len elements on every element carries its position."""
    return F.when(F.size(arr) >= min_len, F.to_json(F.transform(arr, lambda x, i: F.struct(i.alias("_index"), x.alias("value"))))).otherwise(F.to_json(arr))


def _annotate(x, min_len: int):
    if isinstance(x, dict):
        return {k: _annotate(v, min_len) for k, v in x.items()}
    if not isinstance(x, list):
        return x
    inner = [_annotate(v, min_len) for v in x]
    if len(x) < min_len:
        return inner
    return [{"_index": i, **v} if isinstance(v, dict) else {"_index": i, "value": v} for i, v in enumerate(inner)]


def index_json(df: DataFrame, col: str, min_len: int = ANNOTATE_MIN) -> DataFrame:
    """Index annotation of JSON text of any nesting (Arrow batches: built-in functions need a schema).

    Text that is not JSON, that nests too deeply to be read, or that holds a number outside the double range is left as it is."""

    def finite(s):
        if not math.isfinite(x := float(s)):
            raise ValueError(s)
        return x

    def one(s):
        try:
            return json.dumps(_annotate(json.loads(s, parse_float=finite, parse_constant=finite), min_len), ensure_ascii=False, separators=(",", ":"))
        except (TypeError, ValueError, RecursionError):
            return s

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.copy()
            pdf[col] = pdf[col].map(one)
            yield pdf

    return df.mapInPandas(run, T.StructType(df.schema.fields))


# ---- abstention
def abstain_options(options: Column, gold: Column, foreign: Column, rate: float, replace_rate: float, *key) -> tuple[Column, Column, Column]:
    """-> (options, gold, kind) with kind keep / append / replace. `foreign`: a drawn list of another task's labels (`foreign_labels`).

    append: an abstain wording is offered, the answer stays. replace: every option comes from another task and
    abstaining is right. Lists that already offer an abstain option or have fewer than three options are kept."""
    wording = F.get(F.array(*[F.lit(w) for w in X.ABSTAIN_WORDINGS]), pick_index(u8("wording", *key), len(X.ABSTAIN_WORDINGS)))
    able = (F.size(options) >= 3) & ~F.exists(options, X.is_abstain) & chance(u8("abstain", *key), rate)
    replace = chance(u8("abstain_replace", *key), replace_rate)
    kind = F.when(~able, "keep").when(replace, "replace").otherwise("append")
    other = F.slice(foreign, F.lit(1), F.least(F.size(options), F.size(foreign)))
    opts = F.when(kind == "keep", options).when(kind == "append", F.concat(options, F.array(wording))).otherwise(F.concat(other, F.array(wording)))
    return opts, F.when(kind == "replace", F.size(other)).otherwise(gold).cast("int"), kind


def foreign_labels(df: DataFrame, key: str, task: Column, need: Column, pools: DataFrame, into: str = "foreign") -> DataFrame:
    """For every row up to `need` labels of one other task, drawn by hash -> df with `into`.

    pools (task, label). The tasks are a registry of at most a few hundred, carried as one array; labels may be any number: they are a ring of
    blocks met by an equi join. The key is unique. A row without another task gets an empty list."""
    ring = ring_blocks(pools.select(F.col("task").alias("_task"), "label"), ["_task"], "label", "foreign_order")
    tasks = pools.select("task").distinct().agg(F.array_sort(F.collect_list("task")).alias("t")).scalar()
    d = df.withColumn("_others", F.array_remove(tasks, task)).withColumn("_task", F.get("_others", pick_index(u8("other_task", key), F.size("_others"))))
    return ring_slice(d.drop("_others"), key, ["_task"], ring, place("foreign", key), need, into).drop("_task")


def offtopic_probe(options: Column, gold: Column, foreign: Column, *key) -> tuple[Column, Column]:
    """An abstain option in varied wording is offered; in half of the rows all other options are another task's labels and abstaining is right."""
    wording = F.array(F.get(F.array(*[F.lit(w) for w in X.ABSTAIN_WORDINGS]), pick_index(u8("wording", *key), len(X.ABSTAIN_WORDINGS))))
    off = chance(u8("offtopic", *key), 0.5)
    other = F.slice(foreign, F.lit(1), F.least(F.size(options), F.size(foreign)))
    return F.when(off, F.concat(other, wording)).otherwise(F.concat(options, wording)), F.when(off, F.size(other)).otherwise(gold).cast("int")


def abstain_probe(options: Column, gold: Column, *key) -> tuple[Column, Column]:
    """ "none of the above" is offered; in half of the rows the gold option is removed."""
    gone = chance(u8("abstain_probe", *key), 0.5)
    rest = F.filter(options, lambda o, i: i != gold)
    none = F.array(F.lit("none of the above"))
    return F.when(gone, F.concat(rest, none)).otherwise(F.concat(options, none)), F.when(gone, F.size(rest)).otherwise(gold).cast("int")


def question_subset(qs: Column, *key) -> Column:
    """One question (60%) or a hashed subset of at least one."""
    ranked = F.array_sort(F.transform(qs, lambda q, i: F.struct(u8("subset", *key, i).alias("u"), i.alias("i"))))
    n = F.when(chance(u8("subset_one", *key), 0.6), 1).otherwise(1 + pick_index(u8("subset_n", *key), F.size(qs)))
    keep = F.transform(F.slice(ranked, F.lit(1), n), lambda s: s["i"])
    return F.filter(qs, lambda q, i: F.array_contains(keep, i))


def isolated_question(ask: Column, level: Column) -> Column:
    return F.when(ask.isNotNull() & level.isNotNull(), F.format_string(ISOLATED, ask, X.strip_level(level)))


def isolated_rows(df: DataFrame, ask: Column, options: Column, gold: Column) -> DataFrame:
    """One yes/no row per option, without its number or its neighbours; yes only for the gold one."""
    d = df.withColumn("_q", ask).withColumn("_g", gold).select("*", F.posexplode(options).alias("level", "_o"))
    return d.withColumn("text", isolated_question(F.col("_q"), F.col("_o"))).withColumn("gold", (F.col("level") == F.col("_g")).cast("int")).drop("_q", "_g", "_o")
