"""Conversion of tables into the decision format.

An example is a row with `context` and `qs ARRAY<STRUCT<text, options, gold>>`; the long form has one
question per row. Every converter is a projection and a filter unless noted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adjudica.functions import text as X
from adjudica.functions.hashing import chance, hash_sort, pick_index, place, u8
from adjudica.operators.ranking import hash_bucket, ring_blocks, ring_slice, with_rank

NO_CALL = "no function call needed"


def question(text: Column | str, options: Column, gold: Column) -> Column:
    t = F.lit(text) if isinstance(text, str) else text
    return F.struct(t.alias("text"), options.alias("options"), gold.cast("int").alias("gold"))


def strings(*vals: str) -> Column:
    return F.array(*[F.lit(v) for v in vals])


def to_long(examples: DataFrame, keep: list[str]) -> DataFrame:
    """One question per row."""
    e = examples.select(*keep, F.posexplode("qs").alias("qidx", "q"))
    return e.select(*keep, "qidx", F.col("q.text").alias("text"), F.col("q.options").alias("options"), F.col("q.gold").alias("gold"))


def classify(df: DataFrame, text: Column, label: Column, ask: str, names: Column, task: str) -> DataFrame:
    """Single-label classification; rows without a usable label or text are dropped."""
    d = df.withColumn("context", X.strip(text)).withColumn("_y", label.cast("int"))
    d = d.filter(F.col("_y").isNotNull() & (F.col("_y") >= 0) & (F.col("_y") < F.size(names)) & (F.col("context") != ""))
    return d.withColumn("qs", F.array(question(ask, names, F.col("_y")))).withColumn("task", F.lit(task)).drop("_y")


def multiple_choice(df: DataFrame, context: Column, options: Column, gold: Column, ask: str, task: str) -> DataFrame:
    """Ragged options with an index gold; drops bad golds, fewer than two options and blank contexts."""
    d = df.withColumn("context", X.strip(context)).withColumn("_o", F.transform(options, X.strip)).withColumn("_y", gold.cast("int"))
    d = d.filter(F.col("_y").between(0, F.size("_o") - 1) & (F.size("_o") >= 2) & (F.col("context") != ""))
    return d.withColumn("qs", F.array(question(ask, F.col("_o"), F.col("_y")))).withColumn("task", F.lit(task)).drop("_o", "_y")


def single_part(df: DataFrame, parts: str, into: str) -> tuple[DataFrame, DataFrame]:
    """-> (rows with exactly one attached part, carried as the binary column `into`), (the other rows with a reason). parts: ARRAY<BINARY>."""
    n = F.coalesce(F.size(parts), F.lit(0))
    good = df.filter(n == 1).withColumn(into, F.get(parts, F.lit(0))).drop(parts)
    return good, df.filter(n != 1).withColumn("reason", F.concat(F.greatest(n, F.lit(0)).cast("string"), F.lit(" parts, 1 is needed"))).drop(parts)


def letter_index(letter: Column) -> Column:
    """'A' -> 0, 'B' -> 1, ..."""
    return F.ascii(F.upper(letter)) - 65


def label_vocabulary(df: DataFrame, cols: list[str]) -> DataFrame:
    """Sorted distinct labels and their index per column. Labels are ranked in buckets of their first three characters, so a field of any number of labels
    is spread."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("label")) for c in cols])
    distinct = df.select(F.inline(pairs)).filter(F.col("label").isNotNull()).distinct()
    ranked = with_rank(distinct, ["field"], F.substring("label", 1, 3), [F.col("label")], "_r")
    return ranked.select("field", (F.col("_r") - 1).cast("int").alias("idx"), "label")


def shuffle_options(options: Column, gold: Column, *key) -> tuple[Column, Column]:
    """Options in a hashed order and the gold that follows its option."""
    shuffled = hash_sort(options, "shuffle", *key)
    return shuffled, (F.array_position(shuffled, F.get(options, gold)) - 1).cast("int")


def scale_options(legend: Column) -> tuple[Column, Column]:
    """MAP level -> label -> (numeric keys in order, 'k: label' options)."""
    entries = F.array_sort(F.transform(F.map_entries(legend), lambda e: F.struct(e["key"].cast("double").alias("n"), e["key"].alias("k"), e["value"].alias("v"))))
    return F.transform(entries, lambda e: e["k"]), F.transform(entries, lambda e: F.concat(e["k"].cast("string"), F.lit(": "), e["v"]))


def split_last(text: Column, marker: str) -> tuple[Column, Column]:
    """Text before and after the last occurrence of a marker; NULL when it does not occur."""
    rx = rf"(?s)^(.*){marker}(.*)$"
    has = text.rlike(rx)
    return F.when(has, X.strip(F.regexp_extract(text, rx, 1))), F.when(has, X.strip(F.regexp_extract(text, rx, 2)))


def preference(better: Column, first: Column, second: Column, *key) -> tuple[Column, Column, Column]:
    """Swap the two responses on a hashed coin so that position carries no signal.

    better: 0 first, 1 second, 2 tie. -> (response A, response B, gold)"""
    flip = chance(u8("flip", *key), 0.5)
    gold = F.when((better == 2) | ~flip, better).otherwise(1 - better)
    return F.when(flip, second).otherwise(first), F.when(flip, first).otherwise(second), gold.cast("int")


def last_k(df: DataFrame, group: list[str], step: str, value: str, k: int, include_self: bool = False, into: str = "history", chunk: int = 512) -> DataFrame:
    """The values of the last k steps before every step, in order. `step` is a whole number that rises in its group; steps that are missing count as empty.

    A group is cut in chunks of `chunk` steps. The last k steps of a chunk are also handed to the next one as a halo, so every row is shuffled once
    (and k in `chunk` of them twice), and one window per chunk sees all it needs, whatever the length of the group."""
    size = max(chunk, 2 * k)
    here = F.floor(F.col(step) / size)
    near_end = F.pmod(F.col(step), F.lit(size)) >= size - k
    d = df.withColumn("_home", here).withColumn("_chunk", F.explode(F.when(near_end, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home"))))
    frame = Window.partitionBy(*group, "_chunk").orderBy(step).rangeBetween(*((1 - k, 0) if include_self else (-k, -1)))
    d = d.withColumn(into, F.collect_list(value).over(frame))
    return d.filter(F.col("_chunk") == F.col("_home")).drop("_home", "_chunk")


def next_actions(steps: DataFrame, key: list[str], episode: str, env: str, action: str, own: int, others: int, want: int, keep: Column) -> DataFrame:
    """Kept steps of episodes of at least two -> their columns, history (the last three actions) and candidates: up to `want` different actions other than their own.

    steps: one row a step with `step` (from 1) and n (steps of the episode). `own` candidates are probed in the episode and `others` in the pool of all actions of the same
    environment, each by a hashed place and an equi join on a dense index; the environments are a registry, their sizes one map."""
    pool = with_rank(steps.select(*key, env, action).withColumn("_u", u8("apool", *key)), [env], hash_bucket(F.col("_u")), [F.col("_u"), *[F.col(k) for k in key]], "_rn")
    sizes = steps.filter(F.col(env).isNotNull()).groupBy(env).agg(F.count(F.lit(1)).alias("c")).agg(F.map_from_entries(F.collect_list(F.struct(env, "c"))).alias("m")).scalar()
    s = last_k(steps, [episode], "step", action, 3).filter((F.col("n") >= 2) & keep).withColumn("_total", F.element_at(sizes, F.col(env)))
    j = s.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(max(own, others) - 1))))
    j = j.withColumn("_rn", F.when(F.col("_j") < others, 1 + F.pmod(place("pool", *key, "_j"), F.col("_total"))))
    j = j.withColumn("_probe", F.when(F.col("_j") < own, 1 + F.pmod(F.col("step") + pick_index(u8("own", *key, "_j"), F.col("n") - 1), F.col("n"))))
    mine = steps.select(episode, F.col("step").alias("_probe"), F.col(action).alias("_own"))
    j = j.join(mine, [episode, "_probe"], "left").join(pool.select(env, "_rn", F.col(action).alias("_other")), [env, "_rn"], "left")
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("_j", F.col(c).alias("v")))), lambda x: x["v"])
    kept = [*key, env, action, "history"]
    g = j.groupBy(*kept).agg(ordered("_own").alias("_own"), ordered("_other").alias("_other"))
    picked = F.slice(F.array_remove(F.array_distinct(F.array_compact(F.concat("_own", "_other"))), F.col(action)), 1, want)
    return g.select(*kept, picked.alias("candidates"))


def pool_slice(df: DataFrame, key: str, pool: DataFrame, value: str, k: int, into: str = "picked") -> DataFrame:
    """min(k, size) different neighbours of a pool of distinct values in hashed order, from a hashed start per row (a circular slice)."""
    return ring_slice(df, key, [], ring_blocks(pool, [], value, "pool_order"), place("pool", key), F.lit(k), into)


def tool_options(own: Column, others: Column, called: Column, k: int, *key) -> tuple[Column, Column]:
    """Own functions padded from others to k - 1 names, shuffled, "no function call needed" last."""
    names = F.slice(F.array_union(own, others), 1, F.greatest(F.size(own), F.lit(k - 1)))
    options = F.concat(hash_sort(names, "tools", *key), F.array(F.lit(NO_CALL)))
    pos = F.array_position(options, called)
    return options, F.when(F.coalesce(pos, F.lit(0)) > 0, pos - 1).otherwise(F.size(options) - 1).cast("int")


# Fixed value: the attributes that describe an element, in this order.
ELEMENT_KEYS = ("aria_label", "aria-label", "title", "alt", "placeholder", "name", "value", "type", "role", "id", "class")


def element_desc(tag: Column, attributes: Column) -> Column:
    """'tag k=v ...' of the describing attributes, 40 characters per value and 120 in all."""
    attrs = F.from_json(attributes, "map<string,string>")
    bits = [F.when(F.coalesce(attrs[k], F.lit("")) != "", F.concat(F.lit(f"{k}="), F.substring(attrs[k], 1, 40))) for k in ELEMENT_KEYS]
    return F.substring(F.concat_ws(" ", tag, *bits), 1, 120)


# Fixed value: a lettered option line.
LETTER_LINE = r"^([A-J])\.\s*(.+)$"


def letter_choice(user: Column, answer: Column) -> tuple[Column, Column, Column]:
    """'A. x' lines and 'Answer: B' -> (question, options, gold); gold is NULL for a rejected row."""
    lines = F.transform(F.split(user, "\n"), X.strip)
    picked = F.filter(lines, lambda l: l.rlike(LETTER_LINE))
    letters = F.transform(picked, lambda l: F.regexp_extract(l, LETTER_LINE, 1))
    options = F.transform(picked, lambda l: F.regexp_replace(X.strip(F.regexp_extract(l, LETTER_LINE, 2)), r"\.+$", ""))
    ask = F.get(F.filter(lines, lambda l: l.startswith("Question:")), 0)
    letter = F.regexp_extract(answer, r"Answer:\s*([A-J])", 1)
    pos = F.array_position(letters, letter)
    gold = F.when((F.size(options) >= 2) & (letter != "") & (pos > 0), (pos - 1).cast("int"))
    return X.strip(F.substring(ask, 10, 1 << 30)), options, gold


def yes_no_gold(answer: Column) -> Column:
    a = F.lower(X.strip(answer))
    return F.when(a.startswith("yes"), 1).when(a.startswith("no"), 0)


def comma_choice(user: Column, answer: Column) -> tuple[Column, Column]:
    """'Options: a, b, c.' and an option as the answer."""
    raw = F.regexp_extract(user, r"(?s)Options:\s*(.+)$", 1)
    opts = F.filter(F.transform(F.split(raw, ","), lambda o: F.regexp_replace(X.strip(o), r"\.+$", "")), lambda o: o != "")
    ans = F.lower(X.strip(F.regexp_replace(X.strip(answer), r"\.+$", "")))
    pos = F.array_position(F.transform(opts, F.lower), ans)
    return opts, F.when((F.size(opts) >= 2) & (pos > 0), (pos - 1).cast("int"))


def annotator_mean(df: DataFrame, item: str, attributes: dict[str, Column], lo: int, hi: int) -> DataFrame:
    """Per-item mean of every attribute, rounded half to even and clamped; items missing an attribute are dropped."""
    means = df.groupBy(item).agg(*[F.avg(c).alias(k) for k, c in attributes.items()]).dropna(subset=list(attributes))
    clamp = lambda c: F.least(F.lit(hi), F.greatest(F.lit(lo), F.bround(c, 0))).cast("int")
    return means.select(item, *[clamp(F.col(k)).alias(k) for k in attributes])


def pick_relevant(df: DataFrame, query: list[str], item: str, selected: Column) -> DataFrame:
    """Half of the queries get their first selected item, half a hashed unselected one.

    Two minima per query: no list of its items is built."""
    d = df.withColumn("_s", selected).withColumn("_u", u8("unselected", *query, item))
    a = d.groupBy(*query).agg(
        F.min(F.when(F.col("_s"), F.col(item))).alias("_pos"),
        F.min(F.when(~F.col("_s"), F.struct("_u", item))).alias("_neg"),
    ).filter(F.col("_pos").isNotNull())
    take = chance(u8("relevant", *query), 0.5) | F.col("_neg").isNull()
    return a.select(*query, F.when(take, F.col("_pos")).otherwise(F.col(f"_neg.{item}")).alias(item), take.cast("int").alias("gold"))
