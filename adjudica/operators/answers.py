"""Answer assembly: temperatures, isolated levels, confidences, typed answers, routing and beams."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adjudica.functions import dist as D
from adjudica.sources.tables import materialise

TYPES = ("choice", "noul", "score")
SALTS = 64


# ---- temperature resolution
def _positive(v, where: str) -> float:
    if isinstance(v, bool) or not isinstance(v, (int, float)) or not math.isfinite(v) or v <= 0:
        raise ValueError(f"{where} must be a finite number > 0")
    return float(v)


def _type_map(m, where: str) -> dict[str, float]:
    m = m or {}
    unknown = set(m) - set(TYPES)
    if unknown:
        raise ValueError(f"{where}: unknown answer types {sorted(unknown)}")
    return {k: _positive(v, f"{where}[{k}]") for k, v in m.items()}


def resolve_temperature(kind: Column, layout: Column, n_options: Column, config: dict, override: float | None = None) -> Column:
    """The temperature of an answer as one expression.

    state-first: by options, else by type, else the scalar. schema-first: its own by-type map, else its
    scalar, else the state-first value of the type. An override replaces the scalar and switches the
    state-first maps off."""
    by_type = _type_map(config.get("temperature_by_type"), "temperature_by_type")
    schema_by_type = _type_map(config.get("temperature_schema_first_by_type"), "temperature_schema_first_by_type")
    options = config.get("temperature_by_options")
    base = _positive(override if override is not None else config.get("temperature", 1.0), "temperature")
    if override is not None:
        by_type, options = {}, None
    if options is not None and by_type:
        raise ValueError("temperature_by_options and temperature_by_type cannot both be set")

    def lookup(m: dict[str, float], default: Column) -> Column:
        out = F.lit(None).cast("double")
        for k, v in m.items():
            out = F.coalesce(out, F.when(kind == k, F.lit(v)))
        return F.coalesce(out, default)

    plain = lookup(by_type, F.lit(base))
    state = plain
    if options is not None:
        state = D.t_of_options(n_options, float(options["a"]), float(options["b"]), _positive(options.get("min", 0.05), "min"))
    scalar = config.get("temperature_schema_first")
    schema = lookup(schema_by_type, F.lit(_positive(scalar, "temperature_schema_first")) if scalar is not None else plain)
    return F.when(layout == "schema_first", schema).otherwise(state)


# ---- isolated levels
def combine_levels(p_yes: Column) -> Column:
    """Per-level P(fits) -> a distribution over levels; a zero mass divides by 1e-9."""
    return D.let(D.asum(p_yes), lambda s: F.transform(p_yes, lambda x: x / F.when(s == 0, 1e-9).otherwise(s)))


def combine_isolated(level_rows: DataFrame, key: list[str], level: str = "level", p_yes: str = "p_yes") -> DataFrame:
    """Level rows (at most ten per key) -> level_fit, fit_mass and the combined distribution."""
    fit = F.transform(F.array_sort(F.collect_list(F.struct(F.col(level), F.col(p_yes)))), lambda s: s[p_yes])
    return (
        level_rows.groupBy(*key).agg(fit.alias("level_fit"))
        .withColumn("fit_mass", D.asum(F.col("level_fit")))
        .withColumn("probs", combine_levels(F.col("level_fit")))
    )


# ---- typed answers
def format_answer(kind: Column, names: Column, probs: Column, legend: Column | None = None, level_fit: Column | None = None) -> Column:
    """The answer of a question as one struct; fields that do not belong to its type are NULL.

    legend: the levels' descriptions of a score. level_fit: P(fits) of every level that was asked on its own; their sum is fit_mass."""
    no = F.lit(None).cast("array<string>")
    legend = no if legend is None else legend
    level_fit = no.cast("array<double>") if level_fit is None else level_fit
    numbered = lambda a: F.map_from_arrays(F.transform(a, lambda _, i: i.cast("string")), a)
    r4 = lambda c: F.round(c, 4)

    def body(p: Column) -> Column:
        is_noul, is_choice, is_score = kind == "noul", kind == "choice", kind == "score"
        conf = F.when(is_choice, D.choice_confidence(p)).when(is_score, D.score_confidence(p))
        return F.struct(
            kind.alias("type"),
            F.when(is_choice, F.get(names, D.argmax(p))).alias("choice"),
            F.when(is_noul, r4(D.at(p, 1))).alias("noul"),
            F.when(is_score, F.round(D.expected_level(p), 2)).alias("score"),
            r4(conf).alias("confidence"),
            F.when(~is_noul, r4(F.array_max(p))).alias("x_p_max"),
            F.when(~is_noul, r4(D.certainty(p))).alias("certainty"),
            F.when(~is_noul, F.map_from_arrays(names, F.transform(p, r4))).alias("probabilities"),
            F.when(is_score, numbered(legend)).alias("legend"),
            F.when(is_score, numbered(F.transform(level_fit, r4))).alias("level_fit"),
            F.when(is_score, r4(D.asum(level_fit))).alias("fit_mass"),
        )

    return D.let(D.scale_to_one(F.slice(probs, 1, F.size(names))), body)


def assemble(rows: DataFrame, key: list[str], question: str) -> DataFrame:
    """Scored rows of mixed kinds, in any order -> key, question, answer: one typed answer a question.

    Columns: kind (iso: one yes/no row a level; list: the question itself), row_idx, type, names, legend, probs. An answer folds the
    rows of one question (at most ten levels), so the aggregation is by (key, question) and a request of any size is spread."""
    parts = F.array_sort(F.collect_list(F.struct("row_idx", "probs")))
    same = {c: F.any_value(c).alias(c) for c in ("kind", "type", "names", "legend")}  # equal on all rows of a question
    d = rows.groupBy(*key, question).agg(parts.alias("_parts"), *same.values())
    iso = F.col("kind") == "iso"
    d = d.withColumn("_fit", F.when(iso, F.transform("_parts", lambda r: F.get(r["probs"], F.lit(1)))))
    d = d.withColumn("_p", F.when(iso, combine_levels(F.col("_fit"))).otherwise(F.get("_parts", F.lit(0))["probs"]))
    return d.select(*key, question, format_answer(F.col("type"), F.col("names"), F.col("_p"), F.col("legend"), F.col("_fit")).alias("answer"))


def answer_maps(answers: DataFrame, key: list[str], question: str, most: int) -> tuple[DataFrame, DataFrame]:
    """-> (key, answers MAP<question, answer>, in order of the questions), (key, n, reason) of requests with more than `most` answers.

    The map is one value, so a request must be of a checked size before it is gathered."""
    sizes = answers.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    fits = answers.join(sizes.filter(F.col("n") <= most).drop("n"), key)
    by_question = lambda a, b: F.when(a[question] < b[question], -1).when(a[question] > b[question], 1).otherwise(0)
    maps = fits.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(question, "answer")), by_question)).alias("answers"))
    return maps, sizes.filter(F.col("n") > most).withColumn("reason", F.concat(F.lit("too many answers: "), F.col("n").cast("string"), F.lit(f", the limit is {most}")))


def format_schema_answer(kind: Column, names: Column, levels: Column, probs: Column, abstain_below: float = 0.0) -> Column:
    """The typed-schema form: the confidence of a choice or scale is its top probability."""
    top = F.array_max(probs)
    return F.struct(
        F.when(kind == "bool", "noul").otherwise(kind).alias("type"),
        F.when((kind == "choice") & (top >= abstain_below), F.get(names, D.argmax(probs))).alias("choice"),
        F.when(kind == "bool", F.round(D.at(probs, 1), 4)).alias("noul"),
        F.when(kind == "scale", F.round(D.expected_level(probs, levels), 2)).alias("score"),
        F.when(kind != "bool", F.round(top, 4)).alias("confidence"),
    )


def abstain_below(names: Column, probs: Column, t: float) -> Column:
    """The chosen name, or NULL when its probability is below t."""
    return F.when(F.array_max(probs) >= t, F.get(names, D.argmax(probs)))


def second_reading(probs: Column, reversed_logits: Column, t1: Column | float, below: float, a: float, b: float, lo: float = 0.05) -> Column:
    """Average the first reading with one in reversed option order when the top probability is below a bound."""
    t1 = F.lit(float(t1)) if isinstance(t1, (int, float)) else t1
    first = D.log_softmax(F.transform(probs, lambda x: t1 * F.log(F.greatest(x, F.lit(1e-30)))))
    second = D.log_softmax(F.reverse(reversed_logits))
    mean = F.zip_with(first, second, lambda x, y: (x + y) / 2)
    return F.when(F.array_max(probs) < below, D.softmax(mean, D.t_of_options(F.size(probs), a, b, lo))).otherwise(probs)


def join_slices(slices: DataFrame, key: list[str], order: str, values: str, into: str = "logits") -> DataFrame:
    """Slices of one wide row (at most 255 options) joined back in order."""
    packed = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(values))))
    return slices.groupBy(*key).agg(F.flatten(F.transform(packed, lambda s: s[values])).alias(into))


# ---- uses of answers
def gated_routing(answers: DataFrame, policy: DataFrame, choice: str, p_max: str, unsure_below: float) -> DataFrame:
    """Route by outcome: `policy` holds (choice, needs, action, fallback); answers below `unsure_below` go to a person."""
    d = answers.join(policy, choice, "left")
    return d.withColumn(
        "route",
        F.when(F.col(p_max) < unsure_below, "human").when(F.col(p_max) > F.coalesce("needs", F.lit(0.0)), F.coalesce("action", F.col(choice)))
        .otherwise(F.coalesce("fallback", F.col(choice))),
    )


def composite_score(scores: DataFrame, weights: DataFrame, key: list[str], question: str = "question") -> DataFrame:
    """Sum of weight * score / (levels - 1) over the weighted questions of a key."""
    return scores.join(weights, question).groupBy(*key).agg(F.sum(F.col("weight") * F.col("score") / (F.col("levels") - 1)).alias("priority"))


def beam_classify(states: DataFrame, edges: DataFrame, key: str, weight, beam: int, depth: int, root: str = "root", most_edges: int = 1 << 16) -> DataFrame:
    """Walk a label tree keeping the `beam` most probable paths of every state -> key, path, prob.

    `weight(key_col, child_col)` is the unnormalised score of a child; siblings are normalised; ties go to the smaller child. A tree of at most `most_edges`
    edges travels as one map and a state's beam is folded in its row: no shuffle at all. A larger tree is met by joins, level by level,
    with the same result. A path that ends before `depth` is dropped."""
    edges = materialise(edges.select("parent", "child").distinct(), "edges")
    if edges.count() > most_edges:
        return beam_by_joins(states, edges, key, weight, beam, depth, root)
    tree = edges.groupBy("parent").agg(F.array_sort(F.collect_list("child")).alias("c")).agg(F.map_from_entries(F.collect_list(F.struct("parent", "c"))).alias("t"))
    d = states.select(key).withColumn("_tree", tree.scalar())
    paths = F.array(F.struct(F.lit(root).alias("node"), F.lit("").alias("path"), F.lit(1.0).alias("prob")))
    for level in range(depth):
        def grown(p: Column) -> Column:
            children = F.transform(F.coalesce(F.element_at("_tree", p["node"]), F.array().cast("array<string>")), lambda c: F.struct(c.alias("c"), weight(F.col(key), c).cast("double").alias("w")))
            total = lambda cs: D.asum(F.transform(cs, lambda x: x["w"]))
            return D.let(children, lambda cs: D.let(total(cs), lambda s: F.transform(cs, lambda x: F.struct(
                x["c"].alias("node"), F.concat_ws("/", F.nullif(p["path"], F.lit("")), x["c"]).alias("path"), (p["prob"] * x["w"] / s).alias("prob")))))

        ranked = F.sort_array(F.transform(F.flatten(F.transform(paths, grown)), lambda p: F.struct((-p["prob"]).alias("less"), *[p[c].alias(c) for c in ("node", "path", "prob")])))
        d = d.withColumn("_paths", F.slice(ranked, 1, 1 if level == depth - 1 else beam))
        paths = F.col("_paths")
    # an inner explode is preceded by a filter on the size of its array, for which the whole beam would be folded again
    return d.select(key, F.explode_outer("_paths").alias("p")).filter(F.col("p").isNotNull()).select(key, "p.path", "p.prob")


def beam_by_joins(states: DataFrame, edges: DataFrame, key: str, weight, beam: int, depth: int, root: str = "root") -> DataFrame:
    """beam_classify for a tree of any size. Every node's children are copied to SALTS keys, over which the states that reach the node are dealt."""
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    children = edges.select(F.col("parent").alias("node"), "child").withColumn("salt", salts)
    paths = states.select(key, F.lit(root).alias("node"), F.lit("").alias("path"), F.lit(1.0).alias("prob"))
    for level in range(depth):
        cand = paths.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS))).join(children, ["node", "salt"]).drop("salt")
        cand = cand.withColumn("w", weight(F.col(key), F.col("child")))
        total = F.sum("w").over(Window.partitionBy(key, "node"))
        cand = cand.withColumn("prob", F.col("prob") * F.col("w") / total)
        keep = 1 if level == depth - 1 else beam
        rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("prob").desc(), F.col("child")))
        sep = "/" if level else ""
        paths = cand.withColumn("r", rank).filter(F.col("r") <= keep).select(
            key, F.col("child").alias("node"), F.concat("path", F.lit(sep), F.col("child")).alias("path"), "prob")
    return paths.select(key, "path", "prob")
