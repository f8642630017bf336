"""Requests: rendering, row planning, prompts, size limits, shared prefixes and repeated schemas.

A question spec is a row with type, instructions, names ARRAY<STRING>, descs ARRAY<STRING> and isolated BOOLEAN.
choice: names and their descriptions; score: descs are the levels; noul: descs are [false, true]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adjudica.functions import text as X
from adjudica.operators.augment import index_json, isolated_question

MAX_CHOICE, MAX_LEVELS, NARROW = 255, 10, 10
NOUL_DEFAULT = "Which answer fits the context?"


# ---- states and questions
def render_state(df: DataFrame, state: str, is_json: Column) -> DataFrame:
    """Text stays as it is; JSON states get index annotations in their long arrays."""
    text = df.filter(~is_json)
    return text.unionByName(index_json(df.filter(is_json), state).select(*df.columns))


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def question_reason(kind: Column, instructions: Column, names: Column, descs: Column) -> Column:
    """Why a spec is rejected, or NULL."""
    noul = kind.isin("noul", "bool")
    described = F.exists(F.coalesce(descs, F.array().cast("array<string>")), lambda d: ~_blank(d))
    return (
        F.when(~kind.isin("choice", "score", "noul", "bool"), "unknown question type")
        .when(noul & _blank(instructions) & ~described, "noul question without instructions: describe true or false")
        .when(~noul & _blank(instructions), "question without instructions")
        .when((kind == "choice") & ~F.coalesce(F.size(names).between(2, MAX_CHOICE), F.lit(False)), "choice criteria: 2 to 255 options")
        .when((kind == "score") & ~F.coalesce(F.size(descs).between(2, MAX_LEVELS), F.lit(False)), "score criteria: 2 to 10 levels")
    )


def _described(name: Column, desc: Column) -> Column:
    return F.when(_blank(desc), name).otherwise(F.concat(name, F.lit(": "), desc))


def render_question(kind: Column, instructions: Column, names: Column, descs: Column, isolated: Column) -> Column:
    """An accepted spec as STRUCT<question, options, type, names, legend, isolated>."""
    noul = kind.isin("noul", "bool")
    yes_no = F.array(_described(F.lit("no"), F.get(descs, F.lit(0))), _described(F.lit("yes"), F.get(descs, F.lit(1))))
    levels = F.transform(descs, lambda d, i: F.concat(i.cast("string"), F.lit(": "), d))
    options = F.when(noul, yes_no).when(kind == "score", levels).otherwise(F.zip_with(names, descs, _described))
    shown = F.when(noul, F.array(F.lit("false"), F.lit("true"))).when(kind == "score", F.transform(descs, lambda d, i: i.cast("string"))).otherwise(names)
    return F.struct(
        F.when(noul & _blank(instructions), F.lit(NOUL_DEFAULT)).otherwise(instructions).alias("question"),
        options.alias("options"),
        F.when(noul, "noul").otherwise(kind).alias("type"),
        shown.alias("names"),
        F.when(kind == "score", descs).alias("legend"),
        F.coalesce(isolated, F.lit(True)).alias("isolated"),
    )


def split_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """-> (rows with the rendered question `rq`, rejected rows with a reason)."""
    cols = [F.col(c) for c in ("type", "instructions", "names", "descs")]
    d = requests.withColumn("reason", question_reason(*cols))
    good = d.filter(F.col("reason").isNull()).drop("reason").withColumn("rq", render_question(*cols, F.col("isolated")))
    return good, d.filter(F.col("reason").isNotNull())


def plan_rows(good: DataFrame, isolated_levels: bool = True) -> DataFrame:
    """Scoring rows: an isolated score has one yes/no row per level, any other question one row.

    Every row carries its place and the answer type, so no positional index is needed later."""
    rq = F.col("rq")
    iso = (rq["type"] == "score") & rq["isolated"] & F.lit(isolated_levels)
    yes_no = F.array(F.lit("no"), F.lit("yes"))
    level_rows = F.transform(rq["legend"], lambda l: F.struct(isolated_question(rq["question"], l).alias("text"), yes_no.alias("options")))
    rows = F.when(iso, level_rows).otherwise(F.array(F.struct(rq["question"].alias("text"), rq["options"].alias("options"))))
    d = good.withColumn("kind", F.when(iso, "iso").otherwise("list")).withColumn("row_type", rq["type"]).withColumn("n_rows", F.size(rows))
    return d.select("*", F.posexplode(rows).alias("row_idx", "row"))


# ---- orders
VARIANTS = ("packed", "reversed", "alone")


def order_variants(requests: DataFrame, qs: str = "qs") -> DataFrame:
    """Every request with its questions as given (packed), in reverse order, and one by one (alone) -> variant, perm, qs.

    perm[j] is the place in the request of the variant's question j; it travels with the row, so answers find their questions again
    after any scoring. Requests without questions have no variants."""
    n = F.size(qs)
    forward = F.sequence(F.lit(0), n - 1)
    one = lambda name, perm: F.struct(F.lit(name).alias("variant"), perm.alias("perm"))
    orders = F.concat(F.array(one("packed", forward), one("reversed", F.reverse(forward))), F.transform(forward, lambda i: one("alone", F.array(i))))
    d = requests.filter(n > 0).select("*", F.inline(orders))
    return d.withColumn(qs, F.transform("perm", lambda i: F.get(F.col(qs), i)))


def realign(scored: DataFrame, key: list[str], values: str) -> DataFrame:
    """One row a request: columns packed, reversed, alone, each with the values in the order of the request's own questions.

    The inverse of perm is a sort by it. A request's questions are few (its limits), and all variants meet in one exchange."""
    pairs = F.transform(F.arrays_zip(F.col("perm").alias("i"), F.col(values).alias("v")), lambda p: F.struct(p["i"].alias("i"), p["v"].alias("v")))
    aligned = [F.transform(F.array_sort(F.flatten(F.collect_list(F.when(F.col("variant") == v, pairs)))), lambda p: p["v"]).alias(v) for v in VARIANTS]
    return scored.groupBy(*key).agg(*aligned)


# ---- prompts
def option_label(i: Column) -> Column:
    """A..Z, then AA, AB, ..."""
    j = i - 26
    return F.when(i < 26, F.char(i + 65)).otherwise(F.concat(F.char(F.floor(j / 26) + 65), F.char(j % 26 + 65)))


def question_block(q: Column, k: Column, multi: Column) -> Column:
    num = F.when(multi, F.concat(F.lit(" "), (k + 1).cast("string"))).otherwise("")
    opts = F.array_join(F.transform(q["options"], lambda o, i: F.concat(F.lit("\n("), option_label(i), F.lit(") "), o)), "")
    return F.concat(F.lit("Question"), num, F.lit(": "), q["text"], F.lit("\nOptions:"), opts)


def _answer(k: Column, multi: Column) -> Column:
    return F.concat(F.lit("Answer"), F.when(multi, F.concat(F.lit(" "), (k + 1).cast("string"))).otherwise(""), F.lit(": ("))


def prompt_text(context: Column, qs: Column, schema_first: Column) -> Column:
    """The prompt of a context and its questions in either layout."""
    multi = F.size(qs) > 1
    head = F.concat(F.lit("Context:\n"), context)
    by_question = F.transform(qs, lambda q, k: F.concat(F.lit("\n\n"), question_block(q, k, multi), F.lit("\n"), _answer(k, multi)))
    state_first = F.concat(head, F.array_join(by_question, ""))
    blocks = F.array_join(F.transform(qs, lambda q, k: question_block(q, k, multi)), "\n\n")
    slots = F.array_join(F.transform(qs, lambda q, k: _answer(k, multi)), "\n")
    return F.when(schema_first, F.concat(blocks, F.lit("\n\n"), head, F.lit("\n\n"), slots)).otherwise(state_first)


def truncate_context(c: Column, n: int) -> Column:
    """The first n blank-separated units."""
    return F.array_join(F.slice(F.split(c, " "), 1, n), " ")


def neutralize(options: Column) -> Column:
    """Options that read like "none of the above" get a neutral wording."""
    return F.transform(options, lambda o: F.when(F.lower(X.strip(o)).rlike(X.NEUTRAL_RE), F.lit(X.NEUTRAL_NONE)).otherwise(o))


def restore(shown_choice: Column, shown: Column, original: Column) -> Column:
    """The caller's own wording of a chosen option."""
    return F.get(original, (F.array_position(shown, shown_choice) - 1).cast("int"))


# ---- typed schema form
def schema_reason(kind: Column, options: Column, legend: Column) -> Column:
    """Why a schema field {question: choice / bool / scale} is rejected. legend: MAP level text -> label."""
    bad_key = lambda k: ~F.coalesce(k.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)\s*$"), F.lit(False))
    return (
        F.when(~kind.isin("choice", "bool", "scale"), "unknown field type")
        .when((kind == "choice") & (F.coalesce(F.size(options), F.lit(0)) < 1), "options must be a non-empty list")
        .when((kind == "scale") & (F.coalesce(F.size(legend), F.lit(0)) < 1), "legend must be a non-empty map")
        .when((kind == "scale") & F.exists(F.map_keys(legend), bad_key), "legend keys must be finite numbers")
    )


def schema_question(text: Column, kind: Column, options: Column, legend: Column) -> Column:
    from adjudica.operators.convert import scale_options

    keys, labels = scale_options(legend)
    return F.struct(
        text.alias("question"),
        F.when(kind == "bool", F.array(F.lit("no"), F.lit("yes"))).when(kind == "scale", labels).otherwise(options).alias("options"),
        F.when(kind == "bool", "noul").when(kind == "scale", "score").otherwise("choice").alias("type"),
        F.when(kind == "scale", keys).alias("levels"),
    )


# ---- limits, prefixes, caches, assets
def size_limits(rows: DataFrame, request: list[str], units: Column, max_rows: int, max_row: int, max_total: int) -> DataFrame:
    """Per request: rows, longest row, total, and the reason of a refusal (NULL when admitted)."""
    g = rows.groupBy(*request).agg(F.count(F.lit(1)).alias("n_rows"), F.max(units).alias("longest"), F.sum(units).alias("total"))
    return g.withColumn("reason", limit_reason(F.col("n_rows"), F.col("longest"), F.col("total"), max_rows, max_row, max_total))


def limit_reason(n: Column, longest: Column, total: Column, max_rows: int, max_row: int, max_total: int) -> Column:
    return (
        F.when(n > max_rows, F.format_string("too many questions: %d rows, the limit is %d", n, F.lit(max_rows)))
        .when(longest > max_row, F.format_string("too many tokens: one row has %d, the limit is %d", longest, F.lit(max_row)))
        .when(total > max_total, F.format_string("too many tokens: %d in all, the limit is %d", total, F.lit(max_total)))
    )


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x == y)
    first_diff = F.array_position(same, False)
    return F.when(first_diff == 0, n).otherwise(first_diff - 1).cast("bigint")


def shared_prefix_units(rows: DataFrame, request: list[str], row: str, units: str) -> DataFrame:
    """Units of a request with the prefix common to its rows counted once.

    What the smallest and the largest row share, all rows share: two aggregates, combined map-side, stand for the list of rows."""
    g = rows.groupBy(*request).agg(F.count(row).alias("n"), F.sum(F.size(units)).alias("_s"), F.min(units).alias("_lo"), F.max(units).alias("_hi"))
    g = g.withColumn("lcp", common_prefix(F.col("_lo"), F.col("_hi")))
    u = F.when(F.col("n") < 2, F.col("_s")).otherwise(F.col("lcp") + F.col("_s") - F.col("n") * F.col("lcp"))
    return g.select(*request, "n", "lcp", u.cast("bigint").alias("units"))


def repeat_schemas(requests: DataFrame, schema: Column, min_seen: int = 2, top: int = 128) -> DataFrame:
    """Question sets seen at least min_seen times; the `top` most frequent are worth caching."""
    g = requests.groupBy(F.xxhash64(schema).alias("h"), schema.alias("schema")).agg(F.count(F.lit(1)).alias("n"))
    return g.filter(F.col("n") >= min_seen).orderBy(F.col("n").desc(), "schema").limit(top).select("schema", "n")


def asset_reason(state: Column, assets: Column, max_refs: int, questions: Column | None = None) -> tuple[Column, Column]:
    """-> (references found, reason). The longest asset name wins where names overlap: names become one
    alternation, longest first, and matches do not overlap. An asset that only the text of the questions names is told apart: references count in the state."""
    by_length = F.transform(F.array_sort(F.transform(assets, lambda a: F.struct((-F.length(a)).alias("n"), a.alias("a")))), lambda s: s["a"])
    rx = F.concat(F.lit("("), F.array_join(F.transform(by_length, lambda a: F.regexp_replace(a, r"([^A-Za-z0-9])", r"\\$1")), "|"), F.lit(")"))
    hits = F.regexp_extract_all(state, rx, F.lit(1))
    unused = F.array_except(assets, hits)
    asked = F.filter(unused, lambda a: F.contains(F.coalesce(questions, F.lit("")), a)) if questions is not None else F.array().cast("array<string>")
    reason = F.when(F.size(asked) > 0, F.concat(F.lit("named in a question only: "), F.array_join(F.array_sort(asked), ", "))).when(F.size(unused) > 0, F.concat(F.lit("not referenced in the state: "), F.array_join(F.array_sort(unused), ", "))).when(
        F.size(hits) > max_refs, F.format_string("too many references: %d, the limit is %d", F.size(hits), F.lit(max_refs)))
    return hits, reason
