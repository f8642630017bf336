"""Quality classifier: a sparse ensemble of rules.

Shallow trees are grown on text statistics. Every path from a root to a node is a rule, a conjunction of threshold tests.
A logistic model with a lasso penalty chooses few rules, and the chosen rules become one Spark column expression.

Defined results: null and empty texts have all statistics 0 and are scored like any other. Repeated rows get equal scores. Equal
values in a statistic share a side of each threshold. Without rows of both labels, or where no statistic
tells them apart, the model is the share of label 1 (0.5 without rows). `rate` leaves all columns of the table as they are. A text of any length is
counted in its row; an empty table is scored to an empty table.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adjudica.llm.common import materialise, training_sample


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def free(df: DataFrame, prefix: str) -> str:
    """The prefix, lengthened until no column begins with it."""
    while any(c.lower().startswith(prefix.lower()) for c in df.columns):
        prefix = f"_{prefix}"
    return prefix


def statistics(df: DataFrame, text: str, prefix: str = "s_") -> DataFrame:
    """Add the statistics of a text column as double columns `prefix`*."""
    t = F.coalesce(F.col(text), F.lit(""))
    w = free(df, "__w")
    work = df.withColumn(w, F.filter(F.split(t, r"\s+"), lambda x: x != ""))
    n, words = F.length(t).cast("double"), F.size(w).cast("double")
    distinct = F.size(F.array_distinct(w)).cast("double")
    lines = F.filter(F.split(t, "\n"), lambda x: x != "")
    squeezed = F.length(F.translate(t, "abcdefghijklmnopqrstuvwxyz \n", "")).cast("double")
    stats = {
        "chars": n, "words": words, "word_length": share(n, words), "distinct": share(distinct, words), "lines": F.size(lines).cast("double"),
        "distinct_lines": share(F.size(F.array_distinct(lines)).cast("double"), F.size(lines).cast("double")),
        "other": share(squeezed, n), "upper": share(n - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")).cast("double"), n),
        "digits": share(n - F.length(F.translate(t, "0123456789", "")).cast("double"), n),
        "signs": share(n - F.length(F.translate(t, "#$%&*+<=>@^_`{|}~!/\\[]()", "")).cast("double"), n),
        "stops": share(n - F.length(F.translate(t, ".,;:?\"'-", "")).cast("double"), n),
        "repeats": share(F.size(F.filter(F.arrays_zip(F.col(w).alias("a"), F.slice(w, 2, 2147483647).alias("b")), lambda z: z["a"] == z["b"])).cast("double"), words),
    }
    return work.withColumns({f"{prefix}{k}": v for k, v in stats.items()}).drop(w)


def paths(node, names: list[str], so_far: tuple = ()) -> list[tuple]:
    """Rules of a tree: for each node below the root the tests that lead to it, as (statistic, is_at_most, threshold)."""
    out = [so_far] if so_far else []
    if node.subtreeDepth() > 0:
        name, at = names[node.split().featureIndex()], float(node.split().threshold())
        out += paths(node.leftChild(), names, (*so_far, (name, True, at)))
        out += paths(node.rightChild(), names, (*so_far, (name, False, at)))
    return out


def simplify(rule: tuple) -> tuple:
    """One test for each statistic and direction: the sharpest."""
    tests: dict[tuple[str, bool], float] = {}
    for name, low, at in rule:
        key = (name, low)
        tests[key] = at if key not in tests else (min if low else max)(tests[key], at)
    return tuple((name, low, at) for (name, low), at in sorted(tests.items()))


def holds(rule: tuple, prefix: str = "s_") -> Column:
    """The rule as a boolean column over statistics with this prefix."""
    test = lambda n, low, at: (F.col(prefix + n) <= F.lit(at)) if low else (F.col(prefix + n) > F.lit(at))
    return reduce(lambda a, b: a & b, [test(n.removeprefix("s_"), low, at) for n, low, at in rule])


def fit(df: DataFrame, text: str, label: str, bound: int = 5000, trees: int = 12, depth: int = 3, penalty: float = 0.002, seed: int = 7, threshold: float = 0.7) -> dict:
    """Learn from at most about `bound` distinct texts of each label (0 or 1) -> {"rules": [(rule, weight)], "intercept"}.

    Classes are weighted alike, then the intercept is shifted so that even odds lie at `threshold`."""
    sample = training_sample(df, label, text, bound)
    stats = materialise(statistics(sample, "text").drop("text").withColumn("label", F.col("label").cast("double")), "stats").coalesce(4)
    n = {r["label"]: r["n"] for r in stats.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    shift = float(np.log(threshold / (1 - threshold)))
    p = n.get(1.0, 0) / sum(n.values()) if n else 0.5
    by_share = {"rules": [], "intercept": float(np.log((p * 0.98 + 0.01) / (1 - p * 0.98 - 0.01)))}
    if len(n) < 2:
        return by_share
    names = [c for c in stats.columns if c.startswith("s_")]
    weight = F.when(F.col("label") == 1, F.lit(sum(n.values()) / n[1.0])).otherwise(F.lit(sum(n.values()) / n[0.0]))
    data = VectorAssembler(inputCols=names, outputCol="x").transform(stats).withColumn("weight", weight / 2).select("label", "x", "weight", *names)
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, maxBins=64, seed=seed, featureSubsetStrategy="onethird", subsamplingRate=0.7).fit(data)
    rules = sorted({simplify(r) for tree in forest.trees for r in paths(tree._java_obj.rootNode(), names)})
    if not rules:  # no statistic tells the labels apart
        return by_share
    design = data.select("label", "weight", array_to_vector(F.array(*[holds(r).cast("double") for r in rules])).alias("x"))
    lasso = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", regParam=penalty, elasticNetParam=1.0, maxIter=60, standardization=False).fit(design)
    kept = [(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray()) if w]
    return {"rules": kept, "intercept": float(lasso.intercept) + shift}


def score(model: dict, prefix: str = "s_") -> Column:
    """The compiled rules: the probability of label 1 over a DataFrame that has the statistics."""
    z = F.lit(model["intercept"])
    for rule, weight in model["rules"]:
        z = z + F.when(holds(rule, prefix), F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-z))


def rate(df: DataFrame, text: str, model: dict, into: str = "score") -> DataFrame:
    """df with the column `into`; the statistics take names that df does not have, and go again."""
    prefix = free(df, "s_")
    rated = statistics(df, text, prefix).withColumn(f"{prefix}_score", score(model, prefix))
    return rated.select(*[F.col(f"`{c}`") for c in df.columns if c != into], F.col(f"{prefix}_score").alias(into))
