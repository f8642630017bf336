"""Scoring: a pluggable producer of one logit per option, and three scorers of our own.

The contract: `score(rows, scorer)` adds `logits ARRAY<DOUBLE>` with one value per option of the row.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adjudica.functions import dist as D


def score(rows: DataFrame, scorer: DataFrame | Callable, **kw) -> DataFrame:
    """Apply a scorer: any function DataFrame -> DataFrame that adds `logits`."""
    out = scorer(rows, **kw)
    if "logits" not in out.columns:
        raise ValueError("a scorer must add the column logits")
    return out


_MODELS: dict[str, Callable] = {}


def _model(name: str, load_model: Callable[[], Callable]) -> Callable:
    """The model of this Python worker: kept between the tasks the worker runs."""
    if name not in _MODELS:
        _MODELS.clear()
        _MODELS[name] = load_model()
    return _MODELS[name]


def python_scorer(load_model: Callable[[], Callable[[list[str], list[list[str]]], list[list[float]]]], context: str = "context", options: str = "options",
                  name: str | None = None):
    """Wrap a user's Python model. The model is loaded once per worker and sees Arrow batches."""
    name = name or uuid.uuid4().hex

    def scorer(rows: DataFrame) -> DataFrame:
        schema = T.StructType(rows.schema.fields + [T.StructField("logits", T.ArrayType(T.DoubleType()))])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = _model(name, load_model)
            for pdf in batches:
                pdf = pdf.copy()
                pdf["logits"] = model(list(pdf[context]), [list(o) for o in pdf[options]])
                yield pdf

        return rows.mapInPandas(run, schema)

    return scorer


# ---- centroid models: a table (fold, label, i, mean), one row per label and component
#: Cells (doubles) of a model that travel as one value; a larger model is cut by labels and met by a join.
PACKED_CELLS = 1 << 20
#: Copies of every label block in that join, so that rows of one fold spread over tasks.
SALTS = 64


def fit_centroids(train: DataFrame, label: str, vector: str, fold: Column | int = 0, folds: int = 1) -> DataFrame:
    """Mean vector per label, of any width, for out-of-fold scoring -> (fold, label, i, mean).

    Fold f (0 .. folds - 1) holds the means over all rows of the other folds, fold `folds` the means over all rows, for serving. Rows are
    summed map-side; a row's components add to the sums of its own fold, which are few. Rows without a label, and components
    that are null or not finite, take no part."""
    own = F.lit(fold) if isinstance(fold, int) else fold
    x = train.filter(F.col(label).isNotNull()).select(own.cast("int").alias("own"), F.col(label).alias("label"), F.posexplode(vector).alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    sums = x.filter(F.abs("x") < float("inf")).groupBy("own", "label", "i").agg(F.sum("x").alias("s"), F.count("x").alias("n"))
    others = F.filter(F.sequence(F.lit(0), F.lit(folds)), lambda f: f != F.col("own"))
    return sums.select("label", "i", "s", "n", F.explode(others).alias("fold")).groupBy("fold", "label", "i").agg((F.sum("s") / F.sum("n")).alias("mean"))


def save_model(model: DataFrame, folder: str, version: int) -> None:
    """Store a model as a version of a folder; a version is written once and never changed."""
    model.write.mode("errorifexists").parquet(f"{folder.rstrip('/')}/version={int(version)}")


def load_model(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A stored version, by default the latest."""
    stored = spark.read.parquet(folder)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.filter(F.col("version") == version).drop("version")


def label_blocks(model: DataFrame, cells: int = PACKED_CELLS) -> tuple[DataFrame, int]:
    """The model as rows (block, m), m an array in label order of STRUCT<label, folds ARRAY<STRUCT<v, norm>>>, and the number of blocks.

    A block has about `cells` doubles. A label without rows in a fold, or without a component, has zeros there."""
    width, labels, folds = model.agg(F.max("i") + 1, F.count_distinct("label"), F.max("fold")).first()
    width, folds = width or 0, folds or 0
    blocks = max(1, -(-labels * width * (folds + 1) // cells))
    at = lambda m, n, absent: F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.coalesce(F.element_at(m, i), absent))
    zeros = F.array_repeat(F.lit(0.0), width)
    per_fold = model.groupBy("label", "fold").agg(F.map_from_entries(F.collect_list(F.struct("i", "mean"))).alias("c"))
    per_fold = per_fold.select("label", "fold", at(F.col("c"), width - 1, F.lit(0.0)).alias("v")).withColumn("norm", norm(F.col("v")))
    per_label = per_fold.groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("fold", F.struct("v", "norm")))).alias("c"))
    per_label = per_label.select("label", at(F.col("c"), folds, F.struct(zeros.alias("v"), F.lit(0.0).alias("norm"))).alias("folds"))
    block = F.pmod(F.xxhash64("label"), F.lit(blocks)).cast("int")
    return per_label.groupBy(block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("label", "folds"))).alias("m")), blocks


def dot(a: Column, b: Column) -> Column:
    """Inner product; a component that one side lacks counts 0."""
    return D.asum(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y, F.lit(0.0))))


def norm(a: Column) -> Column:
    return F.sqrt(D.asum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def centroid_scorer(model: DataFrame, vector: str, scale: float, cosine: bool = False, fold: Column | int = 0, key: str | None = None, cells: int = PACKED_CELLS):
    """logit_k = scale * x . c_k, or scale * the cosine of the two (0 for a zero vector), with the centroids of the row's fold; adds logits and labels.

    A model of up to `cells` doubles is one value, read once: scoring is narrow. A larger one is cut by labels; every row meets every block by a join on
    (block, salt), needs a unique `key`, and its pieces are put together in block order. Both give the same logits."""
    blocks, n = label_blocks(model, cells)
    own = F.lit(fold) if isinstance(fold, int) else fold

    def logits(x: Column, m: Column) -> Column:
        def one(c: Column) -> Column:
            f = F.get(c["folds"], F.col("_f"))
            if not cosine:
                return F.lit(scale) * dot(x, f["v"])
            return F.coalesce(F.lit(scale) * dot(x, f["v"]) / F.nullif(F.col("_x") * f["norm"], F.lit(0.0)), F.lit(0.0))

        return F.transform(m, one)

    def scorer(rows: DataFrame) -> DataFrame:
        d = rows.withColumn("_f", own.cast("int"))
        if cosine:
            d = d.withColumn("_x", norm(F.col(vector)))
        if n == 1:
            d = d.withColumn("_m", F.coalesce(blocks.select("m").scalar(), F.array().cast(blocks.schema["m"].dataType)))
            d = d.withColumn("logits", logits(F.col(vector), F.col("_m"))).withColumn("labels", F.transform("_m", lambda c: c["label"]))
            return d.drop("_m", "_f", "_x")
        if key is None:
            raise ValueError("a model of several label blocks needs the rows' key")
        parts = d.select(F.col(key).alias("_key"), F.col(vector).alias("_v"), *[c for c in ("_f", "_x") if c in d.columns], F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"))
        parts = parts.withColumn("salt", F.pmod(F.xxhash64("_key"), F.lit(SALTS)))
        met = parts.join(blocks.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["block", "salt"])
        met = met.select("_key", F.struct("block", logits(F.col("_v"), F.col("m")).alias("z"), F.transform("m", lambda c: c["label"]).alias("l")).alias("p"))
        whole = met.groupBy("_key").agg(F.array_sort(F.collect_list("p")).alias("p"))
        whole = whole.select("_key", F.flatten(F.transform("p", lambda q: q["z"])).alias("logits"), F.flatten(F.transform("p", lambda q: q["l"])).alias("labels"))
        return rows.join(whole, rows[key] == whole["_key"], "left").drop("_key")

    return scorer


def lexical_scorer(context: str, options: str):
    """Number of distinct option words that occur in the context."""

    def words(c: Column) -> Column:
        return F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""))

    def scorer(rows: DataFrame) -> DataFrame:
        d = rows.withColumn("_w", words(F.col(context)))
        z = F.transform(options, lambda o: F.size(F.array_intersect(F.col("_w"), words(o))).cast("double"))
        return d.withColumn("logits", z).drop("_w")

    return scorer


def trained_scorer(train: DataFrame, vector: str, label: str, max_iter: int = 50, reg: float = 0.01):
    """Multinomial logistic regression fitted on `train` with Spark ML; its raw predictions are the logits."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    vec = lambda d: d.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    lr = LogisticRegression(featuresCol="_v", labelCol="_y", maxIter=max_iter, regParam=reg, family="multinomial", rawPredictionCol="_raw", probabilityCol="_p", predictionCol="_pred")
    model = lr.fit(vec(train).withColumn("_y", F.col(label).cast("double")).select("_v", "_y"))

    def scorer(rows: DataFrame) -> DataFrame:
        out = model.transform(vec(rows))
        return out.withColumn("logits", vector_to_array("_raw")).drop("_v", "_raw", "_p", "_pred")

    return scorer


def train_loss(logits: Column, gold: Column, label_smooth: float = 0.0, brier_weight: float = 0.0) -> Column:
    """Cross entropy with label smoothing plus a weighted Brier term."""
    lp = D.log_softmax(logits)
    ce = D.let(lp, lambda v: -(1 - label_smooth) * F.get(v, gold) - label_smooth * D.asum(v) / F.size(v))
    return ce + brier_weight * D.brier(D.softmax(logits), gold)
