"""Accuracy, calibration and selective-prediction metrics over prediction tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adjudica.functions import dist as D
from adjudica.operators.ranking import unit_bucket, value_blocks

EULER_GAMMA = 0.5772156649015329


def per_row(pred: DataFrame, probs: str = "probs", gold: str = "gold", eps: float = 1e-12) -> DataFrame:
    """Row-level quantities of every metric; rows with an unknown gold (-1) are left out."""
    p, g = F.col(probs), F.col(gold)
    return (
        pred.filter(g >= 0)
        .withColumn("conf", F.array_max(p))
        .withColumn("pred", (F.array_position(p, F.col("conf")) - 1).cast("int"))
        .withColumn("correct", (F.col("pred") == g).cast("int"))
        .withColumn("nll", D.nll(D.at(p, g), eps))
        .withColumn("brier", D.brier(p, g))
        .withColumn("chance", 1.0 / F.size(p))
    )


def ece_bin(conf: Column, bins: int = 15) -> Column:
    """(lo, hi] bins; a confidence of 0 is in no bin."""
    return F.when(conf <= 0, F.lit(0)).otherwise(F.least(F.lit(bins), F.greatest(F.lit(1), F.ceil(conf * bins)))).cast("int")


def ece_bin_floor(conf: Column, bins: int = 10) -> Column:
    """[lo, hi) bins, the last one closed."""
    return F.least(F.lit(bins - 1), F.floor(conf * bins)).cast("int")


def bin_table(rows: DataFrame, group: list[str], bin_col: Column) -> DataFrame:
    """Sums per (group, bin): every mean metric and the calibration error follow from this small table."""
    return rows.withColumn("bin", bin_col).groupBy(*group, "bin").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("conf").alias("s_conf"),
        F.sum("correct").alias("s_correct"),
        F.sum("nll").alias("s_nll"),
        F.sum("brier").alias("s_brier"),
        F.sum("chance").alias("s_chance"),
    )


def summary_from_bins(bins: DataFrame, group: list[str]) -> DataFrame:
    n = F.sum("n")
    gap = F.when(F.col("bin") > 0, F.abs(F.col("s_conf") - F.col("s_correct"))).otherwise(0.0)
    return bins.groupBy(*group).agg(
        n.alias("n"),
        (F.sum("s_correct") / n).alias("acc"),
        (F.sum("s_nll") / n).alias("nll"),
        (F.sum("s_brier") / n).alias("brier"),
        (F.sum(gap) / n).alias("ece"),
        (F.sum("s_chance") / n).alias("chance"),
        (F.sum("s_conf") / n).alias("mean_conf"),
    )


def ece(rows: DataFrame, group: list[str], bin_col: Column, name: str = "ece") -> DataFrame:
    b = rows.withColumn("bin", bin_col).groupBy(*group, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum("conf").alias("s_conf"), F.sum("correct").alias("s_correct"))
    gap = F.when(F.col("bin").isNotNull(), F.abs(F.col("s_conf") - F.col("s_correct"))).otherwise(0.0)
    return b.groupBy(*group).agg((F.sum(gap) / F.sum("n")).alias(name))


def confidence_blocks(rows: DataFrame, group: list[str]) -> DataFrame:
    """Distinct confidences from high to low with their counts and errors, and the prefix of both."""
    return value_blocks(rows, group, "conf", unit_bucket(F.col("conf")), {"e": 1 - F.col("correct")}, descending=True)


def _inverse_sum(n0: Column, m: Column) -> Column:
    """1/(n0+1) + ... + 1/(n0+m): summed for short runs, by its expansion for long ones."""
    short = F.aggregate(F.sequence(F.lit(1), F.least(m, F.lit(64)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / (n0 + i))
    head = F.when(n0 < 1, 0.0).otherwise(
        F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(n0, F.lit(32))).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / i))

    def tail(n: Column) -> Column:
        return 1.0 / (2 * n) - 1.0 / (12 * n * n)

    n1 = (n0 + m).cast("double")
    nz = F.greatest(n0, F.lit(1)).cast("double")
    long_small = F.log(n1) + F.lit(EULER_GAMMA) + tail(n1) - head
    long_big = F.log1p(m / nz) + tail(n1) - tail(nz)
    return F.when(m <= 64, short).when(n0 <= 32, long_small).otherwise(long_big)


def aurc_and_selective(blocks: DataFrame, group: list[str], coverages: dict[str, float]) -> DataFrame:
    """Area under the risk-coverage curve and accuracy of the most confident share.

    Rows of equal confidence count with their mean error, so no order among ties has to be chosen."""
    n0, m, e0, e, total = (F.col(c) for c in ("m0", "m", "e0", "e", "m_all"))
    r = e / m
    area = (e0 - n0 * r) * _inverse_sum(n0, m) + m * r
    aggs = [(F.sum(area) / F.max(total)).alias("aurc")]
    for name, c in coverages.items():
        k = F.greatest(F.lit(1), F.bround(F.lit(c) * total, 0).cast("bigint"))
        hits = F.when(n0 + m <= k, m - e).when(n0 < k, (k - n0) * (1 - r)).otherwise(0.0)
        aggs.append((F.sum(hits) / F.max(k)).alias(name))
    return blocks.groupBy(*group).agg(*aggs)


def summarize(pred: DataFrame, group: list[str]) -> DataFrame:
    """The full metric row per group."""
    rows = per_row(pred)
    base = summary_from_bins(bin_table(rows, group, ece_bin(F.col("conf"))), group)
    curve = aurc_and_selective(confidence_blocks(rows, group), group, {"acc_at_80": 0.8, "acc_at_50": 0.5})
    return base.join(curve, group)


def auroc(df: DataFrame, group: list[str], score_col: str, positive: Column) -> DataFrame:
    """Area under the ROC curve; equal scores count half. NULL for a group that has rows of one class only."""
    blocks = value_blocks(
        df, group, score_col, unit_bucket(F.col(score_col)),
        {"pos": positive.cast("bigint"), "neg": (~positive).cast("bigint")},
    )
    return blocks.groupBy(*group).agg(
        F.try_divide(F.sum(F.col("pos") * (F.col("neg0") + F.col("neg") / 2.0)), F.max("pos_all") * F.max("neg_all")).alias("auroc"))


def band_correct(p_yes: Column, gold: Column, low: float, high: float) -> Column:
    """Whether a yes/no answer is right and decided: from `high` on it says yes, up to `low` no, and between the two it counts as wrong."""
    return F.when(p_yes >= high, gold == 1).when(p_yes <= low, gold == 0).otherwise(F.lit(False))


def aggregate_split(task_metrics: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Unweighted mean over tasks."""
    return task_metrics.groupBy(*by).agg(F.count(F.lit(1)).alias("tasks"), *[F.avg(m).alias(m) for m in metrics])
