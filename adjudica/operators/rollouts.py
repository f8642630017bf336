"""Returns, baselines and advantages over trajectories of any length."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adjudica.operators.ranking import with_rank, join_salted


def chunk_length(gamma: float, floor: float = 1e-4, most: int = 512) -> int:
    """Steps per chunk such that gamma ** length stays above `floor`: inside a chunk, dividing by gamma ** i is safe."""
    if gamma >= 1:
        return most
    if gamma <= 0:
        return 1
    return max(1, min(most, int(math.log(floor) / math.log(gamma))))


def with_step(df: DataFrame, episode: list[str], bucket: Column, order: list[Column], step: str = "t") -> DataFrame:
    """Add the dense 0-based step of every row inside its episode."""
    return with_rank(df, episode, bucket, order, "_r").withColumn(step, F.col("_r") - 1).drop("_r")


def discounted_returns(df: DataFrame, episode: list[str], step: str, reward: str, gamma: float, into: str = "g") -> DataFrame:
    """G_t = r_t + gamma * G_{t+1} per episode.

    An episode is cut into chunks of a fixed number of steps. Each chunk sends one discounted sum; what a chunk
    receives from later ones is the fold of the sums that follow it, up to the horizon where gamma ** steps leaves
    the range of a double. Inside a chunk the returns are a window of at most `chunk` rows. A long episode is
    therefore spread over its chunks, and no list of its steps is built."""
    size = chunk_length(gamma)
    horizon = 1 if gamma <= 0 else (math.ceil(745 / -math.log(gamma) / size) + 1 if gamma < 1 else None)
    g = F.lit(float(gamma))
    d = df.withColumn("_c", F.floor(F.col(step) / size)).withColumn("_i", F.pmod(F.col(step), F.lit(size)))
    sums = d.groupBy(*episode, "_c").agg(F.sum(F.col(reward) * F.pow(g, F.col("_i"))).alias("_s"))
    after = Window.partitionBy(*episode).orderBy("_c").rowsBetween(1, horizon if horizon else Window.unboundedFollowing)
    if gamma >= 1:
        carry = F.coalesce(F.sum("_s").over(after), F.lit(0.0))
    else:
        later = F.collect_list("_s").over(after)
        decay = F.pow(g, F.lit(size))
        carry = F.aggregate(F.reverse(later), F.lit(0.0), lambda acc, s: s + decay * acc)
    carries = sums.select(*episode, "_c", carry.alias("_carry"))
    inner = Window.partitionBy(*episode, "_c").orderBy("_i").rowsBetween(0, Window.unboundedFollowing)
    here = F.sum(F.col(reward) * F.pow(g, F.col("_i"))).over(inner) / F.pow(g, F.col("_i"))
    out = d.join(carries, [*episode, "_c"])
    return out.withColumn(into, here + F.col("_carry") * F.pow(g, F.lit(size) - F.col("_i"))).drop("_c", "_i", "_carry")


def advantages(df: DataFrame, game: list[str], step: str, value: str, into: str = "advantage") -> DataFrame:
    """Return minus the mean of its (game, step), divided by the population deviation of the game.

    Both statistics are aggregations joined back by salted joins; no window holds a game, and a game of most rows is met in many tasks."""
    base = df.groupBy(*game, step).agg(F.avg(value).alias("_b"))
    d = join_salted(df, base, [*game, step]).withColumn("_a", F.col(value) - F.col("_b"))
    spread = d.groupBy(*game).agg(F.stddev_pop("_a").alias("_sd"))
    return join_salted(d, spread, game).withColumn(into, F.col("_a") / (F.col("_sd") + 1e-6)).drop("_b", "_a", "_sd")


def leave_one_out(df: DataFrame, start: list[str], value: str, into: str = "baseline") -> DataFrame:
    """Mean of the other replicates of the same start (NULL for a single replicate)."""
    g = df.groupBy(*start).agg(F.sum(value).alias("_s"), F.count(F.lit(1)).alias("_n"))
    return join_salted(df, g, start).withColumn(into, F.when(F.col("_n") > 1, (F.col("_s") - F.col(value)) / (F.col("_n") - 1))).drop("_s", "_n")
