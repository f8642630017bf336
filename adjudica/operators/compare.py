"""Comparing runs: agreement, pivots, bootstrap intervals, gates, latency."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adjudica.functions import dist as D
from adjudica.functions.hashing import pick_index, u8
from adjudica.operators.ranking import log_bucket, quantiles, unit_bucket, value_blocks
from adjudica.sources.tables import materialise


def run_pivot(metrics: DataFrame, key: str, run: str, runs: list[str], values: list[str]) -> DataFrame:
    """key x run table: one column per run and metric."""
    return metrics.groupBy(key).pivot(run, runs).agg(*[F.first(v, ignorenulls=True).alias(v) for v in values])


def compare_runs(a: DataFrame, b: DataFrame, key: str, tol: float = 1e-3) -> DataFrame:
    """Row-by-row agreement of two runs as one report row.

    Both sides: key, status INT, type, names ARRAY<STRING>, probs ARRAY<DOUBLE>, usage INT. The rows meet in
    one full outer equi join on the key; everything else is conditional aggregation."""
    side = lambda d, s: d.select(F.col(key), *[F.col(c).alias(f"{c}_{s}") for c in ("status", "type", "names", "probs", "usage")], F.lit(True).alias(f"in_{s}"))
    j = side(a, "a").join(side(b, "b"), key, "full_outer")
    in_a, in_b = F.col("in_a").isNotNull(), F.col("in_b").isNotNull()
    both = in_a & in_b
    ok = both & (F.col("status_a") == 200) & (F.col("status_b") == 200)
    keys_differ = F.array_sort("names_a") != F.array_sort("names_b")
    comparable = ok & ~keys_differ

    def bad(p: Column) -> Column:
        return F.exists(p, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))

    nonfinite = comparable & (bad(F.col("probs_a")) | bad(F.col("probs_b")))
    finite = comparable & ~(bad(F.col("probs_a")) | bad(F.col("probs_b")))
    map_b = F.map_from_arrays("names_b", "probs_b")
    aligned_b = F.transform("names_a", lambda n: F.element_at(map_b, n))
    diff = D.max_abs_diff(F.col("probs_a"), aligned_b)
    pick = lambda s: F.get(F.col(f"names_{s}"), D.argmax(F.col(f"probs_{s}")))
    d = j.withColumn("_finite", finite).withColumn("_diff", F.when(F.col("_finite"), diff))
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    r = d.agg(
        count(in_a).alias("requests_a"),
        count(in_b).alias("requests_b"),
        count(~both).alias("missing_ids"),
        count(ok).alias("compared_requests"),
        count(both & (F.col("status_a") != F.col("status_b"))).alias("status_mismatches"),
        count(ok & keys_differ).alias("answer_key_mismatches"),
        count(nonfinite).alias("nonfinite_or_missing_probs"),
        count(comparable & (pick("a") != pick("b"))).alias("argmax_mismatches"),
        count(F.col("_diff") > tol).alias("prob_diffs_over_tol"),
        F.max("_diff").alias("max_abs_prob_diff"),
        F.max_by(F.col(key), F.col("_diff")).alias("max_at"),
        count(ok & (F.col("usage_a") != F.col("usage_b"))).alias("usage_mismatches"),
    )
    clean = (F.col("missing_ids") + F.col("status_mismatches") + F.col("answer_key_mismatches") + F.col("nonfinite_or_missing_probs")
             + F.col("argmax_mismatches") + F.col("prob_diffs_over_tol")) == 0
    return r.withColumn("ok", clean)


def paired_bootstrap(spark: SparkSession, deltas: DataFrame, task: str, delta: str, resamples: int = 4000) -> DataFrame:
    """Mean of per-task deltas and its 95% interval over hashed resamples of the tasks.

    The unit is the task (a registry of at most a few hundred), so the deltas travel as one array and a
    resample is one row; nothing of the size rows x resamples exists."""
    packed = deltas.agg(F.transform(F.array_sort(F.collect_list(F.struct(task, delta))), lambda s: s[delta]).alias("d")).scalar()
    r = spark.range(resamples).withColumn("d", packed)
    n = F.size("d")
    mean = D.asum(F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.get(F.col("d"), pick_index(u8("bootstrap", F.col("id"), j), n)))) / n
    means = r.select(mean.alias("m"), "d")
    return means.agg(
        F.max(n).cast("bigint").alias("tasks"),
        F.max(D.asum(F.col("d")) / n).alias("delta"),
        F.percentile("m", F.lit(0.025)).alias("ci_low"),
        F.percentile("m", F.lit(0.975)).alias("ci_high"),
    )


#: A prime below 2**32: u_r = (a + r b) mod PRIME is uniform for every r, and pairwise independent over r.
PRIME = 4_294_967_291
#: Bounds of u for the weights 1, 2, ... of a Poisson distribution of mean 1.
POISSON = tuple(int(PRIME * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(11))


def paired_bootstrap_rows(rows: DataFrame, group: list[str], key: list[str], delta: str, resamples: int = 200, hold: int = 5_000) -> DataFrame:
    """Mean of row deltas per group with its 95% interval by a Poisson bootstrap of the rows -> group, n, delta, ci_low, ci_high.

    A row's weight in resample r is a Poisson number from a hash of its key, the same in any partitioning. Each task folds its rows into `resamples`
    sums a group (at most `hold` groups at a time, then they are passed on), so nothing of the size rows x resamples is shuffled and
    a group of any size is a few rows. Rows without a delta take no part."""
    h = F.md5(F.concat_ws("|", F.lit("bootstrap_rows"), *[F.col(k).cast("string") for k in key]))
    part = lambda at: F.pmod(F.conv(F.substring(h, at, 8), 16, 10).cast("bigint"), F.lit(PRIME))
    d = rows.filter(F.col(delta).isNotNull()).select(F.struct(*group).alias("g"), F.to_json(F.struct(*group)).alias("name"), F.col(delta).cast("double").alias("d"), part(1).alias("a"), part(9).alias("b"))
    names = d.select("name", "g").groupBy("name").agg(F.any_value("g").alias("g"))
    schema = "name string, n long, total double, sums array<double>, weights array<long>"
    prime, bounds = PRIME, POISSON

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r, cuts, held = np.arange(resamples), np.array(bounds), {}

        def flush() -> pd.DataFrame:
            out = pd.DataFrame([(k, *v) for k, v in held.items()], columns=["name", "n", "total", "sums", "weights"])
            held.clear()
            return out

        for batch in batches:
            for start in range(0, len(batch), 4096):
                part = batch.iloc[start:start + 4096].sort_values("name", kind="stable")
                x, a, b = part["d"].to_numpy(), part["a"].to_numpy(), part["b"].to_numpy()
                w = np.searchsorted(cuts, (a[:, None] + r * b[:, None]) % prime, side="right")
                name = part["name"].to_numpy()
                firsts = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
                sums, weights = np.add.reduceat(w * x[:, None], firsts), np.add.reduceat(w, firsts)
                totals, counts = np.add.reduceat(x, firsts), np.diff(np.append(firsts, len(x)))
                for k, s, v, t, c in zip(name[firsts], sums, weights, totals, counts):
                    n0, t0, s0, w0 = held.get(k, (0, 0.0, 0.0, 0))
                    held[k] = (n0 + int(c), t0 + float(t), s0 + s, w0 + v)
                if len(held) > hold:
                    yield flush()
        if held:
            yield flush()

    folded = d.select("name", "d", "a", "b").mapInPandas(run, schema)
    per = folded.select("name", "n", "total", F.posexplode(F.arrays_zip("sums", "weights")).alias("r", "z")).groupBy("name", "r").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), (F.sum("z.sums") / F.nullif(F.sum("z.weights"), F.lit(0))).alias("m"))
    out = per.groupBy("name").agg(F.max("n").alias("n"), (F.max("total") / F.max("n")).alias("delta"), F.percentile("m", F.lit(0.025)).alias("ci_low"), F.percentile("m", F.lit(0.975)).alias("ci_high"))
    return out.join(names, "name").select("g.*", "n", "delta", "ci_low", "ci_high")


def independence(aligned: DataFrame, group: list[str]) -> DataFrame:
    """How far answers depend on the company of their questions -> group, n, accuracy of each variant, and against the packed answers the mean and 95% quantile of the
    largest probability change and the share of changed answers.

    aligned: columns packed, reversed, alone (ARRAY<ARRAY<DOUBLE>> by question) and golds. A question whose probabilities differ in number between variants
    cannot come from one request and is left out."""
    asked = F.arrays_zip("packed", "reversed", "alone", "golds")
    d = aligned.select(*group, F.explode(asked).alias("q")).select(*group, "q.*")
    d = d.filter((F.size("packed") == F.size("reversed")) & (F.size("packed") == F.size("alone")))
    pick = {v: D.argmax(F.col(v)) for v in ("packed", "reversed", "alone")}
    d = materialise(d.select(*group, "golds", *[p.alias(f"pick_{v}") for v, p in pick.items()], *[D.max_abs_diff(F.col("packed"), F.col(v)).alias(f"dp_{v}") for v in ("reversed", "alone")]), "independence")
    acc = [F.avg((F.col(f"pick_{v}") == F.col("golds")).cast("int")).alias(f"acc_{v}") for v in pick]
    moved = [x for v in ("reversed", "alone") for x in (F.avg(f"dp_{v}").alias(f"dp_{v}_mean"), F.avg((F.col("pick_packed") != F.col(f"pick_{v}")).cast("int")).alias(f"flips_{v}"))]
    out = d.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *acc, *moved)
    for v in ("reversed", "alone"):
        q = quantiles(d, group, f"dp_{v}", {f"dp_{v}_p95": 0.95}, unit_bucket(F.col(f"dp_{v}")), kind="cont")
        out = out.join(q, group)
    return out


def compare_curves(log: DataFrame, curve: str, step: str, value: str, baseline: str, stretch: Column) -> DataFrame:
    """Every curve of a log against a baseline curve at the steps both have -> curve, windows, share_lower, the means of both over the steps of `stretch`, rows a step.

    Rows are averaged by (curve, step) first; what is joined has one row a step and curve."""
    c = log.groupBy(curve, step).agg(F.avg(value).alias("_v"), F.count(F.lit(1)).alias("_n"))
    base = c.filter(F.col(curve) == baseline).select(step, F.col("_v").alias("_v0"), F.col("_n").alias("_n0"))
    j = c.filter(F.col(curve) != baseline).join(base, step)
    return j.groupBy(curve).agg(
        F.count(F.lit(1)).alias("windows"), F.avg((F.col("_v") < F.col("_v0")).cast("int")).alias("share_lower"), F.avg(F.when(stretch, F.col("_v0"))).alias("mean_base"),
        F.avg(F.when(stretch, F.col("_v"))).alias("mean"), F.avg("_n0").alias("throughput_base"), F.avg("_n").alias("throughput"))


def latency_summary(replay: DataFrame, ms: str, status: str, kind: str, ts: str) -> DataFrame:
    """Counts by class, throughput (NULL within one second) and exact latency quantiles of the answered requests."""
    base = replay.agg(
        F.count_if(F.col(status) == 200).alias("ok"),
        F.count_if(F.col(kind) == "unsupported").alias("unsupported"),
        F.count_if(F.col(kind) == "error").alias("errors"),
        F.try_divide(F.count_if(F.col(status) == 200), F.timestamp_diff("SECOND", F.min(ts), F.max(ts))).alias("throughput_rps"),
        F.avg(F.when(F.col(status) == 200, F.col(ms))).alias("mean_ms"),
        F.max(F.when(F.col(status) == 200, F.col(ms))).alias("max_ms"),
    )
    ok = replay.filter(F.col(status) == 200)
    # a thousand buckets per factor e of a latency: few enough to add up in one task, and their rows are ranked in all
    q = quantiles(ok, [], ms, {"median_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}, log_bucket(F.col(ms), 1024), {"median_ms": "cont", "p95_ms": "disc", "p99_ms": "disc"})
    return base.withColumn("_q", q.select(F.struct("*").alias("q")).scalar()).select(*base.columns, "_q.median_ms", "_q.p95_ms", "_q.p99_ms")


def weighted_quantiles(df: DataFrame, group: list[str], value: str, weight: Column, qs: dict[str, float]) -> DataFrame:
    """Smallest value whose cumulative weight reaches q of the total."""
    blocks = value_blocks(df, group, value, log_bucket(F.col(value)), {"w": weight})
    reached = lambda q: F.min(F.when(F.col("w0") + F.col("w") >= q * F.col("w_all"), F.col(value)))
    return blocks.groupBy(*group).agg(*[reached(q).alias(n) for n, q in qs.items()])
