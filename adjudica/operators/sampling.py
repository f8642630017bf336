"""Sampling, splitting, balancing and packing. Every choice is hash-derived (see functions.hashing)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adjudica.functions.hashing import u8
from adjudica.operators.ranking import hash_bucket, join_salted, top_by_hash, with_rank


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def cap_per_task(df: DataFrame, task: list[str], key: str, cap: int, purpose: str = "cap") -> DataFrame:
    """A seeded sample of at most `cap` rows per task."""
    return top_by_hash(df, task, key, purpose, cap).drop("rank")


def holdout_split(df: DataFrame, task: list[str], key: str, at_most: int, divisor: int, purpose: str = "holdout") -> DataFrame:
    """min(at_most, n // divisor) hashed rows of every task become eval, the rest train."""
    d = df.withColumn("_u", u8(purpose, key))
    d = with_rank(d, task, hash_bucket(F.col("_u")), [F.col("_u"), F.col(key)], "_r", "_n")
    n_eval = F.least(F.lit(at_most), F.floor(F.col("_n") / divisor))
    return d.withColumn("split", F.when(F.col("_r") <= n_eval, "eval").otherwise("train")).drop("_u", "_r", "_n")


def stratified_cap(df: DataFrame, group: list[str], cls: Column, key: str, per_class: Column, purpose: str) -> DataFrame:
    """Up to per_class hashed rows of every class of a group (halves, 75/25 mixes, balances)."""
    d = df.withColumn("_cls", cls).withColumn("_cap", per_class)
    return top_by_hash(d, [*group, "_cls"], key, purpose, F.col("_cap")).drop("_cls", "_cap", "rank")


def drop_heldout(df: DataFrame, dim: DataFrame, on: str) -> DataFrame:
    """Rows of held-out tasks, domains or families never reach training."""
    return df.join(dim.select(on), on, "left_anti")


def replay_sample(df: DataFrame, key: str, n: int, keep: Column | None = None, purpose: str = "replay") -> DataFrame:
    """The first n rows of the hashed general set, among those that pass a filter."""
    d = df if keep is None else df.filter(keep)
    return top_by_hash(d, [], key, purpose, n).drop("rank")


def class_copies(share: Column, floor_share: float = 0.15, most: int = 6) -> Column:
    """Copies of a row whose class has this share of its task."""
    c = F.least(F.lit(most), F.bround(F.lit(floor_share) / F.greatest(share, F.lit(1e-3)), 0)).cast("int")
    return F.when(share >= floor_share, 1).otherwise(c)


def repeat_rows(df: DataFrame, copies: Column, into: str = "copy") -> DataFrame:
    return df.withColumn(into, F.explode(F.sequence(F.lit(1), copies)))


def oversample_rare(df: DataFrame, task: list[str], cls: str) -> DataFrame:
    """Copies of rare-class rows. The class counts are a small table joined back, not a window over the task."""
    counts = df.groupBy(*task, cls).agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.groupBy(*task).agg(F.sum("_n").alias("_t"))
    share = counts.join(totals, task).select(*task, cls, class_copies(F.col("_n") / F.col("_t")).alias("_c"))
    return repeat_rows(join_salted(df, share, [*task, cls]), F.col("_c")).drop("_c")


def class_repeat_cap(df: DataFrame, cls: str, key: str, decisive: str, times: int, filler: str, purpose: str = "filler") -> DataFrame:
    """The decisive class `times` over, the filler class cut to the decisive count, the rest once."""
    n = df.filter(F.col(cls) == decisive).agg(F.count(F.lit(1)).alias("n")).scalar()
    fill = top_by_hash(df.filter(F.col(cls) == filler).withColumn("_n", n), [], key, purpose, F.col("_n")).drop("rank", "_n").withColumn("copy", F.lit(1))
    rest = repeat_rows(df.filter(F.col(cls) != filler), F.when(F.col(cls) == decisive, times).otherwise(1))
    return rest.unionByName(fill)


def assemble_mixture(parts: dict[str, tuple[DataFrame, int]], key: list[str], purpose: str = "mixture") -> DataFrame:
    """Union of named parts with repeats; `u` is the shuffled order of the mixture."""
    out = None
    for name, (df, times) in parts.items():
        d = df.withColumn("part", F.lit(name))
        d = repeat_rows(d, F.lit(times)) if times > 1 else d.withColumn("copy", F.lit(1))
        out = d if out is None else out.unionByName(d)
    return out.withColumn("u", u8(purpose, "part", "copy", *key))


def composition(mixture: DataFrame) -> DataFrame:
    return mixture.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


def quota(df: DataFrame, task: list[str], key: str, quota_col: Column, purpose: str = "quota") -> DataFrame:
    """Hashed rows up to a per-row quota of the task."""
    d = df.withColumn("_q", quota_col)
    return top_by_hash(d, task, key, purpose, F.col("_q")).drop("_q", "rank")


def normalise_text(c: Column) -> Column:
    """Lower case, runs of white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def context_id(c: Column) -> Column:
    """Identity of a context: its SHA-256 as 32 bytes."""
    return F.unhex(F.sha2(c, 256))


def eval_overlap(train: DataFrame, key: str, context: str, evaluation: DataFrame, eval_context: str, min_len: int = 40, salts: int = 16) -> DataFrame:
    """Training rows that share a context with an evaluation row -> key, long and short matches.

    Contexts meet on their SHA-256, so a shuffled row holds a digest and a length instead of a text, and a text is normalised once. Every evaluation
    digest is copied to `salts` keys over which the training rows are dealt: a line that most rows share is met in many tasks.
    Short contexts are reported, not grounds for dropping a row."""

    def digests(d: DataFrame, c: str, *k: str) -> DataFrame:
        whole = F.filter(F.array(normalise_text(F.col(c))), lambda t: t != "")  # an array of one: inline computes the text once
        return d.select(*k, F.inline(F.transform(whole, lambda t: F.struct(context_id(t).alias("_h"), F.length(t).alias("_n")))))

    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
    known = digests(evaluation, eval_context).select("_h").distinct().withColumn("_salt", copies)
    hit = digests(train, context, key).withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salts))).join(known, ["_h", "_salt"], "left_semi")
    long = F.col("_n") >= min_len
    return hit.groupBy(key).agg(F.count_if(long).alias("n_long"), F.count_if(~long).alias("n_short"))


def drop_overlap(train: DataFrame, key: str, overlap: DataFrame) -> DataFrame:
    return train.join(overlap.filter("n_long > 0").select(key), key, "left_anti")


def length_bucket(n: Column) -> Column:
    """Padded length: a multiple of 64, above 2048 of 512, above 8192 of 2048."""
    step = F.when(n <= 2048, 64).when(n <= 8192, 512).otherwise(2048)
    return (F.ceil(n / step) * step).cast("bigint")


def pack_batches(df: DataFrame, key: str, units: str, max_units: int, max_rows: int | None = None, purpose: str = "pack") -> DataFrame:
    """Batches of equal padded length: `t` and the batch number inside it.

    The position in a length bucket comes from bucketed ranks, so one common length may hold any share of the rows."""
    d = df.withColumn("t", length_bucket(F.col(units))).withColumn("_u", u8(purpose, key))
    d = with_rank(d, ["t"], hash_bucket(F.col("_u")), [F.col("_u"), F.col(key)], "_r")
    b = F.greatest(F.lit(1), F.floor(F.lit(max_units) / F.col("t")))
    if max_rows:
        b = F.least(b, F.lit(max_rows))
    return d.withColumn("batch", F.floor((F.col("_r") - 1) / b).cast("bigint")).drop("_u", "_r")


def exemplars(df: DataFrame, label: list[str], key: str, k: int, purpose: str = "exemplar") -> DataFrame:
    """Up to k hashed inputs per label as an ordered list."""
    top = top_by_hash(df, label, key, purpose, k)
    return top.groupBy(*label).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", key))), lambda s: s[key]).alias("exemplars"))
