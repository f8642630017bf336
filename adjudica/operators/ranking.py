"""Ranks, prefix sums and quantiles inside groups of any size.

A plain window over a group sorts the whole group in one task, which fails when one task,
user or label holds a large share of the table. Everything here splits a group into ordered
buckets first:

1. count rows per (group, bucket)           map-side combined, small result
2. prefix sums over the buckets of a group  at most `buckets` rows per group
3. join the offsets back and rank inside (group, bucket)

The join and the window share the (group, bucket) hash partitioning, so the rows are shuffled
once and a hot group is spread over all its buckets. Results are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adjudica.functions.hashing import u8

RING_SALTS = 16
UNTIL_BEFORE = (Window.unboundedPreceding, -1)


def hash_bucket(u: Column) -> Column:
    """4096 buckets in the order of a hash string."""
    return F.substring(u, 1, 3)


def log_bucket(v: Column, per_unit: int = 65536) -> Column:
    """Monotone buckets of about 1/per_unit relative width for any double (some millions at most)."""
    v = v.cast("double")
    return F.floor(F.signum(v) * F.log1p(F.abs(v)) * per_unit).cast("int")


def unit_bucket(p: Column, per_unit: int = 8192) -> Column:
    """Monotone buckets of a probability on the logit scale (at most about 600,000).

    Confidences crowd near 1; equal steps of p would put most of them in the last bucket."""
    odds = F.log(p / (1 - p)) * per_unit
    return F.when(p <= 0, F.lit(-1_000_000)).when(p >= 1, F.lit(1_000_000)).otherwise(F.floor(odds)).cast("int")


def _key(group: list[str], bucket: Column) -> Column:
    """(group, bucket) as one struct: a struct key is never NULL, so rows with a NULL group keep their own group."""
    g = F.struct(*[F.col(c) for c in group]) if group else F.struct(F.lit(0).alias("all"))
    return F.struct(g.alias("g"), bucket.alias("b"))


def _prefix(sums: list[str], before: dict[str, str], total: dict[str, str]) -> list[Column]:
    """Sums over the earlier buckets of a group and over the whole group, on the small bucket table."""
    wg = Window.partitionBy("_k.g")
    earlier = wg.orderBy("_k.b").rowsBetween(*UNTIL_BEFORE)
    return [F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(before[c]) for c in sums] + [F.sum(c).over(wg).alias(total[c]) for c in sums]


def with_rank(df: DataFrame, group: list[str], bucket: Column, order: list[Column], rank: str = "rank",
              size: str | None = None, at_most: Column | int | None = None) -> DataFrame:
    """Add the 1-based position of every row inside its group (exact).

    `bucket` must not decrease along `order`. With `at_most`, only rows of rank <= at_most are
    kept, and buckets that start beyond it are dropped before they are sorted."""
    keyed = df.withColumn("_k", _key(group, bucket))
    offsets = keyed.groupBy("_k").agg(F.count(F.lit(1)).alias("_n")).select("_k", *_prefix(["_n"], {"_n": "_before"}, {"_n": "_size"}))
    joined = keyed.join(offsets, "_k")
    if at_most is not None:
        joined = joined.filter(F.col("_before") < (F.lit(at_most) if isinstance(at_most, int) else at_most))
    inner = Window.partitionBy("_k").orderBy(*order)
    out = joined.withColumn(rank, (F.col("_before") + F.row_number().over(inner)).cast("bigint"))
    if at_most is not None:
        out = out.filter(F.col(rank) <= (F.lit(at_most) if isinstance(at_most, int) else at_most))
    if size:
        out = out.withColumn(size, F.col("_size"))
    return out.drop("_k", "_before", "_size")


def top_by_hash(df: DataFrame, group: list[str], key: str, purpose: str, n: Column | int, rank: str = "rank",
                size: str | None = None) -> DataFrame:
    """The first n rows of every group in hashed order (a seeded sample without replacement)."""
    u = u8(purpose, key)
    d = df.withColumn("_u", u)
    return with_rank(d, group, hash_bucket(F.col("_u")), [F.col("_u"), F.col(key)], rank, size, n).drop("_u")


def ring_blocks(df: DataFrame, group: list[str], value: str, purpose: str, size: int = 256) -> DataFrame:
    """The distinct values of every group as a ring in hashed order, cut in blocks -> group, block, values, size, total.

    A block holds at most `size` values, so a ring of any length is a table of short rows."""
    d = df.select(*group, value).distinct()
    d = d.withColumn("_u", u8(purpose, *group, value))
    d = with_rank(d, group, hash_bucket(F.col("_u")), [F.col("_u"), F.col(value)], "_r", "total")
    d = d.groupBy(*group, "total", F.floor((F.col("_r") - 1) / size).alias("block")).agg(F.array_sort(F.collect_list(F.struct("_r", F.col(value).alias("v")))).alias("_s"))
    return d.select(*group, "total", "block", F.transform("_s", lambda s: s["v"]).alias("values"), F.lit(size).cast("long").alias("size"))


def ring_slice(df: DataFrame, key: str, group: list[str], ring: DataFrame, start: Column, need: Column, into: str) -> DataFrame:
    """Up to `need` successive distinct values of the row's ring from place `start` modulo its length, as an array; the key is unique.

    Each row meets the few blocks that cover its stretch by an equi join. Every block is copied to `RING_SALTS` keys over which the rows are dealt,
    so a short ring, which is one block, does not send all rows to one task. A group without a ring gives an empty array."""
    on = [*group, "block", "_salt"]
    totals = ring.filter("block = 0").select(*group, "total", "size")
    d = df.select(key, *group, start.alias("_start"), need.cast("long").alias("_need")).filter("_need > 0")
    d = d.join(totals, group) if group else d.withColumn("_t", totals.select(F.struct("total", "size").alias("t")).scalar()).filter("_t is not null").select("*", "_t.total", "_t.size").drop("_t")
    d = d.withColumn("_lo", F.pmod("_start", "total")).withColumn("_end", F.col("_lo") + F.least("_need", "total"))
    stretch = lambda turn, lo, hi: F.struct(F.lit(turn).alias("turn"), lo.alias("lo"), hi.alias("hi"))
    both = F.array(stretch(0, F.col("_lo"), F.least("_end", "total")), stretch(1, F.lit(0).cast("long"), F.col("_end") - F.col("total")))
    d = d.select(key, *group, "size", F.explode(F.filter(both, lambda s: s["hi"] > s["lo"])).alias("_s"))
    d = d.withColumn("block", F.explode(F.sequence(F.floor(F.col("_s.lo") / F.col("size")), F.floor((F.col("_s.hi") - 1) / F.col("size")))))
    d = d.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(RING_SALTS)))
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(RING_SALTS - 1).cast("long")))
    j = d.join(ring.select(*group, "block", "values", salts.alias("_salt")), on)
    first = F.greatest(F.col("_s.lo") - F.col("block") * F.col("size"), F.lit(0))
    piece = F.slice("values", (first + 1).cast("int"), (F.least(F.col("_s.hi") - F.col("block") * F.col("size"), F.col("size")) - first).cast("int"))
    got = j.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_s.turn", "block", piece.alias("v")))).alias("_p"))
    got = got.select(key, F.flatten(F.transform("_p", lambda p: p["v"])).alias(into))
    return df.join(got, key, "left").withColumn(into, F.coalesce(into, F.array().cast("array<string>")))


def value_blocks(df: DataFrame, group: list[str], value: str, bucket: Column, sums: dict[str, Column], descending: bool = False) -> DataFrame:
    """One row per (group, distinct value) with its count `m`, its sums, and the prefix of both over
    the earlier values (`m0`, `<name>0`), plus the group totals (`m_all`, `<name>_all`).

    Ties collapse before the shuffle, so a value shared by a third of the rows is one row here."""
    order = F.col(value).desc() if descending else F.col(value).asc()
    names = ["m", *sums]
    blocks = (
        df.groupBy(*group, value)
        .agg(F.count(F.lit(1)).alias("m"), *[F.sum(c).alias(k) for k, c in sums.items()])
        .withColumn("_k", _key(group, -bucket if descending else bucket))
    )
    per = blocks.groupBy("_k").agg(*[F.sum(k).alias(f"_s_{k}") for k in names])
    summed = [f"_s_{k}" for k in names]
    offsets = per.select("_k", *_prefix(summed, {f"_s_{k}": f"_p_{k}" for k in names}, {f"_s_{k}": f"{k}_all" for k in names}))
    inner = Window.partitionBy("_k").orderBy(order).rowsBetween(*UNTIL_BEFORE)
    out = blocks.join(offsets, "_k")
    for k in names:
        out = out.withColumn(f"{k}0", F.col(f"_p_{k}") + F.coalesce(F.sum(k).over(inner), F.lit(0)))
    return out.drop("_k", *[f"_p_{k}" for k in names])


def join_salted(df: DataFrame, small: DataFrame, on: list[str], how: str = "inner", salts: int = RING_SALTS) -> DataFrame:
    """An equi join with a table of few rows per key whose keys may be hot in df: the small side is copied to `salts` keys, over which the rows of df
    are dealt by their contents."""
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
    dealt = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(salts)))
    return dealt.join(small.withColumn("_salt", copies), [*on, "_salt"], how).drop("_salt")


def quantiles(df: DataFrame, group: list[str], value: str, qs: dict[str, float], bucket: Column | None = None, kind: str | dict[str, str] = "disc") -> DataFrame:
    """Exact quantiles per group without gathering a group in one task, all in one pass. `kind` may differ by quantile.

    disc: the nearest-rank value (position ceil(q n)); cont: linear interpolation at q (n - 1)."""
    b = log_bucket(F.col(value)) if bucket is None else bucket
    blocks = value_blocks(df.filter(F.col(value).isNotNull()), group, value, b, {})
    lo_end = F.col("m0") + F.col("m")
    aggs = []
    for name, q in qs.items():
        if (kind if isinstance(kind, str) else kind[name]) == "disc":
            k = F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("m_all") - F.lit(1e-9)))
            aggs.append(F.max(F.when((F.col("m0") < k) & (k <= lo_end), F.col(value))).alias(name))
        else:
            pos = F.lit(q) * (F.col("m_all") - 1)
            lo, hi = F.floor(pos) + 1, F.ceil(pos) + 1
            vlo = F.max(F.when((F.col("m0") < lo) & (lo <= lo_end), F.col(value)))
            vhi = F.max(F.when((F.col("m0") < hi) & (hi <= lo_end), F.col(value)))
            frac = F.max(pos - F.floor(pos))
            aggs.append((vlo + (vhi - vlo) * frac).alias(name))
    return blocks.groupBy(*group).agg(*aggs)
