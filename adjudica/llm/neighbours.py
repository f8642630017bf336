"""Approximate nearest neighbours by a forest of hash prefixes.

Every vector gets one hash string of `bits` signs per tree (sides of random planes through the mean). A tree is the sorted array of
its strings. A query descends in each tree to the vectors that share its longest prefix; then all trees ascend together, one prefix
length at a time, until enough different strings share it. Those vectors are candidates, and their true distances decide.

How many are enough is measured: for a bounded set of sample queries the true neighbours are found by brute force over all rows, and the
smallest number that reaches `target` recall on them is taken. Trees are kept per lane of rows, and counts are added over lanes, so
prefix lengths are those of one forest over all rows. Every row is indexed.

A query's own string does not count, so a query without near rows ascends until others share its prefix; and never is a prefix kept that fewer than
k other rows share in the best of `GUARDS` trees, whose rows are counted one by one. So every query meets at least k rows, or all of them.

Defined results: as in `vectors`, and all-zero vectors take no part. Equal distances go to the smaller id. Copies of one vector share
all their strings and count once towards enough. With at most k candidates all are returned. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from adjudica.llm import vectors
from adjudica.llm.vectors import keep_best

#: Trees in which the rows that share each prefix are counted for the promise of k candidates.
GUARDS = 4


def planes(width: int, trees: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(width, trees * bits))


def strings(m: np.ndarray, centre: np.ndarray, cuts: np.ndarray, trees: int, bits: int) -> np.ndarray:
    """Hash strings as whole numbers (first sign highest), one column per tree."""
    out = np.zeros((len(m), trees), np.int64)
    for t in range(trees):
        side = ((m - centre) @ cuts[:, t * bits:(t + 1) * bits]) > 0
        out[:, t] = side @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))
    return out


def prefix_range(ordered: np.ndarray, code: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 position of the strings that share the leading part of each code, `shift` signs left free."""
    low = (code >> shift) << shift
    return np.searchsorted(ordered, low), np.searchsorted(ordered, low + (np.int64(1) << shift))


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - q) ** 2).sum(1))


def counting(centre, cuts, trees: int, bits: int):
    """What shares each prefix length with a query, itself left out: (id, tree, n0 ... n_bits). Tree -1: different strings other than its own, summed over
    trees; trees 0 to GUARDS - 1: rows."""

    def task(ids, x, qids, q, _):
        have, want = strings(x, centre, cuts, trees, bits), strings(q, centre, cuts, trees, bits)
        n = np.zeros((1 + min(GUARDS, trees), len(q), bits + 1), np.int64)
        here = np.isin(qids, ids)
        for t in range(trees):
            rows = np.sort(have[:, t])
            ordered = np.unique(rows)
            own = np.isin(want[:, t], ordered)
            for length in range(bits + 1):
                a, b = prefix_range(ordered, want[:, t], np.int64(bits - length))
                n[0, :, length] += b - a - own
                if t < GUARDS:
                    a, b = prefix_range(rows, want[:, t], np.int64(bits - length))
                    n[1 + t, :, length] = b - a - here
        return pd.concat([pd.DataFrame({"id": qids, "tree": t - 1} | {f"n{i}": m[:, i] for i in range(bits + 1)}) for t, m in enumerate(n)])

    return task, "id long, tree int, " + ", ".join(f"n{i} long" for i in range(bits + 1))


def truth(k: int, centre, cuts, trees: int, bits: int):
    """The k nearest of the sample queries by brute force, with the longest prefix shared in any tree."""

    def task(ids, x, qids, q, sample):
        out = []
        for qid in sample["id"]:
            i = int(np.searchsorted(qids, qid))
            d = distances(x, q[i])
            d[ids == qid] = np.inf
            best = np.lexsort((ids, d))[:k]
            best = best[d[best] < np.inf]
            have, want = strings(x[best], centre, cuts, trees, bits), strings(q[i:i + 1], centre, cuts, trees, bits)
            differ = (have ^ want).min(1, initial=np.iinfo(np.int64).max) if len(best) else np.zeros(0, np.int64)
            shared = bits - np.array([int(v).bit_length() for v in differ], int)
            out.append(pd.DataFrame({"id": qid, "vec_id": ids[best], "d": d[best], "shared": shared}))
        return pd.concat(out) if out else pd.DataFrame(columns=["id", "vec_id", "d", "shared"])

    return task, "id long, vec_id long, d double, shared int"


def fetching(k: int, centre, cuts, trees: int, bits: int):
    """The k nearest candidates of each query in a lane; the extra rows say how long a prefix must be shared."""

    def task(ids, x, qids, q, levels):
        level = pd.Series(levels["level"].to_numpy(), index=levels["id"]).reindex(qids, fill_value=0).to_numpy(np.int64)
        have, want = strings(x, centre, cuts, trees, bits), strings(q, centre, cuts, trees, bits)
        order = np.argsort(have, axis=0, kind="stable")
        ranges = [prefix_range(have[order[:, t], t], want[:, t], np.int64(bits) - level) for t in range(trees)]
        out = []
        for i in range(len(q)):
            hit = np.zeros(len(x), bool)
            for t in range(trees):
                a, b = ranges[t][0][i], ranges[t][1][i]
                hit[order[a:b, t]] = True
            c = np.flatnonzero(hit & (ids != qids[i]))
            d = distances(x[c], q[i])
            best = keep_best(np.zeros(len(c), np.int64), ids[c], d, k)
            out.append(pd.DataFrame({"query_id": qids[i], "vec_id": ids[c[best]], "score": d[best]}))
        return pd.concat(out)

    return task, "query_id long, vec_id long, score double"


def enough(counts: pd.DataFrame, true: pd.DataFrame, bits: int, target: float, k: int) -> int:
    """The smallest number of strings at which the sample queries find `target` of their true neighbours."""
    names = [f"n{i}" for i in range(bits + 1)]
    table = counts[counts["tree"] < 0].set_index("id")[names]
    n = table.to_numpy()[table.index.get_indexer(true["id"])]
    guards = counts[counts["tree"] >= 0]
    least = pd.Series(np.where(guards[names].to_numpy() >= k, np.arange(bits + 1)[None, :], 0).max(1, initial=0), index=guards["id"]).groupby(level=0).max()
    least = least.reindex(true["id"]).to_numpy()
    top = int(n[:, 0].max()) if len(n) else 1
    m = 16.0
    while m < top:
        level = np.minimum(np.where(n >= m, np.arange(bits + 1)[None, :], 0).max(1), least)
        if (true["shared"].to_numpy() >= level).mean() >= target:
            return int(m)
        m *= 1.15
    return top


def search(df: DataFrame, key: str, vector: str, is_query: Column, k: int = 10, trees: int = 32, bits: int = 24, target: float = 0.95, sample: int = 128, seed: int = 11, lane_rows: int = 8192, group_rows: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance). `is_query` is a condition on the column `id`."""
    spark = df.sparkSession
    packs = vectors.blocks(vectors.clean(df, key, vector, nonzero=True), is_query, lane_rows, group_rows)
    if packs is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = packs.width

    def sums(batches):
        for b in batches:
            for data in b["matrix"]:
                yield pd.DataFrame({"i": np.arange(width), "x": np.frombuffer(data).reshape(-1, width).sum(0) / packs_rows})

    packs_rows = packs.n_rows
    mean = packs.lanes.select("matrix").mapInPandas(sums, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas()
    centre = mean.sort_values("i")["x"].to_numpy()
    forest = (centre, planes(width, trees, bits, seed), trees, bits)
    count, schema = counting(*forest)
    counts = vectors.materialise(packs.search(count, schema).groupBy("id", "tree").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(bits + 1)]), "counts")
    chosen = counts.filter("tree < 0").select("id").orderBy(F.xxhash64("id"), "id").limit(sample)
    brute, schema = truth(k, *forest)
    order = F.row_number().over(Window.partitionBy("id").orderBy("d", "vec_id"))
    true = packs.search(brute, schema, vectors.materialise(chosen, "sample")).withColumn("r", order).filter(F.col("r") <= k).toPandas()
    most = enough(counts.join(F.broadcast(chosen), "id").toPandas(), true, bits, target, k)
    need = F.when(F.col("tree") < 0, F.lit(most)).otherwise(F.lit(k))
    longest = F.greatest(F.lit(0), *[F.when(F.col(f"n{i}") >= need, F.lit(i)).otherwise(F.lit(0)) for i in range(bits + 1)])
    # the longest prefix that enough strings share, unless fewer than k rows share it in each guarding tree
    levels = counts.select("id", "tree", longest.alias("l")).groupBy("id").agg(F.least(F.max(F.when(F.col("tree") < 0, F.col("l"))), F.max(F.when(F.col("tree") >= 0, F.col("l")))).alias("level"))
    fetch, schema = fetching(k, *forest)
    found = packs.search(fetch, schema, levels)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
