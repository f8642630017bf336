"""Exact top-k search by inner product of whole-number vectors.

Vectors are dealt to lanes by descending length. All queries are first held against the lane of the longest; their k-th best scores then say how long a vector must be to come up
to them, queries are grouped by that reach, and a lane is sent only to groups that it can still improve (Cauchy-Schwarz on whole lanes). In a lane vectors are again taken by
descending length. Vectors are rotated to the axes of the singular value decomposition, so that the
first few partial sums hold most of an inner product; Cauchy-Schwarz bounds the rest by the lengths of the residuals. A pair whose
bound is below the query's k-th best so far is dropped, the others are scored exactly on whole numbers.

Defined results: as in `vectors`; a query is no candidate of its own; with fewer than k candidates all are returned; equal scores
go to the smaller id; an empty table or query set gives an empty result. Scores are exact while they fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from adjudica.llm import vectors
from adjudica.llm.vectors import Blocks, keep_best
from adjudica.operators.ranking import log_bucket, with_rank

FOUND = "query_id long, vec_id long, score long"


def rotation(packs: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of all vectors, by falling singular value, from the summed second moments (width x width numbers)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["matrix"]:
                m = np.frombuffer(data).reshape(-1, width)
                m = m / max(1.0, np.abs(m).max(initial=0.0))
                yield pd.DataFrame({"i": np.repeat(np.arange(width), width), "j": np.tile(np.arange(width), width), "x": (m.T @ m).ravel()})

    sums = packs.select("matrix").mapInPandas(run, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
    gram = np.zeros((width, width))
    gram[sums["i"], sums["j"]] = sums["x"]
    return np.linalg.eigh((gram + gram.T) / 2)[1][:, ::-1]


def lane_search(k: int, turn: np.ndarray, stages: tuple[float, ...] = (0.25, 0.5), chunk: int = 512):
    """The work on one lane and one group of queries. stages: shares of the axes summed before each pruning. Extra rows (id, floor) hold scores of which k others are known."""

    def task(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, known: pd.DataFrame | None) -> pd.DataFrame:
        length = np.sqrt((x * x).sum(1))
        order = np.lexsort((ids, -length))
        ids, x, length = ids[order], x[order], length[order]
        xr, qr, qlen = x @ turn, q @ turn, np.sqrt((q * q).sum(1))
        cuts = [0, *sorted({max(1, int(s * x.shape[1])) for s in stages})]
        rest = lambda m, h: np.sqrt(np.maximum(0.0, (m[:, h:] * m[:, h:]).sum(1)))
        xrest, qrest = [rest(xr, h) for h in cuts], [rest(qr, h) for h in cuts]
        xi, qi = x.astype(np.int64), q.astype(np.int64)
        floor = least = np.full(len(q), -np.inf) if known is None else known.set_index("id")["floor"].reindex(qids).to_numpy(float)
        best_q, best_id, best_s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for a in range(0, len(x), chunk):
            b = min(len(x), a + chunk)
            slack = 1e-9 * qlen * length[a] + 1e-6  # rounding of the rotated sums
            live = np.flatnonzero(qlen * length[a] + slack >= floor)
            if not live.size:
                break  # all later vectors are shorter still
            partial, may = np.zeros((live.size, b - a)), np.ones((live.size, b - a), bool)
            for s in range(1, len(cuts)):
                partial += qr[live, cuts[s - 1]:cuts[s]] @ xr[a:b, cuts[s - 1]:cuts[s]].T
                may = partial + qrest[s][live][:, None] * xrest[s][a:b][None, :] + slack[live][:, None] >= floor[live][:, None]
                if not may.any():
                    break
            may &= qids[live][:, None] != ids[a:b][None, :]
            row, col = np.nonzero(may)
            if not row.size:
                continue
            score = np.concatenate([(qi[live[row[i:i + 65536]]] * xi[a + col[i:i + 65536]]).sum(1) for i in range(0, row.size, 65536)])
            nq, nid, ns = np.concatenate([best_q, live[row]]), np.concatenate([best_id, ids[a + col]]), np.concatenate([best_s, score])
            kept = keep_best(nq, nid, -ns, k)
            best_q, best_id, best_s = nq[kept], nid[kept], ns[kept]
            full = np.bincount(best_q, minlength=len(q)) >= k
            low = np.full(len(q), np.inf)
            np.minimum.at(low, best_q, best_s.astype(float))
            floor = np.maximum(least, np.where(full, low, -np.inf))
        return pd.DataFrame({"query_id": qids[best_q], "vec_id": best_id, "score": best_s})

    return task


def lengths(packs: DataFrame, width: int) -> DataFrame:
    """(lane, id, length) of all packed vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lane, ids, data in zip(b["lane"], b["ids"], b["matrix"]):
                m = np.frombuffer(data).reshape(-1, width)
                yield pd.DataFrame({"lane": lane, "id": np.frombuffer(ids, np.int64), "length": np.sqrt((m * m).sum(1))})

    return packs.select("lane", "ids", "matrix").mapInPandas(run, "lane int, id long, length double")


def floors(packs: Blocks, found: DataFrame, k: int) -> DataFrame:
    """(id, floor, reach) of every query: the k-th best score so far (-infinity if there are fewer), and the length a vector needs to come up to it."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    kth = found.withColumn("r", rank).filter(F.col("r") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("floor"))
    q = lengths(packs.groups, packs.width).select("id", "length").join(kth, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    # a shade lower than the quotient, for rounding; a query of length 0 scores 0 everywhere
    reach = F.when(F.col("length") > 0, F.col("floor") / F.when(F.col("length") > 0, F.col("length")) * (1 - 1e-9) - 1e-6).otherwise(F.when(F.col("floor") > 0, float("inf")).otherwise(float("-inf")))
    return vectors.materialise(q.select("id", "floor", reach.alias("reach")), "floors")


def cells(packs: Blocks, bounds: DataFrame, group_rows: int) -> Blocks:
    """The queries in groups of like reach, and in `upto` how many lanes, from the longest, each group has to visit: a lane whose longest vector is
    shorter than every reach of a group holds nothing for it, and is never sent there."""
    width = packs.width
    top = {r["lane"]: r["m"] for r in lengths(packs.lanes, width).groupBy("lane").agg(F.max("length").alias("m")).collect()}  # a number a lane
    of = bounds.withColumn("_l", log_bucket(F.least(F.greatest("reach", F.lit(-1.0)), F.lit(1e15)), 1024)).withColumn("_h", F.xxhash64("id"))
    ordered = with_rank(of, [], F.struct(F.col("_l").alias("l"), F.shiftright("_h", 58).alias("h")), [F.col("_l"), F.col("_h"), F.col("id")], "_r")
    placed = vectors.materialise(ordered.select("id", "reach", F.floor((F.col("_r") - 1) / group_rows).cast("int").alias("g")), "placed")
    least = {r["g"]: r["m"] for r in placed.groupBy("g").agg(F.min("reach").alias("m")).collect()}  # a number a group
    # the longest vector from each lane on; groups and lanes are in order but for rounding, so both are made to fall
    from_lane = np.maximum.accumulate(np.array([top[lane] for lane in range(packs.n_lanes)])[::-1])
    needed = packs.n_lanes - np.searchsorted(from_lane, [least[g] for g in range(len(least))], side="left")
    upto = np.maximum.accumulate(needed[::-1])[::-1].tolist()
    queries = unpacked(packs.groups, width).join(placed.select("id", "g"), "id")
    groups = vectors.materialise(vectors.packed(queries, width, F.col("g")), "groups")
    return Blocks(packs.lanes, packs.n_lanes, groups, len(least), width, packs.n_rows, packs.n_queries, placed.select("id", "g"), upto)


def unpacked(packs: DataFrame, width: int) -> DataFrame:
    """(id, v) of packed vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for ids, data in zip(b["ids"], b["matrix"]):
                yield pd.DataFrame({"id": np.frombuffer(ids, np.int64), "v": list(np.frombuffer(data).reshape(-1, width))})

    return packs.select("ids", "matrix").mapInPandas(run, "id long, v array<double>")


def search(df: DataFrame, key: str, vector: str, is_query: Column, k: int = 5, lane_rows: int = 8192, group_rows: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score. `vector` holds whole numbers; `is_query` is a condition on the column `id`."""
    packs = vectors.blocks(vectors.clean(df, key, vector), is_query, lane_rows, group_rows, by_length=True)
    if packs is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    task = lane_search(k, rotation(packs.lanes, packs.width))
    # the longest vectors first: their scores are the bounds for all others
    found = vectors.materialise(packs.search(task, FOUND, start=0, upto=[1] * packs.n_groups), "longest")
    if packs.n_lanes > 1:
        bounds = floors(packs, found, k)
        reached = cells(packs, bounds, group_rows)
        found = found.unionByName(reached.search(task, FOUND, bounds.select("id", "floor"), start=1, upto=reached.upto))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
