"""Vectors in packed lanes, and the block search that both vector operators share.

All vectors are dealt to lanes of about `lane_rows` rows by a hash of their id, a query set to groups of about `group_rows`. Each
(lane, group) is one task's work, of bounded size. A task's results are merged per query by its caller. Lanes and groups are
written to the shared folder once.

Ids are unique; of rows that repeat an id, the smallest vector is taken. Rows without an id take no part. Vectors shorter than the
longest count as filled up with zeros.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adjudica.llm.common import materialise
from adjudica.operators.ranking import log_bucket, with_rank

PACK = "lane int, n int, ids binary, matrix binary"


def clean(df: DataFrame, key: str, vector: str, nonzero: bool = False) -> DataFrame:
    """(id, v array<double>) of the rows whose vector is not null, holds only finite numbers and, if asked, is not all zeros."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    d = df.select(F.col(key).cast("long").alias("id"), v.alias("v")).filter("id is not null and v is not null")
    d = d.filter(F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))
    if nonzero:
        d = d.filter(F.exists("v", lambda x: x != 0))
    return d.groupBy("id").agg(F.min("v").alias("v"))


def packed(df: DataFrame, width: int, lane: Column) -> DataFrame:
    """One row per lane: ids and a matrix of doubles, rows in the order of ids. `lane` numbers the lanes from 0."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("id")
        m = np.zeros((len(g), width))
        for i, v in enumerate(g["v"]):
            m[i, :len(v)] = v
        return pd.DataFrame({"lane": [int(g["lane"].iloc[0])], "n": [len(g)], "ids": [g["id"].to_numpy(np.int64).tobytes()], "matrix": [m.tobytes()]})

    return df.select("id", "v", lane.cast("int").alias("lane")).groupBy("lane").applyInPandas(run, PACK)


def dealt(lanes: int) -> Column:
    """Lanes by a hash of the id."""
    return F.pmod(F.xxhash64("id"), F.lit(lanes))


def longest_first(df: DataFrame, lane_rows: int) -> DataFrame:
    """Add `lane`: rows by falling length of their vectors (to 1 in 65,536; rows of one length by hash), `lane_rows` to a lane."""
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    d = df.withColumn("_l", -log_bucket(length)).withColumn("_h", F.xxhash64("id"))
    # rows of equal length are cut by their hash, so a table of unit vectors is no single bucket
    d = with_rank(d, [], F.struct(F.col("_l").alias("l"), F.shiftright("_h", 54).alias("h")), [F.col("_l"), F.col("_h"), F.col("id")], "_r")
    return d.withColumn("lane", F.floor((F.col("_r") - 1) / lane_rows).cast("int")).drop("_l", "_h", "_r")


@dataclass
class Blocks:
    lanes: DataFrame
    n_lanes: int
    groups: DataFrame
    n_groups: int
    width: int
    n_rows: int
    n_queries: int
    #: The group of every query (id, g) and the number of lanes each group visits, where these are not by hash and all.
    where: DataFrame | None = None
    upto: list[int] | None = None

    def search(self, task: Callable, schema: str, extra: DataFrame | None = None, start: int = 0, upto: list[int] | None = None) -> DataFrame:
        """Run task(ids, matrix, query_ids, query_matrix, extra rows or None) -> pandas frame on every (lane, group), or, with `upto`, on the lanes
        start ... upto[g] - 1 of every group g; upto falls, so a lane goes to the first groups. One number a group and lane is kept on the driver.

        extra is a table (id, ...) about queries; its rows go to the groups their ids belong to."""
        n_lanes, n_groups, width = self.n_lanes, self.n_groups, self.width
        groups = self.groups.withColumnRenamed("lane", "g")
        if upto is None:
            each_lane, each_group = F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))).alias("g"), F.explode(F.sequence(F.lit(0), F.lit(n_lanes - 1))).alias("lane")
            left = self.lanes.select("lane", "n", "ids", "matrix", each_lane)
        else:
            spark = self.lanes.sparkSession
            falling = [-u for u in upto]
            first = [bisect_left(falling, -lane) if lane >= start else 0 for lane in range(n_lanes)]  # groups that visit a lane
            wanted = lambda name, counts, other: spark.createDataFrame([(i, n) for i, n in enumerate(counts)], f"{name} int, {other} int")
            left = self.lanes.join(F.broadcast(wanted("lane", first, "_n")), "lane").filter("_n > 0").select("lane", "n", "ids", "matrix", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("g"))
            groups = groups.join(F.broadcast(wanted("g", upto, "_u")), "g").filter(F.col("_u") > start)
            each_group = F.explode(F.sequence(F.lit(start), F.col("_u") - 1)).alias("lane")
        names: list[str] = []
        if extra is not None:
            names = extra.columns
            extra = extra.withColumn("g", dealt(n_groups).cast("int")) if self.where is None else extra.join(self.where, "id")
            extra = extra.groupBy("g").agg(F.collect_list(F.struct(*names)).alias("extra"))
            groups = groups.join(extra, "g")  # a group is of bounded size
        right = groups.select("g", F.col("n").alias("qn"), F.col("ids").alias("qids"), F.col("matrix").alias("qmatrix"), *(["extra"] if names else []), each_group)
        columns = [c.split()[0] for c in schema.split(", ")]

        def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if a.empty or b.empty:
                return pd.DataFrame(columns=columns)
            read = lambda x, p: (np.frombuffer(x[f"{p}ids"].iloc[0], np.int64), np.frombuffer(x[f"{p}matrix"].iloc[0]).reshape(-1, width))
            more = pd.DataFrame([dict(r) if isinstance(r, dict) else r.asDict() for r in b["extra"].iloc[0]], columns=names) if names else None
            return task(*read(a, ""), *read(b, "q"), more)

        return left.groupBy("lane", "g").cogroup(right.groupBy("lane", "g")).applyInPandas(run, schema)


def blocks(vectors: DataFrame, is_query: Column, lane_rows: int = 8192, group_rows: int = 1024, by_length: bool = False) -> Blocks | None:
    """Pack vectors (id, v) and the queries among them; None if there is no vector or no query. by_length: lane 0 holds the longest vectors, and so on."""
    stored = materialise(vectors, "vectors")
    seen = stored.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("q"), F.max(F.size("v")).alias("width")).first()
    if not seen["n"] or not seen["q"]:
        return None
    n_lanes, n_groups = math.ceil(seen["n"] / lane_rows), math.ceil(seen["q"] / group_rows)
    lanes = packed(longest_first(stored, lane_rows), seen["width"], F.col("lane")) if by_length else packed(stored, seen["width"], dealt(n_lanes))
    groups = packed(stored.filter(is_query), seen["width"], dealt(n_groups))
    return Blocks(materialise(lanes, "lanes"), n_lanes, materialise(groups, "groups"), n_groups, seen["width"], seen["n"], seen["q"])


def keep_best(q: np.ndarray, ids: np.ndarray, value: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest values of each q, ties to the smaller id, sorted by q and value."""
    order = np.lexsort((ids, value, q))
    qs = q[order]
    start = np.flatnonzero(np.r_[True, qs[1:] != qs[:-1]]) if len(qs) else np.zeros(0, int)
    rank = np.arange(len(qs)) - np.repeat(start, np.diff(np.r_[start, len(qs)]))
    return order[rank < k]
