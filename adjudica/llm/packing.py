"""Best-fit packing of documents into training sequences of several permitted lengths.

Pieces are dealt to shards by a hash; each shard packs its pieces, longest first, into the open bin that they fill best. When none
fits, every permitted size is filled on trial from the shard's pieces that are still to come, and the size of least cost per token
really filled is opened. At the end each bin shrinks to the smallest permitted length that holds its contents. The pieces that a
trial counts on may find a tighter bin, so a shard is also packed with the smallest size that fits, and the cheaper result is kept.

A shard has about `shard_docs` pieces whatever the table's size, so shards grow in number only. Equal rows are counted and dealt on in
lots of at most an eighth of a shard, so no key fills a shard. Loss against one global
packing: the last, part-filled bins of a shard.

Defined results: a text of no tokens (null, empty) gets one piece of length 0 in no bin. Texts beyond the largest length are cut
into pieces of that length and a rest. Repeated rows are packed as separate documents. Ties: bins in order of opening, pieces by key.
A text of any length is pieces of the largest capacity, dealt over shards like others. An empty table gives an empty result; only the key and the length are read.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITIES = (256, 512, 1024, 2048, 4096)
SCHEMA = "key long, piece int, first_token long, n_tokens long, bin_id long, capacity int, offset int"


def blank_tokens(text: Column) -> Column:
    """Number of runs of characters that are not white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def cost(capacity: int, width: int = 16_384) -> float:
    """Relative cost of a sequence: linear work plus attention's square term."""
    return capacity + capacity * capacity / width


def trial_fill(descending: list[int], ends: list[int], at: int, room: int) -> int:
    """Tokens that a bin takes from the negated lengths `descending[at:]`, always the longest that fits. ends[i]: end of i's run of equals."""
    start = room
    while room and (at := bisect_left(descending, -room, at)) < len(descending):
        n = -descending[at]
        taken = min(ends[at] - at, room // n)
        room -= taken * n
        at = ends[at]  # of a run that is not used up nothing more fits
    return start - room


def opened(lengths: list[int], capacities: tuple[int, ...], trial: bool) -> tuple[list[int], list[int], list[int]]:
    """best_fit with one rule of opening: by trial, or the smallest size that fits."""
    descending = [-n for n in lengths]
    ends = [len(lengths)] * len(lengths)
    for i in range(len(lengths) - 2, -1, -1):
        ends[i] = ends[i + 1] if lengths[i] == lengths[i + 1] else i + 1

    def price(c: int, at: int) -> float:
        filled = lengths[at] + trial_fill(descending, ends, at + 1, c - lengths[at])
        return cost(smallest(filled, capacities)) / filled

    free: list[tuple[int, int]] = []  # open bins as (room, bin), sorted
    bins, offsets, filled = [], [], []
    for i, n in enumerate(lengths):
        at = bisect_left(free, (n, -1))
        if at < len(free):
            room, b = free.pop(at)
        else:
            fitting = [c for c in capacities if c >= n]
            room, b = min(fitting, key=lambda c: (price(c, i), c)) if trial else fitting[0], len(filled)
            filled.append(0)
        bins.append(b)
        offsets.append(filled[b])
        filled[b] += n
        if room > n:
            insort(free, (room - n, b))
    return bins, offsets, [smallest(f, capacities) for f in filled]


def smallest(n: int, capacities: tuple[int, ...]) -> int:
    return capacities[bisect_left(capacities, n)]


def best_fit(lengths: list[int], capacities: tuple[int, ...]) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset for each length (longest first, all from 1 to the largest capacity), and the final capacity of each bin.
    `capacities` ascend."""
    return min((opened(lengths, capacities, trial) for trial in (True, False)), key=lambda r: sum(map(cost, r[2])))


def pieces(df: DataFrame, key: str, n_tokens: Column, largest: int) -> DataFrame:
    """(key, piece, first_token, n_tokens): texts cut at the largest capacity."""
    d = df.select(F.col(key).cast("long").alias("key"), F.greatest(n_tokens.cast("long"), F.lit(0)).alias("n"))
    d = d.select("key", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / largest) - 1, F.lit(0)).cast("int"))).alias("piece"))
    first = F.col("piece").cast("long") * largest
    return d.select("key", "piece", first.alias("first_token"), F.least(F.col("n") - first, F.lit(largest)).alias("n_tokens"))


def pack(df: DataFrame, key: str, n_tokens: Column, capacities: tuple[int, ...] = CAPACITIES, shard_docs: int = 2048) -> DataFrame:
    """One row per piece: key, piece, first_token, n_tokens, bin_id, capacity (of the bin after downsizing), offset in the bin."""
    caps = tuple(sorted(capacities))
    total = df.select(F.sum(F.greatest(F.ceil(n_tokens.cast("long") / caps[-1]), F.lit(1)))).first()[0] or 0
    shards = max(1, math.ceil(total / shard_docs))
    lot = max(1, shard_docs // 8)
    p = pieces(df, key, n_tokens, caps[-1]).groupBy("key", "piece", "first_token", "n_tokens").agg(F.count(F.lit(1)).alias("copies"))
    p = p.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(lot).cast("long"))).alias("start"))
    p = p.withColumn("copies", F.least(F.col("copies") - F.col("start"), F.lit(lot)))
    p = p.withColumn("shard", F.pmod(F.xxhash64("key", "piece", "n_tokens", "start"), F.lit(shards))).drop("start")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.loc[group.index.repeat(group["copies"])]
        g = group.sort_values(["n_tokens", "key", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        some = int((g["n_tokens"] > 0).sum())
        bins, offsets, sizes = best_fit(g["n_tokens"].iloc[:some].astype(int).tolist(), caps)
        gap = [None] * (len(g) - some)
        shard = int(g["shard"].iloc[0])
        return pd.DataFrame({
            "key": g["key"].astype("Int64"), "piece": g["piece"], "first_token": g["first_token"], "n_tokens": g["n_tokens"],
            "bin_id": pd.array([(shard << 32) | b for b in bins] + gap, dtype="Int64"),
            "capacity": pd.array([sizes[b] for b in bins] + gap, dtype="Int32"), "offset": pd.array(offsets + gap, dtype="Int32"),
        })

    return p.groupBy("shard").applyInPandas(run, SCHEMA).withColumnRenamed("key", key)
