"""Structured Streaming versions of the request path and of the service statistics.

Every function takes and returns a streaming (or batch) DataFrame, so a test can compare both. `run_once`
drains what is available into a Parquet sink, with checkpoint and sink in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adjudica.sources.tables import shared_dir


def read_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet folder or single file as a stream, with the schema of its batch read.

    The path is given as a pattern of itself: a file stream takes a plain path for a folder only."""
    pattern = f"{path[:-1]}[{path[-1]}]"
    r = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(pattern)


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Drain the stream (trigger availableNow) into Parquet and read the sink."""
    spark = stream.sparkSession
    base = shared_dir(spark)
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start(f"{base}/sink")
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/sink")


def run_batches(stream: DataFrame, write: Callable[[DataFrame, int, str], None]) -> str:
    """Drain the stream through foreachBatch. A batch overwrites its own folder, so a retried batch does not
    add its rows twice. -> the sink folder"""
    base = shared_dir(stream.sparkSession)
    sink = f"{base}/sink"
    q = stream.writeStream.foreachBatch(lambda df, i: write(df, i, sink)).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return sink


def split_sink(reason: str = "reason") -> Callable[[DataFrame, int, str], None]:
    """Write accepted and rejected rows of a batch to two folders."""

    def write(df: DataFrame, batch: int, sink: str) -> None:
        df.persist()
        df.filter(F.col(reason).isNull()).write.mode("overwrite").parquet(f"{sink}/accepted/batch={batch}")
        df.filter(F.col(reason).isNotNull()).write.mode("overwrite").parquet(f"{sink}/rejected/batch={batch}")
        df.unpersist()

    return write


def with_event_time(df: DataFrame, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def window_stats(df: DataFrame, ts: str, width: str, status: Column) -> DataFrame:
    """Tumbling windows with counts by status."""
    w = df.groupBy(F.window(ts, width).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(status == "ok").alias("ok"), F.count_if(status == "error").alias("errors"))
    return w.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "ok", "errors")


def window_latency(df: DataFrame, ts: str, width: str, slide: str, ms: str) -> DataFrame:
    """Sliding latency percentiles (approximate: a mergeable sketch is the streaming state)."""
    w = df.groupBy(F.window(ts, width, slide).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx(ms, F.array(F.lit(0.5), F.lit(0.95)), 10000).alias("q"))
    return w.select(F.col("w.start").alias("start"), "n", F.col("q")[0].alias("median_ms"), F.col("q")[1].alias("p95_ms"))


def bursts(df: DataFrame, ts: str, gap: str, by: str) -> DataFrame:
    """Bursts of requests: sessions that end after a gap."""
    s = df.groupBy(F.session_window(ts, gap).alias("s"), by).agg(F.count(F.lit(1)).alias("n"))
    return s.select(by, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def dedup(df: DataFrame, keys: list[str]) -> DataFrame:
    """Retried requests count once while their watermark is open."""
    return df.dropDuplicatesWithinWatermark(keys)


def count_in_task(df: DataFrame, key: str, ts: str, most_keys: int = 100_000) -> DataFrame:
    """Map-side counts of a stream: every task sends a key at most once per `most_keys` distinct keys it holds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[str, list] = {}

        def flush():
            return pd.DataFrame([(k, v[0], v[1]) for k, v in acc.items()], columns=[key, ts, "n"])

        for pdf in batches:
            g = pdf.groupby(key)[ts].agg(["max", "size"])
            for k, newest, n in zip(g.index, g["max"], g["size"]):
                old = acc.get(k)
                acc[k] = [newest if old is None or newest > old[0] else old[0], int(n) + (old[1] if old else 0)]
            if len(acc) > most_keys:
                yield flush()
                acc.clear()
        if acc:
            yield flush()

    return df.select(key, F.col(ts).cast("timestamp").alias(ts)).mapInPandas(run, f"{key} string, {ts} timestamp, n long")


def second_sights(df: DataFrame, key: str, ts: str = "ts", delay: str = "1 hour", ttl_ms: int = 7 * 86_400_000) -> DataFrame:
    """Emit a key when it is seen for the second time; a key unseen for ttl_ms of event time is forgotten.

    The state of a key is one counter and its newest time. Counts are combined inside the reading tasks first, so a
    key that makes up most of the stream sends a few rows per micro-batch to its state."""

    def fn(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, newest = state.get if state.exists else (0, 0)
        before = seen
        for b in batches:
            seen += int(b["n"].sum())
            newest = max(newest, int(b["ms"].max()))
        state.update((seen, newest))
        state.setTimeoutTimestamp(max(newest + ttl_ms, state.getCurrentWatermarkMs() + 1))
        if before < 2 <= seen:
            yield pd.DataFrame({key: [k[0]], "seen": [2]})

    counted = count_in_task(df, key, ts).withWatermark(ts, delay)
    return counted.select(key, ts, "n", F.unix_millis(ts).alias("ms")).groupBy(key).applyInPandasWithState(
        fn, f"{key} string, seen long", "seen long, newest long", "append", "EventTimeTimeout")


def join_late_gold(answers: DataFrame, golds: DataFrame, key: str, ts: str, gold_ts: str, within: str) -> DataFrame:
    """Answers with the gold that arrives within a bound after them; both sides drop state by watermark."""
    a, g = answers.alias("a"), golds.alias("g")
    cond = F.expr(f"a.{key} = g.gold_{key} AND g.{gold_ts} >= a.{ts} AND g.{gold_ts} <= a.{ts} + INTERVAL {within}")
    return a.join(g, cond, "left_outer")
