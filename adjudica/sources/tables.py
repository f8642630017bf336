"""Sources and sinks: Parquet tables, JSON Lines with rejects, cached splits, manifests."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A Parquet table of a data directory; pruning and pushdown are left to the scan."""
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan over the cores when it has fewer than three splits a core, or when one split holds more than a core's share of the rows.

    For work that costs far more than a row shuffle. All rows of a Parquet row group are read by one split, so of many splits
    only some may hold rows: their number alone does not show that the cores share the work. The rows of each split are counted without
    reading a column. A table whose splits share its rows is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 3 * cores:
        splits = df.groupBy(F.spark_partition_id().alias("split")).agg(F.count(F.lit(1)).alias("n"))
        most, rows = splits.agg(F.max("n"), F.sum("n")).first()
        if not rows or most * cores <= rows:
            return df
    return df.repartition(3 * cores)


def load_split(df: DataFrame, split: str, split_col: str = "split", key: str | None = None, share: float = 1.0, cap: int | None = None) -> DataFrame:
    """The rows of a split, or a slice of it: a hashed `share` of the keys, at most `cap` rows in hashed order. A slice is the same on every read."""
    from adjudica.functions.hashing import chance, u8
    from adjudica.operators.ranking import top_by_hash

    d = df.filter(F.col(split_col) == split)
    if share < 1:
        d = d.filter(chance(u8("slice", key), share))
    return d if cap is None else top_by_hash(d, [], key, "slice_cap", cap).drop("rank")


def split_pair(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """A train and an evaluation source as one table with a split column."""
    return train.withColumn("split", F.lit("train")).unionByName(evaluation.withColumn("split", F.lit("eval")))


def concat_sources(*parts: tuple[str, DataFrame]) -> DataFrame:
    """Named sources of one task, one below the other."""
    out = None
    for name, df in parts:
        df = df.withColumn("part", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, limit: int | None = None) -> DataFrame:
    """JSON Lines (gzip is read transparently). A limit is a reading option of the caller, not a default."""
    df = spark.read.schema(schema).json(path)
    return df.limit(limit) if limit else df


def parse_json(df: DataFrame, col: str, schema: T.StructType, into: str = "rec") -> tuple[DataFrame, DataFrame]:
    """Parse a JSON text column -> (good rows with the parsed struct, rejected rows with a reason).

    Lines that are not JSON objects are rejected, never an error in an executor."""
    corrupt = "_corrupt"
    full = T.StructType(schema.fields + [T.StructField(corrupt, T.StringType())])
    parsed = df.withColumn(into, F.from_json(F.col(col), full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}))
    bad = F.col(into).isNull() | F.col(f"{into}.{corrupt}").isNotNull()
    good = parsed.filter(~bad).withColumn(into, F.col(into).dropFields(corrupt))
    rejects = parsed.filter(bad).drop(into).withColumn("reason", F.lit("not a JSON object of the expected form"))
    return good, rejects


def write_cache(df: DataFrame, path: str) -> None:
    """The (train, eval) cache: Parquet laid out by split and task so that readers prune directories."""
    df.write.mode("overwrite").partitionBy("split", "task").parquet(path)


def read_cache(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if split is None else df.filter(F.col("split") == split)


def write_jsonl(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).option("compression", "gzip").json(path)


def load_all(sources: dict[str, Callable[[], DataFrame]], columns: list[str]) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """Union of every source that loads; a failing source is reported and skipped.

    The loop only builds plans; no rows pass through the driver."""
    out, report = None, []
    for name, loader in sources.items():
        try:
            df = loader().select(*columns)
        except Exception as ex:  # noqa: BLE001 - a broken source must not stop the others
            report.append((name, f"failed: {type(ex).__name__}"))
            continue
        report.append((name, "ok"))
        out = df if out is None else out.unionByName(df)
    return out, report


def fingerprint(*cols: Column) -> Column:
    """Order-free content fingerprint of a group of rows (60 bits of md5, combined by xor)."""
    return F.bit_xor(F.conv(F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in cols])), 1, 15), 16, 10).cast("bigint"))


def manifest(df: DataFrame, group: list[str], n_questions: Column, n_units: Column, key: list[Column]) -> DataFrame:
    """Items, questions, units and a content fingerprint per group, in one pass."""
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("items"),
        F.sum(n_questions).cast("bigint").alias("questions"),
        F.sum(n_units).cast("bigint").alias("units"),
        fingerprint(*key).alias("fingerprint"),
    )


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one every executor can reach: spark.checkpoint.dir of the session.

    A session of one machine (master local) that names no folder gets a temporary one; on a cluster that is an error, as
    executors would each write to a disk of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="adjudica-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/adjudica-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "part") -> DataFrame:
    """Write a reused intermediate to the shared folder and read it back: lineage ends in files that
    survive the loss of an executor."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
