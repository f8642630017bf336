"""Streams over several micro-batches equal the batch result."""
import pytest
from pyspark.sql import functions as F

from adjudica.plans.q_requests import planned
from adjudica.sources.tables import table
from adjudica.streaming import pipelines as P


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    """The events in time order, one file per slice."""
    base = tmp_path_factory.mktemp("events")
    e = table(spark, sf, "events").orderBy("ts")
    rows = e.toPandas()
    n = 5
    for i in range(n):
        part = rows.iloc[len(rows) * i // n : len(rows) * (i + 1) // n]
        spark.createDataFrame(part, e.schema).coalesce(1).write.mode("append").parquet(str(base / "events.parquet"))
    return str(base / "events.parquet")


def stream(spark, folder):
    return P.read_stream(spark, folder, files_per_trigger=1)


def rows(df):
    return sorted(map(str, df.collect()))


def test_plan_equals_batch(spark, sf, folder):
    assert rows(P.run_once(planned(stream(spark, folder)))) == rows(planned(table(spark, sf, "events")))


def test_window_stats_over_batches(spark, sf, folder):
    status = F.when(F.col("event_type") == "error", "error").otherwise("ok")
    got = P.run_once(P.window_stats(P.with_event_time(stream(spark, folder), delay="6 hours"), "ts", "1 day", status))
    want = P.window_stats(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day", status)
    last = table(spark, sf, "events").agg(F.max(F.col("ts").cast("timestamp")) - F.expr("INTERVAL 6 HOURS")).first()[0]
    assert rows(got) == rows(want.filter(F.col("end") <= F.lit(last)))


def test_dedup_over_batches(spark, sf, folder):
    twice = stream(spark, folder).withColumn("attempt", F.explode(F.array(F.lit(1), F.lit(2))))
    got = P.run_once(P.dedup(P.with_event_time(twice), ["event_id"]).select("event_id"))
    assert got.count() == table(spark, sf, "events").count()


def test_second_sight_once_per_key(spark, sf, folder):
    e = stream(spark, folder).select("ts", F.col("event_type").alias("schema"))
    got = P.run_once(P.second_sights(e, "schema", ttl_ms=60 * 86_400_000)).collect()
    assert sorted(x["schema"] for x in got) == sorted(x["event_type"] for x in table(spark, sf, "events").select("event_type").distinct().collect())


def test_split_sink_is_complete(spark, sf, folder):
    s = stream(spark, folder).select("event_id", F.when(F.col("event_type") == "error", "bad").alias("reason"))
    sink = P.run_batches(s, P.split_sink())
    read = lambda v: spark.read.schema("event_id long, reason string").parquet(f"{sink}/{v}").count()
    e = table(spark, sf, "events")
    assert (read("accepted"), read("rejected")) == (e.filter("event_type <> 'error'").count(), e.filter("event_type = 'error'").count())
