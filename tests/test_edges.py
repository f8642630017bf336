"""Ordinary input that must not end a job."""
from pyspark.sql import functions as F

from adjudica.operators import augment, calibrate, compare, convert, metrics, rollouts, rules


def test_auroc_of_one_class_is_null(spark):
    df = spark.createDataFrame([("a", 0.5, True), ("a", 0.7, True), ("b", 0.2, False), ("b", 0.9, True)], "task string, s double, y boolean")
    got = {r["task"]: r["auroc"] for r in metrics.auroc(df, ["task"], "s", F.col("y")).collect()}
    assert got == {"a": None, "b": 1.0}


def test_latency_within_one_second(spark):
    df = spark.sql("select 200 as status, 12.0D as ms, 'ok' as kind, timestamp '2024-01-01 00:00:00' as ts")
    assert compare.latency_summary(df, "ms", "status", "kind", "ts").first()["throughput_rps"] is None


def test_chunk_of_gamma_zero():
    assert rollouts.chunk_length(0.0) == 1


def test_ring_slices_of_any_pool_size(spark):
    for n in (1, 2, 4, 300):
        pool = spark.range(n).select(F.format_string("v%05d", "id").alias("v"))
        got = convert.pool_slice(spark.range(50).withColumnRenamed("id", "k"), "k", pool, "v", 4).collect()
        assert len(got) == 50 and all(len(r["picked"]) == len(set(r["picked"])) == min(4, n) for r in got)
    assert {len(r["picked"]) for r in convert.pool_slice(spark.range(3).withColumnRenamed("id", "k"), "k", pool.limit(0), "v", 4).collect()} == {0}


def test_vocabularies_of_any_size_are_padded_with(spark):
    for n in (200, 201, 1000):
        pool = spark.range(n).select(F.lit("t").alias("task"), F.lit("f").alias("family"), F.format_string("v%d", "id").alias("label"))
        rows = spark.range(20).select("id", F.when(F.col("id") < 10, "g").otherwise("none").alias("fam"), F.array(F.lit("V1"), F.lit("own")).alias("o"))
        got = augment.pad(rows, "id", "fam", "o", F.lit(260), augment.family_pools(pool, ["f", "g"]), "q").collect()
        assert {len(r["q"]) for r in got if r["fam"] == "g"} == {min(255, 2 + n - 1)} and {len(r["q"]) for r in got if r["fam"] == "none"} == {2}
        assert all(len(set(x.lower() for x in r["q"])) == len(r["q"]) for r in got)


def test_twin_without_an_outside_value_is_null(spark):
    a = F.array(F.lit("x"))
    assert spark.range(1).select(rules.membership_twin(F.lit("x"), a, a, "id").alias("t")).first()["t"] is None


def test_json_that_cannot_be_read_is_left(spark):
    deep = "[" * 100_000 + "]" * 100_000
    rows = [(s,) for s in (deep, "[1E400]", "[NaN]", "{", None)]
    got = [r["s"] for r in augment.index_json(spark.createDataFrame(rows, "s string"), "s").collect()]
    assert got == [r[0] for r in rows]


def test_records_with_probabilities_are_fitted(spark):
    rows = [("choice", [0.7, 0.3], float(i % 4 == 0)) for i in range(80)]
    d = spark.createDataFrame(rows, "type string, probs array<double>, gold double")
    want = d.select("type", "gold", F.transform("probs", lambda p: F.log(p)).alias("logits"))
    assert calibrate.fit_by_type(d).collect() == calibrate.fit_by_type(want).collect() != []


def test_gold_between_two_options_is_rejected(spark):
    cols = "type string, logits array<double>, probs array<double>, level_logits array<array<double>>, level_probs array<array<double>>, gold double"
    d = spark.createDataFrame([("choice", [1.0, 2.0], None, None, None, g) for g in (0.9, 1.0, float("nan"))], cols)
    assert [r["r"] for r in d.select(calibrate.record_reason().alias("r")).collect()] == ["gold", None, "gold"]
