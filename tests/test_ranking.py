"""Bucketed ranks, quantiles and curves against brute force on skewed data."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from adjudica.functions.hashing import u8
from adjudica.operators import metrics as M
from adjudica.operators import ranking as K
from adjudica.operators import rollouts as RO


@pytest.fixture(scope="module")
def skewed(spark):
    """Two thirds of the rows in one group, a third of all values equal."""
    rng = np.random.default_rng(3)
    n = 6000
    conf = np.where(rng.random(n) < 0.33, 1.0, rng.random(n))
    rows = [(i, "hot" if rng.random() < 0.67 else f"g{rng.integers(5)}", float(conf[i]), int(rng.random() < conf[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, g string, conf double, correct int").repartition(7)


def test_rank_is_a_permutation_and_ordered(skewed):
    r = K.with_rank(skewed, ["g"], K.unit_bucket(F.col("conf")), [F.col("conf"), F.col("id")], "r", "n").toPandas()
    for _, p in r.groupby("g"):
        p = p.sort_values(["conf", "id"])
        assert list(p["r"]) == list(range(1, len(p) + 1)) and set(p["n"]) == {len(p)}


def test_at_most_equals_filtered_rank(skewed):
    full = K.with_rank(skewed.withColumn("u", u8("x", "id")), ["g"], K.hash_bucket(F.col("u")), [F.col("u"), F.col("id")], "r").filter("r <= 50")
    top = K.top_by_hash(skewed, ["g"], "id", "x", 50)
    assert sorted(x["id"] for x in full.collect()) == sorted(x["id"] for x in top.collect())


def test_null_groups_are_kept(spark):
    d = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, id int")
    got = K.top_by_hash(d, ["g"], "id", "x", 5).collect()
    assert sorted(x["id"] for x in got) == [1, 2, 3]


def test_partition_independence(skewed):
    a = {x["id"] for x in K.top_by_hash(skewed.coalesce(1), ["g"], "id", "x", 37).collect()}
    b = {x["id"] for x in K.top_by_hash(skewed.repartition(16), ["g"], "id", "x", 37).collect()}
    assert a == b


@pytest.mark.parametrize("kind,name", [("cont", "linear"), ("disc", "inverted_cdf")])
def test_quantiles(skewed, kind, name):
    got = {x["g"]: x for x in K.quantiles(skewed, ["g"], "conf", {"q50": 0.5, "q95": 0.95, "q99": 0.99}, kind=kind).collect()}
    for g, p in skewed.toPandas().groupby("g"):
        for q, c in ((0.5, "q50"), (0.95, "q95"), (0.99, "q99")):
            assert got[g][c] == pytest.approx(np.quantile(p["conf"], q, method=name))


def test_curve_with_ties(skewed):
    """The area counts a block of equal confidences with its mean error, whatever the size of the block."""
    blocks = M.confidence_blocks(skewed, ["g"])
    got = {x["g"]: x for x in M.aurc_and_selective(blocks, ["g"], {"a80": 0.8, "a50": 0.5}).collect()}
    for g, p in skewed.toPandas().groupby("g"):
        p = p.sort_values("conf", ascending=False)
        err = p.groupby("conf")["correct"].transform(lambda s: 1 - s.mean()).to_numpy()
        n = len(p)
        assert got[g]["aurc"] == pytest.approx((np.cumsum(err) / np.arange(1, n + 1)).mean(), abs=1e-8)
        for c, name in ((0.8, "a80"), (0.5, "a50")):
            k = max(1, round(c * n))
            assert got[g][name] == pytest.approx(1 - err[:k].mean())


def test_auroc(skewed):
    got = {x["g"]: x["auroc"] for x in M.auroc(skewed, ["g"], "conf", F.col("correct") == 1).collect()}
    for g, p in skewed.toPandas().groupby("g"):
        a, b = p[p["correct"] == 1]["conf"].to_numpy(), p[p["correct"] == 0]["conf"].to_numpy()
        d = a[:, None] - b[None, :]
        assert got[g] == pytest.approx(((d > 0) + 0.5 * (d == 0)).mean())


@pytest.mark.parametrize("gamma", [0.97, 0.5, 1.0])
def test_returns_of_a_long_episode(spark, gamma):
    rng = np.random.default_rng(5)
    rewards = {"long": rng.random(2500), "short": rng.random(3)}
    rows = [(e, t, float(r)) for e, rs in rewards.items() for t, r in enumerate(rs)]
    d = spark.createDataFrame(rows, "e string, t long, r double").repartition(5)
    got = RO.discounted_returns(d, ["e"], "t", "r", gamma).toPandas()
    for e, rs in rewards.items():
        g, want = 0.0, []
        for r in rs[::-1]:
            g = r + gamma * g
            want.append(g)
        np.testing.assert_allclose(got[got["e"] == e].sort_values("t")["g"], want[::-1], rtol=1e-9)
