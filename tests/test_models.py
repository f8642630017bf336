"""Stored centroid models, question orders, row bootstrap and assembled answers."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from adjudica.operators import answers as A
from adjudica.operators import compare as K
from adjudica.operators import requests as R
from adjudica.operators import scoring as S


def vectors(spark, labels=7, width=5, n=120, folds=2):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=width)], f"l{i % labels}", i % 11 % folds) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, v array<double>, y string, f int")


def expected(rows, folds, cosine):
    labels, out = sorted({r[2] for r in rows}), {}
    for i, v, _, f in rows:
        z = []
        for label in labels:
            of = [np.array(x) for _, x, y, g in rows if y == label and g != f]
            c = np.mean(of, axis=0) if of else np.zeros(len(v))
            bottom = np.linalg.norm(v) * np.linalg.norm(c)
            z.append(float(np.dot(v, c)) if not cosine else float(np.dot(v, c) / bottom) if bottom else 0.0)
        out[i] = dict(zip(labels, z))
    return out


@pytest.mark.parametrize("folds", [2, 3])
@pytest.mark.parametrize("cosine", [False, True])
@pytest.mark.parametrize("cells", [1 << 20, 30])
def test_rows_are_scored_by_the_other_folds(spark, folds, cosine, cells):
    rows, df = vectors(spark, folds=folds)
    rows.append((500, [1.0] * 5, "only in one fold", 0))
    df = df.union(spark.createDataFrame(rows[-1:], df.schema)).withColumn("salt", F.lit("own"))
    model = S.fit_centroids(df, "y", "v", F.col("f"), folds)
    scorer = S.centroid_scorer(model, "v", 1.0, cosine, F.col("f"), key="id", cells=cells)
    got = {r["id"]: dict(zip(r["labels"], r["logits"])) for r in S.score(df, scorer).collect()}
    want = expected(rows, folds, cosine)
    assert set(got) == set(want)
    for i in want:
        assert got[i].keys() == want[i].keys() and all(math.isclose(got[i][k], want[i][k], abs_tol=1e-9) for k in want[i]), i
    assert want[500]["only in one fold"] == 0  # its own fold is never used


def test_many_labels_and_any_width(spark):
    rows = [(i, [1.0 if j == i % 300 else 0.0 for j in range(300)], f"{i % 300:03d}", 0) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, v array<double>, y string, f int")
    model = S.fit_centroids(df, "y", "v")  # one fold: the served model of all rows is fold 1
    for cells in (1 << 20, 20_000):
        got = S.score(df, S.centroid_scorer(model, "v", 1.0, fold=1, key="id", cells=cells))
        best = got.select("y", F.get("labels", F.array_position("logits", F.array_max("logits")).cast("int") - 1).alias("best"), F.size("labels").alias("n"))
        assert best.filter("y <> best or n <> 300").count() == 0 and best.count() == 600


def test_odd_training_rows(spark):
    rows = [(1, [1.0, 2.0], "a"), (2, [3.0, None], "a"), (3, [float("nan"), 4.0], "a"), (4, [5.0, 5.0, 5.0], "b"), (5, None, "b"), (6, [9.0, 9.0], None)]
    df = spark.createDataFrame(rows, "id long, v array<double>, y string")
    model = S.fit_centroids(df, "y", "v")
    assert {(r["fold"], r["label"], r["i"]): r["mean"] for r in model.collect()} == {(1, "a", 0): 2.0, (1, "a", 1): 3.0, (1, "b", 0): 5.0, (1, "b", 1): 5.0, (1, "b", 2): 5.0}
    got = {r["id"]: r["logits"] for r in S.score(df, S.centroid_scorer(model, "v", 1.0, fold=1)).collect()}
    assert got[1] == [8.0, 15.0] and got[2] == [6.0, 15.0] and got[4] == [25.0, 75.0] and got[5] == [None, None]
    none = S.fit_centroids(df.limit(0), "y", "v")
    assert [r["logits"] for r in S.score(df.filter("id = 1"), S.centroid_scorer(none, "v", 1.0, fold=1)).collect()] == [[]]


def test_versions_of_a_model(spark, tmp_path):
    _, df = vectors(spark)
    folder = f"file://{tmp_path}/model"
    S.save_model(S.fit_centroids(df, "y", "v"), folder, 1)
    S.save_model(S.fit_centroids(df.filter("y <> 'l0'"), "y", "v"), folder, 2)
    labels = lambda m: m.select("label").distinct().count()
    assert (labels(S.load_model(spark, folder)), labels(S.load_model(spark, folder, 1))) == (6, 7)
    with pytest.raises(Exception, match="exist"):
        S.save_model(S.fit_centroids(df, "y", "v"), folder, 2)


def test_row_bootstrap(spark):
    """Nine tenths of the rows are one group; the interval is that of the normal approximation, and partitioning does not matter."""
    rng = np.random.default_rng(1)
    d = [(i, "hot" if i % 10 else "cold", float(x)) for i, x in enumerate(rng.normal(0.3, 2.0, 20_000))] + [(99_999, "hot", None), (99_998, None, 1.0)]
    df = spark.createDataFrame(d, "id long, g string, d double")
    a = {r["g"]: r for r in K.paired_bootstrap_rows(df.repartition(1), ["g"], ["id"], "d").collect()}
    b = {r["g"]: r for r in K.paired_bootstrap_rows(df.repartition(13), ["g"], ["id"], "d", hold=1).collect()}
    for g in ("hot", "cold"):
        x = np.array([v for _, name, v in d if name == g and v is not None])
        half = 1.96 * x.std() / math.sqrt(len(x))
        assert a[g]["n"] == len(x) and math.isclose(a[g]["delta"], x.mean(), abs_tol=1e-9)
        assert abs((a[g]["ci_high"] - a[g]["ci_low"]) / 2 / half - 1) < 0.25 and a[g]["ci_low"] < x.mean() < a[g]["ci_high"]
        assert all(math.isclose(a[g][c], b[g][c], abs_tol=1e-9) for c in ("delta", "ci_low", "ci_high"))
    assert (a[None]["n"], a[None]["delta"], a[None]["ci_low"]) == (1, 1.0, 1.0)
    assert K.paired_bootstrap_rows(df.limit(0), ["g"], ["id"], "d").count() == 0


def test_orders_find_back(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["x"]), (3, []), (4, None)], "id long, qs array<string>")
    v = R.order_variants(df)
    got = {(r["id"], r["variant"], tuple(r["perm"])): r["qs"] for r in v.collect()}
    assert got[1, "reversed", (2, 1, 0)] == ["c", "b", "a"] and got[1, "alone", (1,)] == ["b"] and got[2, "packed", (0,)] == ["x"] and len(got) == 8
    seen = v.withColumn("z", F.transform("qs", lambda q, j: F.concat(q, j.cast("string"))))  # the answer shows the place it was given at
    back = {r["id"]: r for r in R.realign(seen, ["id"], "z").collect()}
    assert (back[1]["packed"], back[1]["reversed"], back[1]["alone"]) == (["a0", "b1", "c2"], ["a2", "b1", "c0"], ["a0", "b0", "c0"]) and set(back) == {1, 2}


def test_independent_answers_do_not_move(spark):
    df = spark.createDataFrame([(1, "t", [[0.25, 0.75], [1.0, 0.0]], [[0.75, 0.25], [1.0, 0.0]], [[0.25, 0.75], [1.0, 0.0]], [1, 0]), (2, "t", None, None, None, None)],
                               "id int, task string, packed array<array<double>>, reversed array<array<double>>, alone array<array<double>>, golds array<int>")
    r = K.independence(df, ["task"]).collect()
    assert len(r) == 1 and (r[0]["n"], r[0]["acc_packed"], r[0]["acc_reversed"], r[0]["flips_reversed"], r[0]["flips_alone"]) == (2, 1.0, 0.5, 0.5, 0.0)
    assert (r[0]["dp_reversed_mean"], r[0]["dp_alone_mean"], r[0]["dp_alone_p95"]) == (0.25, 0.0, 0.0) and math.isclose(r[0]["dp_reversed_p95"], 0.475)


def test_assemble(spark):
    """A choice, a score whose levels were asked one by one, and a yes/no question, their rows in any order."""
    names = {"team": ["billing", "tech"], "mood": ["0", "1", "2"], "refund": ["false", "true"]}
    rows = [("mood", "iso", 2, "score", [0.6, 0.4]), ("refund", "list", 0, "noul", [0.05, 0.95]), ("mood", "iso", 0, "score", [0.9, 0.1]), ("team", "list", 0, "choice", [0.2, 0.8]), ("mood", "iso", 1, "score", [0.5, 0.5])]
    d = [(7, q, k, i, t, names[q], ["calm", "annoyed", "furious"] if t == "score" else None, p) for q, k, i, t, p in rows]
    df = spark.createDataFrame(d, "req long, qid string, kind string, row_idx int, type string, names array<string>, legend array<string>, probs array<double>")
    answers = A.assemble(df, ["req"], "qid")
    maps, large = A.answer_maps(answers, ["req"], "qid", most=3)
    a = maps.collect()[0]["answers"]
    assert list(a) == ["mood", "refund", "team"] and large.count() == 0
    assert (a["team"]["choice"], a["team"]["confidence"], a["team"]["x_p_max"], a["team"]["probabilities"]) == ("tech", 0.6, 0.8, {"billing": 0.2, "tech": 0.8})
    assert a["refund"]["type"] == "noul" and a["refund"]["noul"] == 0.95 and a["refund"]["confidence"] is None and a["refund"]["legend"] is None
    m = a["mood"]
    assert m["level_fit"] == {"0": 0.1, "1": 0.5, "2": 0.4} == m["probabilities"] and (m["fit_mass"], m["score"], m["confidence"], m["x_p_max"]) == (1.0, 1.3, 0.25, 0.5)
    assert m["legend"] == {"0": "calm", "1": "annoyed", "2": "furious"}
    maps, large = A.answer_maps(answers, ["req"], "qid", most=2)
    assert maps.count() == 0 and large.collect()[0]["reason"] == "too many answers: 3, the limit is 2"
