"""Expected values of FIXTURES.md and of worked examples."""
import math

import pytest
from pyspark.sql import functions as F

from adjudica.functions import dist as D
from adjudica.functions import text as X
from adjudica.operators import answers as A
from adjudica.operators import calibrate as C
from adjudica.operators import convert as CV
from adjudica.operators import requests as R
from adjudica.operators import sampling as S


def arr(*v):
    return F.array(*[F.lit(float(x)) for x in v])


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_choice_confidence(spark):
    p = arr(0.195, 0.1994, 0.2252, 0.2286, 0.1518)
    names = F.array(*[F.lit(x) for x in "abcde"])
    a = one(spark, A.format_answer(F.lit("choice"), names, p))
    assert (a["choice"], a["x_p_max"], a["confidence"]) == ("d", 0.2286, 0.0358)
    assert one(spark, D.choice_confidence(arr(0.8, 0.1, 0.1))) == pytest.approx(0.7)


def test_score_confidence(spark):
    names = F.array(*[F.lit(str(i)) for i in range(3)])
    a = one(spark, A.format_answer(F.lit("score"), names, arr(0, 0.95, 0.05)))
    assert (a["confidence"], a["score"]) == (0.925, 1.05)
    assert one(spark, D.score_confidence(arr(0.01, 0.02, 0.07, 0.3, 0.6))) == pytest.approx(0.55)
    assert one(spark, D.score_confidence(arr(0.3, 0.7))) == pytest.approx(one(spark, D.choice_confidence(arr(0.3, 0.7))))


def test_isolated_levels(spark):
    rows = spark.createDataFrame([(1, i, p) for i, p in enumerate((0.1, 0.5, 0.4))], "id int, level int, p_yes double")
    r = A.combine_isolated(rows, ["id"]).first()
    assert r["fit_mass"] == pytest.approx(1.0)
    names = F.array(*[F.lit(str(i)) for i in range(3)])
    a = one(spark, A.format_answer(F.lit("score"), names, arr(*r["probs"])))
    assert (a["score"], a["confidence"]) == (1.3, 0.25)


def test_zero_mass_branches(spark):
    assert one(spark, D.normalise_or_uniform(arr(0, 0))) == [0.5, 0.5]
    assert one(spark, D.scale_to_one(arr(0, 0))) == [0.0, 0.0]
    assert one(spark, A.combine_levels(arr(0, 0))) == [0.0, 0.0]


def test_shared_prefix(spark):
    rows = spark.createDataFrame([(1, 0, [1, 2, 3, 4]), (1, 1, [1, 2, 9]), (1, 2, [1, 2, 3, 7, 8]), (2, 0, [5, 6])], "r int, i int, u array<int>")
    got = {x["r"]: x["units"] for x in R.shared_prefix_units(rows, ["r"], "i", "u").collect()}
    assert got == {1: 8, 2: 2}


def test_nll_values(spark):
    levels = F.array(arr(40, 0), arr(39, 0))
    assert one(spark, D.nll_isolated_at(levels, F.lit(0), 0.05)) == pytest.approx(20.0)
    dead = F.transform(F.array(arr(1, 0), arr(0.5, 0.5), arr(1, 0)), lambda a: D.safe_log(a))
    assert one(spark, D.nll_isolated_at(dead, F.lit(0), 1.0)) == 690.0
    assert one(spark, D.nll_at(D.safe_log(arr(0.5, 0.25, 0.25)), F.lit(1), 1.0)) == pytest.approx(math.log(4))


def test_softmax_does_not_overflow(spark):
    assert one(spark, D.softmax(arr(1000, 0))) == [1.0, 0.0]
    assert one(spark, D.argmax(arr(0.4, 0.4, 0.2))) == 0


def test_scale_keys_sort_by_value(spark):
    legend = F.create_map(*[F.lit(x) for x in ("10", "high", "2", "mid", "-1", "low")])
    keys, opts = CV.scale_options(legend)
    assert one(spark, keys) == ["-1", "2", "10"] and one(spark, opts) == ["-1: low", "2: mid", "10: high"]


def test_text_predicates(spark):
    yes = ["None of the above", " other ", "Not listed here", "UNSURE", "cannot tell from the text"]
    no = ["others", "none", "the other one", "sure"]
    got = [one(spark, X.is_abstain(F.lit(s))) for s in yes + no]
    assert got == [True] * len(yes) + [False] * len(no)
    assert one(spark, X.clip(F.lit("abcdef"), 3)) == "abc ..." and one(spark, X.clip(F.lit("abc"), 3)) == "abc"
    assert one(spark, X.strip_level(F.lit("2: somewhat"))) == "somewhat"


def test_rare_class_copies(spark):
    shares = [0.2, 0.15, 0.1, 0.05, 0.001, 0.0]  # 0.15 / 0.1 is just below 1.5 as a double
    assert [one(spark, S.class_copies(F.lit(s))) for s in shares] == [1, 1, 1, 3, 6, 6]


def test_length_bucket(spark):
    assert [one(spark, S.length_bucket(F.lit(n))) for n in (1, 64, 65, 2048, 2049, 8192, 8193)] == [64, 64, 128, 2048, 2560, 8192, 10240]


def test_option_labels(spark):
    assert [one(spark, R.option_label(F.lit(i))) for i in (0, 9, 25, 26, 27, 52)] == ["A", "J", "Z", "AA", "AB", "BA"]


def test_question_rejections(spark):
    rows = [
        ("noul", "", None, None, "noul question"), ("noul", None, None, ["", "reads"], None), ("choice", "Which?", ["a"], [None], "choice criteria"),
        ("choice", "", ["a", "b"], [None, None], "question without"), ("score", "How?", None, ["x"], "score criteria"), ("rank", "How?", None, None, "unknown"),
        ("score", "How?", None, ["x", "y"], None), ("choice", "Which?", [str(i) for i in range(256)], [None] * 256, "choice criteria"),
    ]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, type string, instructions string, names array<string>, descs array<string>, want string")
    got = d.select("id", "want", R.question_reason(F.col("type"), F.col("instructions"), F.col("names"), F.col("descs")).alias("r")).collect()
    for x in got:
        assert (x["r"] is None) == (x["want"] is None) and (x["r"] or "").startswith(x["want"] or ""), x


@pytest.mark.parametrize("config", [
    {"temperature": 0}, {"temperature": float("nan")}, {"temperature": True}, {"temperature_by_type": {"bool": 1.0}}, {"temperature_by_type": {"choice": -1}},
    {"temperature_by_type": {"choice": 1.0}, "temperature_by_options": {"a": 1, "b": 0}},
])
def test_temperature_configs_rejected(spark, config):
    with pytest.raises(ValueError):
        A.resolve_temperature(F.lit("choice"), F.lit("state_first"), F.lit(3), config)


def test_record_reasons(spark):
    schema = "type string, logits array<double>, probs array<double>, level_logits array<array<double>>, level_probs array<array<double>>, gold int, want string"
    inf, nan = float("inf"), float("nan")
    rows = [
        ("choice", [1.0, 2.0], None, None, None, 1, None), ("score", None, None, [[0.0, 1.0], [0.0, 2.0]], None, 0, None), ("choice", [1.0, -inf], None, None, None, 0, None),
        (None, [1.0, 2.0], None, None, None, 1, "type"), ("choice", None, None, None, None, 1, "fields"), ("choice", None, None, [[0.0, 1.0], [0.0, 2.0]], None, 0, "isolated levels on another type"),
        ("score", None, None, [[0.0, 1.0, 2.0], [0.0, 1.0]], None, 0, "shape"), ("choice", [1.0], None, None, None, 0, "shape"), ("choice", None, [0.0, 0.0], None, None, 0, "probabilities"),
        ("choice", None, [0.5, 1.5], None, None, 0, "probabilities"), ("choice", [nan, 1.0], None, None, None, 0, "logits"), ("choice", [-inf, -inf], None, None, None, 0, "logits"),
        ("choice", [inf, 1.0], None, None, None, 0, "logits"), ("noul", [1.0, 2.0, 3.0], None, None, None, 0, "noul options"), ("score", None, None, None, [[1.0, 0.0], [1.0, 0.0]], 0, "no level fits"),
        ("choice", [1.0, 2.0], None, None, None, 2, "gold"), ("choice", [1.0, 2.0], None, None, None, -1, "gold"), ("choice", [1.0, 2.0], None, None, None, None, "gold"),
    ]
    d = spark.createDataFrame(rows, schema)
    for x in d.withColumn("r", C.record_reason()).collect():
        assert x["r"] == x["want"], x
