"""Invariants of samplers, augmentations, converters and calibration."""
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from adjudica.functions.hashing import chance, u8
from adjudica.operators import augment as AU
from adjudica.operators import calibrate as C
from adjudica.operators import convert as CV
from adjudica.operators import sampling as S
from adjudica.operators import teacher as T
from adjudica.sources import tables as SRC


def test_chance_is_fair_and_stable(spark):
    n = spark.range(20000).filter(chance(u8("x", "id"), 0.25)).count()
    assert abs(n / 20000 - 0.25) < 0.015
    assert spark.range(20000).repartition(9).filter(chance(u8("x", "id"), 0.25)).count() == n


def test_split_is_disjoint_and_sized(spark):
    d = spark.range(1000).withColumn("task", F.when(F.col("id") < 700, "hot").otherwise("cold"))
    s = S.holdout_split(d, ["task"], "id", 50, 10)
    got = {(x["task"], x["split"]): x["count"] for x in s.groupBy("task", "split").count().collect()}
    assert got == {("hot", "eval"): 50, ("hot", "train"): 650, ("cold", "eval"): 30, ("cold", "train"): 270}


def test_narrow_keeps_gold_and_abstain(spark):
    opts = F.array(*[F.lit(f"o{i}") for i in range(40)], F.lit("None of these"))
    d = spark.range(200).withColumn("o", opts).withColumn("g", (F.col("id") % 41).cast("int"))
    o, g = AU.narrow(F.col("o"), F.col("g"), 10, "id")
    for x in d.select("o", "g", o.alias("n"), g.alias("ng")).collect():
        assert len(x["n"]) == 10 and x["n"][x["ng"]] == x["o"][x["g"]] and "None of these" in x["n"] and len(set(x["n"])) == 10
        assert x["n"] == [v for v in x["o"] if v in x["n"]]


def test_pad_never_repeats(spark):
    d = spark.range(300).select("id", F.lit("own").alias("family"), F.array(F.lit("Alpha"), F.lit("beta")).alias("o"))
    others = spark.createDataFrame([("own", v) for v in ("ALPHA", "gamma", "delta", "Beta", "eps")], "family string, label string")
    for x in AU.pad(d, "id", "family", "o", F.lit(3), others, "p").collect():
        assert x["p"][:2] == ["Alpha", "beta"] and len(x["p"]) == 5 and len({v.lower() for v in x["p"]}) == 5


def test_abstain_augment_gold(spark):
    d = spark.range(500).withColumn("o", F.array(*[F.lit(v) for v in "abcd"]))
    f = F.array(*[F.lit(v) for v in ("x", "y", "z")])
    o, g, k = AU.abstain_options(F.col("o"), F.lit(2), f, 0.8, 0.25, "id")
    kinds = set()
    for x in d.select(o.alias("n"), g.alias("g"), k.alias("k")).collect():
        kinds.add(x["k"])
        if x["k"] == "replace":
            assert x["g"] == len(x["n"]) - 1 and not set("abcd") & set(x["n"])
        else:
            assert x["n"][x["g"]] == "c" and len(x["n"]) == (5 if x["k"] == "append" else 4)
    assert kinds == {"keep", "append", "replace"}


def test_json_groups_respect_the_budget(spark):
    d = spark.range(300).select("id", (F.col("id") % 3).alias("task"), F.repeat(F.lit("x"), (10 + F.col("id") % 50).cast("int")).alias("text"))
    g = AU.json_groups(d, ["task"], "id", "text", 5, 120)
    assert sorted(r["key"] for x in g.collect() for r in x["recs"]) == list(range(300))  # nothing is lost
    for x in g.collect():
        assert 1 <= len(x["recs"]) <= 5
        assert len(x["recs"]) <= 2 or sum(len(r["text"]) for r in x["recs"]) <= 120


def test_json_paths_resolve(spark):
    d = spark.range(40).select("id", F.lit("t").alias("task"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    g = AU.json_groups(d, ["task"], "id", "text", 4, 1000)
    for shape in ("list", "array", "dict", "nested"):
        s, p = AU.json_state(F.col("recs"), F.lit(shape))
        for x in g.select("recs", s.alias("s"), p.alias("p")).collect():
            for r, path in zip(x["recs"], x["p"]):
                v = json.loads(x["s"])
                for part in path.replace("[", ".[").strip(".").split("."):
                    v = v[int(part[1:-1])] if part.startswith("[") else v[part]
                assert v == r["text"]


def test_index_annotation(spark):
    rows = [("[1,2]",), (json.dumps(list(range(8))),), (json.dumps({"a": [{"x": 1}] * 9, "b": [[1]] * 2}),), ("plain text",)]
    got = [x["s"] for x in AU.index_json(spark.createDataFrame(rows, "s string"), "s").collect()]
    assert json.loads(got[0]) == [1, 2] and got[3] == "plain text"
    assert json.loads(got[1])[7] == {"_index": 7, "value": 7}
    deep = json.loads(got[2])
    assert deep["a"][8] == {"_index": 8, "x": 1} and deep["b"] == [[1], [1]]


def test_history_of_a_hot_trajectory(spark):
    d = spark.range(1, 501).select(F.lit("hot").alias("k"), F.col("id").alias("step"), F.concat(F.lit("a"), F.col("id")).alias("act"))
    got = {x["step"]: x["history"] for x in CV.last_k(d, ["k"], "step", "act", 3).collect()}
    assert len(got) == 500 and got[1] == [] and got[2] == ["a1"] and got[400] == ["a397", "a398", "a399"]


def test_overlap_drops_only_long_contexts(spark):
    long = "this is a context of more than forty characters in all"
    tr = spark.createDataFrame([(1, "  This IS a context of more than forty\ncharacters in all"), (2, "short one"), (3, "unrelated")], "id int, c string")
    ev = spark.createDataFrame([(long,), ("short one",)], "c string")
    o = S.eval_overlap(tr, "id", "c", ev, "c")
    assert {x["id"]: (x["n_long"], x["n_short"]) for x in o.collect()} == {1: (1, 0), 2: (0, 1)}
    assert sorted(x["id"] for x in S.drop_overlap(tr, "id", o).collect()) == [2, 3]


def test_letter_choice_rejects(spark):
    text = "Question: Which?\nChoices:\nA. one.\nB. two\nAnswer with the letter."
    d = spark.createDataFrame([(text, "Answer: B"), (text, "Answer: C"), (text, "B"), ("A. only", "Answer: A")], "u string, a string")
    q, o, g = CV.letter_choice(F.col("u"), F.col("a"))
    got = d.select(q.alias("q"), o.alias("o"), g.alias("g")).collect()
    assert (got[0]["q"], got[0]["o"], got[0]["g"]) == ("Which?", ["one", "two"], 1) and [x["g"] for x in got[1:]] == [None] * 3


def test_blank_focus(spark):
    d = spark.createDataFrame([("aa the sentence bb the sentence", '"the sentence"'), ("abc", "short"), ("abc", "not in there")], "s string, f string")
    got = [x["b"] for x in d.select(T.blank_focus(F.col("s"), F.col("f")).alias("b")).collect()]
    assert got == ["aa [...] bb the sentence", None, None]


def test_json_lines_with_damage(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1}\n{"a": \n{"a": 3}\nnot json\n')
    schema = spark.createDataFrame([], "a int").schema
    good, bad = SRC.parse_json(spark.read.text(str(p)), "value", schema)
    assert sorted(x["a"] for x in good.select("rec.a").collect()) == [1, 3] and bad.count() == 2


@pytest.mark.parametrize("true_t", [0.6, 1.8])
def test_temperature_recovery(spark, true_t):
    """Records drawn from softmax(z / T): the fit finds T."""
    rng = np.random.default_rng(11)
    z = rng.normal(0, 2, (4000, 5))
    p = np.exp(z / true_t)
    p /= p.sum(1, keepdims=True)
    gold = (p.cumsum(1) > rng.random((4000, 1))).argmax(1)
    rows = [("choice", [float(x) for x in a], None, int(g)) for a, g in zip(z, gold)]
    d = spark.createDataFrame(rows, "type string, logits array<double>, level_logits array<array<double>>, gold int")
    got = {x["type"]: x for x in C.fit_by_type(d).collect()}
    assert abs(got["choice"]["temperature"] - true_t) < 0.15 and got["choice"]["nll_fitted"] <= got["choice"]["nll_t1"]
    assert got["all"]["temperature"] == got["choice"]["temperature"]


def test_grid_pass_equals_the_expression(spark):
    """The Arrow grid and the built-in expression agree for both kinds of records."""
    rows = [("score", None, [[0.0, 1.0], [0.5, -1.0], [2.0, 0.0]], 1), ("score", None, [[40.0, 0.0], [39.0, 0.0]], 0), ("choice", [0.1, 3.0, float("-inf")], None, 0), ("choice", [1.0, float("-inf")], None, 1)]
    d = spark.createDataFrame([(f"{i}", *r) for i, r in enumerate(rows)], "rid string, type string, logits array<double>, level_logits array<array<double>>, gold int")
    g = C.grid_pass(d, "rid", points=9)
    j = g.join(d, "rid").select("nll", C.record_nll(F.col("t")).alias("want"))
    for x in j.collect():
        assert x["nll"] == pytest.approx(x["want"], rel=1e-9)
