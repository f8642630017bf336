"""Beams, bounds, bands, foreign labels and overlap with hot lines."""
import pytest
from pyspark.sql import functions as F

from adjudica.functions.hashing import pick_index, u8
from adjudica.operators import answers as A
from adjudica.operators import augment as AU
from adjudica.operators import calibrate as C
from adjudica.operators import metrics as M
from adjudica.operators import requests as R
from adjudica.operators import sampling as S
from adjudica.operators import teacher as T


def test_beam_is_the_same_in_the_row_and_by_joins(spark):
    edges = [("root", f"a{i}") for i in range(6)] + [(f"a{i}", f"b{i}{j}") for i in range(5) for j in range(4)] + [(f"b{i}{j}", f"c{i}{j}{k}") for i in range(4) for j in range(4) for k in range(3)]
    e = spark.createDataFrame(edges + edges[:3], "parent string, child string")  # repeated edges count once, a5 and the b4* are dead ends
    w = lambda k, c: pick_index(u8("w", k, c), 50) + 1
    s = spark.range(40).withColumnRenamed("id", "k")
    rows = lambda d: sorted((r["k"], r["path"], round(r["prob"], 9)) for r in d.collect())
    inrow = A.beam_classify(s, e, "k", w, beam=3, depth=3)
    assert rows(inrow) == rows(A.beam_classify(s, e, "k", w, beam=3, depth=3, most_edges=5)) and inrow.count() > 20
    assert "Exchange" not in inrow._jdf.queryExecution().optimizedPlan().toString().replace("ScalarSubquery", "")


def test_shared_prefix_of_a_hot_request(spark):
    d = spark.range(3000).select(F.when(F.col("id") < 2900, 1).otherwise(2).alias("req"), "id", F.array(F.lit("a"), F.lit("b"), (F.col("id") % 7).cast("string")).alias("u"))
    d = d.unionByName(spark.createDataFrame([(3, 1, ["x", "y"]), (4, 1, []), (4, 2, ["x"]), (5, 1, ["a", None, "b"]), (5, 2, ["a", None, "c"])], "req int, id long, u array<string>"))
    got = {r["req"]: (r["n"], r["lcp"], r["units"]) for r in R.shared_prefix_units(d, ["req"], "id", "u").collect()}
    assert got == {1: (2900, 2, 2 + 2900), 2: (100, 2, 102), 3: (1, 2, 2), 4: (2, 0, 1), 5: (2, 2, 4)}


def test_overlap_with_a_line_of_nine_tenths(spark):
    long = "this one line stands in nearly every text of all"
    d = spark.range(2000).select("id", F.when(F.col("id") % 10 > 0, long).when(F.col("id") == 10, "  Short\t ONE ").when(F.col("id") == 20, " ").otherwise("own").alias("t"))
    ev = spark.createDataFrame([(long.upper() + " ",), ("short one",), ("",), (None,)], "t string")
    o = S.eval_overlap(d, "id", "t", ev, "t")
    assert o.filter("n_long = 1 and n_short = 0").count() == 1800 and [tuple(r) for r in o.filter("n_short > 0").collect()] == [(10, 0, 1)]
    plan = o._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 2  # each side normalises once


def test_foreign_labels_come_from_one_other_task(spark):
    pools = {"a": ["a1", "a2", "a3"], "b": [f"b{i}" for i in range(700)], "c": ["c1"]}
    p = spark.createDataFrame([(t, v) for t, vs in pools.items() for v in vs] + [("a", "a1")], "task string, label string")
    d = spark.range(300).withColumn("own", F.when(F.col("id") % 2 == 0, "a").otherwise("b"))
    seen = set()
    for r in AU.foreign_labels(d, "id", F.col("own"), F.lit(5), p).collect():
        of = {v[0] for v in r["foreign"]}
        assert len(of) == 1 and r["own"] not in of and len(set(r["foreign"])) == len(r["foreign"]) == min(5, len(pools[min(of)]))
        seen |= {(r["own"], min(of))}
    assert seen == {("a", "b"), ("a", "c"), ("b", "a"), ("b", "c")}
    alone = AU.foreign_labels(d.filter("own = 'a'"), "id", F.col("own"), F.lit(5), p.filter("task = 'a'")).collect()
    assert all(r["foreign"] == [] for r in alone) and len(alone) == 150


def test_offtopic_probe(spark):
    d = spark.range(200).withColumn("o", F.array(F.lit("x"), F.lit("y"), F.lit("z"))).withColumn("f", F.array(F.lit("p"), F.lit("q")))
    o, g = AU.offtopic_probe(F.col("o"), F.lit(1), F.col("f"), "id")
    rows = d.select(o.alias("o"), g.alias("g")).collect()
    assert {(len(r["o"]), r["g"], tuple(r["o"][:-1])) for r in rows} == {(3, 2, ("p", "q")), (4, 1, ("x", "y", "z"))}


def test_record_bounds(spark):
    ok3 = ["a", "b", "g"]
    rows = [
        ("routing", "hello", ok3, "a", "g", "b", None, None), ("routing", "hi", ok3, "a", "g", "b", None, "state"), ("routing", "x" * 301, ok3, "a", "g", "b", None, "state"),
        ("routing", "hello", ["a", "b"], "a", "a", "b", None, "options"), ("routing", "hello", [f"o{i}" for i in range(10)], "o1", "o2", "o3", None, "options"),
        ("routing", "hello", ok3, "a", "b", "b", None, "generic and catch-all"), ("routing", "hello", ok3, "a", "x", "b", None, "generic and catch-all"), ("routing", "hello", ok3, "z", "g", "b", None, "answer"),
        ("command", "ls", None, "safe", None, None, True, None), ("command", "l", None, "safe", None, None, True, "state"), ("command", "ls", None, "odd", None, None, True, "answer"), ("command", "ls", None, "safe", None, None, None, "outside"),
        ("situation", "s", ok3, "2", None, None, None, None), ("situation", "s", ok3, "3", None, None, None, "answer"), ("situation", "s", ok3, "99999999999", None, None, None, "answer"), ("situation", " ", ok3, "0", None, None, None, "state"),
        ("situation", None, ok3, "0", None, None, None, "state"), ("situation", "s", None, "0", None, None, None, "options"), ("other", "s", ok3, "0", None, None, None, "unknown recipe"), (None, "s", ok3, "0", None, None, None, "unknown recipe"),
    ]
    names = ("recipe", "state", "options", "answer", "generic", "catchall", "outside")
    df = spark.createDataFrame(rows, "recipe string, state string, options array<string>, answer string, generic string, catchall string, outside boolean, want string")
    bad = df.withColumn("got", T.record_reason(*[F.col(c) for c in names])).filter("not got <=> want").collect()
    assert not bad, bad


def test_band(spark):
    d = spark.createDataFrame([(0.8, 1, True), (0.79, 1, False), (0.2, 0, True), (0.21, 0, False), (0.9, 0, False), (0.1, 1, False)], "p double, g int, want boolean")
    assert d.filter(M.band_correct(F.col("p"), F.col("g"), 0.2, 0.8) != F.col("want")).count() == 0


def test_simple_fit(spark):
    import math

    rows = [([0.9, 0.1], 0), ([0.6, 0.4], 1), ([1.0, 0.0], 1), ([0.3, 0.3, 0.4], 2), ([0.5, 0.5], -1), ([0.5, 0.5], 7)]
    df = spark.createDataFrame(rows, "probs array<double>, gold int")
    best = C.fit_simple(df.repartition(3)).collect()[0]

    def nll(t):
        out = 0.0
        for p, g in rows[:4]:
            z = [math.log(x) / t if x > 0 else -math.inf for x in p]
            out += min(-math.log(1e-12), math.log(sum(math.exp(x) for x in z)) - z[g])
        return out / 4

    grid = C.log_grid(C.SIMPLE_LO, C.SIMPLE_HI, C.SIMPLE_N)
    want = min((nll(t), t) for t in grid)
    assert best["nll"] == pytest.approx(want[0], abs=1e-9) and best["t"] == pytest.approx(want[1])
    assert C.fit_simple(df.limit(0)).collect()[0]["t"] is None


def test_last_steps_across_chunks(spark):
    from adjudica.operators import convert as CV

    rows = [("hot", i, f"v{i}") for i in range(1300)] + [("gap", i, f"g{i}") for i in (0, 1, 3, 9)] + [(None, 0, "n0"), (None, 1, "n1"), ("one", 5, None)]
    df = spark.createDataFrame(rows, "g string, step long, v string")
    for k, own in ((3, False), (4, True), (1, False)):
        got = {(r["g"], r["step"]): r["history"] for r in CV.last_k(df, ["g"], "step", "v", k, include_self=own, chunk=16).collect()}
        values = {(g, s): v for g, s, v in rows}
        back = range(k - 1, -1, -1) if own else range(k, 0, -1)
        want = {(g, s): [values[g, s - o] for o in back if values.get((g, s - o)) is not None] for g, s, _ in rows}
        assert got == want, (k, own)


def test_next_actions_stay_in_their_environment(spark):
    from adjudica.operators import convert as CV

    rows = [(e, t, f"env{e % 2}", f"{e % 2}:{(e * 7 + t) % 9}", t + 1, 6) for e in range(40) for t in range(6)] + [(99, 0, "lone", "lone:x", 1, 1)]
    df = spark.createDataFrame(rows, "ep long, t long, env string, act string, step long, n long")
    got = CV.next_actions(df, ["ep", "t"], "ep", "env", "act", own=3, others=4, want=4, keep=F.lit(True)).collect()
    assert len(got) == 240
    for r in got:
        assert r["act"] not in r["candidates"] and len(set(r["candidates"])) == len(r["candidates"]) <= 4 and all(c[0] == r["act"][0] for c in r["candidates"]) and len(r["history"]) == min(3, r["t"])


def resolve(state, path):
    import json
    import re

    at = json.loads(state)
    for name, i in re.findall(r"([A-Za-z_]\w*)|\[(\d+)\]", path):
        at = at[name] if name else at[int(i)]
    return at


def test_mixed_states_place_every_record(spark):
    rows = [(i, None if i == 3 else f'text {i} "q" é\n' * (1 + i % 4), f"ask {i % 2}?", ["a", "b"], i % 2) for i in range(57)]
    df = spark.createDataFrame(rows, "id long, t string, ask string, options array<string>, gold int")
    g = AU.json_groups(df, [], "id", "t", 5, 120, carry=("ask", "options", "gold"))
    pick = lambda vs, p: F.get(F.array(*[F.lit(v) for v in vs]), pick_index(u8(p, "grp", "part"), len(vs)))
    g = g.withColumn("shape", pick(("list", "dict", "array", "nested"), "s")).withColumn("c", pick(("cases", "rows"), "c")).withColumn("f", pick(("text", "body"), "f"))
    state, paths = AU.mixed_state(F.col("recs"), F.col("shape"), F.col("c"), F.col("f"), ("cases", "rows"), ("text", "body"), ("mail", "web"))
    g = g.withColumn("state", state).withColumn("paths", paths).withColumn("qs", AU.path_questions(F.col("recs"), F.col("paths"), 3, ("%s (about %s)", "%2$s - %1$s"), "grp", "part"))
    text = {r[0]: r[1] or "" for r in rows}
    seen, shapes, mixed = [], set(), 0
    for r in g.collect():
        shapes.add(r["shape"])
        mixed += len({x["ask"] for x in r["recs"]}) > 1
        for rec, path in zip(r["recs"], r["paths"]):
            seen.append(rec["key"])
            assert resolve(r["state"], path) == text[rec["key"]], (r["state"], path)
        assert len(r["qs"]) == min(3, len(r["recs"])) and len({q["place"] for q in r["qs"]}) == len(r["qs"])
        for q in r["qs"]:
            rec = r["recs"][q["place"]]
            assert q["gold"] == rec["gold"] and rec["ask"] in q["text"] and f"`{r['paths'][q['place']]}`" in q["text"]
    assert sorted(seen) == list(range(57)) and shapes == {"list", "dict", "array", "nested"} and mixed > 3


def test_rubrics_never_show_the_own_text(spark):
    import json

    opts = F.array(*[F.struct(F.lit(f"l{i}").alias("label"), (F.lit(f"what {i}") if i else F.lit(None).cast("string")).alias("what"), F.lit(f"not {i}").alias("not_for"), F.array(F.lit("own"), F.lit(f"e{i}"), F.lit("x")).alias("examples")) for i in range(4)])
    d = spark.range(300).withColumn("c", F.when(F.col("id") % 2 == 0, "own")).withColumn("o", opts)
    sets, names = (("a", "b", "c"), ("d", "e", "f")), ("c%d", "n-%02d")
    shown = set()
    for r in d.select("c", AU.rubric(F.col("o"), F.col("c"), sets, names, "id").alias("r")).collect():
        assert r["r"][0] in ("c1: l0", "n-01: l0")
        for x in r["r"][1:]:
            name, body = x.split(": ", 1)
            obj = json.loads(body) if body.startswith("{") else {"plain": body}
            keys = next((s for s in sets if set(obj) <= set(s)), None)
            shown.add((keys, len(obj)))
            ex = obj.get(keys[2], []) if keys else []
            assert (r["c"] is None or "own" not in ex) and len(ex) <= 3 and (keys is None or obj[keys[0]].startswith("what"))
    assert {(s, n) for s in sets for n in (1, 2, 3)} | {(None, 1)} == shown


def test_first_flip_takes_the_smallest_edit(spark):
    from adjudica.operators import rules as RU

    d = spark.createDataFrame([(True, True), (True, False), (False, False)], "a boolean, b boolean")
    record = {"a": F.col("a"), "b": F.col("b")}
    edits = RU.clause_edits([("a", "a", ~F.col("a")), ("b", "b", ~F.col("b"))])
    got = lambda rule: [tuple(r["t"]) if r["t"] else None for r in d.select(RU.first_flip(record, edits, rule).alias("t")).collect()]
    assert got(lambda r: F.when(r["a"] & r["b"], "yes").otherwise("no")) == [("a", "no"), ("b", "yes"), ("a+b", "yes")]
    assert got(lambda r: F.lit("always")) == [None, None, None]


def test_vocabulary_and_quantiles_in_buckets(spark):
    from adjudica.operators import compare as K
    from adjudica.operators import convert as CV

    d = spark.createDataFrame([(f"é{i % 50:02d}" if i % 2 else f"a{i % 70}", None if i % 3 else "z") for i in range(500)], "x string, y string")
    got = {(r["field"], r["label"]): r["idx"] for r in CV.label_vocabulary(d, ["x", "y"]).collect()}
    labels = sorted({r["x"] for r in d.collect()}, key=lambda v: v.encode())
    assert got == {**{("x", v): i for i, v in enumerate(labels)}, ("y", "z"): 0}
    import datetime as dt

    rows = [(float(v), 200 if v % 4 else 500, "ok", dt.datetime(2024, 1, 1, 0, 0, v)) for v in range(1, 41)]
    r = K.latency_summary(spark.createDataFrame(rows, "ms double, st int, k string, ts timestamp"), "ms", "st", "k", "ts").collect()[0]
    ok = sorted(v for v, s, _, _ in rows if s == 200)
    assert (r["ok"], r["median_ms"], r["p95_ms"], r["p99_ms"], r["max_ms"]) == (30, (ok[14] + ok[15]) / 2, ok[28], ok[29], ok[29])


def test_advantages_of_a_hot_game(spark):
    import numpy as np

    from adjudica.operators import rollouts as RO

    rows = [("hot" if i % 10 else "cold", i % 4, float((i * 37) % 11)) for i in range(2000)]
    got = RO.advantages(spark.createDataFrame(rows, "g string, t int, v double"), ["g"], "t", "v").collect()
    assert len(got) == 2000
    for g in ("hot", "cold"):
        mean = {t: np.mean([v for a, b, v in rows if a == g and b == t]) for t in range(4)}
        sd = np.std([v - mean[t] for a, t, v in rows if a == g])
        assert all(abs(r["advantage"] - (r["v"] - mean[r["t"]]) / (sd + 1e-6)) < 1e-9 for r in got if r["g"] == g)


def test_assets_named_in_questions_only(spark):
    d = spark.createDataFrame([("see a1", ["a1", "b"], "what of b?"), ("see a1", ["a1", "b"], None), ("a1 and b", ["a1", "b"], "b?")], "s string, a array<string>, q string")
    got = [r[0] for r in d.select(R.asset_reason(F.col("s"), F.col("a"), 4, F.col("q"))[1]).collect()]
    assert got == ["named in a question only: b", "not referenced in the state: b", None]


def test_one_part(spark):
    from adjudica.operators import convert as CV

    d = spark.createDataFrame([(1, [b"x"]), (2, []), (3, [b"a", b"b"]), (4, None)], "i int, p array<binary>")
    good, bad = CV.single_part(d, "p", "image")
    assert [(r["i"], bytes(r["image"])) for r in good.collect()] == [(1, b"x")] and {(r["i"], r["reason"][0]) for r in bad.collect()} == {(2, "0"), (3, "2"), (4, "0")}


def test_curves_against_a_baseline(spark):
    rows = [(c, s, float(v + s)) for s in range(4) for c, v in (("base", 5), ("low", 1), ("high", 9))] + [("low", 9, 0.0)]
    from adjudica.operators import compare as K

    got = {r["c"]: (r["windows"], r["share_lower"], r["mean_base"], r["mean"]) for r in K.compare_curves(spark.createDataFrame(rows, "c string, s int, v double"), "c", "s", "v", "base", F.col("s") < 2).collect()}
    assert got == {"low": (4, 1.0, 5.5, 1.5), "high": (4, 0.0, 5.5, 9.5)}
