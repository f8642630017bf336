"""Operators without SQL against plain versions, and the edge cases of all of them."""
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from adjudica.llm import language, packing, quality, toxicity, urls

EN = "the cat and the dog went to the house with the other one and then it was late in the day"
DE = "der hund und die katze sind nicht auf dem haus und das ist auch schön für den mann"


# ---- op1
def test_every_labelling_of_six_words():
    rng = np.random.default_rng(1)
    for trial in range(80):
        scores = rng.normal(size=(6, 3)) * rng.choice([1, 6, 20])
        if trial % 4 == 0:
            scores = np.round(scores)  # ties
        worth = lambda path: sum(scores[i, k] for i, k in enumerate(path)) - 12.0 * sum(a != b for a, b in zip(path, path[1:]))
        best = max(map(worth, itertools.product(range(3), repeat=6)))
        assert math.isclose(worth(tuple(language.viterbi(scores, 12.0))), best, abs_tol=1e-9)


def test_language_ties_and_nothing(spark):
    train = spark.createDataFrame([("same words here", "zz"), ("same words here", "aa")], "text string, lang string")
    model = language.fit(train, "text", "lang")
    df = spark.createDataFrame([(1, "same words", "own"), (2, "x" * 300_000, "own")], "i int, text string, lang string")
    got = {r["i"]: r["r"] for r in df.select("i", language.label(F.col("text"), model).alias("r")).collect()}
    assert got[1]["lang"] == "aa" and len(got[1]["spans"]) == 1 and got[2]["lang"] in ("aa", "zz")
    assert df.limit(0).select(language.label(F.col("text"), model)).count() == 0


# ---- op2
def plain_reading(token, lm):
    """The best of all readings of a token: a choice for every character."""
    start = "^" * (lm["order"] - 1)
    choices = [toxicity.options(token[i - 1] if i else None, ch, token[i + 1] if i + 1 < len(token) else None, token[i - 2] if i > 1 else None) for i, ch in enumerate(token)]
    best = []
    for picked in itertools.product(*choices):
        state, score, text = start, 0.0, ""
        for letter, cost in picked:
            score -= cost
            if letter == " ":
                score += toxicity.log_letter(lm, state, "$") if state != start else 0.0
                state, text = start, text + " "
            elif letter:
                score += toxicity.log_letter(lm, state, letter)
                state, text = (state + letter)[1:], text + letter
        score += toxicity.log_letter(lm, state, "$") if state != start else 0.0
        best.append((score, " ".join(text.split())))
    return best


def test_every_reading_of_short_tokens():
    lm = toxicity.letters_lm({"idiot": 5, "stupid": 9, "all": 7, "hello": 4, "is": 9, "lo": 2, "a": 3})
    for token in ("1d10t", "st.u", "a11", "a-l-l", "hel1o", "h3ll0", "aa!!", "i$", "$$$$", "l,o", "i s", "aall"):
        readings = plain_reading(token, lm)
        top = max(s for s, _ in readings)
        assert toxicity.decode(token, lm) in {t for s, t in readings if s > top - 1e-9}, token


def test_nothing_that_could_weigh_is_left_undecoded():
    words = ["idiot", "stupid", "moron"]
    lm = toxicity.letters_lm({w: 50 for w in words} | {"all": 7, "hello": 4, "the": 90})
    model = {"lm": lm, "weights": {f: 2.0 for w in words for f in toxicity.features(w)}}
    known = toxicity.Evidence(model)
    rng = np.random.default_rng(2)
    signs = list("aeiostdump013$!.- mrn")
    some = 0
    for _ in range(3000):
        token = "".join(rng.choice(signs) for _ in range(rng.integers(1, 9)))
        core = token.strip(toxicity.EDGE)
        if toxicity.PLAIN.match(core):
            continue
        read = {frozenset(toxicity.restore(token, lm).split()), frozenset(toxicity.WORD.findall(token))}
        weight = max(sum(max(model["weights"].get(f, 0.0) for f in toxicity.features(w)) for w in ws) for ws in read)
        some += weight > 0
        assert known[token] == weight, token
    assert known["1d10t"] > 0 and known["$tup1d!!"] > 0 and known["the.m0r0n"] > 0 and known["hello$$$"] == 0


def test_toxicity_edges(spark):
    rows = [(f"{a}{b} stupid {b}{a} fine", 1) for a in "abcdefgh" for b in "ijklm"] + [(f"{a}{b} fine good people", 0) for a in "abcdefgh" for b in "ijklmnop"]
    model = toxicity.fit(spark.createDataFrame(rows, "text string, y int"), "text", "y", least=5)
    df = spark.createDataFrame([(1, "nice " * 60_000 + "st0pid", "x"), (2, "$" * 3000, "x"), (3, "same", "x"), (3, "same", "x")], "i int, text string, score string")
    got = [(r["i"], r["score"], r["s"]) for r in df.select("i", "score", toxicity.score(F.col("text"), model, spark).alias("s")).collect()]
    assert len(got) == 4 and {s for _, s, _ in got} == {"x"} and all(0 <= s <= 1 for _, _, s in got) and len({s for i, _, s in got if i == 3}) == 1
    assert df.limit(0).select(toxicity.score(F.col("text"), model, spark)).count() == 0


# ---- op7
def test_url_edges(spark):
    rules = (urls.Rule("block", "shop*sale", False), urls.Rule("block", "promo", False))
    rows = [(1, "http://a.net/" + "x/" * 50_000 + "shop/big/sale", "r"), (2, "http://b.org/shop", "r"), (3, "http://c.org/promo", "r"), (3, "http://c.org/promo", "r"), (4, None, "r"), (5, "", "r")]
    df = spark.createDataFrame(rows, "page_id long, url string, rule string")
    got = sorted((r["page_id"], r["verdict"], r["pattern"] or "") for r in urls.judge(df, "page_id", "url", base=(), patterns=rules).collect())
    assert got == [(1, "block", "shop*sale"), (2, "allow", ""), (3, "block", "promo"), (3, "block", "promo"), (4, "allow", ""), (5, "allow", "")]
    assert urls.judge(df.limit(0), "page_id", "url").count() == 0


# ---- op8
def test_rules_in_plain_python(spark):
    rng = np.random.default_rng(6)
    good = [" ".join(rng.choice(["calm", "words", "of", "some", "length", "stand"], 12)) + "." for _ in range(80)]
    bad = ["".join(rng.choice(list("#$% 123aB\n"), 40)) for _ in range(80)]
    train = spark.createDataFrame([(t, 1) for t in good] + [(t, 0) for t in bad], "text string, y int")
    model = quality.fit(train, "text", "y")
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*good[:20], *bad[:20], "", None, "x " * 50_000])], "i int, text string")
    stats = {r["i"]: r.asDict() for r in quality.statistics(df, "text").collect()}
    assert model["rules"]
    for r in quality.rate(df, "text", model).collect():
        z = model["intercept"] + sum(w for rule, w in model["rules"] if all((stats[r["i"]][n] <= at) == low for n, low, at in rule))
        assert math.isclose(r["score"], 1 / (1 + math.exp(-z)), abs_tol=1e-12)


# ---- op10
def plain_best_fit(lengths, capacities):
    """Every piece looks at every bin."""
    rooms, bins, offsets, filled = [], [], [], []
    for n in lengths:
        fitting = [(room, b) for b, room in enumerate(rooms) if room >= n]
        if fitting:
            _, b = min(fitting)
        else:
            b = len(rooms)
            rooms.append(min(c for c in capacities if c >= n))
            filled.append(0)
        bins.append(b)
        offsets.append(filled[b])
        filled[b] += n
        rooms[b] -= n
    return bins, offsets, [min(c for c in capacities if c >= f) for f in filled]


def test_best_fit_by_looking_at_every_bin():
    rng = np.random.default_rng(7)
    for _ in range(200):
        caps = tuple(sorted(rng.choice([8, 16, 32, 64, 100], rng.integers(1, 4), replace=False).tolist()))
        lengths = sorted(rng.integers(1, caps[-1] + 1, rng.integers(0, 40)).tolist(), reverse=True)
        assert packing.opened(lengths, caps, False) == plain_best_fit(lengths, caps)
        both = [packing.opened(lengths, caps, t) for t in (True, False)]
        assert packing.best_fit(lengths, caps) == min(both, key=lambda r: sum(map(packing.cost, r[2])))


def test_packing_ties(spark):
    df = spark.createDataFrame([(i % 3, "a b c d", "x") for i in range(30)], "doc_id long, text string, bin_id string")
    rows = packing.pack(df, "doc_id", packing.blank_tokens(F.col("text")), capacities=(8, 16)).collect()
    assert len(rows) == 30 and len({(r["bin_id"], r["offset"]) for r in rows}) == 30 and all(r["offset"] + 4 <= r["capacity"] for r in rows)


# ---- pipeline
@pytest.fixture(scope="module")
def pipeline():
    return pytest.importorskip("corpus_pipeline")


def test_pipeline_rows(spark, sf, pipeline):
    """Every stage on all that the one before kept, its decisions taken by the operators alone."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one = pipeline.language(spark, docs, sf)
    two = pipeline.toxicity(spark, one, sf)
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    before, after = ({r["doc_id"] for r in d.select("doc_id").collect()} for d in (one, two))
    assert two.columns == docs.columns and after <= before
    assert sum(labels.get(i) == 0 for i in before - after) == 0 and len(before - after) < 0.2 * len(before)
    three = pipeline.near_duplicates(spark, two, sf)
    kept = {r["doc_id"]: len((r["text"] or "").split()) for r in three.collect()}
    packed = pipeline.best_fit_packing(spark, three, sf).collect()
    total = {}
    for r in packed:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_tokens"]
    assert total == kept
    assert sorted((r["doc_id"], r["piece"], r["n_tokens"]) for r in pipeline.run(spark, sf).collect()) == sorted((r["doc_id"], r["piece"], r["n_tokens"]) for r in packed)


def test_pipeline_of_nothing(spark, sf, pipeline):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
