"""Corpus operators against brute force and on edge cases."""
import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from adjudica.llm import bpe, language, licenses, neardup, neighbours, packing, quality, topk, toxicity, urls

#: Rows with null and empty texts, a long one, repeats, and a column whose name clashes with an operator's own.
EN = "the cat and the dog went to the house with the other one and then it was late in the day"
DE = "der hund und die katze sind nicht auf dem haus und das ist auch schön für den mann"


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "12 34 --", "x"), (4, EN, "x"), (4, EN, "x"), (5, f"{EN} {EN} {DE} {DE} {DE}", "x"), (None, DE, "x"), (6, (DE + " ") * 3000, "x"), (7, "Їжак і ліс", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, score string")


def test_language(spark, texts):
    train = spark.createDataFrame([(EN, "en"), (DE, "de")], "text string, lang string")
    model = language.fit(train, "text", "lang")
    rows = texts.select("doc_id", "score", language.label(F.col("text"), model).alias("r")).collect()
    got = {r["doc_id"]: r["r"] for r in rows}
    assert len(rows) == 9 and [got[i]["lang"] for i in (1, 2, 3)] == ["und"] * 3 and got[1]["score"] == 0 and got[2]["spans"] == []
    assert got[4]["lang"] == "en" and got[None]["lang"] == "de" and got[6]["lang"] == "de" and got[6]["score"] == 1
    assert got[5]["lang"] == "de" and [s["lang"] for s in got[5]["spans"]] == ["en", "de"] and got[5]["spans"][1]["first"] == 2 * len(EN.split())
    assert got[7]["score"] == 0
    none = language.fit(train.limit(0), "text", "lang")
    assert {r[0]["lang"] for r in texts.select(language.label(F.col("text"), none)).collect()} == {"und"}


def test_constant_path_is_the_viterbi_path():
    rng = np.random.default_rng(3)
    for _ in range(60):
        scores = rng.normal(size=(30, 3)) * 2
        best = np.array([scores.sum(0).argmax()])
        if language.constant(scores, np.zeros(30, int), best, 12.0)[0]:
            assert set(language.viterbi(scores, 12.0)) == {best[0]}


def test_toxicity(spark, texts):
    bad = [f"word{i % 26:c} stupid other".replace(f"{i % 26:c}", chr(97 + i % 26)) for i in range(60)]
    words = [f"{chr(97 + i)}{chr(97 + j)}" for i in range(10) for j in range(10)]
    rows = [(f"{words[i]} stupid {words[-i]} fine", 1) for i in range(40)] + [(f"{words[i]} {words[-i]} fine good people", 0) for i in range(99)]
    model = toxicity.fit(spark.createDataFrame(rows, "text string, y int"), "text", "y", least=5)
    assert len(bad) == 60 and model["weights"]["stupid$"] > 2
    said = ["so stupid", "so st0p1d", "so $tupid", "s t u p i d", "stuuuupid", "st.upid", "so fine", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string")
    got = {r[0]: r[1] for r in df.select("i", toxicity.score(F.col("t"), model, spark)).collect()}
    assert all(got[i] >= 0.5 for i in (0, 2, 3, 4, 5)) and all(got[i] < 0.5 for i in (6, 7, 8)) and got[7] == got[8]
    restored = {r[0]: r[1] for r in df.select("i", toxicity.restored_text(F.col("t"), model, spark)).collect()}
    assert restored[2] == "so stupid" and restored[4] == "stupid" and restored[8] is None
    empty = toxicity.fit(spark.createDataFrame(rows[:40], "text string, y int"), "text", "y")
    assert {round(r[0], 6) for r in texts.select(toxicity.score(F.col("text"), empty, spark)).collect()} == {0.0}


@pytest.fixture(scope="module")
def insults(spark):
    words = [f"{chr(97 + i)}{chr(97 + j)}" for i in range(10) for j in range(10)]
    other = "you are a good and dear non worthy people who say hello to all of the fine women in town while we eat l d y o u"
    bad = [(f"{words[i]} {w} {words[-i]}", 1) for i in range(40) for w in ("stupid", "idiot", "imbecile")]
    good = [(f"{words[i]} {other} {words[-i]}", 0) for i in range(99)]
    return spark.createDataFrame(bad + good, "text string, y int")


def test_toxic_words_behind_other_words(spark, insults):
    model = toxicity.fit(insults, "text", "y", least=5)
    assert {"stupid$", "idiot$", "imbecile$"} <= set(model["weights"])
    said = [
        ("l'imbecile", "l imbecile"), ("d'idiot", "d idiot"), ("dear,idiot", "dear idiot"), ("non-idiot", "non idiot"), ('"a":"idiot"', "a idiot"),
        ("a s t u p i d", "a stupid"), ("y o u i d i o t", "you idiot"), ("$ t u p i d", "stupid"), ("s  t  u  p  i  d", "stupid"),
        ("stuupid", "stupid"), ("dear,1d1ot", "dear idiot"), ("s.t-u_p i d", "stupid"), ("fine," * 30 + "idiot", "fine " * 30 + "idiot"),
        ("hello all", "hello all"), ("good,people", "good people"), ("y o u  a r e  g o o d", "you are good"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(said)], "i int, t string")
    got = df.select("i", toxicity.score(F.col("t"), model, spark).alias("s"), toxicity.restored_text(F.col("t"), model, spark).alias("r")).orderBy("i").collect()
    assert [r["r"] for r in got] == [want for _, want in said]
    assert [r["s"] >= 0.5 for r in got] == [True] * 13 + [False] * 3


def test_language_model_counts_every_text(spark, insults):
    corpus = spark.createDataFrame([("Über zyxwv zyxwv",), ("zyxwv 1",), (None,), ("",), ("x" * 200_000,)], "text string")
    got = {r["gram"]: r["n"] for r in toxicity.corpus_grams(corpus.repartition(3), "text", flush=1).collect()}
    assert got == toxicity.word_grams({"über": 1, "zyxwv": 3, "x" * 200_000: 1})
    # a bound of one text leaves the weights with nothing, not the language model
    model = toxicity.fit(insults.withColumnRenamed("text", "said"), "said", "y", bound=1, corpus=corpus.select(F.col("text").alias("said")))
    assert model["lm"]["seen"][4]["zyxw"] == 3 and "idio" not in model["lm"]["seen"][4]
    assert toxicity.fit(insults, "text", "y", bound=1)["lm"]["seen"][4]["idio"] == 40
    assert toxicity.restore("z.y.x.w.v", model["lm"]) == "zyxwv"


def test_licenses(spark, texts):
    said = [(10, "The MIT License. mit  LICENSE, again"), (11, "mit license version"), (12, "Licensed under the (new) Apache License, Version 2.0"), (13, "general public-license"), (14, "permission is hereby granted, free of all charge, to any person obtaining one copy of this software and associated documentation files")]
    df = texts.select("doc_id", "text").unionByName(spark.createDataFrame(said, "doc_id long, text string"))
    rows = licenses.scan(df, "doc_id", "text").collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == 14 and got[1]["n_words"] == 0 and got[4]["labels"] == "" and got[4]["score"] == 0
    assert (got[10]["n_base"], got[10]["first_word"], got[10]["last_word"], got[10]["base_labels"]) == (2, 1, 3, "mit")
    assert got[12]["labels"] == "apache" and got[13]["base_labels"] == "gpl" and got[13]["first_word"] == 0
    assert got[14]["base_labels"] == "" and got[14]["labels"] == "mit" and got[14]["first_word"] is None
    assert licenses.scan(df.limit(0), "doc_id", "text").count() == 0


def test_urls(spark):
    said = [(1, None), (2, "no scheme"), (3, "http://EXAMPLE.net/EN/x"), (4, "https://a.example.net/en/x?y#z"), (5, "http://a.example.com/de/"), (6, "http://x.org/fr/1"), (7, "http://spam-farm.example.org/q"), (8, "http://net"), (9, "http://xnet/"), (9, "http://xnet/"), (10, "a://b?://c/d"), (None, "http://b.net/en/")]
    rows = urls.judge(spark.createDataFrame(said, "page_id long, url string"), "page_id", "url").collect()
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}
    assert len(rows) == 12
    assert got[1] == got[2] == ("", "", None, "allow") and got[3] == ("example.net", "/EN/x", "net/", "block")
    assert got[4][2:] == ("example.net/en/", "allow") and got[5][2:] == ("example.com/de/", "block") and got[6][2:] == ("org/fr/", "allow")
    assert got[7][2:] == (None, "block") and got[8][2:] == (None, "allow") and got[9][2:] == (None, "allow") and got[10][:2] == ("b", "") and got[None][2] == "net/"


def plain_top(v, queries, k, key):
    out = []
    for q in queries:
        best = sorted((key(v[q], x), i) for i, x in v.items() if i != q)[:k]
        out += [(q, r + 1, i, s) for r, (s, i) in enumerate(best)]
    return out


def vector_rows():
    rng = np.random.default_rng(5)
    v = {i: [float(x) for x in rng.integers(-40, 40, 6)] for i in range(300)}
    v |= {i: v[7] for i in range(300, 360)}
    return v, [(i, x) for i, x in v.items()] + [(900, None), (901, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (None, [1.0] * 6)]


def test_top_k(spark):
    v, rows = vector_rows()
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = topk.search(df, "id", "v", F.col("id") % 50 == 0, lane_rows=64, group_rows=3).collect()
    want = plain_top(v, [i for i in v if i % 50 == 0], 5, lambda a, b: -sum(int(x) * int(y) for x, y in zip(a, b)))
    assert sorted(map(tuple, got)) == sorted((q, r, i, -s) for q, r, i, s in want)
    assert topk.search(df.limit(0), "id", "v", F.col("id") % 50 == 0).count() == 0
    assert topk.search(df.filter("id < 3"), "id", "v", F.col("id") == 0).count() == 2


def test_neighbours(spark):
    v, rows = vector_rows()
    df = spark.createDataFrame([*rows, (904, [0.0] * 6)], "id long, v array<double>")
    got = neighbours.search(df, "id", "v", F.col("id") % 50 == 0, lane_rows=64, group_rows=3).collect()
    want = plain_top(v, [i for i in v if i % 50 == 0], 10, lambda a, b: float(np.sqrt(((np.array(a) - np.array(b)) ** 2).sum())))
    have = {(r["query_id"], r["vec_id"]): r["score"] for r in got}
    hit = [have.get((q, i)) for q, _, i, _ in want]
    assert len(got) == len(want) and sum(x is not None for x in hit) >= 0.9 * len(want)
    assert all(abs(have[q, i] - s) < 1e-9 for q, _, i, s in want if (q, i) in have)
    assert neighbours.search(df.limit(0), "id", "v", F.col("id") % 50 == 0).count() == 0


def plain_classes(docs, least=0.8):
    bags = {}
    for i, t in docs:
        w = re.findall(r"\w+", (t or "").lower())
        if w and i is not None:
            bags[i] = collections.Counter(tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4)))
    root = {i: i for i, _ in docs if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in bags:
        for b in bags:
            if a < b:
                both = sum((bags[a] & bags[b]).values())
                if both >= least * (sum(bags[a].values()) + sum(bags[b].values()) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def test_near_duplicates(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(400)]
    base = list(rng.choice(words, 90))
    docs = [(1, None), (2, ""), (3, "one two"), (4, "One, two!"), (5, " ".join(base)), (6, " ".join(base)), (None, " ".join(base)), (8, "... --"), (9, "a b " * 4000)]
    for i in range(40):
        w = list(base)
        for _ in range(int(rng.integers(1, 4))):
            w[int(rng.integers(90))] = f"x{i}"
        docs.append((20 + i, " ".join(w)))
    docs += [(100 + i, " ".join(rng.choice(words, 60))) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("size", F.lit(1))
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(df, "doc_id", "text").collect()}
    assert got == plain_classes(docs)
    kept = neardup.deduplicated(df, "doc_id", "text")
    assert kept.columns == df.columns and sorted(r[0] for r in kept.filter("doc_id is not null").collect()) == sorted(set(got.values())) and kept.filter("doc_id is null").count() == 1
    assert neardup.classes(df.limit(0), "doc_id", "text").count() == 0


def test_bag_minhash_estimates_weighted_jaccard():
    a, b = {1: 5, 2: 1, 3: 9}, {1: 3, 2: 4, 4: 2, 3: 9}
    doc, item, weight = zip(*[(0, k, v) for k, v in a.items()], *[(1, k, v) for k, v in b.items()])
    r = neardup.bag_minhash(np.array(doc), neardup.mix(np.array(item, np.uint64)), np.array(weight), 2, 4096)
    true = sum(min(a.get(k, 0), b.get(k, 0)) for k in {*a, *b}) / sum(max(a.get(k, 0), b.get(k, 0)) for k in {*a, *b})
    assert abs((r[0] == r[1]).mean() - true) < 0.04


def test_bpe_against_the_library(spark, texts):
    tokenizers = pytest.importorskip("public_tokenizers")
    import tiktoken

    ranks = bpe.read_ranks(tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    more = spark.createDataFrame([(50, "naïve 日本語 🙂\n\n  x's 12345 <|endoftext|> " + "ab" * 5000)], "doc_id long, text string")
    df = texts.select("doc_id", "text").unionByName(more)
    rows = bpe.round_trip(df, "doc_id", "text", ranks, tokenizers.PATTERN, keep=True, block_chars=2000).collect()
    assert len(rows) == 10
    texts_by = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    for r in rows:
        ids = enc.encode_ordinary(texts_by[r["doc_id"]])
        assert list(r["ids"]) == ids and r["n_tokens"] == len(ids) and bytes(r["decoded"]).decode() == texts_by[r["doc_id"]]
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    back = bpe.decode(spark.createDataFrame([(1, [64, 65]), (2, None), (3, [])], "i int, x array<int>"), "x", ranks).collect()
    assert back[1]["decoded"] is None and bytes(back[2]["decoded"]) == b""
    assert bpe.round_trip(df.limit(0), "doc_id", "text", ranks, tokenizers.PATTERN).count() == 0


def test_packing(spark, texts):
    rows = packing.pack(texts.select("doc_id", "text", F.lit(1).alias("shard")), "doc_id", packing.blank_tokens(F.col("text"))).collect()
    total = sum(len((r["text"] or "").split()) for r in texts.collect())
    assert sum(r["n_tokens"] for r in rows) == total and {r["bin_id"] for r in rows if r["n_tokens"] == 0} == {None}
    bins = collections.defaultdict(list)
    for r in rows:
        if r["n_tokens"]:
            bins[r["bin_id"]].append((r["offset"], r["n_tokens"], r["capacity"]))
    for b in bins.values():
        b.sort()
        assert all(x[0] + x[1] == y[0] for x, y in zip(b, b[1:])) and b[0][0] == 0
        used = b[-1][0] + b[-1][1]
        assert b[0][2] == min(c for c in packing.CAPACITIES if c >= used)
    assert packing.pack(texts.limit(0), "doc_id", F.lit(1)).count() == 0


def test_best_fit_takes_the_tightest_bin():
    bins, offsets, sizes = packing.best_fit([60, 50, 40, 30, 10], (100,))
    assert bins == [0, 1, 0, 1, 1] and offsets == [0, 0, 60, 50, 80] and sizes == [100, 100]
    assert packing.best_fit([5], (8, 64))[2] == [8]


def test_opening_counts_what_a_size_really_takes():
    def price(sizes, lengths):
        return sum(map(packing.cost, sizes)) / sum(lengths)

    rng = np.random.default_rng(4)
    alike = sorted(rng.integers(130, 201, 2048).tolist(), reverse=True)
    bins, offsets, sizes = packing.best_fit(alike, packing.CAPACITIES)
    used = collections.Counter()
    for b, at, n in zip(bins, offsets, alike):
        assert at == used[b]
        used[b] += n
    assert all(used[b] <= c for b, c in enumerate(sizes)) and sum(alike) / sum(sizes) > 0.95 and price(sizes, alike) < 1.1
    # 257 fills half of 512, so seven of them share 2,048 and three 1,024; two are cheaper alone
    assert packing.best_fit([257] * 10, packing.CAPACITIES)[2] == [2048, 1024]
    assert packing.best_fit([257] * 9, packing.CAPACITIES)[2] == [2048, 512, 512]
    for _ in range(50):
        lengths = sorted(rng.integers(1, 300, 40).tolist(), reverse=True)
        least = packing.opened(lengths, packing.CAPACITIES, False)[2]
        assert price(packing.best_fit(lengths, packing.CAPACITIES)[2], lengths) <= price(least, lengths)


def test_equal_rows_and_long_texts_do_not_fill_a_shard(spark):
    rows = [(7, 100)] * 3000 + [(None, 0)] * 3000 + [(i, 5) for i in range(100, 1100)] + [(-1, 4096 * 3000 + 1), (-2, None)]
    df = spark.createDataFrame(rows, "k long, n long").repartition(4)
    got = packing.pack(df, "k", F.col("n"), shard_docs=512).toPandas()
    assert len(got) == 3000 + 3000 + 1000 + 3001 + 1 and got["n_tokens"].sum() == 300_000 + 5000 + 4096 * 3000 + 1
    assert (got["k"] == 7).sum() == 3000 and got["k"].isna().sum() == 3000 and got[got["n_tokens"] == 0]["bin_id"].isna().all()
    full = got[got["n_tokens"] > 0]
    assert full.groupby("bin_id")["n_tokens"].sum().le(full.groupby("bin_id")["capacity"].first()).all()
    assert not full.duplicated(["bin_id", "offset"]).any()
    assert (full["bin_id"].astype("int64") // 2**32).value_counts().max() < 2 * 512


def test_quality(spark, texts):
    rows = [(f"good plain text number {i} about many different things", 1) for i in range(80)] + [(f"bad {i} %%% $$$ ### !!! ~~~ &&&", 0) for i in range(60)]
    model = quality.fit(spark.createDataFrame(rows, "text string, y int"), "text", "y")
    assert model["rules"]
    out = quality.statistics(spark.createDataFrame([(1, "some other plain words here"), (2, "x %%% $$$ ### !!! &&&"), (3, None), (4, "")], "i int, text string"), "text").select("i", quality.score(model).alias("p"))
    got = {r["i"]: r["p"] for r in out.collect()}
    assert got[1] >= 0.7 > got[2] and got[3] == got[4] and all(0 <= p <= 1 for p in got.values())
    one = quality.fit(spark.createDataFrame(rows[:5], "text string, y int"), "text", "y")
    assert not one["rules"]


def test_pipeline_stages_keep_columns(spark, sf):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(900001, None), (900002, ""), (900003, "1 2 3")], "doc_id long, text string")
    docs = docs.unionByName(odd, allowMissingColumns=True).withColumn("r", F.lit("clash"))
    kept = P.language(spark, docs, sf)
    assert kept.columns == docs.columns and kept.filter("doc_id >= 900001").count() == 0
    assert kept.filter("doc_id < 900001").count() >= 0.95 * (docs.count() - 3)
    one = P.near_duplicates(spark, docs, sf)
    want = plain_classes([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert one.columns == docs.columns and sorted(r["doc_id"] for r in one.select("doc_id").collect()) == sorted(set(want.values()))


def test_neighbours_of_lonely_queries(spark):
    """150 groups of 12 near vectors and 4 vectors far from all: every query gets its k rows, however tight the groups that the sample is drawn from are."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(150, 16)) * 20
    rows = [(100 * (12 * g + i), (centres[g] + rng.normal(size=16) * 0.01).tolist()) for g in range(150) for i in range(12)]
    rows += [(100 * (2000 + i), (rng.normal(size=16) * 500).tolist()) for i in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    got = collections.Counter(r["query_id"] for r in neighbours.search(df, "vec_id", "v", F.col("id") % 100 == 0).collect())
    assert len(got) == len(rows) and set(got.values()) == {10}
    few = neighbours.search(df.limit(6), "vec_id", "v", F.col("id") % 100 == 0).collect()
    assert collections.Counter(r["query_id"] for r in few) == {r[0]: 5 for r in df.limit(6).collect()}
    copies = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(300)] + [(300, [5.0, 5.0])], "vec_id long, v array<double>")
    got = collections.Counter(r["query_id"] for r in neighbours.search(copies, "vec_id", "v", F.col("id") % 100 == 0).collect())
    assert got == {0: 10, 100: 10, 200: 10, 300: 10}


def test_language_words_are_letters(spark):
    train = spark.createDataFrame([(EN, "en"), (DE, "de")], "text string, lang string")
    model = language.fit(train, "text", "lang")
    rows = spark.createDataFrame([(0, "½ ² Ⅷ ①"), (1, "12 ¾ _"), (2, f"{EN} ½"), (3, f"{DE} ①")], "i int, text string")
    got = {r["i"]: r["r"]["lang"] for r in rows.select("i", language.label(F.col("text"), model).alias("r")).collect()}
    assert got == {0: "und", 1: "und", 2: "en", 3: "de"}
    marks = spark.createDataFrame([("हिन्दी में लिखा गया यह वाक्य है", "hi"), (EN, "en")], "text string, lang string")
    r = spark.createDataFrame([("यह हिन्दी है",)], "text string").select(language.label(F.col("text"), language.fit(marks, "text", "lang")).alias("r")).first()["r"]
    assert r["lang"] == "hi" and [(s["first"], s["last"]) for s in r["spans"]] == [(0, 2)]


def test_classifiers_on_texts_that_teach_nothing(spark):
    rows = [("12 34", 1), ("--", 0), ("12 34", 0), ("", 1)] * 30
    df = spark.createDataFrame(rows, "text string, y int")
    model = toxicity.fit(df, "text", "y")
    assert {round(r[0], 6) for r in df.select(toxicity.score(F.col("text"), model, spark)).collect()} == {0.0}
    alike = spark.createDataFrame([(f"{a}{b} word", i % 2) for i, (a, b) in enumerate((x, y) for x in "abcdefgh" for y in "ijklmnop")], "text string, y int")
    model = quality.fit(alike, "text", "y")
    assert model["rules"] == [] and abs(quality.rate(alike, "text", model).first()["score"] - 0.5) < 0.05


def test_quality_leaves_columns_alone(spark, texts):
    rows = [("good words stand in this long and calm sentence", 1), ("### $$$ ###", 0)]
    train = spark.createDataFrame([(f"{t} {i}", y) for i in range(60) for t, y in rows], "text string, y int")
    model = quality.fit(train, "text", "y")
    df = texts.withColumn("s_chars", F.lit("keep")).withColumn("__w", F.lit("w")).withColumn("S_words", F.lit(1))
    got = quality.rate(df, "text", model).collect()
    assert len(got) == 9 and {r["s_chars"] for r in got} == {"keep"} and {r["__w"] for r in got} == {"w"} and {r["S_words"] for r in got} == {1}
    assert all(0 <= r["score"] <= 1 for r in got) and len({r["score"] for r in got if r["doc_id"] == 4}) == 1
    assert quality.rate(df.limit(0), "text", model).count() == 0


def test_long_license_templates(spark):
    """A license text of 400 words is one template: found whole, with a hole, and not in parts below the threshold."""
    rng = np.random.default_rng(5)
    text = [f"w{i}" for i in rng.integers(0, 5000, 400)]
    notice = (licenses.Template(" ".join(text), "long"), licenses.Template("mit license", "mit", True))
    cut = text[:150] + ["other", "words"] + text[150:]
    rows = [(1, "before it " + " ".join(text) + " after"), (2, " ".join(cut)), (3, " ".join(text[:250])), (4, " ".join(text[60:])), (5, " ".join(text[i] for i in rng.permutation(400))), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(df, "doc_id", "text", notices=notice).collect()}
    assert {i: r["labels"] for i, r in got.items()} == {1: "long", 2: "long", 3: "", 4: "long", 5: "", 6: ""}
    assert got[1]["score"] == 1.0 and got[2]["score"] == 398 / 399 and abs(got[4]["score"] - 339 / 399) < 1e-9
    with pytest.raises(ValueError):
        licenses.scan(df, "doc_id", "text", notices=(licenses.Template("one", "x"),))


def test_top_k_leaves_short_lanes_out(spark):
    """Few long vectors hold all best scores: lanes of short ones are not visited, and nothing is lost."""
    rng = np.random.default_rng(9)
    x = rng.integers(-9, 10, size=(900, 6)) * np.where(np.arange(900) % 10 == 0, 50, 1)[:, None]
    x[7] = 0
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, v array<double>")
    ask = F.col("id") % 7 == 0
    packs = topk.vectors.blocks(topk.vectors.clean(df, "vec_id", "v"), ask, 64, 16, by_length=True)
    found = packs.search(topk.lane_search(5, topk.rotation(packs.lanes, packs.width)), topk.FOUND, upto=[1] * packs.n_groups)
    c = topk.cells(packs, topk.floors(packs, found, 5), 16)
    assert c.upto == sorted(c.upto, reverse=True) and c.upto[0] == packs.n_lanes and sum(c.upto) < 0.4 * packs.n_lanes * len(c.upto)  # id 7 has length 0: all lanes
    got = collections.defaultdict(list)
    for r in topk.search(df, "vec_id", "v", ask, k=5, lane_rows=64, group_rows=16).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    for q in range(0, 900, 7):
        s = x @ x[q]
        best = sorted((-int(s[i]), i) for i in range(900) if i != q)[:5]
        assert sorted(got[q]) == [(n + 1, i, -v) for n, (v, i) in enumerate(best)], q
    for lanes in (1000, 7):  # one lane; lanes smaller than a query's results
        again = topk.search(df.limit(60), "vec_id", "v", ask, k=5, lane_rows=lanes, group_rows=3)
        assert again.count() == 5 * 9
