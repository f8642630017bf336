"""Work is done once a row and shared by the cores."""
import math
import re

from pyspark.sql import functions as F

from adjudica.functions.hashing import pick_index, u8
from adjudica.operators import answers as A
from adjudica.plans import q_compare as Q
from adjudica.sources.tables import spread


def plan(d) -> str:
    return d._jdf.queryExecution().optimizedPlan().toString()


def test_a_beam_is_folded_once(spark):
    e = spark.createDataFrame([("root", "a"), ("root", "b"), ("a", "c"), ("c", "d"), ("c", "e")], "parent string, child string")
    s = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    d = A.beam_classify(s, e, "k", lambda k, c: pick_index(u8("w", k, c), 50) + 1, beam=3, depth=3)
    assert plan(d).count("md5(") == 3  # one a level
    got = d.select("k", "path").collect()
    assert len(got) == 3 and all(r["path"].startswith("a/c/") for r in got)
    dead = A.beam_classify(s, e.filter("parent <> 'c'"), "k", lambda k, c: F.lit(1.0), beam=3, depth=3)
    assert dead.count() == 0  # every path ends before the depth


def test_splits_without_rows_do_not_count_as_spread(spark):
    cores = spark.sparkContext.defaultParallelism
    one = spark.createDataFrame(spark.sparkContext.parallelize([[(i,) for i in range(999)]] + [[]] * (cores - 1), cores).flatMap(lambda x: x), "i int")
    got = [r["n"] for r in spread(one).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert one.rdd.getNumPartitions() == cores and sum(got) == 999 and max(got) < 999 / cores


def softmaxes(text: str, seen: list[tuple[int, list[int]]]) -> dict[int, str]:
    """Plain form of ordered answers: seen holds (question, questions before it)."""
    words = lambda t: set(re.findall(r"[^\W_]+", t.lower()))
    out = {}
    for k, before in seen:
        known = words(text).union(*[words(Q.ORDER_QS[b][0]) for b in before])
        e = [math.exp(len(words(o) & known)) for o in Q.ORDER_QS[k][1]]
        out[k] = ",".join(str(round(x / sum(e) * 1e6)) for x in e)
    return out


def test_only_words_of_options_go_through_the_orders(spark, tmp_path):
    texts = ["The sea, THE road and the child", "der die und das", "nothing here", "", "la poet of a poet " * 50 + "x" * 1000]
    rows = [(i, "en" if i % 2 else "de", t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    d = Q.question_orders(spark, str(tmp_path))
    assert "array_intersect(split(lower(text" in plan(d)  # the other words are not carried along
    got = {r["doc_id"]: r for r in d.collect()}
    for i, t in enumerate(texts):
        for variant, seen in (("packed", [(0, []), (1, [0]), (2, [0, 1])]), ("reversed", [(2, []), (1, [2]), (0, [2, 1])]), ("alone", [(0, []), (1, []), (2, [])])):
            want = softmaxes(t, seen)
            assert got[i][variant] == ";".join(want[k] for k in range(3))


def test_independence_of_hand_made_texts(spark, tmp_path):
    texts = ["the sea and the road", "der die und das Kind", "of a child of a poet", "other words only", "el mar de la costa"] * 4
    rows = [(i, "en" if i % 2 else "de", t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    scored = Q.ordered_answers(spark, str(tmp_path))
    assert "array_intersect(split(lower(text" in plan(scored)  # the step it shares with question_orders
    assert scored.count() == 5 * len(rows)
    got = {r["task"]: r for r in Q.independence(spark, str(tmp_path)).collect()}
    for lang in ("en", "de"):
        right = []
        for i, of, t in rows:
            if of == lang:
                p = softmaxes(t, [(0, []), (1, []), (2, [])])
                golds = [i % 2, Q.ORDER_LANGS.index(lang), i % 3]
                for k in range(3):
                    values = [int(x) for x in p[k].split(",")]
                    right.append(values.index(max(values)) == golds[k])
        assert got[lang]["n"] == len(right) and got[lang]["acc_alone"] == round(sum(right) / len(right), 6)


def test_many_splits_of_one_row_group_are_spread(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    rows = [(i, "en", f"the sea and the road {i}") for i in range(999)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    small = {"spark.sql.files.maxPartitionBytes": "512", "spark.sql.files.openCostInBytes": "0"}
    kept = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        one = spark.read.parquet(f"{tmp_path}/documents.parquet")
        assert one.rdd.getNumPartitions() >= 3 * cores  # many splits, one of which has all rows
        got = [r["n"] for r in spread(one).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        assert sum(got) == 999 and max(got) < 999 / cores
        even = spark.range(0, 999, 1, 3 * cores)
        assert "Repartition" not in plan(spread(even))  # splits that share the rows are left alone
        assert spread(one.filter("doc_id < 0")).count() == 0
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
