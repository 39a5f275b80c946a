"""Steps that many rows go through: each is worked out once a row, and in enough tasks."""

from pyspark.sql import functions as F

from relcheck.functions import text as T
from relcheck.operators import rules as R
from relcheck.plans import relations
from relcheck.tables import spread


def printed(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_terms_are_normalised_once(spark):
    df = spark.createDataFrame([("holding", "held by", "Cat", "the dog")], "gold string, other string, s string, o string")
    gold, other = F.col("gold"), F.col("other")
    assert printed(df.select(T.hard_score(gold, other))).count("gold#") < 12  # 60 and more before
    assert printed(df.select(T.relation_of_question(gold))).count("gold#") < 6
    assert printed(df.select(T.json_answer(gold))).count("gold#") < 6
    v = df.select(R.relation_verdicts(gold, other, F.col("s"), F.col("o")).alias("v")).first().v
    assert (v.alike, v.close, v.lemma, v.inverse, v.unfit, v.rejected) == df.select(
        T.synonyms(gold, other), T.too_close(gold, other), R.same_lemma(gold, other), R.passive_inverse(gold, other), R.too_close_for_random(gold, other), R.rejection(gold, other, F.col("s"), F.col("o"))
    ).first()


def test_plain_words_are_normalised_like_others(spark):
    given = ["On Top  of", "on top of", "a b c d e f g h i J", "'On'", " on", "on.", "", None, "É on", "on\n", "in-side"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(given)], "k int, x string")
    want = ["on top of", "on top of", "a b c d e f g h i j", "on", "on", "on", "", "", "é on", "on", "in-side"]
    assert [r[0] for r in df.orderBy("k").select(T.normal_relation(F.col("x"))).collect()] == want


def test_triples_of_words(spark, tmp_path):
    texts = ["one, two 3three-four five six7", "ab cd", None, "", "a b c d e f g"]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in relations.triples(spark, str(tmp_path)).collect())
    assert got == [("a", "b", "c"), ("d", "e", "f"), ("four", "five", "six"), ("one", "two", "three")]


def test_spread_keeps_its_tasks(spark):
    df = spread(spark.range(100).withColumn("k", F.col("id") % 50), "k").select("k").distinct()
    parts = df.select(F.spark_partition_id().alias("p")).distinct().count()
    assert df.count() == 50 and parts > 4
