"""Sentences are dealt to all cores and converted once each."""

from pyspark.sql import functions as F

from relcheck.functions import conversion, text
from relcheck.plans import texts

SF = "/root/testdata/sf0.001"


def test_report_counts_repeated_questions(spark):
    rows = [("a", "x", 3), ("a", None, 2), ("b", "x", 1), ("b", "y", 4)]
    once = spark.createDataFrame(rows, "tag string, statement string, times long")
    every = once.select("*", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    told = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert told(conversion.conversion_quality(once, "times")) == told(conversion.conversion_quality(every))


def test_one_file_is_many_tasks(spark):
    each = texts.sentences(spark, SF)
    assert each.rdd.getNumPartitions() == 1
    assert texts.sentence_questions(each).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_white_space_is_what_the_pattern_took(spark):
    rows = [(f"{a}{chr(k)}x{b}{chr(k)}{a}y{chr(k)}{b}",) for k in range(0x10000) if not 0xD800 <= k < 0xE000 for a, b in [("", ""), (" ", "\n"), (" ", " ")]]
    df = spark.createDataFrame([*rows, ("",), (" \n",), (None,)], "t string")
    bare = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    plain = bare(F.regexp_replace("t", r"(?U)\s+", " "))
    assert df.where(~text.stripped(F.col("t")).eqNullSafe(bare("t")) | ~text.spaced(F.col("t")).eqNullSafe(plain)).count() == 0
