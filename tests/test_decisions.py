from pyspark.sql import functions as F

from relcheck.functions import text as T
from relcheck.operators import decisions, rules, sampling, shapes
from relcheck.streaming import resume


def test_margins_and_rows(spark):
    x = spark.sql("select map('A', -1d, 'B', -3d, 'C', -2d) m, map('A', -1d) one, 0.5d share, cast(null as double) none")
    r = x.select(decisions.margin(F.col("m"), F.lit("A")).alias("a"), decisions.margin(F.col("m"), F.lit("B")).alias("b"), decisions.margin(F.col("one"), F.lit("A")).alias("c"), decisions.likelier(F.col("none"), F.col("share")).alias("d")).first()
    assert tuple(r) == (1.0, -2.0, None, None)
    assert x.select(decisions.report_row(F.lit("v1"), F.col("share"), F.col("none"))).first()[0] == "| v1 | 50.00 |  |"


def test_verdicts_of_missing_values(spark):
    x = spark.sql("select 0.5d a, 0.51d b, 0.6d c, cast(null as double) z")
    v = lambda *n: x.select(decisions.heldout_verdict(*map(F.col, n))).first()[0]
    assert [v("a", "z", "c"), v("a", "b", "c"), v("a", "c", "z"), v("a", "b", "z"), v("c", "a", "z")] == ["Incomplete", "Go B", "Go A", "No-Go B", "No-Go A candidate"]


def test_scale_verdict(spark):
    rows = [("up", 1.2, 9, 5, 10, 10, 2.0), ("up", 1.5, 9, 9, 10, 12, 2.0), ("no", 0.1, 9, 2, 10, 30, 1.0), ("no", 0.2, 9, 2, 10, 14, 1.0), ("flat", 0.1, 5, 6, 1, 1, 0.2)]
    df = spark.createDataFrame(rows, "k string, gain double, fp0 int, fp1 int, fn0 int, fn1 int, base double")
    out = decisions.scale_verdict(df, "k", *[F.col(c) for c in ("gain", "fp0", "fp1", "fn0", "fn1", "base")])
    assert {r.k: r.verdict for r in out.collect()} == {"up": "Go A", "no": "No-Go B", "flat": "No-Go A"}


def test_candidate_lists(spark):
    texts = ['{"candidates": [{"relation": "_on_ top", "visually_supported": false, "confidence": " High"}, {"relation": ""}, 7]}', '{"relation": "near", "linguistically_plausible": "yes"}', "no json", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.candidate_list(F.col("t")).alias("c")).orderBy("i").collect()
    assert [[x.relation for x in r.c] for r in rows] == [["on top"], ["near"], [], []]
    assert (rows[0].c[0].visually_supported, rows[0].c[0].confidence, rows[1].c[0].linguistically_plausible, rows[1].c[0].statement) == (False, "high", True, "")


def test_nested_columns(spark):
    df = spark.sql("select 1 id, named_struct('a', 1, '_b', 2, 'folds', 3) s, array(named_struct('_x', 1, 'y', 2)) l, cast(null as struct<_q: int, r: int>) n, 5 _z")
    r = shapes.public(df, "folds").first().asDict(recursive=True)
    assert r == {"id": 1, "s": {"a": 1}, "l": [{"y": 2}], "n": None}
    r = shapes.retagged(df, {"s": {"a": F.lit(9)}}, id=F.lit(4)).first()
    assert (r.id, r.s.a, r.s._b) == (4, 9, 2)
    r = spark.sql("select cast(null as struct<x: int>) a, named_struct('x', cast(null as int)) b, named_struct('x', 3) c").select(shapes.first_present(F.col("a"), F.col("b"), F.col("c"))).first()
    assert r[0].x == 3


def test_chosen_candidates(spark):
    cols = "id int, gold string, subject string, object string, relation string, rank int, linguistically_plausible boolean, visually_supported boolean, confidence string, verified_a boolean, verified_b boolean"
    row = lambda i, rel, rank, conf, a, b, seen=False: (i, "holding", "man", "cup", rel, rank, True, seen, conf, a, b)
    rows = [row(1, "wearing", 1, "medium", True, True), row(1, "watching", 2, "high", True, False), row(1, "kicking", 3, "high", True, True), row(1, "kicking", 4, "high", True, True), row(1, "grasping", 0, "high", True, True), row(2, "wearing", 1, "low", True, True)]
    out = rules.chosen_candidates(spark.createDataFrame(rows, cols), "id").collect()
    assert [(r.id, r.n_tried, r.relation, r["rank"]) for r in out] == [(1, 3, "kicking", 3)]


def test_samplers_and_targets(spark, tmp_path):
    df = spark.range(100)
    assert sampling.stratified_by(df, F.col("id") % 4, 0.1, 1, "id").count() == 8
    assert sampling.free_resources(spark.createDataFrame([(0, 9.0, 1.0), (1, 5.0, 1.0)], "i int, f double, u double"), "f", "u", 4, 2, 3, "i").count() == 0
    out = str(tmp_path / "out")
    work = lambda x: x.withColumn("ok", F.col("id") % 2 == 0)
    assert resume.until_target(df, "id", work, F.col("ok"), out, 7, 10) == 10
    assert spark.read.parquet(out).count() == 20
    assert resume.until_target(df, "id", work, F.col("ok"), out, 99, 60) == 50
    assert spark.read.parquet(out).select("id").distinct().count() == spark.read.parquet(out).count() == 100
