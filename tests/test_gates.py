import json

import pytest
from pyspark.sql import functions as F

from relcheck.functions import text as T
from relcheck.operators import decisions as D
from relcheck.operators import joins, rules, shapes


def test_validated_mapping(spark):
    rows = [
        (["{a}", "{b}"], {"{a}": " cat ", "{b}": "mat", "{c}": "x"}, "ok"),
        (["{a}", "{b}"], {"{a}": " ", "{c}": "x"}, "ok"),
        (["{b}", "{a}"], {"{a}": " "}, "ok"),
        (["{a}"], {"{a}": "{b}"}, None),
        (["{a}"], {"{a}": "Uncertain"}, None),
        (["{a}"], {"{a}": "cat"}, "uncertain"),
        (["{a}"], None, "ok"),
        ([], {}, None),
        (None, None, None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, needed array<string>, m map<string, string>, told string").orderBy("i")
    found = [r[0] for r in df.select(rules.validated_mapping(F.col("needed"), F.col("m"), F.col("told"))).collect()]
    assert [r["status"] for r in found] == ["ok", "invalid_mapping", "missing_placeholder", "invalid_mapping", "uncertain", "uncertain", "missing_placeholder", "ok", "ok"]
    assert found[0]["mapping"] == {"{a}": "cat", "{b}": "mat"}


def test_quality_and_review(spark):
    rows = [("{a} on {b}", "cat on mat", True), ("{a} on {b}", "cat on {b}", False), ("{a} on {b}", "dog on mat", False), (None, "x", False)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, anonymous string, explicit string, fine boolean").orderBy("i")
    needed, m = F.array(F.lit("{a}"), F.lit("{b}")), F.create_map(F.lit("{a}"), F.lit("cat"), F.lit("{b}"), F.lit("mat"))
    assert all(r[0] == r[1] for r in df.select("fine", rules.explicit_quality(F.col("anonymous"), F.col("explicit"), needed, m)).collect())
    cases = [("ok", {"a": "cat"}, False, False), ("uncertain", {}, False, True), (None, {}, False, True), ("ok", {}, True, True), ("ok", {"a": "the big cat"}, None, True), ("ok", {"a": "cat 2"}, False, True), ("ok", {"a": "Golden cat"}, False, True)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(cases)], "i int, status string, m map<string, string>, repaired boolean, review boolean")
    assert all(r[0] == r[1] for r in df.select("review", rules.needs_review(F.col("status"), F.col("m"), F.col("repaired"))).collect())


def test_prepositions_and_domains(spark):
    said = [("The top of it", ""), ("a next to b", "next to"), ("In front, behind", "in"), ("on top", "on top"), ("Under-the bed", "under"), ("runs on", ""), ("", ""), (None, "")]
    df = spark.createDataFrame(said, "x string, y string")
    assert all(r[0] == r[1] for r in df.select("y", T.leading_preposition(F.col("x"))).collect())
    paths = [("VG\\1.jpg", "vg"), ("a/vg_1.jpg", "vg"), ("a/vg/1.jpg", "other"), ("x/DALL-E/1.png", "dalle"), (None, "other")]
    df = spark.createDataFrame(paths, "x string, y string")
    assert all(r[0] == r[1] for r in df.select("y", T.image_domain(F.col("x"))).collect())


def test_coloured_question(spark):
    df = spark.createDataFrame([("Is the cat in the catalogue?", "Cat", "", "mask"), ("Is a cat on a mat?", "cat", "Mat", None)], "q string, s string, o string, mode string")
    assert [r[0] for r in df.select(T.coloured_question(F.col("q"), F.col("s"), F.col("o"), F.col("mode"))).collect()] == [
        "Is the cat in red mask in the cat in red maskalogue?", "Is a cat in red bounding box on a mat in green bounding box?",
    ]


def test_presence_decides(spark):
    told = [{"id": 7, "question": "Q? \n", "image_path": "p", "label": "yes"}, {"question_id": None, "id": 3, "text": "T", "image": "i", "extra": 1}, {"prompt": "P", "file_name": "f"}]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(told)], "ord long, raw string").orderBy("ord")
    out = shapes.canonical_records(df, "raw", F.col("ord"), "\nyes or no?")
    assert [tuple(r) for r in out.collect()] == [("7", "p", "Q?\nyes or no?", "yes"), (None, "i", "T\nyes or no?", None), ("2", "f", "P\nyes or no?", None)]
    for bad in ('{"text": null, "question": "q", "image": "i"}', '{"text": "t"}', "nothing"):
        with pytest.raises(Exception, match="no text or image"):
            shapes.canonical_records(spark.createDataFrame([(0, bad)], "ord long, raw string"), "raw", F.col("ord")).collect()


def test_content_safe(spark):
    bench = spark.createDataFrame([("b", "x/One.jpg"), (None, "two.png")], "content string, name string")
    pool = spark.createDataFrame([("a", "y/ONE.gif"), ("b", "new"), ("c", "two.png"), (None, "three"), ("d", None), ("e", "five.jpg")], "content string, name string")
    kept = {r.content for r in joins.content_safe(pool, bench, "content", "name").collect()}
    assert kept == {"d", "e"}
    assert joins.content_safe(pool, bench.where("content is null"), "content").count() == 6


def test_gain_gates(spark):
    gain = lambda mean, low, high: F.struct(F.lit(mean).cast("double").alias("mean"), F.lit(low).cast("double").alias("low"), F.lit(high).cast("double").alias("high"))
    clear, none, unsure = gain(0.1, 0.05, 0.15), gain(0.0, -0.01, 0.01), gain(0.04, -0.1, 0.2)
    one = spark.range(1)
    said = lambda c: one.select(c).first()[0]
    assert [said(D.contains_zero(F.lit(a).cast("double"), F.lit(b).cast("double"))) for a, b in [(-1.0, 1.0), (0.1, 1.0), (None, None)]] == [True, False, True]
    assert said(D.closer_to_gold(F.lit(0.9), F.lit(0.6), F.lit(0.5))) and not said(D.closer_to_gold(F.lit(0.6), F.lit(0.4), F.lit(0.5)))
    assert [said(D.token_verdict(w, r)) for w, r in [((clear, none), (clear, clear)), ((clear, unsure), (clear, none)), ((clear, unsure), (none, none)), ((none, none), (clear, clear)), ((unsure, gain(None, None, None)), (none, none))]] == ["D", "B", "C", "A", "A"]
    verdict = lambda w, r, h: said(D.training_verdict((w, w), (r, r), (h, h)))
    assert [verdict(clear, none, clear), verdict(clear, clear, clear), verdict(clear, clear, none), verdict(clear, unsure, none), verdict(none, none, none), verdict(clear, clear, unsure)] == ["D", "C", "B", "B", "A", "A"]


def test_strata(spark):
    df = spark.createDataFrame([("a", True), ("a", False), ("b", True), ("c", None)], "g string, y boolean")
    assert {r.g: (r.n, r.in_strata) for r in D.needs_strata(df, F.col("y"), "g").collect()} == {"a": (2, False), "b": (1, True), "c": (0, True)}
    assert D.needs_strata(df.where("false"), F.col("y")).first().in_strata


def test_joins_with_clashing_columns(spark):
    left = spark.createDataFrame([(1, "a", "x/a.jpg", 5), (2, "b", "b", 6)], "_found int, _d string, _n string, k int")
    right = spark.createDataFrame([(5, True), (6, False)], "k int, __found boolean")
    assert sorted((r["_found"], r["__found"]) for r in joins.strict_lookup(left, right, "k").collect()) == [(1, True), (2, False)]
    assert sorted((r["_found"], r.missing) for r in joins.answered_questions(left, right.where("k = 5"), "k").collect()) == [(1, False), (2, True)]
    assert [r["_d"] for r in joins.content_safe(left, left.where("k = 5"), "_d", "_n").collect()] == ["b"]
