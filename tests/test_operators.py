import json

import pytest
from pyspark.sql import functions as F

from relcheck.functions import answers as A
from relcheck.functions import text as T
from relcheck.operators import joins, metrics, rules, sampling, shapes
from relcheck.sources import records
from relcheck.streaming import resume


def values(spark, f, *rows):
    df = spark.createDataFrame([tuple(r) if isinstance(r, (tuple, list)) else (r,) for r in rows], ", ".join(f"c{i} string" for i in range(len(rows[0]) if isinstance(rows[0], (tuple, list)) else 1)))
    return [r[0] for r in df.select(f(*[F.col(c) for c in df.columns])).collect()]


def test_gold_readers_disagree(spark):
    labels = ["No", " false ", "unknown", "not", None, "", "0"]
    assert values(spark, A.gold_yes, *[(x,) for x in labels]) == [False, False, True, True, True, True, False]
    assert values(spark, A.gold_no_within, *[(x,) for x in labels]) == [True, False, True, True, False, False, False]


def test_loose_boolean_and_answered(spark):
    assert values(spark, A.loose_boolean, ("TRUE",), ("no",), ("maybe",), (None,)) == [True, False, None, None]
    assert values(spark, A.answered, ("x",), (" ",), (None,)) == [True, False, False]


def test_strict_head_falls_back(spark):
    assert values(spark, lambda x: A.strict_head(x, fallback=True), ("I think not",), ("sure",), ("",), ("yes\nno",)) == ["No", "Yes", "Invalid", "Yes"]


def test_text_functions(spark):
    assert values(spark, T.normal_relation, (' "Sitting  ON." ',), (None,)) == ["sitting on", ""]
    assert values(spark, T.clean_span, (" a_b  c! ",)) == ["a b c"]
    assert values(spark, T.stem, ("holding",), ("Boxes.",), ("is",), ("walked",), ("cans",)) == ["hold", "boxe", "is", "walk", "cans"]
    assert values(spark, T.third_person, ("carry",), ("watch",), ("hold",), ("be",), ("WATCH",), ("Go",), ("y",)) == ["carries", "watches", "holds", "is", "Watches", "Goes", "ys"]
    assert values(spark, T.token_jaccard, ("a b", "b c"), ("", "x")) == [pytest.approx(1 / 3), 0.0]
    assert values(spark, T.leading_preposition, ("on top of it",), ("under it",)) == ["on top of", "under"]
    assert values(spark, lambda x: T.replaced_once(x, F.lit("on"), F.lit("under")), ("Cat on mat",), ("on on",), ("off",)) == ["Cat under mat", None, None]
    assert values(spark, T.question, ("A cat is on a mat.",), ("Cats sit.",)) == ["Is a cat on a mat?", None]
    assert values(spark, lambda x: T.json_object(x), ('```json\n{"a": 1}\n```',), ("none",)) == ['{"a": 1}', None]
    assert values(spark, T.unquoted, ("\"'x'\"",)) == ["x"]
    assert values(spark, lambda x: T.unquoted(x, pairs_only=True), ('"x"',), ("'x",)) == ["x", "'x"]
    assert values(spark, T.placeholders, ("{b} and {a} and {b}",)) == [["{b}", "{a}"]]


def test_statement_of_question(spark):
    asked = [("Is there a cat on the mat in the image? Please answer with one word.",), ("Is there a cup left to a big box in the image?",), ("Does the man watch a dog in the image?",), ("What?",), (None,)]
    assert [tuple(x) for x in values(spark, T.statement_of_question, *asked)] == [
        ("A cat is on the mat.", "mmrel_spatial_prep"), ("A cup is left to a big box.", "mmrel_spatial_to"), ("The man watches a dog.", "mmrel_action"), (None, "mmrel_fail"), (None, "mmrel_fail"),
    ]


def test_masked_losses(spark):
    df = spark.createDataFrame([([1.0, 2.0, 4.0], [1, 2, 9]), ([1.0], [])], "x array<double>, i array<int>")
    assert [tuple(r[0]) for r in df.select(T.masked_losses(F.col("x"), F.col("i"))).collect()] == [(2, 6.0, 3.0, True), (0, None, None, False)]


def test_array_functions(spark):
    df = spark.range(1).select(F.array(*map(F.lit, [1, 2, 3, 2, 3])).alias("h"), F.array(F.lit(2), F.lit(3)).alias("n"), F.array().cast("array<int>").alias("e"))
    assert df.select(T.subarray_at(F.col("h"), F.col("n"))).first()[0] == 1
    assert df.select(T.subarray_at(F.col("h"), F.col("e"))).first()[0] is None
    spans = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(e).alias("e")) for s, e in [(0, 2), (2, 2), (2, 5)]])
    assert [tuple(x) for x in df.select(T.overlapping(spans, F.lit(1), F.lit(3))).first()[0]] == [(0, 2), (2, 5)]
    text = T.substituted(F.lit("{ab} {a}"), F.create_map(F.lit("{a}"), F.lit("x"), F.lit("{ab}"), F.lit("y")))
    assert df.select(text).first()[0] == "y x"
    assert df.select(T.scaled_box(F.array(F.lit(0.5), F.lit(0.5)), F.lit(10), F.lit(20))).first()[0] == [5.0, 10.0]


def test_rules(spark):
    row = lambda *v: spark.createDataFrame([v], "s string, r string, o string, c string")
    status = lambda *v: row(*v).select(rules.triplet_status(*[F.col(c) for c in "sroc"])).first()[0]
    told = [
        ("low_confidence", "", "on", "mat", "medium"), ("empty_field", "", "on", "mat", "high"), ("subject_eq_object", "Cat", "on", "cat.", "High"), ("relation_len", "cat", "x", "mat", "high"),
        ("too_long", "a b c d e", "on", "mat", "high"), ("too_long", "cat", "a b c d e f", "mat", "high"), ("ok", "a b c d", "sits up on top of", "mat", "high"), ("has_digit", "cat2", "sits on", "mat", "high"),
        ("not_binary", "cat, dog", "on", "mat", "high"), ("not_binary", "cat", "on; by", "mat", "high"), ("ok", "cat", "on, by", "mat", "high"), ("meta_or_attribute", "cat", "is on", "mat", "high"),
        ("meta_or_attribute", "cat", "shown in", "mat", "high"), ("non_entity", "the scene", "near", "mat", "high"), ("vague_relation", "cat", "of", "mat", "high"), ("ok", "cat", "sits on", "mat", "high"),
    ]
    assert [status(*v) for _, *v in told] == [x for x, *_ in told]
    assert values(spark, rules.span_status, (None,), ("x",), ("a b c d e f",), ("on 2",), ("on, by",), ("on the",), ("shown in",), ("scene of",), ("sitting on",)) == [
        "empty_relation", "relation_len", "too_long", "has_digit", "not_binary", "has_article", "meta_relation", "non_entity", None,
    ]
    assert values(spark, rules.rejection, ("holding", "grasping", "man", "cup"), ("on", "upon", "a", "b"), ("held", "holds up", "man", "cup"), ("held by", "watched by", "a", "b"), ("carrying", "washed by", "a", "b"), ("near", "under cup", "man", "the cup"), ("near", "under", "man", "cup")) == [
        "synonym_or_paraphrase", "synonym_or_paraphrase", "morphology", None, None, "mentions_entity", None,
    ]
    assert values(spark, rules.passive_inverse, ("held by", "holding"), ("on", "under"), ("watching", "watched bypass")) == [True, False, True]
    assert values(spark, rules.same_lemma, ("held", "holds"), ("on", "in"), ("", "in"), ("worn", "wearing")) == [True, False, True, True]
    assert values(spark, lambda r, e: rules.mentions(r, e), ("near Cat", "the cat"), ("category", "cat"), ("x", "")) == [True, False, False]
    assert values(spark, T.synonyms, ("holding", "Clutching"), ("on", "on"), ("", ""), ("on", "upon")) == [True, True, False, False]
    assert values(spark, T.too_close, ("watched", "watches it"), ("on", "in"), ("on", "on it"), ("", "x")) == [True, False, True, True]
    assert values(spark, T.hard_score, ("holding", "wearing"), ("looking at", "holding"), ("holding", "grasping"), ("on", "shown in"), ("standing on", "standing behind"), ("sitting at", "sitting behind the wall")) == [7.5, 4.5, -1.0, -1.0, -1.0, -1.0]
    assert values(spark, T.relation_family, ("on top of",), ("wearing a hat",), ("of",)) == ["spatial", "contact", "other"]
    assert values(spark, T.statement, ("the cat", "on", "an mat"), ("'apple'", "in", "Urn")) == ["A cat is on a mat.", "An apple is in an Urn."]
    assert values(spark, A.plausibility, ("Plausible.",), ("it is implausible",), ("not implausibley",), ("implausible or plausible",), ("so plausible",), ("?",)) == ["plausible", "implausible", "implausible", "implausible", "plausible", "parse_error"]
    assert values(spark, lambda x: A.strict_head(x, fallback=True), ("I think\nnot so",), ("It is. not",), ("I think not",)) == ["Yes", "Yes", "No"]
    assert values(spark, rules.bad_ending, ("The cat is.",), ("The cat sits.",)) == [True, False]
    gate = spark.createDataFrame([(None, False, "high"), (True, True, "high"), (True, None, "high"), (True, False, "medium"), (True, False, None)], "p boolean, v boolean, c string")
    assert [r[0] for r in gate.select(rules.teacher_gate(F.col("p"), F.col("v"), F.col("c"))).collect()] == ["teacher_not_plausible", "teacher_not_visually_false", "teacher_not_visually_false", None, "teacher_not_high"]


def test_graph_and_nested(spark):
    df = spark.createDataFrame([(1, ["cat", "mat"], [[0, 1, 5], [0, 9, 1]])], "image int, names array<string>, edges array<array<int>>")
    assert [tuple(r) for r in shapes.graph_triplets(df, ["image"], F.col("names"), F.col("edges")).collect()] == [(1, 0, "cat", "mat", 5)]
    nested = spark.createDataFrame([("a", [(1, [("x", "high")]), (2, None)])], "id string, attempts array<struct<attempt:int, candidates:array<struct<relation:string, confidence:string>>>>")
    assert [tuple(r) for r in shapes.candidates(nested, ["id"], "attempts").collect()] == [("a", 1, 0, "x", "high")]


def test_disjoint_pick_shares_no_image(spark):
    df = spark.createDataFrame([(f"p{i % 3}", f"i{i % 7}", f"j{i % 5}") for i in range(60)], "p string, a string, b string").distinct()
    picked = sampling.disjoint_pick(df, "p", "a", "b", 20, 10, 1).collect()
    images = [x for r in picked for x in (r.a, r.b)]
    assert picked and len(images) == len(set(images))


def test_greedy_unlike(spark):
    x = F.array(*map(F.lit, ["on", "on it", "under", "near", "by"]))
    assert spark.range(1).select(sampling.greedy_unlike(x, T.too_alike)).first()[0] == ["on", "under", "near"]


def test_strict_lookup_fails(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    with pytest.raises(Exception, match="no such key"):
        joins.strict_lookup(a, b, "k").collect()
    agree = joins.agreement(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string"), spark.createDataFrame([(1, "a"), (2, None)], "k int, v string"), "k", "v").first()
    assert tuple(agree) == (1, 1, 1, 1)


def test_metrics_without_rows(spark):
    empty = spark.createDataFrame([], "p boolean, g boolean")
    r = metrics.metrics(empty, F.col("p"), F.col("g")).first()
    assert (r.n, r.accuracy, r.f1) == (0, 0.0, 0.0)


def test_sources_and_sinks(spark, tmp_path):
    path = str(tmp_path / "x.jsonl")
    open(path, "w").write('{"id": 1, "t": "a"}\n\n{"id": 2}\n')
    assert [(r.id, r.t) for r in records.json_lines(spark, path, "id int, t string").orderBy("ord").collect()] == [(1, "a"), (2, None)]
    assert records.optional(spark, str(tmp_path / "none"), "id int").count() == 0
    for text, n in (('{"data": [], "samples": [{"id": 1}]}', 1), ('[{"id": 1}, {"id": 2}]', 2), ('{"x": {"id": 3}}', 1)):
        p = str(tmp_path / f"{n}{len(text)}.json")
        open(p, "w").write(text)
        assert records.json_envelope(spark, p, "id int").count() == n
    df = spark.createDataFrame([(1, "a\tb", None)], "id int, t string, n string")
    records.write_tsv(df, str(tmp_path / "tsv"))
    assert records.tsv(spark, str(tmp_path / "tsv")).first().t == "a b"
    records.write_json(df, str(tmp_path / "json"))
    assert json.loads(spark.read.text(str(tmp_path / "json")).first()[0]) == {"id": 1, "t": "a\tb", "n": None}
    assert "| id | t | n |" in records.markdown(df)


def test_resumed_stream_appends_once(spark, tmp_path):
    jobs, out, check = str(tmp_path / "jobs"), str(tmp_path / "out"), str(tmp_path / "check")
    run = lambda: resume.resumed(spark.readStream.schema("qid int").json(jobs), "qid", lambda df: df.withColumn("answer", F.lit("yes")), out, check).awaitTermination(60)
    spark.createDataFrame([(1,), (2,), (1,)], "qid int").write.json(jobs)
    run()
    spark.createDataFrame([(2,), (3,)], "qid int").write.mode("append").json(jobs)
    run()
    assert sorted(r.qid for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_first_negatives_and_scored(spark, tmp_path):
    spark.createDataFrame([("g1", "yes"), ("g1", "no"), ("g2", "no"), ("g1", "no")], "g string, j string").coalesce(1).write.json(str(tmp_path / "j"))
    resume.first_negatives(spark.readStream.schema("g string, j string").json(str(tmp_path / "j")), "g", "j", str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(60)
    assert sorted(r.g for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["g1", "g2"]
    made = resume.scored(spark.createDataFrame([("a",)], "q string"), lambda: lambda pdf: pdf["q"] + "!")
    assert made.first().answer == "a!"
