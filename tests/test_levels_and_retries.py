"""Levels of equivalence, JSON answers, families, and attempts with retries."""

import json

from pyspark.sql import functions as F

from relcheck.functions import text as T
from relcheck.functions import vocabulary as V
from relcheck.operators import joins, rules
from relcheck.plans.catalogue import QUERIES
from relcheck.streaming import retries


def test_levels(spark):
    known = spark.createDataFrame([("a sitting on",), ("'Holding'",), ("in front",), (None,), ("",)], "k string")
    groups = joins.synonym_index([*V.SYNONYMS, *V.MORE_SYNONYMS], spark)
    terms = {"Sitting on": "exact", "sits on": "lemma", "held": "lemma", "seated on": "synonym", "clutching": "synonym", "in front of": "synonym", "kicking": "unseen", "": "unseen", None: None}
    df = spark.createDataFrame([(t, "n") for t in terms], "t string, _n string")
    out = joins.seen_level(df, "t", known, "k", groups)
    assert out.columns == ["t", "_n", "seen_at"] and {r.t: r.seen_at for r in out.collect()} == terms
    # beside and near share a group with a third term each, not one with each other: synonyms aren't transitive.
    chain = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "c")], "grp long, term string")
    got = joins.seen_level(spark.createDataFrame([("b",), ("c",)], "t string"), "t", spark.createDataFrame([("a",)], "k string"), "k", chain)
    assert {r.t: r.seen_at for r in got.collect()} == {"b": "synonym", "c": "unseen"}
    found = {r.seen_at: r["count"] for r in QUERIES["relation_levels"](spark, "/root/testdata/sf0.001").groupBy("seen_at").count().collect()}
    assert min(found[x] for x in ("exact", "lemma", "synonym", "unseen")) > 0


def test_json_answers(spark):
    answers = {
        '{"a": 1}': ('{"a": 1}', False),
        'x {"a": 1} y': ('{"a": 1}', True),
        '{"b": 2} ```json\n{"a": 1}\n```': ('{"a": 1}', True),
        '{"t": "```{}```"}': ("{}", True),
        "```\nit is {\"a\": 1}.\n```": ('{"a": 1}', True),
        "<think>{</think>{}": ("{}", False),
        "{ broken }": (None, True),
        "none": (None, False),
        None: (None, False),
    }
    df = spark.createDataFrame([(x,) for x in answers], "x string").select("x", T.json_answer(F.col("x")).alias("a"), rules.answer_status(F.col("x")).alias("s"))
    out = df.collect()
    assert {r.x: (r.a.object, r.a.repaired) for r in out} == answers
    assert {r.s for r in out if r.a.object in (None, "{}")} == {"json_parse_error"} and {r.s for r in out if r.a.object == '{"a": 1}'} == {"low_confidence"}
    fine = json.dumps({"subject": "man", "relation": "holding", "object": "cup", "confidence": "High"})
    assert spark.createDataFrame([(fine,)], "x string").select(rules.answer_status(F.col("x"))).first()[0] == "ok"


def test_quality_families(spark):
    want = {"on top of": "spatial", "wearing a hat": "contact", "the top shelf": "spatial", "next tomorrow": "spatial", "melting": "contact", "of": "other", "": "other", None: "other"}
    df = spark.createDataFrame([(x,) for x in want], "x string")
    assert {r.x: r.f for r in df.select("x", T.qc_family(F.col("x")).alias("f")).collect()} == want


def candidate(relation, plausible=True, seen=False, confidence="high"):
    return {"relation": relation, "statement": "", "linguistically_plausible": plausible, "visually_supported": seen, "confidence": confidence}


def test_attempts_are_a_table(spark, tmp_path):
    said = {
        (1, 0): [candidate("grasping"), candidate("kicking", confidence="medium"), candidate("watching"), candidate("watching")],
        (2, 0): "no json",
        (2, 1): [candidate("kicking", seen=True)],
        (2, 2): [candidate("kicking")],
        (3, 0): None,
        (3, 1): [candidate("flying over")],
        (3, 2): [candidate("flying over")],
    }
    calls = []

    def generate(jobs):
        rows = [(r.id, r.attempt, r.gold, r.subject, r.object) for r in jobs.collect()]
        calls.append(sorted((i, a) for i, a, *_ in rows))
        told = lambda x: x if x is None or isinstance(x, str) else json.dumps({"candidates": x})
        return spark.createDataFrame([(*r, told(said[r[0], r[1]])) for r in rows], "id int, attempt int, gold string, subject string, object string, raw string")

    judge_text = lambda c: c.withColumn("text_raw", F.lit("Plausible."))
    judge_image = lambda c: c.withColumn("visual_raw", F.when(F.col("relation") == "flying over", "Yes").otherwise("No, it isn't"))
    jobs = spark.createDataFrame([(1, "holding", "man", "cup"), (2, "holding", "man", "cup"), (3, "holding", "man", "cup"), (3, "holding", "man", "cup"), (None, "x", "y", "z")], "id int, gold string, subject string, object string")
    process = retries.generated(generate, judge_text, judge_image, "id")
    passes = F.col("reason").isNull()
    out = str(tmp_path / "attempts")
    retries.retried(jobs, "id", process, passes, out, 2)
    table = retries.retried(jobs, "id", process, passes, out, 3)
    got = {(r.id, r.attempt): (r.n_candidates, r.relation, r.reason) for r in table.collect()}
    assert table.count() == 7 and got == {
        (1, 0): (4, "watching", None),
        (2, 0): (0, None, "json_parse_error"),
        (2, 1): (1, None, "no_high_confidence_candidate"),
        (2, 2): (1, "kicking", None),
        (3, 0): (0, None, "inference_error"),
        (3, 1): (1, None, "no_high_confidence_candidate"),
        (3, 2): (1, None, "no_high_confidence_candidate"),
    }
    assert [c for c in calls if c] == [[(1, 0), (2, 0), (3, 0)], [(2, 1), (3, 1)], [(2, 2), (3, 2)]]
    ends = {r.id: (r.n_attempts, r.ok, r.attempt, r.drop_reason) for r in retries.outcomes(table, "id", passes, "reason").collect()}
    assert ends == {1: (1, True, 0, None), 2: (3, True, 2, None), 3: (3, False, None, "no_high_confidence_candidate")}
