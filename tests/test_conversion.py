"""Relations of captions and statements of questions, one case for each rule."""

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from relcheck.functions import conversion as C

CAPTIONS = {
    "{A} in daring {B} looked up at {C}": ("looked", "later"),
    "{X} sitting on top of {Y}.": ("sitting on top of", "between"),
    "'{X} showing {Y} painted with {Z}'": ("painted with", "later"),
    "{A} being huggedé by, wrapped in front {B}": ("wrapped in front", "between"),
    "{A} self-healing on  the {B}": ("self-healing on", "between"),
    "{A} leaned against{B}": ("leaned against", "between"),
    "{A} leaned againsté {B}": ("leaned", "between"),
    "{A} walked ontop {B}": ("walked", "between"),
    "{A} walked ON {B}": ("walked on", "between"),
    "{A} is {B}": (None, "fail"),
    "no placeholder walking": (None, "fail"),
    "walking {A} alone": (None, "fail"),
    "{A} resting by the wall": ("resting by", "later"),
    "": (None, "fail"),
    None: (None, "fail"),
}
QUESTIONS = {
    "Is there a cat on the mat? Please answer with one word.": ("There is a cat on the mat.", "rbench_there"),
    "Does the small boy wear  a hat?": ("The small boy wears a hat.", "rbench_does"),
    "Do the boys in red jackets whistle?": ("The boys in red jackets whistle.", "rbench_does_fallback"),
    "Does?": (None, "does_fail"),
    "Is the bird in the image near a shelf?": ("The bird in the image is near a shelf.", "rbench_is_are"),
    "Are the two men running in the image?": ("The two men are running in the image.", "rbench_fallback_ing"),
    "Was the cake cut in two??": ("The cake was cut in two.", "rbench_fallback_ed"),
    "Is the burrito served on a black plate?": ("The burrito is served on a black plate.", "rbench_is_are"),
    "Is this animal a dog?": ("This animal is a dog.", "rbench_fallback_comp"),
    "Is the door behind him open?": ("The door behind him is open.", "rbench_fallback_loc_adj"),
    "Is the door behind the man open?": ("The door is behind the man open.", "rbench_fallback_loc"),
    "Were the shoes under the old bed.?": ("The shoes were under the old bed.", "rbench_fallback_loc"),
    "Is the sky blue?": ("The sky is blue.", "rbench_fallback_last"),
    "Is it?": (None, "is_are_fail"),
    "What is it?": (None, "is_are_fail"),
    " ?": (None, "empty"),
    None: (None, "empty"),
}


def test_caption_relations(spark):
    df = spark.createDataFrame([(c,) for c in CAPTIONS], "c string")
    got = {r.c: (r.x.relation, r.x.source) for r in df.select("c", C.caption_relation(F.col("c")).alias("x")).collect()}
    assert got == CAPTIONS
    only = {r.c: tuple(r.x) for r in df.select("c", C.caption_relation(F.col("c"), True).alias("x")).collect()}
    assert only == {c: x if x[1] == "between" else (None, "fail") for c, x in CAPTIONS.items()}


def test_open_questions_in_one_pass(spark):
    seen = Observation("conversion")
    df = spark.createDataFrame([(q, "No" if q and "?" in q else None) for q in QUESTIONS], "q string, label string")
    out = C.converted(df, "q", "label", observed=seen)
    assert {r.q: (r.statement, r.tag) for r in out.collect()} == QUESTIONS
    told = seen.get
    made = [s for s, _ in QUESTIONS.values() if s]
    assert (told["total"], told["converted"], told["failed"]) == (len(QUESTIONS), len(made), len(QUESTIONS) - len(made))
    assert all(told[f"n_{t}"] == sum(tag == t for _, tag in QUESTIONS.values()) for t in C.TAGS)
    assert {r.gold for r in out.where("q is null").collect()} == {"Yes"} and out.where("gold = 'No'").count() == len(QUESTIONS) - 1


def test_report_counts_duplicates(spark):
    rows = [("Is the sky blue?", "Yes"), ("Is the sky  blue?", "no"), ("Is the sky blue", "x"), ("What?", "x"), ("Is there rain?", "y")]
    got = {r.tag: (r.n, r.converted, r.failed, r.duplicates) for r in C.conversion_quality(C.converted(spark.createDataFrame(rows, "q string, label string"), "q", "label")).collect()}
    assert got == {"rbench_fallback_last": (3, 3, 0, 2), "is_are_fail": (1, 0, 1, 0), "rbench_there": (1, 1, 0, 0), None: (5, 4, 1, 2)}


@pytest.mark.parametrize("question, statement", [("Is there a cat above to the box in the image?", "A cat is above to the box."), ("Does the man hold a cup in the image?", "The man holds a cup.")])
def test_templated_forms(spark, question, statement):
    row = C.converted(spark.createDataFrame([(question, "yes")], "q string, label string"), "q", "label", templated=True).first()
    assert (row.statement, row.gold) == (statement, "Yes") and row.tag.startswith("mmrel_")


def test_a_capital_is_one_letter(spark):
    from relcheck.functions.text import capitalised

    df = spark.createDataFrame([(k, w) for k, w in enumerate(["ßau", "ém", "a", "", "ŉa", "Öl", "1a", "ﬁn"])], "k int, w string")
    assert [r[0] for r in df.orderBy("k").select(capitalised(F.col("w"))).collect()] == ["ẞau", "Ém", "A", "", "ŉa", "Öl", "1a", "ﬁn"]
