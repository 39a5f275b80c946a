"""Chosen samples that the rules and readers tell apart."""

from pyspark.sql import functions as F

from relcheck.functions import answers as A
from relcheck.functions import text as T
from relcheck.operators import rules as R

ANSWERS = ["Yes, it is.", "No.", "no, it does not", "Nothing to see", "", "NO", "It is not there. Yes", "Yes and no", "uncertain", "The answer is (B).", "There is no image, so no", "implausible, not plausible"]
READINGS = {
    "fl01": [True, False, False, True, True, True, False, False, True, True, False, False],
    "fl04": ["yes", "no", "no", "parse_error", "parse_error", "no", "yes", "yes", "uncertain", "parse_error", "no", "parse_error"],
    "fl05": ["Yes", "No", "No", "Invalid", "Invalid", "No", "Invalid", "Yes", "Invalid", "Invalid", "Invalid", "Invalid"],
    "fl06": ["yes", "no", "no", "invalid", "invalid", "no", "yes", "yes", "invalid", "invalid", "invalid", "invalid"],
    "fl07": ["yes", "no", "no", None, None, "no", "yes", "yes", None, None, "no", None],
    "fl08": ["Yes", "No", "No", "No", "No", "No", "No", "Yes", "No", "No", "No", "No"],
    "fl09": ["invalid"] * 9 + ["B"] + ["invalid"] * 2,
    "fl10": ["parse_error"] * 11 + ["implausible"],
}
# (subject, relation, object, confidence); then what the cascades say of each.
TRIPLETS = [
    ("", "on", "mat", "medium", "low_confidence", None), ("", "on", "mat", "high", "empty_field", None), ("Cat", "on", "cat.", "High", "subject_eq_object", None), ("cat", "x", "mat", "high", "relation_len", "relation_len"),
    ("a b c d e", "near", "mat", "high", "too_long", None), ("cat", "up b c d e f", "mat", "high", "too_long", "too_long"), ("a b c d", "sits up on top of", "mat", "high", "ok", None), ("cat2", "sits on", "mat", "high", "has_digit", None),
    ("cat, dog", "near", "mat", "high", "not_binary", None), ("cat", "on; by", "mat", "high", "not_binary", "not_binary"), ("cat", "on, by", "mat", "high", "ok", "not_binary"), ("cat", "is on", "mat", "high", "meta_or_attribute", None),
    ("cat", "shown in", "mat", "high", "meta_or_attribute", "meta_relation"), ("the scene", "near", "mat", "high", "non_entity", None), ("cat", "of", "mat", "high", "vague_relation", None), ("cat", "on the side", "mat", "high", "ok", "has_article"),
]
# (gold, candidate), then: synonyms, too close, one lemma, passive inverse, rejection (entities man and the cup), hard score.
RELATIONS = [
    ("holding", "grasping", True, True, False, False, "synonym_or_paraphrase", -1.0),
    ("on", "upon", False, True, False, False, "synonym_or_paraphrase", -1.0),
    ("under", "beneath", False, False, False, False, "synonym_or_paraphrase", 0.5),
    ("held", "holds up", False, False, True, False, "morphology", 0.5),
    ("near", "under cup", False, False, False, False, "mentions_entity", 0.5),
    ("holding", "wearing", False, False, False, False, None, 7.5),
    ("looking at", "holding", False, False, False, False, None, 4.5),
    ("watching", "seen bypass", False, False, False, False, "meta_relation", -1.0),
    ("watching", "watched bypass", False, True, True, True, "synonym_or_paraphrase", -1.0),
    ("next to", "in front of", False, False, False, False, None, 7.5),
]
# (category) and its name; (relation, statement) with entities cat and the mat, and the relation recovered.
CATEGORY_NAMES = [("tree-merged", "tree"), ("floor-wood", "wooden floor"), ("playing-field-other-merged", "playing field"), ("stop-sign", "stop sign"), ("", "")]
RECOVERED = [
    ("sits on", "The cat is on the mat.", "sits on"), ("cat", "cat sits on mat", "sits on"), ("", "cat near mat", "near"), ("the mat", "mat", "the mat"),
    ("on the mat", "cat lies on the mat", "lies on the"), ("", "", ""),
]


def told(spark, rows, n, *cols):
    df = spark.createDataFrame([(i, *r[:n]) for i, r in enumerate(rows)], "i int, " + ", ".join(f"c{k} string" for k in range(n)))
    return [tuple(r) for r in df.orderBy("i").select(*cols).collect()]


def c(k):
    return F.col(f"c{k}")


def test_answer_readers(spark):
    readers = [A.pred_yes, A.yes_no_uncertain, A.strict_head, A.prior_answer, A.first_yes_no, A.cautious_yes_no, A.choice_letter, A.plausibility]
    assert told(spark, [(a,) for a in ANSWERS], 1, *[f(c(0)) for f in readers]) == list(zip(*READINGS.values()))


def test_triplet_rules(spark):
    assert told(spark, TRIPLETS, 4, R.triplet_status(*[c(k) for k in range(4)]), R.span_status(c(1))) == [r[4:] for r in TRIPLETS]


def test_relation_rules(spark):
    rules = [T.synonyms(c(0), c(1)), T.too_close(c(0), c(1)), R.same_lemma(c(0), c(1)), R.passive_inverse(c(0), c(1)), R.rejection(c(0), c(1), F.lit("man"), F.lit("the cup")), T.hard_score(c(0), c(1))]
    assert told(spark, RELATIONS, 2, *rules) == [r[2:] for r in RELATIONS]


def test_nulls_in_relation_rules(spark):
    assert told(spark, [(None, "on"), ("on", None), (None, None)], 2, T.synonyms(c(0), c(1)), T.too_close(c(0), c(1)), R.same_lemma(c(0), c(1)), R.passive_inverse(c(0), c(1))) == [(False, True, True, False)] * 3


def test_names_and_recovered_relations(spark):
    assert told(spark, CATEGORY_NAMES, 1, T.category_name(c(0))) == [r[1:] for r in CATEGORY_NAMES]
    assert told(spark, RECOVERED, 2, R.recovered_relation(c(0), c(1), F.lit("cat"), F.lit("the mat"))) == [r[2:] for r in RECOVERED]
    assert told(spark, [(None, None)], 2, R.recovered_relation(c(0), c(1), c(0), c(1))) == [("",)]
