"""Readers of free-text answers and labels. They disagree on purpose and are never merged.

All take and return columns. A null text reads as an empty one unless the function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from relcheck.functions.text import stripped

# What counts as a refusal to answer without a picture.
REFUSAL = (
    r"no image|without (an |the )?image|cannot see|can't see|unable to (see|answer)|"
    r"not (provided|available|given)|no visual|need(s)? (an |the )?image|"
    r"requires (an |the )?image|missing image|don'?t have (an |the )?image|"
    r"do not have (an |the )?image|i (do not|don't|cannot|can't) (see|view|access)|"
    r"can't (view|access)|cannot (view|access)|no picture|without (a |the )?picture|"
    r"there is no (image|picture)|image is missing"
)


def given(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def sentence_words(text: Column) -> Column:
    """Words before the first full stop; commas separate too."""
    return F.split(stripped(F.replace(F.split_part(given(text), F.lit("."), F.lit(1)), F.lit(","), F.lit(" "))), r"(?U)\s+")


def pred_yes(text: Column) -> Column:
    """FL-01: a prediction is No if its first sentence has one of the words No, not, no (in this case); else Yes."""
    return ~F.arrays_overlap(sentence_words(text), F.array(F.lit("No"), F.lit("not"), F.lit("no")))


def gold_yes(label: Column) -> Column:
    """FL-02: a label is No if it is one of no, false, 0, n; else (also null) Yes."""
    return ~F.lower(stripped(given(label))).isin("no", "false", "0", "n")


def gold_no_within(label: Column) -> Column:
    """FL-03: a label is No if `no` stands anywhere in it (unknown and not are No here)."""
    return F.lower(stripped(given(label))).contains("no")


def yes_no_uncertain(text: Column) -> Column:
    """FL-04: yes, no, uncertain or parse_error: by the first word, then by a lone yes or no."""
    raw = F.lower(stripped(given(text)))
    first = F.get(F.split(raw, r"(?U)[\s,.:;!?]+", 2), F.lit(0))
    has = lambda w: raw.rlike(rf"\b{w}\b")
    return (
        F.when(first.isin("yes", "y"), "yes")
        .when(first.isin("no", "n"), "no")
        .when(first.startswith("uncertain") | first.isin("unknown", "unsure"), "uncertain")
        .when(has("no") & ~has("yes"), "no")
        .when(has("yes") & ~has("no"), "yes")
        .when(raw.contains("uncertain"), "uncertain")
        .otherwise("parse_error")
    )


def word_end(ascii_words: bool) -> str:
    """Where a word of ASCII letters ends: before all but letters, digits and _, of Unicode or, with ascii_words, of ASCII."""
    return r"(?![A-Za-z0-9_])" if ascii_words else r"\b"


def strict_head(text: Column, fallback: bool = False, ascii_words: bool = False) -> Column:
    """FL-05: Yes or No at the head of the first line's first sentence, else Invalid, or with fallback FL-01 on that sentence
    (an empty answer stays Invalid). Yesñ is no Yes, as in the reference; with ascii_words it is one, as in SQL on RE2."""
    line = F.split_part(F.split_part(stripped(given(text)), F.lit("\n"), F.lit(1)), F.lit("."), F.lit(1))
    head = F.lower(F.regexp_extract(F.replace(line, F.lit(","), F.lit(" ")), rf"(?i)^\s*(yes|no){word_end(ascii_words)}", 1))
    rest = F.when(pred_yes(line), "Yes").otherwise("No") if fallback else F.lit("Invalid")
    return F.when(head == "yes", "Yes").when(head == "no", "No").when(stripped(given(text)) == "", "Invalid").otherwise(rest)


def prior_answer(text: Column, ascii_words: bool = False) -> Column:
    """FL-06: yes, no or invalid. A refusal is invalid unless it begins with yes or no; what FL-04 can't tell is too.
    ascii_words: of a refusal's beginning, as in strict_head."""
    raw = stripped(given(text))
    # Fixed value: what an answer may begin with.
    head = F.lower(F.regexp_extract(raw, rf"""^[\s"'`]*([Yy]es|[Nn]o|[Yy]|[Nn])({word_end(ascii_words)}|[.,:;!?])""", 1))
    by_head = F.when(head.startswith("y"), "yes").when(head.startswith("n"), "no").otherwise("invalid")
    told = yes_no_uncertain(text)
    return F.when(raw == "", "invalid").when(raw.rlike(f"(?i){REFUSAL}"), by_head).when(told.isin("yes", "no"), told).otherwise("invalid")


def first_yes_no(text: Column, none: str | None = None) -> Column:
    """FL-07: the first yes or no anywhere; `none` (null unless told) if there is neither."""
    found = F.regexp_extract(F.lower(given(text)), r"\b(yes|no)\b", 1)
    return F.when(found != "", found).otherwise(F.lit(none))


def cautious_yes_no(text: Column) -> Column:
    """FL-08: Yes or No by prefix (nothing is No), then by a lone yes; No otherwise."""
    low = F.lower(stripped(given(text)))
    return F.when(low.startswith("yes"), "Yes").when(low.startswith("no"), "No").when(low.contains("yes") & ~low.contains("no"), "Yes").otherwise("No")


def choice_letter(text: Column) -> Column:
    """FL-09: the letter A to D that a multiple-choice answer begins with, or invalid."""
    # Fixed value: the forms of an answer.
    pattern = r"(?i)^(?:the\s+answer\s+is\s+|answer\s*(?:is)?\s*[:\-]?\s*)?\(?([ABCD])\)?(?:[.\):]|\s|$)"
    found = F.upper(F.regexp_extract(stripped(given(text)), pattern, 1))
    return F.when(found != "", found).otherwise("invalid")


def plausibility(text: Column) -> Column:
    """FL-10: implausible before plausible, by the first word and then anywhere (implausible also within a word, if plausible
    stands nowhere else); parse_error otherwise."""
    low = F.lower(stripped(given(text)))
    head = F.get(F.split(low, r"(?U)[\s,.:;!?]+", 2), F.lit(0))
    within = low.contains("implausible") & ~F.replace(low, F.lit("implausible"), F.lit("")).contains("plausible")
    return (
        F.when(head.startswith("implausible"), "implausible")
        .when(head.startswith("plausible"), "plausible")
        .when(within | low.rlike(r"\bimplausible\b"), "implausible")
        .when(low.rlike(r"\bplausible\b"), "plausible")
        .otherwise("parse_error")
    )


def loose_boolean(value: Column, default: bool | None = None) -> Column:
    """FL-11: true, yes, 1 are true, false, no, 0 are false; else the default."""
    low = F.lower(stripped(given(value)))
    return F.when(low.isin("true", "yes", "1"), True).when(low.isin("false", "no", "0"), False).otherwise(F.lit(default))


def answered(text: Column, error: Column | None = None) -> Column:
    """FL-28: an answer that isn't empty and has no error."""
    fine = F.lit(True) if error is None else (error.isNull() | (error == ""))
    return fine & (stripped(given(text)) != "")
