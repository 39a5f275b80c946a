"""Relations from captions (SF-12) and statements from questions (SF-21, SF-22), by rules over tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from relcheck.functions import vocabulary as V
from relcheck.functions.answers import gold_no_within
from relcheck.functions.text import capitalised, spaced, statement_of_question, stripped, third_person

PLACEHOLDER = r"\{[^{}]+\}"
BAD_ENDING = r"(?i)\b(is|are|was|were)\.$"
HEAD = r"(?U)\b([A-Za-z][A-Za-z\-]*(?:ing|ed))\b"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def _longest_first(words: list[str]) -> str:
    return "|".join(sorted(words, key=lambda w: (-len(w), w)))


def span_relation(span: Column) -> Column:
    """The first verb in -ing or -ed of a span with the preposition that follows it, in lower case; null if there is none.

    A tokens automaton over the span's heads and what stands between them. Meta heads and auxiliaries are skipped, and so
    is a first head with nothing but a preposition before it (an adjective). Between two heads stands no third one, so a
    preposition after a head lies in the text up to the next head. Compound prepositions are tried before single ones.
    """
    bare = F.regexp_replace(F.coalesce(span, F.lit("")), r"""^[ \t\n"'.,;:()]+|[ \t\n"'.,;:()]+$""", "")
    return let(bare, lambda b: let(F.split(b, HEAD, -1), lambda between: _first_head(b, between)))


def _first_head(bare: Column, between: Column) -> Column:
    before = F.regexp_replace(stripped(F.lower(F.get(between, F.lit(0)))), "^[ ,;:]+|[ ,;:]+$", "")
    adjective = before.isin(*V.SINGLE_PREPOSITIONS, *V.COMPOUND_PREPOSITIONS)
    follows = rf"(?U)^\s*({'|'.join(V.COMPOUND_PREPOSITIONS)}|{_longest_first(V.SINGLE_PREPOSITIONS)})(?!\p{{L}})"

    def state(head: Column, i: Column) -> Column:
        skipped = F.lower(head).isin(*V.SPAN_META_HEADS, *V.SPAN_AUXILIARIES) | ((i == 0) & adjective)
        preposition = F.regexp_extract(F.lower(F.get(between, i + 1)), follows, 1)
        return F.when(~skipped, F.concat(F.lower(head), F.when(preposition != "", F.concat(F.lit(" "), preposition)).otherwise("")))

    return F.get(F.filter(F.transform(F.regexp_extract_all(bare, F.lit(HEAD), 1), state), lambda r: r.isNotNull()), F.lit(0))


def caption_relation(caption: Column, between_only: bool = False) -> Column:
    """SF-12: struct of relation and source: `between` the first two placeholders ({...}), else `later` in any span after a
    placeholder (not with between_only), else null and `fail`. A null caption fails."""
    bare = stripped(F.regexp_replace(stripped(F.coalesce(caption, F.lit(""))), "^[\"']+|[\"']+$", ""))
    spans = F.split(bare, PLACEHOLDER, -1)
    found = F.transform(spans, lambda s, i: F.when(i > 0, span_relation(s)))
    first = F.when(F.size(spans) >= 3, F.get(found, F.lit(1)))
    later = F.lit(None).cast("string") if between_only else F.get(F.filter(found, lambda r: r.isNotNull()), F.lit(0))
    source = F.when(first.isNotNull(), "between").when(later.isNotNull(), "later").otherwise("fail")
    return F.struct(F.coalesce(first, later).alias("relation"), source.alias("source"))


def _sentence(*parts: Column) -> Column:
    """The parts that aren't empty as a sentence with one full stop."""
    kept = F.filter(F.array(*[stripped(p) for p in parts]), lambda p: p != "")
    return F.concat(F.regexp_replace(capitalised(spaced(F.array_join(kept, " "))), "[ .]+$", ""), F.lit("."))


def _joined(tokens: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(tokens, start, length), " ")


def _tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")


def _stems(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.lower(F.regexp_replace(t, "[^A-Za-z]", "")))


def _first_place(items: Column, fits) -> Column:
    """The least index (from 0) of an item that fits(item, index); null if there is none."""
    return F.get(F.filter(F.transform(items, lambda s, i: F.when(fits(s, i), i)), lambda i: i.isNotNull()), F.lit(0))


def _told(statement: Column, tag: str | Column) -> Column:
    return F.struct(statement.alias("statement"), (F.lit(tag) if isinstance(tag, str) else tag).alias("tag"))


def _does(bare: Column) -> Column:
    """Questions with do and does: the verb is the first known one after the first token, else the first token after it that
    isn't one of the words that are no verbs."""
    tokens = _tokens(F.regexp_extract(bare, r"(?i)^(?:Does|Do)\s+(.*)$", 1))

    def placed(p: Column) -> Column:
        known = _first_place(p.stems, lambda s, i: (i > 0) & s.isin(*V.DOES_VERBS))
        other = _first_place(p.stems, lambda s, i: (i > 0) & (s != "") & ~s.isin(*V.NOT_VERBS))
        return let(F.struct(p.tokens.alias("tokens"), known.alias("known"), F.coalesce(known, other).alias("at")), said)

    def said(p: Column) -> Column:
        verb = F.get(p.tokens, p.at)
        verb = F.when(bare.rlike(r"(?i)^does\b"), third_person(verb)).otherwise(verb)
        whole = _sentence(_joined(p.tokens, F.lit(1), p.at), verb, _joined(p.tokens, p.at + 2, F.greatest(F.size(p.tokens) - p.at - 1, F.lit(0))))
        tag = F.when(p.known.isNotNull(), "rbench_does").when(p.at.isNotNull(), "rbench_does_fallback").otherwise("does_fail")
        return _told(F.when(p.at.isNotNull(), whole), tag)

    return let(tokens, lambda t: let(F.struct(t.alias("tokens"), _stems(t).alias("stems")), placed))


IMAGE = r"(?iU)^(.+?)\s+in the image\s+(.+)$"
PLACE = rf"(?iU)\b({_longest_first(V.PLACES)})\b"


def _is_are(bare: Column) -> Column:
    """Questions with is, are, was and were. A subject that `in the image` ends comes first; else the predicate begins at the
    first -ing, else at a participle, another -ed, an article that no place stands before, or a place (a lone adjective at
    the end after a place is the predicate), else it is the last token."""
    form = r"(?i)^(Is|Are|Was|Were)\s+(.*)$"
    trail = r"(?iU)\s+in the image$"
    gerund = lambda s: (F.length(s) > 4) & s.endswith("ing") & ~s.isin(*V.NOT_GERUNDS)
    ed = lambda s: (F.length(s) > 4) & s.endswith("ed")

    def parts(rest: Column) -> Column:
        short = F.when(rest.rlike(trail), stripped(F.regexp_replace(rest, trail, ""))).otherwise(rest)
        return F.struct(F.lower(F.regexp_extract(bare, form, 1)).alias("aux"), rest.rlike(trail).alias("trailing"), short.alias("rest"), _tokens(short).alias("tokens"), F.regexp_extract(short, IMAGE, 1).alias("named"))

    def places(p: Column) -> Column:
        at = lambda pattern: F.regexp_instr(p.rest, F.lit(pattern))
        return let(_stems(p.tokens), lambda stems: F.struct(
            p.alias("p"),
            _first_place(stems, lambda s, i: (i > 0) & gerund(s)).alias("ing"),
            _first_place(stems, lambda s, i: (i > 1) & ed(s)).alias("ed"),
            at(rf"(?iU)\b({_longest_first(V.PARTICIPLES)})\b").alias("participle"),
            at(r"(?iU)\b(a|an|the same)\b").alias("article"),
            at(PLACE).alias("place"),
        ))

    def after(q: Column) -> Column:
        rest = F.substring(q.p.rest, q.place + F.length(F.regexp_extract(q.p.rest, PLACE, 1)), F.length(q.p.rest))
        return F.when(q.place > 1, _tokens(stripped(rest))).otherwise(F.array().cast("array<string>"))

    def chosen(q: Column, after: Column) -> Column:
        rest, tokens, n = q.p.rest, q.p.tokens, F.size(q.p.tokens)
        last = F.element_at(after, -1)
        lone = F.when(F.size(after) > 0, F.lower(last).isin(*V.LAST_ADJECTIVES) & ~F.lower(F.get(after, F.lit(0))).isin("the", "a", "an")).otherwise(False)
        open_ = F.exists(F.slice(_stems(_tokens(q.p.named)), 2, 1 << 20), lambda s: gerund(s) | ed(s))
        noun = (q.p.named != "") & ~open_ & ~q.p.named.rlike(rf"(?iU)^.+\b({_longest_first([*V.PARTICIPLES, *V.PLACES, 'a', 'an', 'the same'])})\b")
        split = lambda i, tag: (_joined(tokens, F.lit(1), i), _joined(tokens, i + 1, n), tag)
        cut = lambda at, tag: (F.substring(rest, F.lit(1), at - 1), F.substring(rest, at, F.length(rest)), tag)
        cases = [
            (noun, (F.concat(q.p.named, F.lit(" in the image")), F.regexp_extract(rest, IMAGE, 2), "rbench_is_are")),
            (q.ing.isNotNull(), split(q.ing, "rbench_fallback_ing")),
            (q.participle > 1, cut(q.participle, "rbench_fallback_ed")),
            (q.ed.isNotNull(), split(q.ed, "rbench_is_are")),
            ((q.article > 1) & ~F.substring(rest, F.lit(1), q.article - 1).rlike(rf"{PLACE}\s+$"), cut(q.article, "rbench_fallback_comp")),
            ((q.place > 1) & lone, (F.substring(rest, F.lit(1), F.length(rest) - F.length(last)), last, "rbench_fallback_loc_adj")),
            (q.place > 1, cut(q.place, "rbench_fallback_loc")),
            (n >= 2, (_joined(tokens, F.lit(1), n - 1), F.element_at(tokens, -1), "rbench_fallback_last")),
        ]
        out = F.struct(F.lit(None).cast("string").alias("subject"), F.lit(None).cast("string").alias("predicate"), F.lit("is_are_fail").alias("tag"))
        for when, (subject, predicate, tag) in reversed(cases):
            out = F.when(when, F.struct(subject.alias("subject"), predicate.alias("predicate"), F.lit(tag).alias("tag"))).otherwise(out)
        return let(out, lambda o: said(o, q.p.aux, q.p.trailing))

    def said(o: Column, aux: Column, trailing: Column) -> Column:
        body = F.concat_ws(" ", stripped(o.subject), aux, stripped(o.predicate))
        more = F.when(trailing & ~F.lower(body).endswith("in the image"), "in the image").otherwise("")
        return _told(F.when(o.subject.isNotNull(), _sentence(F.regexp_replace(body, r"\.+$", ""), more)), o.tag)

    found = let(stripped(F.regexp_extract(bare, form, 2)), lambda r: let(parts(r), lambda p: let(places(p), lambda q: let(after(q), lambda a: chosen(q, a)))))
    return F.when(bare.rlike(form), found).otherwise(_told(F.lit(None).cast("string"), "is_are_fail"))


def open_question_statement(question: Column) -> Column:
    """SF-21 by rules, without a parser: struct of statement and tag; no statement for questions of no known form. Null and
    empty questions: null and `empty`."""
    bare = stripped(F.regexp_replace(stripped(F.coalesce(question, F.lit(""))), r"(?iU)\s*Please answer with one word\.?\s*$", ""))
    there = r"(?iU)^(is|are)\s+there\b"

    def told(bare: Column) -> Column:
        said = _sentence(F.lit("There"), F.lower(F.regexp_extract(bare, there, 1)), F.regexp_replace(bare, there, ""))
        none = _told(F.lit(None).cast("string"), "empty")
        return F.when(bare == "", none).when(bare.rlike(there), _told(said, "rbench_there")).when(bare.rlike(r"(?iU)^do(es)?\b"), _does(bare)).otherwise(_is_are(bare))

    return let(stripped(F.regexp_replace(bare, r"\?+$", "")), told)


#: All tags that a conversion gives.
TAGS = [
    "empty", "rbench_there", "rbench_does", "rbench_does_fallback", "does_fail", "rbench_is_are", "rbench_fallback_ing", "rbench_fallback_ed", "rbench_fallback_comp", "rbench_fallback_loc_adj",
    "rbench_fallback_loc", "rbench_fallback_last", "is_are_fail", "mmrel_spatial_to", "mmrel_spatial_prep", "mmrel_action", "mmrel_fail",
]


def converted(questions: DataFrame, question: str, label: str, templated: bool = False, observed: Observation | None = None) -> DataFrame:
    """SF-22: questions with statement (null: failed), tag, gold (Yes or No), bad_ending. templated takes the forms of SF-20.

    With an Observation, whoever runs the result also gets total, converted, failed and n_<tag> for each tag, from the same
    pass over the data. Columns with these names are replaced."""
    told = (statement_of_question if templated else open_question_statement)(F.col(question))
    out = questions.withColumn("_told", told)
    out = out.withColumns({"statement": F.col("_told.statement"), "tag": F.col("_told.tag"), "gold": F.when(gold_no_within(F.col(label)), "No").otherwise("Yes"), "bad_ending": F.coalesce(F.col("_told.statement").rlike(BAD_ENDING), F.lit(False))}).drop("_told")
    if observed is None:
        return out
    failed = F.col("statement").isNull()
    return out.observe(observed, F.count(F.lit(1)).alias("total"), F.count_if(~failed).alias("converted"), F.count_if(failed).alias("failed"), *[F.count_if(F.col("tag") == t).alias(f"n_{t}") for t in TAGS])


def conversion_quality(done: DataFrame, times: str | None = None) -> DataFrame:
    """SF-22's report on converted questions, a row for each tag and one for all (tag null): n, converted, failed, and
    duplicates, statements that stand in a row before of the same tag (of all for the row of all). times: a column that says
    how many questions a row of done is."""
    said = F.col("statement").isNotNull()
    each = done.groupBy("tag", "statement").agg((F.count(F.lit(1)) if times is None else F.sum(times)).alias("n"))
    whole = each.groupBy("statement").agg(F.sum("n").alias("n")).withColumn("tag", F.lit(None).cast("string"))
    both = each.select("tag", "statement", "n").unionByName(whole)
    return both.groupBy("tag").agg(F.sum("n").alias("n"), F.sum(F.when(said, F.col("n")).otherwise(0)).alias("converted"), F.sum(F.when(~said, F.col("n")).otherwise(0)).alias("failed"), F.sum(F.when(said, F.col("n") - 1).otherwise(0)).alias("duplicates"))
