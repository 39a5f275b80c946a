"""Rule cascades: the first rule that fails names the status (FL-12 to FL-29); what follows from them (SF-19, UD-02)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relcheck.functions import vocabulary as V
from relcheck.functions.text import both_normal, clean_span, first_word, json_object, lemma, let, meta_relation, normal_alike, normal_close, normal_relation, normal_synonyms, share_group, stripped, substituted, synonyms, too_alike, too_close, unquoted, without_article


def cascade(rules: list[tuple[str, Column]], passed: str | None = "ok") -> Column:
    """The name of the first condition that holds (null doesn't), else `passed`."""
    out = F.lit(passed)
    for name, fails in reversed(rules):
        out = F.when(fails, name).otherwise(out)
    return out


def reasons(rules: list[tuple[str, Column]]) -> Column:
    """FL-25: the names of all conditions that hold."""
    return F.array_compact(F.array(*[F.when(fails, F.lit(name)) for name, fails in rules]))


def n_words(x: Column) -> Column:
    return F.size(F.filter(F.split(x, r"(?U)\s+"), lambda w: w != ""))


def triplet_status(subject: Column, relation: Column, obj: Column, confidence: Column) -> Column:
    """FL-12: quality of an extracted (subject, relation, object). Only high confidence passes, and it comes before
    emptiness; nulls are empty fields."""

    def of(t: Column) -> Column:
        s, r, o = t["s"], t["r"], t["o"]
        entity_words = F.concat(F.split(normal_relation(s), " "), F.split(normal_relation(o), " "))
        return cascade(
            [
                ("low_confidence", F.lower(F.trim(F.coalesce(confidence, F.lit("")))) != "high"),
                ("empty_field", (s == "") | (r == "") | (o == "")),
                ("subject_eq_object", normal_relation(s) == normal_relation(o)),
                ("relation_len", ~F.length(r).between(2, 40)),
                ("too_long", (n_words(r) > 5) | (n_words(s) > 4) | (n_words(o) > 4)),
                ("has_digit", F.concat(s, r, o).rlike(r"\p{Nd}")),
                ("not_binary", s.contains(",") | o.contains(",") | r.contains(";")),
                ("meta_or_attribute", first_word(r).isin(*V.ATTRIBUTE_HEADS) | meta_relation(r)),
                ("non_entity", F.arrays_overlap(entity_words, F.array(*[F.lit(w) for w in V.NON_ENTITY]))),
                ("vague_relation", normal_relation(r).isin(*V.VAGUE)),
            ]
        )

    return let(F.struct(clean_span(subject).alias("s"), clean_span(relation).alias("r"), clean_span(obj).alias("o")), of)


def answer_status(raw: Column) -> Column:
    """FL-12 of a model's answer: json_parse_error if it has no JSON object or an empty one, else the status of its subject,
    relation, object and confidence."""
    found = json_object(raw)
    parsed = F.from_json(found, "subject string, relation string, object string, confidence string")
    empty = found.isNull() | found.rlike(r"^\{\s*\}$")
    return F.when(empty, "json_parse_error").otherwise(triplet_status(parsed["subject"], parsed["relation"], parsed["object"], parsed["confidence"]))


def span_status(relation: Column) -> Column:
    """FL-13: why a generated relation can't be used; null if it can."""

    def of(t: Column) -> Column:
        r, n = t["r"], t["n"]
        head = F.split_part(n, F.lit(" "), F.lit(1))
        return cascade(
            [
                ("empty_relation", r == ""),
                ("relation_len", ~F.length(r).between(2, 40)),
                ("too_long", n_words(r) > 5),
                ("has_digit", r.rlike(r"\p{Nd}")),
                ("not_binary", r.rlike("[,;]")),
                ("has_article", n.rlike(r"\b(a|an|the)\b")),
                ("meta_relation", head.isin(*V.META_HEADS)),
                ("non_entity", head.isin(*V.NON_ENTITY)),
            ],
            None,
        )

    return let(clean_span(relation), lambda r: let(F.struct(r.alias("r"), normal_relation(r).alias("n")), of))


def too_close_for_random(gold: Column, other: Column) -> Column:
    """FL-18: too alike, or synonyms."""
    return too_alike(gold, other) | synonyms(gold, other)


def rejection(gold: Column, candidate: Column, subject: Column, obj: Column) -> Column:
    """FL-14: why a candidate can't be the negative of gold; null if it can."""
    return relation_verdicts(gold, candidate, subject, obj)["rejected"]


def relation_verdicts(gold: Column, candidate: Column, subject: Column, obj: Column) -> Column:
    """FL-14, FL-17 to FL-23 at once: struct of alike, close, lemma, inverse, unfit and rejected. Both terms are normalised and
    each rule is judged once a row."""

    def judged(n: Column) -> Column:
        x, y = n["x"], n["y"]
        return F.struct(normal_synonyms(x, y).alias("alike"), normal_close(x, y).alias("close"), normal_lemma(x, y).alias("lemma"), normal_inverse(x, y).alias("inverse"))

    def told(n: Column, v: Column) -> Column:
        x, y = n["x"], n["y"]
        rules = [
            ("synonym_or_paraphrase", v["close"] | share_group(x, y, V.MORE_SYNONYMS)),
            ("morphology", v["lemma"]),
            ("inverse", v["inverse"]),
            ("mentions_entity", mentions(candidate, subject, obj)),
        ]
        unfit = normal_alike(x, y) | v["alike"]
        return F.struct(*[v[k].alias(k) for k in ("alike", "close", "lemma", "inverse")], unfit.alias("unfit"), F.coalesce(span_status(candidate), cascade(rules, None)).alias("rejected"))

    return both_normal(gold, candidate, lambda x, y: let(F.struct(x.alias("x"), y.alias("y")), lambda n: let(judged(n), lambda v: told(n, v))))


def teacher_gate(plausible: Column, visually_supported: Column, confidence: Column) -> Column:
    """FL-15: why a teacher's flags don't pass, null if they do; null flags don't, medium and high confidence both do."""
    rules = [
        ("teacher_not_plausible", ~plausible.eqNullSafe(True)),
        ("teacher_not_visually_false", ~visually_supported.eqNullSafe(False)),
        ("teacher_not_high", ~F.coalesce(confidence, F.lit("")).isin("high", "medium")),
    ]
    return cascade(rules, None)


# Parts of entities' names that are finer than a person would check at a glance.
FINE_NAMES = ("model", "tesla", "sparrow", "retriever", "robin", "golden", "siamese")


def validated_mapping(needed: Column, mapping: Column, told: Column) -> Column:
    """FL-16: struct of status and mapping (the needed names with their stripped values) of placeholders and the map of their
    entities; told is what the model said of itself. The first placeholder that fails decides: missing_placeholder if the map
    lacks it, invalid_mapping if its value is blank, null or another placeholder. Then uncertain, if a value or told says so,
    else ok. A null map lacks every name; without placeholders any map is ok."""
    value = lambda p: stripped(F.coalesce(F.try_element_at(mapping, p), F.lit("")))
    has = lambda p: F.coalesce(F.map_contains_key(mapping, p), F.lit(False))
    each = F.transform(F.array_compact(F.coalesce(needed, F.array().cast("array<string>"))), lambda p: F.struct(p.alias("name"), value(p).alias("value"), has(p).alias("has")))
    wrong = lambda e: ~e["has"] | (e["value"] == "") | (e["value"].startswith("{") & e["value"].endswith("}"))
    first = F.get(F.filter(each, wrong), F.lit(0))
    unsure = F.exists(each, lambda e: F.upper(e["value"]) == "UNCERTAIN") | told.eqNullSafe("uncertain")
    status = cascade([("missing_placeholder", ~first["has"]), ("invalid_mapping", first["has"]), ("uncertain", unsure)])
    return F.struct(status.alias("status"), F.map_from_entries(F.transform(F.array_distinct(each), lambda e: F.struct(e["name"], e["value"]))).alias("mapping"))


def explicit_quality(anonymous: Column, explicit: Column, needed: Column, mapping: Column) -> Column:
    """FL-16: whether an explicit caption is the anonymous one with its placeholders replaced, and none of them is left."""
    left = F.exists(needed, lambda p: explicit.contains(p))
    return F.coalesce((substituted(anonymous, mapping) == explicit) & ~left, F.lit(False))


def needs_review(status: Column, mapping: Column, repaired: Column) -> Column:
    """FL-16: whether a person has to look at a mapping: its status isn't ok, its JSON was repaired, or a value is fine-grained
    (three words, a digit, or a kind of its own)."""
    fine = lambda v: (n_words(v) >= 3) | v.rlike(r"\p{Nd}") | F.lower(v).rlike("|".join(FINE_NAMES))
    return ~status.eqNullSafe("ok") | F.coalesce(repaired, F.lit(False)) | F.coalesce(F.exists(F.map_values(mapping), fine), F.lit(False))


def same_lemma(a: Column, b: Column) -> Column:
    """FL-21: first words with one lemma of three letters or more; true if a side is empty."""
    return both_normal(a, b, normal_lemma)


def normal_lemma(x: Column, y: Column) -> Column:
    """FL-21 of terms that are normalised already."""
    head = lambda x: lemma(F.split_part(x, F.lit(" "), F.lit(1)))
    return (x == "") | (y == "") | let(head(x), lambda h: (F.length(h) >= 3) & (h == head(y)))


def passive_inverse(a: Column, b: Column) -> Column:
    """FL-22: what stands before ` by` in one (which may begin a longer word) is too close to the other, or its first word
    has the other's lemma: held by, holding."""
    return both_normal(a, b, normal_inverse)


def normal_inverse(a: Column, b: Column) -> Column:
    """FL-22 of terms that are normalised already."""

    def one(x: Column, y: Column) -> Column:
        alike = lambda head: (head != "") & (too_close(x, head) | (lemma(first_word(x)) == lemma(first_word(head))))
        return F.when(F.concat(F.lit(" "), y).contains(" by"), let(F.trim(F.split_part(y, F.lit(" by"), F.lit(1))), alike)).otherwise(False)

    return one(a, b) | one(b, a)


def mentions(relation: Column, *entities: Column) -> Column:
    """FL-23: a whole entity (normalised, without its article) within the relation."""
    padded = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    names = F.array(*[normal_relation(without_article(unquoted(e))) for e in entities])
    return let(padded(normal_relation(relation)), lambda text: F.exists(names, lambda name: (name != "") & text.contains(padded(name))))


def bad_ending(text: Column) -> Column:
    """FL-26: a sentence that ends in an auxiliary."""
    return text.rlike(r"(?i)\b(is|are|was|were)\.$")


def validity(invalid_share: Column, yes_ratio: Column) -> Column:
    """FL-29: whether a measurement can be used."""
    return cascade([("too_many_invalid", invalid_share > 0.10), ("degenerate", (yes_ratio > 0.95) | (yes_ratio < 0.05))])


def recovered_relation(relation: Column, told: Column, subject: Column, obj: Column) -> Column:
    """SF-19: the relation, unless it is empty or names an entity: then what the statement has between its entities, if
    that is more than an entity."""
    name = lambda x: normal_relation(without_article(F.coalesce(x, F.lit(""))))
    given = F.struct(name(subject).alias("s"), name(obj).alias("o"), clean_span(relation).alias("r"))

    def cut(g: Column, text: Column) -> Column:
        s, o = g["s"], g["o"]
        text = F.when((s != "") & text.startswith(F.concat(s, F.lit(" "))), F.trim(F.substring(text, F.length(s) + 1, F.length(text)))).otherwise(text)
        return let(text, lambda t: clean_span(F.when((o != "") & t.endswith(F.concat(F.lit(" "), o)), F.trim(F.left(t, F.length(t) - F.length(o)))).otherwise(t)))

    def chosen(g: Column) -> Column:
        entity = lambda x: let(normal_relation(x), lambda n: (n != "") & n.isin(g["s"], g["o"]))
        fine = (g["r"] != "") & ~entity(g["r"]) & ~mentions(g["r"], subject, obj)
        between = let(normal_relation(clean_span(told)), lambda text: cut(g, text))  # only where it is needed
        return F.when(fine, g["r"]).otherwise(let(between, lambda text: F.when((text != "") & ~entity(text), text).otherwise(g["r"])))

    return let(given, chosen)


def chosen_candidates(df: DataFrame, key: str, tries: int = 3) -> DataFrame:
    """UD-02, the part by rules: of each key's candidates the one that is taken. df: key, gold, subject, object, relation,
    rank, linguistically_plausible, visually_supported, confidence, and what two verifiers said: verified_a, verified_b.
    Candidates with an equal relation count once (the least rank); those that the rules and flags let through are tried
    with high confidence first, then by rank, `tries` of them at most, and the first that both verifiers accept wins."""
    once = df.groupBy(key, normal_relation(F.col("relation")).alias("_norm")).agg(F.min_by(F.struct(*[c for c in df.columns if c != key]), "rank").alias("c")).select(key, "c.*")
    status = F.coalesce(
        rejection(F.col("gold"), F.col("relation"), F.col("subject"), F.col("object")),
        teacher_gate(F.col("linguistically_plausible"), F.col("visually_supported"), F.col("confidence")),
    )
    order = F.struct((F.col("confidence") != "high").alias("second"), F.col("rank").alias("rank"), "relation", (F.col("verified_a") & F.col("verified_b")).alias("fine"))
    tried = once.where(status.isNull()).groupBy(key).agg(F.slice(F.sort_array(F.collect_list(order)), 1, tries).alias("t"))
    won = F.get(F.filter("t", lambda x: x.fine), F.lit(0))
    return tried.select(key, F.size("t").alias("n_tried"), won.relation.alias("relation"), won["rank"].alias("rank"))
