"""Text, key and array functions: columns in, columns out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from relcheck.functions import vocabulary as V


#: What \s is with (?U): the characters that Unicode calls white space.
WHITE = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def stripped(x: Column) -> Column:
    """Without white space (of Unicode) on both sides."""
    return F.trim(x, F.lit(WHITE))


def spaced(x: Column) -> Column:
    """White space collapsed to single spaces, none on the sides."""
    return stripped(F.regexp_replace(x, r"(?U) \s+|[\s&&[^ ]]\s*", " "))  # single spaces stay as they are


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), where x is made once a row however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def canonical_id(qid: Column) -> Column:
    """JN-03: one spelling for 7, '7' and '007'."""
    return F.regexp_replace(F.trim(qid.cast("string")), "^0+(?=[0-9]+$)", "")


def draw(seed: int | str, *ids: Column) -> Column:
    """A deterministic order that depends on the seed: sorting by it shuffles (SA-04, SA-14)."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[i.cast("string") for i in ids]))


def normal_relation(x: Column) -> Column:
    """SF-01: lower case, single spaces, no quotes or punctuation on the sides; null is ''."""

    def whole(x: Column) -> Column:
        bare = F.regexp_replace(stripped(x), "^[\"']+|[\"']+$", "")
        return F.regexp_replace(F.regexp_replace(F.lower(bare), r"(?U)\s+", " "), "^[ .,;:!?]+|[ .,;:!?]+$", "")

    # Plain words have nothing to remove; the number of words is bounded, since the pattern recurs.
    return let(F.coalesce(x, F.lit("")), lambda v: F.when(v.rlike(r"^[A-Za-z]++(?: [A-Za-z]++){0,7}+\z"), F.lower(v)).otherwise(whole(v)))


def unquoted(x: Column, pairs_only: bool = False) -> Column:
    """SF-02: without quotes on the sides; with pairs_only just one pair of equal ones that wraps the text."""
    bare = stripped(F.coalesce(x, F.lit("")))
    if pairs_only:
        return F.regexp_replace(bare, r"""(?s)^(["'])(.*)\1$""", "$2")
    return stripped(F.regexp_replace(bare, "^[\"']+|[\"']+$", ""))


def clean_span(x: Column) -> Column:
    """SF-03: underscores as spaces, single spaces, no punctuation on the sides."""
    return F.regexp_replace(spaced(F.translate(F.coalesce(x, F.lit("")), "_", " ")), "^[ .,;:!?\"'`]+|[ .,;:!?\"'`]+$", "")


def without_article(x: Column) -> Column:
    """SF-04: without a leading a, an or the."""
    return F.regexp_replace(x, r"(?i)^(a|an|the)\s+", "")


def article(noun: Column) -> Column:
    """SF-04: an before a vowel letter, else a (also for an empty noun)."""
    return F.when(F.lower(F.left(noun, F.lit(1))).isin("a", "e", "i", "o", "u"), "an").otherwise("a")


# Small letters whose upper case is spelt with several, and the capitals of one letter that they have.
_SMALL = "ß" + "".join(c for c in map(chr, range(0x1F80, 0x1FFD)) if len(c.upper()) > 1 and len(c.title()) == 1)
_CAPITAL = "ẞ" + "".join(c.title() for c in _SMALL[1:])


def capitalised(x: Column) -> Column:
    """The first letter in upper case, the others as they are. It stays one letter: ß becomes ẞ, and a letter that has no
    capital of one letter stays as it is."""
    first = F.substring(x, 1, 1)
    upper = F.when(F.length(F.upper(first)) > 1, F.translate(first, _SMALL, _CAPITAL)).otherwise(F.upper(first))
    return F.concat(upper, F.substring(x, F.lit(2), F.length(x)))


def statement(subject: Column, relation: Column, obj: Column) -> Column:
    """SF-05: `A subject is relation an object.`; quotes and the entities' own articles go before. Null is ''."""
    noun = lambda x: stripped(without_article(unquoted(x)))
    s, o = noun(subject), noun(obj)
    return F.concat(capitalised(article(s)), F.lit(" "), s, F.lit(" is "), unquoted(relation), F.lit(" "), article(o), F.lit(" "), o, F.lit("."))


def question(told: Column) -> Column:
    """SF-23: `A cat is on a mat.` as `Is a cat on a mat?`; null for another form."""
    part = lambda k: F.regexp_extract(told, r"(?i)^(An?)\s+(.+?)\s+is\s+(.+?)\.?\s*$", k)
    return F.when(part(1) != "", F.concat(F.lit("Is "), F.lower(part(1)), F.lit(" "), part(2), F.lit(" "), part(3), F.lit("?")))


def replaced_once(text: Column, old: Column, new: Column) -> Column:
    """SF-06: old replaced by new, any case, if it stands exactly once (overlaps count) and differs from new; else null."""
    low, key = F.lower(text), F.lower(old)
    at = F.position(key, low)
    again = F.position(key, F.substring(low, at + 1, F.length(low)))
    made = F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.length(old), F.length(text)))
    return F.when((at > 0) & (again == 0) & (normal_relation(old) != normal_relation(new)), made)


# The endings, in this order, that take es.
SIBILANTS = ("s", "sh", "ch", "x", "z", "o")


def looked_up(x: Column, table: dict[str, str], otherwise: Column) -> Column:
    """The table's value for x, else `otherwise`."""
    pairs = F.str_to_map(F.lit("|".join(f"{k}={v}" for k, v in table.items())), F.lit("[|]"), F.lit("="))  # one literal
    # A map is searched key by key, a list of literals by hash.
    return F.coalesce(let(x, lambda k: F.when(k.isin(*table), F.try_element_at(pairs, k))), otherwise)


def third_person(verb: Column) -> Column:
    """SF-07: goes, carries, watches, holds, in lower case but for a capital at the beginning."""
    low = F.lower(verb)
    regular = (
        F.when(low.rlike("[^aeiou]y$"), F.regexp_replace(low, "y$", "ies"))
        .when(low.rlike(f"({'|'.join(SIBILANTS)})$"), F.concat(low, F.lit("es")))
        .otherwise(F.concat(low, F.lit("s")))
    )
    out, first = looked_up(low, V.THIRD_PERSONS, regular), F.substring(verb, 1, 1)
    return F.when(first != F.lower(first), capitalised(out)).otherwise(out)


def stem(word: Column) -> Column:
    """SF-08: normalised, without ing, ed, es or s (the first that fits) where more than three letters stay."""
    return let(normal_relation(word), _stem)


def _stem(word: Column) -> Column:
    out = word
    for end in ("s", "es", "ed", "ing"):
        out = F.when(word.endswith(end) & (F.length(word) > len(end) + 3), F.substring(word, F.lit(1), F.length(word) - len(end))).otherwise(out)
    return out


def lemma(word: Column) -> Column:
    """SF-08: from the table of irregular forms, else the stem."""
    return let(normal_relation(word), lambda n: looked_up(n, V.LEMMAS, _stem(n)))


def exact_key(x: Column) -> Column:
    """JN-10: normalised, without quotes and a leading article; null is ''."""
    return normal_relation(without_article(unquoted(x)))


def phrase_lemma(x: Column) -> Column:
    """SF-08: the lemmas of the words of an exact key; '' for an empty one."""
    return let(exact_key(x), lambda key: F.when(key == "", "").otherwise(F.array_join(F.transform(F.split(key, " "), lemma), " ")))


def first_word(x: Column) -> Column:
    return F.split_part(normal_relation(x), F.lit(" "), F.lit(1))


def tokens(x: Column) -> Column:
    return _tokens(normal_relation(x))


def _tokens(x: Column) -> Column:
    return F.array_distinct(F.filter(F.split(x, " "), lambda w: w != ""))


def token_jaccard(a: Column, b: Column) -> Column:
    """SF-09: 0.0 if a side has no tokens."""
    return both_normal(a, b, normal_jaccard)


def normal_jaccard(x: Column, y: Column) -> Column:
    """SF-09 of terms that are normalised already."""
    share = lambda t: F.when((F.size(t["x"]) == 0) | (F.size(t["y"]) == 0), 0.0).otherwise(F.size(F.array_intersect(t["x"], t["y"])) / F.size(F.array_union(t["x"], t["y"])))
    return let(F.struct(_tokens(x).alias("x"), _tokens(y).alias("y")), share)


def too_alike(a: Column, b: Column) -> Column:
    """FL-17: equal, one within the other, same first word, or a token Jaccard of a half; false if a side is empty."""
    return both_normal(a, b, normal_alike)


def normal_alike(x: Column, y: Column) -> Column:
    """FL-17 of terms that are normalised already."""
    same = (x == y) | x.contains(y) | y.contains(x) | (F.split_part(x, F.lit(" "), F.lit(1)) == F.split_part(y, F.lit(" "), F.lit(1)))
    return (x != "") & (y != "") & (same | (normal_jaccard(x, y) >= 0.5))


def both_normal(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f of both terms, normalised once a row."""
    return let(F.struct(normal_relation(a).alias("x"), normal_relation(b).alias("y")), lambda n: f(n["x"], n["y"]))


def share_group(x: Column, y: Column, groups: list[list[str]]) -> Column:
    """Whether a group has both terms, which are normalised already."""
    places: dict[str, list[str]] = {}
    for i, g in enumerate(groups):
        for term in dict.fromkeys(g):
            places.setdefault(term, []).append(str(i))
    table = F.str_to_map(F.lit("|".join(f"{t}={' '.join(ids)}" for t, ids in places.items())), F.lit("[|]"), F.lit("="))
    ids = lambda z: F.split(F.try_element_at(table, z), " ")
    both = x.isin(*places) & y.isin(*places)  # by hash: few terms have to be searched for in the table
    return F.when(both, F.arrays_overlap(ids(x), ids(y))).otherwise(False)


def in_one_group(a: Column, b: Column, groups: list[list[str]]) -> Column:
    """Whether a group has both terms, normalised."""
    return both_normal(a, b, lambda x, y: share_group(x, y, groups))


def synonyms(a: Column, b: Column) -> Column:
    """FL-19: equal, or in one group of synonyms; false if a side is empty."""
    return both_normal(a, b, normal_synonyms)


def normal_synonyms(x: Column, y: Column) -> Column:
    """FL-19 of terms that are normalised already."""
    return (x != "") & (y != "") & ((x == y) | share_group(x, y, V.SYNONYMS))


def too_close(a: Column, b: Column) -> Column:
    """FL-20: empty, equal, synonyms, one within the other, or first words with one stem of four letters or more."""
    return both_normal(a, b, normal_close)


def normal_close(x: Column, y: Column) -> Column:
    """FL-20 of terms that are normalised already."""
    head = lambda x: stem(F.split_part(x, F.lit(" "), F.lit(1)))
    stems = let(head(x), lambda h: (F.length(h) >= 4) & (h == head(y)))
    return (x == "") | (y == "") | (x == y) | share_group(x, y, V.SYNONYMS) | x.contains(y) | y.contains(x) | stems


def relation_family(relation: Column) -> Column:
    """SF-11: spatial, contact (also by the first word) or other."""
    return let(normal_relation(relation), normal_family)


def normal_family(x: Column) -> Column:
    """SF-11 of a term that is normalised already."""
    return F.when(x.isin(*V.SPATIAL), "spatial").when(x.isin(*V.CONTACT) | F.split_part(x, F.lit(" "), F.lit(1)).isin(*V.CONTACT), "contact").otherwise("other")


def qc_family(relation: Column) -> Column:
    """SF-11 for quality checks: the family, and of the others spatial if a word of place is in it, contact if its first
    word ends in ing or ed."""
    x, family = normal_relation(relation), relation_family(relation)
    spatial = F.arrays_overlap(F.split(x, " "), F.array(*[F.lit(w) for w in V.PLACE_WORDS])) | x.rlike("front of|top of|next to")
    return F.when(family != "other", family).when(spatial, "spatial").when(first_word(relation).rlike("(ing|ed)$"), "contact").otherwise("other")


def meta_relation(relation: Column) -> Column:
    """FL-24: the first word speaks of the picture; false for an empty relation."""
    return F.coalesce(first_word(relation).isin(*V.META_HEADS), F.lit(False))


def hard_score(gold: Column, other: Column) -> Column:
    """SF-10: how hard a wrong relation is to tell from the right one; -1 if they are too close or it is a meta relation.
    Lengths and the list of visible relations are those of the texts as they are."""
    word = lambda x: F.split_part(x, F.lit(" "), F.lit(1))

    def scored(n: Column) -> Column:
        x, y = n["x"], n["y"]
        points = [
            (4.0, other.isin(*V.VISUAL)),
            (5.0, word(x) == word(y)),
            (3.0, let(normal_family(x), lambda kind: (kind != "other") & (kind == normal_family(y)))),
            (1.0, let(normal_jaccard(x, y), lambda alike: alike.between(0.15, 0.6))),
            (0.5, F.abs(F.length(gold) - F.length(other)) <= 8),
        ]
        score = F.lit(0.0)
        for many, holds in points:
            score = score + F.when(holds, many).otherwise(0.0)
        return F.when(normal_close(x, y) | word(y).isin(*V.META_HEADS), -1.0).otherwise(score)

    return let(F.struct(normal_relation(gold).alias("x"), normal_relation(other).alias("y")), scored)


def placeholders(caption: Column) -> Column:
    """SF-13: the different {names} of a caption, in order."""
    return F.array_distinct(F.regexp_extract_all(caption, F.lit(r"(\{[^{}]+\})"), F.lit(1)))


def substituted(caption: Column, mapping: Column) -> Column:
    """SF-13: the caption with the map's keys replaced by its values, longest keys first."""
    longest = F.reverse(F.sort_array(F.transform(F.map_entries(mapping), lambda e: F.struct(F.length(e.key).alias("n"), e.key.alias("k"), e.value.alias("v")))))
    return F.aggregate(longest, caption, lambda t, e: F.replace(t, e.k, e.v))


def positions(text: Column, part: Column) -> Column:
    """SF-14: all (overlapping) places of part in text, from 0, in any case."""
    low, key = F.lower(text), F.lower(part)
    every = F.sequence(F.lit(0), F.greatest(F.length(low) - F.length(key), F.lit(0)))
    return F.filter(every, lambda i: F.substring(low, i + 1, F.length(key)) == key)


def subarray_at(hay: Column, needle: Column) -> Column:
    """SF-15: where needle first stands in hay, from 0; null if it doesn't or is empty."""
    last = F.size(hay) - F.size(needle)
    found = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.slice(hay, i + 1, F.size(needle)) == needle)
    return F.when((F.size(needle) > 0) & (last >= 0), F.get(found, F.lit(0)))


def overlapping(offsets: Column, start: Column, end: Column) -> Column:
    """SF-16: the non-empty spans (struct s, e) that overlap [start, end)."""
    return F.filter(offsets, lambda o: (o.e > start) & (o.s < end) & (o.e > o.s))


def json_answer(raw: Column) -> Column:
    """SF-17: struct of object (the JSON object in an answer, as text; null if there is none) and repaired. A fenced block is
    taken before the whole text; where that is no object, what stands from the first brace to the last. repaired tells that
    a fence or braces were looked for. Thoughts in <think> go before. Null is ''."""
    fence = r"(?is)```(?:json)?\s*(.*?)\s*```"
    fine = lambda x: x.startswith("{") & F.try_parse_json(x).isNotNull()

    def opened(bare: Column) -> Column:
        fenced = bare.rlike(fence)
        return F.struct(fenced.alias("fenced"), F.when(fenced, stripped(F.regexp_extract(bare, fence, 1))).otherwise(bare).alias("text"))

    def judged(o: Column) -> Column:
        outer = F.regexp_extract(o["text"], r"(?s)(\{.*\})", 1)
        return F.when(fine(o["text"]), F.struct(o["text"].alias("object"), o["fenced"].alias("repaired"))).otherwise(let(outer, lambda x: F.struct(F.when(fine(x), x).alias("object"), (o["fenced"] | (x != "")).alias("repaired"))))

    bare = stripped(F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?is)<think>.*?</think>", ""))
    return let(bare, lambda b: let(opened(b), judged))  # each step is made once a row


def json_object(raw: Column) -> Column:
    """SF-17: the object of json_answer."""
    return json_answer(raw)["object"]


def as_percent(share: Column, digits: int = 2) -> Column:
    """SF-27: null stays null."""
    return F.when(share.isNotNull(), F.format_string(f"%.{digits}f", 100 * share))


def coloured_question(question: Column, subject: Column, obj: Column, mode: Column, colours: tuple[str, str] = ("red", "green")) -> Column:
    """SF-33: the question with ` in red mask` behind each place of the subject's lower-case name, then the same in the second
    colour for the object; places within longer words count. mode is mask, or else it reads bounding box. An empty or null
    name changes nothing."""
    out, shape = question, F.when(mode == "mask", "mask").otherwise("bounding box")
    for name, colour in zip((subject, obj), colours):
        low = F.lower(F.coalesce(name, F.lit("")))
        out = F.replace(out, low, F.concat(low, F.lit(f" in {colour} "), shape))
    return out


def basename(path: Column) -> Column:
    """SF-32: what stands behind the last slash."""
    return F.element_at(F.split(path, "/"), -1)


def path_stem(path: Column) -> Column:
    """SF-32: the basename without its last extension."""
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def scaled_box(box: Column, width: Column, height: Column) -> Column:
    """SF-33: [x, y, x, y] from shares to pixels."""
    return F.transform(box, lambda v, i: v * F.when(i % 2 == 0, width).otherwise(height))


def leading_preposition(x: Column) -> Column:
    """SF-24: the compound preposition that x begins with (in any case, behind an article), or its first word if that is a
    preposition; else '' (null too). Only white space ends a compound one, any other character but a letter a single one."""
    low = without_article(F.lower(stripped(F.coalesce(x, F.lit("")))))
    single = F.regexp_extract(low, "^[A-Za-z]*", 0)
    out = F.when(single.isin(*V.LEADING_PREPOSITIONS), single).otherwise("")
    for c in reversed(V.LEADING_COMPOUNDS):
        out = F.when((low == c) | low.startswith(c + " "), c).otherwise(out)
    return out


def image_domain(path: Column) -> Column:
    """SF-24: vg, dalle or other, by the path of an image; null is other."""
    p = F.lower(F.translate(F.coalesce(path, F.lit("")), "\\", "/"))
    # What the paths of each source contain.
    return F.when(p.startswith("vg/") | p.startswith("vg_") | p.contains("/vg_"), "vg").when(p.contains("dall-e") | p.contains("dalle"), "dalle").otherwise("other")


def hex_digit_bucket(x: Column, buckets: int = 3) -> Column:
    """SA-12: md5(x) modulo 3 (5, 15: divisors of 15), by the sum of its hexadecimal digits."""
    digits = F.filter(F.split(F.md5(x.cast("string")), ""), lambda c: c != "")
    return F.aggregate(digits, F.lit(0), lambda a, c: a + F.conv(c, 16, 10).cast("int")) % buckets


def family(relation: Column, families: dict[str, list[str]], other: str = "other") -> Column:
    """SF-11: the first family whose list has the relation."""
    out = F.lit(other)
    for name, members in reversed(list(families.items())):
        out = F.when(normal_relation(relation).isin(*members), name).otherwise(out)
    return out


# The question forms, with their lazy and greedy groups, their tags and how the statement is put together.
QUESTION_FORMS = [
    (r"(?i)^Is there (an?|the) (.+?) (above|on|left|right|under|in) to (an?|the) (.+) in the image$", "mmrel_spatial_to", "{0} {1} is {2} to {3} {4}."),
    (r"(?i)^Is there (an?|the) (.+?) (in|on|above|under|left|right|at|near|over|by) (an?|the) (.+) in the image$", "mmrel_spatial_prep", "{0} {1} is {2} {3} {4}."),
    (r"(?i)^Does (an?|the) (.+) ([A-Za-z-]+) (an?|the) (.+) in the image$", "mmrel_action", "{0} {1} {verb} {3} {4}."),
]


def bare_question(question: Column) -> Column:
    """Without the request for one word and question marks at its end."""
    bare = F.regexp_replace(stripped(F.coalesce(question, F.lit(""))), r"(?i)\s*Please answer with one word\.?\s*$", "")
    return stripped(F.regexp_replace(bare, r"\?+$", ""))


def statement_of_question(question: Column) -> Column:
    """SF-20: struct of statement and tag, by the first form that fits; no form: null and mmrel_fail. Null is ''."""
    bare = bare_question(question)
    said, tag = F.lit(None).cast("string"), F.lit("mmrel_fail")
    for pattern, name, form in reversed(QUESTION_FORMS):
        part = [F.regexp_extract(bare, pattern, k) for k in range(1, 6)]
        words = [third_person(part[2]) if w == "{verb}" else part[int(w[1])] if w[0] == "{" else F.lit(w) for w in form.rstrip(".").split(" ")]
        fits = bare.rlike(pattern)
        said = F.when(fits, F.concat(capitalised(spaced(F.concat_ws(" ", *words))), F.lit("."))).otherwise(said)
        tag = F.when(fits, name).otherwise(tag)
    return F.struct(said.alias("statement"), tag.alias("tag"))


def relation_of_question(question: Column) -> Column:
    """SF-24: struct of relation (as an exact key; null if no form fits) and tag, by the forms of SF-20. Null is ''."""

    def told(bare: Column) -> Column:
        form = F.lit(None).cast("int")
        for k, (pattern, _, _) in reversed(list(enumerate(QUESTION_FORMS))):
            form = F.when(bare.rlike(pattern), k).otherwise(form)
        return let(form, lambda k: read(bare, k))

    def read(bare: Column, form: Column) -> Column:
        found, tag = F.lit(None).cast("string"), F.lit("mmrel_fail")
        for k, (pattern, name, _) in enumerate(QUESTION_FORMS):
            found, tag = F.when(form == k, F.regexp_extract(bare, pattern, 3)).otherwise(found), F.when(form == k, name).otherwise(tag)
        return F.struct(let(found, lambda x: F.when(x.isNotNull(), exact_key(x))).alias("relation"), tag.alias("tag"))

    return let(bare_question(question), told)  # the question is stripped once a row


def masked_losses(losses: Column, places: Column) -> Column:
    """SF-30: struct of n, total and mean of the losses at places (from 0; those outside are left out) and located; no
    place inside: 0, nulls and false."""

    def of(own: Column) -> Column:
        inside = F.filter(places, lambda i: (i >= 0) & (i < F.size(own)))
        n = F.size(inside)
        total = F.when(n > 0, F.aggregate(F.transform(inside, lambda i: F.get(own, i)), F.lit(0.0), lambda a, x: a + x))
        return F.struct(F.greatest(n, F.lit(0)).alias("n"), total.alias("total"), F.try_divide(total, n).alias("mean"), (n > 0).alias("located"))

    return let(losses, of)  # made once, not once a place


# Categories with names of their own.
CATEGORIES = {
    "door-stuff": "door", "floor-wood": "wooden floor", "mirror-stuff": "mirror", "tree-merged": "tree", "fence-merged": "fence",
    "ceiling-merged": "ceiling", "sky-other-merged": "sky", "cabinet-merged": "cabinet", "table-merged": "table",
    "floor-other-merged": "floor", "pavement-merged": "pavement", "mountain-merged": "mountain", "grass-merged": "grass",
    "dirt-merged": "dirt", "paper-merged": "paper", "food-other-merged": "food", "building-other-merged": "building",
    "rock-merged": "rock", "wall-other-merged": "wall", "rug-merged": "rug",
}


def category_name(name: Column) -> Column:
    """SF-25: an alias, or the name without -merged and -other and with spaces for hyphens."""
    return looked_up(name, CATEGORIES, F.replace(F.regexp_replace(F.replace(name, F.lit("-merged"), F.lit("")), "-other", ""), F.lit("-"), F.lit(" ")))


def candidate_list(parsed: Column) -> Column:
    """SF-18: the candidates in an answer's JSON (text, as json_object gives it) that have a relation: those of its array, or
    else the whole object as one. Flags that aren't there are null; other text, null included, has none."""
    from relcheck.functions.answers import loose_boolean

    def listed(value: Column) -> Column:
        return F.coalesce(F.try_variant_get(value, "$.candidates", "array<variant>"), F.when(value.isNotNull(), F.array(value)), F.array().cast("array<variant>"))

    text_of = lambda x, name: F.try_variant_get(x, f"$.{name}", "string")

    def told(x: Column) -> Column:
        return let(clean_span(text_of(x, "relation")), lambda relation: fields(x, relation))

    def fields(x: Column, relation: Column) -> Column:
        text = lambda name: text_of(x, name)
        return F.struct(
            relation.alias("relation"),
            normal_relation(relation).alias("relation_norm"),
            clean_span(text("statement")).alias("statement"),
            loose_boolean(text("linguistically_plausible")).alias("linguistically_plausible"),
            loose_boolean(text("visually_supported")).alias("visually_supported"),
            F.lower(stripped(F.coalesce(text("confidence"), F.lit("")))).alias("confidence"),
        )

    return F.filter(F.transform(let(F.try_parse_json(parsed), listed), told), lambda c: c.relation != "")
