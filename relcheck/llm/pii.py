"""PII (DataFrame functions only): patterns, and terms that tell too much about what the patterns protect.

Emails, addresses, card and phone numbers are the protected entities. A term reveals an entity as far as the corpus lets
one infer it: the pointwise mutual information of term and entity, over different texts, against the information
content of the entity. What stays hidden, IC(e) - PMI(t, e) = -log2 p(e | t), is the number of bits one would still have
to guess. In a document that holds the entity, a term that leaves at most HIDDEN_GENERALISED bits is generalised (a
number by [NUMBER], a word by [TERM]), one that leaves at most HIDDEN_REMOVED bits is removed, or generalised too if fewer
than MIN_REMOVED texts hold both, since so few say little. Entities and pairs of one text are judged like all others.

What only one text holds is judged as one entity of that text, because each term stands with all of it alike: so pairs grow
with the texts, not with their entities. Document frequencies are counted over all texts; all counts are partial
aggregates. Places of matches are sums of lengths, by a window over one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relcheck.llm.common import join_small, packed, same_row, saved, table, unpacked
from relcheck.llm.license_scan import lowered, words_of

KINDS = ["email", "ip", "card", "phone", "term"]
# Patterns of the base, written so that no text makes them slow: possessive, and begun only where a match can begin.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
MIN_TEXTS = 1
MIN_REMOVED = 3
MIN_TERM = 3
HIDDEN_GENERALISED, HIDDEN_REMOVED = 1.0, 0.15


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def weight(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    each = F.transform(F.reverse(F.filter(F.split(digits, ""), lambda c: c != "")), weight)
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: Column, value: Column) -> Column:
    n = F.length(digits_of(value))
    ip = F.forall(F.split(value, r"\."), lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False)))
    card = F.when(n.between(16, 19), luhn(digits_of(value))).otherwise(False)
    return F.when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", n.between(8, 15)).otherwise(True)


def placed(rows: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """_id, _h, kind, start, end (code points), value of all matches, leftmost and non-overlapping per kind."""
    with_matches = rows.select("_id", "_h", "_text", *[matches(F.col("_text"), k, p).alias(f"m_{k}") for k, p in patterns.items()])
    some = with_matches.where(" or ".join(f"size(m_{k}) > 0" for k in patterns))
    parts = lambda k, p: F.transform(F.split("_text", p, -1), lambda x: F.length(x))
    none = F.array().cast("array<struct<value:string,gap:int>>")
    pairs = [
        F.when(F.size(f"m_{k}") > 0, F.zip_with(f"m_{k}", F.slice(parts(k, p), 1, F.size(f"m_{k}")), lambda v, g: F.struct(v.alias("value"), g.alias("gap")))).otherwise(none)
        for k, p in patterns.items()
    ]
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), x.alias("found")) for k, x in zip(patterns, pairs, strict=True)])
    each = some.select("_id", "_h", F.explode(kinds).alias("x")).select("_id", "_h", "x.kind", F.posexplode("x.found").alias("j", "f"))
    each = each.select("_id", "_h", "kind", "j", "f.value", "f.gap").distinct()
    before = Window.partitionBy("_id", "_h", "kind").orderBy("j").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.length("value")).over(before)
    return each.withColumn("end", end).select("_id", "_h", "kind", (F.col("end") - F.length("value")).alias("start"), "end", "value")


def matches(text: Column, kind: str, pattern: str) -> Column:
    """All matches; texts without a character that each match has aren't searched."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    needs = {"email": "@", "phone": "+", "ip": "."}.get(kind)
    return F.when(text.contains(needs), found).otherwise(F.array().cast("array<string>")) if needs else found


def entity(kind: Column, value: Column) -> Column:
    return F.concat(kind, F.lit(":"), F.when(kind.isin("card", "phone"), digits_of(value)).otherwise(F.lower(value)))


def terms_of(text: Column, min_term: int) -> Column:
    return F.array_distinct(F.filter(words_of(lowered(text)), lambda w: F.length(w) >= min_term))


def judged(found: DataFrame, min_texts: int) -> DataFrame:
    """_id, _h, e: the entities of each document that stand in min_texts different texts; those of one text as one."""
    held = found.select("_id", "_h", entity(F.col("kind"), F.col("value")).alias("e"))
    texts = held.groupBy("e").agg(F.count_distinct("_h").alias("n_e")).where(F.col("n_e") >= min_texts)
    e = F.when(F.col("n_e") == 1, F.concat(F.lit("only:"), F.col("_h"))).otherwise(F.col("e"))
    return saved(held.join(texts, "e").select("_id", "_h", e.alias("e")).distinct())


def revealing(base: DataFrame, held: DataFrame, min_texts: int, min_term: int) -> DataFrame:
    """e, t, hidden, n_te: the terms that leave at most HIDDEN_GENERALISED bits of an entity hidden. Copies count once."""
    first = base.groupBy("_h").agg(F.min("_id").alias("_id2"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = saved(first.select(F.col("_h").alias("_h2"), "_id2"))
    copy = (base["_h"] == copies["_h2"]) & ~base["_id"].eqNullSafe(copies["_id2"])
    texts = join_small(base, copies, copy, "left_anti").select("_id", "_h", "_text")
    own = saved(held.groupBy(F.col("_id").alias("_id2"), F.col("_h").alias("_h2")).agg(F.collect_set("e").alias("es")))
    near = join_small(texts, own, same_row(texts, own), "inner")
    pairs = near.select(F.explode("es").alias("e"), terms_of(F.col("_text"), min_term).alias("ts")).select("e", F.explode("ts").alias("t"))
    pairs = pairs.groupBy("e", "t").agg(F.count(F.lit(1)).alias("n_te")).where(F.col("n_te") >= min_texts)
    seen = texts.select(F.explode(terms_of(F.col("_text"), min_term)).alias("t2"))
    frequency = seen.groupBy("t2").agg(F.count(F.lit(1)).alias("n_t"))
    hidden = -F.log2(F.least(F.col("n_te") / F.col("n_t"), F.lit(1.0)))
    return pairs.join(frequency, F.col("t") == F.col("t2")).select("e", "t", hidden.alias("hidden"), "n_te").where(F.col("hidden") <= HIDDEN_GENERALISED)


def term_spans(base: DataFrame, found: DataFrame, min_texts: int, min_term: int) -> DataFrame:
    """Spans of kind term: revealing terms in documents that hold the entity, outside of its own spans. `value` is the
    term's replacement."""
    held = judged(found, min_texts)
    told = saved(revealing(base, held, min_texts, min_term))
    shown = F.when(F.col("n_te") >= MIN_REMOVED, F.col("hidden")).otherwise(F.greatest("hidden", F.lit(HIDDEN_GENERALISED)))
    own = held.join(told, "e").groupBy("_id", "_h", "t").agg(F.min(shown).alias("hidden"))
    own = own.groupBy("_id", "_h").agg(F.map_from_entries(F.collect_list(F.struct("t", "hidden"))).alias("terms"))
    areas = found.groupBy(F.col("_id").alias("_id3"), F.col("_h").alias("_h3")).agg(F.collect_list(F.struct("start", "end")).alias("areas"))
    own = own.join(areas, F.col("_id").eqNullSafe(F.col("_id3")) & (F.col("_h") == F.col("_h3")))
    own = saved(own.select(F.col("_id").alias("_id2"), F.col("_h").alias("_h2"), "terms", "areas"))
    near = join_small(base, own, same_row(base, own), "inner")
    words = placed(near.select("_id", "_h", "_text"), {"term": TERM}).withColumn("t", lowered(F.col("value")))
    met = words.join(own, same_row(words, own)).withColumn("hidden", F.try_element_at("terms", F.col("t")))
    apart = ~F.exists("areas", lambda a: (a.start < F.col("end")) & (F.col("start") < a.end))
    shown = F.when(F.col("hidden") <= HIDDEN_REMOVED, "").when(F.col("value").rlike("^[0-9]+$"), "[NUMBER]").otherwise("[TERM]")
    return met.where(F.col("hidden").isNotNull() & apart).select("_id", "_h", "kind", "start", "end", shown.alias("value"))


def pii_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_texts: int = MIN_TEXTS, min_term: int = MIN_TERM) -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone (bigint), base_spans, spans (kind:start:end in code points, comma-joined,
    by kind, then start) and sanitised_text (entities as [EMAIL] and so on, terms generalised or removed).

    min_texts: different texts that an entity, and a pair of term and entity, must stand in to be judged; with 1, as given,
    all are, and a word that stands in no more than two texts is a term wherever one of them holds an entity that no other
    text has. min_term: letters of a term, at least.
    Null text: counts of 0, empty spans, sanitised_text ''. Null ids are ordinary ids. Repeated rows are one document and
    get equal results. Overlapping spans are replaced once, by the first's replacement. Empty tables give empty results.
    """
    base = packed(docs, id_col, text_col)
    found = placed(base, PATTERNS).where(valid(F.col("kind"), F.col("value")))
    found = saved(found)
    terms = term_spans(base.select("_id", "_h", "_text"), found, min_texts, min_term)
    every = found.withColumn("value", F.concat(F.lit("["), F.upper("kind"), F.lit("]"))).unionByName(terms)
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    reach = F.max("end").over(Window.partitionBy("_id", "_h").orderBy("start", order, "end").rowsBetween(Window.unboundedPreceding, -1))
    every = every.select("_id", "_h", "kind", "start", "end", "value", order.alias("k"), F.coalesce(reach, F.lit(0)).alias("reach"))
    span = F.struct("k", "start", "end", F.concat_ws(":", "kind", "start", "end").alias("s"))
    cut = F.struct(F.greatest("start", "reach").alias("start"), "end", "value")
    count = lambda k: F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}")
    per_doc = every.groupBy(F.col("_id").alias("_id2"), F.col("_h").alias("_h2")).agg(
        *[count(k) for k in KINDS[:4]],
        F.sort_array(F.collect_list(span)).alias("spans"),
        F.sort_array(F.collect_list(F.when(F.col("end") > F.col("reach"), cut))).alias("cuts"),
    )
    per_doc = saved(per_doc)
    met = join_small(base, per_doc, same_row(base, per_doc), "left")
    joined = lambda x: F.coalesce(F.array_join(F.transform(x, lambda s: s.s), ","), F.lit(""))
    text, cuts = F.col("_text"), F.col("cuts")
    gap = lambda s, i: F.substring(text, F.coalesce(F.get(cuts, i - 1).end, F.lit(0)) + 1, s.start - F.coalesce(F.get(cuts, i - 1).end, F.lit(0)))
    clean = F.concat(F.array_join(F.transform(cuts, lambda s, i: F.concat(gap(s, i), s.value)), ""), F.substring(text, F.get(cuts, F.size(cuts) - 1).end + 1, F.length(text)))
    return unpacked(
        met,
        {f"n_{k}": F.coalesce(F.col(f"n_{k}"), F.lit(0)).cast("bigint") for k in KINDS[:4]}
        | {
            "base_spans": joined(F.filter("spans", lambda s: s.k < 5)),
            "spans": joined(F.col("spans")),
            "sanitised_text": F.when(F.size(cuts) > 0, clean).otherwise(text),
        },
    )


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")
