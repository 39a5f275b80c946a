"""Queries of caption mappings, word forms, questions, candidates and gates on the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relcheck.functions import text as T
from relcheck.functions import vocabulary as V
from relcheck.operators import decisions as D
from relcheck.operators import joins as J
from relcheck.operators import rules as R
from relcheck.operators import shapes as P
from relcheck.plans.registry import query, read
from relcheck.plans.relations import bucket, bucket_sql, pick, pick_sql, triples
from relcheck.plans.texts import any_of, words
from relcheck.tables import spread

_LINES = r"""with l as (
  select doc_id, unnest(string_split(text, chr(10))) as said, unnest(range(len(string_split(text, chr(10)))))::int as line from documents
), w as (
  select *, list_filter(regexp_extract_all(said, '[A-Za-z]+'), lambda x: x <> '') as w, length(said) as n from l
)"""


def lines(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, line, said, w (its words of letters) and n (its length)."""
    each = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "said"))
    return each.select("doc_id", "line", "said", F.regexp_extract_all("said", F.lit("([A-Za-z]+)"), 1).alias("w"), F.length("said").alias("n"))


@query(rf"""{_LINES}, m as (
  select *, case n % 8 when 0 then '{{x}}' when 1 then ' ' when 2 then 'uncertain' when 3 then w[1] || ' ' || w[2] || ' ' || w[3] else coalesce(w[1], '') end as a, case when n % 5 = 0 then null else coalesce(w[2], '') end as b from w
), s as (
  select *, trim(a) as va, trim(b) as vb, trim(a) = '' or trim(a) is null or (trim(a)[:1] = '{{' and trim(a)[-1:] = '}}') as bad_a from m
), t as (
  select *, case when bad_a then 'invalid_mapping' when n % 5 = 0 then 'missing_placeholder' when vb = '' then 'invalid_mapping' when lower(va) = 'uncertain' or lower(vb) = 'uncertain' or n % 7 = 0 then 'uncertain' else 'ok' end as status from s
)
select doc_id, line, status, coalesce('The ' || replace(case when n % 3 = 0 then '{{a}}' else va end, '{{b}}', coalesce(vb, '{{b}}')) || ' on ' || coalesce(vb, '{{b}}') = 'The ' || replace(va, '{{b}}', coalesce(vb, '{{b}}')) || ' on ' || coalesce(vb, '{{b}}'), false) and vb is not null
  and not (n % 3 = 0 or coalesce(contains(va, '{{a}}'), false)) as fine,
  status <> 'ok' or n % 11 = 0 or len(list_filter(string_split(va, ' '), lambda x: x <> '')) >= 3 or regexp_matches(lower(va) || '|' || coalesce(lower(vb), ''), '{"|".join(R.FINE_NAMES)}') as review from t""")
def caption_mappings(spark: SparkSession, d: str) -> DataFrame:
    """FL-16: the first words of each line as what two placeholders stand for, some of them blank, unsure or left out."""
    x, n = lines(spark, d), F.col("n") % 8
    word = lambda k: F.coalesce(F.get("w", F.lit(k)), F.lit(""))
    three = F.when(F.size("w") >= 3, F.array_join(F.slice("w", 1, 3), " "))
    a = F.when(n == 0, "{x}").when(n == 1, " ").when(n == 2, "uncertain").when(n == 3, three).otherwise(word(0))
    both = F.map_from_arrays(F.array(F.lit("{a}"), F.lit("{b}")), F.array(a, word(1)))
    given = F.when(F.col("n") % 5 == 0, F.map_filter(both, lambda k, v: k == "{a}")).otherwise(both)
    needed, caption = F.array(F.lit("{a}"), F.lit("{b}")), F.lit("The {a} on {b}")
    x = x.select("doc_id", "line", "n", R.validated_mapping(needed, given, F.when(F.col("n") % 7 == 0, "uncertain")).alias("v"), given.alias("given"))
    clean = F.map_filter(F.transform_values("given", lambda k, v: T.stripped(v)), lambda k, v: v.isNotNull())
    explicit = T.substituted(F.when(F.col("n") % 3 == 0, F.lit("The {a}{a} on {b}")).otherwise(caption), clean)
    explicit = F.when(F.col("n") % 3 == 0, F.replace(explicit, F.lit("The "), F.lit("The {a}"))).otherwise(explicit)
    fine = R.explicit_quality(caption, explicit, needed, clean)
    return x.select("doc_id", "line", "v.status", fine.alias("fine"), R.needs_review(F.col("v.status"), clean, F.col("n") % 11 == 0).alias("review"))


@query(rf"""{_LINES} select doc_id, line, case when n % 3 <> 0 then 'teacher_not_plausible' when n % 4 not in (0, 1) then 'teacher_not_visually_false' when n % 5 not in (0, 1) then 'teacher_not_high' end as teacher,
  regexp_matches(regexp_replace(said, '[^\x00-\x7F]', '_', 'g'), '(?i)\b(is|are|was|were)\.$') as bad_end from w""")
def teacher_gates(spark: SparkSession, d: str) -> DataFrame:
    """FL-15, FL-26: flags by the length of a line, null among them."""
    n = F.col("n")
    plausible = F.when(n % 3 == 0, True).when(n % 3 == 1, False)
    supported = F.when(n % 4 < 2, False).when(n % 4 == 2, True)
    sure = F.when(n % 5 == 0, "high").when(n % 5 == 1, "medium").when(n % 5 == 2, "low")
    return lines(spark, d).select("doc_id", "line", R.teacher_gate(plausible, supported, sure).alias("teacher"), R.bad_ending(F.col("said")).alias("bad_end"))


_STEM = "case when w.suffix('ing') and length(w) > 6 then w[:-4] when w.suffix('ed') and length(w) > 5 then w[:-3] when w.suffix('es') and length(w) > 5 then w[:-3] when w.suffix('s') and length(w) > 4 then w[:-2] else w end"


@query(rf"""with d as (select distinct unnest(regexp_extract_all(text, '[A-Za-z]+')) as word from documents), q as (select word, lower(word) as w from d),
lem(f, l) as (values {", ".join(f"('{a}', '{b}')" for a, b in V.LEMMAS.items())}), third(f, l) as (values {", ".join(f"('{a}', '{b}')" for a, b in V.THIRD_PERSONS.items())}),
r as (select word, w, {_STEM} as stem, coalesce(lem.l, {_STEM}) as lemma, coalesce(third.l, case when regexp_matches(w, '[^aeiou]y$') then w[:-2] || 'ies' when regexp_matches(w, '(s|sh|ch|x|z|o)$') then w || 'es' else w || 's' end) as v
  from q left join lem on lem.f = w left join third on third.f = w)
select word, stem, lemma, case when word[1] <> lower(word[1]) then upper(v[1]) || v[2:] else v end as third from r""")
def word_forms(spark: SparkSession, d: str) -> DataFrame:
    """SF-07, SF-08."""
    w = F.col("word")
    return words(read(spark, d, "documents")).select("word", T.stem(w).alias("stem"), T.lemma(w).alias("lemma"), T.third_person(w).alias("third"))


_LEAD = rf"case when regexp_matches(low, '^({'|'.join(V.LEADING_COMPOUNDS)})( |$)') then regexp_extract(low, '^({'|'.join(V.LEADING_COMPOUNDS)})( |$)', 1) when regexp_matches(low, '^({any_of(V.LEADING_PREPOSITIONS)})([^a-z]|$)') then regexp_extract(low, '^({any_of(V.LEADING_PREPOSITIONS)})([^a-z]|$)', 1) else '' end"


@query(rf"""{_LINES}, p as (
  select doc_id, line, n, said, case when n % 2 = 0 then {pick_sql(V.LEADING_COMPOUNDS, "said")} || case when n % 3 = 0 then ' ' else '' end || said else said end as x from w
), q as (
  select *, regexp_replace(lower(trim(x, ' ' || chr(9) || chr(13))), '^(a|an|the)\s+', '') as low from p
)
select doc_id, line, {_LEAD} as preposition, case when n % 5 = 0 then 'vg' when n % 5 = 1 then 'dalle' when n % 5 = 2 then 'vg' else 'other' end as domain from q""")
def leading_prepositions(spark: SparkSession, d: str) -> DataFrame:
    """SF-24 on lines, half of them behind a compound preposition, and on paths of four kinds."""
    n, said = F.col("n"), F.col("said")
    x = F.when(n % 2 == 0, F.concat(pick(V.LEADING_COMPOUNDS, said), F.when(n % 3 == 0, " ").otherwise(""), said)).otherwise(said)
    number = F.col("doc_id").cast("string")
    path = F.when(n % 5 == 0, F.concat(F.lit("VG\\"), number)).when(n % 5 == 1, F.concat(F.lit("x/DALL-E/"), number)).when(n % 5 == 2, F.concat(F.lit("data\\vg_"), number)).when(n % 5 == 3, F.concat(F.lit("data/vg/"), number))
    return lines(spark, d).select("doc_id", "line", T.leading_preposition(x).alias("preposition"), T.image_domain(path).alias("domain"))


#: Verbs and prepositions of the questions made of words.
_PLACES = ["above", "on", "left", "right", "under", "in", "at", "near", "over", "by", "to"]


@query(rf"""with w as (select regexp_extract_all(text, '[A-Za-z]+') as w from documents), x as (
  select distinct w[i] as a, w[i + 1] as b, w[i + 2] as c from w, unnest(range(1, len(w) - 1, 3)) as r(i)
), y as (select *, {pick_sql(_PLACES, "b")} as place, {bucket_sql("a || b", 4)} as form from x),
z as (select *, lower(a) in ('in', 'on', 'above', 'under', 'left', 'right', 'at', 'near', 'over', 'by', 'a', 'an', 'the') or lower(c) in ('in', 'on', 'a', 'an', 'the') as odd from y)
select a, b, c, case when form = 0 and place in ('above', 'on', 'left', 'right', 'under', 'in') then place when form = 1 and place <> 'to' then place when form = 2 then lower(b) end as relation,
  case when form = 0 and place in ('above', 'on', 'left', 'right', 'under', 'in') then 'mmrel_spatial_to' when form = 1 and place <> 'to' then 'mmrel_spatial_prep' when form = 2 then 'mmrel_action' else 'mmrel_fail' end as tag
from z where not odd""")
def question_relations(spark: SparkSession, d: str) -> DataFrame:
    """SF-20, SF-24: questions of three forms, and of none, made of three words in a row; triples with prepositions or articles
    as entities are left to the tests of the forms."""
    each = spread(triples(spark, d), "a", "b", "c").distinct()
    each = each.where(~(F.lower("a").isin(*_PLACES[:-1], "a", "an", "the") | F.lower("c").isin("in", "on", "a", "an", "the")))
    a, b, c, place, form = F.col("a"), F.col("b"), F.col("c"), pick(_PLACES, F.col("b")), bucket(F.concat("a", "b"), 4)
    asked = [F.concat(F.lit("Is there a "), a, F.lit(" "), place, F.lit(" to the "), c), F.concat(F.lit("Is there the "), a, F.lit(" "), place, F.lit(" a "), c), F.concat(F.lit("Does the "), a, F.lit(" "), b, F.lit(" a "), c), F.concat(F.lit("Where is a "), c)]
    q = F.concat(F.get(F.array(*asked), form), F.lit(" in the image? Please answer with one word."))
    return each.select("a", "b", "c", T.relation_of_question(q).alias("r")).select("a", "b", "c", "r.*")


@query(rf"""{_LINES} select doc_id, line, replace(replace(said, lower(w[1]), lower(w[1]) || ' in red ' || shape), lower(w[2]), lower(w[2]) || ' in green ' || shape) as asked
from (select *, case when n % 2 = 0 then 'mask' else 'bounding box' end as shape from w) where len(w) >= 2""")
def coloured_questions(spark: SparkSession, d: str) -> DataFrame:
    """SF-33."""
    mode = F.when(F.col("n") % 2 == 0, "mask").otherwise("box")
    return lines(spark, d).where(F.size("w") >= 2).select("doc_id", "line", T.coloured_question(F.col("said"), F.get("w", F.lit(0)), F.get("w", F.lit(1)), mode).alias("asked"))


@query("""select case page_id % 4 when 0 then page_id::varchar when 1 then null when 2 then (page_id + 1)::varchar else page_id::varchar end as question_id, url as image,
  rtrim(case when page_id % 2 = 0 then html else url end, ' ' || chr(10)) || ' Yes or no?' as text, case when page_id % 3 = 0 then 'yes' end as label from pages""")
def canonical_pages(spark: SparkSession, d: str) -> DataFrame:
    """PR-01 on records as JSON text whose keys differ; a question_id of null stays null although there is an id."""
    k, n = F.col("page_id") % 4, F.col("page_id")
    nulls = F.concat(F.lit('{"question_id": null, "id": '), n, F.lit(", "))
    head = F.when(k == 0, F.concat(F.lit('{"question_id": '), n, F.lit(', "id": 5, '))).when(k == 1, nulls).when(k == 2, F.concat(F.lit('{"id": "'), n + 1, F.lit('", '))).otherwise("{")
    rest = F.when(n % 2 == 0, F.to_json(F.struct(F.col("html").alias("question"), F.col("url").alias("image_path")))).otherwise(F.to_json(F.struct(F.col("url").alias("text"), F.lit("not this").alias("question"), F.col("url").alias("image"))))
    label = F.when(n % 3 == 0, ', "label": "yes"}').otherwise("}")
    raw = F.concat(head, F.substring(rest, F.lit(2), F.length(rest) - 2), label)
    return P.canonical_records(read(spark, d, "pages").select("page_id", raw.alias("raw")), "raw", F.col("page_id"), " Yes or no?")


@query(r"""with p as (select page_id, case when page_id % 10 = 7 then null else html end as html, regexp_extract(url, '[^/]*$') as base from pages), q as (select page_id, html, lower(base) as base, lower(regexp_replace(base, '\.[^.]*$', '')) as stem from p),
b as (select * from q where page_id % 3 = 0), names as (select base as x from b union select stem from b)
select page_id from q where page_id % 3 <> 0 and html is not null and html not in (select html from b where html is not null) and base not in (select x from names) and stem not in (select x from names)""")
def pages_unlike_benchmark(spark: SparkSession, d: str) -> DataFrame:
    """JN-12: pages that share neither content nor a name nor a stem with every third page; unreadable ones go."""
    pages = read(spark, d, "pages").select("page_id", "url", F.when(F.col("page_id") % 10 != 7, F.col("html")).alias("html"))
    return J.content_safe(pages.where("page_id % 3 <> 0"), pages.where("page_id % 3 = 0"), "html", "url").select("page_id")


@query("""select lang, count(quality) as n, avg(quality) as positive_rate, abs(avg(quality) - 0.5) * 100 as points_off, coalesce(abs(avg(quality) - 0.5) * 100 > 3, true) as in_strata
from documents left join labels using (doc_id) group by lang""")
def strata_needed(spark: SparkSession, d: str) -> DataFrame:
    """FL-29."""
    x = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left")
    return D.needs_strata(x, F.col("quality") == 1, "lang")


_GAINS = "avg(g) as mean, avg(g) - 2 * stddev_samp(g) / sqrt(count(*)) as low, avg(g) + 2 * stddev_samp(g) / sqrt(count(*)) as high"
_JUDGED = "*, coalesce(low > 0.03 and mean > 0.05, false) as clear, mean is null or coalesce(high < 0.05 and mean < 0.05, false) as none, coalesce(low <= 0 and high >= 0, true) as zero"


@query(f"""with d as (select lang, source, (n_chars % 11)::double / 10 - 0.45 as g from documents),
x as (select {_JUDGED} from (select lang, source, {_GAINS} from d group by all)), y as (select {_JUDGED} from (select lang, {_GAINS} from d group by all))
select x.lang, x.source, x.zero as zero, abs(y.mean - 0.05) + 1e-12 < abs(x.mean - 0.05) as closer,
  case when x.clear and y.none or y.clear and x.none then 'D' when x.clear or y.clear then 'B' else 'A' end as tokens,
  case when (x.clear or y.clear) and x.none and y.none then 'D' when x.clear or y.clear then 'C' else 'A' end as training
from x join y on x.lang is not distinct from y.lang""")
def gain_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """FL-29, AG-24: a source and its language as the gains of two trainings."""
    docs = read(spark, d, "documents").select("lang", "source", ((F.col("n_chars") % 11).cast("double") / 10 - 0.45).alias("g"))
    spread = 2 * F.stddev_samp("g") / F.sqrt(F.count(F.lit(1)))
    gain = F.struct(F.avg("g").alias("mean"), (F.avg("g") - spread).alias("low"), (F.avg("g") + spread).alias("high"))
    own, whole = docs.groupBy("lang", "source").agg(gain.alias("x")), docs.groupBy(F.col("lang").alias("l")).agg(gain.alias("y"))
    x, y = F.col("x"), F.col("y")
    g, both = (x, y), own.join(whole, F.col("lang").eqNullSafe(F.col("l")))
    told = {"zero": D.contains_zero(x["low"], x["high"]), "closer": D.closer_to_gold(x["mean"], y["mean"], F.lit(0.05)), "tokens": D.token_verdict(g, g), "training": D.training_verdict(g, g, g)}
    return both.select("lang", "source", *[v.alias(k) for k, v in told.items()])


@query(rf"""{_LINES}, c as (select *, list_transform(range(1, least(len(w), 3)), lambda i: w[i] || ' ' || w[i + 1]) as cs from w)
select doc_id, line, i::int as rank, cs[i + 1] as relation, lower(cs[i + 1]) as relation_norm, case when (n + i) % 3 = 0 then true when (n + i) % 3 = 1 then false end as plausible
from c, unnest(range(len(cs))) as r(i) where n % 4 <> 3""")
def listed_candidates(spark: SparkSession, d: str) -> DataFrame:
    """PR-10, SF-18: answers with a list of candidates, some of them broken, as rows."""
    n = F.col("n")
    flag = lambda i: F.when((n + i) % 3 == 0, "Yes").when((n + i) % 3 == 1, "false").otherwise("perhaps")
    one = lambda x, i: F.struct(F.concat(F.get("w", i), F.lit("_"), x, F.lit(".")).alias("relation"), flag(i).alias("linguistically_plausible"))
    made = F.to_json(F.struct(F.transform(F.slice("w", F.lit(2), F.lit(2)), one).alias("candidates")))
    raw = F.when(n % 4 == 3, F.concat(F.lit("[{"), made)).otherwise(F.concat(F.lit("```json\n"), made, F.lit("\n```")))
    told = lines(spark, d).where("n % 4 <> 3 or size(w) > 0").select("doc_id", "line", F.array(F.struct(F.lit(1).alias("attempt"), T.candidate_list(T.json_object(raw)).alias("candidates"))).alias("attempts"))
    rows = P.candidates(told, ["doc_id", "line"], "attempts")
    return rows.select("doc_id", "line", "rank", "relation", "relation_norm", F.col("linguistically_plausible").alias("plausible"))


@query(rf"""{_LINES} select doc_id, line, (list_filter(range(greatest(len(w) - 1, 0)), lambda i: w[i + 1] = w[-2] and w[i + 2] = w[-1])[1])::int as place,
  len(list_filter(range(len(w)), lambda i: 8 * i + length(w[i + 1]) > n // 3 and 8 * i < n // 2))::int as n_over,
  list_sum(list_transform(list_filter(range(0, n // 2, 3), lambda i: i < len(w)), lambda i: length(w[i + 1])))::double as total from w""")
def spans_of_lines(spark: SparkSession, d: str) -> DataFrame:
    """SF-15, SF-16, SF-30: where a line's last two words first stand, how many words overlap a stretch of it (a word begins each 8 characters), and the sum of the
    lengths at every third place, as losses."""
    n = F.col("n")
    place = F.when(F.size("w") >= 2, T.subarray_at(F.col("w"), F.slice("w", -2, 2)))
    spans = F.transform("w", lambda x, i: F.struct((8 * i).alias("s"), (8 * i + F.length(x)).alias("e")))
    losses = F.transform("w", lambda x: F.length(x).cast("double"))
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.floor(n / 2).cast("int") - 1, F.lit(0))), lambda i: (i % 3 == 0) & (i < F.floor(n / 2)))
    over = F.size(T.overlapping(spans, F.floor(n / 3).cast("int"), F.floor(n / 2).cast("int")))
    return lines(spark, d).select("doc_id", "line", place.alias("place"), over.alias("n_over"), T.masked_losses(losses, places)["total"].alias("total"))
