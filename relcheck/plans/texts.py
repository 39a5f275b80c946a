"""Queries of text functions on the texts of documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relcheck.functions import conversion as C
from relcheck.functions import text as T
from relcheck.functions import vocabulary as V
from relcheck.operators import joins as J
from relcheck.operators import shapes as P
from relcheck.plans.registry import query, read
from relcheck.tables import spread


def listed(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def any_of(words: list[str]) -> str:
    return "|".join(sorted(words, key=lambda w: (-len(w), w)))


#: Articles of the documents' languages, made placeholders: texts become captions with many of them.
ARTICLES = "the|la|le|die|der|el"


@query(rf"""with c as (
  select doc_id, trim(regexp_replace(trim(regexp_replace(regexp_replace(text, '[\p{{L}}&&[^A-Za-z]]', '_', 'g'), '[^\x00-\x7F]', '_', 'g'), ' ' || chr(10) || chr(9)), '^["'']+|["'']+$', '', 'g'), ' ' || chr(10) || chr(9)) as t from documents
), s as (
  select doc_id, unnest(string_split_regex(regexp_replace(t, '\b({ARTICLES})\b', '{{x}}', 'g'), '\{{[^{{}}]+\}}')) as span, unnest(range(len(string_split_regex(regexp_replace(t, '\b({ARTICLES})\b', '{{x}}', 'g'), '\{{[^{{}}]+\}}')))) as i,
    len(string_split_regex(regexp_replace(t, '\b({ARTICLES})\b', '{{x}}', 'g'), '\{{[^{{}}]+\}}')) as n from c
), b as (
  select *, regexp_replace(span, '^[ \t\n"''.,;:()]+|[ \t\n"''.,;:()]+$', '', 'g') as bare from s where i > 0
), h as (
  select *, regexp_extract_all(bare, '\b([A-Za-z][A-Za-z\-]*(?:ing|ed))\b', 1) as heads, string_split_regex(bare, '\b([A-Za-z][A-Za-z\-]*(?:ing|ed))\b') as between from b
), r as (
  select doc_id, i, n, list_filter(list_transform(heads, lambda x, j: case when list_contains({listed([*V.SPAN_META_HEADS, *V.SPAN_AUXILIARIES])}, lower(x)) then null
      when j = 1 and list_contains({listed([*V.SINGLE_PREPOSITIONS, *V.COMPOUND_PREPOSITIONS])}, trim(trim(lower(between[1]), ' ' || chr(10)), ' ,;:')) then null
      else lower(x) || coalesce(' ' || nullif(regexp_extract(lower(between[j + 1]) || '|', '^\s*({"|".join(V.COMPOUND_PREPOSITIONS)}|{any_of(V.SINGLE_PREPOSITIONS)})[^a-z_]', 1), ''), '') end), lambda x: x is not null)[1] as rel from h
), p as (
  select doc_id, max(rel) filter (i = 1 and n >= 3) as first, min_by(rel, i) filter (rel is not null) as later from r group by doc_id
)
select doc_id, coalesce(first, later) as relation, case when first is not null then 'between' when later is not null then 'later' else 'fail' end as source from documents left join p using (doc_id)""")
def caption_relations(spark: SparkSession, d: str) -> DataFrame:
    caption = F.regexp_replace("text", rf"(?U)\b({ARTICLES})\b", "{x}")
    return read(spark, d, "documents").select("doc_id", C.caption_relation(caption).alias("r")).select("doc_id", "r.*")


#: How the sentences of the documents are made questions: by their number of characters.
OPENINGS = ["Is", "Are", "Does", "Was", "Is there", "Do", "Were"]

_SENTENCES = rf"""with s as (
  select doc_id, unnest(list_filter(list_transform(string_split_regex(text, '[.\n]'), lambda x: trim(x)), lambda x: x <> '')) as said from documents
), q as (
  select doc_id, said, {listed(OPENINGS)}[length(said) % 7 + 1] as opening, trim(regexp_replace(said, '\?+$', '')) as bare0 from s
), a as (
  select *, lower(split_part(opening, ' ', 1)) as aux, trim(case when bare0 = '' then '' else bare0 end) as rest0 from q
), b as (
  select *, regexp_matches(rest0, '(?i)\sin the image$') as trailing,
    case when regexp_matches(rest0, '(?i)\sin the image$') then trim(regexp_replace(rest0, '(?i)\s+in the image$', '')) else rest0 end as rest from a
), c as (
  select *, regexp_replace(rest, '[^\x00-\x7F]', '_', 'g') as m, list_filter(string_split_regex(rest, '\s+'), lambda x: x <> '') as toks from b
), e as (
  select *, list_transform(toks, lambda x: lower(regexp_replace(x, '[^A-Za-z]', '', 'g'))) as stems from c
), f as (
  select *, list_filter(range(len(stems)), lambda i: i > 0 and length(stems[i + 1]) > 4 and stems[i + 1].suffix('ing') and not list_contains({listed(V.NOT_GERUNDS)}, stems[i + 1]))[1] as ing,
    list_filter(range(len(stems)), lambda i: i > 1 and length(stems[i + 1]) > 4 and stems[i + 1].suffix('ed'))[1] as ed,
    list_filter(range(len(stems)), lambda i: i > 0 and list_contains({listed(V.DOES_VERBS)}, stems[i + 1]))[1] as known,
    list_filter(range(len(stems)), lambda i: i > 0 and stems[i + 1] <> '' and not list_contains({listed(V.NOT_VERBS)}, stems[i + 1]))[1] as other,
    case when regexp_matches(m, '(?i)\b({any_of(V.PARTICIPLES)})\b') then length(regexp_extract(m, '(?is)^(.*?)\b({any_of(V.PARTICIPLES)})\b', 1)) + 1 else 0 end as part,
    case when regexp_matches(m, '(?i)\b(a|an|the same)\b') then length(regexp_extract(m, '(?is)^(.*?)\b(a|an|the same)\b', 1)) + 1 else 0 end as art,
    case when regexp_matches(m, '(?i)\b({any_of(V.PLACES)})\b') then length(regexp_extract(m, '(?is)^(.*?)\b({any_of(V.PLACES)})\b', 1)) + 1 else 0 end as place,
    length(regexp_extract(m, '(?i)\b({any_of(V.PLACES)})\b', 1)) as place_n from e
), g as (
  select *, list_filter(string_split_regex(trim(substr(rest, place + place_n)), '\s+'), lambda x: x <> '') as after, coalesce(known, other) as verb_at from f
), w as (
  select *, case when opening <> 'Does' then toks[verb_at + 1] else (with v as (select lower(toks[verb_at + 1]) as low)
    select case when substr(toks[verb_at + 1], 1, 1) <> lower(substr(toks[verb_at + 1], 1, 1)) then upper(substr(x, 1, 1)) || substr(x, 2) else x end from (
      select case low when 'have' then 'has' when 'do' then 'does' when 'be' then 'is' when 'go' then 'goes' when 'wear' then 'wears' else
        case when regexp_matches(low, '[^aeiou]y$') then low[:-2] || 'ies' when regexp_matches(low, '(s|sh|ch|x|z|o)$') then low || 'es' else low || 's' end end as x from v)) end as verb from g
), t as (
  select *, case when opening = 'Is there' then 'There is ' || rest0
    when opening in ('Does', 'Do') then case when verb_at is null then null else array_to_string(list_filter([array_to_string(toks0[1:verb_at], ' '), verb, array_to_string(toks0[verb_at + 2:], ' ')], lambda x: x <> ''), ' ') end
    when ing is not null then array_to_string(toks[1:ing], ' ') || ' ' || aux || ' ' || array_to_string(toks[ing + 1:], ' ')
    when part > 1 then trim(substr(rest, 1, part - 1)) || ' ' || aux || ' ' || substr(rest, part)
    when ed is not null then array_to_string(toks[1:ed], ' ') || ' ' || aux || ' ' || array_to_string(toks[ed + 1:], ' ')
    when art > 1 and not regexp_matches(substr(m, 1, art - 1), '(?i)\b({any_of(V.PLACES)})\s+$') then trim(substr(rest, 1, art - 1)) || ' ' || aux || ' ' || substr(rest, art)
    when place > 1 and len(after) > 0 and list_contains({listed(V.LAST_ADJECTIVES)}, lower(after[-1])) and not list_contains(['the', 'a', 'an'], lower(after[1]))
      then trim(substr(rest, 1, length(rest) - length(after[-1]))) || ' ' || aux || ' ' || after[-1]
    when place > 1 then trim(substr(rest, 1, place - 1)) || ' ' || aux || ' ' || substr(rest, place)
    when len(toks) >= 2 then array_to_string(toks[1:len(toks) - 1], ' ') || ' ' || aux || ' ' || toks[-1] end as body,
  case when opening = 'Is there' then 'rbench_there'
    when opening in ('Does', 'Do') then case when known is not null then 'rbench_does' when other is not null then 'rbench_does_fallback' else 'does_fail' end
    when ing is not null then 'rbench_fallback_ing' when part > 1 then 'rbench_fallback_ed' when ed is not null then 'rbench_is_are'
    when art > 1 and not regexp_matches(substr(m, 1, art - 1), '(?i)\b({any_of(V.PLACES)})\s+$') then 'rbench_fallback_comp'
    when place > 1 and len(after) > 0 and list_contains({listed(V.LAST_ADJECTIVES)}, lower(after[-1])) and not list_contains(['the', 'a', 'an'], lower(after[1])) then 'rbench_fallback_loc_adj'
    when place > 1 then 'rbench_fallback_loc' when len(toks) >= 2 then 'rbench_fallback_last' else 'is_are_fail' end as tag
  from (select *, toks as toks0 from w)
), u as (select *, trim(regexp_replace(body, '\s+', ' ', 'g')) as flat from t),
done as (select doc_id, said, tag, case when flat is not null then regexp_replace(upper(substr(flat, 1, 1)) || substr(flat, 2), '[ .]+$', '') || '.' end as statement from u)"""


def sentences(spark: SparkSession, d: str) -> DataFrame:
    said = F.filter(F.transform(F.split("text", "[.\n]"), lambda s: F.trim(s)), lambda s: s != "")
    return read(spark, d, "documents").select("doc_id", F.explode(said).alias("said"))


def sentence_questions(each: DataFrame) -> DataFrame:
    """Rows with a sentence `said`, dealt to all cores and converted as questions: a file of texts is one task otherwise."""
    opening = F.get(F.array(*[F.lit(o) for o in OPENINGS]), F.length("said") % 7)
    each = spread(each, *each.columns)
    return C.converted(each.withColumn("q", F.concat(opening, F.lit(" "), F.col("said"), F.lit("?"))), "q", "said")


@query(f"{_SENTENCES} select doc_id, tag, count(*) as n, count(statement) as n_made, md5(string_agg(statement, '|' order by statement)) as digest from done group by doc_id, tag")
def open_questions(spark: SparkSession, d: str) -> DataFrame:
    digest = F.md5(F.array_join(F.array_sort(F.collect_list("statement")), "|"))
    each = sentence_questions(sentences(spark, d)).groupBy("doc_id", "tag").agg(F.count(F.lit(1)).alias("n"), F.count("statement").alias("n_made"), digest.alias("digest"))
    return each.withColumn("digest", F.when(F.col("n_made") > 0, F.col("digest")))


@query(f"""{_SENTENCES}, each as (select tag, statement, count(*) as n from done group by all),
both_ as (select tag, statement, n from each union all select null, statement, sum(n) from each group by statement)
select tag, sum(n)::bigint as n, coalesce(sum(n) filter (statement is not null), 0)::bigint as converted, coalesce(sum(n) filter (statement is null), 0)::bigint as failed,
  coalesce(sum(n - 1) filter (statement is not null), 0)::bigint as duplicates from both_ group by tag""")
def conversion_report(spark: SparkSession, d: str) -> DataFrame:
    different = sentences(spark, d).groupBy("said").agg(F.count(F.lit(1)).alias("times"))
    return C.conversion_quality(sentence_questions(different), "times")


def words(df: DataFrame) -> DataFrame:
    return df.select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1)).alias("word")).distinct()


_STEM = "case when w.suffix('ing') and length(w) > 6 then w[:-4] when w.suffix('ed') and length(w) > 5 then w[:-3] when w.suffix('es') and length(w) > 5 then w[:-3] when w.suffix('s') and length(w) > 4 then w[:-2] else w end"
_LEMMAS = ", ".join(f"('{a}', '{b}')" for a, b in V.LEMMAS.items())


@query(rf"""with lem(f, l) as (values {_LEMMAS}),
d as (select distinct unnest(regexp_extract_all(text, '[A-Za-z]+')) as word from documents), k as (select distinct lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) as w from benchmark),
kl as (select distinct coalesce(l, {_STEM}) as y from k left join lem on f = w),
q as (select word, lower(word) as w from d), q2 as (select word, w, coalesce(l, {_STEM}) as y from q left join lem on f = w),
g as (select distinct 'a' || substr(w, 1, 4) as grp, w as term from q where length(w) >= 5 union select distinct 'b' || right(w, 5), w from q where length(w) >= 6),
gk as (select distinct grp from g where term in (select w from k)), gt as (select distinct term from g where grp in (select grp from gk))
select word, case when w in (select w from k) then 'exact' when y in (select y from kl) then 'lemma' when w in (select term from gt) then 'synonym' else 'unseen' end as seen_at from q2""")
def relation_levels(spark: SparkSession, d: str) -> DataFrame:
    own = words(read(spark, d, "documents"))
    low = own.select(F.lower("word").alias("term")).distinct()
    groups = low.where(F.length("term") >= 5).select(F.concat(F.lit("a"), F.substring("term", 1, 4)).alias("grp"), "term")
    groups = groups.unionByName(low.where(F.length("term") >= 6).select(F.concat(F.lit("b"), F.right("term", F.lit(5))).alias("grp"), "term")).distinct()
    return J.seen_level(own, "word", words(read(spark, d, "benchmark")), "word", groups)


@query(f"""with b as (
  select doc_id, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) as r from (select doc_id, list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda x: lower(x)) as ws from documents)
), f as (
  select doc_id, case when r in {tuple(dict.fromkeys(V.SPATIAL))} then 'spatial' when r in {tuple(dict.fromkeys(V.CONTACT))} or split_part(r, ' ', 1) in {tuple(dict.fromkeys(V.CONTACT))} then 'contact'
    when split_part(r, ' ', 1) in {tuple(V.PLACE_WORDS)} or split_part(r, ' ', 2) in {tuple(V.PLACE_WORDS)} or regexp_matches(r, 'front of|top of|next to') then 'spatial'
    when regexp_matches(split_part(r, ' ', 1), '(ing|ed)$') then 'contact' else 'other' end as family from b
)
select doc_id, family, count(*) as n from f group by all""")
def word_pair_families(spark: SparkSession, d: str) -> DataFrame:
    ws = F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1)
    pairs = read(spark, d, "documents").select("doc_id", ws.alias("ws")).select("doc_id", F.explode(F.transform(F.slice("ws", 2, 1 << 30), lambda w, i: F.concat(F.get("ws", i), F.lit(" "), w))).alias("r"))
    return pairs.groupBy("doc_id", T.qc_family(F.col("r")).alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query("""with t as (select doc_id, regexp_extract_all(text, '[A-Za-z]+') as w, length(text) % 4 as form from documents where text is not null)
select doc_id, case when form = 3 or len(w) < 3 then null else w[1] end as subject, case when form = 3 or len(w) < 3 then null else w[3] end as obj, form in (1, 2) or form = 3 as repaired from t""")
def answers_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Answers of four forms made of each document's words: bare JSON, a fence with braces around it, JSON in a sentence, and
    broken JSON."""
    w = F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1)
    part = lambda k: F.get(F.col("w"), F.lit(k))
    docs = read(spark, d, "documents").where("text is not null").select("doc_id", w.alias("w"), (F.length("text") % 4).alias("form"))
    fields = F.when(F.size("w") >= 3, F.struct(part(0).alias("subject"), part(1).alias("relation"), part(2).alias("object"))).otherwise(F.struct(F.lit(None).cast("string").alias("subject"), F.lit(None).cast("string").alias("relation"), F.lit(None).cast("string").alias("object")))
    made = docs.withColumn("j", F.to_json(fields))
    raw = F.when(F.col("form") == 1, F.concat(F.lit("{not this} ```json\n"), F.col("j"), F.lit("\n``` {nor this}"))).when(F.col("form") == 2, F.concat(F.lit("It is "), F.col("j"), F.lit(".")))
    raw = raw.when(F.col("form") == 3, F.concat(F.lit("It is {"), F.col("j"))).otherwise(F.col("j"))
    found = made.select("doc_id", T.json_answer(raw).alias("a")).select("doc_id", F.from_json("a.object", "subject string, object string").alias("j"), "a.repaired")
    return found.select("doc_id", "j.subject", F.col("j.object").alias("obj"), "repaired")


@query("""select lang, source, count(*) as n, sum(n_chars)::bigint as chars from documents where lang = 'en' and n_chars > 100 group by all""")
def subset_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = P.subset_of(read(spark, d, "documents"), {"lang": "en"}, F.col("n_chars") > 100)
    return rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))
