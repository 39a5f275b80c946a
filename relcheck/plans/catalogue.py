"""The queries of the library on the driver's tables, each with its SQL.

The tables have no yes/no answers, so two answer logs are made of documents: a text rule gives each document a free-text
answer, the label's quality is the gold answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relcheck.functions import answers as A
from relcheck.functions import text as T
from relcheck.operators import decisions as D
from relcheck.operators import joins as J
from relcheck.operators import metrics as M
from relcheck.operators import rules as R
from relcheck.operators import sampling as S
from relcheck.operators import shapes as P
from relcheck.operators import stats as B
from relcheck.plans.registry import ORACLE_SQL, QUERIES, query, read

__all__ = ["ORACLE_SQL", "QUERIES"]

# Answers that readers of answers disagree on, by doc_id modulo their number.
ANSWERS = ["Yes, it is.", "No.", "no, it does not", "Nothing to see", "", "NO", "It is not there. Yes", "Yes and no", "uncertain", "The answer is (B).", "There is no image, so no", "implausible, not plausible"]


def answer_text(n: str) -> str:
    return "case " + " ".join(f"when {n} % {len(ANSWERS)} = {i} then '{a}'" for i, a in enumerate(ANSWERS)) + " end"


def logs(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, lang, gold (boolean), answer and other (texts of two runs)."""
    docs = read(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    gold = read(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("gold"), (F.col("toxic") == 1).alias("toxic"))
    both = docs.join(gold, "doc_id")
    return both.select("*", F.expr(answer_text("doc_id")).alias("answer"), F.when(F.col("n_chars") % 3 == 0, "No, it isn't").otherwise("Yes").alias("other"))


LOGS = f"""with l as (
  select d.doc_id, d.lang, d.source, d.n_chars, b.quality = 1 as gold, b.toxic = 1 as toxic, {answer_text("d.doc_id")} as answer,
         case when d.n_chars % 3 = 0 then 'No, it isn''t' else 'Yes' end as other
  from documents d join labels b using (doc_id)
), p as (
  select *, not list_has_any(string_split_regex(trim(replace(split_part(answer, '.', 1), ',', ' ')), '\\s+'), ['No', 'not', 'no']) as a,
         not list_has_any(string_split_regex(trim(replace(split_part(other, '.', 1), ',', ' ')), '\\s+'), ['No', 'not', 'no']) as b from l
)"""
CELLS = """count(*) filter (a and gold) tp, count(*) filter (a and not gold) fp, count(*) filter (not a and gold) fn, count(*) filter (not a and not gold) tn, count(*) n"""
RATES = """coalesce((tp + tn) / nullif(n, 0), 0.0)::double accuracy, coalesce(tp / nullif(tp + fp, 0), 0.0)::double as precision, coalesce(tp / nullif(tp + fn, 0), 0.0)::double recall,
  coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0)::double f1, coalesce((tp + fp) / nullif(n, 0), 0.0)::double yes_ratio"""


@query(f"{LOGS} select *, {RATES} from (select lang, (1 - grouping(lang))::int as level, {CELLS} from p group by grouping sets ((), (lang)))")
def confusion_by_lang(spark: SparkSession, d: str) -> DataFrame:
    return M.metrics(logs(spark, d), A.pred_yes(F.col("answer")), F.col("gold"), "lang")


@query(f"{LOGS} select *, {RATES} from (select lang, source, (2 - grouping(lang) - grouping(source))::int as level, {CELLS} from p group by grouping sets ((), (lang), (lang, source)))")
def format_subset_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return M.metrics(logs(spark, d), A.pred_yes(F.col("answer")), F.col("gold"), "lang", "source")


@query(f"""{LOGS} select * exclude (yes_ratio), 1.0::double - yes_ratio as yes_ratio from (select *, {RATES} from (select lang, {CELLS} from (select lang, not a as a, not gold as gold from p) group by lang))""")
def no_positive_metrics(spark: SparkSession, d: str) -> DataFrame:
    return M.no_positive(logs(spark, d), ~A.pred_yes(F.col("answer")), ~F.col("gold"), "lang")


@query(f"""{LOGS}, h as (
  select *, case when lower(trim(answer)) similar to 'yes([^a-z0-9_].*)?' then 'Yes' when lower(split_part(trim(answer), '.', 1)) similar to 'no([^a-z0-9_].*)?' then 'No' else 'Invalid' end as v from p
)
select lang, tp, fp, fn, tn, n, n_invalid, {RATES.replace("(tp + fp) / nullif(n, 0), 0.0)::double yes_ratio", "n_yes / nullif(n, 0), 0.0)::double yes_ratio")} from (
  select lang, count(*) filter (v = 'Yes' and gold) tp, count(*) filter (v <> 'No' and not gold) fp, count(*) filter (v <> 'Yes' and gold) fn,
         count(*) filter (v = 'No' and not gold) tn, count(*) n, count(*) filter (v = 'Yes') n_yes, count(*) filter (v = 'Invalid') n_invalid from h group by lang)""")
def invalid_penalised_metrics(spark: SparkSession, d: str) -> DataFrame:
    return M.invalid_penalised(logs(spark, d), A.strict_head(F.col("answer")), F.col("gold"), "lang")


@query(f"""{LOGS}, f as (select unnest(list_distinct([(doc_id % 5)::int, case when doc_id % 2 = 0 then 5 else (doc_id % 5)::int end])) as fold, a, gold from p),
m as (select *, {RATES} from (select fold, {CELLS} from f group by fold))
select count(*) n_folds, avg(accuracy) accuracy, avg(precision) as precision, avg(recall) recall, avg(f1) f1, avg(yes_ratio) yes_ratio from m""")
def fold_macro_average(spark: SparkSession, d: str) -> DataFrame:
    fold = (F.col("doc_id") % 5).cast("int")
    folds = F.array_distinct(F.array(fold, F.when(F.col("doc_id") % 2 == 0, 5).otherwise(fold)))
    return M.fold_mean(logs(spark, d), folds, A.pred_yes(F.col("answer")), F.col("gold"))


@query(f"""{LOGS} select lang, b, c, n, case when b + c = 0 then 0.0 else pow(abs(b - c) - 1, 2) / (b + c) end::double as chi2 from (
  select lang, count(*) filter ((a = gold) and (b <> gold)) b, count(*) filter ((a <> gold) and (b = gold)) c, count(*) n from p group by lang)""")
def mcnemar_counts(spark: SparkSession, d: str) -> DataFrame:
    x = logs(spark, d)
    right = lambda c: A.pred_yes(F.col(c)) == F.col("gold")
    return B.mcnemar(x, right("answer"), right("other"), "lang", p_value=False)


@query()
def mcnemar_p_value(spark: SparkSession, d: str) -> DataFrame:
    x = logs(spark, d)
    right = lambda c: A.pred_yes(F.col(c)) == F.col("gold")
    return B.mcnemar(x, right("answer"), right("other"), "lang")


def binomial_sql(name: str, draws: str) -> str:
    """CTEs: draws (u, n, p and more) with k, the least number whose cumulated binomial chance is u or more."""
    chance = "exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(greatest(p, 1e-300)) + (n - k) * ln(greatest(1 - p, 1e-300)))"
    return f"""{name}_cdf as (
  select n, p, k, sum(case when p <= 0 then (k = 0)::int when p >= 1 then (k = n)::int else {chance} end) over (partition by n, p order by k) as c
  from (select distinct n, p from {draws}), unnest(range(n + 1)) as r(k)
), {name} as (select d.*, (select count(*) from {name}_cdf c where c.n = d.n and c.p = d.p and c.c < d.u) as k from {draws} d)"""


def unit_sql(text: str) -> str:
    return f"(('0x' || substr(md5({text}), 1, 12))::bigint / 281474976710656.0)::double"


def difference_sql(seed: int) -> str:
    """CTEs from counts (label, n, oa, ob): diff (label, draw, mean)."""
    return f"""dd as (select label, draw, n, oa, ob, {unit_sql(f"'{seed}:' || label || ':discordant:' || draw")} as u, coalesce((oa + ob)::double / nullif(n, 0), 0.0) as p from counts, unnest(range(200)) as r(draw)),
{binomial_sql("dk", "dd")},
bb as (select label, draw, n as whole, k as n, {unit_sql(f"'{seed}:' || label || ':b:' || draw")} as u, coalesce(ob::double / nullif(oa + ob, 0), 0.0) as p from dk),
{binomial_sql("bk", "bb")},
diff as (select label, draw, (2 * k - n)::double / whole as mean from bk)"""


@query(f"""{LOGS}, items as (
  select row_number() over (order by doc_id) - 1 as o, (b = gold)::int - (a = gold)::int as v, count(*) over () as n from p
), slots as (select draw, floor({unit_sql("'7:' || draw || ':' || o")} * n)::bigint as o from items, unnest(range(200)) as r(draw)),
m as (select draw, avg(v) as mean from slots join items using (o) group by draw), s as (select list_sort(list(mean)) as xs from m)
select (select avg((b = gold)::int - (a = gold)::int) from p) as delta, (select count(*) from p) as n, xs[6] as low, xs[196] as high from s""")
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    x = logs(spark, d)
    right = lambda c: A.pred_yes(F.col(c)) == F.col("gold")
    return B.paired_resampling(x, right("answer"), right("other"), F.col("doc_id"), 200, 7)


@query(f"""{LOGS}, counts as (
  select 'paired:' || lang as label, lang, count(*) n, count(*) filter (a = gold and b <> gold) oa, count(*) filter (a <> gold and b = gold) ob, avg((b = gold)::int - (a = gold)::int) as delta from p group by lang
), {difference_sql(7)}, s as (select label, list_sort(list(mean)) as xs from diff group by label)
select lang, n, delta, xs[6] as low, xs[196] as high from counts join s using (label)""")
def bootstrap_by_lang(spark: SparkSession, d: str) -> DataFrame:
    x = logs(spark, d)
    right = lambda c: A.pred_yes(F.col(c)) == F.col("gold")
    return B.paired_bootstrap(x, right("answer"), right("other"), 200, 7, "lang")


@query(f"""{LOGS}, counts as (
  select case when lang = 'en' then 'treated' else 'others' end as label, count(*) n, count(*) filter (a = gold and b <> gold) oa, count(*) filter (a <> gold and b = gold) ob,
    avg((b = gold)::int - (a = gold)::int) as gain from p group by all
), {difference_sql(7)}, s as (select list_sort(list(t.mean - o.mean)) as xs from diff t join diff o using (draw) where t.label = 'treated' and o.label = 'others')
select t.gain as treated, o.gain as others, t.gain - o.gain as did, t.n as n_treated, o.n as n_others, xs[6] as low, xs[196] as high
from counts t, counts o, s where t.label = 'treated' and o.label = 'others'""")
def did_by_lang(spark: SparkSession, d: str) -> DataFrame:
    x = logs(spark, d)
    right = lambda c: A.pred_yes(F.col(c)) == F.col("gold")
    return B.difference_in_differences(x, right("answer"), right("other"), F.col("lang") == "en", 200, 7)


@query(f"""{LOGS}, counts as (
  select case when lang = 'en' then 'one' else 'other' end as label, count(*) n, count(*) filter (a = gold) r from p group by all
), rr as (select label, draw, n, {unit_sql("'7:' || label || ':right:' || draw")} as u, r::double / n as p from counts, unnest(range(200)) as t(draw)),
{binomial_sql("rk", "rr")}, s as (select list_sort(list(x.k::double / x.n - y.k::double / y.n)) as xs from rk x join rk y using (draw) where x.label = 'one' and y.label = 'other')
select x.r / x.n - y.r / y.n as gap, x.n as n_one, y.n as n_other, xs[6] as low, xs[196] as high from counts x, counts y, s where x.label = 'one' and y.label = 'other'""")
def gap_by_lang(spark: SparkSession, d: str) -> DataFrame:
    x = logs(spark, d)
    return B.gap(x, A.pred_yes(F.col("answer")) == F.col("gold"), F.col("lang") == "en", 200, 7)


@query()
def mean_bootstrap_by_flag(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("l_extendedprice").cast("double") - F.col("l_quantity").cast("double") * 1500
    return B.mean_bootstrap(read(spark, d, "lineitem"), v, 500, 7, "l_returnflag")


@query("""with x as (select l_returnflag, l_extendedprice::double - l_quantity::double * 1500 as v from lineitem)
select l_returnflag, count(v) n, round(avg(v), 4) mean, round(median(v), 4) median, round(coalesce(stddev_samp(v), 0.0), 4) std, avg((v > 0)::int) positive from x group by l_returnflag""")
def paired_delta_summary(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("l_extendedprice").cast("double") - F.col("l_quantity").cast("double") * 1500
    out = B.summary(read(spark, d, "lineitem"), v, "l_returnflag")
    return out.select("l_returnflag", "n", *[F.round(c, 4).alias(c) for c in ("mean", "median", "std")], "positive")


@query(f"""{LOGS} select layer, count(*) n, avg((v = toxic)::int) lock_rate, avg((v = gold)::int) accuracy from (
  select case when toxic is null then 'invalid' when toxic = gold then 'consistent' else 'conflict' end layer, toxic, a as v, gold from p) group by layer""")
def layer_lock_rate(spark: SparkSession, d: str) -> DataFrame:
    return M.lock_rate(logs(spark, d), F.col("toxic"), A.pred_yes(F.col("answer")), F.col("gold"))


@query(f"""{LOGS} select lang, count(*) filter (a <> gold and b = gold) fixed, count(*) filter (a = gold and b <> gold) broken, count(*) filter (a = gold and b = gold) both_right,
  count(*) filter (a <> gold and b <> gold) both_wrong, avg((a = b)::int) agreement from p group by lang""")
def transition_counts(spark: SparkSession, d: str) -> DataFrame:
    return M.transitions(logs(spark, d), A.pred_yes(F.col("answer")), A.pred_yes(F.col("other")), F.col("gold"), "lang")


@query("""with t as (select p_partkey, unnest(string_split(lower(p_name), ' ')) as item from part)
select item, count(*) n, min(p_partkey) first_seen from t group by item order by n desc, first_seen limit 20""")
def freq_topk(spark: SparkSession, d: str) -> DataFrame:
    words = read(spark, d, "part").select("p_partkey", F.explode(F.split(F.lower("p_name"), " ")).alias("w"))
    return M.most_common(words, F.col("w"), F.col("p_partkey"), 20)


@query("""select count(*) n, count(distinct coalesce(p_type, '')) types, count(distinct coalesce(p_brand, '')) brands, count(distinct coalesce(p_type, '') || '||' || coalesce(p_brand, '')) pairs from part""")
def diversity_stats(spark: SparkSession, d: str) -> DataFrame:
    return M.diversity(read(spark, d, "part"), types=["p_type"], brands=["p_brand"], pairs=["p_type", "p_brand"])


@query("select max(c) / sum(c)::double as max_share, count(*) n_groups from (select source, count(*) c from documents group by source)")
def largest_source_share(spark: SparkSession, d: str) -> DataFrame:
    return M.max_share(read(spark, d, "documents"), "source")


@query("""select word, count(*) n from (select unnest(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: length(x) >= 3)) as word from documents) group by word having count(*) >= 2""")
def vocab_min_freq(spark: SparkSession, d: str) -> DataFrame:
    return M.vocabulary(read(spark, d, "documents"), F.split(F.lower("text"), "[^a-z]+"))


@query("select conv_id, arg_max(text, turn) as text from conversations where role in ('gpt', 'assistant') group by conv_id")
def last_assistant_turn(spark: SparkSession, d: str) -> DataFrame:
    return P.last_turn(read(spark, d, "conversations"), "conv_id", "turn", "role", "text")


@query("select conv_id, arg_min(text, turn) as text from conversations where role in ('human', 'user') group by conv_id")
def first_user_turn(spark: SparkSession, d: str) -> DataFrame:
    return P.first_turn(read(spark, d, "conversations"), "conv_id", "turn", "role", "text")


@query("""select conv_id, count(*) n_turns, string_agg(role, ',' order by turn) roles, md5(string_agg(text, '|' order by turn)) digest from conversations group by conv_id""")
def conversation_nested(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("conversations")
    out = P.conversations(read(spark, d, "conversations"), "conv_id", "turn", "role", "text")
    return out.select("conv_id", F.size(c).cast("bigint").alias("n_turns"), F.array_join(F.transform(c, lambda t: t["from"]), ",").alias("roles"), F.md5(F.array_join(F.transform(c, lambda t: t["value"]), "|")).alias("digest"))


@query("""select doc_id, 0 as pos, 'pos' as variant, 'Quality is ' || quality || '.' as statement from labels
union all select doc_id, 1, 'neg', 'Quality is ' || (1 - quality) || '.' from labels
union all select doc_id, 2, 'toxic', 'Toxic.' from labels where toxic = 1""")
def pair_expand(spark: SparkSession, d: str) -> DataFrame:
    say = lambda q: F.concat(F.lit("Quality is "), q.cast("string"), F.lit("."))
    return P.expanded(read(spark, d, "labels"), ["doc_id"], pos=say(F.col("quality")), neg=say(1 - F.col("quality")), toxic=F.when(F.col("toxic") == 1, "Toxic.").otherwise(""))


@query("""select doc_id as id, text, null as relation, 'docs' as tag from documents union all select item_id, text, null, 'items' from benchmark
union all select conv_id, text, role, 'turns' from conversations""")
def unionbyname_jobs(spark: SparkSession, d: str) -> DataFrame:
    turns = read(spark, d, "conversations")
    return P.tagged_union(
        docs=read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"),
        items=read(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"),
        turns=turns.select(F.col("conv_id").alias("id"), "text", F.col("role").alias("relation")),
    )


@query("select doc_id, lang from documents where doc_id not in (select doc_id from labels)")
def anti_join_resume(spark: SparkSession, d: str) -> DataFrame:
    return J.unprocessed(read(spark, d, "documents").select("doc_id", "lang"), read(spark, d, "labels"), "doc_id")


@query("""select page_id, url from pages where regexp_extract(url, '[^/]*$') not in (select regexp_extract(url, '[^/]*$') from pages where page_id % 3 = 0)""")
def leakage_safe_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = read(spark, d, "pages").select("page_id", "url")
    return J.leakage_safe(pages, pages.where("page_id % 3 = 0"), "url")


@query("""select doc_id from documents where sha256(text) not in (select sha256(text) from documents where doc_id % 2 = 0)""")
def content_hash_decontam(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "text")
    return J.content_safe(docs, docs.where("doc_id % 2 = 0"), "text").select("doc_id")


@query("""select o_orderkey, lpad(o_orderkey::varchar, 12, '0') as noisy, o_orderkey::varchar as qid from orders""")
def aliased_key_join(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders").select("o_orderkey")
    text = orders.select(F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("noisy"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("k"))
    return J.aliased_join(orders, text, "o_orderkey", "k")


@query("""with v as (select distinct p_type as t from part), n as (select distinct p_type as g from part),
w as (select g, t, string_split(lower(g), ' ') a, string_split(lower(t), ' ') b from n, v)
select g, t from w where not (g = t or contains(lower(g), lower(t)) or contains(lower(t), lower(g)) or a[1] = b[1]
  or len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::double >= 0.5)""")
def theta_similarity_pairs(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part")
    gold = part.select(F.col("p_type").alias("g"))
    return J.unlike_candidates(gold, "g", part.select(F.col("p_type").alias("t")), "t")


@query("""with k as (select distinct lower(p_brand) as b from part where p_partkey % 7 = 0)
select p_partkey, case when p_brand is null then null when lower(p_brand) in (select b from k) then 'exact' else 'unseen' end as seen_at from part""")
def equivalence_levels(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part").select("p_partkey", "p_brand")
    return J.seen_level(part, "p_brand", part.where("p_partkey % 7 = 0").select(F.col("p_brand").alias("known")), "known").select("p_partkey", "seen_at")


@query("""select o_custkey, max(o_totalprice::double) filter (o_orderstatus = 'F') as "F", max(o_totalprice::double) filter (o_orderstatus = 'O') as "O", max(o_totalprice::double) filter (o_orderstatus = 'P') as "P"
from orders group by o_custkey having count(distinct o_orderstatus) filter (o_orderstatus in ('F', 'O', 'P')) = 3""")
def k_way_intersection_pivot(spark: SparkSession, d: str) -> DataFrame:
    return J.in_every_run(read(spark, d, "orders"), ["o_custkey"], "o_orderstatus", ["F", "O", "P"], F.col("o_totalprice").cast("double"))


@query("""with r as (select distinct l_partkey, l_suppkey, l_orderkey, l_returnflag from lineitem)
select a.l_partkey, a.l_suppkey, a.l_orderkey, a.l_returnflag, b.l_orderkey as other_l_orderkey, b.l_returnflag as other_l_returnflag
from lineitem a join r b using (l_partkey, l_suppkey) where a.l_orderkey <> b.l_orderkey
and not exists (select 1 from r where r.l_partkey = b.l_partkey and r.l_suppkey = b.l_suppkey and r.l_orderkey = b.l_orderkey and r.l_returnflag = a.l_returnflag)""")
def entity_pair_selfjoin(spark: SparkSession, d: str) -> DataFrame:
    return J.same_pair_elsewhere(read(spark, d, "lineitem"), ["l_partkey", "l_suppkey"], "l_orderkey", "l_returnflag")


@query("""with o as (select row_number() over (order by o_orderkey) - 1 ord, o_custkey id from orders), c as (select row_number() over (order by c_custkey) - 1 ord, c_custkey id from customer)
select ord, o.id left_id, c.id right_id, coalesce(o.id = c.id, false) same from o full join c using (ord)""")
def zip_check(spark: SparkSession, d: str) -> DataFrame:
    a = S.numbered(read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("id")), "o_orderkey")
    b = S.numbered(read(spark, d, "customer").select(F.col("c_custkey").alias("id")), "id")
    return J.zipped(a, b, "ord", "id")


@query("""select l_orderkey, min(l_linenumber) as l_linenumber from lineitem where l_returnflag = 'R' group by l_orderkey""")
def first_qualifying_row(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return S.first_qualifying(rows, ["l_orderkey"], F.col("l_returnflag") == "R", F.col("l_linenumber")).select("l_orderkey", "l_linenumber")


@query("""select p_brand, p_partkey, p_type from (select *, row_number() over (partition by p_brand order by hi, price desc, p_partkey) rn from (
  select p_brand, p_partkey, p_type, p_retailprice::double price, row_number() over (partition by p_brand, p_type order by p_retailprice::double desc, p_partkey) > 2 as hi from part)) where rn <= 5""")
def head_quota_topk(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part").select("p_brand", "p_type", "p_partkey", F.col("p_retailprice").cast("double").alias("price"))
    return S.top_with_quota(part, ["p_brand"], "p_type", 5, 2, F.desc("price"), F.col("p_partkey")).select("p_brand", "p_partkey", "p_type")


@query("""select o_orderkey, tier from (select o_orderkey, o_orderpriority, case when rn <= 5 then 0 when rn <= 8 then 1 when rn <= 12 then 2 else 3 end as tier from (
  select *, row_number() over (partition by o_orderpriority order by o_orderkey) rn from orders) where rn <= 100) order by tier, o_orderkey limit 100""")
def relaxing_cap_select(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return S.relaxing_caps(orders, "o_orderpriority", 100, [0.05, 0.08, 0.12, 1.0], F.col("o_orderkey"), F.col("o_orderkey")).select("o_orderkey", "tier")


@query("""select source, lang, n from (select source, lang, count(*) n, max(count(*)) over (partition by source) m from documents group by source, lang) where n = m""")
def arg_max_ties(spark: SparkSession, d: str) -> DataFrame:
    counts = read(spark, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    return S.arg_max(counts, ["source"], "n")


@query("select source, doc_id from (select source, doc_id, row_number() over (partition by source order by md5('5:' || doc_id), doc_id) rn from documents) where rn = 1")
def one_per_group(spark: SparkSession, d: str) -> DataFrame:
    return S.one_per_group(read(spark, d, "documents").select("source", "doc_id"), ["source"], 5, "doc_id")


@query("select doc_id, ((row_number() over (partition by quality order by doc_id::varchar)) - 1) % 3 as slot from labels")
def round_robin_assign(spark: SparkSession, d: str) -> DataFrame:
    return S.round_robin(read(spark, d, "labels"), ["quality"], 3, F.col("doc_id").cast("string")).select("doc_id", F.col("slot").cast("bigint").alias("slot"))


@query("""select p_type, p_partkey, turn from (select p_type, p_partkey, row_number() over (partition by p_type order by p_partkey)::int turn from part) order by turn, p_type limit 50""")
def round_robin_pick(spark: SparkSession, d: str) -> DataFrame:
    return S.interleaved(read(spark, d, "part").select("p_type", "p_partkey"), "p_type", 50, F.col("p_partkey"))


@query("""with c as (select p_type, count(*) n from part group by p_type), r as (select p_type, n, row_number() over (order by n desc, p_type) - 1 i, greatest(count(*) over () // 3, 1) t from c)
select p_type, n, least(i // t, 2)::int as tertile from r""")
def freq_tertiles(spark: SparkSession, d: str) -> DataFrame:
    return S.tertiles(read(spark, d, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n")), "p_type", "n")


@query("select c_custkey, row_number() over (order by c_custkey) - 1 as ord from customer")
def ordinal_ids(spark: SparkSession, d: str) -> DataFrame:
    return S.numbered(read(spark, d, "customer").select("c_custkey"), "c_custkey")


@query("""with x as (select d.doc_id, d.lang, b.quality from documents d join labels b using (doc_id)),
n as (select *, count(*) over (partition by lang, quality) c, row_number() over (partition by lang, quality order by md5('42:' || doc_id), doc_id) r from x)
select doc_id, lang, quality from n where r <= greatest(0, round_even(c * 0.25, 0))""")
def stratified_ratio_sample(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "documents").select("doc_id", "lang").join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return S.stratified(x, ["lang", "quality"], 0.25, 42, "doc_id")


@query("""with x as (select doc_id, quality * 2 + toxic as stratum from labels), n as (select *, row_number() over (partition by stratum order by doc_id) r from x)
select doc_id, stratum from n order by r > case stratum when 0 then 5 when 1 then 5 when 2 then 10 when 3 then 10 else 0 end, stratum, r limit 40""")
def quota_with_leftover(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "labels").select("doc_id", (F.col("quality") * 2 + F.col("toxic")).alias("stratum"))
    return S.quotas(x, "stratum", {0: 5, 1: 5, 2: 10, 3: 10}, 40, F.col("doc_id"))


@query("""select doc_id, (list_sum(list_transform(string_split(md5(doc_id::varchar), ''), lambda c: strpos('0123456789abcdef', c) - 1)) % 3)::int as bucket from documents""")
def hash_bucket3(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", T.hex_digit_bucket(F.col("doc_id")).alias("bucket"))


@query("""with o as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as ord, count(*) over () n from orders)
select o_orderkey, (ord % 5)::int as stride, (ord // ((n + 4) // 5))::int as chunk from o""")
def shard_stride(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders").select("o_orderkey")
    n = orders.count()
    return S.numbered(orders, "o_orderkey").select("o_orderkey", S.stride_shard(F.col("ord"), 5).alias("stride"), S.chunk_shard(F.col("ord"), n, 5).alias("chunk"))


@query("""with d as (select item_id, row_number() over (order by md5('9:' || item_id) || ':' || item_id) - 1 as i from benchmark) select item_id, ['A', 'B', 'C', 'D'][(i % 4)::int + 1] as letter from d""")
def balanced_letters(spark: SparkSession, d: str) -> DataFrame:
    return S.balanced_letters(read(spark, d, "benchmark").select("item_id"), 9, "item_id")


@query("""with a as (select distinct c_custkey k from customer), b as (select distinct o_custkey k from orders), u as (select a.k ak, b.k bk from a full join b on a.k = b.k)
select count(ak) n_a, count(bk) n_b, count(*) n_union, count(*) filter (ak is not null and bk is not null) n_both, count(*) filter (bk is null) only_a, count(*) filter (ak is null) only_b from u""")
def set_audit(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return J.set_audit(a, read(spark, d, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("""with a as (select lang, source from documents), b as (select distinct lang, source from a), x as (select * from a except all select * from b), y as (select * from b except all select * from a)
select (select count(*) from x) + (select count(*) from y) = 0 as same_multiset, (select count(*) from (select * from a except select * from b)) = 0 as same_set""")
def multiset_equality(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "documents").select("lang", "source")
    return J.same_rows(a, a.distinct())


@query("""with u as (select o_orderkey, 0 as src, o_totalprice::double p from orders where o_orderkey % 3 <> 0 union all select o_orderkey, 1, -1.0 from orders where o_orderkey % 3 <> 1)
select o_orderkey, arg_min(p, src) as price, arg_max(p, src) as latest from u group by o_orderkey""")
def first_and_last_wins(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("price"))
    both = orders.where("o_orderkey % 3 <> 0").withColumn("src", F.lit(0)).unionByName(orders.where("o_orderkey % 3 <> 1").select("o_orderkey", F.lit(-1.0).alias("price"), F.lit(1).alias("src")))
    first = J.first_wins(both, ["o_orderkey"], F.col("src")).select("o_orderkey", "price")
    return first.join(J.last_wins(both, ["o_orderkey"], F.col("src")).select("o_orderkey", F.col("price").alias("latest")), "o_orderkey")


@query("""select n_name, lower(n_name) as relation, case when lower(left(n_name, 1)) in ('a', 'e', 'i', 'o', 'u') then 'an' else 'a' end as article,
  upper(case when lower(left(n_name, 1)) in ('a', 'e', 'i', 'o', 'u') then 'an' else 'a' end)[1] || substr(case when lower(left(n_name, 1)) in ('a', 'e', 'i', 'o', 'u') then 'an' else 'a' end, 2) || ' ' || n_name || ' is near a map.' as statement,
  'Is ' || case when lower(left(n_name, 1)) in ('a', 'e', 'i', 'o', 'u') then 'an' else 'a' end || ' ' || n_name || ' near a map?' as question from nation""")
def statements(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_name")
    told = T.statement(n, F.lit("near"), F.lit("map"))
    return read(spark, d, "nation").select("n_name", T.normal_relation(F.concat(F.lit(" \""), n, F.lit(".\" "))).alias("relation"), T.article(n).alias("article"), told.alias("statement"), T.question(told).alias("question"))


@query("""select item_id, list_transform(list_filter(range(length(text) - 1), lambda i: lower(text)[i + 1:i + 2] = 'th'), lambda i: i::int) as places from benchmark""")
def find_all_positions(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select("item_id", T.positions(F.col("text"), F.lit("th")).alias("places"))


@query("""select p_partkey, case when (length(lower(p_name)) - length(replace(lower(p_name), 'a', ''))) = 1 then regexp_replace(p_name, 'a', '#', 'i') end as replaced from part""")
def replace_once(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", T.replaced_once(F.col("p_name"), F.lit("a"), F.lit("#")).alias("replaced"))


@query("""with f as (select page_id, html, regexp_extract(url, '[^/]*$') as base from pages) select page_id, base, regexp_replace(base, '\\.[^.]*$', '') as stem, sha256(html) as digest from f""")
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    return read(spark, d, "pages").select("page_id", T.basename(url).alias("base"), T.path_stem(url).alias("stem"), F.sha2("html", 256).alias("digest"))


@query("""select page_id, json_extract_string(j, '$.id')::bigint as id, json_extract_string(j, '$.name') as name from (select page_id, '{"id": ' || page_id || ', "name": "p' || page_id || '"}' as j from pages)""")
def json_props_repair(spark: SparkSession, d: str) -> DataFrame:
    raw = F.format_string('{"id": %d, "name": "p%d"}', "page_id", "page_id")
    noisy = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<think>{</think>```json\n"), raw, F.lit("\n```"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("It is "), raw, F.lit("."))).otherwise(raw)
    found = F.from_json(T.json_object(noisy), "id bigint, name string")
    return read(spark, d, "pages").select("page_id", found.alias("j")).select("page_id", "j.id", "j.name")


@query("""select p_partkey, case when p_size > 45 then 'low_confidence' when p_name = '' then 'empty_field' when length(p_name) > 30 then 'bad_length' else 'ok' end as status,
  list_filter([case when p_size > 45 then 'low_confidence' end, case when length(p_name) > 30 then 'bad_length' end], lambda x: x is not null) as reasons from part""")
def status_cascade(spark: SparkSession, d: str) -> DataFrame:
    rules = [("low_confidence", F.col("p_size") > 45), ("empty_field", F.col("p_name") == ""), ("bad_length", F.length("p_name") > 30)]
    return read(spark, d, "part").select("p_partkey", R.cascade(rules).alias("status"), R.reasons([rules[0], rules[2]]).alias("reasons"))


@query("""with own as (select lang, round(avg(n_chars), 1) v from documents group by lang), pub as (select lang, round(avg(n_chars), 1) + case when lang = 'en' then 5 else 0.01 end v from documents group by lang)
select lang, own.v::double as own, pub.v::double as published, abs(own.v - pub.v) <= 0.05 as "within" from own join pub using (lang)""")
def reconcile_tolerance(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "documents").groupBy("lang").agg(F.round(F.avg("n_chars"), 1).alias("v"))
    return M.reconciled(own, own.withColumn("v", F.col("v") + F.when(F.col("lang") == "en", 5.0).otherwise(0.01)), ["lang"], "v", 0.05)


@query(f"""{LOGS} select lang, case when inv > 0.10 then 'too_many_invalid' when yes > 0.95 or yes < 0.05 then 'degenerate' else 'ok' end as decision from (
  select lang, avg((answer = '')::int) inv, avg(a::int) yes from p group by lang)""")
def decision_case(spark: SparkSession, d: str) -> DataFrame:
    x = logs(spark, d).groupBy("lang").agg(F.avg((~A.answered(F.col("answer"))).cast("int")).alias("inv"), F.avg(A.pred_yes(F.col("answer")).cast("int")).alias("yes"))
    return x.select("lang", R.validity(F.col("inv"), F.col("yes")).alias("decision"))


MEASURES = f"""{LOGS}, k as (
  select *, case when n_chars % 7 = 0 then null when n_chars % 3 = 0 then 'no' else 'yes' end as x, case when doc_id % 40 = 0 then 'no' else 'yes' end as y,
         case when doc_id % 7 >= n_chars % 5 then 'yes' else 'no' end as z from p
)"""
MEASURE = "struct_pack(n := count(*), valid := count({0}), invalid_share := 1 - count({0}) / count(*), yes_ratio := avg(({0} = 'yes')::int), one_answer := greatest(avg(({0} = 'yes')::int), avg(({0} = 'no')::int)))"


@query(f"""{MEASURES}, m as (select lang, {MEASURE.format("x")} as main, {MEASURE.format("y")} as fb, {MEASURE.format("z")} as lp from k group by lang),
t as (select *, main.invalid_share > 0.10 as second, case when main.invalid_share > 0.10 then fb else main end as w from m),
u as (select lang, case when w.one_answer > 0.95 then 'logprob' when second then 'fallback' else 'main' end as used, case when w.one_answer > 0.95 then lp else w end as c from t)
select lang, used, c.one_answer > 0.95 or (used = 'logprob' and c.one_answer >= 0.90) or (used <> 'logprob' and c.invalid_share > 0.10) as failed,
       c.n as n, c.valid as valid, c.invalid_share as invalid_share, c.yes_ratio as yes_ratio, c.one_answer as one_answer from u""")
def chosen_measurement(spark: SparkSession, d: str) -> DataFrame:
    """AG-23, FL-29, SF-29."""
    x = F.when(F.col("n_chars") % 7 == 0, None).when(F.col("n_chars") % 3 == 0, "no").otherwise("yes")
    y = F.when(F.col("doc_id") % 40 == 0, "no").otherwise("yes")
    return D.chosen_measurement(logs(spark, d), x, y, D.likelier(F.col("doc_id") % 7, F.col("n_chars") % 5), "lang")


@query(f"""{LOGS}, v as (select lang, avg((a = gold)::int) v1, avg((b = gold)::int) v2, avg(gold::int) v3 from p group by lang)
select lang, case when (v2 > v1 + 0.03 or v3 > v1 + 0.03) and v3 > v2 + 0.02 then 'Go B' when v2 > v1 + 0.03 or v3 > v1 + 0.03 then 'Go A'
                  when abs(v2 - v1) < 0.02 and abs(v3 - v1) < 0.02 then 'No-Go B' else 'No-Go A candidate' end as heldout,
       case when least(e, t) >= 0.08 or (greatest(e, t) >= 0.10 and least(e, t) >= 0.04) then 'A'
            when (e >= 0.08) <> (t >= 0.08) and abs(e - t) >= 0.08 then 'C' when abs(e) < 0.04 and abs(t) < 0.04 then 'B'
            when (e > 0.05 and t < 0.02) or (t > 0.05 and e < 0.02) then 'C' when e >= 0.05 and t >= 0.05 then 'A' else 'B' end as adaptation
from (select *, v2 - v1 as e, v3 - v1 as t from v)""")
def verdicts(spark: SparkSession, d: str) -> DataFrame:
    """AG-24."""
    right = lambda c: F.avg((c == F.col("gold")).cast("int"))
    v = logs(spark, d).groupBy("lang").agg(right(A.pred_yes(F.col("answer"))).alias("v1"), right(A.pred_yes(F.col("other"))).alias("v2"), F.avg(F.col("gold").cast("int")).alias("v3"))
    first, second, third = F.col("v1"), F.col("v2"), F.col("v3")
    return v.select("lang", D.heldout_verdict(first, second, third).alias("heldout"), D.adaptation_verdict(second - first, third - first).alias("adaptation"))


JUDGED = f"""{LOGS}, j as (select *, case n_chars % 4 when 0 then 'implausible' when 1 then 'parse_error' when 2 then null else 'plausible' end as judgment from p)"""


def judged(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_chars") % 4
    return logs(spark, d).withColumn("judgment", F.when(k == 0, "implausible").when(k == 1, "parse_error").when(k == 3, "plausible"))


@query(f"""{JUDGED} select lang, count(*) n, avg(coalesce(judgment = 'plausible', false)::int) plausible_rate, avg(coalesce(judgment = 'implausible', false)::int) implausible_rate,
  avg(coalesce(judgment = 'parse_error', false)::int) parse_error_rate, avg(coalesce(judgment = case when toxic then 'implausible' else 'plausible' end, false)::int) accuracy from j group by lang""")
def judgment_rates(spark: SparkSession, d: str) -> DataFrame:
    """AG-18."""
    return D.judgment_rates(judged(spark, d), "lang", "judgment", F.col("toxic"))


@query(f"""{JUDGED} select 2 * count(*) as n, avg(coalesce(x.judgment = 'implausible', false)::int + coalesce(y.judgment = 'plausible', false)::int) / 2 as accuracy
  from j x join j y on y.doc_id = x.doc_id + 1 where x.toxic and not y.toxic""")
def paired_judgments(spark: SparkSession, d: str) -> DataFrame:
    """AG-18: each toxic document with the next one, if that isn't toxic."""
    x = judged(spark, d)
    return D.paired_accuracy(x.where(~F.col("toxic")).withColumn("doc_id", F.col("doc_id") - 1), x.where("toxic"), "doc_id", "judgment")


@query(f"""{LOGS}, c as (select lang, gold, case when n_chars % 5 > 0 then a end as u, case when n_chars % 7 > 0 then b end as v from p)
select *, n < 100 as low_power from (select lang, count(*) filter (u is not null and v is not null) n, count(*) filter (u is null or v is null) missing,
  avg((u = gold)::int) filter (v is not null) accuracy_a, avg((v = gold)::int) filter (u is not null) accuracy_b,
  count(*) filter (u = gold and v <> gold) only_a, count(*) filter (u <> gold and v = gold) only_b from c group by lang)""")
def run_contrast(spark: SparkSession, d: str) -> DataFrame:
    """UD-05."""
    u, v = F.when(F.col("n_chars") % 5 > 0, A.pred_yes(F.col("answer"))), F.when(F.col("n_chars") % 7 > 0, A.pred_yes(F.col("other")))
    return D.contrast(logs(spark, d), u, v, F.col("gold"), "lang")


@query(f"""{LOGS} select lang, max(acc) filter (bench = 'b0') b0, max(acc) filter (bench = 'b1') b1 from (
  select lang, 'b' || doc_id % 2 as bench, avg((a = gold)::int) acc from p group by all) group by lang""")
def metric_matrix(spark: SparkSession, d: str) -> DataFrame:
    """PR-16."""
    x = logs(spark, d).withColumn("bench", F.concat(F.lit("b"), F.col("doc_id") % 2))
    return D.metric_matrix(x, "lang", "bench", ["b0", "b1"], A.pred_yes(F.col("answer")), F.col("gold"))


@query("""with t as (select c_nationkey as subject, o_orderstatus as object, o_orderpriority as predicate, count(*) n from orders join customer on o_custkey = c_custkey group by all)
select * from t qualify n = max(n) over (partition by subject, object)""")
def usual_predicates(spark: SparkSession, d: str) -> DataFrame:
    """AG-13."""
    x = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return M.usual_predicates(x.select(F.col("c_nationkey").alias("subject"), F.col("o_orderstatus").alias("object"), F.col("o_orderpriority").alias("predicate")))


@query(f"""{LOGS} select doc_id::varchar as qid, case when n_chars % 3 = 0 then b else a end as pred from p""")
def answer_predictions(spark: SparkSession, d: str) -> DataFrame:
    """PR-15: where a question has a second answer, that counts; ids are text with leading zeros in one of the logs."""
    x = logs(spark, d)
    first = x.select(F.col("doc_id").cast("string").alias("question_id"), F.col("answer").alias("text"), F.lit(None).cast("string").alias("response"), F.lit(0).alias("ord"))
    second = x.where("n_chars % 3 = 0").select(F.concat(F.lit("00"), "doc_id").alias("question_id"), F.lit("").alias("text"), F.col("other").alias("response"), F.lit(1).alias("ord"))
    return P.answer_predictions(first.unionByName(second), "ord")


@query("""select o_orderkey, o_totalprice, l_linenumber as negative_l_linenumber, l_quantity as negative_rank, 'no' as negative_judgment from lineitem join orders on l_orderkey = o_orderkey
where l_linenumber % 2 = 0 qualify row_number() over (partition by o_orderkey order by l_quantity, l_linenumber) = 1""")
def first_negatives_joined(spark: SparkSession, d: str) -> DataFrame:
    """JN-16."""
    x = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.col("l_quantity").alias("rank"), F.when(F.col("l_linenumber") % 2 == 0, "no").otherwise("yes").alias("judgment"))
    return J.first_negatives_of(x, read(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", "judgment", "rank", "l_linenumber")


@query("""select p_partkey, p_size, row_number() over (order by p_size desc, p_partkey::varchar) - 1 as ordinal,
  case when ordinal < 20 then 20 when ordinal < 50 then 50 else 120 end as smallest from part qualify ordinal < 120""")
def nested_samples(spark: SparkSession, d: str) -> DataFrame:
    """SA-01 to SA-03: samples of 20, 50 and 120 parts, each within the next."""
    x = read(spark, d, "part").select("p_partkey", "p_size")
    return S.nested_samples(x, [20, 50, 120], F.desc("p_size"), F.col("p_partkey").cast("string"))


@query("""select p_partkey from part where p_retailprice >= 950 and p_size <= 20 order by p_retailprice desc, p_partkey limit 3""")
def free_resources(spark: SparkSession, d: str) -> DataFrame:
    """FL-30."""
    return S.free_resources(read(spark, d, "part"), "p_retailprice", "p_size", 950, 20, 3, "p_partkey").select("p_partkey")


# The other modules register their queries when they are imported.
from relcheck.plans import captions as captions  # noqa: E402
from relcheck.plans import relations as relations  # noqa: E402
from relcheck.plans import selections as selections  # noqa: E402
from relcheck.plans import tables as tables  # noqa: E402
from relcheck.plans import texts as texts  # noqa: E402
