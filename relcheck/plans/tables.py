"""Queries of joins, tallies, samples and readers on the driver's tables, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relcheck.functions import answers as A
from relcheck.functions import text as T
from relcheck.operators import joins as J
from relcheck.operators import metrics as M
from relcheck.operators import sampling as S
from relcheck.operators import shapes as P
from relcheck.plans.registry import query, read
from relcheck.plans.texts import words
from relcheck.sources import records
from relcheck.tables import workspace


@query("select c_custkey, c_mktsegment, o_orderkey, o_orderkey is null as missing from customer left join orders on c_custkey = o_custkey")
def questions_with_answers(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return J.answered_questions(read(spark, d, "customer").select("c_custkey", "c_mktsegment"), orders, "c_custkey")


@query("""select l.doc_id, l.quality, a.n_chars % 2 = 0 as pred_a, b.n_chars % 3 = 0 as pred_b from labels l
join documents a on a.doc_id = l.doc_id and a.n_chars > 300 join documents b on b.doc_id = l.doc_id and b.source <> 'src0'""")
def paired_runs(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    first = docs.where("n_chars > 300").select("doc_id", (F.col("n_chars") % 2 == 0).alias("pred"))
    second = docs.where("source <> 'src0'").select("doc_id", (F.col("n_chars") % 3 == 0).alias("pred"))
    return J.paired(read(spark, d, "labels").select("doc_id", "quality"), first, second, "doc_id")


@query("select s_suppkey, n_nationkey, n_name from supplier join nation on s_nationkey = n_nationkey")
def supplier_nations(spark: SparkSession, d: str) -> DataFrame:
    nations = read(spark, d, "nation").select("n_nationkey", "n_name")
    return J.strict_lookup(read(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey")), nations, "n_nationkey").select("s_suppkey", "n_nationkey", "n_name")


@query("""select count(*) filter (l.doc_id is null) as missing, count(*) filter (l.doc_id is not null and nullif(quality, toxic) is null) as invalid,
  count(*) filter (nullif(quality, toxic) is not null) as compared, count(*) filter (coalesce(nullif(quality, toxic) = (n_chars % 2)::int, false)) as agreeing
from documents d left join labels l using (doc_id)""")
def label_agreement(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "documents").select("doc_id", (F.col("n_chars") % 2).cast("int").alias("v"))
    return J.agreement(own, read(spark, d, "labels").select("doc_id", F.nullif("quality", "toxic").cast("int").alias("v")), "doc_id", "v")


@query("select o_orderstatus, coalesce(nullif(o_orderpriority, '5-LOW'), 'missing') as o_orderpriority, count(*) as n from orders group by all")
def status_tally(spark: SparkSession, d: str) -> DataFrame:
    return M.tally(read(spark, d, "orders").withColumn("o_orderpriority", F.nullif("o_orderpriority", F.lit("5-LOW"))), "o_orderstatus", "o_orderpriority")


@query("select l_partkey, l_suppkey, array_to_string(list_sort(list(distinct l_returnflag)), ',') as flags from lineitem group by all")
def flags_of_pairs(spark: SparkSession, d: str) -> DataFrame:
    return M.collected(read(spark, d, "lineitem"), ["l_partkey", "l_suppkey"], "l_returnflag").select("l_partkey", "l_suppkey", F.array_join("values", ",").alias("flags"))


@query("select doc_id, lang from documents order by md5('5:' || doc_id), doc_id limit 100")
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    return S.sample(read(spark, d, "documents").select("doc_id", "lang"), 5, "doc_id", 100)


@query("select lang, source, v, row_number() over (partition by lang order by coalesce(v, -1) desc, source) as rank from (select lang, source, sum(n_chars)::double as v from documents group by all)")
def ranked_sources(spark: SparkSession, d: str) -> DataFrame:
    sums = read(spark, d, "documents").groupBy("lang", "source").agg(F.sum("n_chars").cast("double").alias("v"))
    return M.ranked_models(sums, "lang", "source", "v").withColumn("rank", F.col("rank").cast("bigint"))


@query("select distinct t as term from (select p_type as t from part union all select p_brand from part) where t <> ''")
def relation_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return P.vocabulary_of(read(spark, d, "part"), "p_type", "p_brand")


@query("""with w as (select distinct unnest(regexp_extract_all(text, '[A-Za-z]+')) as word from documents)
select word, lower(word) not in ('no', 'false', '0', 'n') as gold, contains(lower(word), 'no') as no_within, case when lower(word) in ('true', 'yes', '1') then true when lower(word) in ('false', 'no', '0') then false end as loose,
  lower(word) in ('no', 'n') as refused from w""")
def gold_readings(spark: SparkSession, d: str) -> DataFrame:
    """FL-02, FL-03, FL-11 and FL-04 on the words of documents."""
    w = F.col("word")
    return words(read(spark, d, "documents")).select("word", A.gold_yes(w).alias("gold"), A.gold_no_within(w).alias("no_within"), A.loose_boolean(w).alias("loose"), (A.yes_no_uncertain(w) == "no").alias("refused"))


#: Words of the documents' languages that become placeholders.
NAMED = ["the", "la", "die", "le", "of"]


def _named_sql(text: str) -> str:
    for w in NAMED:
        text = f"replace({text}, ' {w} ', ' {{{w}}} ')"
    return text


@query(f"""with c as (select doc_id, {_named_sql("text")} as t from documents where text is not null)
select doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(t, '\\{{[^{{}}]+\\}}'))), ' ') as named, md5(replace(replace(replace(t, '{{the}}', 'A cat'), '{{die}}', 'Hund'), '{{la}}', '')) as filled from c""")
def placeholders_filled(spark: SparkSession, d: str) -> DataFrame:
    caption = F.col("text")
    for w in NAMED:
        caption = F.replace(caption, F.lit(f" {w} "), F.lit(f" {{{w}}} "))
    mapping = F.create_map(*[F.lit(x) for x in ("{the}", "A cat", "{die}", "Hund", "{la}", "")])
    docs = read(spark, d, "documents").where("text is not null").select("doc_id", caption.alias("c"))
    return docs.select("doc_id", F.array_join(F.sort_array(T.placeholders(F.col("c"))), " ").alias("named"), F.md5(T.substituted(F.col("c"), mapping)).alias("filled"))


@query("""with w as (select doc_id, string_split(text, ' ') as ws from documents where text is not null),
e as (select doc_id, ws, unnest(range(len(ws))) as i from w)
select doc_id, count(*) as n, count(distinct ws[i + 1]) as subjects, count(distinct (ws[i + 1], ws[i + 3])) as pairs, sum(i + 1)::bigint as predicates from e where i + 2 < len(ws) group by doc_id""")
def word_graph(spark: SparkSession, d: str) -> DataFrame:
    """PR-11: each word and the second one after it as an edge; edges that lead out of the text go."""
    docs = read(spark, d, "documents").where("text is not null").groupBy("doc_id").agg(F.collect_list("text").alias("texts"))

    def triplets(text: Column) -> Column:
        edges = lambda ws: F.transform(F.sequence(F.lit(0), F.size(ws) - 1), lambda i: F.array(i, i + 2, i + 1))
        return T.let(F.split(text, " "), lambda ws: P.triplet_list(ws, edges(ws)))

    graphs = docs.select("doc_id", F.flatten(F.transform("texts", triplets)).alias("e")).where(F.size("e") > 0)
    # Counted within each document: texts are shuffled once, edges never. Words have no space, so a pair is told by its text.
    pairs = F.transform("e", lambda x: F.concat(x["subject"], F.lit(" "), x["object"]))
    total = F.aggregate("e", F.lit(0).cast("bigint"), lambda s, x: s + x["predicate"])
    return graphs.select("doc_id", F.size("e").cast("bigint").alias("n"), F.size(F.array_distinct("e.subject")).cast("bigint").alias("subjects"), F.size(F.array_distinct(pairs)).cast("bigint").alias("pairs"), total.alias("predicates"))


@query("select source, count(*) as n, 0::bigint as first, count(*) - 1 as last, count(*) as places, sum(doc_id)::bigint as ids from documents where source is not null group by source")
def json_lines_ordinals(spark: SparkSession, d: str) -> DataFrame:
    """SC-01, SC-12: documents written as JSON lines, a file for each source, and read with their line numbers."""
    path = f"{workspace(spark)}/lines-{uuid.uuid4().hex}"
    read(spark, d, "documents").where("source is not null").select("doc_id", "text", F.col("source").alias("s"), F.col("source").alias("folder")).repartition("folder").write.partitionBy("folder").json(path)
    lines = records.json_lines(spark, f"{path}/*/*.json", "doc_id long, s string")
    return lines.groupBy(F.col("s").alias("source"), "file").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"), F.max("ord").alias("last"), F.count_distinct("ord").alias("places"), F.sum("doc_id").alias("ids")).drop("file")
