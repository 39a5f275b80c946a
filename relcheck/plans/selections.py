"""Queries of selections, ranks and statistics that need several rounds, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relcheck.operators import selection
from relcheck.plans.registry import query, read


def greedy_sql(name: str, source: str, used: str, groups: str, cap: int, limit: str) -> str:
    """A sequential pass over source (k from 1, id, g, l, r): lists of what is used and taken, a row for each step."""
    fits = f"not list_contains(c.used, s.l) and not list_contains(c.used, s.r) and len(list_filter(c.gs, lambda x: x = s.g)) < {cap} and len(c.ids) < {limit}"
    return f"""{name}(k, used, gs, ids) as (
  select 0::bigint, ({used})::bigint[], ({groups})::varchar[], []::bigint[]
  union all
  select s.k, case when {fits} then list_concat(c.used, [s.l, s.r]) else c.used end, case when {fits} then list_append(c.gs, s.g) else c.gs end,
    case when {fits} then list_append(c.ids, s.id) else c.ids end
  from {name} c join {source} s on s.k = c.k + 1
), {name}_end as (select * from {name} order by k desc limit 1)"""


@query(f"""with recursive one as (
  select o_custkey as l, min_by(o_orderkey, (md5('3:' || o_orderkey), o_orderkey)) as id from orders group by o_custkey
), pool as (
  select one.*, o_orderpriority as g, (id * 7) % 1500 as r, md5('4:' || id) as d, row_number() over (partition by o_orderpriority order by md5('4:' || id), id) as turn,
    count(*) over (partition by o_orderpriority) as n from one join orders on o_orderkey = id
), s1 as (select *, row_number() over (order by n, g, d, id) as k from pool where n >= 10),
s2 as (select *, row_number() over (order by turn, n, g) as k from pool),
s3 as (select *, row_number() over (order by d, id) as k from pool),
{greedy_sql("h", "s1", "[]", "[]", 1, "1e9")},
{greedy_sql("t", "s2", "select used from h_end", "[]", 30, "300")},
{greedy_sql("f", "s3", "select used from t_end", "select gs from h_end", 4, "40 - (select len(ids) from h_end)")},
picked as (select unnest(ids) as id, 'train' as split from t_end union all select unnest(ids), 'heldout' from h_end union all select unnest(ids), 'heldout' from f_end)
select split, id as o_orderkey, l as image, r as other_image, g as o_orderpriority from picked join pool using (id)""")
def image_disjoint_split(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.col("o_custkey").alias("image"), ((F.col("o_orderkey") * 7) % 1500).alias("other_image"))
    return selection.image_split(rows, "o_orderpriority", "image", "other_image", "o_orderkey", 300, 40, 3).drop("place")
