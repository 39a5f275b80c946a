"""Sharding: balanced label propagation under capacity quotas, then exact evening out of the row counts.

Documents with one link key (equal texts, unless told otherwise) are linked. They start in shards drawn by a hash. In each
round a Spark join tells every linked document how many of its neighbours are in each shard; it wants to the fullest of
those with room, if that is fuller than its own. If more want to a shard than it has room for, a hash admits the part
that fits: whole groups of links together, unless a group is too large for one shard. Documents without links then fill
the shards up, and what a shard has over its share (unlinked ones first) goes where rows are missing, so that the counts
are at most one apart.

Nothing is gathered per shard or per group: counts are partial aggregates, and a row's gapless slot is its rank within
a bucket of hashes plus the counts of the buckets before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relcheck.llm.common import saved, table

ROUNDS = 6
#: Rows in a bucket of hashes, on average, when ranks are counted.
BUCKET_ROWS = 4096


def unit(*cols: Column) -> Column:
    """A number in [0, 1) by hash."""
    return F.pmod(F.xxhash64(F.lit(11), *cols), F.lit(1 << 40)) / F.lit(float(1 << 40))


def counts_by_shard(df: DataFrame, col: str, n_shards: int) -> list[int]:
    found = {r[0]: r[1] for r in df.groupBy(col).count().collect()}
    return [found.get(s, 0) for s in range(n_shards)]


def propagated(linked: DataFrame, n_rows: int, n_shards: int, rounds: int) -> DataFrame:
    """linked (_g, _u, shard, ...) after the rounds; every round's labels are saved."""
    room_of = n_rows // n_shards
    for turn in range(rounds):
        load = counts_by_shard(linked, "shard", n_shards)
        room = [max(0, room_of - x) for x in load]
        here = F.array(*[F.sum((F.col("shard") == s).cast("bigint")) for s in range(n_shards)])
        groups = linked.groupBy(F.col("_g").alias("_g2")).agg(here.alias("_here"), F.count(F.lit(1)).alias("_all"))
        best = F.array_max(F.array(*[F.struct(F.when(F.lit(room[s] > 0), F.get("_here", F.lit(s))).otherwise(-1).alias("n"), F.lit(-s).alias("s")) for s in range(n_shards)]))
        groups = groups.select("*", best.alias("_best")).where(F.col("_all") > F.array_max("_here"))
        target, fuller = (-F.col("_best.s")).cast("int"), F.col("_best.n")
        own = F.get("_here", F.col("shard"))
        wants = F.coalesce((fuller > own) | ((fuller == own) & (target < F.col("shard"))), F.lit(False)) & F.coalesce(F.col("shard") != target, F.lit(False))
        asked = linked.join(groups, linked["_g"].eqNullSafe(groups["_g2"]), "left").select(
            *linked.columns, F.when(wants, target).alias("_to"), F.when(F.col("_all") * 16 <= room_of, unit(F.col("_g"), F.lit(turn))).otherwise(F.col("_u")).alias("_draw")
        )
        asked = saved(asked)
        moves = counts_by_shard(asked.where("_to is not null"), "_to", n_shards)
        if not sum(moves):
            break
        share = F.get(F.array(*[F.lit(min(1.0, room[s] / moves[s]) if moves[s] else 0.0) for s in range(n_shards)]), F.col("_to"))
        linked = asked.withColumn("shard", F.when(F.col("_draw") < share, F.col("_to")).otherwise(F.col("shard"))).select(*linked.columns)
    return linked


def ranked(df: DataFrame, n_rows: int) -> DataFrame:
    """df with `_rank`, gapless from 0 in each shard, by (_late, _u): a rank in a bucket plus the buckets before."""
    buckets = max(1, n_rows // BUCKET_ROWS)
    df = df.withColumn("_b", F.floor(F.col("_u") * buckets))
    key = ["shard", "_late", "_b"]
    before = Window.partitionBy("shard").orderBy("_late", "_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_c")).withColumn("_start", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    within = F.row_number().over(Window.partitionBy(*key).orderBy("_u", "_id", "_a"))
    return df.withColumn("_in", within).join(starts, key).withColumn("_rank", F.col("_in") + F.col("_start") - 1)


def shard_documents(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", link: list[Column] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """id, size, text_crc32, shard, slot of every row of docs; shards' row counts are at most one apart.

    link: columns that linked documents have in common; by default equal texts. Null text: size 1 and crc32 of ''; null
    texts and empty ones are linked. Null ids and repeated rows are rows like others (repeated rows are linked, each has
    a slot of its own). Fewer rows than shards leave shards empty. Other columns of docs aren't returned.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    group = F.struct(*(link or [F.xxhash64(text), F.xxhash64(F.lit(7), text)]))
    base = docs.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(text) + 1).cast("bigint").alias("_size"),
        F.crc32(text).alias("_crc"),
        F.xxhash64(F.to_json(group)).alias("_a"),
        F.to_json(group).alias("_g"),
    )
    base = base.withColumn("_u", unit(F.col("_id"), F.col("_a")))
    base = saved(base.withColumn("shard", F.floor(F.col("_u") * n_shards).cast("int")))
    n = base.count()
    groups = saved(base.groupBy(F.col("_g").alias("_g2")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_g2"))
    tie = F.col("_g").eqNullSafe(F.col("_g2"))
    flagged = saved(base.join(groups, tie, "left").withColumn("_late", F.col("_g2").isNull().cast("int")).drop("_g2"))
    linked = saved(propagated(flagged.where("_late = 0"), n, n_shards, rounds))
    due = [n // n_shards + (s < n % n_shards) for s in range(n_shards)]
    load = counts_by_shard(linked, "shard", n_shards)
    rest, cut, ends = [max(0, d - x) for d, x in zip(due, load, strict=True)], 0.0, []
    for x in rest:
        cut += x / max(1, sum(rest))
        ends.append(cut)
    filled = F.lit(n_shards - 1)
    for s in reversed(range(n_shards - 1)):
        filled = F.when(unit(F.col("_u"), F.lit(3)) < ends[s], F.lit(s)).otherwise(filled)
    every = saved(linked.unionByName(flagged.where("_late = 1").withColumn("shard", filled.cast("int"))))
    have = counts_by_shard(every, "shard", n_shards)
    over, under, o, u = [], [], 0, 0
    for s in range(n_shards):
        over.append(o)
        o += max(0, have[s] - due[s])
        under.append(u)
        u += max(0, due[s] - have[s])
    numbers = lambda xs: F.array(*[F.lit(x).cast("bigint") for x in xs])
    out = ranked(every, n)
    spare = F.col("_rank") - F.get(numbers(due), F.col("shard")) + F.get(numbers(over), F.col("shard"))
    to = F.lit(0)
    for s in range(1, n_shards):
        if due[s] > have[s]:
            to = F.when(spare >= under[s], F.lit(s)).otherwise(to)
    first = next((s for s in range(n_shards) if due[s] > have[s]), 0)
    to = F.when(spare < F.lit(under[first] + max(0, due[first] - have[first])), F.lit(first)).otherwise(to)
    is_spare = F.col("_rank") >= F.get(numbers(due), F.col("shard"))
    shard = F.when(is_spare, to).otherwise(F.col("shard")).cast("int")
    slot = F.when(is_spare, spare - F.get(numbers(under), to) + F.get(numbers(have), to)).otherwise(F.col("_rank")).cast("bigint")
    return out.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), shard.alias("shard"), slot.alias("slot"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
