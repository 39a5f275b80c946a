"""Prefix trie of conversations, merged family by family.

Conversations of one base id (c - c mod 20) are a family: each is rebuilt from the first turns of the base and its own
later turns. A node of the trie, a sequence of turns, is named by its depth and 128 bits: the xor of hashes of (place,
role, text) over its turns, which is a running total and so can be taken in pieces of a conversation of any length.

Families come first: base turns and members meet by base id, and a family's conversations become its small trie, one row
for each of its nodes with the numbers of its members. Only these combined rows are shuffled by node and merged.

A node belongs to its smallest member. Along a conversation, from some depth on all nodes are its own, so the trie falls
apart into one tail of each conversation. What a subtree holds is then the sum, over its conversations, of what the tails
hold below its top: running totals within tails, and for the nodes above a tail its whole total. That takes one row for
each turn of a conversation, however deep the trie is, and no rounds. Totals are combined family by family again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relcheck.llm.common import saved, table
from relcheck.llm.curriculum import n_words
from relcheck.operators.ranges import in_ranges

FAMILY = 20
#: A conversation borrows fewer turns than this from its base.
BORROWED = 4
#: Conversation ids that are joined to one text before they are hashed.
TOGETHER = 512
NODE = ["depth", "a", "b"]


def base_of(conv: Column) -> Column:
    return conv - F.pmod(conv, F.lit(FAMILY))


def borrowed_turns(conv: Column) -> Column:
    """How many turns a conversation takes from its base: the CRC of its decimal id modulo BORROWED."""
    return F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(BORROWED))


def rebuilt(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """family, conv, depth (0: the root, in every conversation), x, y (hashes of the turn at that place), words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turns = conversations.select(
        F.col(conv_col).cast("bigint").alias("conv"),
        F.col(turn_col).alias("turn"),
        F.xxhash64(F.lit(1), role, text).alias("x"),
        F.xxhash64(F.lit(2), role, text).alias("y"),
        n_words(text).alias("words"),
    ).where("conv is not null")
    turns = saved(in_ranges(turns, [F.col("conv")], [F.col("turn").asc_nulls_first(), F.col("x"), F.col("y")], rank="place").drop("turn"))
    # The cogroup: members and the base's first turns, by family. A family has at most FAMILY members and BORROWED - 1 turns.
    first = turns.where((base_of(F.col("conv")) == F.col("conv")) & (F.col("place") < BORROWED)).groupBy(F.col("conv").alias("base"))
    first = first.agg(F.sort_array(F.collect_list(F.struct("place", "x", "y", "words"))).alias("turns"))
    members = turns.select("conv").distinct().select(base_of(F.col("conv")).alias("family"), "conv", borrowed_turns(F.col("conv")).cast("int").alias("h"))
    taken = F.coalesce(F.slice("turns", 1, F.col("h")), F.array().cast("array<struct<place:bigint,x:bigint,y:bigint,words:bigint>>"))
    members = members.join(first, F.col("family") == F.col("base"), "left").select("family", "conv", "h", F.when(F.col("h") > 0, taken).alias("taken"))
    members = saved(members.withColumn("taken", F.coalesce("taken", F.array().cast("array<struct<place:bigint,x:bigint,y:bigint,words:bigint>>"))))
    root = F.array(F.struct(F.lit(0).cast("bigint").alias("place"), F.lit(0).cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("y"), F.lit(0).cast("bigint").alias("words")))
    start = members.select("family", "conv", F.explode(F.concat(root, "taken")).alias("t")).select("family", "conv", F.col("t.place").alias("depth"), "t.x", "t.y", "t.words")
    known = members.select(F.col("conv").alias("conv2"), "family", "h", F.size("taken").alias("n"))
    own = turns.join(known, F.col("conv") == F.col("conv2")).where(F.col("place") > F.col("h"))
    return start.unionByName(own.select("family", "conv", (F.col("place") - F.col("h") + F.col("n")).alias("depth"), "x", "y", "words"))


def ends_digests(ends: DataFrame) -> DataFrame:
    """NODE and the SHA-256 of the conversation ids (conv) of each node, ascending, comma-joined.

    Ids are ranked in ranges, joined to texts of TOGETHER ids, and only nodes with more ids than that have their texts
    hashed one after the other, in the order Spark sorts them, with nothing held but the hash's state."""
    node = [F.col(c) for c in NODE]
    ranked = in_ranges(ends, node, [F.col("conv")], rank="n", size="all")
    part = F.floor((F.col("n") - 1) / TOGETHER)
    texts = ranked.groupBy(*NODE, part.alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"), F.max("all").alias("all"))
    texts = saved(texts)
    small = texts.where(F.col("all") <= TOGETHER).select(*NODE, F.sha2("ids", 256).alias("ends_sha256"))
    large = texts.where(F.col("all") > TOGETHER).select(*NODE, "part", "ids").repartition(*NODE).sortWithinPartitions(*NODE, "part")
    return small.unionByName(large.mapInPandas(hashed_in_turn, "depth long, a long, b long, ends_sha256 string"))


def hashed_in_turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    node, state = None, None
    for pdf in batches:
        done = []
        for depth, a, b, ids in zip(pdf["depth"], pdf["a"], pdf["b"], pdf["ids"], strict=True):
            if (depth, a, b) != node:
                if node:
                    done.append((*node, state.hexdigest()))
                node, state = (depth, a, b), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pd.DataFrame(done, columns=["depth", "a", "b", "ends_sha256"])
    if node:
        yield pd.DataFrame([(*node, state.hexdigest())], columns=["depth", "a", "b", "ends_sha256"])


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null roles and texts are empty ones; a null turn stands first; turns with one number are ordered by hash. Rows with a
    null conv_id belong to no conversation and count nowhere. Repeated rows are repeated turns. An empty table has no
    nodes, not even a root. Other columns aren't used, whatever their names.
    """
    placed = rebuilt(conversations, conv_col, turn_col, role_col, text_col)
    mark = lambda c, k: F.when(F.col("depth") == 0, F.lit(0)).otherwise(F.xxhash64(F.lit(k), "depth", c))
    placed = placed.select("family", "conv", "depth", "words", mark("x", 1).alias("x"), mark("y", 2).alias("y"))
    paths = in_ranges(placed, [F.col("conv")], [F.col("depth")], size="turns", totals={"a": F.col("x"), "b": F.col("y")}, how="xor")
    paths = saved(paths.withColumns({"pa": F.col("a").bitwiseXOR(F.col("x")), "pb": F.col("b").bitwiseXOR(F.col("y"))}).drop("x", "y"))

    # Each family's trie, then the families' nodes merged.
    facts = [F.sum("n").alias("n"), F.min("conv").alias("conv"), F.first("words").alias("words"), F.first("pa").alias("pa"), F.first("pb").alias("pb")]
    families = paths.withColumn("n", F.lit(1).cast("bigint")).groupBy("family", *NODE).agg(*facts)
    nodes = saved(families.groupBy(*NODE).agg(*facts))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("d2"), F.col("pa").alias("a2"), F.col("pb").alias("b2")).agg(F.count(F.lit(1)).alias("children"))
    here = lambda x: (F.col("depth") == x["d2"]) & (F.col("a") == x["a2"]) & (F.col("b") == x["b2"])
    nodes = nodes.join(children, here(children), "left").withColumn("children", F.coalesce("children", F.lit(0).cast("bigint"))).drop("d2", "a2", "b2")

    # What each conversation's own tail holds from a depth down, and in all.
    values = {"tokens": (F.col("n") - 1) * F.col("words"), "leaves": (F.col("children") == 0).cast("bigint")}
    tails = saved(in_ranges(nodes, [F.col("conv")], [F.desc("depth")], totals=values))
    whole = tails.groupBy(F.col("conv").alias("conv2")).agg(F.min("depth").alias("from"), F.max("tokens").alias("t"), F.max("leaves").alias("l")).where("`from` > 0")
    above = paths.join(whole, F.col("conv") == F.col("conv2")).where(F.col("depth") < F.col("from"))
    sums = [F.sum("t").alias("t"), F.sum("l").alias("l")]
    above = above.groupBy("family", *NODE).agg(*sums).groupBy(*[F.col(c).alias(c2) for c, c2 in zip(NODE, ("d2", "a2", "b2"), strict=True)]).agg(*sums)
    nodes = tails.join(above, here(above), "left").drop("d2", "a2", "b2")

    # A node's parent belongs to the same conversation but at the top of a tail, whose parent has to be looked up.
    tops = whole.select("conv2", F.col("from").alias("d"))
    tops = tails.join(tops, (F.col("conv") == F.col("conv2")) & (F.col("depth") == F.col("d"))).select("conv", (F.col("d") - 1).alias("d2"), F.col("pa").alias("a2"), F.col("pb").alias("b2"))
    tops = tails.select(*NODE, F.col("conv").alias("parent")).join(tops, here(tops)).select(F.col("conv").alias("c4"), (F.col("d2") + 1).alias("d4"), "parent")
    nodes = nodes.join(tops, (F.col("conv") == F.col("c4")) & (F.col("depth") == F.col("d4")), "left")
    ends = ends_digests(paths.where(F.col("depth") == F.col("turns") - 1).select(*NODE, "conv")).withColumnsRenamed({"depth": "d2", "a": "a2", "b": "b2"})
    out = nodes.join(ends, here(ends), "left")
    return out.select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.when(F.col("depth") > 0, F.coalesce("parent", "conv")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"),
        (F.col("tokens") + F.coalesce("t", F.lit(0))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


ORACLE = r"""
with turns as (
  select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as r from conversations where conv_id is not null
), crc_table as (
  select list(v order by i) as t from (select i, list_reduce(list_prepend(i::bigint, range(8)), lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end) as v from range(256) as s(i))
), convs as (
  select c, c - ((c % 20) + 20) % 20 as base, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::bigint)),
    lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295) % 4 as h
  from (select distinct c from turns), crc_table
), rows_ as (
  select v.c, 0 as part, b.r, b.role, b.text from convs v join turns b on b.c = v.base and b.r < v.h
  union all select v.c, 1, o.r, o.role, o.text from convs v join turns o on o.c = v.c and o.r >= v.h
), paths as (
  select c, row_number() over w as depth, md5(string_agg(md5(role || chr(0) || text), '') over w) as node,
    len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) as words
  from rows_ window w as (partition by c order by part, r)
  union all select c, 0, md5(''), 0 from convs
), nodes as (
  select depth, node, min(c) as conv, count(*) as n, any_value(words) as words from paths group by depth, node
), linked as (
  select n.*, p.node as parent_node from nodes n left join paths p on p.c = n.conv and p.depth = n.depth - 1
), kids as (
  select parent_node, depth - 1 as depth, count(*) as k from linked where depth > 0 group by all
), valued as (
  select l.*, coalesce(k, 0) as k, m.conv as parent from linked l left join kids on kids.parent_node = l.node and kids.depth = l.depth
    left join nodes m on m.node = l.parent_node and m.depth = l.depth - 1
), below as (
  select p.node, p.depth, sum((v.n - 1) * v.words)::bigint as saved_tokens, count(*) filter (v.k = 0) as leaves
  from valued v join paths p on p.c = v.conv and p.depth <= v.depth group by p.node, p.depth
), ends as (
  select node, depth, sha256(string_agg(c::varchar, ',' order by c)) as s from (select *, max(depth) over (partition by c) as last from paths) where depth = last group by node, depth
)
select v.conv as conv_id, v.depth::bigint as depth, v.parent as parent_conv_id, v.n as n_convs, v.k as n_children, b.leaves as n_leaves, b.saved_tokens,
  coalesce(e.s, sha256('')) as ends_sha256
from valued v join below b on b.node = v.node and b.depth = v.depth left join ends e on e.node = v.node and e.depth = v.depth
"""
