"""Ranks and running totals in ranges against plain Python."""

import collections
import random

from pyspark.sql import functions as F

from relcheck.operators.ranges import in_ranges


def test_ranks_and_totals_of_a_hot_group(spark):
    dice = random.Random(3)
    rows = [("hot" if k % 3 else dice.choice(["a", "b", None]), dice.randrange(40), dice.choice([None, 1, 5]), "x") for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, o int, v int, _part string")
    out = in_ranges(df, [F.col("g")], [F.desc("o"), F.col("v").asc_nulls_first()], rank="rank", size="size", totals={"upto": F.col("v")}).collect()
    assert out[0].__fields__ == ["g", "o", "v", "_part", "rank", "size", "upto"]
    groups = collections.defaultdict(list)
    for r in out:
        groups[r.g].append(r)
    assert {g: len(x) for g, x in groups.items()} == collections.Counter(g for g, *_ in rows)
    for x in groups.values():
        x.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in x] == list(range(1, len(x) + 1)) and {r.size for r in x} == {len(x)}
        assert [(-r.o, r.v or 0) for r in x] == sorted((-r.o, r.v or 0) for r in x)
        total = 0
        for r in x:
            total += r.v or 0
            assert r.upto == total


def test_hashes_without_groups_and_empty(spark):
    df = spark.range(500).select("id", F.xxhash64("id").alias("h"))
    out = in_ranges(df, [], [F.col("id")], rank="n", totals={"x": F.col("h")}, how="xor").orderBy("id").collect()
    x = 0
    for k, r in enumerate(out):
        x ^= r.h
        assert (r.n, r.x) == (k + 1, x)
    assert in_ranges(df.limit(0), [F.col("id")], [F.col("h")], rank="n", size="s").count() == 0
