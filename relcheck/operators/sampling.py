"""Windows, samples, quotas and shards (WN, SA). Random choices are orders of md5(seed:id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relcheck.functions.text import draw
from relcheck.operators.ranges import in_ranges, spare
from relcheck.operators.selection import greedy_disjoint


def first_qualifying(df: DataFrame, keys: list[str], qualifies: Column, *order: Column) -> DataFrame:
    """WN-01, WN-02: the first row of each group, by order, that qualifies."""
    best = F.min(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.struct(*df.columns).alias("row"))).alias("best")
    return df.where(qualifies).groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(best).select("best.row.*")


def top_with_quota(df: DataFrame, keys: list[str], head: str, k: int, quota: int, *order: Column) -> DataFrame:
    """WN-04, WN-13: the first k of each group by order, no more than quota of one head unless the group has too few."""
    own = spare(df)
    ranked = in_ranges(df, [F.col(c) for c in [*keys, head]], list(order), rank=own + "h")
    ranked = in_ranges(ranked, [F.col(c) for c in keys], [F.col(own + "h") > quota, *order], rank=own + "r")
    return ranked.where(F.col(own + "r") <= k).select(*df.columns)


def relaxing_caps(df: DataFrame, group: str, n: int, shares: list[float], order: Column, tie: Column) -> DataFrame:
    """WN-05: n rows by order, where no group has more than a share of n; caps are relaxed, share by share, while rows are
    missing. The limit is a top-n of partitions, not one window over all rows."""
    own = spare(df)
    ranked = in_ranges(df, [F.col(group)], [order, tie], rank=own + "r")
    tier = F.lit(len(shares))
    for k in reversed(range(len(shares))):
        tier = F.when(F.col(own + "r") <= max(1, int(n * shares[k])), k).otherwise(tier)
    return ranked.withColumn("tier", tier).where(F.col("tier") < len(shares)).orderBy("tier", order, tie).limit(n).drop(own + "r")


def arg_max(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """WN-06: the rows with the greatest value of each group, ties kept."""
    own = spare(df)
    best = df.groupBy(*keys).agg(F.max(value).alias(own + "best"))
    return df.join(best, keys).where(F.col(value) == F.col(own + "best")).drop(own + "best")


def one_per_group(df: DataFrame, keys: list[str], seed: int, id_col: str) -> DataFrame:
    """WN-07: a random row of each group."""
    return first_qualifying(df, keys, F.lit(True), draw(seed, F.col(id_col)), F.col(id_col))


def round_robin(df: DataFrame, strata: list[str], slots: int, *order: Column) -> DataFrame:
    """WN-08: slots 0, 1, ... dealt in turn within each stratum."""
    return in_ranges(df, [F.col(c) for c in strata], list(order), rank="slot").withColumn("slot", ((F.col("slot") - 1) % slots).cast("int"))


def interleaved(df: DataFrame, group: str, n: int, *order: Column) -> DataFrame:
    """WN-09: n rows: the first of each group, then the second of each, and so on."""
    return in_ranges(df, [F.col(group)], list(order), rank="turn").withColumn("turn", F.col("turn").cast("int")).orderBy("turn", group).limit(n)


def tertiles(df: DataFrame, key: str, count: str) -> DataFrame:
    """WN-10: keys by falling count in thirds 0, 1, 2; what the division leaves joins the last."""
    own = spare(df)
    ranked = in_ranges(df, [], [F.desc(count), F.col(key)], rank=own + "r", size=own + "n")
    third = F.greatest(F.floor(F.col(own + "n") / 3), F.lit(1))
    return ranked.withColumn("tertile", F.least(F.floor((F.col(own + "r") - 1) / third), F.lit(2)).cast("int")).drop(own + "r", own + "n")


def numbered(df: DataFrame, order: str) -> DataFrame:
    """WN-11: `ord`, gapless from 0, by a column of unique values. Ranges and their counts come from one written table."""
    return in_ranges(df, [], [F.col(order)], rank="ord").withColumn("ord", F.col("ord") - 1)


def shuffled(df: DataFrame, seed: int, id_col: str) -> DataFrame:
    """SA-14."""
    return df.orderBy(draw(seed, F.col(id_col)), id_col)


def sample(df: DataFrame, seed: int, id_col: str, n: int) -> DataFrame:
    """SA-04, SA-05: n random rows (all, if there are fewer)."""
    return shuffled(df, seed, id_col).limit(n)


def stratified(df: DataFrame, strata: list[str], share: float, seed: int, id_col: str) -> DataFrame:
    """SA-06: a share of each stratum, rounded half to even."""
    own = spare(df)
    ranked = in_ranges(df, [F.col(c) for c in strata], [draw(seed, F.col(id_col)), F.col(id_col)], rank=own + "r", size=own + "n")
    return ranked.where(F.col(own + "r") <= F.greatest(F.lit(0), F.bround(F.col(own + "n") * share))).select(*df.columns)


def greedy_unlike(candidates: Column, alike, k: int = 3) -> Column:
    """SA-07: the first k of an ordered array of which no two are alike."""

    def add(taken: Column, x: Column) -> Column:
        return F.when((F.size(taken) < k) & ~F.exists(taken, lambda y: alike(x, y)), F.array_append(taken, x)).otherwise(taken)

    return F.aggregate(candidates, F.array().cast("array<string>"), add)


def quotas(df: DataFrame, stratum: str, quota: dict, n: int, *order: Column) -> DataFrame:
    """SA-09: up to its quota of each stratum, then leftovers in strata order, n rows in all."""
    most, own = F.lit(0), spare(df)
    for k, v in quota.items():
        most = F.when(F.col(stratum) == k, v).otherwise(most)
    ranked = in_ranges(df, [F.col(stratum)], list(order), rank=own + "r")
    return ranked.orderBy(F.col(own + "r") > most, stratum, own + "r").limit(n).drop(own + "r")


def balanced_letters(df: DataFrame, seed: int, id_col: str, letters: str = "ABCD") -> DataFrame:
    """SA-10: answer positions dealt evenly, in a random order of the items."""
    dealt = numbered(df.withColumn("_d", F.concat(draw(seed, F.col(id_col)), F.lit(":"), F.col(id_col).cast("string"))), "_d")
    return dealt.withColumn("letter", F.get(F.array(*[F.lit(x) for x in letters]), (F.col("ord") % len(letters)).cast("int"))).drop("_d", "ord")


def stride_shard(order: Column, shards: int) -> Column:
    """SA-11: every shards-th row."""
    return F.pmod(order, F.lit(shards)).cast("int")


def chunk_shard(order: Column, rows: int, shards: int) -> Column:
    """SA-11: consecutive rows."""
    return F.floor(order / -(-rows // shards)).cast("int")


def disjoint_pick(df: DataFrame, group: str, left: str, right: str, per_group: int, n: int, seed: int) -> DataFrame:
    """SA-13: rows in turns of groups of which no two have an image (left or right) in common.

    The turn is the row's place in its group by md5 of the seed and its images; no more than per_group rows of a group are
    taken. What a sequential pass in that order takes is found in rounds (selection.greedy_disjoint); then the n that come
    first are kept.
    """
    turned = in_ranges(df, [F.col(group)], [draw(seed, F.col(left), F.col(right)), F.col(left), F.col(right)], rank="_turn")
    order = [F.col("_turn"), F.col(group), F.col(left), F.col(right)]
    return greedy_disjoint(turned, group, [left, right], per_group, order).orderBy("place").limit(n).select(*df.columns)


def stratified_by(df: DataFrame, key: Column, share: float, seed: int, id_col: str) -> DataFrame:
    """UD-03: a share of each stratum, where the stratum is any expression."""
    return stratified(df.withColumn("_stratum", key), ["_stratum"], share, seed, id_col).drop("_stratum")


def leading(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """SA-01, SA-02: the first n rows by several keys; keys cast to string sort 10 before 9."""
    return df.orderBy(*order).limit(n)


def nested_samples(df: DataFrame, sizes: list[int], *order: Column) -> DataFrame:
    """SA-03: the first max(sizes) rows by order with their ordinal and the least of the sizes whose sample has them, so
    that each sample holds all smaller ones. Only that many rows meet in one task."""
    first = df.orderBy(*order).limit(max(sizes)).withColumn("ordinal", F.row_number().over(Window.orderBy(*order)) - 1)
    least = F.lit(None).cast("int")
    for n in sorted(sizes, reverse=True):
        least = F.when(F.col("ordinal") < n, n).otherwise(least)
    return first.withColumn("smallest", least)


def free_resources(df: DataFrame, free: str, used: str, min_free: float, max_used: float, n: int, tie: str) -> DataFrame:
    """FL-30: the n resources with most room that have enough of it and little use; none if there are fewer than n."""
    best = df.where((F.col(free) >= min_free) & (F.col(used) <= max_used)).orderBy(F.desc(free), tie).limit(n)
    return best.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))).where(F.col("_n") == n).drop("_n")
