"""Paired statistics (AG-05 to AG-09). Draws of counts are keyed by md5, so that any engine can repeat them."""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from relcheck.operators.metrics import n_if
from relcheck.operators.ranges import in_ranges
from relcheck.tables import saved, spread


@F.pandas_udf(DoubleType())
def erfc(x: pd.Series) -> pd.Series:
    """SF-31: Spark has no complementary error function; applied to aggregates only."""
    return x.map(math.erfc, na_action="ignore")


def mcnemar(df: DataFrame, a_right: Column, b_right: Column, *keys: str, p_value: bool = True) -> DataFrame:
    """AG-05: discordant counts b and c, chi2 with continuity correction, and its p value (1 if nothing is discordant)."""
    out = df.groupBy(*keys).agg(n_if(a_right & ~b_right).alias("b"), n_if(~a_right & b_right).alias("c"), F.count(F.lit(1)).alias("n"))
    n = F.col("b") + F.col("c")
    out = out.withColumn("chi2", F.when(n == 0, 0.0).otherwise(F.try_divide(F.pow(F.abs(F.col("b") - F.col("c")) - 1, F.lit(2)), n)))
    return out.withColumn("p_value", erfc(F.sqrt(F.col("chi2") / 2))) if p_value else out


def unit(seed: int, *parts: Column) -> Column:
    """A number from 0 to under 1 by the md5 of seed and parts: draws that any engine can repeat."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(16**12)


def binomial_cdf(n: int, p: float) -> tuple[int, np.ndarray]:
    """Where the distribution's mass begins and its cumulated chances from there: 40 deviations around the mean, which
    holds all that a double can tell from 0 and 1."""
    spread = 40 * math.sqrt(n * p * (1 - p)) + 50
    low, high = max(0, int(n * p - spread)), min(n, int(n * p + spread) + 1)
    mode = min(high, max(low, int((n + 1) * p)))
    log = math.lgamma(n + 1) - math.lgamma(mode + 1) - math.lgamma(n - mode + 1) + mode * math.log(p) + (n - mode) * math.log1p(-p)
    up, down = np.arange(mode, high), np.arange(mode, low, -1)
    above = np.cumprod((n - up) / (up + 1.0) * (p / (1 - p)))
    below = np.cumprod(down / (n - down + 1.0) * ((1 - p) / p))
    return low, np.cumsum(np.concatenate([below[::-1], [1.0], above]) * math.exp(log))


@F.pandas_udf(LongType())
def binomial(u: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """The binomial number that u (0 to 1) stands for: the least k with a cumulated chance of u or more. For draws of
    counts, whose number is bounded; n may be of any size."""
    out = np.zeros(len(u), np.int64)
    keys = pd.DataFrame({"n": n.to_numpy(), "p": p.to_numpy()})
    for (size, chance), rows in keys.groupby(["n", "p"]).indices.items():
        if size <= 0 or chance <= 0:
            continue
        if chance >= 1:
            out[rows] = size
            continue
        low, cdf = binomial_cdf(int(size), float(chance))
        own = u.to_numpy()[rows]
        out[rows] = np.where(own > 0, np.minimum(low + np.searchsorted(cdf, own, side="left"), int(size)), 0)
    return pd.Series(out)


def with_draws(counts: DataFrame, draws: int) -> DataFrame:
    return counts.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))


def drawn_difference(seed: int, label: Column, n: Column, only_a: Column, only_b: Column) -> Column:
    """b - a in one draw of n of n items: the number of discordant items is binomial, and so is b's part of them."""
    either = only_a + only_b
    discordant = binomial(unit(seed, label, F.lit("discordant"), F.col("draw")), n, F.coalesce(F.try_divide(either, n), F.lit(0.0)))
    won = binomial(unit(seed, label, F.lit("b"), F.col("draw")), discordant, F.coalesce(F.try_divide(only_b, either), F.lit(0.0)))
    return F.try_divide(won * 2 - discordant, n)


def drawn_rate(seed: int, label: Column, n: Column, right: Column) -> Column:
    """The share of right items in one draw of n of n items."""
    return F.try_divide(binomial(unit(seed, label, F.lit("right"), F.col("draw")), n, F.coalesce(F.try_divide(right, n), F.lit(0.0))), n)


def interval(means: DataFrame, draws: int, *keys: str) -> DataFrame:
    """The draws' elements int(0.025 B) and int(0.975 B), in order; the draws of a key are a bounded number."""
    each = F.sort_array(F.collect_list("mean"))
    return means.groupBy(*keys).agg(F.get(each, F.lit(int(0.025 * draws))).alias("low"), F.get(each, F.lit(int(0.975 * draws))).alias("high"))


def with_interval(point: DataFrame, means: DataFrame, draws: int, *keys: str) -> DataFrame:
    ends = interval(means.where("mean is not null"), draws, *keys)
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys] or [F.lit(True)]
    return point.alias("p").join(ends.alias("e"), reduce(lambda x, y: x & y, same), "left").select("p.*", "e.low", "e.high")


def paired_bootstrap(df: DataFrame, a_right: Column, b_right: Column, draws: int, seed: int, *keys: str) -> DataFrame:
    """AG-06: the accuracy difference b - a with its interval from draws of n of n items.

    An item is right for both, for a only, for b only or for neither, and a draw of n items is a draw of these counts. So
    each key is one row of counts, and its draws are binomial numbers by md5, whatever the number of items."""
    point = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), n_if(a_right & ~b_right).alias("only_a"), n_if(~a_right & b_right).alias("only_b"), F.avg(b_right.cast("int") - a_right.cast("int")).alias("delta")
    )
    label = F.concat_ws(":", F.lit("paired"), *[F.col(k).cast("string") for k in keys])
    means = with_draws(point, draws).select(*keys, drawn_difference(seed, label, F.col("n"), F.col("only_a"), F.col("only_b")).alias("mean"))
    return with_interval(point.select(*keys, "n", "delta"), means, draws, *keys)


def paired_resampling(df: DataFrame, a_right: Column, b_right: Column, item: Column, draws: int, seed: int) -> DataFrame:
    """AG-06 by resampling itself: n, the accuracy difference delta = b - a, and its interval from draws of n of n items.

    Items are numbered by `item`; slot j of draw d takes the item numbered floor(n u), where u is the number by md5 of seed,
    d and j. Every slot is drawn and looked up by a join, and a draw's mean is an aggregate. Items with unknown outcomes are
    drawn, but count in no mean.

    Slots are made on all cores and shuffled to the items. Spark takes them to be as few as the items and would broadcast
    them, which the hint forbids: what is held in memory are the items of a partition."""
    items = df.select(item.alias("item"), (b_right.cast("int") - a_right.cast("int")).alias("v"))
    items = saved(in_ranges(items, [], [F.col("item")], rank="r", size="n").select((F.col("r") - 1).alias("o"), "v", "n"))
    slots = with_draws(spread(items.select("o", "n"), "o"), draws).select("draw", F.floor(unit(seed, F.col("draw"), F.col("o")) * F.col("n")).alias("o"))
    means = slots.join(items.select("o", "v").hint("shuffle_hash"), "o").groupBy("draw").agg(F.avg("v").alias("mean"))
    return with_interval(items.agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("delta")), means, draws)


def summary(df: DataFrame, value: Column, *keys: str) -> DataFrame:
    """AG-07: n, mean, median, sample deviation (0.0 for one row), share of positive values."""
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.avg((value > 0).cast("int")).alias("positive")
    )


def mean_bootstrap(df: DataFrame, value: Column, draws: int, seed: int, *keys: str, piece_rows: int = 100_000, block: int = 100) -> DataFrame:
    """AG-07 with the interval of the mean: keys, n, mean, median, std, positive, ci95_low and ci95_high.

    Draws of n of n values, null values left out. A key's values lie in pieces of piece_rows; how many of a draw's n values
    come from each piece is a multinomial number, and within a piece values are drawn with replacement. So each draw has
    the law of a draw of n of n, a task holds a piece, and a number for each piece and draw is shuffled, not one for each
    value and draw. Generators are seeded by seed, key and piece: reruns agree. Percentiles are interpolated.
    """
    key = F.to_json(F.struct(*[F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)] or [F.lit(0).alias("k")]), {"ignoreNullFields": "false"})
    rows = in_ranges(df.select(key.alias("key"), value.cast("double").alias("v")).where("v is not null"), [F.col("key")], [F.col("v")], rank="r", size="n")
    rows = saved(rows.select("key", "v", "n", F.floor((F.col("r") - 1) / piece_rows).cast("int").alias("piece")))
    sizes = saved(rows.groupBy("key", "piece").agg(F.count(F.lit(1)).alias("own"), F.first("n").alias("n")))

    def takes(key_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """How many values each draw of a block takes from each piece of a key."""
        pdf = pdf.sort_values("piece")
        rng = np.random.default_rng([seed, key_[1], 1, *hashlib.sha256(key_[0].encode()).digest()])
        counts = rng.multinomial(int(pdf["n"].iloc[0]), (pdf["own"] / pdf["n"]).to_numpy(), size=min(block, draws - key_[1] * block))
        return pd.DataFrame({"key": pdf["key"], "piece": pdf["piece"], "block": key_[1], "counts": list(counts.T)})

    blocks = F.explode(F.sequence(F.lit(0), F.lit(-(-draws // block) - 1)))
    counts = sizes.withColumn("block", blocks).groupBy("key", "block").applyInPandas(takes, "key string, piece int, block int, counts array<long>")

    def sums(key_: tuple, own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        values = np.sort(own["v"].to_numpy())
        rng = np.random.default_rng([seed, key_[1], 2, *hashlib.sha256(key_[0].encode()).digest()])
        every = np.concatenate(told.sort_values("block")["counts"].to_list())
        out = [sum(values[rng.integers(0, len(values), min(1 << 20, m - a))].sum() for a in range(0, m, 1 << 20)) for m in every.tolist()]
        return pd.DataFrame({"key": key_[0], "draw": np.arange(draws), "s": out})

    drawn = rows.groupBy("key", "piece").cogroup(counts.groupBy("key", "piece")).applyInPandas(sums, "key string, draw int, s double")
    whole = sizes.select(F.col("key").alias("key2"), "n").distinct()
    means = drawn.groupBy("key", "draw").agg(F.sum("s").alias("s")).join(whole, F.col("key") == F.col("key2")).select("key", (F.col("s") / F.col("n")).alias("m"))
    ends = means.groupBy("key").agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("e"))
    point = summary(df.withColumn("_key", key), value, *keys, "_key")
    return point.join(ends, F.col("_key") == F.col("key"), "left").select(*keys, "n", "mean", "median", "std", "positive", F.get("e", F.lit(0)).alias("ci95_low"), F.get("e", F.lit(1)).alias("ci95_high"))


def difference_in_differences(df: DataFrame, a_right: Column, b_right: Column, treated: Column, draws: int = 0, seed: int = 0) -> DataFrame:
    """AG-08: (b - a) among the treated minus (b - a) among the others, with numbers of items and, if draws are told, the
    interval from draws of each stratum by itself. Difference and interval are null if a stratum is empty."""
    gain = b_right.cast("int") - a_right.cast("int")
    sides = {"treated": treated, "others": ~treated}
    point = df.agg(
        *[F.avg(F.when(c, gain)).alias(k) for k, c in sides.items()],
        *[n_if(c).alias(f"n_{k}") for k, c in sides.items()],
        *[n_if(c & a_right & ~b_right).alias(f"a_{k}") for k, c in sides.items()],
        *[n_if(c & ~a_right & b_right).alias(f"b_{k}") for k, c in sides.items()],
    ).withColumn("did", F.col("treated") - F.col("others"))
    told = point.select("treated", "others", "did", "n_treated", "n_others")
    if not draws:
        return told
    one, other = (drawn_difference(seed, F.lit(k), F.col(f"n_{k}"), F.col(f"a_{k}"), F.col(f"b_{k}")) for k in sides)
    return with_interval(told, with_draws(point, draws).select((one - other).alias("mean")), draws)


def gap(df: DataFrame, right: Column, one: Column, draws: int = 0, seed: int = 0) -> DataFrame:
    """AG-09: the accuracy of one sample minus that of the rest, with numbers of items and, if draws are told, the interval
    from draws of each sample by itself. Gap and interval are null if a sample is empty."""
    sides = {"one": one, "other": ~one}
    point = df.agg(*[F.avg(F.when(c, right.cast("int"))).alias(f"acc_{k}") for k, c in sides.items()], *[n_if(c).alias(f"n_{k}") for k, c in sides.items()], *[n_if(c & right).alias(f"r_{k}") for k, c in sides.items()])
    told = point.select((F.col("acc_one") - F.col("acc_other")).alias("gap"), "n_one", "n_other")
    if not draws:
        return told
    x, y = (drawn_rate(seed, F.lit(k), F.col(f"n_{k}"), F.col(f"r_{k}")) for k in sides)
    return with_interval(told, with_draws(point, draws).select((x - y).alias("mean")), draws)
