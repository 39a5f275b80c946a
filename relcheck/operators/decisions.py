"""Decisions over aggregates, choices by scores, and the rows of report tables (AG-18, AG-23, AG-24, SF-28, SF-29, UD-05)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relcheck.functions.text import as_percent
from relcheck.operators.metrics import confusion, n_if, ratio
from relcheck.operators.rules import cascade

# Shares of unreadable answers, of one answer, and of one answer among scores, above which a measurement fails.
MAX_INVALID, MAX_ONE_ANSWER, MAX_ONE_SCORE = 0.10, 0.95, 0.90


def likelier(yes: Column, no: Column) -> Column:
    """SF-29: the answer with the greater log probability; yes on a tie, null if one is missing."""
    return F.when(yes >= no, "yes").when(yes < no, "no")


def margin(scores: Column, gold: Column) -> Column:
    """SF-29: the gold key's score minus the best of the others in a map; null without gold or without others."""
    others = F.array_max(F.map_values(F.map_filter(scores, lambda k, v: k != gold)))
    return F.try_element_at(scores, gold) - others


def measured(answer: Column) -> Column:
    """FL-29: n, valid, invalid_share, yes_ratio and one_answer (the greater share of valid ones) of answers yes, no and
    invalid; a null answer is a missing one and counts as invalid. Without rows everything is invalid."""
    yes, no, n = n_if(answer == "yes"), n_if(answer == "no"), F.count(F.lit(1))
    bad = F.coalesce(F.try_divide((n - yes - no).cast("double"), n), F.lit(1.0))
    return F.struct(
        n.alias("n"), (yes + no).alias("valid"), bad.alias("invalid_share"), ratio(yes, yes + no).alias("yes_ratio"), ratio(F.greatest(yes, no), yes + no).alias("one_answer")
    )


def chosen_measurement(df: DataFrame, main: Column, fallback: Column, by_score: Column, *keys: str) -> DataFrame:
    """AG-23: which of three ways to measure a prior is used, per group, and whether it failed. The fallback replaces a main
    measurement with too many unreadable answers (where any fallback exists); scores replace what says nearly always the
    same. One aggregate reads all three."""
    out = df.groupBy(*keys).agg(measured(main).alias("main"), measured(fallback).alias("fallback"), measured(by_score).alias("logprob"), (F.count(fallback) > 0).alias("has"))
    second = F.col("has") & (F.col("main.invalid_share") > MAX_INVALID)
    out = out.withColumn("text", F.when(second, F.col("fallback")).otherwise(F.col("main")))
    scores = F.col("text.one_answer") > MAX_ONE_ANSWER
    used = F.when(scores, "logprob").when(second, "fallback").otherwise("main")
    out = out.select(*keys, used.alias("used"), F.when(scores, F.col("logprob")).otherwise(F.col("text")).alias("m"))
    by = F.col("used") == "logprob"
    failed = (F.col("m.one_answer") > MAX_ONE_ANSWER) | (by & (F.col("m.one_answer") >= MAX_ONE_SCORE)) | (~by & (F.col("m.invalid_share") > MAX_INVALID))
    return out.select(*keys, "used", failed.alias("failed"), "m.*")


def heldout_verdict(first: Column, second: Column, third: Column) -> Column:
    """AG-24: what held-out accuracies of three versions say of negatives: none, random and hard ones. The third may be null."""
    # How far accuracies have to be apart.
    better = (second > first + 0.03) | (third > first + 0.03)
    alike = (F.abs(second - first) < 0.02) & (third.isNull() | (F.abs(third - first) < 0.02))
    return cascade(
        [("Incomplete", first.isNull() | second.isNull()), ("Go B", better & (third > second + 0.02)), ("Go A", better), ("No-Go B", alike)],
        "No-Go A candidate",
    )


def adaptation_verdict(one: Column, other: Column) -> Column:
    """AG-24: A (both trainings help), B (neither does) or C (they disagree), by two gains of accuracy."""
    # Gains that count as large, small and apart.
    low, high = F.least(one, other), F.greatest(one, other)
    small = (F.abs(one) < 0.04) & (F.abs(other) < 0.04)
    apart = (low < 0.08) & (high >= 0.08) & (high - low >= 0.08)
    return cascade(
        [("A", (low >= 0.08) | ((high >= 0.10) & (low >= 0.04))), ("C", apart), ("B", small), ("C", (high > 0.05) & (low < 0.02)), ("A", low >= 0.05)],
        "B",
    )


# A gain is clear if its interval lies above 0.03 and its mean above 0.05; it is none if both are below 0.05.
CLEAR_LOW, CLEAR_MEAN = 0.03, 0.05


def contains_zero(low: Column, high: Column) -> Column:
    """FL-29: whether an interval holds zero; a missing one does."""
    return F.coalesce((low <= 0) & (high >= 0), F.lit(True))


def closer_to_gold(before: Column, after: Column, gold: Column) -> Column:
    """FL-29: whether a yes-ratio came closer to gold's, by more than rounding errors (1e-12)."""
    return F.abs(after - gold) + 1e-12 < F.abs(before - gold)


def needs_strata(df: DataFrame, positive: Column, *keys: str, most: float = 3.0) -> DataFrame:
    """FL-29: a row per group (all rows without keys): n, the share of positives, how many percentage points it is from a half,
    and whether it has to be drawn in strata, because it is off by more than `most` or has no positives to tell of (nulls
    don't count)."""
    out = df.groupBy(*keys).agg(F.count(positive).alias("n"), F.avg(positive.cast("int")).alias("positive_rate"))
    off = F.abs(F.col("positive_rate") - 0.5) * 100
    return out.withColumn("points_off", off).withColumn("in_strata", F.coalesce(off > most, F.lit(True)))


def clear_gain(mean: Column, low: Column) -> Column:
    """FL-29: a gain that is certain and large; null is none."""
    return F.coalesce((low > CLEAR_LOW) & (mean > CLEAR_MEAN), F.lit(False))


def no_gain(mean: Column, high: Column) -> Column:
    """FL-29: a gain that is surely small; so is a missing one."""
    return mean.isNull() | F.coalesce((high < CLEAR_MEAN) & (mean < CLEAR_MEAN), F.lit(False))


def token_verdict(whole: tuple[Column, Column], relation: tuple[Column, Column]) -> Column:
    """AG-24: what matched captions say of two trainings, by their gains over whole captions and over relations alone (structs
    mean, low, high). D: one training gains and the other doesn't; B: captions and relations gain; C: captions alone;
    A: nothing generalises."""
    clear, none = lambda g: clear_gain(g["mean"], g["low"]), lambda g: no_gain(g["mean"], g["high"])
    one_sided = (clear(whole[0]) & none(whole[1])) | (clear(whole[1]) & none(whole[0]))
    captions, relations = clear(whole[0]) | clear(whole[1]), clear(relation[0]) | clear(relation[1])
    return cascade([("D", one_sided), ("B", captions & relations), ("C", captions)], "A")


def training_verdict(whole: tuple[Column, Column], relation: tuple[Column, Column], heldout: tuple[Column, Column]) -> Column:
    """AG-24: what two trainings learned, by gains (structs mean, low, high) on their own captions, their relations and held-out
    relations. D: the surface alone; C: relations that generalise; B: only what was trained on; A: too weak to tell."""
    clear, none = lambda g: clear_gain(g["mean"], g["low"]), lambda g: no_gain(g["mean"], g["high"])
    some, nothing = lambda gs: clear(gs[0]) | clear(gs[1]), lambda gs: none(gs[0]) & none(gs[1])
    return cascade([("D", some(whole) & nothing(relation)), ("C", some(whole) & some(relation) & some(heldout)), ("B", some(whole) & nothing(heldout))], "A")


def scale_verdict(df: DataFrame, key: str, gain: Column, fp_before: Column, fp_after: Column, fn_before: Column, fn_after: Column, base_gain: Column) -> DataFrame:
    """AG-24: what more training data did, from a row per benchmark: gains are in percentage points. Healthy: half a point
    without more false positives or many more false negatives; biased: the opposite, bought by saying no."""
    # Points of gain, growth of false negatives, and numbers of benchmarks.
    fewer = fp_after <= fp_before
    worse = fn_after > fn_before + F.greatest(F.lit(3.0), 0.15 * F.greatest(fn_before, F.lit(1)))
    out = df.groupBy(key).agg(
        n_if(gain >= 1.0).alias("one_point"),
        n_if(gain >= 0.5).alias("half_point"),
        n_if(fewer & ~worse & (gain >= 0.5)).alias("healthy"),
        n_if(fewer & worse & (gain < 0.5)).alias("biased"),
        F.max(F.abs(base_gain)).alias("over_base"),
        F.avg(gain).alias("mean_gain"),
    )
    rules = [
        ("Go A", (F.col("one_point") >= 2) & (F.col("healthy") >= 2)),
        ("Weak Go", (F.col("half_point") >= 3) & (F.col("healthy") >= 2)),
        ("No-Go B", F.col("biased") >= 2),
        ("No-Go A", F.col("over_base") < 0.5),
    ]
    return out.withColumn("verdict", cascade(rules, "observe"))


def judgment_rates(df: DataFrame, subset: str, judgment: str, negative: Column) -> DataFrame:
    """AG-18: shares of the judgments in each subset, and how often implausible means a negative and plausible a positive."""
    is_ = lambda v: F.coalesce(F.col(judgment) == v, F.lit(False))
    share = lambda c: F.avg(c.cast("int"))
    return df.groupBy(subset).agg(
        F.count(F.lit(1)).alias("n"),
        share(is_("plausible")).alias("plausible_rate"),
        share(is_("implausible")).alias("implausible_rate"),
        share(is_("parse_error")).alias("parse_error_rate"),
        share(F.when(negative, is_("implausible")).otherwise(is_("plausible"))).alias("accuracy"),
    )


def paired_accuracy(positives: DataFrame, negatives: DataFrame, key: str, judgment: str) -> DataFrame:
    """AG-18: over negatives whose positive (one row a key) was judged too: n judgments, and the share of right ones; null
    without pairs."""
    right = lambda df, v, name: df.select(key, F.coalesce(F.col(judgment) == v, F.lit(False)).cast("int").alias(name))
    both = right(negatives, "implausible", "_n").join(right(positives, "plausible", "_p"), key)
    return both.agg((2 * F.count(F.lit(1))).alias("n"), (F.avg(F.col("_n") + F.col("_p")) / 2).alias("accuracy"))


def contrast(df: DataFrame, a: Column, b: Column, gold: Column, *keys: str) -> DataFrame:
    """UD-05: two runs on the items that both answered: accuracies, discordant counts, how many items are missing, and
    whether there are too few (100) to tell. One aggregate; intervals come from stats.paired_bootstrap."""
    there = a.isNotNull() & b.isNotNull()
    right = lambda x: F.avg(F.when(there, (x == gold).cast("int")))
    out = df.groupBy(*keys).agg(
        n_if(there).alias("n"),
        n_if(~there).alias("missing"),
        right(a).alias("accuracy_a"),
        right(b).alias("accuracy_b"),
        n_if(there & (a == gold) & (b != gold)).alias("only_a"),
        n_if(there & (a != gold) & (b == gold)).alias("only_b"),
    )
    return out.withColumn("low_power", F.col("n") < 100)


def metric_matrix(df: DataFrame, model: str, bench: str, benches: list[str], pred: Column, gold: Column) -> DataFrame:
    """PR-16: a row per model, a column with the accuracy in each benchmark; null where a model has no answers."""
    cells = df.select(model, bench, pred.alias("_p"), gold.alias("_g")).groupBy(model, bench).agg(*confusion(F.col("_p"), F.col("_g")))
    cells = cells.withColumn("accuracy", ratio(F.col("tp") + F.col("tn"), F.col("n")))
    return cells.groupBy(model).agg(*[F.max(F.when(F.col(bench) == b, F.col("accuracy"))).alias(b) for b in benches])


def report_row(name: Column, *cells: Column) -> Column:
    """SF-28: a line of a Markdown table; shares are percentages, what is null is an empty cell."""
    told = [F.coalesce(as_percent(c), F.lit("")) for c in cells]
    return F.concat(F.lit("| "), F.concat_ws(" | ", F.coalesce(name, F.lit("")), *told), F.lit(" |"))
