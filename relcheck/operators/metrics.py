"""Confusion-matrix metrics, grouping sets and tallies (AG)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relcheck.operators.sampling import arg_max


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, 0.0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def n_if(x: Column) -> Column:
    return F.count_if(F.coalesce(x, F.lit(False)))


def confusion(pred: Column, gold: Column) -> list[Column]:
    """AG-01: counts of the four cells."""
    return [n_if(pred & gold).alias("tp"), n_if(pred & ~gold).alias("fp"), n_if(~pred & gold).alias("fn"), n_if(~pred & ~gold).alias("tn"), F.count(F.lit(1)).alias("n")]


def rates(df: DataFrame) -> DataFrame:
    """AG-01: accuracy, precision, recall, f1, yes_ratio of counted cells; zero denominators give 0.0."""
    tp, fp, fn, tn, n = (F.col(c) for c in ("tp", "fp", "fn", "tn", "n"))
    return df.withColumns(
        {"accuracy": ratio(tp + tn, n), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "yes_ratio": ratio(tp + fp, n)}
    )


def metrics(df: DataFrame, pred: Column, gold: Column, *keys: str) -> DataFrame:
    """AG-01, AG-12, AG-14: metrics overall and for each prefix of keys; `level` counts the keys of a row's set, which tells
    the overall row from a group of nulls."""
    sets = ", ".join("(" + ", ".join(keys[:k]) + ")" for k in range(len(keys) + 1))
    told = df.select(*keys, pred.alias("_p"), gold.alias("_g"))
    if not keys:
        return rates(told.agg(*confusion(F.col("_p"), F.col("_g"))))
    cells = "count_if(_p and _g) tp, count_if(_p and not _g) fp, count_if(not _p and _g) fn, count_if(not _p and not _g) tn, count(*) n"
    level = " + ".join(f"(1 - grouping({k}))" for k in keys)
    out = told.sparkSession.sql(f"select {', '.join(keys)}, cast({level} as int) level, {cells} from {{t}} group by grouping sets ({sets})", t=told)
    return rates(out)


def no_positive(df: DataFrame, pred_no: Column, gold_no: Column, *keys: str) -> DataFrame:
    """AG-02: the metrics with No as the positive class; yes_ratio is 1 minus the share of predicted No."""
    out = rates(df.groupBy(*keys).agg(*confusion(pred_no, gold_no)))
    return out.withColumn("yes_ratio", 1.0 - ratio(F.col("tp") + F.col("fp"), F.col("n")))


def invalid_penalised(df: DataFrame, pred: Column, gold: Column, *keys: str) -> DataFrame:
    """AG-03: pred is Yes, No or Invalid; Invalid counts as wrong. yes_ratio counts literal Yes only."""
    yes, no, bad = pred == "Yes", pred == "No", pred == "Invalid"
    cells = [n_if(yes & gold).alias("tp"), n_if((yes | bad) & ~gold).alias("fp"), n_if((no | bad) & gold).alias("fn"), n_if(no & ~gold).alias("tn"), F.count(F.lit(1)).alias("n")]
    out = rates(df.groupBy(*keys).agg(*cells, n_if(yes).alias("n_yes"), n_if(bad).alias("n_invalid")))
    return out.withColumn("yes_ratio", ratio(F.col("n_yes"), F.col("n"))).drop("n_yes")


def fold_mean(df: DataFrame, folds: Column, pred: Column, gold: Column) -> DataFrame:
    """AG-04: metrics per fold, averaged over folds. folds: an array; an item may be in several."""
    per_fold = metrics(df.select(F.explode(folds).alias("fold"), pred.alias("p"), gold.alias("g")), F.col("p"), F.col("g"), "fold").where("level = 1")
    return per_fold.agg(F.count(F.lit(1)).alias("n_folds"), *[F.avg(c).alias(c) for c in ("accuracy", "precision", "recall", "f1", "yes_ratio")])


def most_common(df: DataFrame, item: Column, order: Column, k: int) -> DataFrame:
    """AG-10: the k most frequent items; ties go to the one that appears first by order."""
    return df.groupBy(item.alias("item")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seen")).orderBy(F.desc("n"), "first_seen").limit(k)


def vocabulary(df: DataFrame, words: Column, min_count: int = 2, min_length: int = 3) -> DataFrame:
    """AG-10: words of an array column that are frequent and long enough."""
    each = df.select(F.explode(words).alias("word")).where(F.length("word") >= min_length)
    return each.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def diversity(df: DataFrame, **combinations: list[str]) -> DataFrame:
    """AG-11: distinct counts of columns and of combinations of them (null counts as ''), and the row count."""
    key = lambda cols: F.concat_ws("||", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    return df.agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(key(cols)).alias(name) for name, cols in combinations.items()])


def max_share(df: DataFrame, key: str) -> DataFrame:
    """AG-11: the largest group's share of the rows."""
    return df.groupBy(key).count().agg((F.max("count") / F.sum("count")).alias("max_share"), F.count(F.lit(1)).alias("n_groups"))


def transitions(df: DataFrame, before: Column, after: Column, gold: Column, *keys: str) -> DataFrame:
    """AG-15, AG-16: what changed between two predictions, and how often they agree."""
    return df.groupBy(*keys).agg(
        n_if((before != gold) & (after == gold)).alias("fixed"),
        n_if((before == gold) & (after != gold)).alias("broken"),
        n_if((before == gold) & (after == gold)).alias("both_right"),
        n_if((before != gold) & (after != gold)).alias("both_wrong"),
        F.avg((before == after).cast("int")).alias("agreement"),
    )


def lock_rate(df: DataFrame, prior: Column, vision: Column, gold: Column) -> DataFrame:
    """AG-17: rows by whether the prior agrees with the gold answer; how often vision follows the prior."""
    layer = F.when(prior.isNull(), "invalid").when(prior == gold, "consistent").otherwise("conflict")
    return df.select(layer.alias("layer"), prior.alias("p"), vision.alias("v"), gold.alias("g")).groupBy("layer").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("v") == F.col("p")).cast("int")).alias("lock_rate"), F.avg((F.col("v") == F.col("g")).cast("int")).alias("accuracy")
    )


def tally(df: DataFrame, *keys: str, missing: str = "missing") -> DataFrame:
    """AG-19: rows per combination of statuses; a null status has a name."""
    return df.groupBy(*[F.coalesce(F.col(k).cast("string"), F.lit(missing)).alias(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"))


def collected(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """AG-20: the sorted set of values of each key; sets are as small as the values of one key."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_set(value)).alias("values"))


def reconciled(own: DataFrame, published: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """AG-22: own and published values side by side, and whether they agree within the tolerance (null: one is missing)."""
    both = own.select(*keys, F.col(value).alias("own")).join(published.select(*keys, F.col(value).alias("published")), keys, "full")
    return both.withColumn("within", F.abs(F.col("own") - F.col("published")) <= tolerance)


def ranked_models(df: DataFrame, bench: str, model: str, value: str) -> DataFrame:
    """WN-12: models by value within a benchmark; null counts as -1, ties go by name."""
    order = Window.partitionBy(bench).orderBy(F.desc(F.coalesce(F.col(value), F.lit(-1.0))), model)
    return df.withColumn("rank", F.row_number().over(order))


def usual_predicates(triplets: DataFrame) -> DataFrame:
    """AG-13, WN-06: subject, object, predicate, n of the most frequent predicates of each pair of entities, ties kept."""
    counts = triplets.groupBy("subject", "object", "predicate").agg(F.count(F.lit(1)).alias("n"))
    return arg_max(counts, ["subject", "object"], "n")
