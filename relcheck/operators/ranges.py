"""Ranks and running totals within groups of any size.

A window over a whole group is one task, however large the group. Here rows are dealt to ranges of (group, order) by
Spark's range partitioning and written once, so that a large group lies in several neighbouring ranges. Windows then run
within (range, group) pieces, and what the pieces before hold of the group is added: a table with a row for each piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relcheck.tables import saved

#: How values of a running total are gathered, and how two totals are joined. xor doesn't overflow: it suits hashes.
TOTALS = {"sum": (F.sum, lambda a, b: a + b), "xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b))}


def spare(df: DataFrame) -> str:
    """A prefix that no column of df has."""
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def in_ranges(
    df: DataFrame, group: list[Column], order: list[Column], rank: str | None = None, size: str | None = None, totals: dict[str, Column] | None = None, how: str = "sum"
) -> DataFrame:
    """df with columns of these names: rank, the row's place in its group from 1 without gaps; size, the group's number of
    rows; and for each name of totals the total (how: sum or xor) of its value up to and with the row.

    Rows that order holds equal get ranks in an arbitrary order. Null groups are groups; null values count as 0. Columns
    of df with one of the names are replaced. The written table is the one that both ranks and totals come from, so a
    task that runs again finds the same ranges.
    """
    gather, both = TOTALS[how]
    own, values = spare(df), totals or {}
    part, key, tie, n = (own + x for x in ("part", "key", "tie", "n"))
    added_columns = [
        F.struct(*[c.alias(f"g{k}") for k, c in enumerate(group)] or [F.lit(0).alias("g")]).alias(key),
        F.monotonically_increasing_id().alias(tie),
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(f"{own}v{k}") for k, c in enumerate(values.values())],
    ]
    laid = df.select("*", *added_columns).repartitionByRange(F.col(key), *order, F.col(tie))
    laid = saved(laid.withColumn(part, F.spark_partition_id()))
    within = Window.partitionBy(part, key).orderBy(*order, tie)
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = laid.withColumn(n, F.row_number().over(within).cast("bigint"))
    local = local.withColumns({f"{own}l{k}": gather(f"{own}v{k}").over(upto) for k in range(len(values))})
    pieces = laid.groupBy(part, key).agg(F.count(F.lit(1)).alias(own + "rows"), *[gather(f"{own}v{k}").alias(f"{own}s{k}") for k in range(len(values))])
    whole = Window.partitionBy(key)
    before = whole.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(
        part,
        key,
        F.coalesce(F.sum(own + "rows").over(before), F.lit(0)).alias(own + "past"),
        F.sum(own + "rows").over(whole).alias(own + "all"),
        *[F.coalesce(gather(f"{own}s{k}").over(before), F.lit(0)).alias(f"{own}b{k}") for k in range(len(values))],
    )
    added = {rank: F.col(n) + F.col(own + "past"), size: F.col(own + "all")}
    added |= {name: both(F.col(f"{own}l{k}"), F.col(f"{own}b{k}")) for k, name in enumerate(values)}
    added.pop(None, None)
    kept = [F.col(f"`{c}`") for c in df.columns if c not in added]
    return local.join(pieces, [part, key]).select(*kept, *[c.alias(k) for k, c in added.items()])
