"""Selections in which no image is used twice (SA-13): what a sequential pass would take, found in rounds of joins.

A sequential pass takes a row if none of its images is in a row taken before and its group isn't full. Whether it takes
a row is certain as soon as the rows before it that share an image or the group are decided as far as they matter:

* a row is taken if it is the first of what is undecided at each of its images, and the rows before it in its group that
  are taken or undecided don't fill the group;
* a row is left if a taken row has one of its images, or if the rows taken before it fill its group.

Each round decides all rows that can be decided, at least the first one, and in a random order nearly all after few
rounds. Rounds go through the order in stretches, each FACTOR times as long as what is behind it: what is decided before
a stretch removes rows of full groups and of used images from all that follow, so that most rows are read a few times and
never in a round of their own. Rounds work on written tables; the driver sees counts only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relcheck.functions.text import draw
from relcheck.operators.ranges import in_ranges
from relcheck.tables import saved


#: Rows of the first stretch, and how much longer the order is after each.
STRETCH, FACTOR = 20_000, 16


def _ends(rows: DataFrame) -> DataFrame:
    return rows.select("_o", F.explode("_images").alias("_image"))


def _without(rows: DataFrame, used: DataFrame) -> DataFrame:
    """The rows that have none of the used images."""
    return rows.join(_ends(rows).join(used, "_image", "left_semi").select("_o").distinct(), "_o", "left_anti")


def greedy_disjoint(df: DataFrame, group: str, images: list[str], cap: int | None, order: list[Column], forbidden: DataFrame | None = None, already: DataFrame | None = None) -> DataFrame:
    """The rows of df that a pass in this order takes, with `place`, their number in the order.

    cap: how many rows of a group are taken at most (None: all that fit). A null image is no image: it conflicts with
    nothing. A null group is a group. forbidden: images (column image) that are used before the pass. already: rows that
    count for their groups' caps beforehand. Ties of order are broken arbitrarily.
    """
    own = F.array_distinct(F.array_compact(F.array(*[F.col(c).cast("string") for c in images])))
    rows = in_ranges(df, [], order, rank="place")
    rows = saved(rows.select(F.struct("*").alias("row"), F.struct(F.col(group).cast("string").alias("g")).alias("_group"), own.alias("_images"), F.col("place").alias("_o")))
    if forbidden is not None:
        rows = saved(_without(rows, forbidden.select(F.col("image").cast("string").alias("_image")).where("_image is not null").distinct()))
    had = None
    if already is not None and cap is not None:
        had = already.groupBy(F.struct(F.col(group).cast("string").alias("g")).alias("_group2")).agg(F.count(F.lit(1)).alias("_had"))
    taken, end, rest = rows.limit(0), STRETCH, rows
    while not rest.isEmpty():
        new = saved(_rounds(rest.where(F.col("_o") <= end), taken, cap, had))
        taken, rest, end = saved(taken.unionByName(new)), rest.where(F.col("_o") > end), end * FACTOR
        if cap is not None:
            counts = taken.select(F.col("_group").alias("_group2"), F.lit(1).alias("_had"))
            counts = (counts if had is None else counts.unionByName(had)).groupBy("_group2").agg(F.sum("_had").alias("_had"))
            full = counts.where(F.col("_had") >= cap).select("_group2")
            rest = rest.join(full, F.col("_group") == F.col("_group2"), "left_anti")
        rest = saved(_without(rest, _ends(new).select("_image").distinct()))
    return taken.select("row.*")


def _rounds(rows: DataFrame, before: DataFrame, cap: int | None, had: DataFrame | None) -> DataFrame:
    """The rows that the pass takes of these, after those taken before; had: more rows that count for the groups' caps."""
    taken, rounds = rows.limit(0), 0
    while not rows.isEmpty():
        first = _ends(rows).groupBy("_image").agg(F.min("_o").alias("_first"))
        later = _ends(rows).join(first, "_image").where("_o > _first").select("_o").distinct().withColumn("_later", F.lit(True))
        told = rows.join(later, "_o", "left").withColumns({"_fits": F.lit(True), "_full": F.lit(False)})
        if cap is not None:
            both = rows.select("_o", "_group", F.lit(0).alias("_taken")).unionByName(before.unionByName(taken).select("_o", "_group", F.lit(1).alias("_taken")))
            room = F.lit(cap)
            if had is not None:
                both = both.join(had, F.col("_group") == F.col("_group2"), "left").drop("_group2")
                room = F.lit(cap) - F.coalesce("_had", F.lit(0))
            both = in_ranges(both, [F.col("_group")], [F.col("_o")], rank="_rank", totals={"_before": F.col("_taken")}).where("_taken = 0")
            both = both.select(F.col("_o").alias("_o2"), (F.col("_rank") <= room).alias("_fits"), (F.col("_before") >= room).alias("_full"))
            told = told.drop("_fits", "_full").join(both, F.col("_o") == F.col("_o2"))
        told = saved(told.where("not _full").select("row", "_group", "_images", "_o", (F.col("_fits") & F.col("_later").isNull()).alias("_new")))
        new = told.where("_new").drop("_new")
        rounds += 1
        taken = saved(taken.unionByName(new)) if rounds % 8 == 0 else taken.unionByName(new)
        rows = saved(_without(told.where("not _new").drop("_new"), new.select(F.explode("_images").alias("_image"))))
    return taken


def _images_of(rows: DataFrame, left: str, right: str) -> DataFrame:
    return rows.select(F.explode(F.array(F.col(left).cast("string"), F.col(right).cast("string"))).alias("image"))


def image_split(
    df: DataFrame, group: str, left: str, right: str, id_col: str, n_train: int, n_held: int, seed: int, cap_share: float = 0.1, reserve_from: int = 10
) -> DataFrame:
    """SA-13: rows for training and held-out rows, with `split` and `place`; no image (left or right) is in two rows.

    Of each left image one random row goes on. Each group of reserve_from rows or more, small groups first, has one row
    held out. Training rows are then dealt in turns of the groups (small ones first), no more than cap_share of n_train
    for a group; a row's turn is its place in its group. What is left fills the held-out rows up to n_held, in random
    order, no more than cap_share of n_held for a group. Either split may stay smaller where rows run out.
    """
    best = F.min_by(F.struct("*"), F.struct(draw(seed, F.col(id_col)), F.col(id_col)))
    pool = df.groupBy(F.col(left).alias("_left")).agg(best.alias("row")).select("row.*")
    dealt = draw(seed + 1, F.col(id_col))
    pool = saved(in_ranges(pool, [F.col(group)], [dealt, F.col(id_col)], rank="_turn", size="_size"))
    sizes = [F.col("_size"), F.col(group).asc_nulls_first()]
    cap = lambda n: max(1, int(n * cap_share))
    held = saved(greedy_disjoint(pool.where(F.col("_size") >= reserve_from), group, [left, right], 1, [*sizes, dealt, F.col(id_col)]))
    train = greedy_disjoint(pool, group, [left, right], cap(n_train), [F.col("_turn"), *sizes], forbidden=_images_of(held, left, right))
    train = saved(train.orderBy("place").limit(n_train))
    missing = n_held - held.count()
    if missing > 0:
        used = _images_of(train, left, right).unionByName(_images_of(held, left, right))
        more = greedy_disjoint(pool, group, [left, right], cap(n_held), [dealt, F.col(id_col)], forbidden=used, already=held)
        held = held.unionByName(more.orderBy("place").limit(missing))
    both = train.withColumn("split", F.lit("train")).unionByName(held.withColumn("split", F.lit("heldout")))
    return both.drop("_turn", "_size")
