"""Mixing sources to target weights by a time-varying curriculum (DataFrame functions only).

Each source has a schedule: its weight over training time 0 to 1, linear between knots. The schedule's integral is the
source's overall weight, from which its target follows: all sources share `share` times all words by weight, no source
takes more than `most` times its own words, and what is left over is shared again by weight.

A source's documents stand in a fixed random order, and its stream goes through them `most` times; the target says where
the stream ends. The schedule's integral up to a time, scaled to the target, is the number of words that the source has
given by then. Inverted, it tells at which time a place of the stream is due: that is the training position of the
document there. Documents are then sorted by position in ranges.

Running totals of a source are taken in ranges of its stream, so a source that holds a third of all rows is many pieces.
Sources are a table as well: their ranks come from the same function, and targets from rounds of aggregates over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relcheck.llm.common import join_small, saved, table
from relcheck.operators.ranges import in_ranges

#: Weights over time, (time, weight) at the knots; dealt to the sources in turn. They integrate to 3, 1 and 2.
SCHEDULES = (((0.0, 4.0), (1.0, 2.0)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.5), (0.5, 2.5), (1.0, 1.5)))
SHARE = 1.5
MOST = 2
SEED = 11


def n_words(text: Column) -> Column:
    """Runs of characters other than space and ASCII control white space; null: 0."""
    return F.size(F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "), " "), "")).cast("bigint")


def areas(schedule: tuple) -> list[tuple[float, float, float, float, float]]:
    """Per segment: where it begins, its length, the weights at its ends, and the integral before it."""
    out, before = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        out.append((t0, t1 - t0, w0, w1, before))
        before += (t1 - t0) * (w0 + w1) / 2
    return out


def integral(schedule: tuple) -> float:
    """The integral of a schedule, which has to go from 0 to 1 with weights of 0 or more, not all of them 0."""
    times = [t for t, _ in schedule]
    whole = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False))
    if times[:1] != [0.0] or times[-1:] != [1.0] or any(a >= b for a, b in zip(times, times[1:], strict=False)) or any(w < 0 for _, w in schedule) or whole <= 0:
        raise ValueError(f"a schedule goes from time 0 to 1 with weights that aren't negative nor all 0: {schedule}")
    return whole


def time_of(given: Column, schedule: tuple) -> Column:
    """The time by which a share `given` (0 to 1) of the schedule's integral is reached."""
    due, out = given * integral(schedule), None
    for t0, length, w0, w1, before in reversed(areas(schedule)):
        rest = F.greatest(due - before, F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + rest * (2 * (w1 - w0) / length), F.lit(0.0)))
        at = F.least(F.lit(t0) + F.coalesce(F.try_divide(rest * 2, root + w0), F.lit(0.0)), F.lit(t0 + length))
        out = at if out is None else F.when(due >= before + length * (w0 + w1) / 2, out).otherwise(at)
    return out


def targets(sized: DataFrame, schedules: tuple, share: float, most: int) -> DataFrame:
    """_source2, _schedule (which of the schedules), _words (the source's) and _target. Each round caps the sources whose
    part exceeds `most` times their words and shares the rest by weight; it ends when no more are capped. The driver sees
    sums only."""
    sources = sized.groupBy("_source").agg(F.sum("_size").alias("_words"))
    sources = in_ranges(sources, [], [F.col("_source").asc_nulls_last()], rank="_n")
    which = F.pmod(F.col("_n") - 1, F.lit(len(schedules))).cast("int")
    weight = F.get(F.array(*[F.lit(integral(s)) for s in schedules]), which)
    sources = saved(sources.select(F.col("_source").alias("_source2"), which.alias("_schedule"), "_words", weight.alias("_weight")))
    cap, level, capped = F.col("_words") * most, 0.0, 0
    while True:
        over = F.col("_weight") * level > cap
        told = sources.agg(F.sum("_words").alias("all"), F.count_if(over).alias("n"), F.sum(F.when(over, cap)).alias("fixed"), F.sum(F.when(~over, F.col("_weight"))).alias("free")).first()
        if level and told["n"] == capped or not told["all"] or not told["free"]:
            break
        capped, level = told["n"], (share * told["all"] - (told["fixed"] or 0)) / told["free"]
    return saved(sources.select("_source2", "_schedule", "_words", F.least(F.col("_weight") * level, cap.cast("double")).alias("_target")))


def planned(docs: DataFrame, id_col: str, text_col: str, source_col: str, with_text: bool, schedules: tuple, share: float, most: int, seed: int) -> DataFrame:
    """row (struct), _size, _words, _target, _copies (array of struct of words and position)."""
    if not 0 < share <= most:
        raise ValueError("the share of all words has to be over 0 and no more than a source may take of its own")
    text = F.col(text_col).cast("string")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if with_text or c != text_col])
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))
    sized = saved(docs.select(row.alias("row"), F.col(source_col).cast("string").alias("_source"), draw.alias("_draw"), F.xxhash64(text).alias("_h"), n_words(text).alias("_size")))
    known = targets(sized.select("_source", "_size"), schedules, share, most)
    order = [F.col("_draw"), F.col("_h"), F.col("_size")]
    stood = in_ranges(sized, [F.col("_source")], order, totals={"_upto": F.col("_size")})
    met = join_small(stood, known, F.col("_source").eqNullSafe(F.col("_source2")), "left")
    end = F.round("_target").cast("bigint")

    def copy(k: Column) -> Column:
        start = k * F.col("_words") + F.col("_upto") - F.col("_size")
        given = F.coalesce(F.try_divide(start.cast("double"), F.col("_target")), F.lit(0.0))
        at = None
        for i in reversed(range(len(schedules))):
            at = time_of(given, schedules[i]) if at is None else F.when(F.col("_schedule") == i, time_of(given, schedules[i])).otherwise(at)
        return F.struct(F.greatest(F.lit(0), F.least(F.col("_size"), end - start)).cast("bigint").alias("words"), at.alias("position"))

    copies = F.filter(F.array(*[copy(F.lit(k).cast("bigint")) for k in range(most)]), lambda c: c["words"] > 0)
    return met.select("row", "_draw", "_source", "_size", "_words", "_target", copies.alias("_copies"))


def curriculum(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", schedules: tuple = SCHEDULES, share: float = SHARE, most: int = MOST, seed: int = SEED
) -> DataFrame:
    """docs without their texts, with size, source_size, target, taken, n_copies, first_position and second_position,
    sorted by first_position in ranges (documents that aren't taken last).

    taken: the words that the mix takes of the document, copies counted. All copies are whole but the one in which the
    source's target ends, which is cut there, so that a source's words sum to its target, rounded. Null text: size 0,
    never taken. A null source is a source like others, the last in order. A document with a null id has its place by
    hash like others; repeated rows are documents of their own, each with its place. Empty tables give empty results, and
    so do texts without words: nothing taken. Columns of docs with the name of an added one are replaced.
    """
    out = planned(docs, id_col, text_col, source_col, False, schedules, share, most, seed)
    place = lambda k: F.get("_copies", F.lit(k)).getField("position")
    added = {
        "size": F.col("_size"),
        "source_size": F.col("_words"),
        "target": F.col("_target"),
        "taken": F.aggregate("_copies", F.lit(0).cast("bigint"), lambda a, c: a + c["words"]),
        "n_copies": F.size("_copies").cast("bigint"),
        "first_position": place(0),
        "second_position": place(1),
    }
    kept = [F.col("row").getField(f).alias(f) for f in out.schema["row"].dataType.names if f.lower() not in added]
    told = out.select(*kept, *[c.alias(k) for k, c in added.items()], F.col("_draw").alias("_d"))
    order = [F.col("first_position").asc_nulls_last(), F.col("_d")]
    return told.repartitionByRange(*order).sortWithinPartitions(*order).drop("_d")


def training_order(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", schedules: tuple = SCHEDULES, share: float = SHARE, most: int = MOST, seed: int = SEED
) -> DataFrame:
    """A row for each copy that the mix takes, with the columns of docs, position and words (all words of the text, or the
    number of them that the target leaves), sorted by position in ranges. Cases as in curriculum."""
    out = planned(docs, id_col, text_col, source_col, True, schedules, share, most, seed)
    each = out.select("row", "_draw", F.explode("_copies").alias("c"))
    kept = [F.col("row").getField(f).alias(f) for f in out.schema["row"].dataType.names if f.lower() not in ("position", "words")]
    told = each.select(*kept, F.col("c.position").alias("position"), F.col("c.words").alias("words"), F.col("_draw").alias("_d"))
    order = [F.col("position"), F.col("_d")]
    return told.repartitionByRange(*order).sortWithinPartitions(*order).drop("_d")


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("source")


ORACLE = r"""
with z as (
  select doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::bigint as size from documents
), s as (
  select source, sum(size)::bigint as words, (row_number() over (order by source nulls last) - 1) % 3 as k from z group by source
), w as (
  select source, words, k, [3.0, 1.0, 2.0][k + 1]::double as weight, 2 * words as cap, sum(words) over () as every from s
), filled as (
  select *, (1.5 * every - coalesce(sum(cap) over (order by cap / weight, source rows between unbounded preceding and 1 preceding), 0))::double
      / sum(weight) over (order by cap / weight, source rows between current row and unbounded following) as level from w
), t as (
  select source, words, k, least(weight * (select min_by(level, cap / weight) from filled where weight * level <= cap), cap::double) as target from filled
), p as (
  select z.doc_id, z.size, t.words, t.target, t.k, md5('11:' || z.doc_id) as d,
    sum(z.size) over (partition by z.source order by md5('11:' || z.doc_id), z.doc_id rows between unbounded preceding and current row) - z.size as before
  from z join t on z.source is not distinct from t.source
), c as (
  select doc_id, copy, greatest(0, least(size, round(target)::bigint - (copy * words + before)))::bigint as n, (copy * words + before) / target as g, k from p, (values (0), (1)) as v(copy)
), m as (
  select doc_id, copy, n, case k
    when 0 then least(greatest(g * 3.0, 0.0) * 2 / (sqrt(greatest(16.0 + greatest(g * 3.0, 0.0) * -4.0, 0.0)) + 4.0), 1.0)
    when 1 then least(g * 2 / (sqrt(0.25 + g * 2.0) + 0.5), 1.0)
    else case when g * 2.0 >= 1.0 then least(0.5 + greatest(g * 2.0 - 1.0, 0.0) * 2 / (sqrt(greatest(6.25 + greatest(g * 2.0 - 1.0, 0.0) * -4.0, 0.0)) + 2.5), 1.0)
         else least(g * 2.0 * 2 / (sqrt(2.25 + g * 2.0 * 4.0) + 1.5), 0.5) end
    end as due
  from c where n > 0
), f as (
  select doc_id, sum(n)::bigint as taken, count(*) as n_copies, min_by(due, copy) as first_position, max_by(due, copy) as last_position from m group by doc_id
)
select p.doc_id, p.size, p.words as source_size, p.target, coalesce(f.taken, 0) as taken, coalesce(f.n_copies, 0) as n_copies,
  f.first_position, case when f.n_copies = 2 then f.last_position end as second_position
from p left join f using (doc_id)
"""
