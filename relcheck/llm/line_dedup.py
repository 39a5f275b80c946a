"""Line dedup: overlapping windows of three consecutive lines, found again anywhere in the corpus, are removed.

Every window of three lines is hashed to 128 bits. A window's first occurrence, by (id, hash of the text, line), stays;
each later occurrence covers its three lines, and covered lines are removed. Only the windows' hashes are shuffled:
grouped with partial aggregates for the first occurrence, then joined back, where Spark splits skewed keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relcheck.llm.common import join_small, let, packed, same_row, saved, table, unpacked

NOT_SPACE = r"[^\x20\x09-\x0D]"


def windows_of(lines: Column) -> Column:
    """array<struct<j, a, b>>: first line and key of each window of three lines that aren't all blank."""

    def window(x: Column, j: Column, ls: Column) -> Column:
        y, z = F.get(ls, j + 1), F.get(ls, j + 2)
        full = x.rlike(NOT_SPACE).cast("int") + y.rlike(NOT_SPACE).cast("int") + z.rlike(NOT_SPACE).cast("int")
        return F.when(full >= 1, F.struct(j.alias("j"), F.xxhash64(x, y, z).alias("a"), F.xxhash64(F.lit(7), x, y, z).alias("b")))

    return let(lines, lambda ls: F.when(F.size(ls) >= 3, F.filter(F.transform(F.slice(ls, 1, F.size(ls) - 2), lambda x, j: window(x, j, ls)), lambda w: w.isNotNull())))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text column holding what stays, and n_lines, n_removed_lines (bigint) appended.

    Lines are split at \\n and compared as they are. Null text: one empty line, stays null. Documents under three lines
    are left alone. Null ids come first in the order of occurrences. Repeated rows (same id, same text) are one document:
    they don't remove each other. A document that loses all lines gets ''. Empty tables give empty results.
    """
    base = packed(docs, id_col, text_col)
    windows = saved(base.select("_id", "_h", F.explode(windows_of(F.split("_text", "\n"))).alias("w")).select("_id", "_h", "w.*"))
    place = F.struct("_id", "_h", "j")
    first = windows.groupBy("a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = first.select(F.col("a").alias("a2"), F.col("b").alias("b2"), "first")
    later = windows.join(first, (F.col("a") == F.col("a2")) & (F.col("b") == F.col("b2"))).where(place > F.col("first"))
    covered = saved(later.groupBy(F.col("_id").alias("_id2"), F.col("_h").alias("_h2")).agg(F.collect_set("j").alias("_js")))
    met = join_small(base, covered, same_row(base, covered), "left")
    lines = F.split("_text", "\n")
    kept = lambda ls: F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.flatten(F.transform("_js", lambda j: F.array(j, j + 1, j + 2))))
    text = let(lines, lambda ls: let(kept(ls), lambda k: F.struct(F.array_join(F.transform(k, lambda i: F.get(ls, i)), "\n").alias("t"), F.size(k).alias("k"))))
    out = met.select("row", F.size(lines).cast("bigint").alias("_n"), F.when(F.col("_js").isNotNull(), text).alias("_kept"))
    return unpacked(
        out,
        {
            text_col: F.coalesce(F.col("_kept.t"), F.col("row").getField(text_col).cast("string")),
            "n_lines": F.col("_n"),
            "n_removed_lines": F.coalesce(F.col("_n") - F.col("_kept.k"), F.lit(0)).cast("bigint"),
        },
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = r"""
with l as (
  select doc_id, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents
), win as (
  select doc_id, i, line as x, lead(line, 1) over o as y, lead(line, 2) over o as z from l window o as (partition by doc_id order by i)
), good as (
  select doc_id, i, x, y, z from win where z is not null
    and (regexp_matches(x, '[^\x20\x09-\x0D]')::int + regexp_matches(y, '[^\x20\x09-\x0D]')::int + regexp_matches(z, '[^\x20\x09-\x0D]')::int) >= 1
), later as (
  select doc_id, i from (select doc_id, i, row_number() over (partition by x, y, z order by doc_id, i) as r from good) where r > 1
), gone as (
  select distinct doc_id, unnest([i, i + 1, i + 2]) as i from later
), kept as (
  select l.doc_id, count(*) as n_lines, count(g.i) as n_removed_lines,
         coalesce(string_agg(l.line, chr(10) order by l.i) filter (g.i is null), '') as text
  from l left join gone g on l.doc_id = g.doc_id and l.i = g.i group by l.doc_id
)
select d.doc_id, k.text, coalesce(k.n_lines, 1)::bigint as n_lines, coalesce(k.n_removed_lines, 0)::bigint as n_removed_lines
from documents d left join kept k using (doc_id)
"""
