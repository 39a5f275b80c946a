"""Quality rules (DataFrame functions only): per-document counts, and lines that too many documents of a host share.

The method: each document's lines are normalised and hashed; a line is heavy in a host if it stands in `max_docs` of the
host's distinct documents or more, or, in smaller hosts, in at least `share` of them and at least `min_docs`. Heavy lines
are removed, and a document that loses more than half of its words that way is depleted and rejected.

Lines are joined to the heavy ones by host and key, so that nothing is gathered for a host; where the heavy lines are too
many to broadcast, Spark splits the partitions of lines that stand in very many documents. Only documents that have heavy
lines then have their texts rewritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relcheck.llm.common import join_small, let, packed, same_row, saved, table, unpacked

SPACES = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
REPEATED_SHARE = 50  # per cent of the words


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def trigram_hashes(ws: Column) -> Column:
    some = F.transform(F.slice(ws, 1, F.size(ws) - 2), lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)))
    return F.when(F.size(ws) >= 3, some).otherwise(F.array().cast("array<bigint>"))


def repeated_words(ws: Column) -> Column:
    """Words that stand in a 3-word window which the text holds twice or more."""

    def covered(grams: Column) -> Column:
        by_hash = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        places = lambda s: F.sort_array(F.transform(F.filter(s, lambda x, j: (x.h == F.get(s, j - 1).h) | (x.h == F.get(s, j + 1).h)), lambda x: x.i))
        steps = lambda p: F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3))))
        return let(by_hash, lambda s: let(places(s), lambda p: F.aggregate(steps(p), F.lit(0), lambda a, x: a + x)))

    return let(trigram_hashes(ws), lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), covered(g)).otherwise(0))


def normalised_lines(text: Column) -> Column:
    """Lower case, every digit as 0, no space around; one entry for each \\n-split line."""
    return F.transform(F.split(F.regexp_replace(F.lower(text), "[1-9]", "0"), "\n"), lambda x: F.trim(x))


def line_key(line: Column) -> Column:
    """128 bits of a normalised line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(7), line).alias("b"))


def heavy_lines(base: DataFrame, share: float, min_docs: int, max_docs: int) -> DataFrame:
    """_id2, _h2, _host2, _heavy: the documents with heavy lines of their host, and the keys of those lines.

    Works on the documents' line keys alone, which are written once. Copies of one text in a host count once."""
    lines = F.array_distinct(F.filter(normalised_lines(F.col("_text")), lambda x: x != ""))
    keys = saved(base.select("_id", "_h", "_host", F.transform(lines, line_key).alias("_keys")))
    each = keys.select("_id", "_h", "_host", F.explode("_keys").alias("_k"))
    counted = each.groupBy("_host", "_k").agg(F.count_distinct("_h").alias("_n")).where(F.col("_n") >= min(min_docs, max_docs))
    hosts = saved(keys.groupBy(F.col("_host").alias("_host2")).agg(F.count_distinct("_h").alias("_docs")))
    often = (F.col("_n") >= max_docs) | ((F.col("_n") >= min_docs) & (F.col("_n") >= share * F.col("_docs")))
    heavy = join_small(counted, hosts, F.col("_host").eqNullSafe(F.col("_host2")), "inner").where(often)
    heavy = saved(heavy.select("_host2", F.col("_k").alias("_k2")))
    met = join_small(each, heavy, F.col("_host").eqNullSafe(F.col("_host2")) & (F.col("_k") == F.col("_k2")), "inner")
    own = met.groupBy("_id", "_h", "_host").agg(F.collect_set("_k").alias("_heavy"))
    return saved(own.select(F.col("_id").alias("_id2"), F.col("_h").alias("_h2"), F.col("_host").alias("_host2"), "_heavy"))


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", share: float = 0.1, min_docs: int = 20, max_docs: int = 1000
) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (bigint), base_failed, n_heavy_lines,
    n_heavy_words, clean_text (the text without heavy lines) and kept.

    kept is false if base_failed (under 50 words, or over half of the words in repeated 3-word windows) or if heavy lines
    hold over half of the words. Null text: counts of 0, clean_text '', rejected. A null host is a host like others. Ids
    aren't used: repeated rows get equal results. Empty tables give empty results; extra columns stay.
    """
    base = packed(docs, id_col, text_col).withColumn("_host", F.col("row").getField(host_col).cast("string"))
    heavy = heavy_lines(base.drop("row"), share, min_docs, max_docs)
    met = join_small(base, heavy, same_row(base, heavy) & F.col("_host").eqNullSafe(F.col("_host2")), "left")
    text = F.col("_text")
    kept_lines = F.filter(
        F.arrays_zip(F.split(text, "\n").alias("l"), normalised_lines(text).alias("n")),
        lambda x: ~F.array_contains(F.col("_heavy"), line_key(x.n)),
    )
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE))
    stats = met.select(
        "row",
        "_text",
        let(words_of(text), lambda ws: F.struct(F.size(ws).cast("bigint").alias("n"), repeated_words(ws).cast("bigint").alias("r"))).alias("_w"),
        F.length(F.regexp_replace(F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit("\n"), F.lit("")), SPACES, "")).cast("bigint").alias("_chars"),
        F.length(F.regexp_replace(text, f"[^{SYMBOLS}]++", "")).cast("bigint").alias("_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("_dup"),
        F.when(F.col("_heavy").isNull(), text).otherwise(F.array_join(F.transform(kept_lines, lambda x: x.l), "\n")).alias("_clean"),
    )
    n, changed = F.col("_w.n"), F.col("_clean") != F.col("_text")
    count = lambda c, pattern: F.size(F.split(c, pattern))
    cut = stats.select(
        "*",
        F.when(changed, n - F.size(words_of(F.col("_clean")))).otherwise(0).cast("bigint").alias("_cut_words"),
        F.when(F.col("_clean") == "", count(F.col("_text"), "\n")).when(changed, count(F.col("_text"), "\n") - count(F.col("_clean"), "\n")).otherwise(0).cast("bigint").alias("_cut_lines"),
    )
    failed = (n < MIN_WORDS) | (100 * F.col("_w.r") > REPEATED_SHARE * n)
    return unpacked(
        cut,
        {
            "n_words": n,
            "word_chars": F.col("_chars"),
            "n_symbols": F.col("_symbols"),
            "n_dup_lines": F.col("_dup"),
            "n_repeat_words": F.col("_w.r"),
            "base_failed": failed,
            "n_heavy_lines": F.col("_cut_lines"),
            "n_heavy_words": F.col("_cut_words"),
            "clean_text": F.col("_clean"),
            "kept": ~failed & (2 * F.col("_cut_words") <= n),
        },
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_heavy_lines", "n_heavy_words")


ORACLE = r"""
with d as (
  select doc_id, source, coalesce(text, '') as t from documents
), w as (
  select doc_id, source, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls,
         string_split(t, chr(10)) as raw,
         list_transform(string_split(translate(lower(t), '123456789', '000000000'), chr(10)), lambda x: trim(x, ' ')) as norm
  from d
), grams as (
  select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g
  from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w where len(ws) >= 3)
), twice as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from grams) where c > 1
), repeated as (
  select doc_id, count(distinct p) as r from (select doc_id, unnest([i, i + 1, i + 2]) as p from twice) group by doc_id
), hosts as (
  select source, count(distinct t) as n_docs from d group by source
), per_line as (
  select source, line, count(distinct t) as n
  from (select source, t, unnest(list_distinct(list_filter(norm, lambda x: x <> ''))) as line from w) group by source, line
), heavy as (
  select p.source, list(p.line) as hs from per_line p join hosts h on p.source is not distinct from h.source
  where p.n >= 1000 or (p.n >= 20 and p.n >= 0.1 * h.n_docs) group by p.source
), parts as (
  select w.doc_id, w.t, len(w.ws) as n_words, coalesce(r.r, 0) as n_repeat_words, len(w.ls) - len(list_distinct(w.ls)) as n_dup_lines,
         list_filter(w.raw, lambda x, i: list_contains(h.hs, w.norm[i])) as cut
  from w left join repeated r using (doc_id) left join heavy h on w.source is not distinct from h.source
), counted as (
  select *, len(list_filter(string_split_regex(array_to_string(cut, chr(10)), '[\x20\x09-\x0D]+'), lambda x: x <> '')) as cut_words from parts
)
select doc_id, n_words::bigint as n_words,
  length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
  n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words,
  (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
  (not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and 2 * coalesce(cut_words, 0) <= n_words) as kept,
  coalesce(len(cut), 0)::bigint as n_heavy_lines, coalesce(cut_words, 0)::bigint as n_heavy_words
from counted
"""
