"""Joins of questions, answers and pools (JN). Big sides keep their partitioning; small dimensions are left to AQE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relcheck.functions.text import basename, canonical_id, exact_key, normal_relation, path_stem, phrase_lemma, too_alike
from relcheck.operators.ranges import spare
from relcheck.tables import saved, spread


def last_wins(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """SC-04: of rows with one key the last by order. An aggregate with partial maxima, no window."""
    best = F.max(F.struct(order.alias("o"), F.struct(*df.columns).alias("row"))).alias("best")
    return df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(best).select("best.row.*")


def first_wins(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """SO-04, WN-03: of rows with one key the first by order."""
    best = F.min(F.struct(order.alias("o"), F.struct(*df.columns).alias("row"))).alias("best")
    return df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(best).select("best.row.*")


def answered_questions(questions: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """JN-01, JN-02: all questions with their answers; `missing` tells those without one."""
    there = max(spare(questions), spare(answers)) + "found"
    return questions.join(answers.withColumn(there, F.lit(True)), key, "left").withColumn("missing", F.col(there).isNull()).drop(there)


def aliased_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner") -> DataFrame:
    """JN-03, JN-15: ids that are numbers on one side and text on the other; `qid` is the common spelling."""
    a = left.withColumn("qid", canonical_id(F.col(left_key)))
    b = right.withColumn("qid", canonical_id(F.col(right_key))).drop(right_key)
    return a.join(b, "qid", how)


def paired(gold: DataFrame, first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """JN-04: items that both runs answered. first and second have `pred` columns."""
    a = first.select(key, F.col("pred").alias("pred_a"))
    return gold.join(a, key).join(second.select(key, F.col("pred").alias("pred_b")), key)


def in_every_run(long: DataFrame, keys: list[str], run: str, runs: list[str], value: Column) -> DataFrame:
    """JN-05: one row for each key that every run has, with a column for each run; one shuffle instead of a chain of joins."""
    cells = [F.max(F.when(F.col(run) == r, value)).alias(r) for r in runs]
    return long.groupBy(*keys).agg(*cells).where(" and ".join(f"`{r}` is not null" for r in runs))


def zipped(left: DataFrame, right: DataFrame, order: str, identity: str) -> DataFrame:
    """JN-06: rows side by side by their ordinal; `same` tells whether both are there and are the same item."""
    a = left.select(F.col(order), F.col(identity).alias("left_id"))
    b = right.select(F.col(order), F.col(identity).alias("right_id"))
    return a.join(b, order, "full").withColumn("same", F.coalesce(F.col("left_id") == F.col("right_id"), F.lit(False)))


def checked_zip(left: DataFrame, right: DataFrame, order: str, identity: str) -> DataFrame:
    """JN-06 with the abort: fails if any pair isn't the same item."""
    out = zipped(left, right, order, identity)
    return out.where(F.coalesce(F.assert_true(F.col("same"), "rows side by side aren't the same item").isNull(), F.lit(True)))


def unprocessed(jobs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """JN-07: jobs that aren't done."""
    return jobs.join(done.select(key).distinct(), key, "left_anti")


def leakage_safe(pool: DataFrame, used: DataFrame, image: str) -> DataFrame:
    """JN-08: rows of pool whose image (by basename) isn't used."""
    taken = used.select(basename(F.col(image)).alias("_image")).distinct()
    return pool.join(taken, basename(F.col(image)) == F.col("_image"), "left_anti")


#: Terms that a vocabulary may have: its join to gold relations has a row for nearly every pair.
MAX_VOCABULARY = 100_000


def unlike_candidates(gold: DataFrame, relation: str, vocabulary: DataFrame, candidate: str) -> DataFrame:
    """JN-09: for each different gold relation the candidates that aren't too alike. Nearly all pairs are in the result, so
    the vocabulary has to be a dimension: one of more than MAX_VOCABULARY different terms is refused."""
    own, terms = gold.select(relation).distinct(), vocabulary.select(candidate).distinct()
    if terms.count() > MAX_VOCABULARY:
        raise ValueError(f"a vocabulary of more than {MAX_VOCABULARY} terms")
    return own.join(F.broadcast(terms), ~too_alike(F.col(relation), F.col(candidate)))


def synonym_index(groups: list[list[str]], spark: SparkSession) -> DataFrame:
    """term and grp of closed groups of synonyms, normalised: the inverted index that seen_level joins with."""
    rows = [(i, t) for i, g in enumerate(groups) for t in g]
    return spark.createDataFrame(rows, "grp long, term string").select("grp", normal_relation(F.col("term")).alias("term")).distinct()


def seen_level(df: DataFrame, term: str, known: DataFrame, known_term: str, groups: DataFrame | None = None) -> DataFrame:
    """JN-10: exact, lemma, synonym or unseen: the closest level at which known has the term; null terms stay null.

    groups (grp, term): groups of synonyms, which may overlap and aren't transitive. The groups that known has a term of are
    found by an equality join on terms, and so are the terms that share a group with one of them: no pair of terms is
    compared. Terms are looked up once each, however often they stand in df."""
    own = spare(df)
    n, found = own + "n", own + "seen"
    exact = known.select(exact_key(F.col(known_term)).alias("x")).where("x <> ''").distinct()
    lemmas = exact.select(phrase_lemma(F.col("x")).alias("y")).distinct()
    terms = spread(df.select(exact_key(F.col(term)).alias(n)).where(F.col(n) != ""), n).distinct().withColumn(own + "lemma", phrase_lemma(F.col(n)))
    told = terms.join(exact.withColumn("e", F.lit(True)), F.col(n) == F.col("x"), "left").join(lemmas.withColumn("l", F.lit(True)), F.col(own + "lemma") == F.col("y"), "left")
    told = told.select(n, "e", "l")
    if groups is not None:
        there = groups.join(exact, F.col("term") == F.col("x"), "left_semi").select("grp").distinct()
        hit = groups.join(there, "grp", "left_semi").select(F.col("term").alias("t")).distinct().withColumn("s", F.lit(True))
        told = told.join(hit, F.col(n) == F.col("t"), "left").drop("t")
    else:
        told = told.withColumn("s", F.lit(None).cast("boolean"))
    level = F.when(F.col("e"), "exact").when(F.col("l"), "lemma").when(F.col("s"), "synonym").otherwise("unseen")
    out = df.withColumn(n, exact_key(F.col(term))).join(told.select(F.col(n).alias(own + "m"), level.alias(found)), F.col(n) == F.col(own + "m"), "left")
    return out.select(*df.columns, F.when(F.col(term).isNotNull(), F.coalesce(found, F.lit("unseen"))).alias("seen_at"))


#: Rows of a task in which pairs are compared.
PAIR_ROWS = 250_000
#: Rows of a pair that are compared with each other in one piece; a pair of more is cut into blocks of about as many.
BLOCK_ROWS = 4_000
#: Numbers by hash that pairs are counted under first, since most tables have no frequent pair.
BUCKETS = 65_536


def frequent_pairs(rows: DataFrame, pair: list[str], own: str) -> DataFrame:
    """The pairs of more than BLOCK_ROWS rows, with their numbers of rows and blocks (columns with the prefix own). Only pairs
    that share a bucket of so many rows are counted one by one."""
    n, bucket = own + "n", F.pmod(F.xxhash64(*pair), F.lit(BUCKETS))
    many = F.col(n) > BLOCK_ROWS
    full = rows.groupBy(bucket.alias(own + "bucket")).agg(F.count(F.lit(1)).alias(n)).where(many)
    found = rows.join(F.broadcast(full), bucket == F.col(own + "bucket"), "left_semi").groupBy(*pair).agg(F.count(F.lit(1)).alias(n)).where(many)
    return saved(found.withColumn(own + "blocks", F.ceil(F.col(n) / BLOCK_ROWS)))


def same_pair_elsewhere(df: DataFrame, pair: list[str], group: str, value: str) -> DataFrame:
    """JN-11: rows of one pair in different groups of which the other doesn't have the row's value at all: each row meets every
    different row of its pair. A null value is one that no other group has; rows with a null in pair or group meet none.

    Rows are dealt once, to tasks of about PAIR_ROWS, and all that follows stays within these tasks. A frequent pair's groups
    are dealt to blocks by hash, and each two blocks (also a block and itself) are a cell that is compared by itself: rows go
    to the cells of their block, so a frequent pair is spread over many tasks and none holds its square."""
    rows = df.select(*pair, group, value).where(" and ".join(f"`{c}` is not null" for c in [*pair, group]))
    own = spare(rows)
    spark, home, low, high, known = df.sparkSession, own + "home", own + "low", own + "high", own + "known"
    frequent = frequent_pairs(rows, pair, own)
    copies = frequent.agg(F.coalesce(F.sum(F.col(own + "n") * (F.col(own + "blocks") - 1)), F.lit(0))).first()[0]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism, (df.count() + copies) // PAIR_ROWS)
    # Frequent pairs are at most one for BLOCK_ROWS rows.
    blocks = F.coalesce(own + "blocks", F.lit(1))
    placed = rows.join(F.broadcast(frequent.drop(own + "n")), pair, "left").withColumn(home, F.pmod(F.xxhash64(group), blocks))
    met = placed.withColumn(own + "other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    met = met.select(*rows.columns, home, F.least(home, own + "other").alias(low), F.greatest(home, own + "other").alias(high))
    cell = [*pair, low, high]
    dealt = met.repartition(tasks, *cell)
    others = dealt.distinct().withColumn(known, F.collect_set(value).over(Window.partitionBy(*cell, group)))
    others = others.withColumnsRenamed({group: f"other_{group}", value: f"other_{value}", home: own + "away"})
    # Rows of one block meet in the cell of that block alone. Spark doesn't see how many rows the blocks make: no broadcast.
    once = (F.col(low) == F.col(high)) | (F.col(home) != F.col(own + "away"))
    met = dealt.join(others.hint("merge"), cell).where(once & (F.col(group) != F.col(f"other_{group}")))
    return met.where(~F.coalesce(F.array_contains(known, F.col(value)), F.lit(False))).select(*rows.columns, f"other_{group}", f"other_{value}")


def content_safe(candidates: DataFrame, benchmark: DataFrame, content: str, name: str | None = None) -> DataFrame:
    """JN-12: candidates whose content (by SHA-256) and, if told, name the benchmark doesn't have. A candidate without content
    (one that can't be read) goes too, as soon as the benchmark has any content. Names are paths: a basename or its stem, in
    any case, that equals a basename or a stem of the benchmark goes."""
    d, n = spare(candidates) + "d", spare(candidates) + "n"
    digest = lambda: F.coalesce(F.sha2(F.col(content).cast("binary"), 256), F.lit("unreadable"))
    known = benchmark.where(F.col(content).isNotNull()).select(F.explode(F.array(digest(), F.lit("unreadable"))).alias(d)).distinct()
    out = candidates.join(known, digest() == F.col(d), "left_anti")
    if name:
        parts = lambda: (F.lower(basename(F.col(name))), F.lower(path_stem(F.col(name))))
        names = benchmark.select(F.explode(F.array(*parts())).alias(n)).where(F.col(n).isNotNull()).distinct()
        for part in parts():
            out = out.join(names, part == F.col(n), "left_anti")
    return out


def strict_lookup(df: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """JN-13: a lookup that must succeed: fails if the dimension lacks a key."""
    there = max(spare(df), spare(dimension)) + "found"
    found = df.join(dimension.withColumn(there, F.lit(True)), key, "left")
    return found.where(F.when(F.col(there).isNull(), F.raise_error(F.concat(F.lit("no such key: "), F.col(key).cast("string"))).cast("boolean")).otherwise(True)).drop(there)


def agreement(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """JN-14: one row: missing on the right, invalid (null) there, compared, agreeing."""
    b = right.select(key, F.col(value).alias("_other"), F.lit(True).alias("_found"))
    met = left.select(key, value).join(b, key, "left")
    return met.agg(
        F.count_if(F.col("_found").isNull()).alias("missing"),
        F.count_if(F.col("_found") & F.col("_other").isNull()).alias("invalid"),
        F.count_if(F.col("_other").isNotNull()).alias("compared"),
        F.count_if(F.coalesce(F.col(value) == F.col("_other"), F.lit(False))).alias("agreeing"),
    )


def set_audit(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """AG-21, SO-02: sizes of both sets of keys, their union, intersection and differences, by one aggregate."""
    both = a.select(key).distinct().withColumn("_a", F.lit(1)).withColumn("_b", F.lit(0)).unionByName(b.select(key).distinct().withColumn("_a", F.lit(0)).withColumn("_b", F.lit(1)))
    per_key = both.groupBy(key).agg(F.max("_a").alias("a"), F.max("_b").alias("b"))
    n = lambda c: F.count_if(c)
    a_, b_ = F.col("a") == 1, F.col("b") == 1
    return per_key.agg(n(a_).alias("n_a"), n(b_).alias("n_b"), F.count(F.lit(1)).alias("n_union"), n(a_ & b_).alias("n_both"), n(a_ & ~b_).alias("only_a"), n(b_ & ~a_).alias("only_b"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """SO-03: one row: whether a and b are equal as multisets and as sets."""
    cols = a.columns
    count = a.select(*cols, F.lit(1).alias("_s")).unionByName(b.select(*cols, F.lit(-1).alias("_s"))).groupBy(*cols).agg(F.sum("_s").alias("s"), F.min("_s").alias("low"), F.max("_s").alias("high"))
    return count.agg((F.count_if(F.col("s") != 0) == 0).alias("same_multiset"), (F.count_if(F.col("low") == F.col("high")) == 0).alias("same_set"))


def first_negatives_of(judged: DataFrame, source: DataFrame, key: str, judgment: str, rank: str, order: str) -> DataFrame:
    """JN-16: source rows with their first `no` in judged: the least rank (null: 99), then order. Judgments without a source
    row, and source rows without a `no`, go. Columns of judged are prefixed with negative_."""
    rest = F.struct(*[F.col(c).alias(f"negative_{c}") for c in judged.columns if c != key])
    best = judged.where(F.col(judgment) == "no").groupBy(key).agg(F.min_by(rest, F.struct(F.coalesce(F.col(rank), F.lit(99)), order)).alias("_no"))
    return source.join(best, key).select(*source.columns, "_no.*")
