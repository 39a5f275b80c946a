"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, benchmark decontamination, BPE encoding.

Each stage works on all that its predecessor kept, and what it decides takes effect: rejected documents, removed lines,
copies and contaminated documents are gone for the next stage. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relcheck.llm.bpe import encode_corpus
from relcheck.llm.common import saved, table
from relcheck.llm.decontaminate import decontaminated
from relcheck.llm.jaccard_join import deduplicated
from relcheck.llm.line_dedup import line_dedup
from relcheck.llm.quality_rules import quality_rules


def with_text(docs: DataFrame, like: DataFrame, text: str) -> DataFrame:
    """The columns of like, with text in place of theirs and n_chars counted anew."""
    return docs.withColumn("text", F.col(text)).withColumn("n_chars", F.length("text").cast("bigint")).select(*like.columns)


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; the others lose their heavy lines."""
    return with_text(quality_rules(docs).where("kept"), docs, "clean_text")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines that earlier windows have; one that loses all of them stays as an empty text."""
    return with_text(line_dedup(docs), docs, "text")


def jaccard_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document stays."""
    return deduplicated(docs).select(*docs.columns)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which an item of the benchmark stands go."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Numbers of tokens and digests of what is left; a null or empty text has no tokens."""
    import public_tokenizers

    return encode_corpus(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("line_dedup", line_dedup_stage),
    ("jaccard_join", jaccard_join_stage),
    ("decontaminate", decontaminate_stage),
    ("bpe", bpe_stage),
]

#: SQL can't express BPE; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
