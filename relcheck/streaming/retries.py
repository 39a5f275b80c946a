"""Generate, filter by rules and verify, with retries (UD-02): a bounded loop whose attempts are a table.

The table has a row for each (id, attempt). A round takes the ids that have neither passed nor been tried in that round,
so a call that was stopped goes on where it ended, and a round costs what still fails. Models are hooks: functions from
DataFrame to DataFrame, such as resume.scored makes them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relcheck.functions.answers import plausibility, yes_no_uncertain
from relcheck.functions.text import candidate_list, json_answer, normal_relation, statement
from relcheck.operators.rules import recovered_relation, rejection, teacher_gate

Step = Callable[[DataFrame], DataFrame]


def retried(jobs: DataFrame, key: str, process: Step, passes: Column, out: str, attempts: int) -> DataFrame:
    """The table of attempts in out, filled up: process gets jobs with a column attempt (0, 1, ...) and returns a row for
    each with at least key and attempt; passes tells of such a row whether it is fine. No id is tried more than `attempts`
    times. Repeated keys of jobs are one job; null keys are none."""
    spark = jobs.sparkSession
    jobs = jobs.where(F.col(key).isNotNull()).dropDuplicates([key])
    spark.createDataFrame([], process(jobs.limit(0).withColumn("attempt", F.lit(0))).schema).write.mode("append").parquet(out)
    for n in range(attempts):
        done = spark.read.parquet(out)
        closed = done.where(passes | (F.col("attempt") >= n)).select(key).distinct()
        todo = jobs.join(closed, key, "left_anti")
        if todo.isEmpty():
            continue
        process(todo.withColumn("attempt", F.lit(n))).write.mode("append").parquet(out)
    return spark.read.parquet(out)


def outcomes(tried: DataFrame, key: str, passes: Column, reason: str) -> DataFrame:
    """key, n_attempts, ok, attempt (the first that passed) and drop_reason (of the last one, where none passed)."""
    best = tried.groupBy(key).agg(F.count_distinct("attempt").alias("n_attempts"), F.min(F.when(passes, F.col("attempt"))).alias("attempt"), F.max_by(reason, "attempt").alias("_r"))
    return best.select(key, "n_attempts", F.col("attempt").isNotNull().alias("ok"), "attempt", F.when(F.col("attempt").isNull(), F.col("_r")).alias("drop_reason"))


def candidates_of(answers: DataFrame, key: str) -> DataFrame:
    """A row for each candidate in an answer: key, attempt, gold, subject, object, rank, relation (recovered where it was
    empty or an entity), told, rendered and status: duplicate, a rule's or a flag's name, or null if it may be verified."""
    listed = answers.withColumn("_c", candidate_list(json_answer(F.col("raw"))["object"]))
    each = listed.select(key, "attempt", "gold", "subject", "object", F.posexplode("_c").alias("rank", "c"))
    each = each.withColumn("relation", recovered_relation(F.col("c.relation"), F.col("c.statement"), F.col("subject"), F.col("object")))
    first = each.groupBy(key, "attempt", normal_relation(F.col("relation")).alias("_norm")).agg(F.min("rank").alias("_first"))
    each = each.withColumn("_norm", normal_relation(F.col("relation"))).join(first, [key, "attempt", "_norm"])
    status = F.coalesce(
        F.when(F.col("rank") > F.col("_first"), "duplicate"),
        rejection(F.col("gold"), F.col("relation"), F.col("subject"), F.col("object")),
        teacher_gate(F.col("c.linguistically_plausible"), F.col("c.visually_supported"), F.col("c.confidence")),
    )
    rendered = statement(F.col("subject"), F.col("relation"), F.col("object"))
    return each.select(key, "attempt", "gold", "subject", "object", "rank", "relation", F.col("c.confidence").alias("confidence"), F.col("c.statement").alias("told"), rendered.alias("rendered"), status.alias("status"))


def generated(generate: Step, judge_text: Step | None, judge_image: Step | None, key: str) -> Step:
    """The process of retried() for jobs with key, gold, subject and object: generate adds raw, the judges add text_raw and
    visual_raw to candidates. A row for each (key, attempt): n_candidates, relation, rank and reason (null: selected).

    Candidates that may be verified are taken with high confidence first, then by rank; the first that is plausible as text
    and not supported by the image is selected. Null raw is inference_error; an answer without candidates is
    json_parse_error; else the reason is no_high_confidence_candidate."""

    def process(jobs: DataFrame) -> DataFrame:
        answers = generate(jobs).select(key, "attempt", "gold", "subject", "object", "raw")
        each = candidates_of(answers, key)
        pending = each.where("status is null")
        fine = F.lit(True)
        if judge_text:
            pending, fine = judge_text(pending), fine & (plausibility(F.col("text_raw")) == "plausible")
        if judge_image:
            pending, fine = judge_image(pending), fine & (yes_no_uncertain(F.col("visual_raw")) == "no")
        order = F.struct((F.col("confidence") != "high").alias("second"), F.col("rank").alias("rank"))
        won = pending.where(fine).groupBy(key, "attempt").agg(F.min_by(F.struct("relation", "rank"), order).alias("won"))
        counted = each.groupBy(key, "attempt").agg(F.count(F.lit(1)).alias("n_candidates"))
        out = answers.select(key, "attempt", F.col("raw").isNull().alias("_failed")).join(counted, [key, "attempt"], "left").join(won, [key, "attempt"], "left")
        reason = F.when(F.col("_failed"), "inference_error").when(F.col("n_candidates").isNull(), "json_parse_error").when(F.col("won").isNull(), "no_high_confidence_candidate")
        return out.select(key, "attempt", F.coalesce("n_candidates", F.lit(0)).cast("bigint").alias("n_candidates"), "won.relation", F.col("won.rank").alias("rank"), reason.alias("reason"))

    return process
