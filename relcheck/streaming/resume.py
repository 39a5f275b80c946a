"""Resumable work as streams (ST), and the hook for model calls (UD-01)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def resumed(jobs: DataFrame, key: str, process: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """ST-01: jobs (a stream) processed once a key and appended to a table as they come; a restart goes on from the
    checkpoint. A batch that was appended but not committed is appended again: its batch number tells, and readers keep
    the first row of a key."""

    def append(batch: DataFrame, number: int) -> None:
        process(batch).withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    return jobs.dropDuplicates([key]).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_negatives(judged: DataFrame, group: str, judgment: str, out: str, checkpoint: str, time: str | None = None, keep: str = "7 days") -> StreamingQuery:
    """ST-02: the first `no` of each group, appended to a table; later rows of the group are skipped. With a column of event
    time a group is remembered for `keep`, else for good."""
    negative = judged.where(F.col(judgment) == "no")
    once = negative.withWatermark(time, keep).dropDuplicatesWithinWatermark([group]) if time else negative.dropDuplicates([group])
    return once.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def until_target(jobs: DataFrame, key: str, process: Callable[[DataFrame], DataFrame], passes: Column, out: str, target: int, step: int) -> int:
    """ST-03: jobs in the order of their keys, `step` of them a round, processed and appended to a table until `target` rows
    of it pass or no job is left; what the table has from an earlier call isn't done again. Returns how many rows pass:
    fewer than the target means that more jobs are needed. A round's rows aren't appended twice: a key is a job once."""
    spark = jobs.sparkSession
    spark.createDataFrame([], process(jobs.limit(0)).schema).write.mode("append").parquet(out)
    while True:
        done = spark.read.parquet(out)
        good = done.where(passes).count()
        todo = jobs.join(done.select(key).distinct(), key, "left_anti").orderBy(key).limit(step)
        if good >= target or todo.isEmpty():
            return good
        process(todo).write.mode("append").parquet(out)


def scored(df: DataFrame, make: Callable[[], Callable[[pd.DataFrame], pd.Series]], output: str = "answer") -> DataFrame:
    """UD-01: a model as a table function. make() builds the scorer once a task; it gets batches and returns texts."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", {output} string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = make()
        for pdf in batches:
            yield pdf.assign(**{output: score(pdf)})

    return df.mapInPandas(run, schema)
