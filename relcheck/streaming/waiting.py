"""A stream of files that are complete (ST-04): a Python streaming source that polls a folder and hands on each file once.

A file is complete when a marker file stands beside it (its name and a suffix), or, without markers, when it hasn't been
changed for a while. Complete files are written to a log in the order they are found, and offsets are places in that log:
a batch that runs again gets the files it had, and a restart goes on where the last one ended.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


@dataclass
class OneFile(InputPartition):
    path: str


class WaitingSource(DataSource):
    """Rows of file, ord (the line's number from 0) and value. Options: path (a folder that driver and executors see), log (a
    file of the driver's that outlives it), suffix (of files), marker (suffix of markers; '' for none), quiet (seconds
    without change, where there are no markers)."""

    @classmethod
    def name(cls) -> str:
        return "complete_files"

    def schema(self) -> str:
        return "file string, ord long, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return WaitingReader(dict(self.options))


class WaitingReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.log = options["path"].removeprefix("file://"), options["log"]
        self.suffix, self.marker = options.get("suffix", ""), options.get("marker", "")
        self.quiet = float(options.get("quiet", 5))

    def logged(self) -> list[str]:
        if not os.path.exists(self.log):
            return []
        with open(self.log, encoding="utf-8") as f:
            return [json.loads(line) for line in f if line.endswith("\n")]

    def complete(self, path: str) -> bool:
        if self.marker:
            return os.path.exists(path + self.marker)
        return time.time() - os.stat(path).st_mtime >= self.quiet

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        known = self.logged()
        seen, new = set(known), []
        for name in sorted(os.listdir(self.folder)):
            path = os.path.join(self.folder, name)
            marker = bool(self.marker) and name.endswith(self.marker)
            if path not in seen and name.endswith(self.suffix) and not marker and os.path.isfile(path) and self.complete(path):
                new.append(path)
        if new:
            text = "".join(json.dumps(p) + "\n" for p in [*known, *new])
            with open(self.log + ".new", "w", encoding="utf-8") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            os.replace(self.log + ".new", self.log)
        return {"files": len(known) + len(new)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [OneFile(p) for p in self.logged()[start["files"] : end["files"]]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.path, encoding="utf-8") as f:
            for k, line in enumerate(f):
                yield partition.path, k, line.rstrip("\n")

    def commit(self, end: dict) -> None:
        """Nothing to do: the log stays, so that a file is never handed on again."""


def complete_files(spark: SparkSession, path: str, log: str, suffix: str = "", marker: str = "", quiet: float = 5) -> DataFrame:
    """ST-04: a stream of the lines of files in path, each file once and only when it is complete; see WaitingSource."""
    spark.dataSource.register(WaitingSource)
    reader = spark.readStream.format("complete_files").option("path", path).option("log", log).option("suffix", suffix)
    return reader.option("marker", marker).option("quiet", quiet).load()
