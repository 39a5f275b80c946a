"""Single-document sinks (SC-11, SC-15): a table as one JSON document or one Markdown report.

A Python data source writer with two phases: each task writes its rows as text to a part file of its own, and the commit
joins the parts of the tasks that succeeded, in the order of partitions, to one file that is renamed into place. Until
then an older document stays; after a failure the parts go and it is still there. Rows aren't held in memory, neither in
tasks nor in the driver, and there is no limit to them. The path has to be one that driver and executors see.
"""

from __future__ import annotations

import glob
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class Part(WriterCommitMessage):
    partition: int
    path: str
    rows: int


class DocumentSource(DataSource):
    """Options: path, form (json, json_object or markdown), title (of a Markdown section)."""

    @classmethod
    def name(cls) -> str:
        return "single_document"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return DocumentWriter(self.options["path"].removeprefix("file://"), self.options.get("form", "json"), [f.name for f in schema.fields], self.options.get("title"))


class DocumentWriter(DataSourceWriter):
    def __init__(self, path: str, form: str, columns: list[str], title: str | None):
        if form not in ("json", "json_object", "markdown"):
            raise ValueError(f"no such form: {form}")
        self.path, self.form, self.columns, self.title, self.run = path, form, columns, title, uuid.uuid4().hex

    def line(self, row) -> str:
        if self.form == "markdown":
            cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
            return "| " + " | ".join(cell(v) for v in row) + " |"
        whole = json.dumps(row.asDict(recursive=True), ensure_ascii=False, indent=2, default=str)
        return whole if self.form == "json_object" else "  " + whole.replace("\n", "\n  ")

    def write(self, rows: Iterator) -> Part:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        os.makedirs(os.path.dirname(self.path) or ".", exist_ok=True)
        path, n = f"{self.path}.{self.run}.{uuid.uuid4().hex}.part", 0
        with open(path, "w", encoding="utf-8") as f:
            for row in rows:
                f.write((("\n" if self.form == "markdown" else ",\n") if n else "") + self.line(row))
                n += 1
        return Part(number, path, n)

    def commit(self, messages: list) -> None:
        parts = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.partition)
        if self.form == "json_object" and sum(m.rows for m in parts) != 1:
            self.abort(messages)
            raise ValueError("a single object takes a table of one row")
        between = "\n" if self.form == "markdown" else ",\n"
        head = {"json": "[\n" if parts else "[", "json_object": ""}.get(self.form)
        if head is None:
            head = (f"## {self.title}\n\n" if self.title else "") + "| " + " | ".join(self.columns) + " |\n|" + "---|" * len(self.columns) + "\n"
        whole = f"{self.path}.{self.run}.whole"
        os.makedirs(os.path.dirname(self.path) or ".", exist_ok=True)
        with open(whole, "w", encoding="utf-8") as out:
            out.write(head)
            for k, m in enumerate(parts):
                out.write(between if k else "")
                with open(m.path, encoding="utf-8") as f:
                    shutil.copyfileobj(f, out)
            out.write(("\n]\n" if parts else "]\n") if self.form == "json" else "\n" if parts else "")
        os.replace(whole, self.path)
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        for leftover in glob.glob(f"{glob.escape(self.path)}.{self.run}.*"):
            os.remove(leftover)


def write_document(df: DataFrame, path: str, form: str = "json", title: str | None = None) -> None:
    """SC-11, SC-15: df in its order as one document: json (a pretty array), json_object (one row, an object) or markdown."""
    df.sparkSession.dataSource.register(DocumentSource)
    writer = df.write.format("single_document").mode("overwrite").option("path", path).option("form", form)
    (writer.option("title", title) if title else writer).save()


def write_report(sections: list[tuple[str, DataFrame]], path: str, title: str) -> None:
    """SC-15: a Markdown report with a section for each (title, table), all rows of each, renamed into place at the end."""
    run = uuid.uuid4().hex
    parts = [f"{path}.{run}.{k}" for k in range(len(sections))]
    try:
        for (name, df), part in zip(sections, parts, strict=True):
            write_document(df, part, "markdown", name)
        with open(f"{path}.{run}", "w", encoding="utf-8") as out:
            out.write(f"# {title}\n")
            for part in parts:
                out.write("\n")
                with open(part, encoding="utf-8") as f:
                    shutil.copyfileobj(f, out)
        os.replace(f"{path}.{run}", path)
    finally:
        for leftover in glob.glob(f"{glob.escape(path)}.{run}*"):
            os.remove(leftover)
