"""Members of ZIP archives as rows (SC-18): a Python data source whose partitions are members of the central directory."""

from __future__ import annotations

import glob
import os
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of members, uncompressed, that a task reads.
PARTITION_BYTES = 64 << 20


@dataclass
class Members(InputPartition):
    archive: str
    names: tuple[str, ...]


@dataclass
class Broken(InputPartition):
    archive: str
    error: str


class ZipSource(DataSource):
    """Rows of archive, name, size, crc32, ok, error, content. A member that can't be read or whose CRC differs is a row with
    ok false, the error, and no content; so is an archive without a readable central directory (name null). Folders are
    left out. Options: path (a file, folder or pattern that all executors see), partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return "archive string, name string, size long, crc32 long, ok boolean, error string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return ZipReader(self.options["path"], int(self.options.get("partitionBytes", PARTITION_BYTES)))


class ZipReader(DataSourceReader):
    def __init__(self, path: str, most: int):
        path = path.removeprefix("file://")
        self.archives, self.most = sorted(glob.glob(os.path.join(path, "*.zip") if os.path.isdir(path) else path)), most

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for archive in self.archives:
            try:
                with zipfile.ZipFile(archive) as z:
                    names, size = [], 0
                    for info in z.infolist():
                        if info.is_dir():
                            continue
                        if names and size + info.file_size > self.most:
                            out.append(Members(archive, tuple(names)))
                            names, size = [], 0
                        names.append(info.filename)
                        size += info.file_size
                    if names:
                        out.append(Members(archive, tuple(names)))
            except (OSError, zipfile.BadZipFile) as e:
                out.append(Broken(archive, str(e)))
        return out or [Members("", ())]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import zlib

        if isinstance(partition, Broken):
            yield partition.archive, None, None, None, False, partition.error, None
            return
        if not partition.names:
            return
        with zipfile.ZipFile(partition.archive) as z:
            for name in partition.names:
                info = z.getinfo(name)
                try:
                    yield partition.archive, name, info.file_size, info.CRC, True, None, z.read(name)  # read() checks the CRC
                except (OSError, RuntimeError, EOFError, zipfile.BadZipFile, NotImplementedError, zlib.error) as e:
                    yield partition.archive, name, info.file_size, info.CRC, False, str(e) or type(e).__name__, None


def zip_members(spark: SparkSession, path: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """SC-18: the members of archives; see ZipSource."""
    spark.dataSource.register(ZipSource)
    return spark.read.format("zip_members").option("path", path).option("partitionBytes", partition_bytes).load()


def extract(spark: SparkSession, path: str, folder: str) -> int:
    """SC-18: writes all members below folder and returns their number. Nothing is written if any member is bad or has a name
    that leads out of the folder. A file is written under another name and then renamed, so tasks that run again do no
    harm. The folder has to be one that all executors see."""
    members = zip_members(spark, path)
    bad = members.where(~F.col("ok") | F.col("name").rlike(r"^/|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)")).select("archive", "name", "error").take(3)
    if bad:
        raise ValueError("bad members: " + "; ".join(f"{r.archive}: {r.name}: {r.error or 'leads out of the folder'}" for r in bad))

    def write(rows) -> None:
        import os
        import uuid

        for r in rows:
            to = os.path.join(folder, r.name)
            os.makedirs(os.path.dirname(to), exist_ok=True)
            part = f"{to}.{uuid.uuid4().hex}.part"
            with open(part, "wb") as f:
                f.write(r.content)
            os.replace(part, to)

    os.makedirs(folder, exist_ok=True)
    members.foreachPartition(write)
    return members.count()
