"""Sources and sinks (SC). Scans carry an ordinal, since a DataFrame has no order of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relcheck.operators.ranges import in_ranges


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, asked of the file system it belongs to."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, ord and value of the lines of text files: ord is the line's number in its file from 0, blank lines counted,
    however the files are split into tasks. A file's lines are ranked by the start of their block and their order there."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), "value")
    return in_ranges(lines, [F.col("file")], [F.col("_block"), F.col("_at")], rank="ord").select("file", (F.col("ord") - 1).alias("ord"), "value")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SC-01: JSONL with `file` and `ord`, the line's number in its file from 0; blank lines are skipped."""
    lines = numbered_lines(spark, path)
    return lines.where(F.trim("value") != "").select("file", "ord", F.from_json("value", schema).alias("r")).select("file", "ord", "r.*")


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SC-01: by the suffix: lines for .jsonl and .ndjson, else a document that is an array or an envelope. `ord` is the line
    or the place in the document."""
    if path.lower().rstrip("/*").endswith((".jsonl", ".ndjson")):
        return json_lines(spark, path, schema).drop("file")
    return json_envelope(spark, path, schema)


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SC-01: a JSON array in a file, with `ord` the place in it."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", f"array<struct<{schema}>>")).alias("ord", "r"))
    return whole.select("ord", "r.*")


def json_envelope(spark: SparkSession, path: str, schema: str, names: tuple[str, ...] = ("data", "samples", "questions")) -> DataFrame:
    """SC-02: records in an array, under the first non-empty of names, or as the values of an object."""
    item = f"struct<{schema}>"
    raw = spark.read.text(path, wholetext=True)
    array = F.from_json("value", f"array<{item}>")
    under = F.from_json("value", "struct<" + ", ".join(f"{n}: array<{item}>" for n in names) + ">")
    filled = [F.when(F.size(under.getField(n)) > 0, under.getField(n)) for n in names]
    values = F.map_values(F.from_json("value", f"map<string,{item}>"))
    found = F.when(F.ltrim("value").startswith("["), array).otherwise(F.coalesce(*filled, values))
    return raw.select(F.posexplode(found).alias("ord", "r")).select("ord", "r.*")


def optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SC-03: JSONL that may be absent: no rows then."""
    return json_lines(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], f"file string, ord long, {schema}")


def processed(df: DataFrame, *keys: str) -> DataFrame:
    """SC-05: the different keys that are done: the first non-null of keys, null ones ignored."""
    key = F.coalesce(*[F.col(k).cast("string") for k in keys])
    return df.select(key.alias("key")).where("key is not null").distinct()


def tsv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """SC-06: tab-separated with a header; all columns are text unless a schema is given."""
    reader = spark.read.option("sep", "\t").option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """SC-07: one id a line, without blanks and repetitions."""
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''").distinct()


def nested_images(spark: SparkSession, path: str, column: str = "image") -> DataFrame:
    """SC-08: Parquet with images as struct{bytes, path}: file, path, name, length and content; other columns aren't read."""
    image = F.col(column)
    rows = spark.read.parquet(path).where(image.isNotNull()).select(F.col("_metadata.file_path").alias("file"), image["path"].alias("path"), image["bytes"].alias("content"))
    return rows.select("file", "path", F.element_at(F.split("path", "/"), -1).alias("name"), F.length("content").cast("bigint").alias("length"), "content")


def images(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("jpg", "jpeg", "png", "webp", "bmp")) -> DataFrame:
    """SC-08, SC-09: files below path with one of the extensions (any case): path, name, length; content is read only if
    asked for."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.where(F.lower(F.substring_index("path", ".", -1)).isin(*extensions)).withColumn("name", F.element_at(F.split("path", "/"), -1))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SC-11, SC-12, SC-13: JSONL with explicit nulls; mode append keeps what is there."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_tsv(df: DataFrame, path: str, scrub: str = "\t\n") -> None:
    """SC-14: tab-separated with a header; tabs and newlines in text become spaces."""
    clean = [F.translate(c, scrub, " " * len(scrub)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    df.select(*clean).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def markdown(df: DataFrame) -> str:
    """SC-15: a small table of results as Markdown, all its rows; large ones go to documents.write_document."""
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns) + "\n"
    return head + "".join("| " + " | ".join("" if v is None else str(v) for v in r) + " |\n" for r in df.toLocalIterator())
