"""Sources and sinks: line numbers over split files, broken archives, failed commits, files that aren't complete."""

import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from relcheck.sources import archives, documents, records
from relcheck.streaming.waiting import complete_files


def test_line_numbers_of_split_files(spark, tmp_path):
    folder = tmp_path / "lines.jsonl"
    folder.mkdir()
    want = set()
    for name, n in (("a.jsonl", 3000), ("b.jsonl", 1)):
        rows = ["" if k % 7 == 3 else json.dumps({"id": k, "t": "x" * (k % 50)}) for k in range(n)]
        (folder / name).write_text("\n".join(rows) + "\n")
        want |= {(name, k, k) for k in range(n) if k % 7 != 3}
    for size in ("4k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        try:
            out = records.json_lines(spark, str(folder), "id int, t string").select(F.element_at(F.split("file", "/"), -1), "ord", "id").collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert {tuple(r) for r in out} == want and len(out) == len(want)
    assert records.json_records(spark, str(folder), "id int").count() == len(want)
    (tmp_path / "c.json").write_text('{"data": [{"id": 5}, {"id": 6}]}')
    assert [tuple(r) for r in records.json_records(spark, str(tmp_path / "c.json"), "id int").orderBy("ord").collect()] == [(0, 5), (1, 6)]


def test_nested_images(spark, tmp_path):
    rows = [(1, (bytearray(b"abc"), "x/y.png")), (2, None)]
    spark.createDataFrame(rows, "k int, image struct<bytes: binary, path: string>").write.parquet(str(tmp_path / "p"))
    out = records.nested_images(spark, str(tmp_path / "p"))
    assert [(r.path, r.name, r.length, bytes(r.content)) for r in out.collect()] == [("x/y.png", "y.png", 3, b"abc")]
    assert "ReadSchema: struct<image:struct<bytes:binary,path:string>>" in out._jdf.queryExecution().toString()


def test_archive_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "good.zip", "w") as z:
        for k in range(30):
            z.writestr(f"d/{k}.txt", f"text {k} " * 200)
        z.writestr("d/", "")
    with zipfile.ZipFile(tmp_path / "bad.zip", "w", zipfile.ZIP_STORED) as z:
        z.writestr("one.txt", "a" * 500)
        z.writestr("two.txt", "b" * 500)
    raw = (tmp_path / "bad.zip").read_bytes()
    (tmp_path / "bad.zip").write_bytes(raw.replace(b"b" * 500, b"b" * 499 + b"c"))
    (tmp_path / "none.zip").write_bytes(b"not an archive")
    rows = archives.zip_members(spark, str(tmp_path), 3000)
    assert rows.rdd.getNumPartitions() > 10
    got = {(os.path.basename(r.archive), r.name): r for r in rows.collect()}
    assert len(got) == 33 and bytes(got["good.zip", "d/7.txt"].content) == b"text 7 " * 200
    assert got["bad.zip", "one.txt"].ok and not got["bad.zip", "two.txt"].ok and "CRC" in got["bad.zip", "two.txt"].error and got["bad.zip", "two.txt"].content is None
    assert not got["none.zip", None].ok
    assert archives.extract(spark, str(tmp_path / "good.zip"), str(tmp_path / "out")) == 30
    assert sorted(os.listdir(tmp_path / "out/d")) == sorted(f"{k}.txt" for k in range(30)) and (tmp_path / "out/d/3.txt").read_text() == "text 3 " * 200
    with pytest.raises(ValueError, match="two.txt"):
        archives.extract(spark, str(tmp_path / "bad.zip"), str(tmp_path / "out2"))
    with zipfile.ZipFile(tmp_path / "out.zip", "w") as z:
        z.writestr("../x.txt", "x")
    with pytest.raises(ValueError, match="leads out"):
        archives.extract(spark, str(tmp_path / "out.zip"), str(tmp_path / "out2"))
    assert not (tmp_path / "out2").exists() and archives.zip_members(spark, str(tmp_path / "nothing*.zip")).count() == 0


def test_one_json_document(spark, tmp_path):
    path = str(tmp_path / "sub/all.json")
    rows = [{"id": k, "name": f"é {k}", "inner": {"x": [k, None]}} for k in range(500)]
    df = spark.createDataFrame([(r["id"], r["name"], (r["inner"]["x"],)) for r in rows], "id int, name string, inner struct<x: array<int>>").repartition(7).orderBy("id")
    documents.write_document(df, path)
    text = open(path, encoding="utf-8").read()
    assert text == json.dumps(rows, ensure_ascii=False, indent=2) + "\n" and os.listdir(tmp_path / "sub") == ["all.json"]
    failing = df.withColumn("id", F.when(F.col("id") == 400, F.raise_error("no").cast("int")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="no"):
        documents.write_document(failing, path)
    assert open(path, encoding="utf-8").read() == text and os.listdir(tmp_path / "sub") == ["all.json"]
    documents.write_document(df.limit(0), path)
    assert open(path).read() == "[]\n"
    documents.write_document(df.where("id = 3"), path, "json_object")
    assert json.load(open(path)) == rows[3]
    with pytest.raises(Exception, match="one row"):
        documents.write_document(df, path, "json_object")
    assert json.load(open(path)) == rows[3] and os.listdir(tmp_path / "sub") == ["all.json"]


def test_report(spark, tmp_path):
    path = str(tmp_path / "report.md")
    documents.write_report([("All", spark.range(250).orderBy("id")), ("None", spark.range(0)), ("Odd", spark.createDataFrame([("a|b\nc", None)], "x string, y int"))], path, "Results")
    text = open(path).read()
    assert text.startswith("# Results\n\n## All\n\n| id |\n|---|\n| 0 |\n") and "| 249 |\n\n## None\n\n| id |\n|---|\n\n## Odd" in text and text.endswith("| a\\|b c |  |\n")
    assert os.listdir(tmp_path) == ["report.md"]


def test_files_are_handed_on_once_and_complete(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put = lambda name, text: (folder / name).write_text(text)

    def run():
        stream = complete_files(spark, str(folder), str(tmp_path / "log"), ".txt", ".done")
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((os.path.basename(r.file), r.ord, r.value) for r in spark.read.schema("file string, ord long, value string").parquet(str(tmp_path / "out")).collect())

    put("a.txt", "1\n2\n")
    put("b.txt", "half")
    put("a.txt.done", "")
    assert run() == [("a.txt", 0, "1"), ("a.txt", 1, "2")]
    put("b.txt", "whole\n")
    put("b.txt.done", "")
    put("c.other", "x")
    want = [("a.txt", 0, "1"), ("a.txt", 1, "2"), ("b.txt", 0, "whole")]
    assert run() == want and run() == want
