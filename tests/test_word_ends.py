"""Heads of answers that a letter beyond ASCII follows: answer_readers reads them as its SQL does."""

import duckdb
from conftest import rows_of
from pyspark.sql import functions as F

from relcheck.functions import answers as A
from relcheck.plans.catalogue import ORACLE_SQL, QUERIES


def test_heads_before_other_letters(spark, tmp_path):
    # A hash of the line decides what stands before it: of 60 lines some stay as they are.
    said = ["Yesñ{}taque, no image", "noó {} there is no picture", "Nñ{} cannot see", "yes{}", "No_{}", "Yes é{}", "Y, ñ{} no image"]
    rows = [(k, "\n".join(x.format("a" * k) for x in said)) for k in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["answer_readers"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    found = con.sql(ORACLE_SQL["answer_readers"])
    cols = sorted(out.columns)
    assert rows_of(cols, [r.asDict() for r in out.collect()]) == rows_of(cols, [dict(zip(found.columns, r)) for r in found.fetchall()])


def test_readers_by_themselves_end_words_at_any_letter(spark):
    df = spark.createDataFrame([("Yesñ, no image",), ("No ñ, no image",)], "x string")
    got = df.select(A.strict_head(F.col("x")), A.strict_head(F.col("x"), ascii_words=True), A.prior_answer(F.col("x")), A.prior_answer(F.col("x"), ascii_words=True)).collect()
    assert [tuple(r) for r in got] == [("Invalid", "Yes", "invalid", "yes"), ("No", "No", "no", "no")]
