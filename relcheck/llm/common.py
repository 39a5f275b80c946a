"""What the text operators share: tables, saved intermediate results, row identity, joins with a checked size.

Conventions of all operators here:

* A document is identified by its id and its text. Rows with the same id and the same text are repeated rows: they are
  one document, and each of them gets that document's result. Rows with one id and several texts are several documents,
  ordered among themselves by a hash of the text.
* A null text counts as an empty one. Null ids are allowed; where order matters, each operator says where they stand.
* Other columns are carried along untouched. A column of the input that has the name of a column the operator adds is
  replaced by the operator's column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relcheck.tables import saved, workspace

__all__ = ["BROADCAST_BYTES", "join_small", "let", "packed", "same_row", "saved", "table", "unpacked", "workspace"]

#: A side of a join is broadcast only if its rows stay under this many bytes.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_small(big: DataFrame, small: DataFrame, on: Column, how: str) -> DataFrame:
    """big joined to small, which was saved(): broadcast if its rows, written as JSON, stay under BROADCAST_BYTES, else an
    ordinary shuffled join."""
    size = small.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return big.join(F.broadcast(small) if size <= BROADCAST_BYTES else small, on, how)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, also where body uses it inside of lambdas."""
    return F.transform(F.array(value), body)[0]


def packed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The row as struct `row`, and `_id`, `_text` (never null), `_h` (hash of the text): names can't clash then."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.struct("*").alias("row"), F.col(id_col).cast("bigint").alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_h"))


def unpacked(df: DataFrame, added: dict[str, Column]) -> DataFrame:
    """The columns of `row` that added doesn't replace, then added. text may be replaced in its place."""
    taken = {k.lower() for k in added}
    fields = [f.name for f in df.schema["row"].dataType.fields]
    kept = [F.col("row").getField(f).alias(f) for f in fields if f.lower() not in taken]
    return df.select(*kept, *(c.alias(k) for k, c in added.items()))


def same_row(a: DataFrame, b: DataFrame) -> Column:
    """The condition that joins two tables on a document's identity."""
    return a["_id"].eqNullSafe(b["_id2"]) & (a["_h"] == b["_h2"])
