"""Rows of a frequent pair meet every other row of it, in pieces that no task holds all of."""

import duckdb
import pytest
from conftest import rows_of

from relcheck.operators import joins
from relcheck.plans.catalogue import ORACLE_SQL, QUERIES

SCHEMA = "l_partkey long, l_suppkey long, l_orderkey long, l_returnflag string"


@pytest.mark.parametrize("block", [joins.BLOCK_ROWS, 40])
def test_no_partner_is_dropped(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(joins, "BLOCK_ROWS", block)
    frequent = [(1, 1, k // 2, "ANR"[k * k % 3]) for k in range(330)] + [(1, 1, k + 500, "A") for k in range(150)]
    odd = [(2, 1, 1, None), (2, 1, 2, "A"), (2, 1, 3, None), (None, 1, 1, "A"), (None, 1, 2, "R"), (3, 1, None, "A"), (3, 1, 4, "R"), (3, 1, 5, "A")]
    rare = [(k, 2, j, "AR"[j % 2]) for k in range(20) for j in range(3)]
    spark.createDataFrame([*frequent, *odd, *rare], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    out = QUERIES["entity_pair_selfjoin"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    found = con.sql(ORACLE_SQL["entity_pair_selfjoin"])
    cols, rows = sorted(out.columns), [r.asDict() for r in out.collect()]
    assert rows_of(cols, rows) == rows_of(cols, [dict(zip(found.columns, r)) for r in found.fetchall()])
    # By itself: every two different rows of the pair whose orders differ, unless the other order has the flag.
    flags = {}
    for p, s, o, f in set(frequent):
        flags.setdefault(o, set()).add(f)
    assert sum(r["l_partkey"] == 1 and r["l_suppkey"] == 1 for r in rows) == sum(len(flags[o]) for _, _, k, f in frequent for o in flags if o != k and f not in flags[o])


def test_a_frequent_pair_is_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(joins, "BLOCK_ROWS", 40)
    monkeypatch.setattr(joins, "PAIR_ROWS", 100)
    df = spark.createDataFrame([(1, 1, k, "AR"[k % 2]) for k in range(400)], SCHEMA)
    out = joins.same_pair_elsewhere(df, ["l_partkey", "l_suppkey"], "l_orderkey", "l_returnflag")
    sizes = out.rdd.glom().map(len).collect()
    assert sum(sizes) == 400 * 200 and sum(n > 0 for n in sizes) > 10 and max(sizes) < 40_000
