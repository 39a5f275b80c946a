"""Pairs are compared in tasks whose number grows with the table, so that a task's rows don't."""

from relcheck.operators import joins
from relcheck.plans.catalogue import ORACLE_SQL, QUERIES


def test_tasks_grow_with_rows(spark, same_as_sql, monkeypatch):
    monkeypatch.setattr(joins, "PAIR_ROWS", 100)
    out = QUERIES["entity_pair_selfjoin"](spark, "/root/testdata/sf0.001")
    assert out.rdd.getNumPartitions() >= spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count() // 100
    same_as_sql(QUERIES["entity_pair_selfjoin"], ORACLE_SQL["entity_pair_selfjoin"])
