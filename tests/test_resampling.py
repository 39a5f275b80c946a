import hashlib

import pytest
from pyspark.sql import functions as F

from relcheck.operators import stats


def test_every_slot_of_every_draw_is_drawn(spark):
    rows = [(3 * k, k % 3 != 0, k % 5 != 0) for k in range(37)]
    df = spark.createDataFrame(rows, "id int, a boolean, b boolean").repartition(3)
    v = [int(b) - int(a) for _, a, b in rows]
    place = lambda d, j: int(int(hashlib.md5(f"7:{d}:{j}".encode()).hexdigest()[:12], 16) / 16**12 * 37)
    means = sorted(sum(v[place(d, j)] for j in range(37)) / 37 for d in range(80))
    r = stats.paired_resampling(df, F.col("a"), F.col("b"), F.col("id"), 80, 7).first()
    assert (r.n, r.delta, r.low, r.high) == (37, pytest.approx(sum(v) / 37), pytest.approx(means[2]), pytest.approx(means[78]))
    none = stats.paired_resampling(df.limit(0), F.col("a"), F.col("b"), F.col("id"), 80, 7).first()
    assert (none.n, none.low) == (0, None)


def test_slots_are_not_broadcast(spark):
    df = spark.range(50).select("id", (F.col("id") % 3 == 0).alias("a"), (F.col("id") % 5 == 0).alias("b"))
    plan = stats.paired_resampling(df, F.col("a"), F.col("b"), F.col("id"), 80, 7)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin [o" in plan and "BroadcastHashJoin" not in plan
