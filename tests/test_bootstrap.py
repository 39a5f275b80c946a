"""Intervals against resampling itself."""

import math
import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from relcheck.operators import stats


@pytest.mark.parametrize("n, p", [(1, 0.5), (7, 0.1), (400, 0.93), (60, 0.5)])
def test_binomial_numbers(n, p):
    chances = [math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)]
    cdf = np.cumsum(chances)
    us = [0.0, 1e-9, 0.05, 0.3, 0.5, 0.77, 0.999, 1 - 1e-12]
    got = stats.binomial.func(pd.Series(us), pd.Series([n] * len(us)), pd.Series([p] * len(us)))
    assert list(got) == [next((k for k in range(n + 1) if cdf[k] >= u), n) for u in us]


def test_binomial_of_many(spark):
    n, p = 10**10, 0.3
    got = stats.binomial.func(pd.Series([0.5, 0.975]), pd.Series([n, n]), pd.Series([p, p]))
    sd = math.sqrt(n * p * (1 - p))
    assert abs(got[0] - n * p) < 5 and abs(got[1] - (n * p + 1.959964 * sd)) < 5
    edge = stats.binomial.func(pd.Series([0.4] * 3), pd.Series([0, 9, 9]), pd.Series([0.5, 0.0, 1.0]))
    assert list(edge) == [0, 0, 9]


def resampled(parts, rounds=4000, seed=1):
    """Bounds of the sum of means of parts (sign, values), each drawn n of n."""
    rng = np.random.default_rng(seed)
    draws = sum(sign * np.array([rng.choice(v, len(v)).mean() for _ in range(rounds)]) for sign, v in parts)
    draws.sort()
    return draws[int(0.025 * rounds)], draws[int(0.975 * rounds)]


def test_intervals_have_the_law_of_resampling(spark):
    dice = random.Random(4)
    rows = [(k, dice.random() < 0.6, dice.random() < 0.7, k % 3 == 0, dice.gauss(3, 2)) for k in range(600)]
    df = spark.createDataFrame(rows, "id int, a boolean, b boolean, t boolean, v double")
    a, b, t = F.col("a"), F.col("b"), F.col("t")
    delta = lambda keep: np.array([int(y) - int(x) for _, x, y, s, _ in rows if keep(s)])
    r = stats.paired_bootstrap(df, a, b, 2000, 7).first()
    low, high = resampled([(1, delta(lambda s: True))])
    assert r.n == 600 and r.delta == pytest.approx(delta(lambda s: True).mean()) and r.low == pytest.approx(low, abs=0.006) and r.high == pytest.approx(high, abs=0.006)
    by = {x.t: x for x in stats.paired_bootstrap(df, a, b, 2000, 7, "t").collect()}
    low, high = resampled([(1, delta(lambda s: s))])
    assert by[True].n == 200 and by[True].low == pytest.approx(low, abs=0.012) and by[True].high == pytest.approx(high, abs=0.012)
    r = stats.difference_in_differences(df, a, b, t, 2000, 7).first()
    low, high = resampled([(1, delta(lambda s: s)), (-1, delta(lambda s: not s))])
    assert r.low == pytest.approx(low, abs=0.013) and r.high == pytest.approx(high, abs=0.013) and (r.n_treated, r.n_others) == (200, 400)
    right = lambda keep: np.array([int(x) for _, x, _, s, _ in rows if keep(s)])
    r = stats.gap(df, a, t, 2000, 7).first()
    low, high = resampled([(1, right(lambda s: s)), (-1, right(lambda s: not s))])
    assert r.low == pytest.approx(low, abs=0.012) and r.high == pytest.approx(high, abs=0.012)


def test_mean_bootstrap(spark):
    dice = random.Random(4)
    rows = [("x" if k % 4 else None, dice.gauss(3, 2)) for k in range(800)] + [("one", 5.0), ("x", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    out = {r.g: r for r in stats.mean_bootstrap(df, F.col("v"), 1500, 7, "g", piece_rows=70).collect()}
    for g in ("x", None):
        own = [v for h, v in rows if h == g and v is not None]
        r = out[g]
        low, high = resampled([(1, np.array(own))])
        assert r.n == len(own) and r["mean"] == pytest.approx(statistics.mean(own)) and r["std"] == pytest.approx(statistics.stdev(own)) and r.median == pytest.approx(statistics.median(own))
        assert r.ci95_low == pytest.approx(low, abs=0.03) and r.ci95_high == pytest.approx(high, abs=0.03)
    assert (out["one"].ci95_low, out["one"].ci95_high, out["one"]["std"], out["none"].n, out["none"].ci95_low) == (5.0, 5.0, 0.0, 0, None)
    again = {r.g: r for r in stats.mean_bootstrap(df.repartition(3), F.col("v"), 1500, 7, "g", piece_rows=70).collect()}
    assert again["x"].ci95_low == pytest.approx(out["x"].ci95_low)


def test_empty_strata(spark):
    df = spark.createDataFrame([(True, False, True)], "a boolean, b boolean, t boolean")
    r = stats.difference_in_differences(df, F.col("a"), F.col("b"), F.col("t"), 50, 1).first()
    assert (r.did, r.low, r.high, r.n_others) == (None, None, None, 0)
    r = stats.gap(df, F.col("a"), F.col("t"), 50, 1).first()
    assert (r.gap, r.low, r.high) == (None, None, None)
    assert stats.paired_bootstrap(df.limit(0), F.col("a"), F.col("b"), 50, 1).first().low is None
