"""Disjoint selections against sequential passes."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from relcheck.operators import sampling, selection
from relcheck.plans.catalogue import ORACLE_SQL, QUERIES


def one_pass(rows, cap, used=(), had=()):
    used, counts, out = set(used), collections.Counter(had), []
    for o, g, a, b in sorted(rows):
        mine = {x for x in (a, b) if x is not None}
        if not mine & used and (cap is None or counts[g] < cap):
            out.append(o)
            used |= mine
            counts[g] += 1
    return out


@pytest.mark.parametrize("cap", [None, 3, 12])
def test_rounds_equal_the_pass(spark, cap):
    dice = random.Random(cap)
    images = [f"i{k}" for k in range(80)] + [None]
    hot = ["hot"] * 25
    rows = [(k, dice.choice(["p", "q", "q", "q", None]), dice.choice(images + hot), dice.choice(images)) for k in range(400)]
    df = spark.createDataFrame(rows, "o int, g string, a string, b string")
    got = selection.greedy_disjoint(df, "g", ["a", "b"], cap, [F.col("o")]).collect()
    assert sorted(r.o for r in got) == one_pass(rows, cap)
    if cap:
        used, had = spark.createDataFrame([("i1",), (None,), ("hot",)], "image string"), df.where("o < 5")
        got = selection.greedy_disjoint(df, "g", ["a", "b"], cap, [F.desc("o")], used, had).collect()
        want = one_pass([(-o, g, a, b) for o, g, a, b in rows], cap, ["i1", "hot"], collections.Counter(g for _, g, *_ in rows[:5]))
        assert sorted(-r.o for r in got) == want and {r.place for r in got} <= set(range(1, 401))
    assert selection.greedy_disjoint(df.limit(0), "g", ["a", "b"], cap, [F.col("o")]).count() == 0


def test_disjoint_pick_equals_the_pass(spark):
    """200 rows and 80 images: all that a pass in turns takes."""
    rows = [(f"p{i % 5}", f"i{i * 7 % 80}", f"i{i * i % 80}") for i in range(200)]
    rows = sorted({r for r in rows})
    order = collections.defaultdict(list)
    for p, a, b in rows:
        order[p].append((hashlib.md5(f"1:{a}:{b}".encode()).hexdigest(), a, b))
    turned = [((t, p, a, b), p, a, b) for p, x in order.items() for t, (_, a, b) in enumerate(sorted(x))]
    df = spark.createDataFrame(rows, "p string, a string, b string")
    got = sampling.disjoint_pick(df, "p", "a", "b", 20, 30, 1).collect()
    assert sorted((r.p, r.a, r.b) for r in got) == sorted(o[1:] for o in one_pass(turned, 20)[:30]) and got[0].__fields__ == ["p", "a", "b"]


def test_split_equals_sql_and_shares_no_image(same_as_sql, spark):
    same_as_sql(QUERIES["image_disjoint_split"], ORACLE_SQL["image_disjoint_split"])
    out = QUERIES["image_disjoint_split"](spark, "/root/testdata/sf0.001").collect()
    images = [x for r in out for x in {r.image, r.other_image}]
    assert len(images) == len(set(images)) and {r.split for r in out} == {"train", "heldout"}


@pytest.mark.parametrize("cap", [None, 3])
def test_stretches_equal_the_pass(spark, cap, monkeypatch):
    """Stretches of 10, 30 and more rows; with full groups most rows are in no round."""
    monkeypatch.setattr(selection, "STRETCH", 10)
    monkeypatch.setattr(selection, "FACTOR", 3)
    seen, rounds = [], selection._rounds
    monkeypatch.setattr(selection, "_rounds", lambda rows, *more: (seen.append(rows.count()), rounds(rows, *more))[1])
    dice = random.Random(5)
    rows = [(k, dice.choice(["p", "q", None]), f"a{dice.randrange(90)}", dice.choice([None, f"a{dice.randrange(90)}"])) for k in range(300)]
    df = spark.createDataFrame(rows, "o int, g string, a string, b string")
    used, had = spark.createDataFrame([("a1",)], "image string"), df.where("o < 2")
    got = selection.greedy_disjoint(df, "g", ["a", "b"], cap, [F.col("o")], used, had).collect()
    want = one_pass(rows, cap, ["a1"], collections.Counter(g for _, g, *_ in rows[:2]))
    assert sorted(r.o for r in got) == want and len(seen) > 1 and sum(seen) < (60 if cap else 300)
