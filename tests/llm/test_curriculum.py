"""Mixing against plain Python, on odd tables and by its SQL."""

import collections
import hashlib
import re

import pytest

from relcheck.llm import curriculum
from relcheck.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string, source string, size string, _draw int, position int"


def test_op11_equals_sql(same_as_sql):
    same_as_sql(QUERIES["op11_mixing"], ORACLE_SQL["op11_mixing"])


def shared_by_weight(words, weights, share, most):
    """Targets by the contract's words: caps, and the excess shared again until none is above."""
    capped = set()
    while True:
        free = sum(w for s, w in weights.items() if s not in capped)
        level = (share * sum(words.values()) - sum(most * words[s] for s in capped)) / free if free else 0
        over = {s for s in words if s not in capped and level * weights[s] > most * words[s]}
        if not over:
            return {s: most * words[s] if s in capped else level * weights[s] for s in words}
        capped |= over


def odd_rows():
    rows = [(i, "w " * (i % 23), ["é", "a", None, "z", "b", "ab"][i * i % 6], "x", 1, 2) for i in range(400)]
    rows += [(900, None, "a", "x", 1, 2), (901, "", None, "x", 1, 2), (None, "one two", "a", "x", 1, 2), (None, "one two", "a", "x", 1, 2)]
    return rows + [(902, "t " * 60000, "tiny", "x", 1, 2), (903, "\x0b  \n \x1f", "tiny", "x", 1, 2), (7, rows[7][1], rows[7][2], "x", 1, 2)]


def test_targets_words_and_positions(spark):
    rows = odd_rows()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    words = collections.Counter()
    for _, t, s, *_ in rows:
        words[s] += size(t)
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(words, key=lambda s: (s is None, s or "")))}
    want = shared_by_weight(words, weights, 1.5, 2)
    df = spark.createDataFrame(rows, SCHEMA)
    out = curriculum.curriculum(df).collect()
    assert out[0].__fields__ == ["doc_id", "source", "_draw", "position", "size", "source_size", "target", "taken", "n_copies", "first_position", "second_position"]
    assert collections.Counter((r.doc_id, r.source, r["size"]) for r in out) == collections.Counter((i, s, size(t)) for i, t, s, *_ in rows)
    taken = collections.Counter()
    for r in out:
        assert r.source_size == words[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert taken == {s: round(t) for s, t in want.items()}
    places = [r.first_position for r in out]
    assert places == sorted(places, key=lambda p: (p is None, p or 0)) and all(0 <= p < 1 for p in places if p is not None)
    assert sorted(map(repr, out)) == sorted(map(repr, curriculum.curriculum(df.repartition(7)).collect()))


def test_positions_follow_the_schedules(spark):
    """At any time a source has given the share of its target that its schedule's integral says, but for a document."""
    rows = [(i, "w " * 10, f"s{i % 3}", "x", 1, 2) for i in range(1500)]
    out = curriculum.training_order(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [r.position for r in out] == sorted(r.position for r in out) and out[0].__fields__ == ["doc_id", "text", "source", "size", "_draw", "position", "words"]
    for s, schedule in zip(("s0", "s1", "s2"), curriculum.SCHEDULES, strict=True):
        own = [r for r in out if r.source == s]
        whole = sum(r.words for r in own)
        for at in (0.1, 0.35, 0.5, 0.8):
            due = sum(max(0, min(at, t0 + n) - t0) * (w0 + w0 + (w1 - w0) * max(0, min(at, t0 + n) - t0) / n) / 2 for t0, n, w0, w1, _ in curriculum.areas(schedule))
            assert abs(sum(r.words for r in own if r.position < at) / whole - due / curriculum.integral(schedule)) < 0.005
    assert max(collections.Counter(r.doc_id for r in out).values()) == 2
    order = lambda i: hashlib.md5(f"11:{i}".encode()).hexdigest()
    first = [r.doc_id for r in out if r.source == "s1"]
    assert first == sorted(first, key=order)


def test_nothing_to_mix(spark):
    assert curriculum.curriculum(spark.createDataFrame([], SCHEMA)).count() == 0
    blank = curriculum.curriculum(spark.createDataFrame([(1, " ", "a", "x", 1, 2), (2, None, None, "x", 1, 2)], SCHEMA)).collect()
    assert {(r["size"], r.source_size, r.target, r.taken, r.first_position) for r in blank} == {(0, 0, 0.0, 0, None)}
    with pytest.raises(ValueError):
        curriculum.integral(((0.0, 1.0), (0.5, 2.0)))
