"""Importance resampling against plain Python."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from relcheck.llm import importance
from relcheck.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def features(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return ws, collections.Counter(zlib.crc32(" ".join(ws[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(ws) - k + 1))


def by_hand(docs, target):
    s, t, own = collections.Counter(), collections.Counter(), []
    for i, text in docs:
        ws, f = features(text)
        own.append((i, len(ws), f))
        s += f
    for text in target:
        t += features(text)[1]
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    rows = []
    for i, n, f in own:
        weight = sum(gain(b) * c for b, c in f.items())
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    best = able[: 5 * len(able) // 100]
    return rows, best


def test_op12_equals_plain_python(spark):
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet").collect()
    rows, best = by_hand([(r.doc_id, r.text) for r in read("documents")], [r.text for r in read("benchmark")])
    rank = {r[0]: k + 1 for k, r in enumerate(best)}
    out = QUERIES["op12_resampling"](spark, SF).collect()
    assert sorted((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r.rank or 0) for r in out) == sorted((*r, rank.get(r[0], 0)) for r in rows)
    assert len(best) > 5


def test_odd_texts_in_small_pieces(spark):
    dice = random.Random(5)
    words = ["Ab", "c", "é", "İx", "9", "w" * 70, "ß", " "]
    docs = [(k, "".join(dice.choice(words) + dice.choice([" ", "-", "\n", "  ", "\x7f"]) for _ in range(dice.randrange(90)))) for k in range(300)]
    docs += [(500, None), (501, ""), (502, " - "), (503, "one"), (504, "x" * 5000), (505, "long word " * 4000), (None, "a b " * 30), (7, docs[7][1]), (7, "other " * 25)]
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in docs], "doc_id long, text string, weight int, row string")
    target = spark.createDataFrame([("Ab c é",), (None,), ("c c 9",)], "text string")
    want, best = by_hand(docs, ["Ab c é", None, "c c 9"])
    for piece in (60, importance.PIECE_BYTES):
        out = importance.importance(df, target, piece_bytes=piece)
        assert out.columns == ["doc_id", "row", "n_words", "n_features", "weight", "score", "rank"]
        out = out.collect()
        assert collections.Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in out) == collections.Counter(want)
        drawn = sorted((r for r in out if r["rank"]), key=lambda r: r["rank"])
        assert [r["rank"] for r in drawn] == list(range(1, len(best) + 1)) and [r.score for r in drawn] == [r[4] for r in best]
    texts = importance.importance(df, target, with_text=True).where("rank is not null").select("doc_id", "text", "score").collect()
    assert collections.Counter((r.doc_id, r.score) for r in texts) == collections.Counter((r[0], r[4]) for r in best)
    assert all((r.doc_id, r.text) in docs for r in texts)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c"), (2, "d " * 30)], "doc_id long, text string")
    assert importance.importance(none, some).count() == 0
    want, _ = by_hand([(1, "a b c"), (2, "d " * 30)], [])
    assert sorted((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in importance.importance(some, none).collect()) == want


def test_shifted_crcs():
    hasher = importance.Hasher()
    heads, tails = [b"", b"a", b"some words", b"x" * 300], [b"", b"b", "é".encode() * 40, b"y" * 1000]
    pairs = [(a, b) for a in heads for b in tails]
    got = hasher.shift(pa.array([zlib.crc32(a) for a, _ in pairs], pa.uint32()), pa.array([len(b) for _, b in pairs], pa.int64()))
    assert [int(g.as_py()) ^ zlib.crc32(b) for g, (_, b) in zip(got, pairs)] == [zlib.crc32(a + b) for a, b in pairs]
    assert hasher.shift(pa.array([None, 5], pa.uint32()), pa.array([1, None], pa.int64())).null_count == 2
    assert np.array_equal(importance.gains(np.zeros(4, np.int64), np.zeros(4, np.int64)), np.zeros(4, np.int64))


@pytest.mark.parametrize("most", [1, 3, 10, 100])
def test_pieces_hold_each_word_once(most):
    text = b"  aa b  ccc d ee  f ggggggg h "
    got = list(importance.pieces(text, most, 3))
    assert b"".join(a for a, _ in got) == text
    words = text.split()
    seen = 0
    for a, after in got:
        seen += len(a.split())
        assert after.split() == words[seen : seen + 2]
