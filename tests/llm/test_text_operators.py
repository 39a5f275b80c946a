"""Every operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and columns
whose names clash."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from relcheck.llm import bpe, decontaminate, jaccard_join, license_scan, line_dedup, pii, pitman_yor, quality_rules, sharding, suffix_dedup
from relcheck.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, row string, _h string, n_words int, _id long, kept string"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], ORACLE_SQL[name])


@pytest.fixture(scope="module")
def texts(spark):
    """Documents of the smallest table with odd ones; all ids with a null among them."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    base = docs[5][1]
    odd = [None, "", " \n\t ", "one", base, base[100:149], base[100:150], "zz" + base[100:151], "ab" * 300, "é" * 80, "x" * 30000, "a b c d e " * 400, base.replace("e", "E", 1), "<|endoftext|> á İK CC-BY"]
    docs += [(1000 + i, t) for i, t in enumerate(odd)] + [(None, base), (1004, base), (1004, base), (1004, "other text")]
    return docs


@pytest.fixture(scope="module")
def df(spark, texts):
    return spark.createDataFrame([(i, t, "h" if k % 2 else None, "r", "x", 7, -1, "k") for k, (i, t) in enumerate(texts)], SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(rows):
    return collections.Counter(rows)


def test_line_dedup_keeps_columns(df, empty, texts):
    out = line_dedup.line_dedup(df)
    assert out.count() == len(texts) and set(df.columns) <= set(out.columns)
    assert line_dedup.line_dedup(empty).count() == 0
    text = "a\nb\nc\nd"
    spark = df.sparkSession
    rows = spark.createDataFrame([(1, text), (2, "x\n" + text), (2, "x\n" + text), (3, "a\nb"), (4, None), (5, "\n\n\n\n")], "doc_id long, text string")
    got = {(r.doc_id, r.text, r.n_removed_lines) for r in line_dedup.line_dedup(rows).collect()}
    assert got == {(1, text, 0), (2, "x", 4), (3, "a\nb", 0), (4, None, 0), (5, "\n\n\n\n", 0)}


def test_quality_rules_edges(spark, df, empty, texts):
    out = quality_rules.quality_rules(df)
    assert out.count() == len(texts) and out.schema["n_words"].dataType.simpleString() == "bigint"
    assert quality_rules.quality_rules(empty).count() == 0
    own = lambda i: " ".join(chr(97 + i % 26) * (1 + i // 26) + "x" * j for j in range(60))
    rows = [(i, f"{own(i)}\nShared by all {i % 10}", "h") for i in range(30)]
    got = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert {(r.n_heavy_lines, r.n_heavy_words, r.kept, "Shared" in r.clean_text) for r in got.collect()} == {(1, 4, True, False)}
    short = [(100 + i, f"{'y' * i}\n" + "Shared by all 1\n" * 20, "h") for i in range(3)]
    got = quality_rules.quality_rules(spark.createDataFrame(rows + short, "doc_id long, text string, source string"))
    assert {r.doc_id: r.kept for r in got.collect()} == {i: i < 100 for i, _, _ in rows + short}


def test_bpe_equals_the_library(df, empty, texts, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        tokenizer = Tokenizer.from_file(path)
        want = []
        for i, t in texts:
            ids = tokenizer.encode(t or "", add_special_tokens=False).ids
            told = tokenizer.decode(ids, skip_special_tokens=False)
            want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(told.encode()).hexdigest()))
        assert bag(tuple(r) for r in bpe.encode_corpus(df, path).collect()) == bag(want)
        assert bpe.encode_corpus(empty, path).count() == 0


def test_shards_are_even_and_gapless(df, empty, texts):
    out = sharding.shard_documents(df).collect()
    counts = collections.Counter(r.shard for r in out)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 8
    for s, n in counts.items():
        assert sorted(r.slot for r in out if r.shard == s) == list(range(n))
    assert bag((r.doc_id, r.size, r.text_crc32) for r in out) == bag((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    assert sharding.shard_documents(empty).count() == 0


def test_sharding_splits_a_group_too_large(spark):
    rows = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("t"), (F.col("id") / 2).cast("int").cast("string"))).alias("text"))
    out = sharding.shard_documents(rows).collect()
    counts = collections.Counter(r.shard for r in out)
    assert set(counts.values()) == {50}


def removed_bytes(texts):
    first = {}
    order = lambda i: math.inf if i is None else i
    for i, t in texts:
        raw = (t or "").encode()
        for k in range(len(raw) - 49):
            first[raw[k : k + 50]] = min(first.get(raw[k : k + 50], math.inf), order(i))
    for i, t in texts:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 49):
            if first[raw[k : k + 50]] < order(i):
                gone[k : k + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(raw)) if gone[k] and not (k and gone[k - 1]))
        yield i, len(raw), sum(gone), spans, bytes(c for c, g in zip(raw, gone) if not g)


@pytest.mark.parametrize("hot", [256, 1])
def test_suffix_dedup(df, empty, texts, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_BLOCKS", hot)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 30_000)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 30_000)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.suffix_dedup(df).collect()]
    assert bag(got) == bag(removed_bytes(texts))
    assert suffix_dedup.suffix_dedup(empty).count() == 0


@pytest.mark.parametrize("hot", [256, 1])
def test_suffix_dedup_steps(texts, hot, monkeypatch):
    """The steps without Spark: what workers read from the module can be set here."""
    monkeypatch.setattr(suffix_dedup, "HOT_BLOCKS", hot)
    monkeypatch.setattr(suffix_dedup, "SORT_BYTES", 2000)
    bits, tables = 2, []
    for b in range(3):
        own = [(i, k, t or "", b) for k, (i, t) in enumerate(texts) if k % 3 == b]
        tables.append(pd.DataFrame(own, columns=["_id", "_h", "_text", "block"]).astype({"_id": "Int64"}))
    each = lambda rows, f: pd.concat([f(x) for _, x in pd.concat(rows).groupby("bucket")])
    first = each([suffix_dedup.send_triggers(bits)(t) for t in tables], suffix_dedup.shared_triggers)
    mine = lambda replies, b: replies[replies["block"] == b]
    entries = pd.concat([suffix_dedup.send_entries(bits)(t, mine(first, b)) for b, t in enumerate(tables)])
    told = pd.concat([first, each([entries], suffix_dedup.least_ids)])
    sent = pd.concat([suffix_dedup.send_texts(bits)(t, mine(told, b)) for b, t in enumerate(tables)])
    third = [suffix_dedup.dictionary(entries[entries["bucket"] == k], sent[sent["bucket"] == k]) for k in range(1 << bits)]
    every = pd.concat([told, *third])
    assert hot > 1 or any(first["y"].map(any))
    out = pd.concat([suffix_dedup.cut_block(bits, False)(t, mine(every, b)) for b, t in enumerate(tables)])
    got = [(None if i is pd.NA else i, *x) for i, *x in out.itertuples(index=False, name=None)]
    assert bag(got) == bag(removed_bytes(texts))


@pytest.mark.parametrize("hot", [64, 3])
def test_lm_scores(df, empty, texts, hot, monkeypatch):
    monkeypatch.setattr(pitman_yor, "BUCKET_BYTES", 40_000)
    monkeypatch.setattr(pitman_yor, "HOT_COUNT", hot)
    monkeypatch.setattr(pitman_yor, "HOT_SHARE", 0)
    out = pitman_yor.lm_scores(df).collect()
    tokens = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + ["\0end"]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    counts = collections.Counter(w for i, t in texts if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    base = lambda t: round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), 6)
    want = bag((i, held(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, base(t)) for i, t in texts)
    assert bag((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    own = [r for r in out if r.held_out]
    assert sum(r.score for r in own) > sum(r.base_score for r in own)
    assert pitman_yor.lm_scores(empty).count() == 0


def test_lm_model_sums_to_one():
    """Sections of two contexts with any seating: the probabilities of all words, and of one unknown, are one."""
    c = np.array([[5, 1, 0, 3], [2, 0, 7, 1]])
    t = np.array([[2, 1, 0, 1], [1, 0, 3, 1]])
    customers, known = t.sum(axis=0), 4
    seated = np.minimum(customers, 2)
    totals = np.array([known, c.sum(), customers.sum(), seated.sum()], float)
    parent = pitman_yor.p_parent(customers, seated, totals)
    unknown = pitman_yor.p_parent(np.zeros(1), np.zeros(1), totals)[0]
    assert abs(parent.sum() + unknown - 1) < 1e-12
    for own, tables in zip(c, t):
        back = pitman_yor.STRENGTH + pitman_yor.DISCOUNT * tables.sum()
        p = (own - pitman_yor.DISCOUNT * tables + back * parent) / (pitman_yor.STRENGTH + own.sum())
        assert abs(p.sum() + back * unknown / (pitman_yor.STRENGTH + own.sum()) - 1) < 1e-12


def test_lm_ways_and_draws_are_exact():
    """The closed form against the recursion; draws of few and of many customers against the exact distribution."""
    n = 80
    ways = np.full((n + 1, n + 1), -np.inf)
    ways[0, 0] = 0
    for c in range(1, n + 1):
        for t in range(1, c + 1):
            ways[c, t] = np.logaddexp(ways[c - 1, t - 1], ways[c - 1, t] + np.log(max(c - 1 - t / 2, 1e-300)) if t < c else -np.inf)
    for c in (1, 2, 7, n):
        assert np.allclose(pitman_yor.log_ways(np.full(c, c), np.arange(1, c + 1)), ways[c, 1 : c + 1])
    rng = np.random.default_rng(1)
    for c, others, p in ((3, 4, 0.1), (20, 50, 0.02), (500, 1000, 0.01), (5000, 200, 0.3), (40, 10**6, 0.01)):
        t = np.arange(1, c + 1)
        logit = pitman_yor.log_ways(np.full(c, c), t) + np.cumsum(np.log((pitman_yor.STRENGTH + pitman_yor.DISCOUNT * (others + t - 1)) * p))
        w = np.exp(logit - logit.max())
        mean = (w * t).sum() / w.sum()
        sd = np.sqrt((w * t * t).sum() / w.sum() - mean**2)
        x = pitman_yor.seat(rng, np.full(4000, c), np.full(4000, others), np.full(4000, p), pitman_yor.STRENGTH)
        assert abs(x.mean() - mean) < 5 * sd / 60 + 1e-9 and abs(x.std() - sd) < 0.1 * sd + 1e-9


def test_jaccard_join(df, empty, spark):
    words = [f"w{i}" for i in range(300)]
    near = [(i, " ".join(w if j != (7 * i) % 300 else f"x{i}" for j, w in enumerate(words))) for i in range(90)]
    rows = near + [(200, near[3][1]), (201, near[3][1]), (202, None), (203, ""), (204, "a b"), (205, "a b"), (None, "lone words here that nobody else has at all"), (206, " ".join(words[:100]))]
    got = {r._id: r for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {}
    for i, t in rows:
        w = (t or "").split()
        k = min(5, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    for i, s in sets.items():
        linked = [j for j, o in sets.items() if j != i and s and o and len(s & o) >= 0.8 * len(s | o)]
        assert got[i].n_links == len(linked), i
    assert {got[i].class_id for i, _ in near} == {0} and got[205].class_id == 204 and got[202].class_id == 202
    assert jaccard_join.near_duplicates(empty).count() == 0 and jaccard_join.deduplicated(empty).count() == 0
    kept = jaccard_join.deduplicated(df)
    assert kept.columns == df.columns and 0 < kept.count() < df.count()


def test_license_scan(df, empty, texts, spark):
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    told = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    def want(i, t):
        w = told(t)
        places = [(k, name) for p, name in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        at = [k for k, _ in places]
        return i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({n for _, n in places}))

    out = license_scan.license_scan(df)
    assert bag((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out.collect()) == bag(want(*x) for x in texts)
    assert license_scan.license_scan(empty).count() == 0
    rows = [(1, "x\nReleased under the MIT License."), (2, "Licensed under the Apache License, Version 2.0."), (3, "mit license"), (4, "Redistribution and use in source or binary forms, with or without modification, are permitted provided that the following conditions are met")]
    got = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].labels for i in (1, 2, 3, 4)] == ["mit", "apache-2.0", "", "bsd"] and 0.8 <= got[4].score < 1


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    luhn = sum(int(c) * (1 + i % 2) - 9 * (int(c) * (1 + i % 2) > 9) for i, c in enumerate(reversed(digits))) % 10 == 0
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in value.split(".")), "card": 16 <= len(digits) <= 19 and luhn, "phone": 8 <= len(digits) <= 15}[kind]


def test_pii(df, empty, spark):
    odd = ["x@y.z_w@q.r a@b.c.d@e.f @ a@ b@c", "1.2.3.4.5.6.7.8 300.1.1.1 255.255.255.255 0001.2.3.4", "4111 1111 1111 1111 4111-1111-1111-1111 4111 1111 1111 1112", "+1 (555) 555-1234 +12 +1234567890123456 é+4930123456é", "9 " * 4000, None, "", "foo@bar.com é@x.y", "x" * 20000, "1." * 5000]
    odd += [f"tom@a.com zebra n{i}" for i in range(3)] + ["the word", "a zebras"]
    rows = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pii_scan(rows).collect()}
    for i, t in enumerate(odd):
        want = [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, t or "") if holds(k, m[0])]
        assert got[i].base_spans == ",".join(want)
        assert (got[i].sanitised_text == (t or "")) == (got[i].spans == "")
    assert [got[i].sanitised_text for i in (10, 14)] == ["[EMAIL]  n0", "a zebras"]
    assert pii.pii_scan(empty).count() == 0 and pii.pii_scan(df).count() == df.count()


def test_decontamination(df, empty, spark):
    item = "The quick brown fox jumps over the lazy dog while seven wizards watch it from the old stone bridge"
    edited = item.replace("quick", "quikc").replace("stone", "ston")
    rows = spark.createDataFrame([(1, f"x {item.upper()} y"), (2, f"a  {edited}\nb"), (3, item[: len(item) // 2]), (4, None), (5, ""), (5, "z" * 30000)], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (7, item), (8, "short"), (9, None)], "item_id long, text string")
    assert sorted((r._id, r.item_id, r.distance) for r in decontaminate.benchmark_matches(rows, items).collect()) == [(1, 7, 0), (2, 7, 3)]
    assert decontaminate.decontaminated(rows, items).count() == 4
    assert decontaminate.decontaminated(df, items).count() == df.count()
    assert decontaminate.decontaminated(empty, items).count() == 0
    assert decontaminate.benchmark_matches(df, items.limit(0)).count() == 0


def test_myers_equals_dynamic_programming():
    import random

    rng = random.Random(1)
    for _ in range(60):
        a, b = ("".join(rng.choices("abc", k=rng.randint(1, n))) for n in (70, 90))
        row, best = list(range(len(a) + 1)), len(a)
        for c in b:
            now = [0]
            for k, x in enumerate(a, 1):
                now.append(min(now[-1] + 1, row[k] + 1, row[k - 1] + (x != c)))
            row, best = now, min(best, now[-1])
        assert decontaminate.myers(a, b)[0] == best


def test_lm_seating_is_sampled():
    """Draws of tables, also of the parent, follow the exact distribution; a parent of many words has second tables."""
    rng = np.random.default_rng(5)
    n, known, c = 20_000, 20_000, 6
    t = np.ones(n, np.int64)
    for _ in range(40):
        t = pitman_yor.seat(rng, np.full(n, c), t.sum() - t, np.full(n, 1 / (known + 1)), pitman_yor.PARENT_STRENGTH)
    new = pitman_yor.DISCOUNT * t.sum() / known
    weight = {1: 1.0}
    for k in range(1, c):  # k customers are seated
        weight = {a: weight.get(a, 0) * (k - 0.5 * a) + weight.get(a - 1, 0) * new for a in range(1, k + 2)}
    mean = sum(a * x for a, x in weight.items()) / sum(weight.values())
    assert t.mean() > 1.5 and abs(t.mean() - mean) < 0.05


def test_lm_rounds_improve_the_first_draw(spark, monkeypatch):
    assert pitman_yor.BURN_IN >= 2 and pitman_yor.SAMPLES >= 2
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("doc_id < 100")

    def bits():
        return sum(r.score for r in pitman_yor.lm_scores(docs).collect() if r.held_out)

    whole = bits()
    monkeypatch.setattr(pitman_yor, "BURN_IN", 0)
    monkeypatch.setattr(pitman_yor, "SAMPLES", 1)
    assert whole > bits()


def test_jaccard_paths_keep_recall_in_deep_buckets():
    """2000 pairs of signatures alike in 0.8, led through the first paths and four splits: pairs that share a path still."""
    assert all(jaccard_join.missed(jaccard_join.runs_for(0.999), k) <= 0.001 for k in range(jaccard_join.LEVELS + 1))
    rng, n = np.random.default_rng(3), 2000
    drawn = lambda: rng.integers(0, 1 << 32, (n, 64), dtype=np.uint64).astype(np.uint32)
    one, other = drawn(), drawn()
    two, mode = np.where(rng.random((n, 64)) < 0.8, one, drawn()), other[0].tobytes()
    sigs = pd.DataFrame([(i, side, x.tobytes()) for side, own in enumerate((one, two)) for i, x in enumerate(own)], columns=["k1", "k2", "sig"])
    rows = pd.concat(jaccard_join.first_paths(0, jaccard_join.runs_for(0.999))(iter([sigs.assign(lab=sigs["k1"])])))
    for _ in range(4):
        met = rows.merge(sigs, on=["k1", "k2"]).assign(mode=mode, p1=pd.NA, p2=pd.NA, plab=pd.NA)
        rows = pd.concat(jaccard_join.split_once(iter([met])))[["path", "k1", "k2", "lab"]].dropna()
    shared = rows[rows["k2"] == 0].merge(rows[rows["k2"] == 1], on=["path", "k1"])["k1"].nunique()
    assert shared >= 0.997 * n


@pytest.mark.parametrize("block", [512, 16])
def test_jaccard_join_finds_all_links(spark, block, monkeypatch):
    """Against brute force: a group of near copies, and texts that share a long passage, in buckets that are split; large
    components are compared in blocks."""
    import random

    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "FEW", 16)
    rng = random.Random(7)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    passage, base, rows = words(90), words(150), []
    for i in range(120):  # near copies of one text, of all degrees
        rows.append([w if rng.random() > 0.001 * (i % 30) else "x" for w in base])
    for i in range(240):  # half of each text is the passage; every fourth has a near copy
        own = passage + words(80)
        rows.append(own)
        if i % 4 == 0:
            rows.append([*own[:-3], "y", "y", "y"])
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in rows]
    near = [[j for j, o in enumerate(sets) if len(s & o) >= 0.8 * len(s | o)] for s in sets]
    root = list(range(len(rows)))
    for _ in range(20):
        root = [min(root[j] for j in own) for own in near]
    copies = collections.Counter(map(frozenset, sets))
    got = {r._id: r for r in jaccard_join.near_duplicates(docs).collect()}
    for i, own in enumerate(near):
        assert (got[i].n_links, got[i].class_id, got[i].n_copies) == (len(own) - 1, root[i], copies[frozenset(sets[i])] - 1), i
