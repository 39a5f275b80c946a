"""The pipeline against what brute force says of each stage."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from relcheck.llm.common import saved, table

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = table(spark, SF, "documents")
    names, kept = [], [docs]
    for name, stage in corpus_pipeline.STAGES:
        names.append(name)
        kept.append(saved(stage(spark, kept[-1], SF)))
    assert names == ["quality_rules", "line_dedup", "jaccard_join", "decontaminate", "bpe"]
    assert all(x.columns == docs.columns for x in kept[:-1])
    rows = [{r.doc_id: r.text for r in x.collect()} for x in kept[:-1]]
    for i, t in rows[0].items():
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        twice = {p for k, g in enumerate(grams) if grams.count(g) > 1 for p in (k, k + 1, k + 2)}
        if len(words) < 50 or 100 * len(twice) > 50 * len(words):
            assert i not in rows[1]
    seen = set()
    for i in sorted(rows[2]):
        lines = rows[1][i].split("\n")
        gone = set()
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            if any(x.strip() for x in w):
                if w in seen:
                    gone |= {k, k + 1, k + 2}
                seen.add(w)
        assert rows[2][i] == "\n".join(x for k, x in enumerate(lines) if k not in gone)
    items = [r.text for r in table(spark, SF, "benchmark").collect()]
    for i, t in rows[3].items():
        if any(x in t for x in items):
            assert i not in rows[4]
    assert {r.doc_id for r in kept[-1].collect()} == set(rows[4])
    again = corpus_pipeline.run(spark, SF)
    order = lambda x: sorted(map(tuple, x.select("doc_id", "n_tokens", "ids_sha256").collect()))
    assert order(again) == order(kept[-1])
    assert kept[-1].where(F.col("n_tokens") == 0).count() <= 1
