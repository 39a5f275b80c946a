from relcheck.llm import pii, quality_rules


def test_terms_beside_an_entity_of_one_text(spark):
    texts = ["ask tom@a.com or +49 30 1234567 in quillhaven", "the ask of all", "or in the", "the ask or in all", "in the ask", "ask or not in the", None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.sanitised_text for r in pii.pii_scan(rows).collect()}
    assert got == {0: "ask [EMAIL] or [PHONE] in [TERM]"} | {i: t or "" for i, t in enumerate(texts) if i}
    kept = {r.doc_id: r.sanitised_text for r in pii.pii_scan(rows, min_texts=2).collect()}
    assert kept[0] == "ask [EMAIL] or [PHONE] in quillhaven"


def test_an_absolute_limit_of_lines(spark):
    own = lambda i: " ".join(chr(97 + i % 26) * (1 + i // 26) + "x" * j for j in range(60))
    rows = [(i, own(i) + "\nFooter" * (i < 5), host) for i in range(30) for host in ("h", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    cut = lambda **x: {(r.doc_id, r.source, r.n_heavy_lines) for r in quality_rules.quality_rules(df, **x).collect()}
    assert cut(share=0.5, max_docs=5) == {(i, h, int(i < 5)) for i, _, h in rows}
    assert cut(share=0.5, min_docs=2, max_docs=6) == {(i, h, 0) for i, _, h in rows}
