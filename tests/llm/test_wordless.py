from relcheck.llm import jaccard_join


def test_one_wordless_text_stays(spark):
    rows = [(2, ""), (1, ""), (3, " \n"), (4, None), (5, "word"), (5, "word")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in jaccard_join.deduplicated(docs).collect()) == [(1, ""), (5, "word"), (5, "word")]
