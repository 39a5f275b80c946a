from relcheck.plans import tables


def test_edges_are_counted_within_documents(spark, tmp_path):
    texts = [(1, "a b a b a"), (1, "b b a"), (2, "one"), (3, None), (4, ""), (5, "x  y x  y"), (6, "a b")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = tables.word_graph(spark, str(tmp_path))
    assert sorted(tuple(r) for r in out.collect()) == [(1, 4, 2, 3, 7), (5, 4, 3, 3, 10)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "Generate" not in plan  # edges were shuffled, three times each, before
