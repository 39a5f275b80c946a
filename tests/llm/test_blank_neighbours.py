from relcheck.llm import line_dedup


def test_passage_between_blank_lines(spark):
    rows = [(1, "a\n\npassage of words\n\nb"), (2, "c\n\npassage of words\n\nd"), (3, "\n\n\n"), (4, "\n\n\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.text, r.n_removed_lines) for r in line_dedup.line_dedup(docs).collect()}
    assert got == {(1, rows[0][1], 0), (2, "c\nd", 3), (3, "\n\n\n", 0), (4, "\n\n\n", 0)}
