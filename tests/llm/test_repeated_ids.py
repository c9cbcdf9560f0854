from tarnmill.llm.ngram_join import keep_first


def test_rows_of_one_id_are_told_apart_by_text(spark):
    one, two, three = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, three), (5, one), (5, two), (5, two), (5, three + " end"), (7, one + " end"), (8, None), (None, "x y z w v"), (None, "x y z w v")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in keep_first(df, 3, 9, 10).collect()), key=str)
    assert got == sorted([(1, three), (5, one), (5, two), (8, None), (None, "x y z w v"), (None, "x y z w v")], key=str)


def test_copies_of_one_id_keep_one_row(spark):
    text = " ".join(f"a{i}" for i in range(60))
    df = spark.createDataFrame([(5, text), (5, text + " end"), (6, text)], "doc_id long, text string")
    assert [r.doc_id for r in keep_first(df, 3, 9, 10).collect()] == [5]
