from mirrorsift.llm import quality_rules, toxicity


def tables(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, v, v) for i, (_, v) in enumerate(texts)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_the_fit_reads_whole_texts(spark):
    texts = [("plain words " * 4000 + f"behind the cut {i}", i % 2) for i in range(6)] + [(None, 1), ("", 0)]
    docs, labels = tables(spark, texts)
    for column, rows, chars in (("quality", quality_rules.FIT_ROWS, quality_rules.FIT_CHARS), ("toxic", toxicity.FIT_ROWS, toxicity.FIT_CHARS)):
        got, y = quality_rules.labelled_sample(docs, labels, column, rows, chars)
        assert sorted(zip(got, y.tolist(), strict=True)) == sorted((t, v) for t, v in texts if t is not None)


def test_the_bound_leaves_out_whole_rows(spark):
    texts = [("w" * 100 + str(i), i % 2) for i in range(40)]
    got, y = quality_rules.labelled_sample(*tables(spark, texts), "quality", 1500, 500)
    assert set(zip(got, y.tolist(), strict=True)) <= set(texts) and y.tolist().count(0) == y.tolist().count(1) == 5
