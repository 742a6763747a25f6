import corpus_pipeline
from mirrorsift.llm import queries


def test_stages_and_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "mixing", "packing"]
    out = corpus_pipeline.run(spark, sf_dir)
    rows = out.collect()
    assert rows and {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)
    assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_one_of_each_group_stays(spark, odd):
    kept = sorted(r["doc_id"] for r in corpus_pipeline.one_of_each_group(spark, odd.where("doc_id is not null"), "").select("doc_id").distinct().collect())
    assert 5 in kept and 6 not in kept and 14 not in kept and 13 not in kept and {1, 2, 3} <= set(kept)


def test_stages_on_odd_rows(spark, odd, none, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for start in (odd, none):
        docs = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == odd.columns
        corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count()


def test_every_operator_is_registered():
    assert {int(k[2:].split("_")[0]) for k in queries.queries()} == set(range(1, 11))


def test_few_near_duplicates_leave_texts_in_place(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text number {i // 2} has few words of {i // 2}") for i in range(40)], "doc_id long, text string").repartition(4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most, kind in ((100, "BroadcastHashJoin"), (3, "SortMergeJoin")):
            monkeypatch.setattr(corpus_pipeline, "BROADCAST_IDS", most, raising=False)
            out = corpus_pipeline.one_of_each_group(spark, docs, "")
            assert sorted(r["doc_id"] for r in out.collect()) == list(range(0, 40, 2))
            assert kind in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
