import corpus_pipeline as c
from eddyline.llm import byte_bpe, byte_cnn, ngram_join, pigeonhole, secret_battery

FOLDER = "/root/testdata/sf0.001"


def test_run_equals_the_stages_one_by_one(spark, documents):
    """Every stage against what its operator says about the rows it is given."""
    docs, sizes = documents, []
    for number, (_, step) in enumerate(c.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()}
        out = c.stage(step(spark, docs, FOLDER), "pipeline-test")
        after = {r["doc_id"]: r for r in out.collect()}
        if number < 4:
            assert out.columns == documents.columns
        if number == 0:
            judged = {r["doc_id"]: r for r in byte_cnn.predict(docs, byte_cnn.fit(docs)).collect()}
            assert set(after) == {i for i, r in judged.items() if r["lang_pred"] != "und" and r["score"] >= 0.25}
        if number == 1:
            assert set(after) == {r["doc_id"] for r in ngram_join.similar_groups(docs).collect() if r["component_id"] == r["doc_id"]}
        if number == 2:
            bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
            assert set(after) == set(before) - {r["doc_id"] for r in pigeonhole.contaminated(docs, bench).collect()}
        if number == 3:
            assert set(after) == set(before)
            found, name = secret_battery.with_spans(docs)
            hit = {r["doc_id"] for r in found.collect() if r[name]}
            assert {i for i in after if after[i]["text"] != before[i]["text"]} == hit
            assert all(after[i]["n_chars"] == len(after[i]["text"]) for i in hit)
        if number == 4:
            assert set(after) == set(before)
        sizes.append(len(after))
        docs = out
    assert {tuple(r) for r in c.run(spark, FOLDER).collect()} == {tuple(r) for r in docs.collect()}
    assert sizes == sorted(sizes, reverse=True)


def test_odd_rows_and_empty_tables(spark, documents):
    extra = documents.limit(30).selectExpr("doc_id", "text", "lang", "source", "n_chars", "1 AS n", "'x' AS t", "2 AS bucket")
    rows = extra.unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) doc_id, CAST(NULL AS STRING) text, CAST(NULL AS STRING) lang, CAST(NULL AS STRING) source, CAST(NULL AS BIGINT) n_chars, 1 n, 'x' t, 2 bucket UNION ALL SELECT 900, '', 'en', 's', 0, 1, 'x', 2"))
    for docs in (rows, rows.limit(0)):
        for _, step in c.STAGES:
            docs = c.stage(step(spark, docs, FOLDER), "pipeline-odd")
        assert byte_bpe.digests(docs.limit(0).selectExpr("doc_id", "'' AS text")).count() == 0
