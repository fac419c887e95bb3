import zlib

import numpy as np
from eddyline.llm import ordinal_toxicity as o


def test_held_out_recall_and_precision(spark):
    folder = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = o.op7_ordinal_toxicity(spark, folder).collect()
    assert len(rows) == 10_000
    held = [r for r in rows if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    toxic = [r["toxic"] for r in held if truth[r["doc_id"]]]
    clean = [r["toxic"] for r in held if not truth[r["doc_id"]]]
    assert np.mean(toxic) > 0.85 and np.mean(clean) < 0.02
    assert all(abs(r["severity"] - r["p_toxic"]) <= 2 and 0 <= r["grade"] < o.GRADES for r in rows)


def test_the_fit_orders_grades():
    rng = np.random.default_rng(1)
    x = (rng.random((2000, 3)) < 0.5).astype(float)
    score = x @ np.array([2.0, -1.0, 0.0]) + rng.logistic(size=2000)
    y = np.searchsorted([0.0, 1.5], score)
    w, cuts = o.cumulative_fit(x, y, 3, steps=1500)
    assert np.allclose(w, [2, -1, 0], atol=0.3) and np.allclose(cuts, [0, 1.5], atol=0.3)


def test_odd_rows(spark, frame, empty):
    words = ["nice day in town", "you are scum and trash"]
    docs = spark.createDataFrame([(i, f"{words[i % 2]} number {i}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(None, 1), (3, None), (0, 0), (0, 0), (9999, 1)], "doc_id long, toxic int")
    model = o.fit(docs, labels)
    df = frame("scum of the earth, trash", "a nice day", "word " * 300_000)
    got = o.predict(df, model).collect()
    assert len(got) == df.count()
    by_id = {r["doc_id"]: r["toxic"] for r in got if r["doc_id"] is not None}
    assert by_id[0] and not by_id[1]
    assert o.predict(empty, model).count() == 0
    assert o.fit(docs, labels.where("toxic = 0")) is None and o.fit(docs, labels.limit(0)) is None
    assert {r["severity"] for r in o.predict(df, None).collect()} == {0.0}
