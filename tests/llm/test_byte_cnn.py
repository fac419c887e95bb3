import zlib

import numpy as np

from eddyline.llm import byte_cnn as b
from pyspark.sql import functions as F


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    rows = b.op4_byte_cnn(spark, folder).collect()
    assert {r["doc_id"] for r in rows} == set(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97


def test_odd_rows(spark, documents, frame, empty):
    net = b.fit(documents)
    german = documents.where("lang = 'de' AND n_chars > 2000").first()["text"]
    df = frame("the and attion to thanedble the", "12345 ... !!", german * 300)
    got = {r["doc_id"]: r for r in b.predict(df, net).where("doc_id IS NOT NULL").collect()}
    assert b.predict(df, net).count() == df.count()
    assert [got[i]["lang_pred"] == "und" for i in range(5)] == [False, True, False, True, True]
    assert got[1]["score"] == 0 and got[2]["lang_pred"] == "de"
    kept = b.keep_known(df, net)
    assert kept.columns == df.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["0", "0", "2", "None"]
    assert b.predict(empty, net).count() == 0 and b.fit(empty) is None
    assert {r["lang_pred"] for r in b.predict(df, None).collect()} == {"und"} and b.keep_known(df, None).count() == 0


def test_the_fit_leaves_the_held_out_fold_alone(documents):
    wrong = documents.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, "xx").otherwise(F.col("lang")))
    assert "xx" not in b.fit(wrong, docs_per_lang=30).langs


def slow_probabilities(net, window):
    """Every filter at every place, one by one, in double precision."""
    pooled = []
    for w in b.WIDTHS:
        k = net.kernels[w].astype(float)
        pooled += [max(sum(k[j, window[a + j], f] for j in range(w)) for a in range(len(window) - w + 1)) for f in range(b.FILTERS)]
    hidden = np.maximum(np.array(pooled) + net.bias, 0)
    z = hidden @ net.out.astype(float) + net.out_bias
    z = np.exp(z - z.max())
    return z / z.sum()


def test_the_network_equals_its_definition():
    rng = np.random.default_rng(3)
    net = b.Net.start(["x", "y", "z"])
    windows = rng.integers(0, 256, (3, 40)).astype(np.uint8)
    got = net.probabilities(net.pool(windows, net.pairs())[0])
    assert np.abs(got - [slow_probabilities(net, w) for w in windows]).max() < 1e-5


def test_the_first_step_follows_the_loss():
    """Adam's first step has the size of the rate and the sign of the slope, which finite
    differences of the loss give."""
    rng = np.random.default_rng(5)
    x, y = rng.integers(97, 105, (16, 30)).astype(np.uint8), rng.integers(0, 2, 16)
    start, after = b.Net.start(["x", "y"]), b.train(x, y, ["x", "y"], epochs=1, rate=1e-3)

    def loss(net):
        return -np.mean([np.log(slow_probabilities(net, w)[c]) for w, c in zip(x, y)])

    for name, places in (("out", [(0, 0), (5, 1), (40, 0)]), ("out_bias", [(0,), (1,)]), ("bias", [(2,), (17,), (33,)])):
        for place in places:
            slope = []
            for step in (1e-2, -1e-2):
                moved = b.Net(start.langs, start.kernels, *(p.copy() for p in (start.bias, start.out, start.out_bias)))
                getattr(moved, name)[place] += step
                slope.append(loss(moved))
            slope = (slope[0] - slope[1]) / 2e-2
            change = getattr(after, name)[place] - getattr(start, name)[place]
            assert abs(slope) < 1e-4 or np.sign(change) == -np.sign(slope)


def test_many_languages(spark):
    rows = [(i, f"{'abcdefghij'[i % 10] * 3} word{i % 300} " * 30, f"l{i % 300}") for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = b.fit(df)
    assert net is not None and len(net.langs) == 300
