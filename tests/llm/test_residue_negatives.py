import math

import numpy as np
from eddyline.llm import residue_negatives as g
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int, key string, x int, block long, kind string, dims long"


def brute(rows, every=50, n_positives=5, n_negatives=3):
    """Rows are (id, vector, label); distinct ones take part, as Python integers."""
    seen = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        x = tuple(math.floor(256 * float(c)) for c in v)
        if sum(c * c for c in x) < 2**56:
            seen[i, label, x] = None
    out = []
    for i, label, x in seen:
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(x, y)), j, other) for (j, other, y) in seen if (j, other, y) != (i, label, x)]
        for score, j, _ in sorted(s for s in scored if s[2] == label)[:n_positives]:
            window = sorted(s for s in scored if s[2] != label and 50 * -score <= 100 * -s[0] <= 95 * -score)
            out += [(i, j, rank, k, -score, -other) for rank, (other, k, _) in enumerate(window[:n_negatives], 1)]
    return sorted(out)


def got(df, **options):
    return sorted(map(tuple, g.hard_negatives(df, **options).collect()))


def test_scores_are_exact_at_every_size():
    rng = np.random.default_rng(4)
    for top in (3, 255, 60_000, 1 << 23):
        for d in (1, 63, 64, 65, 200):
            x, y = (rng.integers(-top, top + 1, (n, d)).astype(np.int32) for n in (7, 11))
            a, b = (g.Rows(np.arange(len(z)), np.zeros(len(z), int), np.arange(len(z)), z) for z in (x, y))
            want = x.astype(object) @ y.astype(object).T
            if a.norm * b.norm < 2**56:
                assert (g.scores(a, b) == want.astype(np.int64)).all()
    assert len(g.primes_for(2**56 + 1)) <= len(g.PRIMES) and math.prod(g.PRIMES[:6]) < 2**62


def test_the_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in df.collect()]
    out = g.op11_residue_negatives(spark, "/root/testdata/sf0.01")
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert dict(out.dtypes)["rank"] == "int"
    assert sorted(map(tuple, out.collect())) == brute(rows)


def test_ties_copies_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(g, "BLOCK_BYTES", 512)
    rng = np.random.default_rng(8)
    rows = [(int(i), [float(c) for c in rng.integers(-2, 4, 3) / 2], int(rng.integers(0, 3))) for i in rng.permutation(240)]
    rows += rows[:40]  # repeated rows
    rows += [(50, [1.0, 1.0, 1.0], 1), (50, [0.5, 2.0, 1.0], 1), (100, [2.0, 1.0], 2), (150, [], 0), (3, [1.0, 1.0, 0.5, 9.0], 1)]
    rows += [(None, [1.0, 2.0, 1.0], 1), (200, None, 1), (200, [1.0, None, 2.0], 0), (0, [float("nan"), 1.0, 1.0], 1), (0, [1.0, float("inf"), 1.0], 1), (0, [1.0, 1.0, 1.0], None), (350, [3e30, 1.0, 1.0], 2)]
    df = spark.createDataFrame([(*r, "k", 1, 2, "q", 3) for r in rows], SCHEMA)
    assert got(df) == brute(rows)
    assert got(df, every=7, n_positives=2, n_negatives=4) == brute(rows, 7, 2, 4)


def test_large_values_and_few_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(0, 9000, 70)], i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert got(df, every=10) == brute(rows, 10)
    assert got(df.where("label = 1")) == [] and got(df.limit(0)) == [] and got(df.where("vec_id = 50")) == []
    one = df.where(F.col("vec_id").isin(0, 2, 3))
    assert got(one) == brute([r for r in rows if r[0] in (0, 2, 3)])
