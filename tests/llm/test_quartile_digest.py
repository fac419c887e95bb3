import hashlib

import numpy as np
from eddyline.llm import quartile_digest as q
from pyspark.sql import functions as F


def check(rows, got):
    """``rows`` in descending order, each against the one after it."""
    want = []
    for k, (doc_id, text) in enumerate(rows):
        text, then = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + then[:half]
        own, other, follow = (q.digest(t.encode()) for t in (text, new, then))
        want.append((doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), own.tobytes().hex(), other.tobytes().hex(), q.likeness(own, other), q.likeness(own, follow)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_the_documents(spark, documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    got = q.op10_quartile_digest(spark, "/root/testdata/sf0.001").collect()
    check(sorted(rows, reverse=True), got)
    assert np.mean([r["near_edited"] > r["near_next"] for r in got]) > 0.97


def test_odd_rows(spark, frame, empty):
    df = frame("é" * 999, "abc", "x" * 50_000)
    rows = [(r["doc_id"], r["text"] or "") for r in df.collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, r[1]), reverse=True)
    check(rows, q.edited_pairs(df).collect())
    assert q.edited_pairs(empty).count() == 0 and q.fingerprints(empty).count() == 0
    one = spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")
    check([(1, "abcdef")], q.edited_pairs(one).collect())


def test_likeness_is_bounded_and_follows_the_change():
    rng = np.random.default_rng(2)
    a = rng.integers(97, 123, 4000, dtype=np.uint8)
    digests = []
    for share in (0, 200, 1000, 4000):
        b = a.copy()
        b[:share] = rng.integers(97, 123, share, dtype=np.uint8)
        digests.append(q.likeness(q.digest(a.tobytes()), q.digest(b.tobytes())))
    assert digests[0] == 1.0 and digests == sorted(digests, reverse=True) and 0 <= min(digests)
    assert q.likeness(q.digest(b""), q.digest(b"")) == 1.0 and set(q.digest(b"")) == {0}


def test_chunks_do_not_change_counts(monkeypatch):
    raw = bytes(np.random.default_rng(1).integers(0, 256, 10_000, dtype=np.uint8))
    whole = q.counts_of(raw)
    monkeypatch.setattr(q, "CHUNK", 777)
    assert (q.counts_of(raw) == whole).all()


def test_ids_of_other_types(spark):
    rows = [(i, f"text number {i} " * 20) for i in range(5)]
    for kind in ("smallint", "tinyint", "decimal(9,2)"):
        df = spark.createDataFrame(rows, "doc_id int, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
        got = {int(r["doc_id"]): r["n_chars"] for r in q.edited_pairs(df).collect()}
        assert got == {i: len(t) for i, t in rows}


def slow_digest(raw, buckets=256):
    """The definition on Python integers."""
    counts = [0] * buckets
    for k, (i, j) in enumerate(((3, 7), (4, 9), (5, 11))):
        for a in range(len(raw) - j):
            h = (raw[a] * 2654435761 + raw[a + i] * 2246822519 + raw[a + j] * 3266489917 + 668265263 * (k + 1)) % 2**32
            h = (h ^ h >> 15) * 2246822519 % 2**32
            counts[h >> 24] += 1
    ordered = sorted(counts)
    quarter = [sum(c > ordered[buckets * k // 4 - 1] for k in (1, 2, 3)) for c in counts]
    packed = [quarter[a] << 6 | quarter[a + 1] << 4 | quarter[a + 2] << 2 | quarter[a + 3] for a in range(0, buckets, 4)]
    return [min(255, round(np.log2(1 + len(raw)) * 8)), *packed]


def slow_likeness(a, b):
    steps = sum(abs((x >> s & 3) - (y >> s & 3)) for x, y in zip(a[1:], b[1:]) for s in (0, 2, 4, 6))
    return max(0.0, 1 - (steps + min(48.0, abs(a[0] - b[0]))) / (3 * 4 * (len(a) - 1) + 48.0))


def test_digests_equal_the_definition(monkeypatch, documents):
    texts = ["", "a", "abcdefghijkl", "é" * 40, "x" * 500, *[r["text"] or "" for r in documents.select("text").limit(25).collect()]]
    raw = [t.encode()[:20_000] for t in texts]
    want = [slow_digest(r) for r in raw]
    for chunk in (q.CHUNK, 97):
        monkeypatch.setattr(q, "CHUNK", chunk)
        assert [q.digest(r).tolist() for r in raw] == want
    for x in range(0, len(raw), 3):
        for y in range(len(raw)):
            got = q.likeness(np.array(want[x], np.uint8), np.array(want[y], np.uint8))
            assert abs(got - slow_likeness(want[x], want[y])) < 1e-12
