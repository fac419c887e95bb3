import hashlib
import random

import numpy as np
import pytest
from eddyline.llm import suffix_dedup as s
from hypothesis import given, settings
from hypothesis import strategies as st


def brute(rows):
    """(n_bytes, n_removed, n_spans, digest) by (id, text), rows in order of id."""
    seen, out = set(), {}
    for doc_id, text in rows:
        raw = text.encode()
        gone = np.zeros(len(raw) + 1, np.int64)
        for i in range(len(raw) - s.LENGTH + 1):
            window = raw[i : i + s.LENGTH]
            if window in seen:
                gone[i] += 1
                gone[i + s.LENGTH] -= 1
            seen.add(window)
        cover = np.cumsum(gone[:-1]) > 0
        kept = bytes(c for c, g in zip(raw, cover) if not g)
        out[doc_id] = (len(raw), int(cover.sum()), int((np.diff(cover.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from([97, 98]), min_size=1, max_size=300))
def test_suffix_array_and_common_prefixes(values):
    text = np.array(values, np.uint8)
    raw = text.tobytes()
    order = s.suffix_array(text)
    want = sorted(range(len(raw)), key=lambda i: raw[i:])
    assert order.tolist() == want
    cap = 20
    got = s.common_prefixes(text, order, np.array([0]), np.array([len(raw)]), cap)
    for k in range(1, len(raw)):
        a, b = raw[want[k - 1] :], raw[want[k] :]
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert got[k] == min(n, cap)


def texts(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    passage = " ".join(word() for _ in range(60))
    out = []
    for i in range(120):
        own = " ".join(word() for _ in range(rng.randint(0, 120)))
        cut = rng.randint(0, 60)
        out.append(rng.choice([own, own + passage, passage[cut:] + own, own + passage[cut : cut + 150] + word(), passage, "ab" * rng.randint(20, 300), own + own]))
    return out + [out[5], out[5][:130], "x" * 9000, "xy" * 5000, ""]


def compare(spark, rows):
    got = {r["doc_id"]: tuple(r)[1:] for r in s.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_against_brute_force(spark):
    compare(spark, list(enumerate(texts())))


@pytest.mark.parametrize("crowd", [2, 10**9])
def test_crowded_anchors_are_merged(spark, monkeypatch, crowd):
    """Noticed by one batch, or from the bytes of an anchor over the corpus."""
    monkeypatch.setattr(s, "CROWD", crowd)
    monkeypatch.setattr(s, "SHARD_BYTES", 2000)
    monkeypatch.setattr(s, "REGION", 50)
    compare(spark, list(enumerate(texts(8))))


def test_the_documents(spark):
    folder = "/root/testdata/sf0.001"
    rows = sorted(map(tuple, spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()))
    got = {r["doc_id"]: tuple(r)[1:] for r in s.op5_suffix_dedup(spark, folder).collect()}
    assert got == brute(rows)


def test_odd_rows(spark, frame, empty):
    long = "".join(f"{i} and " for i in range(400))
    df = frame(long, long + "tail", "short")
    rows = s.deduplicate(df).collect()
    assert len(rows) == df.count()
    kept = sorted((str(r["doc_id"]), bytes(r["kept"]).decode()) for r in rows)
    assert kept[0] == kept[1] == ("0", long) and kept[2] == ("1", "tail") and kept[-1] == ("None", long)
    assert s.digests(empty).count() == 0
