import random
import re
from collections import Counter, defaultdict

import numpy as np
from eddyline.llm import fast_similarity as g
from eddyline.llm import list_links
from pyspark.sql import functions as F

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingle_set(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + 4]) for i in range(max(len(words) - 3, 1))) if words else frozenset()


def brute(rows):
    """(id, set size, component, kept) by row; rows are (id, text)."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for j, n in Counter(j for h in s for j in where[h]).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for h in s:
            where[h].append(i)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted((doc_id, len(sets[i]), least[find(i)], doc_id == least[find(i)]) for i, (doc_id, _) in enumerate(rows))


def compare(spark, rows):
    out = g.near_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, out.collect())) == brute(rows)


def slow_sketch(items):
    """The rounds one by one, on Python integers."""

    def mixed(x):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> shift) * factor % 2**64
        return x ^ x >> 31

    t, out = g.COORDINATES, [None] * g.COORDINATES
    for i in range(2 * t):
        for x in items:
            h = mixed(x ^ int(g._SEEDS[i]))
            place = (h >> 32) * t >> 32 if i < t else i - t
            value = (i, h % 2**32)
            out[place] = min(out[place] or value, value)
        if all(out):
            break
    return [i << 32 | h for i, h in out]


def test_the_sketch_is_that_of_the_slow_rounds():
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (1, 2, 3, 10, 200, 3000)]
    got = g.sketch(sets)
    assert [row.tolist() for row in got] == [slow_sketch(s.tolist()) for s in sets]
    assert (got != g._EMPTY).all()
    assert (g.sketch([np.zeros(0, np.uint64), sets[0]])[1] == got[0]).all()


def test_coordinates_agree_like_the_sets():
    rng = np.random.default_rng(1)
    for both, only in ((8, 2), (80, 20), (800, 200), (30, 30)):
        share = []
        for _ in range(200):
            x = rng.integers(0, 2**63, both + only, dtype=np.uint64)
            a, b = g.short_sketch([x[: both + only // 2], np.concatenate([x[:both], x[both + only // 2 :]])])
            share.append((a == b).mean())
        want = both / (both + only)
        assert abs(np.mean(share) - want) < 0.02 and np.std(share) < 1.3 * (want * (1 - want) / g.COORDINATES) ** 0.5


def test_pairs_at_the_threshold_meet_in_a_band_and_agree_enough():
    rng = np.random.default_rng(3)
    for both in [*range(4, 40, 4), 100, 400]:
        sets = []
        for _ in range(300):
            x = rng.integers(0, 2**63, both + both // 4, dtype=np.uint64)
            cut = both + rng.integers(0, both // 4 + 1)
            sets += [x[:cut], np.concatenate([x[:both], x[cut:]])]
        s = g.short_sketch(sets)
        a, b = s[::2], s[1::2]
        assert (a.view(np.uint64) == b.view(np.uint64)).any(1).all()
        assert ((a == b).mean(1) >= g.LEAST).all()


def test_the_documents(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    out = g.op12_fast_similarity(spark, folder)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, out.collect())) == brute(rows)


def near_copies(rng, n):
    base = [f"w{rng.randrange(40)}" for _ in range(n)]
    for _ in range(rng.randrange(12)):
        words = list(base)
        for _ in range(rng.randrange(1 + n // 30 + 1)):
            k = rng.randrange(len(words))
            words[k : k + rng.randrange(2)] = [f"v{rng.randrange(9)}"][: rng.randrange(2)]
        yield " ".join(words)


def test_groups_of_all_sizes(spark, monkeypatch):
    monkeypatch.setattr(g, "SMALL_LIST", 5)
    monkeypatch.setattr(list_links, "PART", 4)
    monkeypatch.setattr(list_links, "COLUMNS", 7)
    rng = random.Random(6)
    texts = [t for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 17, 25, 40, 41, 60, 90, 140, 260) for _ in range(3) for t in near_copies(rng, n)]
    base = [f"b{i}" for i in range(120)]
    for k in range(80):  # a loose group: many lists with several components
        words = list(base)
        for _ in range(rng.randrange(3, 9)):
            words[rng.randrange(120)] = f"x{rng.randrange(12)}"
        texts.append(" ".join(words))
    rng.shuffle(texts)
    compare(spark, list(enumerate(texts)))


def test_overlaps_and_links_of_a_block(monkeypatch):
    monkeypatch.setattr(list_links, "COLUMNS", 5)
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 30, rng.integers(0, 25))) for _ in range(14)]
    got = list_links.overlaps(sets[:6], sets[6:])
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[6:]] for a in sets[:6]]
    assert list_links.overlaps([], sets).shape == (0, 14)
    base = np.arange(100)
    near = [np.append(base[k:], 1000 + np.arange(k)) for k in (0, 5, 40, 45)]  # 0 and 1 are similar, 2 and 3 too
    m = {"set": near, "n": np.full(4, 100), "shared": np.full(4, 100), "group": np.array([7, 8, 9, 10])}
    a, b = list_links.block_links(m, np.arange(4), np.arange(4), 80, 100)
    assert sorted(map(tuple, np.sort(np.stack([a, b], 1)).tolist())) == [(0, 1), (2, 3)]


def test_odd_rows(spark, frame, empty):
    text = " ".join(f"word{i}" for i in range(30))
    df = frame(text, text.upper() + "\n", "one two", "one\ttwo", " \n ")
    want = [(0, 27, 0, True), (0, 27, 0, True), (1, 27, 0, False), (2, 1, 2, True), (3, 1, 2, False), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (None, 27, None, True)]
    assert sorted(map(tuple, g.near_groups(df).collect()), key=str) == sorted(want, key=str)
    assert g.near_groups(empty).count() == 0
    other = " ".join(f"other{i}" for i in range(30))
    rows = spark.createDataFrame([(2, text), (2, other), (3, other), (4, text), (4, text)], "doc_id long, text string")
    assert sorted((r[0], r[2]) for r in g.near_groups(rows).collect()) == [(2, 2), (2, 2), (3, 2), (4, 2), (4, 2)]


def test_a_very_long_text_and_a_large_group_of_copies(spark):
    rng = random.Random(9)
    long_text = " ".join(f"l{rng.randrange(10**5)}" for _ in range(200_000))
    base = [f"w{i}" for i in range(200)]
    rows = [(0, long_text), (1, long_text + " end"), (2, "x" * (1 << 21))]
    rows += [(i, " ".join(base)) for i in range(10, 200)]
    for i in range(200, 420):
        words = list(base)
        words[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(words)))
    out = {r["doc_id"]: r["component_id"] for r in g.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0] == out[1] == 0 and out[2] == 2 and {c for i, c in out.items() if i >= 10} == {10}
