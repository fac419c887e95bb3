import random
import re
from collections import Counter, defaultdict

import numpy as np
from eddyline.llm import components, list_links, ngram_join as g
from pyspark.sql import functions as F

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingle_set(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows):
    """Component and set size by row; rows are (id, text)."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i, s in enumerate(sets):
        shared = Counter(j for h in s for j in where[h])
        for j, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for h in s:
            where[h].append(i)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted((doc_id, len(sets[i]), least[find(i)]) for i, (doc_id, _) in enumerate(rows))


def compare(spark, rows):
    out = g.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, out.collect())) == brute(rows)


def test_the_documents(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, g.op9_ngram_join(spark, folder).collect())) == brute(rows)


def near_copies(rng, n):
    base = [f"w{rng.randrange(40)}" for _ in range(n)]
    for _ in range(rng.randrange(12)):
        words = list(base)
        for _ in range(rng.randrange(1 + n // 30 + 1)):
            k = rng.randrange(len(words))
            words[k : k + rng.randrange(2)] = [f"v{rng.randrange(9)}"][: rng.randrange(2)]
        yield " ".join(words)


def test_groups_of_all_sizes(spark):
    rng = random.Random(6)
    texts = [t for n in (1, 2, 4, 5, 6, 7, 8, 9, 12, 17, 25, 40, 41, 60, 90, 140, 260) for _ in range(3) for t in near_copies(rng, n)]
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [f"{passage} " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 40))) for _ in range(60)]
    rng.shuffle(texts)
    compare(spark, list(enumerate(texts)))


def test_loose_groups_in_blocks_and_in_rows(spark, monkeypatch):
    """Sets around the threshold: many lists with many components."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(160)]
    texts = []
    for _ in range(120):
        words = list(base)
        for _ in range(rng.randrange(2, 7)):
            words[rng.randrange(160)] = f"x{rng.randrange(5)}"
        texts.append(" ".join(words))
    monkeypatch.setattr(list_links, "PART", 16)
    for small in (3, 1000):
        monkeypatch.setattr(g, "SMALL_LIST", small)
        compare(spark, list(enumerate(texts)))


def test_similar_pairs_share_a_fragment():
    """No pair at the threshold may be lost, whatever the sizes."""
    rng = np.random.default_rng(3)
    for n in [*range(1, 60), 100, 257, 1000]:
        for _ in range(40 if n < 60 else 5):
            both = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            free = n * 100 // 80 - n
            x = rng.integers(0, free + 1) if free else 0
            a = np.unique(np.concatenate([both, rng.integers(0, 2**64, x, dtype=np.uint64)]))
            b = np.unique(np.concatenate([both, rng.integers(0, 2**64, free - x, dtype=np.uint64)]))
            assert np.intersect1d(g.fragment_hashes(a, 80, 100), g.fragment_hashes(b, 80, 100)).size


def test_odd_rows(spark, frame, empty):
    text = " ".join(f"word{i}" for i in range(30))
    df = frame(text, text.upper() + "\n", "one two", "one\ttwo", " \n ")
    rows = sorted(map(tuple, g.similar_groups(df).collect()), key=str)
    want = [(0, 26, 0), (0, 26, 0), (1, 26, 0), (2, 1, 2), (3, 1, 2), (4, 0, 4), (5, 0, 5), (6, 0, 6), (None, 26, None)]
    assert rows == sorted(want, key=str)
    kept = g.keep_one(df)
    assert kept.columns == df.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["0", "0", "2", "4", "5", "6", "None"])
    assert g.similar_groups(empty).count() == 0 and g.keep_one(empty).count() == 0


def test_words_in_chunks(monkeypatch):
    texts = ["alpha beta gamma " * 50, "a" * 64 + " " + "b" * 63 + " c", "x" * 500, " " * 64 + "y" * 200 + "  z", "q" * 128 + " r" + "s" * 62]
    whole = [g.word_hashes(t.encode()) for t in texts]
    monkeypatch.setattr(g, "CHUNK", 64)
    for text, hashes in zip(texts, whole):
        assert g.word_hashes(text.encode()).tolist() == hashes.tolist()
    monkeypatch.undo()
    long_word = "w" * (3 * g.CHUNK + 5)
    assert len(g.shingles(long_word)) == 1
    assert g.shingles(f"one two {long_word} three four").tolist() == g.shingles(f"\n ONE  two {long_word} three four ").tolist()


def test_rows_that_repeat_an_id_are_judged_by_their_text(spark):
    text, other = " ".join(f"word{i}" for i in range(30)), " ".join(f"other{i}" for i in range(30))
    rows = [(1, text), (2, text), (2, other), (3, other), (3, "alone"), (4, text)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, g.keep_one(df).collect())) == [(1, text), (2, other), (3, "alone")]


def test_a_large_class_is_dealt_over_many_parts(spark):
    text = " ".join(f"word{i}" for i in range(30))
    rows = [(i, text) for i in range(400)] + [(1000, text + " more")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    out = g.similar_groups(df)
    assert {r["component_id"] for r in out.collect()} == {0}


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(200 + i, 200 + rng.randrange(60)) for i in range(60)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {n: n for e in edges for n in e}
    for _ in range(100):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == {n: p for n, p in parent.items() if n != p}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_a_large_group_needs_few_pairs(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(300):
        words = list(base)
        words[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = g.similar_groups(df)
    assert out.select(F.countDistinct("component_id")).first()[0] == 1
