import random

from eddyline.llm import components as C


def least_of_group(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {n: find(n) for n in list(parent) if find(n) != n}


def found(spark, edges):
    return {r["node"]: r["component"] for r in C.components(spark.createDataFrame(edges, "u long, v long")).collect()}


def test_components_of_chains_stars_and_random_edges(spark):
    draw = random.Random(3)
    chain = [(i, i + 1) for i in range(40)]
    star = [(1000 + i, 1500) for i in range(300)]
    loose = [(draw.randrange(5000, 5300), draw.randrange(5000, 5300)) for _ in range(150)]
    edges = [*chain, *star, *loose, (7, 7), (1500, 1000)]
    assert found(spark, edges) == least_of_group(edges)


def test_settled_stars_take_no_round(spark, monkeypatch):
    rounds = []
    kept = C._large
    monkeypatch.setattr(C, "_large", lambda edges: rounds.append(1) or kept(edges))
    stars = [(i, 0) for i in range(1, 50)] + [(100, i) for i in range(60, 61)]
    assert found(spark, stars) == least_of_group(stars)
    assert not rounds
    assert found(spark, [(i, 25) for i in range(50) if i != 25]) == {i: 0 for i in range(1, 50)}
    assert len(rounds) <= 2
