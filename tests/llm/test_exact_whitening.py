import math
from fractions import Fraction

import numpy as np
from eddyline.llm import exact_whitening as g

SCHEMA = "vec_id long, embedding array<float>, component string, n string, x int, i int, dims string"


def slow_charpoly(matrix):
    """Faddeev-LeVerrier on fractions, from the constant up."""
    d = len(matrix)
    a = [[Fraction(int(v)) for v in row] for row in matrix]
    m, c = [[Fraction(0)] * d for _ in range(d)], [Fraction(1)]
    for k in range(1, d + 1):
        m = [[sum(a[i][t] * m[t][j] for t in range(d)) + (c[-1] if i == j else 0) for j in range(d)] for i in range(d)]
        c.append(-sum(a[i][t] * m[t][i] for i in range(d) for t in range(d)) / k)
    return [int(v) for v in reversed(c)]


def check(rows, out, dims, count=8):
    """Against sums in Python integers and numpy's eigenvectors; rows are the remaining (id, vector)."""
    x = [[math.floor(1024 * float(c)) + 100000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(r[k] for r in x) for k in range(dims)]
    deviation = {i: sum((n * c - s) ** 2 for c, s in zip(r, sums)) for (i, _), r in zip(rows, x)}
    y = np.array([[n * c - s for c, s in zip(r, sums)] for r in x], float) / n
    v = y.T @ y / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(count, int((values > 1e-9 * max(values[0], 1e-300)).sum()))
    assert len(out) == n * k
    want = {i: (y[r] @ vectors[:, :k]) / np.sqrt(values[:k]) for r, (i, _) in enumerate(rows)}
    signs = {}
    for r in out:
        c = r["component"] - 1
        assert r["n"] == n and r["deviation"] == deviation[r["vec_id"]] and r["identity_error"] < 1e-9
        assert math.isclose(r["explained"], values[c] / np.trace(v), rel_tol=1e-9)
        if abs(want[r["vec_id"]][c]) > 1e-3:
            sign = signs.setdefault(c, np.sign(want[r["vec_id"]][c] * r["whitened"]))
            assert abs(sign * r["whitened"] - want[r["vec_id"]][c]) < 1e-6
    assert set(signs) == set(range(k))


def test_products_are_exact():
    rng = np.random.default_rng(1)
    for top in (1, 1000, 1 << 20, 1 << 39):
        x = rng.integers(-top, top, (700, 5))
        assert (g.products(x) == x.astype(object).T @ x.astype(object)).all()


def test_polynomial_modulo_primes_and_joined(spark):
    rng = np.random.default_rng(2)
    for d in (1, 2, 3, 7):
        x = rng.integers(-9, 9, (d + 3, d)).astype(object)
        x[:, 0] = 0 if d == 3 else x[:, 0]
        m = x.T @ x
        want = slow_charpoly(m)
        assert g.characteristic_polynomial(spark, m) == want
        for p in (5, 97, 2147483647):
            assert g.charpoly_mod(m, np.array([p]))[0].tolist() == [c % p for c in want]
    first = [p for p, _ in zip(g.primes_below(1 << 31), range(3))]
    assert first == [2147483647, 2147483629, 2147483587]


def test_roots_are_counted_and_isolated():
    poly = [1]
    for r in (0, 0, 3, 7, 7, 7, 50, 1000):
        poly = [a - r * b for a, b in zip([0, *poly], [*poly, 0])]
    assert [g.roots_above(poly, a) for a in (0, 2, 3, 6, 7, 999, 1000)] == [6, 6, 5, 5, 2, 1, 0]
    roots, s = g.largest_roots(poly, 1100, 8)
    assert [-(-(r + 1) >> s) for r in roots] == [1000, 50, 7, 7, 7, 3]
    assert s > 100 and all(abs(Fraction(r, 1 << s) - w) <= Fraction(1, 1 << s) for r, w in zip(roots, (1000, 50, 7, 7, 7, 3)))


def test_the_embeddings(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    out = g.op13_exact_whitening(spark, folder)
    assert dict(out.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    check(rows, out.collect(), 64)


def test_close_and_equal_eigenvalues(spark):
    rng = np.random.default_rng(3)
    # every sign pattern: the covariance is diagonal; two entries have equal variance, one nearly
    rows = [(i, [(1 if i >> k & 1 else -1) * a for k, a in enumerate((3.0, 3.0, 2.0, 1.9990234375, 0.5))]) for i in range(32)]
    df = spark.createDataFrame([(*r, "a", "b", 1, 2, "c") for r in rows], SCHEMA)
    out = g.whitened(df).collect()
    by = {}
    for r in out:
        by.setdefault(r["component"], {})[r["vec_id"]] = r["whitened"]
    w = np.array([[by[c][i] for i in range(32)] for c in sorted(by)])
    assert np.abs(w @ w.T / 32 - np.eye(5)).max() < 1e-12 and max(r["identity_error"] for r in out) < 1e-12
    y = np.array([v for _, v in rows])
    assert np.abs(np.abs(w[2] @ y / 32) - [0, 0, 2.0, 0, 0]).max() < 1e-9 and np.abs(np.abs(w[3] @ y / 32) - [0, 0, 0, 1.9990234375, 0]).max() < 1e-9
    noisy = [(i, [float(c) for c in rng.normal(0, [5, 1, 1, 0.1])]) for i in range(50)]
    check([(i, [float(np.float32(c)) for c in v]) for i, v in noisy], g.whitened(spark.createDataFrame(noisy, "vec_id long, embedding array<float>")).collect(), 4)


def test_odd_rows(spark):
    good = [(i, [float(i % 5), float(i * i % 7), 1.0]) for i in range(40)]
    odd = [(90, None), (91, [1.0, None, 2.0]), (92, [1.0, float("nan"), 2.0]), (93, [float("-inf"), 1.0, 2.0]), (94, [1.0]), (95, []), (96, [3e38, 1.0, 1.0])]
    make = lambda rows: spark.createDataFrame([(*r, "a", "b", 1, 2, "c") for r in rows], SCHEMA)
    check(good, g.whitened(make(good + odd)).collect(), 3)
    repeated = g.whitened(make(good + good[:1])).collect()
    assert len(repeated) == 41 * 2 and {r["n"] for r in repeated} == {41}
    assert g.whitened(make([])).count() == 0 and g.whitened(make(odd[:1])).count() == 0
    assert g.whitened(make([(1, [2.0, 3.0]), (2, [2.0, 3.0])])).count() == 0 and g.whitened(make(good[:1])).count() == 0
    assert len(g.whitened(make(good + [(None, [1.0, 2.0, 1.0])])).where("vec_id IS NULL").collect()) == 2


def test_large_entries_keep_exact_deviations(spark):
    rows = [(i, [float(v), 1.0 * i]) for i, v in enumerate((1e8, -1e8, 5e7, 0.0))]
    out = g.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    x = [[math.floor(1024 * c) for c in v] for _, v in rows]
    for r in out:
        want = sum((4 * c - sum(z[k] for z in x)) ** 2 for k, c in enumerate(x[r["vec_id"]]))
        assert r["deviation"] == (want if want < 2**63 else None)
