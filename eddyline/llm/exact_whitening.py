"""Whitening of embeddings from the exact characteristic polynomial of their scatter matrix.

1. Components become whole numbers y = floor(1024 c). Tasks add up counts, sums and products
   as exact integers, summed by Spark; n times the sum of products less the product of the
   sums is n^2 times the covariance, an integer matrix M.
2. Modulo a prime M becomes upper Hessenberg by similarity, from which a recurrence gives
   the characteristic polynomial modulo that prime. Primes are dealt over tasks, and Chinese
   remaindering joins the coefficients; Maclaurin's inequality bounds them by the trace.
3. All roots are real, so by Descartes' rule the sign changes of p(x + a) count the roots
   above a exactly, equal ones as often as they occur. Exact Taylor shifts thus isolate the
   largest roots to ``BITS`` binary digits.
4. Inverse iteration on M - root in fixed point numbers of 2 ``BITS`` digits finds the null
   space; vectors of equal roots are made orthogonal. The result is rounded to doubles.
5. One pass projects the rows, another one adds up the covariance of the projections, whose
   distance from the identity is reported.

What reaches the driver depends on the number of dimensions alone.

Defined cases: rows with a null vector, or a null or non-finite component, take no part; nor
do rows with a component of 2^40 or more after scaling, or of another length than most rows
(of equally frequent lengths the longer counts). Rows that repeat count as often as they
occur. Components of zero variance do not exist: there are as many as the rank, and at most
``COMPONENTS``; equal rows only, or none, give no result. ``deviation`` is null where it does
not fit a long. A null id is kept.
"""

from __future__ import annotations

from decimal import Context, Decimal
from math import comb, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eddyline.llm.common import bound_batches, table
from eddyline.session import stage

COMPONENTS = 8
SCALE = 1024
BITS = 128
LIMB = 20
LIMIT = 2.0**40
ROWS = 4096
PRIMES_A_TASK = 24


def scaled(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, dims, x): the rows that take part, x as packed 64 bit integers."""
    bound_batches(df.sparkSession)
    taken = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("v IS NOT NULL")

    def run(batches):
        for batch in batches:
            column = batch.column("v")
            v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null becomes NaN
            edges = column.offsets.to_numpy() - column.offsets[0].as_py()
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(scale * v)
            fits = np.abs(x) < LIMIT
            bad = np.concatenate([np.zeros(1, np.int64), np.cumsum(~fits)])
            kept = np.flatnonzero(bad[edges[1:]] == bad[edges[:-1]])
            packed = np.where(fits, x, 0).astype("<i8").tobytes()
            blobs = [packed[8 * edges[i] : 8 * edges[i + 1]] for i in kept]
            sizes = (edges[1:] - edges[:-1])[kept]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(kept)), pa.array(sizes, pa.int32()), pa.array(blobs, pa.binary())], ["vec_id", "dims", "x"])

    return taken.mapInArrow(run, f"vec_id {dict(df.dtypes)[id_col]}, dims int, x binary")


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("x").to_pylist()), "<i8").reshape(-1, d)


def _pieces(batch: pa.RecordBatch):
    for at in range(0, batch.num_rows, ROWS):
        yield batch.slice(at, ROWS)


def products(x: np.ndarray) -> np.ndarray:
    """x.T @ x as Python integers: products of limbs below 2^20 over at most 4,096 rows are
    exact in doubles."""
    limbs, rest = [], x
    while True:
        high = rest >> LIMB
        small = not (high + (rest < 0)).any()
        limbs.append((rest if small else rest - (high << LIMB)).astype(np.float64))
        if small:
            break
        rest = high
    total = np.zeros((x.shape[1],) * 2, object)
    for j, a in enumerate(limbs):
        for k, b in enumerate(limbs):
            total += (a.T @ b).astype(np.int64).astype(object) << (LIMB * (j + k))
    return total


def moments(rows: DataFrame, d: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, their sums and their sums of products, exactly."""
    upper = np.triu_indices(d + 1)

    def run(batches):
        total = np.zeros((d + 1, d + 1), object)
        for batch in batches:
            for piece in _pieces(batch):
                x = _matrix(piece, d)
                total += products(np.concatenate([np.ones((len(x), 1), np.int64), x], axis=1))
        if total[0, 0]:
            values = [Decimal(int(v)) for v in total[upper]]
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()) for k in upper] + [pa.array(values, pa.decimal128(38, 0))], ["i", "j", "v"])

    sums = rows.mapInArrow(run, "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(F.sum("v").alias("v"))
    whole = np.zeros((d + 1, d + 1), object)
    for i, j, v in sums.collect():  # dimensions squared, whatever the rows
        whole[i, j] = whole[j, i] = int(v)
    return int(whole[0, 0]), whole[0, 1:], whole[1:, 1:]


def primes_below(start: int):
    """Primes below ``start``, descending, by Miller-Rabin with bases that decide 32 bits."""
    for p in range(start - 1 | 1, 2, -2):
        odd, twos = p - 1, 0
        while odd % 2 == 0:
            odd, twos = odd // 2, twos + 1
        if all(pow(a, odd, p) in (0, 1) or any(pow(a, odd << k, p) == p - 1 for k in range(twos)) for a in (2, 3, 5, 7)):
            yield p


def charpoly_mod(matrix: np.ndarray, primes: np.ndarray) -> np.ndarray:
    """Coefficients of det(x - matrix) modulo each of the primes (below 2^31), from the
    constant up: a row per prime. Hessenberg form by similarity, then the recurrence over its
    leading blocks."""
    d, p = len(matrix), primes.astype(np.int64)
    h = np.array([(matrix % int(q)).astype(np.int64) for q in p])
    rows = np.arange(len(p))
    for k in range(d - 2):
        pivot = k + 1 + (h[:, k + 1 :, k] != 0).argmax(1)
        swap = h[rows, pivot].copy()
        h[rows, pivot], h[:, k + 1] = h[:, k + 1].copy(), swap
        swap = h[rows, :, pivot].copy()
        h[rows, :, pivot], h[:, :, k + 1] = h[:, :, k + 1].copy(), swap
        inverse = np.array([pow(int(a), -1, int(q)) if a else 0 for a, q in zip(h[:, k + 1, k], p)])
        factor = h[:, k + 2 :, k] * inverse[:, None] % p[:, None]
        h[:, k + 2 :] = (h[:, k + 2 :] - factor[:, :, None] * h[:, k + 1, None] % p[:, None, None]) % p[:, None, None]
        h[:, :, k + 1] = (h[:, :, k + 1] + (h[:, :, k + 2 :] * factor[:, None] % p[:, None, None]).sum(2)) % p[:, None]
    polys = np.zeros((d + 1, len(p), d + 1), np.int64)
    polys[0, :, 0] = 1
    for m in range(1, d + 1):
        now = np.zeros((len(p), d + 1), np.int64)
        now[:, 1:] = polys[m - 1][:, :-1]
        now = (now - polys[m - 1] * h[:, m - 1, m - 1, None]) % p[:, None]
        below = np.ones(len(p), np.int64)
        for i in range(m - 2, -1, -1):
            below = below * h[:, i + 1, i] % p
            now = (now - polys[i] * (below * h[:, i, m - 1] % p)[:, None]) % p[:, None]
        polys[m] = now
    return polys[d]


def characteristic_polynomial(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Exact coefficients of det(x - matrix), from the constant up, of an integer matrix
    without negative eigenvalues."""
    d, trace = len(matrix), int(np.trace(matrix))
    bound = max(comb(d, k) * (trace + d) ** k // d**k + 1 for k in range(d + 1))
    primes, product = [], 1
    for q in primes_below(1 << 31):
        primes.append(q)
        product *= q
        if product > 2 * bound:
            break

    def run(batches):
        for batch in batches:
            own = batch.column("prime").to_numpy()
            if len(own):
                found = charpoly_mod(matrix, own)
                yield pa.RecordBatch.from_arrays([batch.column("prime"), pa.array(found.tolist(), pa.list_(pa.int64()))], ["prime", "coefficients"])

    dealt = spark.createDataFrame([(q,) for q in primes], "prime long").repartition(-(-len(primes) // PRIMES_A_TASK))
    found = {q: c for q, c in dealt.mapInArrow(run, "prime long, coefficients array<long>").collect()}
    weights = [product // q * pow(product // q, -1, q) for q in primes]
    out = []
    for k in range(d + 1):
        c = sum(found[q][k] * w for q, w in zip(primes, weights)) % product
        out.append(c - product if c > product // 2 else c)
    return out


def roots_above(poly: list[int], a: int) -> int:
    """How many roots of ``poly``, all of them real, exceed a."""
    c = list(poly)
    for low in range(len(c) - 1):
        for k in range(len(c) - 2, low - 1, -1):
            c[k] += a * c[k + 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def _newton(poly: list[int], x: int, steps: int = 4) -> int:
    """A root near x, in whole numbers."""
    for _ in range(steps):
        value = slope = 0
        for c in reversed(poly):
            value, slope = value * x + c, slope * x + value
        if not slope:
            break
        x -= value // slope
    return x


def largest_roots(poly: list[int], top: int, count: int) -> tuple[list[int], int]:
    """The ``count`` largest positive roots, all below ``top``, times 2^s and rounded down
    (a root that is whole: less one); equal roots are repeated. Bisection and Newton steps
    only propose: every root is certified by counts on both sides."""
    s = max(0, BITS - top.bit_length())
    d = len(poly) - 1
    wide = [c << (s * (d - k)) for k, c in enumerate(poly)]
    count = min(count, roots_above(poly, 0))
    out: list[int] = []
    while len(out) < count:
        rank = len(out) + 1  # the last cell with at least so many roots above its lower end
        low, high, step = 0, out[-1] + 1 if out else top << s, 0
        while high - low > 1:
            step += 1
            if step % 16 == 0:
                x = _newton(wide, (low + high) // 2)
                near = next((c for c in (x, x - 1) if low <= c < high and roots_above(wide, c) >= rank > roots_above(wide, c + 1)), None)
                if near is not None:
                    low, high = near, near + 1
                    break
            mid = (low + high) // 2
            low, high = (mid, high) if roots_above(wide, mid) >= rank else (low, mid)
        out += [low] * (roots_above(wide, low) - roots_above(wide, low + 1))
    return out[:count], s


def null_vector(matrix: np.ndarray, root: int, s: int, earlier: list[np.ndarray], steps: int = 3) -> np.ndarray:
    """A unit vector of the null space of matrix - root 2^-s by inverse iteration, orthogonal
    to ``earlier``; in fixed point with 2 ``BITS`` binary digits."""
    d, digits = len(matrix), 2 * BITS
    a = np.array([[int(v) << digits for v in row] for row in matrix], object)
    for i in range(d):
        a[i, i] -= (2 * root + 1) << (digits - s - 1)
    order = list(range(d))
    for k in range(d):  # triangular factors, with row exchanges
        p = max(range(k, d), key=lambda i: abs(a[i, k]))
        if p != k:
            a[[k, p]] = a[[p, k]]
            order[k], order[p] = order[p], order[k]
        a[k, k] = a[k, k] or 1  # singular: the smallest number instead
        if k + 1 < d:
            a[k + 1 :, k] = (a[k + 1 :, k] << digits) // a[k, k]
            a[k + 1 :, k + 1 :] -= (a[k + 1 :, k, None] * a[None, k, k + 1 :]) >> digits
    start = np.random.default_rng(len(earlier)).integers(-(1 << 30), 1 << 30, d)
    x = np.array([int(v) for v in start], object) << (digits - 30)
    for _ in range(steps):
        x = _unit(_without(x, earlier, digits), digits)[order]
        for k in range(1, d):
            x[k] -= int((a[k, :k] * x[:k]).sum()) >> digits
        for k in range(d - 1, -1, -1):
            x[k] = ((x[k] - (int((a[k, k + 1 :] * x[k + 1 :]).sum()) >> digits)) << digits) // a[k, k]
        x = _unit(x, digits)
    return _unit(_without(x, earlier, digits), digits)


def _without(x: np.ndarray, earlier: list[np.ndarray], digits: int) -> np.ndarray:
    for e in earlier:
        x = x - (e * (int((e * x).sum()) >> digits) >> digits)
    return x


def _unit(x: np.ndarray, digits: int) -> np.ndarray:
    size = isqrt(int((x * x).sum()))
    return np.array([(int(v) << digits) // max(size, 1) for v in x], object)


def principal(spark: SparkSession, n: int, sums: np.ndarray, squares: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit eigenvectors as columns, eigenvalues of the covariance, their share of its
    trace) of the ``count`` largest eigenvalues that are not zero."""
    m = n * squares - sums[:, None] * sums[None]
    trace = int(np.trace(m))
    d = len(m)
    if not trace:
        return np.zeros((d, 0)), np.zeros(0), np.zeros(0)
    poly = characteristic_polynomial(spark, m)
    roots, s = largest_roots(poly, trace + 1, count)
    vectors: list[np.ndarray] = []
    for root in roots:
        vectors.append(null_vector(m, root, s, vectors))
    exact = Context(prec=60)
    columns = np.array([[float(exact.divide(Decimal(int(c)), Decimal(1 << (2 * BITS)))) for c in v] for v in vectors]).T
    middle = [Decimal(2 * r + 1) for r in roots]  # each root is within half a unit
    values = np.array([float(exact.divide(v, Decimal(n * n << (s + 1)))) for v in middle])
    shares = np.array([float(exact.divide(v, Decimal(trace << (s + 1)))) for v in middle])
    return columns, values, shares


def whitened(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, count: int = COMPONENTS) -> DataFrame:
    """A row per remaining row and component: (vec_id, component, n, deviation, whitened,
    explained, identity_error). A constant added to all entries changes none of them."""
    spark = df.sparkSession
    rows = stage(scaled(df, id_col, vector_col, scale), "whitening-rows")
    common = rows.groupBy("dims").count().orderBy(F.desc("count"), F.desc("dims")).first()
    d = common["dims"] if common else 0
    rows = rows.where(F.col("dims") == d)
    kind = dict(rows.dtypes)["vec_id"]
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double"
    if not d:
        return spark.createDataFrame([], schema + ", identity_error double")
    n, sums, squares = moments(rows, d)
    vectors, values, shares = principal(spark, n, sums, squares, count)
    k = len(values)
    if not k:
        return spark.createDataFrame([], schema + ", identity_error double")
    directions = vectors / np.sqrt(values)

    def project(batches):
        for batch in batches:
            for piece in _pieces(batch):
                x = _matrix(piece, d)
                fits = n * int(np.abs(x).max()) + int(np.abs(sums).max()) < 1 << 62
                centered = n * x - sums.astype(np.int64) if fits else n * x.astype(object) - sums
                deviation = _squares(centered)
                w = (centered.astype(np.float64) / n) @ directions
                m = len(x)
                columns = [piece.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64))]
                columns.append(pa.array([v for v in deviation for _ in range(k)], pa.int64()))
                columns += [pa.array(w.reshape(-1)), pa.array(np.tile(shares, m))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained"])

    error = identity_error(rows, d, n, sums, directions)
    return rows.mapInArrow(project, schema).withColumn("identity_error", F.lit(error))


def _squares(centered: np.ndarray) -> list[int | None]:
    """Sum of squares of each row, exactly; None beyond a long."""
    top = int(np.abs(centered).max(initial=0))
    if top**2 * centered.shape[1] < 1 << 63:
        return (centered.astype(np.int64) ** 2).sum(1).tolist()
    exact = (int(sum(int(v) ** 2 for v in row)) for row in centered)
    return [v if v < 1 << 63 else None for v in exact]


def identity_error(rows: DataFrame, d: int, n: int, sums: np.ndarray, directions: np.ndarray) -> float:
    """Largest distance of the covariance of the projections from the identity, added up over
    all rows."""
    k = directions.shape[1]
    mean = np.array([float(int(v)) / n for v in sums])
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]

    def run(batches):
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            for piece in _pieces(batch):
                w = (_matrix(piece, d) - mean) @ directions
                w = np.concatenate([np.ones((len(w), 1)), w], axis=1)
                total += w.T @ w
        if total[0, 0]:
            yield pa.RecordBatch.from_arrays([pa.array(z, pa.int32()) for z in zip(*pairs)] + [pa.array([total[p] for p in pairs])], ["i", "j", "v"])

    sums_of = {(i, j): v for i, j, v in rows.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v")).collect()}
    mean_w = [sums_of[0, i] / n for i in range(1, k + 1)]
    return max(abs(sums_of[i, j] / n - mean_w[i - 1] * mean_w[j - 1] - (i == j)) for i in range(1, k + 1) for j in range(i, k + 1))


def op13_exact_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
