"""Permutation and bootstrap tests of a difference of means, on blocks of values.

The rows shrink to at most ``blocks`` blocks of neighbouring values, each with its counts,
sums and sums of squares per sample: that table, of a fixed size, is all a replicate needs.
Replicates are dealt over tasks in chunks; a chunk's draws are seeded by its number, so a
retried task repeats them.

Labels (or draws) are split over the blocks down a binary tree, one hypergeometric (or
binomial) draw per node and replicate, so group sizes are exact in every replicate. A block
of one distinct value needs nothing else. Where there are more distinct values than blocks,
the sum inside a block is drawn with its exact mean and variance from a normal distribution;
the mean and the variance of a replicate then are exact all the same.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddyline.operators.aggregates import value_prefix

BLOCKS = 4096
CHUNK = 100
EXACT_DRAW = 1_000_000_000  # numpy draws hypergeometric numbers of smaller urns only


@dataclass
class Table:
    """Counts, sums and centred sums of squares per block, for samples a and b."""

    n: np.ndarray  # (2, blocks)
    s: np.ndarray
    q: np.ndarray

    @property
    def sizes(self) -> tuple[int, int]:
        return int(self.n[0].sum()), int(self.n[1].sum())

    @property
    def observed(self) -> float | None:
        a, b = self.sizes
        return float(self.s[0].sum() / a - self.s[1].sum() / b) if a and b else None


def block_table(df: DataFrame, value: str, sample: str = "sample", blocks: int = BLOCKS) -> Table:
    """At most ``blocks`` rows reach the driver: a block per distinct value if they are few
    enough, else per range of about equally many rows."""
    label = {name: F.col(sample) == name for name in "ab"}
    rows = df.where(F.col(value).isNotNull() & F.col(sample).isin("a", "b")).select(F.col(value).cast("double").alias("v"), sample)
    counts = value_prefix(rows, [], "v", {f"n{x}": F.count_if(label[x]) for x in "ab"})
    distinct = counts.count()
    if distinct <= blocks:
        counts = counts.withColumn("block", F.col("v"))
    else:
        before = F.col("cum_na") + F.col("cum_nb") - F.col("na") - F.col("nb")
        counts = counts.withColumn("block", F.floor(before * blocks / (F.col("all_na") + F.col("all_nb"))).cast("double"))
    center = F.col("v") - F.col("m")
    means = counts.agg((F.sum(F.col("v") * (F.col("na") + F.col("nb"))) / F.sum(F.col("na") + F.col("nb"))).alias("m")).first()["m"] or 0.0
    counts = counts.withColumn("m", F.lit(means))
    sums = [F.sum(f"n{x}").alias(f"n{x}") for x in "ab"]
    sums += [F.sum(center * F.col(f"n{x}")).alias(f"s{x}") for x in "ab"] + [F.sum(center * center * F.col(f"n{x}")).alias(f"q{x}") for x in "ab"]
    found = sorted(counts.groupBy("block").agg(*sums).collect(), key=lambda r: r["block"])
    get = lambda c: np.array([[r[f"{c}{x}"] for r in found] for x in "ab"], float).reshape(2, -1)
    return Table(get("n"), get("s"), get("q"))


def _hypergeometric(rng: np.random.Generator, good: np.ndarray, bad: np.ndarray, k: np.ndarray) -> np.ndarray:
    total = good + bad
    small = total < EXACT_DRAW
    out = rng.hypergeometric(np.where(small, good, 0).astype(np.int64), np.where(small, bad, 1).astype(np.int64), np.where(small, k, 0).astype(np.int64)).astype(float)
    if not small.all():  # for such urns the normal form errs by less than a rounding step
        share = good / total
        spread = np.sqrt(np.maximum(k * share * (1 - share) * (total - k) / np.maximum(total - 1, 1), 0))
        normal = np.rint(k * share + spread * rng.standard_normal(k.shape))
        out = np.where(small, out, np.clip(normal, np.maximum(0, k - bad), np.minimum(k, good)))
    return out


def split_labels(rng: np.random.Generator, sizes: np.ndarray, k: np.ndarray) -> np.ndarray:
    """How many of ``k`` labels fall into each block of ``sizes`` rows: (replicates, blocks)."""
    return _down_the_tree(sizes, k, lambda left, right, at: _hypergeometric(rng, np.broadcast_to(left, at.shape), np.broadcast_to(right, at.shape), at))


def split_draws(rng: np.random.Generator, sizes: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The same for ``k`` draws with replacement."""

    def draw(left, right, at):
        share = np.divide(left, left + right, out=np.zeros_like(left), where=left + right > 0)
        return rng.binomial(at.astype(np.int64), np.broadcast_to(share, at.shape)).astype(float)

    return _down_the_tree(sizes, k, draw)


def _down_the_tree(sizes: np.ndarray, k: np.ndarray, draw) -> np.ndarray:
    width = 1 << max(0, int(np.ceil(np.log2(max(len(sizes), 1)))))
    levels = [np.pad(sizes.astype(float), (0, width - len(sizes)))]
    while len(levels[-1]) > 1:
        levels.append(levels[-1].reshape(-1, 2).sum(1))
    at = k.astype(float)[:, None]
    for level in reversed(levels[:-1]):
        left = draw(level[::2], level[1::2], at)
        at = np.stack([left, at - left], axis=2).reshape(len(k), -1)
    return at[:, : len(sizes)]


def _block_sums(rng: np.random.Generator, k: np.ndarray, n: np.ndarray, s: np.ndarray, q: np.ndarray, replace: bool) -> np.ndarray:
    """Sum of the drawn values per replicate, given how many were drawn in each block."""
    size = np.maximum(n, 1)
    mean, variance = s / size, np.maximum(q / size - (s / size) ** 2, 0)
    variance[variance < 1e-12 * np.maximum(q / size, 1e-300)] = 0  # one distinct value
    left = 1 if replace else (n - k) / np.maximum(n - 1, 1)
    return (k * mean).sum(1) + np.sqrt(np.maximum((k * variance * left).sum(1), 0)) * rng.standard_normal(len(k))


def _replicates(df: DataFrame, replicates: int, one_chunk) -> DataFrame:
    """(replicate, n_a, n_b, diff), from ``one_chunk(number, size)``."""

    def run(batches):
        for batch in batches:
            for number in batch.column("id").to_pylist():
                first = number * CHUNK
                n_a, n_b, diff = one_chunk(number, min(CHUNK, replicates - first))
                columns = [pa.array(np.arange(first, first + len(diff)), pa.int64()), pa.array(n_a.astype(np.int64)), pa.array(n_b.astype(np.int64)), pa.array(diff)]
                yield pa.RecordBatch.from_arrays(columns, ["replicate", "n_a", "n_b", "diff"])

    spark, chunks = df.sparkSession, -(-replicates // CHUNK)
    return spark.range(0, chunks, 1, min(chunks, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(run, "replicate long, n_a long, n_b long, diff double")


def permutation_null(df: DataFrame, table: Table, replicates: int = 9999, seed: int = 7) -> DataFrame:
    """The replicate distribution: labels dealt anew, group sizes as observed."""
    (size_a, size_b), n, s, q = table.sizes, table.n.sum(0), table.s.sum(0), table.q.sum(0)
    total = s.sum()

    def chunk(number: int, size: int):
        rng = np.random.Generator(np.random.Philox(key=[seed, number]))
        k = split_labels(rng, n, np.full(size, size_a))
        a = _block_sums(rng, k, n, s, q, replace=False)
        n_a = k.sum(1)
        return n_a, n.sum() - n_a, a / max(size_a, 1) - (total - a) / max(size_b, 1)

    return _replicates(df, replicates, chunk)


def permutation_test(df: DataFrame, value: str, sample: str = "sample", replicates: int = 9999, seed: int = 7, alpha: float = 0.05, blocks: int = BLOCKS) -> DataFrame:
    """Observed mean difference, p (twice the smaller tail, the observed one counted) and
    decision. No row without both samples."""
    table = block_table(df, value, sample, blocks)
    observed = table.observed
    spark = df.sparkSession
    if observed is None:
        return spark.createDataFrame([], "statistic double, replicates long, p_value double, decision string")
    slack = 1e-12 * max(1.0, abs(observed))
    low, high = (F.count_if(F.col("diff") <= observed + slack) + 1, F.count_if(F.col("diff") >= observed - slack) + 1)
    p = F.least(F.lit(1.0), 2 * F.least(low, high) / (F.count("*") + 1))
    out = permutation_null(df, table, replicates, seed).agg(F.lit(observed).alias("statistic"), F.count("*").alias("replicates"), p.alias("p_value"))
    return out.withColumn("decision", F.when(F.col("p_value") < alpha, F.lit("Reject H0")).otherwise(F.lit("Fail to Reject H0")))


def bootstrap_distribution(df: DataFrame, table: Table, replicates: int = 9999, seed: int = 7) -> DataFrame:
    """Mean differences of resamples, each sample drawn with replacement at its own size."""
    sizes = table.sizes

    def chunk(number: int, size: int):
        rng = np.random.Generator(np.random.Philox(key=[seed, number]))
        means, taken = [], []
        for x in (0, 1):
            k = split_draws(rng, table.n[x], np.full(size, sizes[x]))
            taken.append(k.sum(1))
            means.append(_block_sums(rng, k, table.n[x], table.s[x], table.q[x], replace=True) / max(sizes[x], 1))
        return taken[0], taken[1], means[0] - means[1]

    return _replicates(df, replicates, chunk)


def bootstrap_ci(df: DataFrame, value: str, sample: str = "sample", replicates: int = 9999, confidence: float = 0.95, seed: int = 7, blocks: int = BLOCKS) -> DataFrame:
    """Observed mean difference, percentile interval and whether it leaves out zero."""
    table = block_table(df, value, sample, blocks)
    if table.observed is None:
        return df.sparkSession.createDataFrame([], "statistic double, replicates long, ci_low double, ci_high double, decision string")
    tail = (1 - confidence) / 2
    # one number per replicate: an exact percentile over a fixed, small set
    out = bootstrap_distribution(df, table, replicates, seed).agg(
        F.lit(table.observed).alias("statistic"),
        F.count("*").alias("replicates"),
        F.percentile("diff", F.lit(tail)).alias("ci_low"),
        F.percentile("diff", F.lit(1 - tail)).alias("ci_high"),
    )
    apart = (F.col("ci_low") > 0) | (F.col("ci_high") < 0)
    return out.withColumn("decision", F.when(apart, F.lit("significant")).otherwise(F.lit("not significant")))


def null_checks(df: DataFrame, value: str, sample: str = "sample", replicates: int = 9999, seed: int = 7, blocks: int = BLOCKS) -> DataFrame:
    """(check, expected, ok): replicate distributions against what is known of them. Expected
    values come from the blocks; a simulated mean may be four standard errors away, a
    variance six hundredths."""
    table = block_table(df, value, sample, blocks)
    (a, b), n, s, q = table.sizes, table.n.sum(), table.s.sum(), table.q.sum()
    pooled = (q - s * s / n) / (n - 1) * (1 / a + 1 / b)
    own = [(table.q[x].sum() - table.s[x].sum() ** 2 / m) / m / m for x, m in ((0, a), (1, b))]
    rows = []
    for name, null, mean, variance in (
        ("permutation", permutation_null(df, table, replicates, seed), 0.0, pooled),
        ("bootstrap", bootstrap_distribution(df, table, replicates, seed), table.observed, sum(own)),
    ):
        found = null.agg(F.avg("diff"), F.var_pop("diff"), F.min("n_a"), F.max("n_a"), F.min("n_b"), F.max("n_b")).first()
        rows.append((f"{name} sizes", float(a + b), list(found[2:]) == [a, a, b, b]))
        rows.append((f"{name} mean", float(mean), bool(abs(found[0] - mean) <= 4 * (variance / replicates) ** 0.5)))
        rows.append((f"{name} variance", float(variance), bool(abs(found[1] - variance) <= 0.06 * variance)))
    return df.sparkSession.createDataFrame(rows, "check string, expected double, ok boolean")
