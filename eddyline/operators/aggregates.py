"""Group summaries: moments, shares, histograms, bins, cross tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eddyline.operators.scan import BLOCK, Sum, Total, scan
from eddyline.session import stage


def group_stats(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, mean, sample and population deviation of ``value`` per group."""
    v = F.col(value)
    return df.where(v.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std_samp"),
        F.stddev_pop(v).alias("std_pop"),
    )


def mean_ci(df: DataFrame, by: Sequence[str], value: str, ddof: int = 1) -> DataFrame:
    """Mean with the normal 95% band; ``ddof`` 1 = sample, 0 = population deviation."""
    std = F.col("std_samp") if ddof == 1 else F.col("std_pop")
    half = 1.96 * F.try_divide(std, F.sqrt("n"))
    stats = group_stats(df, by, value)
    return stats.select(*by, "n", "mean", (F.col("mean") - half).alias("ci_low"), (F.col("mean") + half).alias("ci_high"))


def with_totals(counts: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """Group total of an already aggregated table, attached to its rows. A null is a
    group of its own; without groups the total is one number."""
    if not by:
        return counts.withColumn(out, counts.agg(F.sum(value)).scalar())
    names = {c: f"_by_{i}" for i, c in enumerate(by)}
    totals = counts.groupBy(*[F.col(c).alias(n) for c, n in names.items()]).agg(F.sum(value).alias(out))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()])
    return counts.join(totals, same, "left").drop(*names.values())


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_first(column))


def top_k_values(df: DataFrame, column: str, k: int) -> DataFrame:
    return value_counts(df, column).limit(k)


def keep_top_k(df: DataFrame, column: str, k: int) -> DataFrame:
    return df.join(top_k_values(df, column, k).select(column), column, "left_semi")


def crosstab_margins(df: DataFrame, a: str, b: str, b_values: Sequence[str]) -> DataFrame:
    """Two-way counts with an ``All`` row and an ``All`` column."""
    counts = [F.count_if(F.col(b) == v).alias(v) for v in b_values]
    table = df.rollup(a).agg(F.grouping(a).alias("_g"), *counts, F.count("*").alias("All"))
    label = F.when(F.col("_g") == 1, F.lit("All")).otherwise(F.coalesce(F.col(a).cast("string"), F.lit("")))
    return table.select(label.alias(a), *b_values, "All")


def crosstab_normalized(df: DataFrame, a: str, b: str, within: str) -> DataFrame:
    """Counts and their share within the row (``a``) or within the column (``b``)."""
    counts = df.groupBy(a, b).agg(F.count("*").alias("n"))
    base = [a] if within == "row" else [b]
    return with_totals(counts, base, "n", "_t").withColumn("share", F.col("n") / F.col("_t")).drop("_t")


def counts_per_group_hist(df: DataFrame, groups: DataFrame, keys: Sequence[str], where: Column) -> DataFrame:
    """How many keys have 0, 1, 2, … matching rows; keys without any count as 0."""
    per_key = df.where(where).groupBy(*keys).agg(F.count("*").alias("k"))
    full = groups.select(*keys).distinct().join(per_key, list(keys), "left")
    return full.groupBy(F.coalesce("k", F.lit(0).cast("long")).alias("k")).agg(F.count("*").alias("n_groups"))


def share_by_key(df: DataFrame, key: str, where: Column) -> DataFrame:
    return df.groupBy(key).agg(
        F.count("*").alias("n"), F.avg(F.when(where, 1.0).otherwise(0.0)).alias("share")
    ).orderBy(F.desc("share"), key)


ROWS_PER_BLOCK = 1_000_000


def range_blocks(df: DataFrame, column: str, rows_per_block: int) -> DataFrame:
    """``df``, a staged table, with a block number that is ordered like the values: the
    partition it falls into when dealt out by range, and then staged again. Equal values
    share a block. What fits one block is left as it is."""
    parts = max(1, -(-df.count() // rows_per_block))
    if parts == 1:
        return df.withColumn(BLOCK, F.pmod(F.xxhash64(column), F.lit(parts)))
    dealt = df.repartitionByRange(parts, column).withColumn(BLOCK, F.spark_partition_id().cast("long"))
    return stage(dealt, "blocks")


def value_prefix(df: DataFrame, by: Sequence[str], value: str, measures: Mapping[str, Column], rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Counts per distinct value with running totals in value order.

    ``measures`` are aggregates per value; each gets ``cum_<name>`` (including the
    row) and ``all_<name>`` (the group's total). The counts are staged: they are
    far smaller than the rows, and are read several times.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(*[c.alias(n) for n, c in measures.items()])
    counts = range_blocks(stage(counts, "counts"), value, rows_per_block)
    steps = [Sum(f"cum_{n}", F.col(n)) for n in measures] + [Total(f"all_{n}", F.col(n)) for n in measures]
    return scan(counts.withColumnRenamed(BLOCK, "_range"), list(by), [value], F.col("_range"), steps).drop("_range")


def ecdf(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    rows = value_prefix(df, by, value, {"n": F.count("*")})
    return rows.select(*by, value, "n", (F.col("cum_n") / F.col("all_n")).alias("ecdf"))


def exact_median(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Median by value counts and running totals; no group is collected."""
    rows = value_prefix(df, by, value, {"n": F.count("*")})
    below, upto, total = F.col("cum_n") - F.col("n"), F.col("cum_n"), F.col("all_n")
    lower, upper = F.floor((total + 1) / 2), F.floor((total + 2) / 2)
    hold = lambda r: (below < r) & (r <= upto)
    return rows.groupBy(*by).agg(
        F.max("all_n").alias("n"),
        ((F.max(F.when(hold(lower), F.col(value))) + F.max(F.when(hold(upper), F.col(value)))) / 2).alias("median"),
    )


def bin_index(value: Column, lo: float, width: float, bins: int) -> Column:
    """Bin number; the last bin includes its right edge, outside is null."""
    hi = lo + width * bins
    index = F.floor((value - F.lit(lo)) / F.lit(width)).cast("long")
    return F.when((value >= lo) & (value < hi), index).when(value == hi, F.lit(bins - 1).cast("long"))


def histogram(df: DataFrame, by: Sequence[str], value: str, lo: float, width: float, bins: int) -> DataFrame:
    """Counts, probability and density per fixed-width bin (empty bins absent)."""
    rows = df.withColumn("bin", bin_index(F.col(value), lo, width, bins)).where("bin is not null")
    counts = rows.groupBy(*by, "bin").agg(F.count("*").alias("n"))
    share = F.col("n") / F.col("_t")
    return (
        with_totals(counts, by, "n", "_t")
        .withColumn("bin_start", F.lit(float(lo)) + F.col("bin") * F.lit(float(width)))
        .withColumn("probability", share)
        .withColumn("density", share / width)
        .drop("_t")
    )


def histogram_widths(df: DataFrame, by: Sequence[str], value: str, lo: float, hi: float, widths: Sequence[float]) -> DataFrame:
    """Histograms of several widths in one pass."""
    choices = F.explode(F.array(*[F.lit(float(w)) for w in widths])).alias("width")
    rows = df.select(*by, value, choices)
    v, w = F.col(value), F.col("width")
    bins = F.ceil((F.lit(hi) - F.lit(lo)) / w)
    index = F.least(F.floor((v - lo) / w), bins - 1).cast("long")
    return (
        rows.where((v >= lo) & (v <= hi))
        .groupBy(*by, "width", index.alias("bin"))
        .agg(F.count("*").alias("n"))
        .withColumn("bin_start", F.lit(float(lo)) + F.col("bin") * F.col("width"))
    )


def masked_hist(df: DataFrame, masks: Mapping[str, Column], value: str, lo: float, width: float, bins: int) -> DataFrame:
    """Histogram of one series under each of several masks, in one pass."""
    hits = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in masks.items()]))
    return histogram(df.withColumn("mask", F.explode(hits)), ["mask"], value, lo, width, bins)


def masked_stats(df: DataFrame, masks: Mapping[str, Column], value: str) -> DataFrame:
    hits = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in masks.items()]))
    return group_stats(df.withColumn("mask", F.explode(hits)), ["mask"], value)


def hexbin(df: DataFrame, x: str, y: str, made: Column, size: float = 15, min_attempts: int = 5) -> DataFrame:
    """Hexagonal bins with attempts and share made, inside the half court."""
    w, h = F.lit(3.0**0.5 * size), F.lit(1.5 * size)
    row = F.bround(F.col(y) / h, 0).cast("long")
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_r", row)
    shift = F.when(F.abs("_r") % 2 == 1, w / 2).otherwise(F.lit(0.0))
    rows = rows.withColumn("_c", F.bround((F.col(x) - shift) / w, 0).cast("long"))
    bins = rows.groupBy("_r", "_c").agg(F.count("*").alias("attempts"), F.count_if(made).alias("made"))
    cx, cy = F.col("_c") * w + shift, F.col("_r") * h
    return (
        bins.where(F.col("attempts") >= min_attempts)
        .where((cy <= 470) & (cy >= -60) & (F.abs(cx) <= 260))
        .select(
            F.col("_r").alias("row"), F.col("_c").alias("col"), cx.alias("x"), cy.alias("y"), "attempts",
            (F.col("made") / F.col("attempts") * 100).alias("pct_made"),
        )
    )


def heatmap_2d(df: DataFrame, x: Column, y: Column, value: str, min_count: int) -> DataFrame:
    return (
        df.groupBy(x.alias("x_bin"), y.alias("y_bin"))
        .agg(F.avg(value).alias("mean_value"), F.count("*").alias("n"))
        .where(F.col("n") >= min_count)
    )


def describe(df: DataFrame) -> DataFrame:
    """One row per column: n, mean, std, min, exact quartiles (interpolated) and max.

    The columns are stacked, shrink to counts per distinct value, and running totals
    find the ranks; no column is collected or sorted in one task.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in df.columns])
    long = df.select(F.explode(pairs).alias("p")).select("p.*")
    moments = long.groupBy("column").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max")
    )
    rows = value_prefix(long, ["column"], "value", {"n": F.count("*")})
    before, upto, total = F.col("cum_n") - F.col("n"), F.col("cum_n"), F.col("all_n")
    picked = {}
    for name, share in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
        at = (total - 1) * share
        for end, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            picked[f"_{name}_{end}"] = F.max(F.when((before <= rank) & (rank < upto), F.col("value")))
        picked[f"_{name}_w"] = F.max(at - F.floor(at))
    found = rows.groupBy("column").agg(*[c.alias(n) for n, c in picked.items()])
    both = moments.join(found, "column", "left")
    between = lambda q: (F.col(f"_{q}_lo") + (F.col(f"_{q}_hi") - F.col(f"_{q}_lo")) * F.col(f"_{q}_w")).alias(q)
    return both.select("column", "n", "mean", "std", "min", between("q25"), between("q50"), between("q75"), "max")


def distinct_count(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    fn = F.approx_count_distinct if approximate else F.countDistinct
    return df.agg(*[fn(c).alias(f"n_{c}") for c in columns])


def weighted_effect(df: DataFrame, effect: str, n: str) -> DataFrame:
    return df.agg(
        F.try_divide(F.sum(F.col(effect) * F.col(n)), F.sum(n)).alias("weighted_effect"), F.sum(n).alias("n")
    )


def confusion_scores(df: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """TP, FP, FN, precision, recall and F1: overall, per season and per period."""
    counts = [
        F.count_if(truth & predicted).alias("tp"),
        F.count_if(~truth & predicted).alias("fp"),
        F.count_if(truth & ~predicted).alias("fn"),
    ]
    sets = df.groupingSets([[], ["season"], ["period"]], "season", "period").agg(
        F.grouping("season").alias("_gs"), F.grouping("period").alias("_gp"), *counts
    )
    scope = F.when(F.col("_gs") == 0, F.lit("season")).when(F.col("_gp") == 0, F.lit("period")).otherwise(F.lit("overall"))
    one = F.lit(1)
    out = sets.withColumn("scope", scope)
    out = out.withColumn("precision", F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), one))
    out = out.withColumn("recall", F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), one))
    p, r = F.col("precision"), F.col("recall")
    out = out.withColumn("f1", 2 * p * r / F.greatest(p + r, F.lit(1e-9)))
    return out.select("scope", "season", "period", "tp", "fp", "fn", "precision", "recall", "f1")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def threshold_crossings(df: DataFrame, keys: Sequence[str], order: str, running: str, k: float) -> DataFrame:
    """First row per key at which the running value reaches ``k``."""
    hit = df.where(F.col(running) >= k)
    return hit.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), order).alias("_row")).select("_row.*")

