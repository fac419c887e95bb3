"""Data-quality checks. Each is one aggregation over the table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eddyline.config import SPINE, Spine
from eddyline.operators.scan import Lag, scan


class CheckError(ValueError):
    """A check of severity ``error`` found bad rows."""


def check_required_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """One row per required column: whether it is present, and how many rows have it filled."""
    have = set(df.columns)
    counted = df.agg(*[(F.count(c) if c in have else F.lit(0).cast("long")).alias(f"c{i}") for i, c in enumerate(required)], F.count("*").alias("rows"))
    pairs = [F.struct(F.lit(c).alias("column"), F.lit(c in have).alias("present"), F.col(f"c{i}").alias("n_filled"), F.col("rows").alias("n_rows")) for i, c in enumerate(required)]
    return counted.select(F.explode(F.array(*pairs)).alias("r")).select("r.*")


def count_failures(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows that break each rule, from a single pass over the data."""
    names = list(rules)
    counted = df.agg(*[F.count_if(rules[n]).alias(f"c{i}") for i, n in enumerate(names)])
    pairs = F.array(*[F.struct(F.lit(n).alias("check"), F.col(f"c{i}").alias("n_bad")) for i, n in enumerate(names)])
    return counted.select(F.explode(pairs).alias("r")).select("r.*")


def check_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return count_failures(df, {c: F.col(c).isNull() for c in columns})


def check_unique_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of duplicated keys and of surplus rows."""
    dup = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return dup.agg(F.count("*").alias("duplicate_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0).cast("long")).alias("surplus_rows"))


def check_order_unique(df: DataFrame, s: Spine = SPINE) -> DataFrame:
    return check_unique_key(df, [s.entity, s.order])


BAD_IDS = 5


def bad_ids(flags: DataFrame, entity: str, names: Sequence[str], n: int = BAD_IDS) -> DataFrame:
    """(check, n_bad, bad_ids): of one row per entity with a flag per check, the number of
    flagged entities and the ``n`` smallest ids. Tasks keep their ``n`` smallest per check
    before anything moves, so the list is merged from a few rows of each task."""
    pairs = F.array(*[F.struct(F.lit(c).alias("check"), F.coalesce(F.col(c), F.lit(False)).alias("bad")) for c in names])
    long = flags.select(F.col(entity).alias("id"), F.explode(pairs).alias("r")).select("id", "r.*")
    place = F.row_number().over(Window.partitionBy("check").orderBy("id"))
    few = long.where("bad").select("check", "id").withColumn("place", place).where(F.col("place") <= n)
    lists = few.groupBy("check").agg(F.array_sort(F.collect_list("id")).alias("bad_ids"))
    counts = long.groupBy("check").agg(F.count_if("bad").alias("n_bad"))
    return counts.join(lists, "check", "left").withColumn("bad_ids", F.coalesce("bad_ids", F.array().cast(lists.schema["bad_ids"].dataType)))


def bad_entity_ids(df: DataFrame, rules: Mapping[str, Column], n: int = BAD_IDS, s: Spine = SPINE) -> DataFrame:
    """(check, n_bad, bad_ids) for rules on rows: entities with a row that breaks each rule, all
    rules in one pass."""
    per = df.groupBy(s.entity).agg(*[F.bool_or(F.coalesce(c, F.lit(False))).alias(name) for name, c in rules.items()])
    return bad_ids(per, s.entity, list(rules), n)


def check_monotone(df: DataFrame, s: Spine = SPINE) -> DataFrame:
    """Entities whose scores or clock fall, with the five smallest ids of each check."""
    columns = [s.home, s.away, s.clock]
    rows = scan(df, [s.entity], [s.order], s.order_block(), [Lag(f"_p_{c}", F.col(c)) for c in columns])
    per = rows.groupBy(s.entity).agg(
        *[F.coalesce(F.bool_or(F.col(c) < F.col(f"_p_{c}")), F.lit(False)).alias(c) for c in columns]
    )
    out = bad_ids(per, s.entity, columns).withColumnRenamed("check", "column")
    severity = F.when(F.col("column") == s.clock, F.lit("warning")).otherwise(F.lit("error"))
    return out.withColumn("severity", severity)


def bad_entities(df: DataFrame, condition: Column, n: int = 5, s: Spine = SPINE) -> DataFrame:
    """The n smallest entity ids with a row that breaks a rule."""
    return df.where(condition).select(s.entity).distinct().orderBy(s.entity).limit(n)


def range_rules(s: Spine = SPINE) -> dict[str, Column]:
    return {
        "period 1-10": ~F.col(s.period).between(1, 10),
        "clock >= 0": F.col(s.clock) < 0,
        "remaining >= 0": F.col(s.remaining) < 0,
        "home score >= 0": F.col(s.home) < 0,
        "away score >= 0": F.col(s.away) < 0,
        "season 2000-2100": ~F.col(s.season).between(2000, 2100),
        "season type known": ~F.col(s.season_type).isin("rg", "po"),
    }


def check_ranges(df: DataFrame, s: Spine = SPINE) -> DataFrame:
    return count_failures(df, range_rules(s))


def check_intervals(df: DataFrame, start: str, end: str) -> DataFrame:
    return count_failures(df, {"end before start": F.col(end) < F.col(start), "empty": F.col(end) == F.col(start)})


# How a possession can end, besides free throws (``ft_x_of_y``).
OUTCOMES = (
    "made_2pt", "made_3pt", "made_2pt_and1", "made_3pt_and1", "miss", "miss_def_reb",
    "turnover_live", "turnover_dead", "end_of_period", "violation", "other",
)


def consistency_rules(columns: Sequence[str], s: Spine = SPINE) -> dict[str, Column]:
    """Stored columns against their recomputation, and against the values they may hold
    where those columns are there."""
    margin = F.col(s.home) - F.col(s.away)
    clutch = (F.abs(margin) <= 5) & (F.col(s.clock) >= 2400)
    rules = {
        "score_margin": ~F.col("score_margin").eqNullSafe(margin),
        "is_clutch": ~F.col("is_clutch").eqNullSafe(clutch),
        "IsPlayoff": ~F.col("IsPlayoff").eqNullSafe(F.col(s.season_type) == "po"),
        "possession points iff id": F.col("possession_id").isNull() != F.col("possession_points").isNull(),
        "id iff live possession": F.col("possession_id").isNotNull() != (F.col(s.possession) > 0),
        "role iff intervention": (F.col(s.action) == "timeout") != (F.col("timeout_role") != ""),
    }
    outcome = F.col("possession_outcome")
    optional = {
        s.points: ("points 0-3", ~F.col(s.points).isin(0, 1, 2, 3)),
        "shot_value": ("shot value 1-3", ~F.col("shot_value").isin(1, 2, 3)),
        "possession_outcome": ("outcome known", ~outcome.isin(*OUTCOMES) & ~outcome.startswith("ft_")),
    }
    return rules | {name: rule for column, (name, rule) in optional.items() if column in columns}


def check_consistency(df: DataFrame, s: Spine = SPINE) -> DataFrame:
    return count_failures(df, consistency_rules(df.columns, s))


def check_alignment(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Coverage of a lookup and whether it would multiply rows."""
    per_key = right.groupBy(*keys).agg(F.count("*").alias("_n"))
    joined = left.join(per_key, list(keys), "left")
    n = F.coalesce("_n", F.lit(1))
    return joined.agg(
        F.count("*").alias("rows_before"),
        F.sum(n).alias("rows_after"),
        F.avg(F.when(F.col("_n").isNotNull(), 1.0).otherwise(0.0)).alias("coverage"),
    )


def check_containment(pieces: DataFrame, wholes: DataFrame, keys: Sequence[str], length: Column, whole_length: Column) -> DataFrame:
    """Total length of pieces against the intervals they were cut from.

    A key without pieces has pieces of length 0, which agree with intervals that add up to 0
    but not with intervals of unknown length. Both sides meet in one grouping, so that a
    null key is one key.
    """
    unknown = F.lit(None)
    a = pieces.select(*keys, length.alias("_a"), unknown.cast("long").alias("_b"), F.lit(True).alias("_piece"))
    b = wholes.select(*keys, unknown.cast("long").alias("_a"), whole_length.alias("_b"), F.lit(False).alias("_piece"))
    both = a.unionByName(b).groupBy(*keys).agg(
        F.sum("_a").alias("_a"), F.sum("_b").alias("_b"), F.bool_or("_piece").alias("_pieces"), F.bool_or(~F.col("_piece")).alias("_wholes")
    )
    zero = F.lit(0)
    same = F.coalesce("_a", zero) == F.coalesce("_b", zero)
    alone = (~F.col("_pieces") & F.col("_b").isNull()) | (~F.col("_wholes") & F.col("_a").isNull())
    return both.agg(F.count("*").alias("n_keys"), F.count_if(~same | alone).alias("n_disagree"))


def check_report(checks: Mapping[str, tuple[DataFrame, str]], raise_errors: bool = False) -> DataFrame:
    """All (check, n_bad) tables with their severity; optionally raise on errors."""
    parts = [
        df.select(F.lit(group).alias("group"), "check", "n_bad", F.lit(severity).alias("severity"))
        for group, (df, severity) in checks.items()
    ]
    report = reduce(DataFrame.unionByName, parts)
    if raise_errors:
        failed = report.where("severity = 'error' and n_bad > 0")
        total = failed.count()
        if total:
            shown = "; ".join(f"{r['group']}/{r['check']}: {r['n_bad']} rows" for r in failed.limit(20).collect())
            raise CheckError(f"{total} checks failed, see the report for all: {shown}")
    return report


def unexpected_values(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Values outside an enumeration, by anti join on the distinct values."""
    spark: SparkSession = df.sparkSession
    known = spark.createDataFrame([(v,) for v in allowed], f"{column} string")
    return df.select(column).distinct().join(known, column, "left_anti")
