"""Reading, stacking, merging and writing tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SEASON_TYPES = ("rg", "po")


def scan_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None, schema: StructType | None = None):
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(path)
    return df.select(*columns) if columns else df


def scan_csv_season(
    spark: SparkSession, root: str, schema: StructType | str, season: int, season_type: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """One season of a ``season=/season_type=`` CSV layout; other folders are not read."""
    df = spark.read.schema(schema).option("header", True).csv(root)
    df = df.where((F.col("season") == season) & (F.col("season_type") == season_type))
    return df.select(*columns) if columns else df


def list_seasons(files: DataFrame) -> DataFrame:
    """Seasons present per type, from the partition columns only."""
    return files.select("season", "season_type").distinct()


def resolve_seasons(df: DataFrame, seasons: int | Sequence[int] | None = None) -> DataFrame:
    """None = all, a list = those, n > 0 = that season, -n = the last n seasons."""
    if seasons is None:
        return df
    if isinstance(seasons, int) and seasons < 0:
        last = df.select("season").distinct().orderBy(F.desc("season")).limit(-seasons)
        return df.join(last, "season", "left_semi")
    wanted = [seasons] if isinstance(seasons, int) else list(seasons)
    return df.where(F.col("season").isin(wanted))


def stack_seasons(frames: Mapping[str, Sequence[DataFrame]], drop: Sequence[str] = ()) -> DataFrame:
    """Concatenate frames of both season types; absent columns become null."""
    flagged = [
        df.withColumn("IsPlayoff", F.lit(kind == "po")) for kind, group in frames.items() for df in group
    ]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), flagged)
    return stacked.drop(*drop)


def game_dates_lookup(sources: Sequence[DataFrame], key: str, date: str) -> DataFrame:
    """id → date from the first source that has the id; earliest date inside it."""
    ranked = [df.select(key, date, F.lit(i).alias("_priority")) for i, df in enumerate(sources)]
    rows = reduce(DataFrame.unionByName, ranked).where(F.col(date).isNotNull())
    best = rows.groupBy(key).agg(F.min(F.struct("_priority", date)).alias("_b"))
    return best.select(key, F.col("_b")[date].alias(date)).orderBy(date, key)


def merge_wide_stats(base: DataFrame, others: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer joins on ``keys``; a column already present is kept from the left."""

    def add(left: DataFrame, right: DataFrame) -> DataFrame:
        fresh = [c for c in right.columns if c in keys or c not in left.columns]
        return left.join(right.select(*fresh), list(keys), "full")

    return reduce(add, others, base)


def incremental_append(saved: DataFrame, fetched: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Saved rows plus fetched rows whose key is new; one row per key.

    Among duplicates the saved row stays, then the smallest ``order``.
    """
    fresh = fetched.join(saved.select(*keys).distinct(), list(keys), "left_anti")
    both = saved.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    columns = saved.columns
    kept = both.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct("_new", order)).alias("_row"))
    return kept.select("_row.*")


def pending_keys(wanted: DataFrame, saved: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys still to be fetched."""
    return wanted.select(*keys).distinct().join(saved.select(*keys).distinct(), list(keys), "left_anti")


def sink_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ("season", "season_type"), mode: str = "overwrite"):
    writer = df.write.mode(mode).option("compression", "zstd")
    present = [c for c in partition_by if c in df.columns]
    (writer.partitionBy(*present) if present else writer).parquet(path)


def sink_csv(df: DataFrame, path: str, mode: str = "overwrite"):
    """A header CSV. Meant for result tables; the write stays distributed."""
    df.write.mode(mode).option("header", True).csv(path)


# Names under which the SQL questions see the tables.
VIEW_KEYS = {
    "player_stats": {"PLAYER_ID": "personId", "season_int": "season"},
    "player_advanced": {"PLAYER_ID": "personId", "TEAM_ID": "teamId", "season_int": "season"},
    "rotations": {"PERSON_ID": "personId", "TEAM_ID": "teamId"},
}


def table_views(frames: Mapping[str, DataFrame]) -> None:
    """Register frames for SQL under harmonised key names."""
    for name, df in frames.items():
        df = df.withColumnsRenamed(VIEW_KEYS.get(name, {}))
        if name == "pbp":
            df = df.withColumn("clock_seconds", F.col("seconds_remaining")).withColumn("subType_clean", F.trim("subType"))
            df = df.withColumnRenamed("prev_sub_type", "prev_sub_type_clean")
        df.createOrReplaceTempView(name)
