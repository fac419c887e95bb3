"""Cleaning of raw feeds: parsing, filling inside an entity, monotone scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddyline.config import SPINE, Spine
from eddyline.functions import columns as C
from eddyline.operators.scan import Lag, Last, Max, Total, scan


def derive_game_date(df: DataFrame, s: Spine = SPINE) -> DataFrame:
    """Date of the entity's first known timestamp, on all its rows."""
    first = F.when(F.col(s.wall).isNotNull(), F.struct(F.col(s.order), F.to_date(s.wall).alias("d")))
    rows = scan(df, [s.entity], [s.order], s.order_block(), [Total("_first", first, "min")])
    return rows.withColumn("game_date", F.col("_first")["d"]).drop("_first")


def fill_forward(df: DataFrame, column: str, out: str, s: Spine = SPINE) -> DataFrame:
    """Last known value inside the entity (never from another entity)."""
    return scan(df, [s.entity], [s.order], s.order_block(), [Last(out, F.col(column))])


def merge_game_date_ffill(df: DataFrame, dates: DataFrame, s: Spine = SPINE) -> DataFrame:
    """Attach the date of each row's id and fill gaps forward in the entity."""
    joined = df.join(dates.select(s.entity, s.order, F.col("game_date").alias("_known")), [s.entity, s.order], "left")
    return fill_forward(joined, "_known", "game_date", s).drop("_known")


def ffill_to_int(df: DataFrame, columns: list[str], s: Spine = SPINE) -> DataFrame:
    """Forward-filled scores as longs; before the first value they are 0."""
    steps = [Last(f"_f_{c}", F.col(c)) for c in columns]
    rows = scan(df, [s.entity], [s.order], s.order_block(), steps)
    filled = {c: F.coalesce(F.col(f"_f_{c}").try_cast("long"), F.lit(0).cast("long")) for c in columns}
    return rows.withColumns(filled).drop(*[f"_f_{c}" for c in columns])


def cummax_monotone(df: DataFrame, columns: list[str], s: Spine = SPINE) -> DataFrame:
    """Scores replaced by their running maximum in the entity."""
    rows = scan(df, [s.entity], [s.order], s.order_block(), [Max(f"_m_{c}", F.col(c)) for c in columns])
    return rows.withColumns({c: F.col(f"_m_{c}") for c in columns}).drop(*[f"_m_{c}" for c in columns])


def clock_reversals(df: DataFrame, s: Spine = SPINE) -> DataFrame:
    """Flag rows whose clock is behind the previous row's."""
    rows = scan(df, [s.entity], [s.order], s.order_block(), [Lag("_pc", F.col(s.clock))])
    return rows.withColumn("is_reversal", F.coalesce(F.col(s.clock) < F.col("_pc"), F.lit(False))).drop("_pc")


def wall_clock_delta(df: DataFrame, s: Spine = SPINE) -> DataFrame:
    """Real seconds since the previous event of the entity."""
    rows = scan(df, [s.entity], [s.order], s.order_block(), [Lag("_pw", F.unix_micros(s.wall))])
    return rows.withColumn("wall_delta_s", (F.unix_micros(s.wall) - F.col("_pw")) / 1e6).drop("_pw")


def next_resume_duration(
    df: DataFrame,
    excluded: tuple[str, ...] = ("substitution", "stoppage", "instantreplay"),
    longest: int = 600,
    s: Spine = SPINE,
) -> DataFrame:
    """Whole seconds from an intervention to the next event that resumes play.

    Null on other rows and where the duration is outside [0, ``longest``].
    """
    resumed = F.when(~F.col(s.action).isin(*excluded), F.unix_micros(s.wall))
    rows = scan(df, [s.entity], [s.order], s.order_block(), [Last("_r", resumed, inclusive=False, reverse=True)])
    gap = F.col("_r") - F.unix_micros(s.wall)
    seconds = F.when(gap >= 0, F.floor(gap / 1_000_000)).otherwise(F.ceil(gap / 1_000_000)).cast("long")
    keep = (F.col(s.action) == "timeout") & seconds.between(0, longest)
    return rows.withColumn("timeout_duration_s", F.when(keep, seconds)).drop("_r")


def clean_feed(raw: DataFrame, s: Spine = SPINE) -> DataFrame:
    """The current feed: strings trimmed, clocks and times parsed, scores monotone,
    whole floats to ints, identifying columns first."""
    df = C.strip_strings(raw)
    df = df.withColumn(s.remaining, C.iso_clock_seconds(F.col("clock")))
    df = df.withColumn("seconds_elapsed", C.elapsed_in_period(F.col(s.remaining), F.col(s.period)))
    df = df.withColumn(s.clock, C.game_elapsed(F.col(s.period), F.col("seconds_elapsed")))
    df = C.parse_timestamps(df, [s.wall])
    df = derive_game_date(df, s)
    df = cummax_monotone(df, [s.home, s.away], s)
    df = C.cast_float_to_int(df, [s.home, s.away, s.team, s.person])
    return C.reorder_columns(df, [s.entity, "game_date", s.order, s.period, "clock"], [s.home, s.away])


def clean_older_feed(raw: DataFrame, dates: DataFrame, s: Spine = SPINE) -> DataFrame:
    """The older feed: dates merged by id, scores filled forward then monotone."""
    df = C.strip_strings(raw)
    df = C.older_feed_columns(df)
    df = merge_game_date_ffill(df, dates, s)
    df = ffill_to_int(df, [s.home, s.away], s)
    df = cummax_monotone(df, [s.home, s.away], s)
    return C.reorder_columns(df, [s.entity, "game_date", s.order, s.period, "clock"], [s.home, s.away])
