"""Per-row column derivations. All are plain expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

REGULAR_PERIOD, EXTRA_PERIOD = 720, 300


def strip_strings(df: DataFrame) -> DataFrame:
    text = {f.name: F.trim(f.name) for f in df.schema.fields if isinstance(f.dataType, StringType)}
    return df.withColumns(text)


def iso_clock_seconds(clock: Column) -> Column:
    """``PT04M56.00S`` → seconds left; null for anything else."""
    minutes = F.regexp_extract(clock, r"^PT(\d+)M(\d+(?:\.\d+)?)S$", 1).try_cast("double")
    seconds = F.regexp_extract(clock, r"^PT(\d+)M(\d+(?:\.\d+)?)S$", 2).try_cast("double")
    return minutes * 60 + seconds


def elapsed_in_period(remaining: Column, period: Column) -> Column:
    return F.when(period <= 4, REGULAR_PERIOD - remaining).otherwise(EXTRA_PERIOD - remaining)


def mmss_seconds(text: Column) -> Column:
    parts = F.split(text, ":")
    whole = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("long")
    return F.when(F.size(parts) == 2, whole(1) * 60 + whole(2))


def wall_minute(text: Column) -> Column:
    """``7:12 PM`` → minute on a 12-hour face."""
    pattern = r"^(\d{1,2}):(\d{2})"
    hour = F.regexp_extract(text, pattern, 1).try_cast("long")
    return (hour % 12) * 60 + F.regexp_extract(text, pattern, 2).try_cast("long")


def game_elapsed(period: Column, elapsed: Column) -> Column:
    regular = F.least(period - 1, F.lit(4)) * REGULAR_PERIOD
    extra = F.greatest(period - 5, F.lit(0)) * EXTRA_PERIOD
    return regular + extra + elapsed


def left_in_regulation(period: Column, remaining: Column) -> Column:
    return F.when(period <= 4, (4 - period) * REGULAR_PERIOD + remaining).otherwise(F.lit(0))


def season_from_id(game: Column) -> Column:
    return F.lit(2000) + F.floor((game % 10_000_000) / 100_000).cast("long")


def season_type_from_id(game: Column) -> Column:
    return F.when(F.floor(game / 10_000_000) == 2, F.lit("rg")).otherwise(F.lit("po"))


def cast_float_to_int(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Whole doubles become longs; a fractional value becomes null."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: F.when(F.col(c) == F.floor(c), F.col(c).try_cast("long")) for c in present})


def parse_timestamps(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.try_to_timestamp(c) for c in columns if c in df.columns})


def reorder_columns(df: DataFrame, start: Sequence[str], end: Sequence[str]) -> DataFrame:
    head = [c for c in start if c in df.columns]
    tail = [c for c in end if c in df.columns and c not in head]
    return df.select(*head, *[c for c in df.columns if c not in (*head, *tail)], *tail)


def shot_value(action: Column) -> Column:
    return F.when(action == "3pt", 3).when(action == "2pt", 2).when(action == "freethrow", 1)


def shot_points(action: Column, result: Column) -> Column:
    return F.when(result == "Made", F.coalesce(shot_value(action), F.lit(0))).otherwise(F.lit(0))


def is_clutch(margin: Column, elapsed: Column) -> Column:
    return (F.abs(margin) <= 5) & (elapsed >= 2400)


def clutch_window(period: Column, remaining: Column, lead: Column) -> Column:
    return (period >= 4) & (remaining <= 300) & (F.abs(lead) <= 5)


def court_x(y: Column, side: Column) -> Column:
    return F.when(side == "right", F.bround(5 * (y - 50), 0)).when(side == "left", F.bround(-5 * (y - 50), 0)).cast("int")


def court_y(x: Column, side: Column) -> Column:
    return (
        F.when(side == "right", F.bround(-9.4 * x + 887.5, 0)).when(side == "left", F.bround(9.4 * x - 52.5, 0)).cast("int")
    )


def bin_clock(clock: Column, width: int) -> Column:
    return F.floor(clock / width) * width


def signed_for(metric: Column, own_side: Column) -> Column:
    """The metric seen from one side: as is when it is the home side, else negated."""
    return F.when(own_side, metric).otherwise(-metric)


def time_bucket(period: Column, remaining: Column) -> Column:
    return (
        F.when(period <= 3, F.concat(F.lit("Q"), period.cast("int")))
        .when((period == 4) & (remaining > 300), F.lit("Q4_early"))
        .when(period == 4, F.lit("Q4_clutch"))
        .otherwise(F.lit("OT"))
    )


def _ladder(value: Column, steps: Sequence[tuple[int, str]], last: str) -> Column:
    """First label whose upper edge the value does not exceed."""
    chain = F.when(value <= steps[0][0], F.lit(steps[0][1]))
    for edge, label in steps[1:]:
        chain = chain.when(value <= edge, F.lit(label))
    return chain.when(value.isNotNull(), F.lit(last))


# Upper edges and labels of the caller's score margin and streak.
MARGIN_STEPS = [(-16, "down15+"), (-6, "down6-15"), (-1, "down1-5"), (0, "tied"), (5, "up1-5"), (15, "up6-15")]
STREAK_STEPS = [(-10, "down10+"), (-6, "down6-9"), (-3, "down3-5"), (2, "calm"), (5, "up3-5"), (9, "up6-9")]


def margin_bucket(margin: Column) -> Column:
    return _ladder(margin, MARGIN_STEPS, "up15+")


def streak_bucket(streak: Column) -> Column:
    return _ladder(streak, STREAK_STEPS, "up10+")


def alias_columns(df: DataFrame) -> DataFrame:
    out = df.withColumn("clock_seconds", F.col("seconds_remaining"))
    return out.withColumn("subType_clean", F.trim("subType")) if "subType" in df.columns else out


def derive_missing(df: DataFrame, derived: Mapping[str, Column]) -> DataFrame:
    """Add each derived column only where the feed lacks it."""
    return df.withColumns({name: expr for name, expr in derived.items() if name not in df.columns})


def older_feed_columns(df: DataFrame) -> DataFrame:
    """Columns of the older feed computed where absent, in dependency order."""
    period = F.col("period")
    for step in (
        {"seconds_remaining": iso_clock_seconds(F.col("clock"))},
        {"seconds_elapsed": elapsed_in_period(F.col("seconds_remaining"), period)},
        {"game_seconds_elapsed": game_elapsed(period, F.col("seconds_elapsed"))},
        {"pc_seconds": F.bround("seconds_remaining", 0).cast("long"), },
        {"IsPlayoff": F.col("season_type").isin("po", "playoffs")} if "season_type" in df.columns else {},
        {"shotValue": F.lit(0.0)},
        {name: F.lit(None).cast("timestamp") for name in ("game_date", "game_date_ffill")},
    ):
        df = derive_missing(df, step)
    return df


def qualifier_array(df: DataFrame, column: str = "qualifiers") -> Column:
    """Qualifiers as an array, whether the feed ships a string or a list."""
    if isinstance(df.schema[column].dataType, StringType):
        return F.split(F.col(column), ", *")
    return F.col(column)


# Letters outside ASCII and their plain forms, position by position.
FOLD_FROM = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿĀāĂăĄąĆćČčĎďĒēĖėĘęĚěĞğĢģĪīĮįİıĶķĻļŁłŃńŅņŇňŌōŐőŘřŚśŞşŠšŢţŤťŪūŮůŰűŲųŹźŻżŽž"
FOLD_TO = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyyAaAaAaCcCcDdEeEeEeEeGgGgIiIiIiKkLlLlNnNnNnOoOoRrSsSsSsTtTtUuUuUuUuZzZzZz"


def ascii_fold(text: Column) -> Column:
    """Latin letters without their marks; other characters outside ASCII vanish."""
    return F.regexp_replace(F.translate(text, FOLD_FROM, FOLD_TO), r"[^\x00-\x7F]", "")


