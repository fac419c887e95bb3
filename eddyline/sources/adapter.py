"""Projection of a generic event stream onto the spine shape.

Input: ``events`` (event_id, ts, user_id, event_type, value, props). A user is an
entity; the 30 days from the fixed epoch become 2,880 clock ticks, which are four
periods of 720. Only running scores need a scan; everything else is per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eddyline.config import SPINE, Spine
from eddyline.operators.scan import Sum, scan

EPOCH = "TIMESTAMP_NTZ '2024-01-01 00:00:00'"
TICK_SECONDS = 900


def _elapsed_ticks() -> Column:
    gap = f"(ts - {EPOCH})"
    seconds = (
        f"extract(DAY FROM {gap}) * 86400L + extract(HOUR FROM {gap}) * 3600L"
        f" + extract(MINUTE FROM {gap}) * 60L + cast(floor(extract(SECOND FROM {gap})) as bigint)"
    )
    return F.expr(f"({seconds}) div {TICK_SECONDS}")


def _pick(column: str, mapping: dict[str, str], other: str) -> Column:
    first, *rest = mapping.items()
    chain = F.when(F.col(column) == first[0], F.lit(first[1]))
    for value, label in rest:
        chain = chain.when(F.col(column) == value, F.lit(label))
    return chain.otherwise(F.lit(other))


def project_events(events: DataFrame) -> DataFrame:
    """Per-row spine columns, before running scores."""
    kind = F.col("event_type")
    k, gse, period = F.col("k"), F.col("game_seconds_elapsed"), F.col("period")
    shot = kind.isin("click", "view")
    home, away = F.lit(100) + F.col("user_id") % 10, F.lit(200) + F.col("user_id") % 7
    is_home = (kind == "click") | ((kind != "view") & (F.col("event_id") % 2 == 0))
    number = F.regexp_extract("props", '"k": *([0-9]+)', 1)
    df = events.withColumn("k", number.try_cast("long"))
    df = df.withColumn("game_seconds_elapsed", _elapsed_ticks())
    df = df.withColumn("period", F.least(F.expr("game_seconds_elapsed div 720"), F.lit(3)) + F.lit(1))
    return df.select(
        F.col("user_id").alias("gameId"),
        F.col("event_id").alias("orderNumber"),
        F.col("ts").cast("timestamp").alias("timeActual"),
        gse,
        period,
        (F.lit(720) * period - gse).alias("seconds_remaining"),
        _pick(
            "event_type",
            {"click": "2pt", "view": "3pt", "purchase": "timeout", "signup": "substitution"},
            "stoppage",
        ).alias("actionType"),
        F.when(kind == "purchase", F.when(k % 10 == 7, F.lit("challenge")).otherwise(F.lit("full"))).alias("subType"),
        F.when(
            kind == "purchase", F.when(k % 2 == 0, F.lit("team, mandatory")).otherwise(F.lit("team"))
        ).alias("qualifiers"),
        F.when(kind == "error", F.element_at(F.array(*map(F.lit, ["overturned", "stands", "support"])), (k % 3 + 1).cast("int"))).alias("descriptor"),
        F.when(is_home, home).otherwise(away).alias("teamId"),
        F.when(kind == "signup", F.lit(0).cast("long")).otherwise(F.when(is_home, home).otherwise(away)).alias("possession"),
        (F.col("event_id") % 5 + 1).alias("personId"),
        F.when(shot, F.floor("value") % 3 + 1).otherwise(F.lit(0)).cast("long").alias("points_scored"),
        is_home.alias("_is_home"),
        (F.lit(2020) + F.col("user_id") % 3).alias("season"),
        F.when(F.col("user_id") % 5 == 0, F.lit("po")).otherwise(F.lit("rg")).alias("season_type"),
        (F.col("user_id") % 5 == 0).alias("IsPlayoff"),
        k,
        F.col("value"),
    )


def spine_from_events(events: DataFrame, s: Spine = SPINE) -> DataFrame:
    """The full spine: projected rows plus the running score of each side."""
    rows = project_events(events)
    points = F.col("points_scored")
    scored = scan(
        rows,
        [s.entity],
        [s.order],
        s.order_block(),
        [
            Sum(s.home, F.when(F.col("_is_home"), points).otherwise(F.lit(0).cast("long"))),
            Sum(s.away, F.when(F.col("_is_home"), F.lit(0).cast("long")).otherwise(points)),
        ],
    )
    return scored.drop("_is_home")


def as_plays(spine: DataFrame) -> DataFrame:
    """The same rows with a richer action vocabulary.

    The event stream has five kinds of event; possession endings need misses,
    rebounds, free throws and turnovers, which are read off ``k``.
    """
    k, action = F.col("k"), F.col("actionType")
    dead = F.element_at(
        F.array(*map(F.lit, ["rebound", "turnover", "steal", "block", "violation", "period"])), (k % 6 + 1).cast("int")
    )
    return (
        spine.withColumn(
            "shotResult",
            F.when(action.isin("2pt", "3pt", "timeout"), F.when(k % 3 == 0, F.lit("Missed")).otherwise(F.lit("Made"))),
        )
        .withColumn(
            "subType",
            F.when((action == "stoppage") & (k % 6 == 0), F.when(k % 4 == 0, F.lit("offensive")).otherwise(F.lit("defensive"))),
        )
        .withColumn("isFieldGoal", action.isin("2pt", "3pt").cast("int"))
        .withColumn("actionType", F.when(action == "timeout", F.lit("freethrow")).when(action == "stoppage", dead).otherwise(action))
    )


def as_older_feed(spine: DataFrame) -> DataFrame:
    """The rows under the vocabulary of the older feed: its own action and
    sub-type labels, seasons around the rule change, rows charged to nobody."""
    timeout, order = F.col("actionType") == "timeout", F.col("orderNumber")
    label = (
        F.when(order % 4 == 0, F.lit("Official TV"))
        .when(F.col("subType") == "challenge", F.lit("Coach Challenge"))
        .when(F.col("k") % 3 == 0, F.lit("Short"))
        .otherwise(F.lit("Regular"))
    )
    return (
        spine.withColumn("subType", F.when(timeout, label))
        .withColumn("actionType", F.when(timeout, F.lit("Timeout")).otherwise(F.col("actionType")))
        .withColumn("personId", order % 4)
        .withColumn("season", F.lit(2013) + F.col("gameId") % 6)
    )


def iso_clock(remaining: Column) -> Column:
    """Seconds as the feed writes them: ``PT04M56.00S``."""
    minutes, seconds = F.floor(remaining / 60), remaining % 60
    return F.concat(F.lit("PT"), F.lpad(minutes.cast("string"), 2, "0"), F.lit("M"), F.lpad(seconds.cast("string"), 2, "0"), F.lit(".00S"))


def as_raw_feed(spine: DataFrame) -> DataFrame:
    """The spine as a raw feed ships it: padded strings, text clocks and times,
    scores as doubles that sometimes fall back or are missing."""
    order = F.col("orderNumber")
    dip = F.when(order % 13 == 0, F.lit(1)).otherwise(F.lit(0))
    return spine.select(
        "gameId",
        "orderNumber",
        "period",
        F.concat(F.lit("  "), "actionType", F.lit(" ")).alias("actionType"),
        iso_clock(F.col("seconds_remaining")).alias("clock"),
        F.when(order % 17 != 0, F.date_format("timeActual", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("timeActual"),
        F.col("teamId").cast("double").alias("teamId"),
        F.col("personId").cast("double").alias("personId"),
        (F.col("scoreHome") - dip).cast("double").alias("scoreHome"),
        F.when(order % 7 != 0, F.col("scoreAway").cast("double")).alias("scoreAway"),
        "season",
    )
