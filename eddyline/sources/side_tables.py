"""Side tables in the reference shapes, projected from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddyline.config import SPINE, Spine
from eddyline.operators.joins import number_by_clock
from eddyline.operators.scan import Lag, scan

END_OF_PLAY = 2880


def stints(spine: DataFrame, s: Spine = SPINE) -> DataFrame:
    """On-court intervals: from one substitution of a team to its next."""
    subs = spine.where(F.col(s.action) == "substitution").select(
        s.entity, s.order, s.person, s.team, s.season, s.season_type, F.col(s.clock).alias("in_game_seconds")
    )
    rows = scan(subs, [s.entity, s.team], [s.order], s.order_block(), [Lag("_next", F.col("in_game_seconds"), reverse=True)])
    rows = rows.withColumn("out_game_seconds", F.coalesce("_next", F.lit(END_OF_PLAY).cast("long"))).drop("_next")
    return number_stints(rows, s).withColumn(
        "stint_duration_minutes", (F.col("out_game_seconds") - F.col("in_game_seconds")) / 60.0
    )


def number_stints(rows: DataFrame, s: Spine = SPINE) -> DataFrame:
    """``stint_id``: 1, 2, … per (entity, person) by start."""
    return number_by_clock(rows, [s.entity, s.person], "in_game_seconds", s.order, "stint_id", s)


def rotations(base: DataFrame, s: Spine = SPINE) -> DataFrame:
    """Raw intervals in tenths of a second; one in ten is stretched past a break."""
    stretch = F.when(F.col(s.order) % 10 == 0, F.lit(15000)).otherwise(F.lit(0))
    return base.select(
        s.entity,
        s.order,
        F.col(s.person).alias("PERSON_ID"),
        F.col(s.team).alias("TEAM_ID"),
        (F.col("in_game_seconds") * 10).alias("IN_TIME_REAL"),
        (F.col("out_game_seconds") * 10 + stretch).alias("OUT_TIME_REAL"),
        (F.col(s.order) % 7).alias("PLAYER_PTS"),
        (F.col(s.order) % 11 - 5).alias("PT_DIFF"),
    )


def player_advanced(customer: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    slot = key % 17
    return customer.select(
        key.alias("PLAYER_ID"),
        F.col("c_name").alias("playerName"),
        (F.lit(2020) + key % 3).alias("season_int"),
        F.when(slot < 10, slot + 100).otherwise(slot + 190).alias("TEAM_ID"),
        (F.col("c_acctbal") / 1000).alias("NET_RATING"),
        (key % 82 + 1).alias("GP"),
    )


def player_season(orders: DataFrame) -> DataFrame:
    """Season totals per (player, season, team), and a TOT row where a player has
    more than one team."""
    season = (F.lit(2020) + F.year("o_orderdate") % 3).cast("long")
    per_team = orders.groupBy(
        F.col("o_custkey").alias("PLAYER_ID"),
        season.alias("season_int"),
        F.lit("rg").alias("season_type"),
        F.col("o_orderpriority").alias("TEAM_ABBREVIATION"),
    ).agg(F.count("*").alias("GP"), F.sum(F.floor("o_totalprice")).alias("PTS"))
    total = (
        per_team.groupBy("PLAYER_ID", "season_int", "season_type")
        .agg(F.count("*").alias("_teams"), F.sum("GP").alias("GP"), F.sum("PTS").alias("PTS"))
        .where("_teams > 1")
        .drop("_teams")
        .withColumn("TEAM_ABBREVIATION", F.lit("TOT"))
    )
    return per_team.unionByName(total)


def boxscores(spine: DataFrame, s: Spine = SPINE) -> DataFrame:
    shot = F.col(s.action).isin("2pt", "3pt")
    return spine.groupBy(s.entity, s.person).agg(
        F.max(s.team).alias("box_team"),
        F.sum(s.points).alias("points"),
        F.count_if(shot).alias("fieldGoalsAttempted"),
        F.count_if(shot & (F.col(s.points) > 1)).alias("fieldGoalsMade"),
    )
