"""State derived from the ordered log: streaks, possessions, sides, results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eddyline.config import SPINE, Spine
from eddyline.operators.joins import join_null_safe
from eddyline.operators.scan import Changes, Lag, SegmentTotal, Streak, Sum, drop_layout, into_layout, layout_of, scan

def net_points(s: Spine = SPINE) -> Column:
    """Score gained by home minus away against the previous row, 0 at the start."""
    zero = F.lit(0).cast("long")
    home = F.greatest(F.coalesce(F.col(s.home) - F.col("_ph"), zero), zero)
    away = F.greatest(F.coalesce(F.col(s.away) - F.col("_pa"), zero), zero)
    return home - away


def previous_scores(s: Spine = SPINE) -> list[Lag]:
    return [Lag("_ph", F.col(s.home)), Lag("_pa", F.col(s.away))]


def with_streak(spine: DataFrame, s: Spine = SPINE) -> DataFrame:
    """Signed running net of the current scoring segment."""
    rows = scan(spine, [s.entity], [s.order], s.order_block(), previous_scores(s), keep_block=True)
    rows = rows.withColumn("_net", net_points(s))
    return scan(rows, [s.entity], [s.order], None, [Streak("streak", F.col("_net"))]).drop("_ph", "_pa", "_net")


def possession_step(s: Spine = SPINE) -> Changes:
    return Changes("_pid", F.col(s.possession), F.col(s.possession) > 0)


def live_possession(s: Spine = SPINE) -> Column:
    return F.when(F.col(s.possession) > 0, F.col("_pid"))


def with_possession_id(spine: DataFrame, s: Spine = SPINE) -> DataFrame:
    """Change index of the side in possession, null on dead rows."""
    rows = scan(spine, [s.entity], [s.order], s.order_block(), [possession_step(s)])
    return rows.withColumn("possession_id", live_possession(s)).drop("_pid")


def with_possession_points(rows: DataFrame, s: Spine = SPINE) -> DataFrame:
    """Points of each possession on all its rows."""
    key = [s.entity, "possession_id"]
    sums = rows.where("possession_id is not null").groupBy(*key).agg(F.sum(s.points).alias("possession_points"))
    return rows.join(sums, key, "left")


def possession_outcomes(rows: DataFrame, s: Spine = SPINE) -> DataFrame:
    """How each possession ended; the first label in the chain that holds wins."""
    action, made = F.col(s.action), F.col("shotResult") == "Made"
    any_of = lambda c: F.max(F.coalesce(c, F.lit(False)))
    flags = (
        rows.where("possession_id is not null")
        .groupBy(s.entity, "possession_id")
        .agg(
            any_of(action == "steal").alias("steal"),
            any_of((action == "2pt") & made).alias("two"),
            any_of((action == "3pt") & made).alias("three"),
            any_of(action.isin("2pt", "3pt") & (F.col("shotResult") == "Missed")).alias("missed"),
            F.count_if(action == "freethrow").alias("ft"),
            F.count_if((action == "freethrow") & made).alias("ft_made"),
            F.max_by(F.struct(action.alias("action"), F.col(s.sub).alias("sub")), s.order).alias("last"),
        )
    )
    last, two, three = F.col("last"), F.col("two"), F.col("three")
    no_basket, and_one = ~two & ~three, F.col("ft_made") > 0
    outcome = (
        F.when(three & and_one, F.lit("made_3pt_and1"))
        .when(two & and_one, F.lit("made_2pt_and1"))
        .when(three, F.lit("made_3pt"))
        .when(two, F.lit("made_2pt"))
        .when(no_basket & (F.col("ft") > 0), F.concat(F.lit("ft_"), "ft_made", F.lit("_of_"), "ft"))
        .when((last["action"] == "turnover") & F.col("steal"), F.lit("turnover_live"))
        .when(last["action"] == "turnover", F.lit("turnover_dead"))
        .when((last["action"] == "rebound") & (last["sub"] == "defensive"), F.lit("miss_def_reb"))
        .when(last["action"] == "period", F.lit("end_of_period"))
        .when(last["action"] == "violation", F.lit("violation"))
        .when(F.col("missed"), F.lit("miss"))
        .otherwise(F.lit("other"))
    )
    return flags.select(s.entity, "possession_id", outcome.alias("possession_outcome"))


def possessions(rows: DataFrame, s: Spine = SPINE, first: tuple[str, ...] | None = None) -> DataFrame:
    """One row per possession: its opening state and its points.

    ``rows`` carries ``possession_id``, ``possession_points`` and the columns in
    ``first``, which are read at the possession's first row.
    """
    first = first or (s.period, s.clock, s.remaining, "score_margin", "streak", s.season, s.season_type, "IsPlayoff", s.possession)
    opening = F.min_by(F.struct(*first), s.order).alias("_first")
    return (
        rows.where("possession_id is not null")
        .groupBy(s.entity, "possession_id")
        .agg(opening, F.max_by("possession_points", s.order).alias("possession_points"))
        .select(s.entity, "possession_id", "_first.*", "possession_points")
    )


def home_team(spine: DataFrame, s: Spine = SPINE) -> DataFrame:
    """The team that scores when the home score rises; earliest row decides."""
    scoring = spine.where((F.col(s.points) > 0) & (F.col(s.team) > 0)).select(s.entity, s.order, s.team, s.home)
    rows = scan(scoring, [s.entity], [s.order], s.order_block(), [Lag("_ph", F.col(s.home))])
    return (
        rows.where(F.col(s.home) > F.col("_ph"))
        .groupBy(s.entity)
        .agg(F.min_by(s.team, s.order).alias("home_teamId"))
    )


def teams(spine: DataFrame, s: Spine = SPINE) -> DataFrame:
    return spine.where(F.col(s.team) > 0).select(s.entity, s.team).distinct()


def team_pairs(spine: DataFrame, s: Spine = SPINE) -> DataFrame:
    """Ordered pairs of distinct teams per entity (a handful of teams each)."""
    sides = teams(spine, s)
    a = sides.withColumnRenamed(s.team, "teamA")
    b = sides.withColumnRenamed(s.team, "teamB")
    return a.join(b, s.entity).where("teamA <> teamB")


def home_away(spine: DataFrame, s: Spine = SPINE) -> DataFrame:
    pairs = team_pairs(spine, s).withColumnsRenamed({"teamA": "home_teamId", "teamB": "away_teamId"})
    return pairs.join(home_team(spine, s), [s.entity, "home_teamId"])


def away_team(spine: DataFrame, s: Spine = SPINE) -> DataFrame:
    """Smallest team id of the entity that is not the home team."""
    other = teams(spine, s).join(home_team(spine, s), s.entity).where(F.col(s.team) != F.col("home_teamId"))
    return other.groupBy(s.entity).agg(F.min(s.team).alias("away_teamId"))


def final_score(spine: DataFrame, s: Spine = SPINE) -> DataFrame:
    end = F.max_by(F.struct(F.col(s.home).alias("final_home"), F.col(s.away).alias("final_away")), s.order)
    start = F.min_by(F.struct(s.season, s.season_type), s.order)
    return (
        spine.groupBy(s.entity)
        .agg(end.alias("e"), start.alias("b"))
        .select(s.entity, "e.*", "b.*")
        .withColumn("home_won", F.col("final_home") > F.col("final_away"))
    )


def wins_by_team(spine: DataFrame, s: Spine = SPINE) -> DataFrame:
    """One row per (entity, team) with its opponent, result and score difference."""
    home = F.col("teamId") == F.col("home_teamId")
    diff = F.col("final_home") - F.col("final_away")
    pairs = team_pairs(spine, s).withColumnsRenamed({"teamA": "teamId", "teamB": "opponent_team"})
    return (
        pairs.join(home_team(spine, s), s.entity)
        .join(final_score(spine, s), s.entity)
        .withColumn("won", F.when(home, diff > 0).otherwise(diff < 0))
        .withColumn("pt_diff", F.when(home, diff).otherwise(-diff))
    )


def team_season_record(spine: DataFrame, s: Spine = SPINE) -> DataFrame:
    """Wins, losses and share of wins per (season, team), regular season only."""
    games = wins_by_team(spine.where(F.col(s.season_type) == "rg"), s)
    sums = games.groupBy(s.season, "teamId").agg(
        F.count_if(F.col("won")).alias("wins"), F.count_if(~F.col("won")).alias("losses")
    )
    return sums.withColumn("wpct", F.try_divide("wins", F.col("wins") + F.col("losses")))


def team_season_ppp(poss: DataFrame, s: Spine = SPINE) -> DataFrame:
    return (
        poss.where(F.col(s.possession) > 0)
        .groupBy(s.season, s.season_type, F.col(s.possession).alias("teamId"))
        .agg(F.sum("possession_points").alias("total_pts"), F.count("*").alias("n_poss"))
        .withColumn("ppp", F.try_divide("total_pts", "n_poss"))
    )


def head_to_head(spine: DataFrame, poss: DataFrame, s: Spine = SPINE) -> DataFrame:
    """Point differential per possession for each ordered pair of teams."""
    counts = poss.where(F.col(s.possession) > 0).groupBy(s.entity).agg(F.count("*").alias("n_poss"))
    return (
        wins_by_team(spine, s)
        .join(counts, s.entity)
        .groupBy(s.season, s.season_type, F.col("teamId").alias("calling_team"), "opponent_team")
        .agg(
            F.count("*").alias("n_games"),
            F.sum("pt_diff").alias("total_pt_diff"),
            F.sum("n_poss").alias("total_poss"),
        )
        .withColumn("pt_diff_per_poss", F.try_divide("total_pt_diff", "total_poss"))
    )


def team_net_rating(players: DataFrame) -> DataFrame:
    """Games-weighted mean rating per (team, season)."""
    weighted = F.sum(F.col("NET_RATING") * F.col("GP"))
    return players.groupBy(F.col("TEAM_ID").alias("teamId"), F.col("season_int").alias("season")).agg(
        F.try_divide(weighted, F.sum("GP")).alias("team_net_rating")
    )


def running_ppp(poss: DataFrame, s: Spine = SPINE) -> DataFrame:
    """Points per possession of the side so far in the entity, per possession."""
    keys = [s.entity, s.possession]
    rows = scan(
        poss.select(*keys, "possession_id", "possession_points"),
        keys,
        ["possession_id"],
        s.order_block("possession_id"),
        [Sum("cum_pts", F.col("possession_points")), Sum("cum_poss", F.lit(1).cast("long"))],
    )
    return rows.withColumn("team_cum_ppp", F.try_divide("cum_pts", "cum_poss"))


def sides(spine: DataFrame, s: Spine = SPINE) -> DataFrame:
    """Home and away team, one row per entity."""
    others = join_null_safe(teams(spine, s), home_team(spine, s), [s.entity])
    away = F.min(F.when(F.col(s.team) != F.col("home_teamId"), F.col(s.team)))
    return others.groupBy(s.entity, "home_teamId").agg(away.alias("away_teamId"))


def enrich(spine: DataFrame, labels: DataFrame, teams_of: DataFrame, s: Spine = SPINE) -> DataFrame:
    """The enriched spine: one shuffle of the log by (entity, block).

    Both scans, the possession totals and the entity's teams (``teams_of``) work in
    that layout; ``labels`` (role and cause of the sparse intervention rows) is
    joined on it too, when the write runs inside ``session.reuse_layout``. Columns that no
    step reads travel in one struct, which each window copies as a whole.
    """
    block = s.order_block()
    used = [s.entity, s.order, s.clock, s.action, s.sub, s.possession, s.points, s.home, s.away]
    spare = [c for c in spine.columns if c not in used]
    rows = scan(
        spine.select(*used, F.struct(*spare).alias("_spare")) if spare else spine,
        [s.entity],
        [s.order],
        block,
        [
            *previous_scores(s),
            possession_step(s),
            Lag("prev_action_type", F.col(s.action)),
            Lag("prev_sub_type", F.col(s.sub)),
        ],
        keep_block=True,
    )
    rows = rows.withColumn("_net", net_points(s)).withColumn("possession_id", live_possession(s))
    rows = scan(
        rows,
        [s.entity],
        [s.order],
        None,
        [
            Streak("streak", F.col("_net")),
            SegmentTotal("possession_points", "possession_id", F.col(s.points), [s.entity]),
        ],
        attach=teams_of,
        keep_block=True,
    )
    rows = rows.drop("_ph", "_pa", "_pid", "_net")
    margin = F.col(s.home) - F.col(s.away)
    rows = rows.withColumn("score_margin", margin).withColumn(
        "is_clutch", (F.abs(margin) <= 5) & (F.col(s.clock) >= 2400)
    )
    own = into_layout(labels, rows, [s.entity], block)
    rows = drop_layout(rows.join(own, [*layout_of(rows, [s.entity]), s.order], "left"))
    added = [c for c in rows.columns if c not in (*used, "_spare")]
    rows = rows.select(*[F.col(f"_spare.{c}") if c in spare else F.col(c) for c in spine.columns], *added)
    return rows.withColumn("timeout_role", F.coalesce("timeout_role", F.lit(""))).withColumn(
        "timeout_cause", F.coalesce("timeout_cause", F.lit(""))
    )
