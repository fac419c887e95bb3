"""Questions the SQL layer is expected to answer, as DataFrame plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eddyline.config import SPINE, Spine
from eddyline.operators import joins
from eddyline.operators.aggregates import heatmap_2d, threshold_crossings
from eddyline.operators.scan import Changes, Sum, scan
from eddyline.plans import state
from eddyline.session import stage


def per_possession(plays: DataFrame, s: Spine = SPINE) -> DataFrame:
    """Mean points per possession by how it ended."""
    first = joins.first_in_group(
        plays.where("possession_id is not null").select(s.entity, "possession_id", s.order, "possession_points"),
        [s.entity, "possession_id"],
        [s.order],
    )
    ends = state.possession_outcomes(plays, s)
    return first.join(ends, [s.entity, "possession_id"]).groupBy("possession_outcome").agg(
        F.avg("possession_points").alias("avg_pts"), F.count("*").alias("possessions")
    )


def fatigue_by_stint_minute(rows: DataFrame, stints: DataFrame, min_minutes: float = 6, top: int = 6, s: Spine = SPINE) -> DataFrame:
    """Points of a player per team possession, by minute since entering.

    Possession starts of a team and points of a player become running totals over the
    clock, which each spell asks at the edges of its minutes: ``top`` + 1 questions a spell
    and no pair of a spell and a row.
    """
    spell = [s.entity, s.person, s.team, "_in", "_out"]
    long = stints.where((F.col("stint_duration_minutes") >= min_minutes) & (F.col("in_game_seconds") < F.col("out_game_seconds")))
    long = long.select(s.entity, s.person, s.team, F.col("in_game_seconds").alias("_in"), F.col("out_game_seconds").alias("_out")).groupBy(*spell).agg(F.count("*").alias("_w"))
    # one plain column each: a struct in the aggregation would have the whole log sorted
    starts = rows.where("possession_id is not null").groupBy(s.entity, "possession_id").agg(
        F.min_by(s.possession, s.order).alias("_who"), F.min_by(s.clock, s.order).alias(s.clock)
    )
    starts = starts.select(s.entity, "_who", s.clock, F.lit(0).alias("_kind"), F.lit(1).cast("long").alias("n"))
    scored = rows.where("possession_id is not null").select(s.entity, F.col(s.person).alias("_who"), s.clock, F.lit(1).alias("_kind"), F.col(s.points).alias("n"))
    edges = F.array(*[F.struct(F.lit(m).alias("m"), F.least(F.col("_in") + 60 * m, F.col("_out")).alias("at")) for m in range(top + 1)])
    asked = long.withColumn("_e", F.explode(edges)).withColumn("_q", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("who")) for k, c in enumerate((s.team, s.person))])))
    asked = asked.select(s.entity, s.person, "_in", "_w", F.col("_e.m").alias("_m"), F.col("_e.at").alias("_at"), F.col("_q.kind").alias("_kind"), F.col("_q.who").alias("_who"))
    before = joins.total_before(asked, starts.unionByName(scored), [s.entity, "_kind", "_who"], s.clock, "n", "_at", s.clock_span)
    # spells of a player that start together add up edge by edge
    sums = [F.sum(F.when((F.col("_kind") == k) & (F.col("_m") == m), F.col("before") * F.col("_w"))).alias(f"{name}{m}") for k, name in enumerate(("team", "person")) for m in range(top + 1)]
    per = before.groupBy(s.entity, s.person, "_in").agg(*sums)
    minutes = [
        F.struct(F.lit(m).cast("long").alias("stint_minute"), *[(F.col(f"{k}{m}") - F.col(f"{k}{m - 1}")).alias(k) for k in ("team", "person")])
        for m in range(1, top + 1)
    ]
    both = per.select(F.explode(F.array(*minutes)).alias("v")).select("v.*").where("team > 0")
    out = both.groupBy("stint_minute").agg(F.sum("team").alias("total_possessions"), F.sum("person").alias("total_player_pts"))
    return out.withColumn("pts_per_poss", F.try_divide("total_player_pts", "total_possessions"))


def after_event(rows: DataFrame, action: str, s: Spine = SPINE) -> DataFrame:
    """Points on the play after an event, and in possessions that contain it.

    Plays without points count as 0 in both.
    """
    after = rows.where(F.col("prev_action_type") == action)
    event = after.agg(F.lit("next_play").alias("level"), F.avg(s.points).alias("avg_points"), F.count("*").alias("n"))
    held = rows.where("possession_id is not null").groupBy(s.entity, "possession_id").agg(
        F.bool_or(F.col(s.action) == action).alias("_has"), F.max("possession_points").alias("_pts")
    )
    poss = held.where("_has").agg(F.lit("possession").alias("level"), F.avg("_pts").alias("avg_points"), F.count("*").alias("n"))
    return event.unionByName(poss)


def post_rebound_shots(plays: DataFrame, s: Spine = SPINE) -> DataFrame:
    """Shots taken after the last offensive rebound of their possession."""
    key = [s.entity, "possession_id"]
    rebound = (F.col(s.action) == "rebound") & (F.col(s.sub) == "offensive")
    last = plays.where(rebound & F.col("possession_id").isNotNull()).groupBy(*key).agg(F.max(s.order).alias("_last"))
    shots = plays.where(F.col("isFieldGoal") == 1).join(last, key).where(F.col(s.order) > F.col("_last"))
    return shots.drop("_last")


def shot_clock(plays: DataFrame, s: Spine = SPINE) -> DataFrame:
    """24 seconds less the clock run off since the possession began, if in [0, 24]."""
    key = [s.entity, "possession_id"]
    start = plays.where("possession_id is not null").groupBy(*key).agg(F.min_by(s.remaining, s.order).alias("_start"))
    left = 24.0 - (F.col("_start") - F.col(s.remaining))
    shots = plays.where(F.col("isFieldGoal") == 1).join(start, key).withColumn("shot_clock_remaining", left)
    return shots.where(F.col("shot_clock_remaining").between(0, 24)).drop("_start")


def safe_ratio(num: Column, den: Column) -> Column:
    return F.try_divide(num, den)


def season_join(box: DataFrame, totals: DataFrame, s: Spine = SPINE) -> DataFrame:
    """Rows joined to season totals on player, season and season type."""
    one = joins.prefer_total_row(totals, ["PLAYER_ID", "season_int", "season_type"])
    one = one.withColumnsRenamed({"PLAYER_ID": s.person, "season_int": s.season, "season_type": s.season_type})
    return box.join(one, [s.person, s.season, s.season_type])


# --- runs ------------------------------------------------------------------------


def scoring_runs(rows: DataFrame, s: Spine = SPINE) -> DataFrame:
    """Scoring rows numbered by run: consecutive scores of one team."""
    scoring = rows.where(F.col(s.points) > 0)
    return scan(scoring, [s.entity], [s.order], s.order_block(), [Changes("run_id", F.col(s.team), F.lit(True))])


def opponents(spine: DataFrame, s: Spine = SPINE) -> DataFrame:
    """The other team of each team, smallest id first."""
    pairs = state.team_pairs(spine, s)
    return pairs.groupBy(s.entity, F.col("teamA").alias("run_team")).agg(F.min("teamB").alias("opp_team"))


def next_points(queries: DataFrame, scoring: DataFrame, horizon: int, s: Spine = SPINE) -> DataFrame:
    """``next_run``, ``next_other`` and ``next_n`` over (clock, clock + horizon]: points of
    the query row's ``run_team``, of all other teams, and the number of scoring rows.

    Teams are compared directly, so an entity without a home team counts like any other.
    """
    rows = scoring.select(s.entity, s.clock, F.col(s.points).alias("all"), F.lit(1).cast("long").alias("n"))
    out = joins.forward_sum(queries, rows, [s.entity], s.clock, ["all", "n"], horizon, s.clock_span)
    own = scoring.where(F.col(s.team).isNotNull()).select(s.entity, F.col(s.team).alias("run_team"), s.clock, F.col(s.points).alias("run"))
    out = joins.forward_sum(out, own, [s.entity, "run_team"], s.clock, ["run"], horizon, s.clock_span)
    out = out.withColumn("next_run", F.coalesce("next_run", F.when(F.col("next_all").isNotNull(), F.lit(0).cast("long"))))
    return out.withColumn("next_other", F.col("next_all") - F.col("next_run")).drop("next_all")


def run_timeout_situations(
    enriched: DataFrame, size: int = 6, within: int = 60, horizon: int = 180, breaks: str = "period", s: Spine = SPINE
) -> DataFrame:
    """What follows runs of ``size``+ points: trailing timeout, break or neither."""
    rows = enriched.where((F.col(s.season_type) == "rg") & (F.col(s.clock) < 2880)).select(
        s.entity, s.order, s.clock, s.team, s.action, s.points, "home_teamId"
    )
    scoring = rows.where(F.col(s.points) > 0)
    runs = scoring_runs(rows, s).groupBy(s.entity, "run_id").agg(
        F.max(s.team).alias("run_team"),
        F.max("home_teamId").alias("home_teamId"),
        F.max(s.order).alias(s.order),
        F.max(s.clock).alias(s.clock),
        F.sum(s.points).alias("run_points"),
    )
    # one row per long run; the lookups below read it several times
    runs = stage(runs.where((F.col("run_points") >= size) & (F.col(s.clock) <= 2700)), "runs")
    stops = rows.where(F.col(s.action).isin("timeout", breaks))
    runs = runs.join(stops.select(s.entity).distinct(), s.entity, "left_semi")
    runs = runs.join(opponents(enriched, s), [s.entity, "run_team"], "left")
    calls = stops.where(F.col(s.action) == "timeout").withColumnRenamed(s.team, "opp_team")
    runs = joins.first_after(runs, calls, [s.entity, "opp_team"], s, within=within, prefix="to_")
    runs = joins.first_after(runs, stops.where(F.col(s.action) == breaks), [s.entity], s, within=within, prefix="br_")
    to, br = F.col(f"to_{s.clock}"), F.col(f"br_{s.clock}")
    situation = (
        F.when(to.isNotNull() & (br.isNull() | (to <= br)), F.lit("trailing_timeout"))
        .when(br.isNotNull(), F.lit("game_break"))
        .otherwise(F.lit("no_timeout"))
    )
    runs = stage(runs.withColumn("situation", situation), "situations")
    runs = next_points(runs, scoring, horizon, s).where("next_n > 0")
    mine, theirs = F.col("next_run"), F.col("next_other")
    return runs.groupBy("situation").agg(
        F.count("*").alias("num_runs"),
        F.avg("run_points").alias("avg_run_size"),
        F.avg(mine).alias("avg_running_pts"),
        F.avg(theirs).alias("avg_trailing_pts"),
        F.avg(theirs - mine).alias("avg_net_swing"),
        (100.0 * F.count_if(theirs > mine) / F.count("*")).alias("pct_trailing_wins"),
    )


def run_triggers(rows: DataFrame, size: int = 6, s: Spine = SPINE) -> DataFrame:
    """The row at which each run first reaches ``size`` points, staged: it is sparse
    and every question about it reads it more than once."""
    runs = scoring_runs(rows, s)
    key = [s.entity, "run_id"]
    runs = scan(runs, key, [s.order], s.order_block(), [Sum("run_points", F.col(s.points))])
    return stage(threshold_crossings(runs, key, s.order, "run_points", size), "triggers")


def run_trigger_categories(enriched: DataFrame, size: int = 6, within: int = 60, horizon: int = 180, s: Spine = SPINE) -> DataFrame:
    """First timeout within a minute of a run's trigger, by who called it, and what
    both sides score in the three minutes after."""
    need = [s.entity, s.order, s.clock, s.team, s.points, s.action, s.sub, "home_teamId"]
    regular = enriched.where(F.col(s.season_type) == "rg").select(*need)
    scoring = regular.where(F.col(s.points) > 0)
    triggers = run_triggers(regular, size, s).where(F.col(s.clock) < 2700)
    triggers = triggers.select(s.entity, s.order, s.clock, F.col(s.team).alias("run_team"), "home_teamId")
    triggers = triggers.join(opponents(enriched, s), [s.entity, "run_team"], "left")
    calls = enriched.where(F.col(s.action) == "timeout").select(*need)
    found = joins.first_after(triggers, calls, [s.entity], s, [s.team, s.sub], within, "to_")
    kind, team = F.lower(F.coalesce(f"to_{s.sub}", F.lit(""))), F.col(f"to_{s.team}")
    league = kind.rlike("official|mandatory|tv|media|auto") | team.isNull() | (team == 0)
    category = (
        F.when(F.col(f"to_{s.order}").isNull(), F.lit("no_timeout"))
        .when(league, F.lit("exogenous_break"))
        .when(team == F.col("opp_team"), F.lit("opponent_timeout"))
        .when(team == F.col("run_team"), F.lit("run_team_timeout"))
        .otherwise(F.lit("exogenous_break"))
    )
    start = F.coalesce(f"to_{s.clock}", s.clock)
    rows = stage(found.withColumn("category", category).withColumn(s.clock, start), "categories")
    rows = next_points(rows, scoring, horizon, s)
    zero = F.lit(0).cast("long")
    mine, theirs = F.coalesce("next_run", zero), F.coalesce("next_other", zero)
    return rows.groupBy("category").agg(
        F.count("*").alias("n_runs"),
        F.avg(mine).alias("avg_run_team_pts"),
        F.avg(theirs).alias("avg_opp_pts"),
        F.avg(mine - theirs).alias("avg_net_run_team"),
        (F.stddev_samp(mine - theirs) / F.sqrt(F.count("*"))).alias("se_net"),
    )


# --- time on the floor ----------------------------------------------------------


def possession_starts(rows: DataFrame, s: Spine = SPINE) -> DataFrame:
    opening = F.struct(F.col(s.possession).alias("offense"), F.col(s.clock), F.col(s.season), F.col(s.season_type))
    return (
        rows.where("possession_id is not null")
        .groupBy(s.entity, "possession_id")
        .agg(F.min_by(opening, s.order).alias("f"), F.max("possession_points").alias("possession_points"))
        .select(s.entity, "possession_id", "f.*", "possession_points")
    )


def floor_time(points: DataFrame, stints: DataFrame, team: str, out: str, s: Spine = SPINE) -> DataFrame:
    """Mean seconds since entering of the team's players on court."""
    spans = stints.select(s.entity, F.col(s.team).alias(team), F.col("in_game_seconds").alias("_in"), F.col("out_game_seconds").alias("_out"))
    return joins.mean_time_since_start(spans, points, [s.entity, team], s.clock, "_in", "_out", out, s.clock_span)


def with_defense(starts: DataFrame, spine: DataFrame, s: Spine = SPINE) -> DataFrame:
    pairs = state.team_pairs(spine, s).withColumnsRenamed({"teamA": "offense", "teamB": "defense"})
    return starts.join(pairs, [s.entity, "offense"])


def floor_time_heatmap(rows: DataFrame, stints: DataFrame, min_count: int = 100, s: Spine = SPINE) -> DataFrame:
    """Mean points by average minutes since entering, offence against defence."""
    regular = rows.where(F.col(s.season_type) == "rg")
    starts = stage(with_defense(possession_starts(regular, s), rows, s), "starts")
    spans = stints.where(F.col(s.season_type) == "rg")
    key = [s.entity, "possession_id", "defense"]
    defenders = floor_time(starts, spans, "defense", "def_s", s).select(*key, "def_s")
    both = floor_time(starts, spans, "offense", "off_s", s).join(defenders, key)
    both = both.where(F.col("off_s").between(0, 1200) & F.col("def_s").between(0, 1200))
    minute = lambda c: F.floor(F.col(c) / 60).cast("long")
    table = heatmap_2d(both, minute("off_s"), minute("def_s"), "possession_points", min_count)
    return table.where("x_bin <= 15 and y_bin <= 15")


def shooter_floor_time(rows: DataFrame, stints: DataFrame, season: int, min_count: int = 30, s: Spine = SPINE) -> DataFrame:
    """Mean points by the shooter's and the defenders' minutes on court, in steps
    of two minutes up to 14."""
    here = (F.col(s.season) == season) & (F.col(s.season_type) == "rg")
    regular, spans = rows.where(here), stints.where(here)
    starts = stage(with_defense(possession_starts(regular, s), rows, s), "starts")
    shots = regular.where(F.col(s.action).isin("2pt", "3pt") & F.col("possession_id").isNotNull())
    shooter = shots.groupBy(s.entity, "possession_id").agg(F.min_by(s.person, s.order).alias(s.person))
    entered = spans.groupBy(s.entity, s.person).agg(F.max("in_game_seconds").alias("_entered"))
    both = floor_time(starts, spans, "defense", "def_s", s)
    both = both.join(shooter, [s.entity, "possession_id"]).join(entered, [s.entity, s.person])
    off = (F.col(s.clock) - F.col("_entered")) / 60.0
    both = both.withColumn("off_min", off).withColumn("def_min", F.col("def_s") / 60.0).where("off_min >= 0 and def_min >= 0")
    step = lambda c: F.least(F.floor(F.col(c) / 2) * 2, F.lit(14)).cast("long")
    return heatmap_2d(both, step("off_min"), step("def_min"), "possession_points", min_count)


# --- small examples ------------------------------------------------------------------


def ratio_by_season(plays: DataFrame, s: Spine = SPINE) -> DataFrame:
    shot = F.col(s.action) == "3pt"
    made = shot & (F.col("shotResult") == "Made")
    return plays.groupBy(s.season).agg(
        F.count_if(shot).alias("attempts"), safe_ratio(F.count_if(made), F.count_if(shot)).alias("share_made")
    )


def top_players(plays: DataFrame, k: int = 10, min_attempts: int = 20, s: Spine = SPINE) -> DataFrame:
    shots = plays.where(F.col("isFieldGoal") == 1).groupBy(s.entity, s.person).agg(
        F.count("*").alias("attempts"), F.count_if(F.col("shotResult") == "Made").alias("made")
    )
    ratio = safe_ratio(F.col("made"), F.col("attempts"))
    return shots.where(F.col("attempts") >= min_attempts).withColumn("share_made", ratio).orderBy(
        F.desc("share_made"), F.desc("attempts"), s.entity, s.person
    ).limit(k)


def share_by_type(plays: DataFrame, s: Spine = SPINE) -> DataFrame:
    shots = plays.where(F.col("isFieldGoal") == 1)
    by_type = shots.groupBy(s.season_type, s.action).agg(F.count("*").alias("n"))
    totals = by_type.groupBy(s.season_type).agg(F.sum("n").alias("_t"))
    return by_type.join(totals, s.season_type).withColumn("share", F.col("n") / F.col("_t")).drop("_t")


def comebacks(spine: DataFrame, deficit: int = 15, s: Spine = SPINE) -> DataFrame:
    """Entities whose home side trailed by ``deficit`` or more and still won."""
    lead = F.col(s.home) - F.col(s.away)
    per = spine.groupBy(s.entity).agg(F.min(lead).alias("worst"), F.max_by(lead, s.order).alias("final_lead"))
    return per.where((F.col("worst") <= -deficit) & (F.col("final_lead") > 0))


def after_timeout_share(rows: DataFrame, s: Spine = SPINE) -> DataFrame:
    label = F.when(F.col("prev_action_type") == "timeout", F.lit("after timeout")).otherwise(F.lit("other"))
    return rows.groupBy(label.alias("situation")).agg(
        F.count("*").alias("n"), F.avg(F.when(F.col(s.points) > 0, 1.0).otherwise(0.0)).alias("scoring_share")
    )


# Words of a question that never name a player.
STOP_WORDS = (
    "show", "me", "the", "for", "this", "year", "season", "from", "what", "give", "how", "many", "all", "per", "game", "stats",
    "averages", "compare", "plot", "chart", "list", "top", "best", "worst", "most", "least", "with", "and", "points", "rebounds",
    "assists", "steals", "blocks", "turnovers", "shooting", "percentage",
)


def search_terms(question: str, stop_words: Sequence[str] = STOP_WORDS) -> list[str]:
    """Words of at least three letters or digits that are not stop words."""
    words = [w.strip("'\".,!?()").lower() for w in question.split()]
    return [w for w in words if len(w) >= 3 and w.isascii() and w.isalnum() and not w.isdigit() and w not in stop_words]


def name_search(df: DataFrame, key: str, name: Column, question: str, per_term: int = 5, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """Up to ``per_term`` rows per term whose folded name contains it, smallest key first.

    The ranking is cut inside each input partition before it is shuffled.
    """
    terms = search_terms(question, stop_words)
    if not terms:
        return df.select(F.lit("").alias("term"), F.col(key), name.alias("name")).where("false")
    folded = F.lower(name)
    hits = F.array_compact(F.array(*[F.when(folded.contains(t), F.lit(t)) for t in dict.fromkeys(terms)]))
    rows = df.select(F.explode(hits).alias("term"), F.col(key), name.alias("name"))
    rank = F.row_number().over(Window.partitionBy("term").orderBy(key))
    return rows.withColumn("rank", rank).where(F.col("rank") <= per_term)
