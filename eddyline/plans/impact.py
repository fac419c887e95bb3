"""Forward effects of events during runs, and control moments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eddyline.config import SPINE, Spine
from eddyline.operators.asof import nearest_shifted
from eddyline.operators.joins import join_null_safe
from eddyline.operators.scan import Changes, Last, scan
from eddyline.session import stage

ENDOGENOUS = ["coach_discretionary", "mistagged_discretionary"]
EXOGENOUS = ["tv_mandatory", "coach_absorb"]


def clock_states(spine: DataFrame, s: Spine = SPINE) -> DataFrame:
    """Score after the last event at each clock value: one row per (entity, clock)."""
    # one plain column each: a struct in the aggregation would have the whole log sorted
    return spine.groupBy(s.entity, s.clock).agg(
        F.max_by(s.home, s.order).alias("h"), F.max_by(s.away, s.order).alias("a"), F.max(s.order).alias("o")
    )


def forward_scores(
    rows: DataFrame, spine: DataFrame, minutes: Sequence[float], s: Spine = SPINE, keep_shift: bool = False
) -> DataFrame:
    """Change of lead between each row and the event nearest to clock + n min.

    Adds ``lead_change``, ``home_pts_scored`` and ``away_pts_scored``; with several
    horizons each row appears once per horizon, marked by ``minutes``.
    """
    shifts = [int(m * 60) if float(m * 60).is_integer() else m * 60.0 for m in minutes]
    found = nearest_shifted(rows, clock_states(spine, s), [s.entity], s.clock, shifts, s.clock_span, ["h", "a", "o"])
    joined = join_null_safe(rows, found, [s.entity, s.clock], "left")
    home = F.col("match")["h"] - F.col(s.home)
    away = F.col("match")["a"] - F.col(s.away)
    out = (
        joined.withColumn("home_pts_scored", home)
        .withColumn("away_pts_scored", away)
        .withColumn("lead_change", home - away)
    )
    if keep_shift:
        out = out.withColumn("minutes", F.col("shift") / 60.0)
    return out.drop("match", "shift")


def suffering_called(s: Spine = SPINE) -> Column:
    streak, team, home = F.col("streak"), F.col(s.team), F.col("home_teamId")
    return F.coalesce(((streak > 0) & (team != home)) | ((streak < 0) & (team == home)), F.lit(False))


def coarse_group(challenge_apart: bool, s: Spine = SPINE) -> Column:
    """endogenous / exogenous / (challenge) / control."""
    timeout, cause = F.col(s.action) == "timeout", F.col("timeout_cause")
    chain = (
        F.when(timeout & cause.isin(ENDOGENOUS) & suffering_called(s), F.lit("endogenous"))
        .when(timeout & cause.isin(EXOGENOUS), F.lit("exogenous"))
        .when(F.col(s.action) == "stoppage", F.lit("exogenous"))
    )
    if challenge_apart:
        chain = chain.when(timeout & (cause == "challenge"), F.lit("challenge"))
    return chain.otherwise(F.lit("control"))


def fine_subtype(s: Spine = SPINE) -> Column:
    timeout, cause = F.col(s.action) == "timeout", F.col("timeout_cause")
    return (
        F.when(timeout & cause.isin(*EXOGENOUS, *ENDOGENOUS), cause)
        .when(timeout & (cause == "challenge"), F.lit("coach_challenge"))
        .when(F.col(s.action) == "stoppage", F.lit("stoppage"))
        .otherwise(F.lit("control"))
    )


def candidate_rows(
    enriched: DataFrame, run_sizes: Sequence[int], challenge_apart: bool, s: Spine = SPINE
) -> DataFrame:
    """Rows inside a run, with one control per run segment.

    Segments are numbered among the rows that reach the run size, so two runs of
    one sign with only short runs between them count as one segment. Each run size
    is its own key, so a sweep is one pass.
    """
    # a few percent of the log; each phase of the scans reads them
    rows = stage(enriched.where(F.abs("streak") >= min(run_sizes)), "long-runs")
    sizes = F.array(*[F.lit(n) for n in run_sizes])
    rows = rows.withColumn("run_size", F.explode(sizes)).where(F.abs("streak") >= F.col("run_size"))
    rows = rows.withColumn("group", coarse_group(challenge_apart, s)).withColumn("subtype_fine", fine_subtype(s))
    key = [s.entity, "run_size"]
    segment = Changes("_seg", F.signum("streak"), F.lit(True))
    rows = scan(rows, key, [s.order], s.order_block(), [segment], keep_block=True)
    control = F.col("group") == "control"
    earlier = Last("_earlier", F.when(control, F.col("_seg")), inclusive=False)
    rows = scan(rows, key, [s.order], None, [earlier])
    opens = ~F.col("_earlier").eqNullSafe(F.col("_seg"))
    return rows.where(~control | opens).drop("_seg", "_earlier")


def run_impact(
    enriched: DataFrame,
    run_sizes: Sequence[int] = (6,),
    minutes: Sequence[float] = (3.0,),
    challenge_apart: bool = False,
    s: Spine = SPINE,
) -> DataFrame:
    """C6 (and C7 with ``challenge_apart``): recovery of the side suffering a run."""
    need = [
        s.entity, s.order, s.clock, s.remaining, s.period, s.action, s.sub, s.team, s.season, s.season_type,
        s.home, s.away, s.possession, "possession_id", "streak", "timeout_cause", "home_teamId", "away_teamId",
    ]
    # a few percent of the log, read once per horizon lookup and once for the join
    rows = stage(candidate_rows(enriched.select(*need), run_sizes, challenge_apart, s), "candidates")
    rows = forward_scores(rows, enriched, minutes, s, keep_shift=True).where("lead_change is not null")
    sign = F.signum("streak").cast("long")
    lead = F.col(s.home) - F.col(s.away)
    return (
        rows.withColumn("recovery", -sign * F.col("lead_change"))
        .withColumn("suffering_margin", -sign * lead)
        .withColumn("running_team_pts", F.when(sign > 0, F.col("home_pts_scored")).otherwise(F.col("away_pts_scored")))
        .withColumn("suffering_location", F.when(sign > 0, F.lit("away")).otherwise(F.lit("home")))
        .withColumn("lead", lead)
        .withColumn("clutch", (F.col(s.period) >= 4) & (F.col(s.remaining) <= 300) & (F.abs(lead) <= 5))
    )


def slice_filters(
    rows: DataFrame,
    location: str | None = None,
    margin: str | None = None,
    max_abs_margin: int | None = None,
    period: int | None = None,
    season_type: str | None = None,
    s: Spine = SPINE,
) -> DataFrame:
    """Keep rows by the suffering side's situation; every argument applies."""
    if location is not None:
        rows = rows.where(F.col("suffering_location") == location)
    if margin == "ahead":
        rows = rows.where("suffering_margin > 0")
    elif margin == "behind":
        rows = rows.where("suffering_margin < 0")
    if max_abs_margin is not None:
        rows = rows.where(F.abs("suffering_margin") <= max_abs_margin)
    if period is not None:
        rows = rows.where(F.col(s.period) == period)
    if season_type is not None:
        rows = rows.where(F.col(s.season_type) == season_type)
    return rows
