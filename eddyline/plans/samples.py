"""Samples for the hypothesis tests: which value, which rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eddyline.config import SPINE, Spine
from eddyline.functions.predicates import SampleSpec


@dataclass(frozen=True)
class Metric:
    """A value per row, and whether one row stands for a whole possession."""

    value: str
    per_possession: bool = False
    shots_only: bool = False

    def column(self) -> Column:
        return F.expr(self.value)


METRICS = {
    "possession_points": Metric("cast(possession_points as double)", per_possession=True),
    "possession_outcome": Metric("possession_outcome", per_possession=True),
    "shot_made": Metric("case when shotResult = 'Made' then 1.0D else 0.0D end", shots_only=True),
    "points_per_event": Metric("cast(points_scored as double)"),
    "shot_distance": Metric("cast(shotDistance as double)", shots_only=True),
}


@dataclass(frozen=True)
class Comparison:
    """A preset: one metric, two samples, the test that suits it."""

    metric: str
    test: str
    a: SampleSpec
    b: SampleSpec


PRESETS = {
    "timeout effect on scoring": Comparison("possession_points", "glrt", SampleSpec(prev_event="timeout"), SampleSpec()),
    "clutch vs other shooting": Comparison("shot_made", "prop_z", SampleSpec(clutch=True), SampleSpec(clutch=False)),
    "home vs away 3pt": Comparison(
        "shot_made", "prop_z", SampleSpec(home_away="home", shot_type="3pt"), SampleSpec(home_away="away", shot_type="3pt")
    ),
    "shots after an offensive rebound": Comparison("shot_made", "glrt", SampleSpec(prev_event="offensive rebound"), SampleSpec()),
    "overtime vs regulation outcomes": Comparison(
        "possession_outcome", "chi2", SampleSpec(period="OT"), SampleSpec(period="regulation")
    ),
}


def sample_metric(rows: DataFrame, metric: str, spec: SampleSpec, label: str, s: Spine = SPINE) -> DataFrame:
    """(entity, order, season, season_type, value, sample) of one sample."""
    rows = _values(rows, metric, spec.condition(), s).where("_met")
    return rows.select(s.entity, s.order, s.season, s.season_type, "value", F.lit(label).alias("sample"))


def _values(rows: DataFrame, metric: str, condition: Column, s: Spine) -> DataFrame:
    """The metric and whether ``condition`` holds, one row per event or possession. Only
    the columns these need are read; season and type are constant in an entity."""
    m = METRICS[metric]
    if m.shots_only:
        rows = rows.where(F.col("isFieldGoal") == 1)
    met = F.coalesce(condition, F.lit(False)).alias("_met")
    if not m.per_possession:
        return rows.select(s.entity, s.order, s.season, s.season_type, m.column().alias("value"), met)
    slim = rows.where(F.col("possession_id").isNotNull()).select(s.entity, "possession_id", s.order, s.season, s.season_type, m.column().alias("value"), met)
    first = slim.groupBy(s.entity, "possession_id", s.season, s.season_type).agg(
        F.min_by("value", s.order).alias("value"), F.min_by("_met", s.order).alias("_met"), F.min(s.order).alias(s.order)
    )
    return first.drop("possession_id")


def preset_samples(rows: DataFrame, name: str, s: Spine = SPINE) -> DataFrame:
    """Both samples of a preset, stacked."""
    c = PRESETS[name]
    return sample_metric(rows, c.metric, c.a, "a", s).unionByName(sample_metric(rows, c.metric, c.b, "b", s))


def split_by(rows: DataFrame, metric: str, condition: Column, s: Spine = SPINE) -> DataFrame:
    """Rows of a metric labelled a where the condition holds and b elsewhere."""
    label = F.when(F.col("_met"), F.lit("a")).otherwise(F.lit("b")).alias("sample")
    return _values(rows, metric, condition, s).select(s.entity, s.order, s.season, s.season_type, "value", label)
