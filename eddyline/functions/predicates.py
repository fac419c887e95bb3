"""Row predicates. Each returns a boolean column, so filters reach the scan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENDOGENOUS = ("coach_discretionary", "mistagged_discretionary")
EXOGENOUS = ("tv_mandatory", "coach_absorb")
OLDER_ENDOGENOUS = ("Regular", "Short", "Coach Challenge")
OLDER_EXOGENOUS = ("Official", "Official TV")


def is_timeout(label: str = "timeout") -> Column:
    return F.col("actionType") == label


def is_endogenous() -> Column:
    return F.col("timeout_cause").isin(*ENDOGENOUS)


def is_exogenous() -> Column:
    return F.col("timeout_cause").isin(*EXOGENOUS)


def older_endogenous() -> Column:
    return F.col("subType").isin(*OLDER_ENDOGENOUS)


def older_exogenous() -> Column:
    return F.col("subType").isin(*OLDER_EXOGENOUS)


def is_stoppage() -> Column:
    return F.col("actionType") == "stoppage"


def action_subtype(action: str, sub: str) -> Column:
    return (F.col("actionType") == action) & (F.col("subType") == sub)


def is_challenge() -> Column:
    return action_subtype("timeout", "challenge")


def is_exogenous_break() -> Column:
    return is_exogenous() | is_stoppage()


def streak_at_least(n: int, direction: str = "either") -> Column:
    streak = F.col("streak")
    options = {"home": streak >= n, "away": streak <= -n, "either": F.abs(streak) >= n}
    if direction not in options:
        raise ValueError(f"direction must be one of {sorted(options)}, got {direction!r}")
    return options[direction]


def season_range(lo: int, hi: int) -> Column:
    return F.col("season").between(lo, hi)


def label_contains(column: str, part: str) -> Column:
    return F.coalesce(F.trim(F.col(column).cast("string")).contains(part), F.lit(False))


def label_in(column: str, labels: Sequence[str]) -> Column:
    return F.coalesce(F.trim(F.col(column).cast("string")).isin(*labels), F.lit(False))


CLASSIFIER_COLUMNS = (
    "gameId", "orderNumber", "period", "seconds_remaining", "actionType", "subType", "teamId", "personId", "qualifiers",
    "scoreHome", "scoreAway", "points_scored", "season",
)


def classifier_prep(df: DataFrame, seasons: tuple[int, int] | None, action: str) -> DataFrame:
    """The classifier's input: the columns that exist, the seasons asked for,
    trimmed labels, base role and era."""
    rows = df.select(*[c for c in CLASSIFIER_COLUMNS if c in df.columns])
    if seasons is not None:
        rows = rows.where(season_range(*seasons))
    rows = rows.withColumns({"actionType": F.trim("actionType"), "subType": F.trim("subType")}).where(is_timeout(action))
    challenge = label_in("subType", ["challenge", "Coach Challenge"])
    return rows.select(
        "gameId", "orderNumber", "season", (F.col("season") < 2017).alias("early"),
        F.when(challenge, F.lit("challenge")).otherwise(F.lit("discretionary")).alias("base_role"),
    )


PERIODS = {"regulation": (1, 4), "OT": (5, None), "Q1": (1, 1), "Q2": (2, 2), "Q3": (3, 3), "Q4": (4, 4)}


@dataclass(frozen=True)
class SampleSpec:
    """Choices that define one sample; unset ones do not filter."""

    seasons: tuple[int, ...] = ()
    season_type: str | None = None
    teams: tuple[int, ...] = ()
    persons: tuple[int, ...] = ()
    prev_event: str | None = None
    period: str | None = None
    clutch: bool | None = None
    shot_type: str | None = None
    home_away: str | None = None

    def condition(self) -> Column:
        parts = []
        if self.seasons:
            parts.append(F.col("season").isin(*self.seasons))
        if self.season_type:
            parts.append(F.col("season_type") == self.season_type)
        if self.teams:
            parts.append(F.col("teamId").isin(*self.teams))
        if self.persons:
            parts.append(F.col("personId").isin(*self.persons))
        if self.prev_event == "offensive rebound":
            parts.append((F.col("prev_action_type") == "rebound") & (F.col("prev_sub_type") == "offensive"))
        elif self.prev_event:
            parts.append(F.col("prev_action_type") == self.prev_event)
        if self.period:
            first, last = PERIODS[self.period]
            parts.append(F.col("period") >= first if last is None else F.col("period").between(first, last))
        if self.clutch is not None:
            parts.append(F.col("is_clutch") == self.clutch)
        if self.shot_type:
            parts.append(F.col("actionType") == self.shot_type)
        if self.home_away == "home":
            parts.append(F.col("teamId") == F.col("home_teamId"))
        elif self.home_away == "away":
            parts.append(F.col("teamId") != F.col("home_teamId"))
        condition = F.lit(True)
        for part in parts:
            condition = condition & part
        return condition
