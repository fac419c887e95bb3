"""Nearest-control matching without forming pairs.

The distance between a treated and a control row depends only on their state
(streak, margin, clock), so both sides shrink to distinct states first. Streak and
margin are whole numbers within a small band, so each treated state asks one
as-of question per offset of the band; the best answer wins. The cost is linear:
(offsets × treated states) + control states, whatever one entity holds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eddyline.config import SPINE, Spine
from eddyline.operators.asof import asof
from eddyline.session import shuffle_tasks


@dataclass(frozen=True)
class TwinRule:
    """Bounds and weights of one matching rule."""

    clock: str = "seconds_remaining"
    same_period: bool = True
    other_period: bool = False
    nearest: int = 0
    farthest: int = 120
    clock_unit: int = 30
    streak_band: int = 2
    margin_band: int = 3
    streak_weight: int = 2
    margin_weight: int = 3


STANDARD = TwinRule()
DOUGHNUT = TwinRule(clock="game_seconds_elapsed", same_period=False, nearest=180, farthest=720, clock_unit=60)
OTHER_PERIOD = TwinRule(same_period=False, other_period=True)


def _span(band: int) -> Column:
    return F.sequence(F.lit(-band), F.lit(band))


def matched_twins(
    treated: DataFrame, controls: DataFrame, rule: TwinRule = STANDARD, value: str = "recovery", s: Spine = SPINE
) -> DataFrame:
    """Treated rows with their best control: ``c_order``, ``c_<value>``, ``dist``.

    Ties in distance go to the smallest control order; a control may serve many.
    Rows without a candidate are dropped.
    """
    by_period = rule.same_period or rule.other_period
    state = [s.entity, *([s.period] if by_period else []), "streak", "suffering_margin", rule.clock]
    best_control = F.min(F.struct(F.col(s.order).alias("o"), F.col(value).alias("v"))).alias("_ctl")
    lookup = controls.groupBy(*state).agg(best_control)
    lookup = lookup.withColumnsRenamed({"streak": "_cs", "suffering_margin": "_cm", rule.clock: "_t"})

    # a fixed number of tasks, not merged by size: each state grows to one row per offset of the
    # bands, and the task that writes them to the next shuffle holds them all
    tasks = -(-shuffle_tasks(treated.sparkSession) // 4)
    asked = treated.select(*state).repartition(tasks, *state).distinct()
    asked = asked.withColumn("_ds", F.explode(_span(rule.streak_band))).withColumn("_cs", F.col("streak") + F.col("_ds"))
    asked = asked.where(F.signum("_cs") == F.signum("streak"))
    asked = asked.withColumn("_dm", F.explode(_span(rule.margin_band))).withColumn("_cm", F.col("suffering_margin") + F.col("_dm"))
    keys = [s.entity, "_cs", "_cm"]
    if by_period:
        keys.append("_cp")
        lookup = lookup.withColumnRenamed(s.period, "_cp")
        if rule.other_period:
            # the periods that have controls of this state
            asked = asked.join(lookup.select(*keys).distinct(), keys[:-1]).where(F.col("_cp") != F.col(s.period))
        else:
            asked = asked.withColumn("_cp", F.col(s.period))
    # states with no control at this (streak, margin) cannot match: drop them early
    asked = asked.join(lookup.select(*keys).distinct(), keys, "left_semi")

    clock = F.col(rule.clock)
    sides = F.array(F.struct(F.lit(-1).alias("way"), (clock - rule.nearest).alias("t")), F.struct(F.lit(1).alias("way"), (clock + rule.nearest).alias("t")))
    asked = asked.withColumn("_p", F.explode(sides)).withColumn("_way", F.col("_p")["way"]).withColumn("_t", F.col("_p")["t"]).drop("_p")
    found = asof(lookup, asked, keys, "_t", ["_ctl"], s.clock_span)
    # an exact match of the probe time is always reported as ``backward``
    exact_hit = F.col("backward")["_t"] == F.col("_t")
    hit = F.when((F.col("_way") < 0) | exact_hit, F.col("backward")).otherwise(F.col("forward"))
    gap = F.abs(hit["_t"] - clock)
    dist = (
        F.abs("_ds") * rule.streak_weight
        + gap / rule.clock_unit
        + F.abs("_dm") * rule.margin_weight
    )
    found = found.where(hit.isNotNull() & (gap >= rule.nearest) & (gap <= rule.farthest))
    # compared in whole clock units, so that equal distances tie exactly
    exact = (F.abs("_ds") * rule.streak_weight + F.abs("_dm") * rule.margin_weight) * rule.clock_unit + gap
    best = found.groupBy(*state).agg(
        F.min(F.struct(exact.alias("d"), hit["_ctl"]["o"].alias("o"), hit["_ctl"]["v"].alias("v"), dist.alias("dist"))).alias("_best")
    )
    out = treated.join(best, state)
    b = F.col("_best")
    return (
        out.withColumn("c_order", b["o"]).withColumn(f"c_{value}", b["v"]).withColumn("dist", b["dist"]).drop("_best")
    )
