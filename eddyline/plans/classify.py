"""Labelling of interventions by rule tables.

Interventions are a small share of the log, so every rule works on those rows
only; ``state.enrich`` joins the labels back by key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eddyline.config import SPINE, Spine
from eddyline.operators.joins import join_null_safe
from eddyline.operators.scan import Lag, Sum, scan

# Fixed values of the published rule tables: periods and the clock marks (seconds
# remaining) at which slot 1, 2, 3 falls due.
SLOTS_BEFORE_2017 = [([2, 4], [540, 360, 180]), ([1, 3], [360, 180]), ([5, 6, 7, 8, 9, 10], [180])]
SLOTS_FROM_2017 = [([1, 2, 3, 4], [420, 180]), ([5, 6, 7, 8, 9, 10], [180])]
LATE_ONLY_BEFORE_2017 = [([2, 4], [540, 360, 180])]
ALL_FOUR_FROM_2017 = [([1, 2, 3, 4], [420, 180])]
ABSORB_BUFFER = 80
BUFFER_SWEEP = [30, 60, 120, 180, 240, 300, 600, 1200]
CHALLENGES = ("challenge", "Coach Challenge")


def triggers_for(period: Column, table) -> Column:
    """Array of clock marks of the period, null where the table has none."""
    chain = None
    for periods, marks in table:
        value = F.array(*[F.lit(m).cast("long") for m in marks])
        chain = F.when(period.isin(*periods), value) if chain is None else chain.when(period.isin(*periods), value)
    return chain


def is_flagged(signal: str, columns: Sequence[str], s: Spine = SPINE) -> Column:
    """Whether the feed marks a row as league-mandated."""
    if signal == "person_zero":
        if s.person not in columns:
            raise ValueError(f"signal {signal!r} needs column {s.person!r}")
        return F.coalesce(F.col(s.person) == 0, F.lit(False))
    if signal == "qualifier":
        if "qualifiers" not in columns:
            raise ValueError(f"signal {signal!r} needs column 'qualifiers'")
        return F.coalesce(F.col("qualifiers").cast("string").contains("mandatory"), F.lit(False))
    raise ValueError(f"unknown signal {signal!r}")


@dataclass(frozen=True)
class Rules:
    """One feed's vocabulary and slot table."""

    action: str = "timeout"
    challenges: tuple[str, ...] = CHALLENGES
    signal: str = "qualifier"
    slots: tuple = tuple((tuple(p), tuple(t)) for p, t in SLOTS_FROM_2017)
    buffer: int = ABSORB_BUFFER


OLDER_FEED = Rules(
    action="Timeout",
    signal="person_zero",
    slots=tuple((tuple(p), tuple(t)) for p, t in SLOTS_BEFORE_2017),
)


def prepare_interventions(spine: DataFrame, home: DataFrame | None, rules: Rules = Rules(), s: Spine = SPINE) -> DataFrame:
    """Intervention rows with slot rank, first-by-team flag and slot owner."""
    rows = spine.where(F.trim(s.action) == rules.action)
    rows = rows.withColumn("_challenge", F.coalesce(F.trim(s.sub).isin(*rules.challenges), F.lit(False)))
    rows = rows.withColumn("_flag", is_flagged(rules.signal, spine.columns, s))
    key = [s.entity, s.period, s.team]
    first = rows.where(~F.col("_challenge") & F.col(s.team).isNotNull()).groupBy(*key).agg(F.min(s.order).alias("_first"))
    # a flagged challenge still moves the slot counter
    rows = scan(rows, [s.entity, s.period], [s.order], s.order_block(), [Sum("_rank", F.col("_flag").cast("long"))])
    rows = join_null_safe(rows, first, key, "left").withColumn("_is_first", F.coalesce(F.col(s.order) == F.col("_first"), F.lit(False)))
    if home is None:
        rows = rows.withColumn("home_teamId", F.lit(None).cast("long"))
    else:
        rows = join_null_safe(rows, home, [s.entity], "left")
    return rows.withColumn("_triggers", triggers_for(F.col(s.period), rules.slots))


def role_and_cause(rows: DataFrame, buffer: Column, s: Spine = SPINE) -> DataFrame:
    """C3 and C4 on prepared rows."""
    rank, marks, team, home = F.col("_rank"), F.col("_triggers"), F.col(s.team), F.col("home_teamId")
    mandatory = F.col("_flag") & ~F.col("_challenge")
    slots = F.size(marks)
    mark = F.try_element_at(marks, rank.cast("int"))
    unknown = home.isNull()
    owner = F.coalesce(
        F.when(rank == 1, unknown | (team == home)).when(rank == 2, unknown | ((team != home) & (team > 0))).otherwise(True),
        F.lit(False),
    )
    early = F.col(s.remaining) - mark
    mistagged = F.lit("mistagged_discretionary")
    role = (
        F.when(F.col("_challenge"), F.lit("challenge"))
        .when(mandatory & marks.isNotNull(), F.concat(F.lit("slot_"), F.least(rank, slots.cast("long")), F.lit("_mandatory")))
        .otherwise(F.lit("discretionary"))
    )
    cause = (
        F.when(F.col("_challenge"), F.lit("challenge"))
        .when(~mandatory | marks.isNull(), F.lit("coach_discretionary"))
        .when(rank > slots, mistagged)
        .when(early <= 0, F.when(owner, F.lit("tv_mandatory")).otherwise(mistagged))
        .when(early > 0, F.when(F.col("_is_first") & owner & (early <= buffer), F.lit("coach_absorb")).otherwise(mistagged))
        .otherwise(F.lit(""))
    )
    return rows.withColumn("timeout_role", role).withColumn("timeout_cause", cause)


def classify_events(spine: DataFrame, home: DataFrame | None, rules: Rules = Rules(), s: Spine = SPINE) -> DataFrame:
    """(entity, order, timeout_role, timeout_cause) for every intervention row."""
    rows = role_and_cause(prepare_interventions(spine, home, rules, s), F.lit(rules.buffer), s)
    return rows.select(s.entity, s.order, "timeout_role", "timeout_cause")


def buffer_sweep(spine: DataFrame, home: DataFrame, buffers: Sequence[int] = BUFFER_SWEEP, s: Spine = SPINE) -> DataFrame:
    """Counts per cause for each absorb buffer, in one pass over prepared rows."""
    rows = prepare_interventions(spine, home, Rules(), s)
    rows = rows.withColumn("buffer", F.explode(F.array(*[F.lit(b) for b in buffers])))
    return role_and_cause(rows, F.col("buffer"), s).groupBy("buffer", "timeout_cause").agg(F.count("*").alias("n"))


# --- alternative classifiers ------------------------------------------------


def _roles(spine: DataFrame, action: str, s: Spine) -> DataFrame:
    rows = spine.where(F.trim(s.action) == action)
    rows = rows.withColumn("_challenge", F.coalesce(F.trim(s.sub).isin(*CHALLENGES), F.lit(False)))
    return rows.withColumn("_early_era", F.col(s.season) < 2017)


def _base_role() -> Column:
    return F.when(F.col("_challenge"), F.lit("challenge")).otherwise(F.lit("discretionary"))


def _era_triggers(before, after, s: Spine) -> Column:
    period = F.col(s.period)
    return F.when(F.col("_early_era"), triggers_for(period, before)).otherwise(triggers_for(period, after))


@dataclass(frozen=True)
class SlotClaim:
    """Parameters of one slot-claim variant (applied before 2017 / from 2017)."""

    before: tuple
    after: tuple
    below: int = 90
    above: int = 0
    # upper edge of a claim above its mark; None means the previous mark
    reach: int | None = None
    cascading: bool = True


def _freeze(table):
    return tuple((tuple(p), tuple(t)) for p, t in table)


SLOT_CLAIMS = {
    "v1": SlotClaim(_freeze(LATE_ONLY_BEFORE_2017), _freeze(ALL_FOUR_FROM_2017)),
    "v2": SlotClaim(_freeze(LATE_ONLY_BEFORE_2017), _freeze(ALL_FOUR_FROM_2017), reach=30),
    "v3": SlotClaim(_freeze(LATE_ONLY_BEFORE_2017), _freeze(ALL_FOUR_FROM_2017), reach=0),
    "v5": SlotClaim(_freeze(SLOTS_BEFORE_2017), _freeze(ALL_FOUR_FROM_2017)),
}


def slot_claim(spine: DataFrame, claim: SlotClaim, action: str = "timeout", s: Spine = SPINE) -> DataFrame:
    """Per slot in order, the first eligible row of (entity, period) claims it.

    Slots are few, so the passes are unrolled. Each pass is one aggregation to a
    row per (entity, period) and a join back.
    """
    key = [s.entity, s.period]
    rows = _roles(spine, action, s).withColumn("_marks", _era_triggers(claim.before, claim.after, s))
    rows = rows.select(*key, s.order, s.remaining, s.season, "_challenge", "_early_era", "_marks")
    sr = F.col(s.remaining)
    open_rows = rows.where(~F.col("_challenge") & F.col("_marks").isNotNull())
    depth = max(len(t) for table in (claim.before, claim.after) for _, t in table)
    # state per (entity, period): order and kind of the rows that took slots 1..k
    state = None
    for slot in range(1, depth + 1):
        mark = F.try_element_at("_marks", F.lit(slot))
        if claim.reach is not None:
            upper = mark + claim.reach
        elif slot == 1:
            upper = F.lit(720)
        else:
            upper = F.try_element_at("_marks", F.lit(slot - 1))
        eligible = (sr > mark - claim.below) & (sr <= upper)
        rows_k = open_rows
        if state is not None:
            rows_k = rows_k.join(state, key, "left")
            taken = F.lit(False)
            for j in range(1, slot):
                taken = taken | F.coalesce(F.col(f"_o{j}") == F.col(s.order), F.lit(False))
            blocked = F.lit(False)
            if claim.cascading:
                for j in range(1, slot):
                    blocked = blocked | (F.col("_early_era") & F.coalesce(F.col(f"_m{j}"), F.lit(False)))
            eligible = eligible & ~taken & ~blocked
        won = rows_k.where(eligible).groupBy(*key).agg(
            F.min(s.order).alias(f"_o{slot}"), F.min_by(sr <= mark + claim.above, s.order).alias(f"_m{slot}")
        )
        state = won if state is None else state.join(won, key, "full")
    role = _base_role()
    joined = rows.join(state, key, "left")
    chain = None
    for slot in range(1, depth + 1):
        hit = F.col(f"_o{slot}") == F.col(s.order)
        label = F.when(F.col(f"_m{slot}"), F.lit(f"slot_{slot}_mandatory")).otherwise(F.lit(f"slot_{slot}_absorbed"))
        chain = F.when(hit, label) if chain is None else chain.when(hit, label)
    return joined.select(*key, s.order, s.season, chain.otherwise(role).alias("timeout_role"))


def nearest_trigger(spine: DataFrame, action: str = "timeout", below: int = 90, s: Spine = SPINE) -> DataFrame:
    """v4: one mandatory per (entity, period), the row closest below a mark."""
    key = [s.entity, s.period]
    rows = _roles(spine, action, s).withColumn(
        "_marks", _era_triggers(LATE_ONLY_BEFORE_2017, ALL_FOUR_FROM_2017, s)
    )
    rows = rows.select(*key, s.order, s.remaining, s.season, "_challenge", "_marks")
    near = (
        rows.where(~F.col("_challenge"))
        .select(*key, s.order, s.remaining, F.posexplode("_marks").alias("_slot", "_mark"))
        .withColumn("_dist", F.col("_mark") - F.col(s.remaining))
        .where(f"_dist between 0 and {below}")
    )
    best = near.groupBy(*key).agg(
        F.min(F.struct("_dist", s.order, "_slot")).alias("_best")
    )
    hit = F.col("_best")[s.order] == F.col(s.order)
    label = F.concat(F.lit("slot_"), F.col("_best")["_slot"] + 1, F.lit("_mandatory"))
    role = F.when(hit, label).otherwise(_base_role())
    return rows.join(best, key, "left").select(*key, s.order, s.season, role.alias("timeout_role"))


def stateful_rule(spine: DataFrame, action: str = "timeout", s: Spine = SPINE) -> DataFrame:
    """v6: the k-th eligible row takes slot k; the only state is a counter."""
    key = [s.entity, s.period]
    table_before = [(p, t) for p, t in SLOTS_BEFORE_2017 if 5 not in p]
    table_after = [(p, t) for p, t in SLOTS_FROM_2017 if 5 not in p]
    overtime = F.when(F.col(s.period) >= 5, F.array(F.lit(180).cast("long")))
    marks = F.coalesce(_era_triggers(table_before, table_after, s), overtime)
    rows = _roles(spine, action, s).withColumn("_marks", marks)
    counted = ~F.col("_challenge") & F.col(s.remaining).isNotNull()
    rows = scan(
        rows.select(*key, s.order, s.remaining, s.season, "_challenge", "_marks"),
        key,
        [s.order],
        s.order_block(),
        [Sum("_k", counted.cast("long"))],
    )
    mark = F.try_element_at("_marks", F.col("_k").cast("int"))
    kind = F.when(F.col(s.remaining) > mark, F.lit("_absorbed")).otherwise(F.lit("_mandatory"))
    role = F.when(counted & mark.isNotNull(), F.concat(F.lit("slot_"), "_k", kind)).otherwise(_base_role())
    return rows.select(*key, s.order, s.season, role.alias("timeout_role"))


def structural_rule(spine: DataFrame, near_mark: bool, action: str = "timeout", below: int = 90, s: Spine = SPINE) -> DataFrame:
    """v7 / v8: rows charged to nobody are league-fired; the clock gives the slot."""
    rows = _roles(spine, action, s)
    sr, period = F.col(s.remaining), F.col(s.period)
    fired = F.coalesce(F.col(s.person) == 0, F.lit(False))
    if near_mark:
        marks = triggers_for(period, SLOTS_BEFORE_2017)
        slot = F.lit(None).cast("int")
        for k in (1, 2, 3):
            mark = F.try_element_at(marks, F.lit(k))
            slot = F.when((sr <= mark) & (sr >= mark - below), F.lit(k)).otherwise(slot)
    else:
        slot = (
            F.when(period.isin(2, 4), F.when(sr > 360, 1).when(sr > 180, 2).otherwise(3))
            .when(period.isin(1, 3), F.when(sr > 180, 1).otherwise(2))
            .otherwise(1)
        )
    role = F.when(fired & slot.isNotNull(), F.concat(F.lit("slot_"), slot, F.lit("_mandatory"))).otherwise(_base_role())
    return rows.select(s.entity, s.period, s.order, s.season, role.alias("timeout_role"))


VARIANTS = {
    **{name: (lambda df, c=claim: slot_claim(df, c)) for name, claim in SLOT_CLAIMS.items()},
    "v4": nearest_trigger,
    "v6": stateful_rule,
    "v7": lambda df: structural_rule(df, near_mark=False),
    "v8": lambda df: structural_rule(df, near_mark=True),
}


# --- counters and durations ---------------------------------------------------


def cumulative_by_scope(spine: DataFrame, home: DataFrame, s: Spine = SPINE) -> DataFrame:
    """Running count of full interventions in (entity, period): all, home, away."""
    rows = join_null_safe(spine, home, [s.entity], "left")
    full = (F.lower(s.action) == "timeout") & ~F.coalesce(F.col(s.sub).isin(*CHALLENGES), F.lit(False))
    at_home = F.coalesce(F.col(s.team) == F.col("home_teamId"), F.lit(False))
    at_away = F.coalesce(F.col(s.team) != F.col("home_teamId"), F.lit(False))
    one = lambda c: c.cast("long")
    return scan(
        rows,
        [s.entity, s.period],
        [s.order],
        s.order_block(),
        [Sum("cum_all", one(full)), Sum("cum_home", one(full & at_home)), Sum("cum_away", one(full & at_away))],
    )


def next_same_kind(spine: DataFrame, s: Spine = SPINE) -> DataFrame:
    """Seconds from each intervention to the next one of the entity."""
    rows = spine.where(F.col(s.action) == "timeout").select(s.entity, s.order, s.wall)
    rows = scan(rows, [s.entity], [s.order], s.order_block(), [Lag("_next", F.col(s.wall), reverse=True)])
    gap = (F.unix_micros("_next") - F.unix_micros(s.wall)) / 1e6
    return rows.select(s.entity, s.order, gap.alias("next_delta_s"))
