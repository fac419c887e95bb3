"""Comparisons of event groups: sweeps, slices, matched pairs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eddyline.config import SPINE, Spine
from eddyline.functions import columns as C
from eddyline.functions import distributions as D
from eddyline.operators import joins, matching
from eddyline.plans import impact, state, stats

GROUPS = {"endo": "endogenous", "exo": "exogenous", "ctrl": "control"}
SUBTYPES = ["tv_mandatory", "stoppage", "coach_absorb", "coach_discretionary", "mistagged_discretionary", "coach_challenge"]

# Parameter grids of the published sweeps.
RUN_SIZES, HORIZONS = (5, 6, 8, 10), (1.0, 2.0, 3.0, 5.0)
HORIZON_SWEEP = (0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0)
RUN_SWEEP = (4, 5, 6, 7, 8, 10, 12, 15)


def compare_groups(df: DataFrame, by: Sequence[str], value: str = "recovery") -> DataFrame:
    """n and mean of each group side by side, differences to control, Welch t."""
    aggs = []
    for short, name in GROUPS.items():
        x = F.when(F.col("group") == name, F.col(value))
        aggs += [F.count(x).alias(f"{short}_n"), F.avg(x).alias(f"{short}_mean"), F.var_samp(x).alias(f"_{short}_v")]
    out = df.groupBy(*by).agg(*aggs)
    for short in ("endo", "exo"):
        ok = (F.col(f"{short}_n") >= 2) & (F.col("ctrl_n") >= 2)
        se = F.sqrt(F.col(f"_{short}_v") / F.col(f"{short}_n") + F.col("_ctrl_v") / F.col("ctrl_n"))
        delta = F.col(f"{short}_mean") - F.col("ctrl_mean")
        out = out.withColumn(f"{short}_delta", F.when(ok, delta))
        out = out.withColumn(f"{short}_t", F.when(ok, delta / F.nullif(se, F.lit(0.0))))
    return out


def with_p_values(table: DataFrame) -> DataFrame:
    """p and stars for the comparison table; drops the variances it needed."""
    for short in ("endo", "exo"):
        one_less = lambda n: F.nullif(F.col(n) - 1, F.lit(0))
        a, b = F.col(f"_{short}_v") / F.col(f"{short}_n"), F.col("_ctrl_v") / F.col("ctrl_n")
        df = F.pow(a + b, 2) / F.nullif(F.pow(a, 2) / one_less(f"{short}_n") + F.pow(b, 2) / one_less("ctrl_n"), F.lit(0.0))
        table = table.withColumn(f"{short}_p", D.p_t(F.col(f"{short}_t"), df))
        table = table.withColumn(f"{short}_sig", D.sig_label(F.col(f"{short}_p")))
    return table.drop("_endo_v", "_exo_v", "_ctrl_v")


def without_variances(table: DataFrame) -> DataFrame:
    return table.drop("_endo_v", "_exo_v", "_ctrl_v")


def multi_sweep(
    enriched: DataFrame,
    run_sizes: Sequence[int] = RUN_SIZES,
    minutes: Sequence[float] = HORIZONS,
    filters: Mapping[str, Column] | None = None,
    value: str = "recovery",
    s: Spine = SPINE,
) -> DataFrame:
    """Group means over run size × horizon (× situation filter), as one job."""
    rows = impact.run_impact(enriched, run_sizes, minutes, s=s)
    by = ["run_size", "minutes"]
    if filters:
        hits = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in filters.items()]))
        rows = rows.withColumn("situation", F.explode(hits))
        by.append("situation")
    return compare_groups(rows, by, value)


def margin_situations(margins: Sequence[int | None], side: str) -> dict[str, Column]:
    ahead = F.col("suffering_margin") > 0 if side == "ahead" else F.col("suffering_margin") < 0
    return {
        f"{side}, any margin" if m is None else f"{side}, |m|<={m}": ahead if m is None else ahead & (F.abs("suffering_margin") <= m)
        for m in margins
    }


def running_team_effect(enriched: DataFrame, s: Spine = SPINE) -> DataFrame:
    """Points of the running side per group, and exogenous against control in %."""
    table = multi_sweep(enriched, (6, 10), (1.0, 2.0, 3.0), value="running_team_pts", s=s)
    table = table.where((F.col("run_size") == 6) | (F.col("minutes") == 3.0))
    return table.withColumn("exo_vs_ctrl_pct", (F.try_divide("exo_mean", "ctrl_mean") - 1) * 100)


def within_entity_control(rows: DataFrame, s: Spine = SPINE) -> DataFrame:
    """Each event against the mean control of its own entity."""
    means = rows.where(F.col("group") == "control").groupBy(s.entity).agg(F.avg("recovery").alias("_ctl"))
    events = rows.where(F.col("group").isin("endogenous", "exogenous")).join(means, s.entity)
    return stats.one_sample(events.withColumn("x", F.col("recovery") - F.col("_ctl")), ["group"], "x")


def twins(rows: DataFrame, rule: matching.TwinRule = matching.STANDARD, s: Spine = SPINE) -> DataFrame:
    """Matched pairs with their difference in recovery."""
    treated, controls = rows.where(F.col("group") != "control"), rows.where(F.col("group") == "control")
    pairs = matching.matched_twins(treated, controls, rule, "recovery", s)
    return pairs.withColumn("pair_diff", F.col("recovery") - F.col("c_recovery"))


def pair_summary(pairs: DataFrame, by: str, min_n: int = 30) -> DataFrame:
    """Paired t of the difference, with both means."""
    means = pairs.groupBy(by).agg(F.avg("recovery").alias("treated_mean"), F.avg("c_recovery").alias("ctrl_mean"))
    return stats.one_sample(pairs, [by], "pair_diff", min_n).join(means, by)


def pair_forest(pairs: DataFrame, min_n: int = 5) -> DataFrame:
    """Mean difference with its 95% band for every subtype and coarse group."""
    labels = F.array(F.col("group"), F.col("subtype_fine"))
    rows = pairs.withColumn("label", F.explode(F.array_distinct(labels)))
    out = stats.one_sample(rows, ["label"], "pair_diff", min_n)
    return out.withColumn("half_width", 1.96 * F.col("std") / F.sqrt("n"))


def estimator_contrast(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The between-group difference next to the matched difference."""
    table = compare_groups(rows.withColumn("_all", F.lit(1)), ["_all"])
    between = table.select(F.expr("stack(2, 'endogenous', endo_delta, 'exogenous', exo_delta) as (group, delta)"))
    matched = pairs.where(F.col("group").isin("endogenous", "exogenous")).groupBy("group").agg(F.avg("pair_diff").alias("delta"))
    return between.withColumn("estimator", F.lit("between")).unionByName(matched.withColumn("estimator", F.lit("matched")))


def subtype_effects(rows: DataFrame) -> DataFrame:
    """Each subtype against the control rows."""
    x = F.col("recovery")
    control = rows.where(F.col("group") == "control")
    others = rows.where(F.col("subtype_fine").isin(SUBTYPES)).withColumn("sample", F.lit("a"))
    names = F.explode(F.array(*[F.lit(n) for n in SUBTYPES]))
    # control moments are one row; they are repeated per subtype, not the rows
    base = control.agg(F.count(x).alias("n_b"), F.avg(x).alias("mean_b"), F.var_samp(x).alias("var_b"))
    base = base.withColumn("subtype_fine", names)
    mine = others.groupBy("subtype_fine").agg(
        F.count(x).alias("n_a"), F.avg(x).alias("mean_a"), F.var_samp(x).alias("var_a"), F.stddev_pop(x).alias("std_pop")
    )
    return stats.welch(mine.join(base, "subtype_fine"))


# --- slices -------------------------------------------------------------------


def _ranges(value: Column, edges: Sequence[tuple[str, float | None, float | None]]) -> Column:
    """Label of the half-open range [lo, hi) that holds the value."""
    chain = None
    for label, lo, hi in edges:
        cond = value.isNotNull()
        if lo is not None:
            cond = cond & (value >= lo)
        if hi is not None:
            cond = cond & (value < hi)
        chain = F.when(cond, F.lit(label)) if chain is None else chain.when(cond, F.lit(label))
    return chain


# The published slices.
PHASES = [
    ("Q1 early", 0, 360), ("Q1 late", 360, 720), ("Q2 early", 720, 1080), ("Q2 late", 1080, 1440),
    ("Q3 early", 1440, 1800), ("Q3 late", 1800, 2160), ("Q4 early", 2160, 2520), ("Q4 late", 2520, 2880),
]
GAPS = [("much worse", None, -5), ("worse", -5, -1), ("even", -1, 1), ("better", 1, 5), ("much better", 5, None)]
STRENGTH = [("weak", None, -2), ("average", -2, 2), ("strong", 2, None)]
SUBS = [("0 subs", 0, 1), ("1-2 subs", 1, 3), ("3+ subs", 3, None)]
RATES = [("< 1.00", 0.0, 1.0), ("1.00-1.15", 1.0, 1.15), ("1.15-1.30", 1.15, 1.30), (">= 1.30", 1.30, None)]


def slice_table(rows: DataFrame, label: Column, value: str = "recovery") -> DataFrame:
    rows = rows.withColumn("slice", label).where("slice is not null")
    return compare_groups(rows, ["slice"], value)


def by_period(rows: DataFrame, s: Spine = SPINE) -> DataFrame:
    return slice_table(rows, F.when(F.col(s.period) <= 4, F.concat(F.lit("Q"), F.col(s.period).cast("int"))))


def by_season_type(rows: DataFrame, s: Spine = SPINE) -> DataFrame:
    return slice_table(rows, F.col(s.season_type))


def by_phase(rows: DataFrame, s: Spine = SPINE) -> DataFrame:
    return slice_table(rows, _ranges(F.col(s.clock), PHASES))


def by_clutch(rows: DataFrame) -> DataFrame:
    return slice_table(rows, F.when(F.col("clutch"), F.lit("clutch")).otherwise(F.lit("non-clutch")))


def with_team_quality(rows: DataFrame, players: DataFrame, s: Spine = SPINE) -> DataFrame:
    """Season rating of the suffering team and its gap to the opponent."""
    rating = state.team_net_rating(players)
    home = rating.select(F.col("teamId").alias("home_teamId"), F.col("season").alias(s.season), F.col("team_net_rating").alias("home_net"))
    away = rating.select(F.col("teamId").alias("away_teamId"), F.col("season").alias(s.season), F.col("team_net_rating").alias("away_net"))
    out = rows.join(home, ["home_teamId", s.season], "left").join(away, ["away_teamId", s.season], "left")
    at_home = F.col("suffering_location") == "home"
    gap = F.col("home_net") - F.col("away_net")
    return out.withColumn("suffering_team_net", F.when(at_home, F.col("home_net")).otherwise(F.col("away_net"))).withColumn(
        "suffering_vs_opp_net", C.signed_for(gap, at_home)
    )


def by_quality_gap(rows: DataFrame, players: DataFrame, s: Spine = SPINE) -> DataFrame:
    return slice_table(with_team_quality(rows, players, s), _ranges(F.col("suffering_vs_opp_net"), GAPS))


def by_strength(rows: DataFrame, players: DataFrame, s: Spine = SPINE) -> DataFrame:
    return slice_table(with_team_quality(rows, players, s), _ranges(F.col("suffering_team_net"), STRENGTH))


def with_sub_count(rows: DataFrame, spine: DataFrame, s: Spine = SPINE) -> DataFrame:
    subs = spine.where(F.col(s.action) == "substitution")
    return joins.count_within(rows, subs, [s.entity], s.clock, 30, "subs_30s")


def by_sub_count(rows: DataFrame, spine: DataFrame, s: Spine = SPINE) -> DataFrame:
    return slice_table(with_sub_count(rows, spine, s), _ranges(F.col("subs_30s"), SUBS))


def with_running_ppp(rows: DataFrame, poss: DataFrame, s: Spine = SPINE) -> DataFrame:
    rate = state.running_ppp(poss, s).select(
        s.entity, s.possession, "possession_id", F.col("team_cum_ppp").alias("running_team_ppp")
    )
    return rows.join(rate, [s.entity, s.possession, "possession_id"], "left")


def by_running_ppp(rows: DataFrame, poss: DataFrame, s: Spine = SPINE) -> DataFrame:
    return slice_table(with_running_ppp(rows, poss, s), _ranges(F.col("running_team_ppp"), RATES))


def moderator_matrix(rows: DataFrame, spine: DataFrame, poss: DataFrame, players: DataFrame, s: Spine = SPINE) -> DataFrame:
    """Differences to control in 12 strata, each row stacked once per stratum it meets."""
    rows = with_running_ppp(with_team_quality(with_sub_count(rows, spine, s), players, s), poss, s)
    subs, gap, clock, ppp = F.col("subs_30s"), F.col("suffering_vs_opp_net"), F.col(s.clock), F.col("running_team_ppp")
    strata = {
        "0 subs": subs == 0,
        "1-2 subs": subs.between(1, 2),
        "3+ subs": subs >= 3,
        "gap <= -5": gap <= -5,
        "|gap| < 1": F.abs(gap) < 1,
        "gap >= 5": gap >= 5,
        "Q1": clock < 720,
        "Q2": (clock >= 720) & (clock < 1440),
        "Q3": (clock >= 1440) & (clock < 2160),
        "Q4": clock >= 2160,
        "ppp < 1.00": ppp < 1.00,
        "ppp >= 1.30": ppp >= 1.30,
    }
    hits = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in strata.items()]))
    return compare_groups(rows.withColumn("stratum", F.explode(hits)), ["stratum"])


# --- outcomes of reviewed calls -----------------------------------------------


def challenge_rows(rows: DataFrame, outcomes: DataFrame, s: Spine = SPINE) -> DataFrame:
    """Challenge events with the nearest recorded outcome within 60 seconds."""
    calls = rows.where(F.col("subtype_fine") == "coach_challenge")
    return joins.nearest_outcome(calls, outcomes, [s.entity, s.period], s.clock, ["descriptor"], s.order, 60, s.clock_span)


def challenge_twins(rows: DataFrame, outcomes: DataFrame, s: Spine = SPINE) -> DataFrame:
    """Matched pairs of challenges, by outcome and pooled."""
    known = challenge_rows(rows, outcomes, s).where("descriptor is not null")
    controls = rows.where(F.col("group") == "control")
    pairs = matching.matched_twins(known, controls, matching.STANDARD, "recovery", s)
    verdict = F.when(F.col("descriptor") == "overturned", F.lit("overturned")).otherwise(F.lit("failed"))
    pairs = pairs.withColumn("pair_diff", F.col("recovery") - F.col("c_recovery"))
    return pairs.withColumn("outcome", F.explode(F.array(verdict, F.lit("pooled"))))


def challenge_lead_change(spine: DataFrame, outcomes: DataFrame, home: DataFrame, minutes: float = 3.0, s: Spine = SPINE) -> DataFrame:
    """Every reviewed call: change of lead afterwards, signed to the calling team."""
    rows = impact.forward_scores(outcomes, spine, [minutes], s).where(F.col(s.team).isNotNull())
    rows = rows.join(home, s.entity, "left")
    signed = F.when(F.col(s.team) == F.col("home_teamId"), F.col("lead_change")).otherwise(-F.col("lead_change"))
    verdict = F.when(F.col("descriptor") == "overturned", F.lit("overturned")).otherwise(F.lit("failed"))
    return rows.withColumn("calling_lead_change", signed).withColumn("outcome", verdict)


def recovery_summary(rows: DataFrame) -> DataFrame:
    """n, mean and 95% band (population deviation) of the three groups."""
    x = F.col("recovery")
    out = rows.where(F.col("group").isin(*GROUPS.values())).groupBy("group").agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), (1.96 * F.stddev_pop(x) / F.sqrt(F.count(x))).alias("half_width")
    )
    return out


def recovery_grid(rows: DataFrame) -> DataFrame:
    """The comparison for home/away × ahead/behind."""
    margin = F.col("suffering_margin")
    side = F.when(margin > 0, F.lit("ahead")).when(margin < 0, F.lit("behind"))
    rows = rows.withColumn("location", F.col("suffering_location")).withColumn("situation", side)
    return compare_groups(rows.where("situation is not null"), ["location", "situation"])
