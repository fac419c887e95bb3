"""Registered queries: streaks, classifiers, run impact, windows, experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from eddyline.catalog.common import longs, r6, rounded
from eddyline.catalog.oracle_parts import analysis, cause_case, oracle
from eddyline.catalog.oracle_parts import r6 as R
from eddyline.functions import predicates as P
from eddyline.operators import aggregates as A
from eddyline.operators import joins, matching
from eddyline.plans import classify, experiments, impact, state, stats, windows
from eddyline.sources import adapter

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
KEY = "gameId, orderNumber"
key = ["gameId", "orderNumber"]


def register(name: str, sql: str | None = None, extra: dict[str, str] | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = oracle(sql, extra)
        return fn

    return keep


# --- C1, C2, ETL ------------------------------------------------------------------


@register("streak", f"SELECT {KEY}, streak FROM st")
def _(t):
    return state.with_streak(t.spine).select(*key, "streak")


@register("possession_id", f"SELECT {KEY}, possession_id FROM st1 WHERE possession_id IS NOT NULL")
def _(t):
    return state.with_possession_id(t.spine).where("possession_id is not null").select(*key, "possession_id")


ENRICHED = ["streak", "possession_id", "possession_points", "score_margin", "prev_action_type", "home_teamId", "away_teamId", "timeout_role", "timeout_cause"]


@register("enrich", f"SELECT {KEY}, {', '.join(ENRICHED)} FROM en")
def _(t):
    return state.enrich(t.spine, t.labels, t.sides).select(*key, *ENRICHED)


# --- C3, C4 -------------------------------------------------------------------------


@register("classify_events", f"SELECT {KEY}, timeout_role, timeout_cause FROM lab")
def _(t):
    return classify.classify_events(t.spine, state.home_team(t.spine))


@register("classify_role", f"SELECT {KEY}, timeout_role FROM lab")
def _(t):
    return classify.classify_events(t.spine, state.home_team(t.spine)).select(*key, "timeout_role")


@register("classify_cause", f"SELECT {KEY}, timeout_cause FROM lab")
def _(t):
    return classify.classify_events(t.spine, state.home_team(t.spine)).select(*key, "timeout_cause")


_SWEEP = " UNION ALL ".join(
    f"SELECT {b} AS buffer, timeout_cause, count(*) AS n FROM (SELECT {cause_case(str(b))} AS timeout_cause FROM tos) q GROUP BY timeout_cause"
    for b in (30, 60, 120, 180, 240, 300, 600, 1200)
)


@register("classify_buffer_sweep", f"SELECT buffer::BIGINT AS buffer, timeout_cause, n FROM ({_SWEEP}) z")
def _(t):
    return longs(classify.buffer_sweep(t.spine, state.home_team(t.spine)), ["buffer"])


@register("slot_owner_default", f"""SELECT timeout_cause, (e.seconds_remaining // 180) * 180 AS bin, count(*) AS n,
{R('avg(CASE WHEN rk = 1 THEN (e.teamId = e.home_teamId)::INT WHEN rk = 2 THEN (e.teamId <> e.home_teamId)::INT END)', 'conformance')}
FROM en e JOIN tos t ON t.gameId = e.gameId AND t.orderNumber = e.orderNumber WHERE fl AND NOT ch AND rk <= 2 GROUP BY 1, 2""")
def _(t):
    rows = classify.prepare_interventions(t.spine, state.home_team(t.spine))
    rows = classify.role_and_cause(rows, F.lit(classify.ABSORB_BUFFER))
    home = F.col("teamId") == F.col("home_teamId")
    conforms = F.when(F.col("_rank") == 1, home).otherwise(~home)
    rows = rows.where(F.col("_flag") & ~F.col("_challenge") & (F.col("_rank") <= 2))
    bins = F.floor(F.col("seconds_remaining") / 180) * 180
    return rows.groupBy("timeout_cause", bins.alias("bin")).agg(
        F.count("*").alias("n"), r6(F.avg(conforms.cast("int")), "conformance")
    )


BASE_ROLE = "CASE WHEN ch THEN 'challenge' ELSE 'discretionary' END"


def claim_parts(before: str, after: str, reach: int | None) -> dict[str, str]:
    """Slot claim in SQL: one pick per slot, in order, excluding earlier picks."""
    parts = {"cl0": f"SELECT *, CASE WHEN early THEN {before} ELSE {after} END AS marks FROM oldto"}
    taken, blocked = "FALSE", "FALSE"
    previous = "cl0"
    for k in (1, 2, 3):
        if reach is not None:
            upper = f"marks[{k}] + {reach}"
        else:
            upper = "720" if k == 1 else f"marks[{k - 1}]"
        ok = f"NOT ch AND marks[{k}] IS NOT NULL AND seconds_remaining > marks[{k}] - 90 AND seconds_remaining <= {upper} AND NOT ({taken}) AND NOT ({blocked})"
        parts[f"cl{k}"] = f"""
SELECT *, min(CASE WHEN {ok} THEN orderNumber END) OVER (PARTITION BY gameId, period) AS o{k},
  coalesce(arg_min(seconds_remaining <= marks[{k}], orderNumber) FILTER (WHERE {ok}) OVER (PARTITION BY gameId, period), FALSE) AS m{k} FROM {previous}"""
        taken += f" OR coalesce(orderNumber = o{k}, FALSE)"
        blocked += f" OR (early AND m{k})"
        previous = f"cl{k}"
    return parts


LATE = "CASE WHEN period IN (2, 4) THEN [540, 360, 180] END"
FULL = "CASE WHEN period IN (2, 4) THEN [540, 360, 180] WHEN period IN (1, 3) THEN [360, 180] ELSE [180] END"
POST = "CASE WHEN period <= 4 THEN [420, 180] END"
CLAIM_SQL = f"""SELECT gameId, orderNumber, CASE WHEN orderNumber = o1 THEN 'slot_1_' || CASE WHEN m1 THEN 'mandatory' ELSE 'absorbed' END
WHEN orderNumber = o2 THEN 'slot_2_' || CASE WHEN m2 THEN 'mandatory' ELSE 'absorbed' END
WHEN orderNumber = o3 THEN 'slot_3_' || CASE WHEN m3 THEN 'mandatory' ELSE 'absorbed' END ELSE {BASE_ROLE} END AS timeout_role FROM cl3"""


def _claim(version: str, before: str, reach: int | None):
    @register(f"classify_slot_claim_{version}", CLAIM_SQL, claim_parts(before, POST, reach))
    def query(t):
        rows = classify.slot_claim(adapter.as_older_feed(t.spine), classify.SLOT_CLAIMS[version], "Timeout")
        return rows.select(*key, "timeout_role")


_claim("v1", LATE, None)
_claim("v2", LATE, 30)
_claim("v3", LATE, 0)
_claim("v5", FULL, None)


@register("classify_nearest_trigger", f"""SELECT o.gameId, o.orderNumber, CASE WHEN b.orderNumber IS NOT NULL THEN 'slot_' || b.slot || '_mandatory' ELSE {BASE_ROLE} END AS timeout_role
FROM oldto o LEFT JOIN (SELECT gameId, orderNumber, slot FROM (
SELECT gameId, period, orderNumber, s.slot, marks[s.slot] - seconds_remaining AS dist FROM (SELECT *, CASE WHEN early THEN {LATE} ELSE {POST} END AS marks FROM oldto WHERE NOT ch) q, (SELECT unnest([1, 2, 3]) AS slot) s
WHERE marks[s.slot] - seconds_remaining BETWEEN 0 AND 90) r QUALIFY row_number() OVER (PARTITION BY gameId, period ORDER BY dist, orderNumber, slot) = 1) b USING (gameId, orderNumber)""")
def _(t):
    return classify.nearest_trigger(adapter.as_older_feed(t.spine), "Timeout").select(*key, "timeout_role")


@register("classify_stateful", f"""SELECT gameId, orderNumber, CASE WHEN NOT ch AND marks[n] IS NOT NULL THEN 'slot_' || n || CASE WHEN seconds_remaining > marks[n] THEN '_absorbed' ELSE '_mandatory' END ELSE {BASE_ROLE} END AS timeout_role
FROM (SELECT *, CASE WHEN early THEN {FULL} ELSE {POST} END AS marks, CAST(sum((NOT ch)::INT) OVER (PARTITION BY gameId, period ORDER BY orderNumber ROWS UNBOUNDED PRECEDING) AS BIGINT) AS n FROM oldto) q""")
def _(t):
    return classify.stateful_rule(adapter.as_older_feed(t.spine), "Timeout").select(*key, "timeout_role")


@register("classify_structural_v7", f"""SELECT gameId, orderNumber, CASE WHEN personId = 0 THEN 'slot_' || CASE WHEN period IN (2, 4) THEN CASE WHEN seconds_remaining > 360 THEN 1 WHEN seconds_remaining > 180 THEN 2 ELSE 3 END
ELSE CASE WHEN seconds_remaining > 180 THEN 1 ELSE 2 END END || '_mandatory' ELSE {BASE_ROLE} END AS timeout_role FROM oldto""")
def _(t):
    return classify.structural_rule(adapter.as_older_feed(t.spine), False, "Timeout").select(*key, "timeout_role")


@register("classify_structural_v8", f"""SELECT gameId, orderNumber, CASE WHEN personId = 0 AND s > 0 THEN 'slot_' || s || '_mandatory' ELSE {BASE_ROLE} END AS timeout_role FROM (
SELECT *, CASE WHEN period IN (2, 4) THEN CASE WHEN seconds_remaining BETWEEN 450 AND 540 THEN 1 WHEN seconds_remaining BETWEEN 270 AND 360 THEN 2 WHEN seconds_remaining BETWEEN 90 AND 180 THEN 3 ELSE 0 END
ELSE CASE WHEN seconds_remaining BETWEEN 270 AND 360 THEN 1 WHEN seconds_remaining BETWEEN 90 AND 180 THEN 2 ELSE 0 END END AS s FROM oldto) q""")
def _(t):
    return classify.structural_rule(adapter.as_older_feed(t.spine), True, "Timeout").select(*key, "timeout_role")


OLD_RULE = {
    "oc0": "SELECT *, personId = 0 AS fl, CAST(sum((personId = 0)::INT) OVER (PARTITION BY gameId, period ORDER BY orderNumber ROWS UNBOUNDED PRECEDING) AS BIGINT) AS rk FROM oldto",
    "oc": f"SELECT *, CASE WHEN ch THEN 'challenge' WHEN fl THEN 'slot_' || least(rk, len({FULL})) || '_mandatory' ELSE 'discretionary' END AS timeout_role FROM oc0",
}


@register("classify_older_feed", f"SELECT {KEY}, timeout_role FROM oc", OLD_RULE)
def _(t):
    return classify.classify_events(adapter.as_older_feed(t.spine), None, classify.OLDER_FEED).select(*key, "timeout_role")


@register("confusion_scores", f"""SELECT CASE WHEN gs = 0 THEN 'season' WHEN gp = 0 THEN 'period' ELSE 'overall' END AS scope, season, period, tp, fp, fn,
{R('tp / greatest(tp + fp, 1)', 'precision')}, {R('tp / greatest(tp + fn, 1)', 'recall')},
{R('2 * (tp / greatest(tp + fp, 1)) * (tp / greatest(tp + fn, 1)) / greatest(tp / greatest(tp + fp, 1) + tp / greatest(tp + fn, 1), 1e-9)', 'f1')}
FROM (SELECT season, period, grouping(season) AS gs, grouping(period) AS gp, count(*) FILTER (WHERE gt AND pr) AS tp, count(*) FILTER (WHERE NOT gt AND pr) AS fp, count(*) FILTER (WHERE gt AND NOT pr) AS fn
FROM (SELECT season, period, contains(subType, 'Official') AS gt, contains(timeout_role, '_mandatory') AS pr FROM oc) a GROUP BY GROUPING SETS ((), (season), (period))) b""", OLD_RULE)
def _(t):
    old = adapter.as_older_feed(t.spine)
    rows = old.where("actionType = 'Timeout'").join(classify.classify_events(old, None, classify.OLDER_FEED), key)
    out = A.confusion_scores(rows, P.label_contains("subType", "Official"), P.label_contains("timeout_role", "_mandatory"))
    return rounded(out, ["precision", "recall", "f1"])


@register("cause_diff", "SELECT coalesce(a, 'All') AS old_cause, coalesce(b, 'All') AS new_cause, count(*) AS n FROM (SELECT " + cause_case("80") + " AS a, " + cause_case("300") + " AS b FROM tos) q GROUP BY CUBE (a, b)")
def _(t):
    rows = classify.prepare_interventions(t.spine, state.home_team(t.spine))
    old = classify.role_and_cause(rows, F.lit(80)).select(*key, F.col("timeout_cause").alias("old_cause"))
    new = classify.role_and_cause(rows, F.lit(300)).select(*key, F.col("timeout_cause").alias("new_cause"))
    table = old.join(new, key).cube("old_cause", "new_cause").agg(F.count("*").alias("n"))
    return table.select(*[F.coalesce(c, F.lit("All")).alias(c) for c in ("old_cause", "new_cause")], "n")


# --- C5 to C7 -------------------------------------------------------------------------


def _lead_change(minutes, seconds):
    @register(f"lead_change_n_{seconds}s", f"SELECT s.gameId, s.orderNumber, (n.h - n.a) - (scoreHome - scoreAway) AS lead_change FROM spine s JOIN near{seconds} n ON s.gameId = n.gameId AND s.game_seconds_elapsed = n.g")
    def query(t):
        return impact.forward_scores(t.spine, t.spine, [minutes]).select(*key, "lead_change")


_lead_change(3.0, 180)
_lead_change(0.5, 30)

IMPACT = ["recovery", "running_team_pts", "streak", "suffering_location", "suffering_margin"]


@register("run_impact", f"SELECT {KEY}, grp AS \"group\", recovery::BIGINT AS recovery, running_team_pts, streak, suffering_location, suffering_margin::BIGINT AS suffering_margin FROM ana")
def _(t):
    return impact.run_impact(t.enriched).select(*key, "group", *IMPACT)


@register("rich_analysis", f"SELECT {KEY}, grp AS \"group\", subtype_fine, clutch, recovery::BIGINT AS recovery FROM rich")
def _(t):
    return impact.run_impact(t.enriched, challenge_apart=True).select(*key, "group", "subtype_fine", "clutch", "recovery")


@register("slice_filters", f"SELECT {KEY} FROM ana WHERE suffering_location = 'home' AND suffering_margin < 0 AND abs(suffering_margin) <= 15 AND period = 2 AND season_type = 'rg'")
def _(t):
    return impact.slice_filters(t.impact, "home", "behind", 15, 2, "rg").select(*key)


def compare_sql(by: str, source: str, value: str = "recovery") -> str:
    def agg(g, fn):
        return f"{fn}({value}) FILTER (WHERE grp = '{g}')"

    cols = []
    for s, g in (("endo", "endogenous"), ("exo", "exogenous"), ("ctrl", "control")):
        cols += [f"{agg(g, 'count')} AS {s}_n", f"{agg(g, 'avg')} AS {s}_m", f"{agg(g, 'var_samp')} AS {s}_v"]
    inner = f"SELECT {by}, {', '.join(cols)} FROM {source} GROUP BY ALL"
    names = ", ".join(b.split(" AS ")[-1].strip() for b in by.split(", "))
    outer = [names, "endo_n", "exo_n", "ctrl_n", R("endo_m", "endo_mean"), R("exo_m", "exo_mean"), R("ctrl_m", "ctrl_mean")]
    for s in ("endo", "exo"):
        ok = f"{s}_n >= 2 AND ctrl_n >= 2"
        outer.append(R(f"CASE WHEN {ok} THEN {s}_m - ctrl_m END", f"{s}_delta"))
        outer.append(R(f"CASE WHEN {ok} THEN ({s}_m - ctrl_m) / nullif(sqrt({s}_v / {s}_n + ctrl_v / ctrl_n), 0) END", f"{s}_t"))
    return f"SELECT {', '.join(outer)} FROM ({inner}) cmp"


def compared(df):
    cols = [f"{s}_{c}" for s in ("endo", "exo") for c in ("mean", "delta", "t")] + ["ctrl_mean"]
    return rounded(experiments.without_variances(df), cols)


def sweep_parts(runs, seconds) -> dict[str, str]:
    parts = {}
    for r in runs:
        for s in seconds:
            parts.update(analysis(f"an_{r}_{s}", r, s, False))
    names = [f"an_{r}_{s}" for r in runs for s in seconds]
    cols = "run_size, minutes, grp, recovery, running_team_pts, suffering_margin"
    parts["sweep"] = " UNION ALL ".join(f"SELECT {cols} FROM {n}" for n in names)
    return parts


E1, E2, E3 = sweep_parts((5, 6, 8, 10), (60, 120, 180, 300)), sweep_parts((6,), (30, 60, 90, 120, 150, 180, 240, 300)), sweep_parts((4, 5, 6, 7, 8, 10, 12, 15), (180,))
BY_RUN = "run_size::BIGINT AS run_size, minutes::DOUBLE AS minutes"


@register("multi_sweep", compare_sql(BY_RUN, "sweep"), E1)
def _(t):
    return longs(compared(experiments.multi_sweep(t.enriched)), ["run_size"])


@register("multi_sweep_horizon", compare_sql(BY_RUN, "sweep"), E2)
def _(t):
    return longs(compared(experiments.multi_sweep(t.enriched, (6,), experiments.HORIZON_SWEEP)), ["run_size"])


@register("multi_sweep_run_size", compare_sql(BY_RUN, "sweep"), E3)
def _(t):
    return longs(compared(experiments.multi_sweep(t.enriched, experiments.RUN_SWEEP, (3.0,))), ["run_size"])


E7 = sweep_parts((8, 10), (120, 180))
E7["sit"] = "SELECT *, 'ahead, any margin' AS situation FROM sweep WHERE suffering_margin > 0" + "".join(
    f" UNION ALL SELECT *, 'ahead, |m|<={m}' FROM sweep WHERE suffering_margin > 0 AND abs(suffering_margin) <= {m}" for m in (5, 10, 15)
)


@register("multi_sweep_margin", compare_sql(BY_RUN + ", situation", "sit"), E7)
def _(t):
    filters = experiments.margin_situations([None, 5, 10, 15], "ahead")
    return longs(compared(experiments.multi_sweep(t.enriched, (8, 10), (2.0, 3.0), filters)), ["run_size"])


E6 = sweep_parts((6, 10), (60, 120, 180))


@register("running_team_effect", f"SELECT *, {R('(exo_mean / ctrl_mean - 1) * 100', 'exo_vs_ctrl_pct')} FROM ({compare_sql(BY_RUN, 'sweep', 'running_team_pts')}) z WHERE run_size = 6 OR minutes = 3.0", E6)
def _(t):
    table = experiments.running_team_effect(t.enriched)
    table = compared(table)
    pct = (F.try_divide("exo_mean", "ctrl_mean") - 1) * 100
    return longs(table.withColumn("exo_vs_ctrl_pct", r6(pct, "exo_vs_ctrl_pct")), ["run_size"])


ONE_T = f"count(*) AS n, {R('avg(x)', 'mean')}, {R('stddev_samp(x)', 'std')}, {R('avg(x) / nullif(stddev_samp(x) / sqrt(count(*)), 0)', 't_stat')}"


@register("within_entity_control", f"SELECT grp AS \"group\", {ONE_T} FROM (SELECT a.grp, a.recovery - c.m AS x FROM ana a JOIN (SELECT gameId, avg(recovery) AS m FROM ana WHERE grp = 'control' GROUP BY 1) c USING (gameId) WHERE grp <> 'control') q GROUP BY grp")
def _(t):
    return rounded(experiments.within_entity_control(t.impact), ["mean", "std", "t_stat"])


def _twins(name, part, rule, scale):
    @register(name, f"SELECT {KEY}, c_order, c_recovery::BIGINT AS c_recovery, (dist / {scale}.0)::DOUBLE AS dist FROM {part}")
    def query(t):
        pairs = experiments.twins(t.rich, rule)
        return pairs.select(*key, "c_order", "c_recovery", F.col("dist").cast("double").alias("dist"))


_twins("matched_twin", "twin", matching.STANDARD, 30)
_twins("matched_twin_doughnut", "twin_dough", matching.DOUGHNUT, 60)
_twins("matched_twin_other_period", "twin_other", matching.OTHER_PERIOD, 30)


@register("matched_twin_summary", f"SELECT grp AS \"group\", {ONE_T}, {R('avg(recovery)', 'treated_mean')}, {R('avg(c_recovery)', 'ctrl_mean')} FROM (SELECT *, pair_diff AS x FROM twin) q GROUP BY grp HAVING count(*) >= 5")
def _(t):
    out = experiments.pair_summary(experiments.twins(t.rich), "group", 5)
    return rounded(out, ["mean", "std", "t_stat", "treated_mean", "ctrl_mean"])


@register("pair_forest", f"SELECT label, {ONE_T}, {R('1.96 * stddev_samp(x) / sqrt(count(*))', 'half_width')} FROM (SELECT grp AS label, pair_diff AS x FROM twin UNION ALL SELECT subtype_fine, pair_diff FROM twin) q GROUP BY label HAVING count(*) >= 5")
def _(t):
    return rounded(experiments.pair_forest(experiments.twins(t.rich)), ["mean", "std", "t_stat", "half_width"])


@register("estimator_contrast", f"""SELECT 'between' AS estimator, g AS "group", {R("avg(recovery) FILTER (WHERE grp = g) - avg(recovery) FILTER (WHERE grp = 'control')", 'delta')} FROM rich CROSS JOIN (SELECT unnest(['endogenous', 'exogenous']) AS g) z GROUP BY g
UNION ALL SELECT 'matched', grp, {R('avg(pair_diff)', 'delta')} FROM twin WHERE grp IN ('endogenous', 'exogenous') GROUP BY grp""")
def _(t):
    return rounded(experiments.estimator_contrast(t.rich, experiments.twins(t.rich)), ["delta"])


@register("subtype_effects", f"""SELECT subtype_fine, n_a, n_b, {R('ma', 'mean_a')}, {R('mb', 'mean_b')}, {R('sp', 'std_pop')}, {R('ma - mb', 'diff')}, {R('(ma - mb) / nullif(sqrt(va / n_a + vb / n_b), 0)', 't_stat')}
FROM (SELECT subtype_fine, count(*) AS n_a, avg(recovery) AS ma, var_samp(recovery) AS va, stddev_pop(recovery) AS sp FROM rich WHERE subtype_fine <> 'control' GROUP BY 1) a,
(SELECT count(*) AS n_b, avg(recovery) AS mb, var_samp(recovery) AS vb FROM rich WHERE grp = 'control') b WHERE n_a >= 2""")
def _(t):
    out = experiments.subtype_effects(t.rich).where("n_a >= 2")
    out = out.select("subtype_fine", "n_a", "n_b", "mean_a", "mean_b", "std_pop", "diff", "t_stat")
    return rounded(out, ["mean_a", "mean_b", "std_pop", "diff", "t_stat"])


# --- slices -------------------------------------------------------------------------------


def _slice(name, case, extra_from, build):
    src = f"(SELECT *, {case} AS slice FROM {extra_from}) sl WHERE slice IS NOT NULL"

    @register(f"slice_table_{name}", compare_sql("slice", src), _SLICE_PARTS)
    def query(t):
        return compared(build(t))


# The edges are written out here once more, so that a wrong one in the engine shows.
PHASE_SQL = """CASE WHEN game_seconds_elapsed < 360 THEN 'Q1 early' WHEN game_seconds_elapsed < 720 THEN 'Q1 late' WHEN game_seconds_elapsed < 1080 THEN 'Q2 early'
WHEN game_seconds_elapsed < 1440 THEN 'Q2 late' WHEN game_seconds_elapsed < 1800 THEN 'Q3 early' WHEN game_seconds_elapsed < 2160 THEN 'Q3 late'
WHEN game_seconds_elapsed < 2520 THEN 'Q4 early' WHEN game_seconds_elapsed < 2880 THEN 'Q4 late' END"""
GAP_SQL = "CASE WHEN gap < -5 THEN 'much worse' WHEN gap < -1 THEN 'worse' WHEN gap < 1 THEN 'even' WHEN gap < 5 THEN 'better' WHEN gap >= 5 THEN 'much better' END"
STRENGTH_SQL = "CASE WHEN s_net < -2 THEN 'weak' WHEN s_net < 2 THEN 'average' WHEN s_net >= 2 THEN 'strong' END"
SUBS_SQL = "CASE WHEN subs = 0 THEN '0 subs' WHEN subs BETWEEN 1 AND 2 THEN '1-2 subs' WHEN subs >= 3 THEN '3+ subs' END"
RATE_SQL = "CASE WHEN rate < 0 THEN NULL WHEN rate < 1.0 THEN '< 1.00' WHEN rate < 1.15 THEN '1.00-1.15' WHEN rate < 1.3 THEN '1.15-1.30' WHEN rate >= 1.3 THEN '>= 1.30' END"


_SLICE_PARTS = {
    "qual": """SELECT r.*, CASE WHEN suffering_location = 'home' THEN h.team_net_rating ELSE a.team_net_rating END AS s_net,
CASE WHEN suffering_location = 'home' THEN h.team_net_rating - a.team_net_rating ELSE a.team_net_rating - h.team_net_rating END AS gap
FROM rich r LEFT JOIN net h ON h.teamId = r.home_teamId AND h.season = r.season LEFT JOIN net a ON a.teamId = r.away_teamId AND a.season = r.season""",
    "subc": """SELECT r.*, (SELECT count(*) FROM spine b WHERE b.gameId = r.gameId AND b.actionType = 'substitution' AND abs(b.game_seconds_elapsed - r.game_seconds_elapsed) <= 30) AS subs FROM rich r""",
    "cppp": "SELECT gameId, possession_id, sum(possession_points) OVER w / count(*) OVER w AS rate FROM possn WINDOW w AS (PARTITION BY gameId, possession ORDER BY possession_id ROWS UNBOUNDED PRECEDING)",
    "prate": "SELECT r.*, rate FROM rich r LEFT JOIN cppp USING (gameId, possession_id)",
    "modr": """SELECT q.*, s.subs, p.rate FROM qual q JOIN (SELECT gameId, orderNumber, subs FROM subc) s USING (gameId, orderNumber) JOIN (SELECT gameId, orderNumber, rate FROM prate) p USING (gameId, orderNumber)""",
}

_slice("period", "CASE WHEN period <= 4 THEN 'Q' || period END", "rich", lambda t: experiments.by_period(t.rich))
_slice("season_type", "season_type", "rich", lambda t: experiments.by_season_type(t.rich))
_slice("phase", PHASE_SQL, "rich", lambda t: experiments.by_phase(t.rich))
_slice("clutch", "CASE WHEN clutch THEN 'clutch' ELSE 'non-clutch' END", "rich", lambda t: experiments.by_clutch(t.rich))
_slice("quality_gap", GAP_SQL, "qual", lambda t: experiments.by_quality_gap(t.rich, t.player_advanced))
_slice("strength", STRENGTH_SQL, "qual", lambda t: experiments.by_strength(t.rich, t.player_advanced))
_slice("sub_count", SUBS_SQL, "subc", lambda t: experiments.by_sub_count(t.rich, t.spine))
_slice("running_ppp", RATE_SQL, "prate", lambda t: experiments.by_running_ppp(t.rich, t.possessions))

STRATA = {
    "0 subs": "subs = 0", "1-2 subs": "subs BETWEEN 1 AND 2", "3+ subs": "subs >= 3", "gap <= -5": "gap <= -5", "|gap| < 1": "abs(gap) < 1",
    "gap >= 5": "gap >= 5", "Q1": "game_seconds_elapsed < 720", "Q2": "game_seconds_elapsed >= 720 AND game_seconds_elapsed < 1440",
    "Q3": "game_seconds_elapsed >= 1440 AND game_seconds_elapsed < 2160", "Q4": "game_seconds_elapsed >= 2160", "ppp < 1.00": "rate < 1.0", "ppp >= 1.30": "rate >= 1.3",
}
_MOD = " UNION ALL ".join(f"SELECT '{n}' AS stratum, grp, recovery FROM modr WHERE {c}" for n, c in STRATA.items())


@register("moderator_matrix", compare_sql("stratum", f"({_MOD}) m"), _SLICE_PARTS)
def _(t):
    return compared(experiments.moderator_matrix(t.rich, t.spine, t.possessions, t.player_advanced))


@register("moderator_matrix_p")
def _(t):
    return experiments.with_p_values(experiments.moderator_matrix(t.rich, t.spine, t.possessions, t.player_advanced))


# --- outcomes ---------------------------------------------------------------------------------

CHALLENGE = {
    "chr": """SELECT c.*, o.descriptor AS outcome_d FROM (SELECT * FROM rich WHERE subtype_fine = 'coach_challenge') c
JOIN (SELECT gameId, period, game_seconds_elapsed, orderNumber, descriptor FROM spine WHERE descriptor IS NOT NULL) o ON o.gameId = c.gameId AND o.period = c.period
AND abs(o.game_seconds_elapsed - c.game_seconds_elapsed) <= 60
QUALIFY row_number() OVER (PARTITION BY c.gameId, c.orderNumber ORDER BY abs(o.game_seconds_elapsed - c.game_seconds_elapsed), o.game_seconds_elapsed DESC, o.orderNumber DESC) = 1""",
    "chp": "SELECT t.pair_diff AS x, CASE WHEN outcome_d = 'overturned' THEN 'overturned' ELSE 'failed' END AS outcome FROM chr JOIN twin t USING (gameId, orderNumber)",
    "chl": """SELECT CASE WHEN s.teamId = home_teamId THEN 1 ELSE -1 END * ((n.h - n.a) - (scoreHome - scoreAway)) AS x,
CASE WHEN descriptor = 'overturned' THEN 'overturned' ELSE 'failed' END AS outcome
FROM spine s JOIN near180 n ON s.gameId = n.gameId AND s.game_seconds_elapsed = n.g LEFT JOIN home ON home.gameId = s.gameId WHERE descriptor IS NOT NULL""",
}


def _outcomes(t):
    return t.spine.where("descriptor is not null")


@register("challenge_outcomes", f"SELECT outcome, {ONE_T} FROM (SELECT * FROM chp UNION ALL SELECT x, 'pooled' FROM chp) q GROUP BY outcome", CHALLENGE)
def _(t):
    rows = t.rich.drop("descriptor")
    pairs = experiments.challenge_twins(rows, _outcomes(t))
    return rounded(stats.one_sample(pairs, ["outcome"], "pair_diff"), ["mean", "std", "t_stat"])


@register("challenge_lead_change", f"SELECT outcome, {ONE_T} FROM chl GROUP BY outcome", CHALLENGE)
def _(t):
    rows = experiments.challenge_lead_change(t.spine, _outcomes(t), state.home_team(t.spine))
    return rounded(stats.one_sample(rows, ["outcome"], "calling_lead_change"), ["mean", "std", "t_stat"])


# --- C9 to C13 ------------------------------------------------------------------------------------

C9 = {
    "c9": """SELECT e.gameId, e.orderNumber, e.season_type, e.seconds_remaining, e.score_margin, e.subType AS timeout_subtype, e.teamId AS timeout_team, e.possession_id,
o.x AS off, p.possession_points, e.teamId = p.possession AS own FROM en e JOIN (SELECT unnest(range(1, 6)) AS x) o ON TRUE
JOIN possn p ON p.gameId = e.gameId AND p.possession_id = e.possession_id + o.x WHERE e.actionType = 'timeout'"""
}


@register("post_event_possessions", f"SELECT {KEY}, off, possession_points, own FROM c9", C9)
def _(t):
    rows = windows.post_event_possessions(t.enriched, t.possessions)
    return rows.select(*key, F.col("offset").alias("off"), "possession_points", F.col("is_calling_team_poss").alias("own"))


@register("post_window_filters", f"SELECT {KEY}, off FROM c9 WHERE timeout_subtype = 'full' AND season_type = 'rg' AND seconds_remaining BETWEEN 60 AND 600 AND score_margin <= 20 AND own AND EXISTS (SELECT 1 FROM possn p WHERE p.gameId = c9.gameId AND p.possession_id = c9.possession_id AND abs(p.streak) >= 3)", C9)
def _(t):
    rows = windows.post_event_possessions(t.enriched, t.possessions)
    out = windows.post_window_filters(rows, t.possessions, ["full"], "rg", (60, 600), (None, 20), 3, "calling")
    return out.select(*key, F.col("offset").alias("off"))


@register("post_event_hist", f"SELECT off, (floor(possession_points + 0.5))::BIGINT AS bin, count(*) AS n, {R('count(*) / sum(count(*)) OVER (PARTITION BY off)', 'probability')} FROM (SELECT off, possession_points FROM c9 UNION ALL SELECT 0, possession_points FROM possn) q WHERE possession_points BETWEEN -0.5 AND 7.5 GROUP BY 1, 2", C9)
def _(t):
    after = windows.post_event_possessions(t.enriched, t.possessions).select(F.col("offset").alias("off"), "possession_points")
    base = t.possessions.select(F.lit(0).cast("long").alias("off"), "possession_points")
    out = A.histogram(after.unionByName(base), ["off"], "possession_points", -0.5, 1.0, 8)
    return out.select("off", "bin", "n", r6("probability"))


CF = {
    "cf": f"""SELECT tb AS trail_bucket, avg(x) FILTER (WHERE tr) AS tm, stddev_samp(x) FILTER (WHERE tr) AS ts, count(*) FILTER (WHERE tr) AS to_n,
avg(x) FILTER (WHERE NOT tr) AS cm, stddev_samp(x) FILTER (WHERE NOT tr) AS cs, count(*) FILTER (WHERE NOT tr) AS ctrl_n FROM (
SELECT TRUE AS tr, CASE WHEN timeout_team = possession THEN trailing_net ELSE -trailing_net END AS tb, CASE WHEN timeout_team = possession THEN forward_net ELSE -forward_net END AS x
FROM nets JOIN tokeys USING (gameId, possession_id)
UNION ALL SELECT FALSE, trailing_net, forward_net FROM nets n WHERE NOT EXISTS (SELECT 1 FROM tokeys k WHERE k.gameId = n.gameId AND k.possession_id = n.possession_id)) q
GROUP BY tb HAVING count(*) FILTER (WHERE tr) >= 10 AND count(*) FILTER (WHERE NOT tr) >= 10"""
}


@register("counterfactual", f"SELECT trail_bucket, to_n, ctrl_n, {R('tm', 'to_fwd_mean')}, {R('ts', 'to_fwd_std')}, {R('cm', 'ctrl_fwd_mean')}, {R('cs', 'ctrl_fwd_std')}, {R('tm - cm', 'causal_effect')} FROM cf", CF)
def _(t):
    out = windows.counterfactual(t.possessions, t.enriched, min_n=10)
    return rounded(out, ["to_fwd_mean", "to_fwd_std", "ctrl_fwd_mean", "ctrl_fwd_std", "causal_effect"])


@register("bucket_ci", f"SELECT trail_bucket, to_n, ctrl_n, {R('tm', 'to_fwd_mean')}, {R('cm', 'ctrl_fwd_mean')}, {R('tm - cm', 'causal_effect')}, {R('tm - 1.96 * ts / sqrt(to_n)', 'to_low')}, {R('tm + 1.96 * ts / sqrt(to_n)', 'to_high')}, {R('cm - 1.96 * cs / sqrt(ctrl_n)', 'ctrl_low')}, {R('cm + 1.96 * cs / sqrt(ctrl_n)', 'ctrl_high')} FROM cf", CF)
def _(t):
    out = windows.bucket_ci(windows.counterfactual(t.possessions, t.enriched, min_n=10))
    return rounded(out, [c for c in out.columns if c not in ("trail_bucket", "to_n", "ctrl_n")])


EVW = ["calling_team", "opponent_team", "pts_for_pre", "pts_against_pre", "pts_for_post", "pts_against_post", "n_for_pre", "n_for_post", "net_pre", "net_post", "net_change", "streak_signed", "margin_calling", "time_bucket"]


@register("event_windows", f"SELECT {KEY}, calling_team, opponent_team, {', '.join(c + '::BIGINT AS ' + c for c in EVW[2:-1])}, time_bucket, {R('ppp_for_pre', 'ppp_for_pre')}, {R('ppp_for_post', 'ppp_for_post')} FROM evw")
def _(t):
    rows = t.events
    rows = longs(rows, EVW[2:-1])
    return rows.select(*key, *EVW, r6("ppp_for_pre"), r6("ppp_for_post"))


BASE = ["calling_team_ppp", "opponent_team_ppp", "h2h_pt_diff_per_poss", "excess_net_post", "excess_h2h_net_post", "excess_ppp_for_post"]


@register("attach_baselines", f"SELECT {KEY}, {', '.join(R(c, c) for c in BASE)} FROM evb")
def _(t):
    rows = t.event_table
    return rows.select(*key, *[r6(c) for c in BASE])


def pre_post_sql(by, pre, post, excess):
    more = "".join(f", {R(f'avg({c})', o)}" for o, c in excess.items())
    return f"""SELECT {by}, count(*) AS n, {R(f'avg({pre})', 'pre_mean')}, {R(f'avg({post})', 'post_mean')}, {R(f'avg({post} - {pre})', 'delta_mean')}, {R(f'stddev_samp({post} - {pre})', 'delta_std')}{more},
{R(f'(avg({pre}) - avg({post})) / nullif(sqrt(var_samp({pre}) / count(*) + var_samp({post}) / count(*)), 0)', 't_stat')} FROM evb WHERE {pre} IS NOT NULL AND {post} IS NOT NULL GROUP BY {by}"""


@register("pre_post_summary_net", pre_post_sql("time_bucket", "net_pre", "net_post", {"excess_vs_baseline": "excess_net_post", "excess_vs_h2h": "excess_h2h_net_post"}))
def _(t):
    out = windows.pre_post_summary(t.event_table, ["time_bucket"]).drop("df")
    return rounded(out, [c for c in out.columns if c not in ("time_bucket", "n")])


@register("pre_post_summary_ppp", pre_post_sql("season_type", "ppp_for_pre", "ppp_for_post", {"excess_vs_baseline": "excess_ppp_for_post"}))
def _(t):
    out = windows.pre_post_summary(t.event_table, ["season_type"], "ppp").drop("df")
    return rounded(out, [c for c in out.columns if c not in ("season_type", "n")])


OVER = {"net_pre_mean": "net_pre", "net_post_mean": "net_post", "delta_mean": "net_change", "ppp_for_pre_mean": "ppp_for_pre", "ppp_for_post_mean": "ppp_for_post", "excess_net_post_mean": "excess_net_post", "excess_h2h_net_post_mean": "excess_h2h_net_post", "excess_ppp_for_post_mean": "excess_ppp_for_post"}


@register("overall_table", f"SELECT g AS \"group\", count(*) AS n, {', '.join(R(f'avg({c})', o) for o, c in OVER.items())} FROM (SELECT 'all' AS g, * FROM evb UNION ALL SELECT CASE WHEN is_endogenous THEN 'endogenous' ELSE 'exogenous' END, * FROM evb) q GROUP BY g")
def _(t):
    out = windows.overall_table(t.event_table)
    return rounded(out, list(OVER))


BP = "[14400, 28800, 31800, 34800, 37800, 40800]"


@register("split_intervals", f"""SELECT gameId, orderNumber, PERSON_ID AS personId, {R('a / 10', 'in_s')}, {R('b / 10', 'out_s')}, {R('(b - a) / 600', 'minutes')}, CASE WHEN n = 1 THEN ppts END AS player_pts,
row_number() OVER (PARTITION BY gameId, PERSON_ID ORDER BY a, orderNumber) AS stint_id FROM (
SELECT r.*, len(bounds) - 1 AS n, bounds[i] AS a, bounds[i + 1] AS b FROM (SELECT *, list_concat(list_concat([tin], list_filter({BP}, lambda x: x > tin AND x < tout)), [tout]) AS bounds FROM rot) r,
LATERAL (SELECT unnest(range(1, len(bounds))) AS i) u) q""")
def _(t):
    out = joins.build_stints(t.rotations)
    return out.select(*key, "personId", r6("in_game_seconds", "in_s"), r6("out_game_seconds", "out_s"), r6("stint_duration_minutes", "minutes"), "player_pts", "stint_id")


# --- figure data -----------------------------------------------------------------------------------


@register("role_by_clock", "SELECT timeout_cause, period, seconds_remaining // 30 AS bin, count(*) AS n FROM en WHERE actionType = 'timeout' AND timeout_cause IN ('tv_mandatory', 'coach_absorb') GROUP BY ALL")
def _(t):
    rows = t.enriched.where(P.is_timeout() & F.col("timeout_cause").isin("tv_mandatory", "coach_absorb"))
    return A.histogram(rows, ["timeout_cause", "period"], "seconds_remaining", 0, 30, 25).select("timeout_cause", "period", "bin", "n")


@register("duration_by_role", f"""SELECT timeout_role, count(*) AS n, {R('median(least(d, 3600))', 'median')} FROM (SELECT timeout_role, (lead(epoch_us(timeActual)) OVER (PARTITION BY gameId ORDER BY orderNumber) - epoch_us(timeActual)) / 1e6 AS d
FROM en WHERE actionType = 'timeout') q WHERE d IS NOT NULL GROUP BY timeout_role""")
def _(t):
    rows = classify.next_same_kind(t.spine).where("next_delta_s is not null").join(t.labels, key)
    rows = rows.withColumn("d", F.least("next_delta_s", F.lit(3600.0)))
    return rounded(A.exact_median(rows, ["timeout_role"], "d"), ["median"])


@register("recovery_summary", f"SELECT grp AS \"group\", count(*) AS n, {R('avg(recovery)', 'mean')}, {R('1.96 * stddev_pop(recovery) / sqrt(count(*))', 'half_width')} FROM ana GROUP BY grp")
def _(t):
    return rounded(experiments.recovery_summary(t.impact), ["mean", "half_width"])


@register("recovery_grid", compare_sql("suffering_location AS location, situation", "(SELECT *, CASE WHEN suffering_margin > 0 THEN 'ahead' WHEN suffering_margin < 0 THEN 'behind' END AS situation FROM ana WHERE suffering_margin <> 0) g"))
def _(t):
    return compared(experiments.recovery_grid(t.impact))


