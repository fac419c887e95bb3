"""Registered queries: data quality and the SQL layer's questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from eddyline.catalog.common import r6, rounded
from eddyline.catalog.oracle_parts import UPTO, W, oracle
from eddyline.catalog.oracle_parts import r6 as R
from eddyline.functions import columns as C
from eddyline.operators import joins
from eddyline.plans import quality, questions, state

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


# --- quality -------------------------------------------------------------------


REQUIRED = ["gameId", "orderNumber", "streak", "possession_id", "teamId", "shotDistance"]


@register("check_required_columns", " UNION ALL ".join(f"""SELECT '{c}' AS "column", {'FALSE' if c == 'shotDistance' else 'TRUE'} AS present, {'0::BIGINT' if c == 'shotDistance' else f'count({c})'} AS n_filled, count(*) AS n_rows FROM en""" for c in REQUIRED))
def _(t):
    return quality.check_required_columns(t.enriched, REQUIRED)


def failures_sql(rules: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS \"check\", count(*) FILTER (WHERE {c}) AS n_bad FROM {source}" for n, c in rules.items())


NULLS = ["possession_id", "subType", "prev_action_type", "home_teamId", "teamId"]


@register("check_nulls", failures_sql({c: f"{c} IS NULL" for c in NULLS}, "en"))
def _(t):
    return quality.check_nulls(t.enriched, NULLS)


@register("check_unique_key", "SELECT count(*) AS duplicate_keys, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS surplus_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) q")
def _(t):
    return quality.check_unique_key(t.raw("lineitem"), ["l_orderkey", "l_linenumber"])


@register("check_contiguous", "SELECT count(*) AS duplicate_keys, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS surplus_rows FROM (SELECT count(*) AS n FROM raw GROUP BY gameId, orderNumber HAVING count(*) > 1) q")
def _(t):
    return quality.check_order_unique(t.spine)


IDS = "array_to_string(list(gameId ORDER BY gameId) FILTER (WHERE bad)[1:5], ',')"
MONO = f"""SELECT col AS "column", count(*) FILTER (WHERE bad) AS n_bad, coalesce({IDS}, '') AS bad_ids, CASE WHEN col = 'game_seconds_elapsed' THEN 'warning' ELSE 'error' END AS severity FROM (
SELECT gameId, 'scoreHome' AS col, bool_or(coalesce(h < ph, FALSE)) AS bad FROM mono GROUP BY 1 UNION ALL
SELECT gameId, 'scoreAway', bool_or(coalesce(scoreAway < pa, FALSE)) FROM mono GROUP BY 1 UNION ALL
SELECT gameId, 'game_seconds_elapsed', bool_or(coalesce(g < pg, FALSE)) FROM mono GROUP BY 1) q GROUP BY col"""


@register("check_monotone", MONO, {
    "mono0": "SELECT *, scoreHome - CASE WHEN orderNumber % 301 = 0 THEN 1 ELSE 0 END AS h, game_seconds_elapsed - 40 * (orderNumber % 2) AS g FROM spine",
    "mono": f"SELECT *, lag(h) OVER ({W}) AS ph, lag(scoreAway) OVER ({W}) AS pa, lag(g) OVER ({W}) AS pg FROM mono0",
})
def _(t):
    o = F.col("orderNumber")
    broken = t.spine.withColumn("scoreHome", F.col("scoreHome") - F.when(o % 301 == 0, 1).otherwise(0)).withColumn(
        "game_seconds_elapsed", F.col("game_seconds_elapsed") - 40 * (o % 2)
    )
    return joined_ids(quality.check_monotone(broken))


def joined_ids(df):
    return df.withColumn("bad_ids", F.concat_ws(",", F.col("bad_ids").cast("array<string>")))


RANGES = {
    "period 1-10": "NOT period BETWEEN 1 AND 10", "clock >= 0": "g < 0", "remaining >= 0": "seconds_remaining < 0", "home score >= 0": "scoreHome < 0",
    "away score >= 0": "scoreAway < 0", "season 2000-2100": "NOT season BETWEEN 2000 AND 2100", "season type known": "season_type NOT IN ('rg', 'po')",
}


@register("check_ranges", failures_sql(RANGES, "(SELECT *, game_seconds_elapsed - 30 AS g FROM spine) q"))
def _(t):
    return quality.check_ranges(t.spine.withColumn("game_seconds_elapsed", F.col("game_seconds_elapsed") - 30))


@register("check_bad_ids", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{n}' AS \"check\", count(*) FILTER (WHERE bad) AS n_bad, coalesce({IDS}, '') AS bad_ids FROM (SELECT gameId, bool_or(coalesce({c}, FALSE)) AS bad FROM (SELECT *, game_seconds_elapsed - 30 AS g FROM spine) r GROUP BY gameId) q" for n, c in RANGES.items()) + ") z")
def _(t):
    off = t.spine.withColumn("game_seconds_elapsed", F.col("game_seconds_elapsed") - 30)
    return joined_ids(quality.bad_entity_ids(off, quality.range_rules()))


@register("check_intervals", failures_sql({"end before start": "o < i", "empty": "o = i"}, "stints"))
def _(t):
    return quality.check_intervals(t.stints, "in_game_seconds", "out_game_seconds")


CONSISTENT = {
    "score_margin": "m2 IS DISTINCT FROM scoreHome - scoreAway", "is_clutch": "is_clutch IS DISTINCT FROM (abs(scoreHome - scoreAway) <= 5 AND game_seconds_elapsed >= 2400)",
    "IsPlayoff": "IsPlayoff IS DISTINCT FROM (season_type = 'po')", "possession points iff id": "(possession_id IS NULL) <> (possession_points IS NULL)",
    "id iff live possession": "(possession_id IS NOT NULL) <> (possession > 0)", "role iff intervention": "(actionType = 'timeout') <> (timeout_role <> '')",
    "points 0-3": "points_scored NOT IN (0, 1, 2, 3)", "shot value 1-3": "sv NOT IN (1, 2, 3)", "outcome known": "oc NOT IN (" + ", ".join(f"'{o}'" for o in quality.OUTCOMES) + ") AND NOT starts_with(oc, 'ft_')",
}


@register("check_consistency", failures_sql(CONSISTENT, "(SELECT e.*, score_margin + CASE WHEN orderNumber % 50 = 0 THEN 1 ELSE 0 END AS m2, CASE actionType WHEN '3pt' THEN 3 WHEN '2pt' THEN 2 + CASE WHEN orderNumber % 70 = 0 THEN 3 ELSE 0 END END AS sv, CASE WHEN orderNumber % 90 = 0 THEN 'unheard of' ELSE possession_outcome END AS oc FROM en e LEFT JOIN outc USING (gameId, possession_id)) q"))
def _(t):
    # some rows are put out of order, which the checks must notice
    o = F.col("orderNumber")
    rows = t.enriched.join(state.possession_outcomes(t.plays), ["gameId", "possession_id"], "left")
    value = C.shot_value(F.col("actionType"))
    rows = rows.withColumns({
        "score_margin": F.col("score_margin") + F.when(o % 50 == 0, 1).otherwise(0),
        "shot_value": F.when((F.col("actionType") == "2pt") & (o % 70 == 0), 5).otherwise(value),
        "possession_outcome": F.when(o % 90 == 0, F.lit("unheard of")).otherwise(F.col("possession_outcome")),
    })
    return quality.check_consistency(rows)


@register("check_alignment", f"SELECT count(*) AS rows_before, CAST(sum(coalesce(n, 1)) AS BIGINT) AS rows_after, {R('avg((n IS NOT NULL)::INT)', 'coverage')} FROM spine s LEFT JOIN (SELECT gameId, personId, count(*) AS n FROM stints GROUP BY ALL) b USING (gameId, personId)")
def _(t):
    return rounded(quality.check_alignment(t.spine, t.stints, ["gameId", "personId"]), ["coverage"])


@register("check_containment", """SELECT count(*) AS n_keys, count(*) FILTER (WHERE lost IS DISTINCT FROM 0) AS n_disagree FROM (
SELECT gameId, PERSON_ID, sum(CASE WHEN orderNumber % 11 = 0 THEN tout - tin ELSE 0 END) AS lost FROM rot GROUP BY ALL) q""")
def _(t):
    # every eleventh interval is left out of the pieces, which the check must notice
    pieces = joins.build_stints(t.rotations.where("orderNumber % 11 <> 0"))
    wholes = t.rotations.withColumn("personId", F.col("PERSON_ID"))
    length = F.bround((F.col("out_game_seconds") - F.col("in_game_seconds")) * 10, 0).cast("long")
    return quality.check_containment(pieces, wholes, ["gameId", "personId"], length, F.col("OUT_TIME_REAL") - F.col("IN_TIME_REAL"))


@register("check_report", " UNION ALL ".join(
    f"SELECT '{g}' AS \"group\", * , '{sev}' AS severity FROM ({failures_sql(rules, src)}) q" for g, rules, src, sev in (
        ("nulls", {c: f"{c} IS NULL" for c in ("gameId", "teamId")}, "en", "error"),
        ("intervals", {"end before start": "o < i", "empty": "o = i"}, "stints", "warning"),
    )))
def _(t):
    return quality.check_report({
        "nulls": (quality.check_nulls(t.enriched, ["gameId", "teamId"]), "error"),
        "intervals": (quality.check_intervals(t.stints, "in_game_seconds", "out_game_seconds"), "warning"),
    }, raise_errors=True)


@register("unexpected_values", "SELECT DISTINCT actionType FROM plays WHERE actionType NOT IN ('2pt', '3pt', 'freethrow', 'rebound')")
def _(t):
    return quality.unexpected_values(t.plays, "actionType", ["2pt", "3pt", "freethrow", "rebound"])


@register("bad_entities", "SELECT DISTINCT gameId FROM spine WHERE abs(scoreHome - scoreAway) > 10 ORDER BY gameId LIMIT 5")
def _(t):
    return quality.bad_entities(t.spine, F.abs(F.col("scoreHome") - F.col("scoreAway")) > 10)


# --- questions --------------------------------------------------------------------


@register("q_per_possession", f"SELECT possession_outcome, {R('avg(possession_points)', 'avg_pts')}, count(*) AS possessions FROM possn JOIN outc USING (gameId, possession_id) GROUP BY 1")
def _(t):
    return rounded(questions.per_possession(t.plays), ["avg_pts"])


FATIGUE = {
    "ls": "SELECT * FROM stints WHERE (o - i) / 60.0 >= 1",
    "pf": "SELECT gameId, possession_id, possession, game_seconds_elapsed AS g FROM possn",
    "tp": "SELECT s.personId, s.gameId, s.i, (pf.g - s.i) // 60 + 1 AS mnt, count(*) AS np FROM pf JOIN ls s ON pf.gameId = s.gameId AND pf.g >= s.i AND pf.g < s.o AND pf.possession = s.teamId GROUP BY ALL",
    "pl": "SELECT s.personId, s.gameId, s.i, (p.game_seconds_elapsed - s.i) // 60 + 1 AS mnt, sum(p.points_scored) AS pts FROM en p JOIN ls s ON p.gameId = s.gameId AND p.personId = s.personId AND p.game_seconds_elapsed >= s.i AND p.game_seconds_elapsed < s.o WHERE p.possession_id IS NOT NULL GROUP BY ALL",
}


@register("q_fatigue_by_stint_minute", f"SELECT mnt AS stint_minute, CAST(sum(np) AS BIGINT) AS total_possessions, CAST(sum(coalesce(pts, 0)) AS BIGINT) AS total_player_pts, {R('sum(coalesce(pts, 0)) / sum(np)', 'pts_per_poss')} FROM tp LEFT JOIN pl USING (personId, gameId, i, mnt) WHERE mnt BETWEEN 1 AND 6 GROUP BY 1", FATIGUE)
def _(t):
    return rounded(questions.fatigue_by_stint_minute(t.enriched, t.stints, min_minutes=1), ["pts_per_poss"])


@register("q_after_event", f"""SELECT 'next_play' AS level, {R('avg(points_scored)', 'avg_points')}, count(*) AS n FROM en WHERE prev_action_type = 'timeout'
UNION ALL SELECT 'possession', {R('avg(p)', 'avg_points')}, count(*) FROM (SELECT max(possession_points) AS p FROM en WHERE possession_id IS NOT NULL GROUP BY gameId, possession_id HAVING bool_or(actionType = 'timeout')) q""")
def _(t):
    return rounded(questions.after_event(t.enriched, "timeout"), ["avg_points"])


@register("q_post_oreb_shots", "SELECT p.gameId, p.orderNumber FROM plays p JOIN (SELECT gameId, possession_id, max(orderNumber) AS l FROM plays WHERE actionType = 'rebound' AND subType = 'offensive' AND possession_id IS NOT NULL GROUP BY ALL) o USING (gameId, possession_id) WHERE isFieldGoal = 1 AND p.orderNumber > o.l")
def _(t):
    return questions.post_rebound_shots(t.plays).select(*key)


@register("q_shot_clock", f"SELECT p.gameId, p.orderNumber, {R('24.0 - (s.seconds_remaining - p.seconds_remaining)', 'shot_clock_remaining')} FROM plays p JOIN possn s USING (gameId, possession_id) WHERE isFieldGoal = 1 AND 24.0 - (s.seconds_remaining - p.seconds_remaining) BETWEEN 0 AND 24")
def _(t):
    return questions.shot_clock(t.plays).select(*key, r6("shot_clock_remaining"))


@register("q_safe_ratio", f"SELECT gameId, {R('sum(points_scored) / nullif(count(*) FILTER (WHERE actionType = {0}freethrow{0} AND k > 90), 0)'.format(chr(39)), 'ratio')} FROM plays GROUP BY gameId")
def _(t):
    rare = F.count_if((F.col("actionType") == "freethrow") & (F.col("k") > 90))
    return t.plays.groupBy("gameId").agg(r6(questions.safe_ratio(F.sum("points_scored"), rare), "ratio"))


@register("q_season_join", f"SELECT {KEY}, p.PTS AS season_pts FROM spine s JOIN pss1 p ON p.PLAYER_ID = s.personId AND p.season_int = s.season AND p.season_type = s.season_type")
def _(t):
    rows = t.spine.select(*key, "personId", "season", "season_type")
    return questions.season_join(rows, t.player_season).select(*key, F.col("PTS").alias("season_pts"))


RUNS = {
    "rg": "SELECT * FROM en WHERE season_type = 'rg' AND game_seconds_elapsed < 2880",
    "rs0": f"SELECT *, CASE WHEN lag(teamId) OVER ({W}) = teamId THEN 0 ELSE 1 END AS nw FROM rg WHERE points_scored > 0",
    "rs1": f"SELECT *, sum(nw) OVER ({W} {UPTO}) AS run_id FROM rs0",
    "rs2": f"SELECT *, sum(points_scored) OVER (PARTITION BY gameId, run_id ORDER BY orderNumber {UPTO}) AS rp FROM rs1",
    "big": "SELECT gameId, run_id, max(teamId) AS rt, max(orderNumber) AS eo, max(game_seconds_elapsed) AS eg, sum(points_scored) AS rpts FROM rs1 GROUP BY gameId, run_id HAVING sum(points_scored) >= 6 AND max(game_seconds_elapsed) <= 2700",
    "brk": """SELECT b.gameId, b.run_id, b.rt, b.eg, b.rpts,
min(CASE WHEN e.orderNumber > b.eo AND e.game_seconds_elapsed <= b.eg + 60 AND e.actionType = 'timeout' AND e.teamId <> b.rt THEN e.game_seconds_elapsed END) AS tt,
min(CASE WHEN e.orderNumber > b.eo AND e.game_seconds_elapsed <= b.eg + 60 AND e.actionType = 'stoppage' THEN e.game_seconds_elapsed END) AS bb
FROM big b JOIN (SELECT * FROM rg WHERE actionType IN ('timeout', 'stoppage')) e ON e.gameId = b.gameId GROUP BY ALL""",
    "cls": "SELECT *, CASE WHEN tt IS NOT NULL AND (bb IS NULL OR tt <= bb) THEN 'trailing_timeout' WHEN bb IS NOT NULL THEN 'game_break' ELSE 'no_timeout' END AS situation FROM brk",
    "aft": """SELECT c.gameId, c.run_id, c.situation, c.rpts, sum(CASE WHEN s.teamId = c.rt THEN s.points_scored ELSE 0 END) AS mine, sum(CASE WHEN s.teamId <> c.rt THEN s.points_scored ELSE 0 END) AS theirs
FROM cls c JOIN (SELECT * FROM rg WHERE points_scored > 0) s ON s.gameId = c.gameId AND s.game_seconds_elapsed > c.eg AND s.game_seconds_elapsed <= c.eg + 180 GROUP BY ALL""",
}


@register("q_run_timeout_situations", f"""SELECT situation, count(*) AS num_runs, {R('avg(rpts)', 'avg_run_size')}, {R('avg(mine)', 'avg_running_pts')}, {R('avg(theirs)', 'avg_trailing_pts')}, {R('avg(theirs - mine)', 'avg_net_swing')},
{R('100.0 * count(*) FILTER (WHERE theirs > mine) / count(*)', 'pct_trailing_wins')} FROM aft GROUP BY situation""", RUNS)
def _(t):
    out = questions.run_timeout_situations(t.enriched, breaks="stoppage")
    return rounded(out, [c for c in out.columns if c not in ("situation", "num_runs")])


TRIGGER = {
    "sp0": f"SELECT *, CASE WHEN lag(teamId) OVER ({W}) = teamId THEN 0 ELSE 1 END AS nw FROM en WHERE points_scored > 0 AND season_type = 'rg'",
    "sp1": f"SELECT *, sum(nw) OVER ({W} {UPTO}) AS run_id FROM sp0",
    "sp2": f"SELECT *, sum(points_scored) OVER (PARTITION BY gameId, run_id ORDER BY orderNumber {UPTO}) AS rp FROM sp1",
    "tr0": "SELECT gameId, min(orderNumber) AS ro, arg_min(game_seconds_elapsed, orderNumber) AS rg_t, max(teamId) AS rt FROM sp2 WHERE rp >= 6 GROUP BY gameId, run_id",
    "tr1": "SELECT t.*, (SELECT min(teamB) FROM pairs p WHERE p.gameId = t.gameId AND p.teamA = t.rt) AS opp FROM tr0 t WHERE rg_t < 2700",
    "tr2": "SELECT t.gameId, t.ro, t.rg_t, t.rt, t.opp, min(e.orderNumber) AS fo FROM tr1 t LEFT JOIN (SELECT * FROM en WHERE actionType = 'timeout') e ON e.gameId = t.gameId AND e.orderNumber > t.ro AND e.game_seconds_elapsed BETWEEN t.rg_t AND t.rg_t + 60 GROUP BY ALL",
    "tr3": """SELECT t.*, CASE WHEN fo IS NULL THEN 'no_timeout' WHEN regexp_matches(lower(coalesce(e.subType, '')), 'official|mandatory|tv|media|auto') OR e.teamId IS NULL OR e.teamId = 0 THEN 'exogenous_break'
WHEN e.teamId = opp THEN 'opponent_timeout' WHEN e.teamId = rt THEN 'run_team_timeout' ELSE 'exogenous_break' END AS category, coalesce(e.game_seconds_elapsed, rg_t) AS ws, coalesce(fo, ro) AS wo
FROM tr2 t LEFT JOIN en e ON e.gameId = t.gameId AND e.orderNumber = t.fo""",
    "tr4": """SELECT c.gameId, c.ro, c.category, coalesce(sum(f.points_scored) FILTER (WHERE f.teamId = c.rt), 0) AS mine, coalesce(sum(f.points_scored) FILTER (WHERE f.teamId = c.opp), 0) AS theirs
FROM tr3 c LEFT JOIN (SELECT * FROM en WHERE points_scored > 0 AND season_type = 'rg') f ON f.gameId = c.gameId AND f.orderNumber > c.wo AND f.game_seconds_elapsed > c.ws AND f.game_seconds_elapsed <= c.ws + 180 GROUP BY ALL""",
}


@register("q_run_trigger_categories", f"SELECT category, count(*) AS n_runs, {R('avg(mine)', 'avg_run_team_pts')}, {R('avg(theirs)', 'avg_opp_pts')}, {R('avg(mine - theirs)', 'avg_net_run_team')}, {R('stddev_samp(mine - theirs) / sqrt(count(*))', 'se_net')} FROM tr4 GROUP BY category", TRIGGER)
def _(t):
    out = questions.run_trigger_categories(t.enriched)
    return rounded(out, [c for c in out.columns if c not in ("category", "n_runs")])


FLOOR = {
    "ps": "SELECT * FROM possn WHERE season_type = 'rg'",
    "offs": "SELECT p.gameId, p.possession_id, avg(p.game_seconds_elapsed - s.i) AS f FROM ps p JOIN stints s ON s.gameId = p.gameId AND s.teamId = p.possession AND p.game_seconds_elapsed >= s.i AND p.game_seconds_elapsed < s.o GROUP BY ALL",
    "defs": "SELECT p.gameId, p.possession_id, avg(p.game_seconds_elapsed - s.i) AS f FROM ps p JOIN stints s ON s.gameId = p.gameId AND s.teamId <> p.possession AND p.game_seconds_elapsed >= s.i AND p.game_seconds_elapsed < s.o GROUP BY ALL",
    "shr": "SELECT gameId, possession_id, arg_min(personId, orderNumber) AS personId FROM en WHERE actionType IN ('2pt', '3pt') AND possession_id IS NOT NULL AND season = 2021 AND season_type = 'rg' GROUP BY ALL",
    "lst": "SELECT gameId, personId, max(i) AS i FROM stints WHERE season = 2021 AND season_type = 'rg' GROUP BY ALL",
}


@register("q_floor_time_heatmap", f"""SELECT floor(o.f / 60)::BIGINT AS x_bin, floor(d.f / 60)::BIGINT AS y_bin, {R('avg(possession_points)', 'mean_value')}, count(*) AS n FROM ps JOIN offs o USING (gameId, possession_id) JOIN defs d USING (gameId, possession_id)
WHERE o.f BETWEEN 0 AND 1200 AND d.f BETWEEN 0 AND 1200 GROUP BY 1, 2 HAVING count(*) >= 2 AND floor(o.f / 60) <= 15 AND floor(d.f / 60) <= 15""".replace("HAVING count(*) >= 2 AND floor(o.f / 60) <= 15 AND floor(d.f / 60) <= 15", "HAVING count(*) >= 2 AND x_bin <= 15 AND y_bin <= 15"), FLOOR)
def _(t):
    return rounded(questions.floor_time_heatmap(t.enriched, t.stints, min_count=2), ["mean_value"])


@register("q_shooter_floor_time", f"""SELECT x_bin, y_bin, {R('avg(possession_points)', 'mean_value')}, count(*) AS n FROM (
SELECT least(floor((p.game_seconds_elapsed - l.i) / 60.0 / 2) * 2, 14)::BIGINT AS x_bin, least(floor(d.f / 60.0 / 2) * 2, 14)::BIGINT AS y_bin, possession_points
FROM ps p JOIN shr h USING (gameId, possession_id) JOIN lst l ON l.gameId = p.gameId AND l.personId = h.personId JOIN defs d ON d.gameId = p.gameId AND d.possession_id = p.possession_id
WHERE p.season = 2021 AND p.game_seconds_elapsed >= l.i AND d.f >= 0) q GROUP BY 1, 2 HAVING count(*) >= 2""", FLOOR)
def _(t):
    return rounded(questions.shooter_floor_time(t.enriched, t.stints, 2021, min_count=2), ["mean_value"])


@register("q_example_ratio", f"SELECT season, count(*) FILTER (WHERE actionType = '3pt') AS attempts, {R('count(*) FILTER (WHERE actionType = {0}3pt{0} AND shotResult = {0}Made{0}) / nullif(count(*) FILTER (WHERE actionType = {0}3pt{0}), 0)'.format(chr(39)), 'share_made')} FROM plays GROUP BY season")
def _(t):
    return rounded(questions.ratio_by_season(t.plays), ["share_made"])


@register("q_example_top", f"SELECT gameId, personId, attempts, made, {R('made / attempts', 'share_made')} FROM (SELECT gameId, personId, count(*) AS attempts, count(*) FILTER (WHERE shotResult = 'Made') AS made FROM plays WHERE isFieldGoal = 1 GROUP BY ALL HAVING count(*) >= 6) q ORDER BY made / attempts DESC, attempts DESC, gameId, personId LIMIT 10")
def _(t):
    return rounded(questions.top_players(t.plays, 10, 6), ["share_made"])


@register("q_example_share", f"SELECT season_type, actionType, n, {R('n / sum(n) OVER (PARTITION BY season_type)', 'share')} FROM (SELECT season_type, actionType, count(*) AS n FROM plays WHERE isFieldGoal = 1 GROUP BY ALL) q")
def _(t):
    return rounded(questions.share_by_type(t.plays), ["share"])


@register("q_example_comeback", "SELECT gameId, min(scoreHome - scoreAway) AS worst, arg_max(scoreHome - scoreAway, orderNumber) AS final_lead FROM spine GROUP BY gameId HAVING worst <= -5 AND final_lead > 0")
def _(t):
    return questions.comebacks(t.spine, 5)


@register("q_example_after_timeout", f"SELECT CASE WHEN prev_action_type = 'timeout' THEN 'after timeout' ELSE 'other' END AS situation, count(*) AS n, {R('avg((points_scored > 0)::INT)', 'scoring_share')} FROM en GROUP BY 1")
def _(t):
    return rounded(questions.after_timeout_share(t.enriched), ["scoring_share"])


