"""Common table expressions the reference SQL of the registered queries is built from.

They restate the spine projection and the derived state in plain SQL over the given
tables, independently of the Spark plans.
"""

from __future__ import annotations

import re

W = "PARTITION BY gameId ORDER BY orderNumber"
UPTO = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"

PARTS: dict[str, str] = {}

PARTS["ev"] = """
SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k,
  CAST(floor((epoch_us(ts) - 1704067200000000) / 900000000.0) AS BIGINT) AS gse,
  (event_type = 'click' OR (event_type <> 'view' AND event_id % 2 = 0)) AS is_home
FROM events"""

PARTS["raw"] = """
SELECT user_id AS gameId, event_id AS orderNumber, ts AS timeActual, gse AS game_seconds_elapsed,
  least(gse // 720, 3) + 1 AS period, 720 * (least(gse // 720, 3) + 1) - gse AS seconds_remaining,
  CASE event_type WHEN 'click' THEN '2pt' WHEN 'view' THEN '3pt' WHEN 'purchase' THEN 'timeout'
    WHEN 'signup' THEN 'substitution' ELSE 'stoppage' END AS actionType,
  CASE WHEN event_type = 'purchase' THEN CASE WHEN k % 10 = 7 THEN 'challenge' ELSE 'full' END END AS subType,
  CASE WHEN event_type = 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'team, mandatory' ELSE 'team' END END AS qualifiers,
  CASE WHEN event_type = 'error' THEN CASE k % 3 WHEN 0 THEN 'overturned' WHEN 1 THEN 'stands' ELSE 'support' END END AS descriptor,
  CASE WHEN is_home THEN 100 + user_id % 10 ELSE 200 + user_id % 7 END AS teamId,
  CASE WHEN event_type = 'signup' THEN 0 WHEN is_home THEN 100 + user_id % 10 ELSE 200 + user_id % 7 END AS possession,
  event_id % 5 + 1 AS personId,
  CASE WHEN event_type IN ('click', 'view') THEN 1 + CAST(floor(value) AS BIGINT) % 3 ELSE 0 END AS points_scored,
  2020 + user_id % 3 AS season, CASE WHEN user_id % 5 = 0 THEN 'po' ELSE 'rg' END AS season_type,
  user_id % 5 = 0 AS IsPlayoff, k, value, is_home
FROM ev"""

PARTS["spine"] = f"""
SELECT *, CAST(sum(CASE WHEN is_home THEN points_scored ELSE 0 END) OVER ({W} {UPTO}) AS BIGINT) AS scoreHome,
  CAST(sum(CASE WHEN is_home THEN 0 ELSE points_scored END) OVER ({W} {UPTO}) AS BIGINT) AS scoreAway
FROM raw"""

PARTS["st0"] = f"""
SELECT *, lag(actionType) OVER ({W}) AS prev_action_type, lag(subType) OVER ({W}) AS prev_sub_type,
  greatest(coalesce(scoreHome - lag(scoreHome) OVER ({W}), 0), 0)
  - greatest(coalesce(scoreAway - lag(scoreAway) OVER ({W}), 0), 0) AS net,
  CASE WHEN possession > 0 AND (lag(possession) OVER ({W}) IS NULL OR possession <> lag(possession) OVER ({W}))
    THEN 1 ELSE 0 END AS pflag
FROM spine"""

PARTS["st1"] = f"""
SELECT *, CASE WHEN net <> 0 THEN sign(net) END AS sg,
  CASE WHEN possession > 0 THEN CAST(sum(pflag) OVER ({W} {UPTO}) AS BIGINT) END AS possession_id
FROM st0"""

PARTS["st2"] = f"""
SELECT *, last_value(sg IGNORE NULLS) OVER ({W} {BEFORE}) AS psg FROM st1"""

PARTS["st3"] = f"""
SELECT *, sum(CASE WHEN sg IS NOT NULL AND psg IS NOT NULL AND sg <> psg THEN 1 ELSE 0 END) OVER ({W} {UPTO}) AS sgseg
FROM st2"""

PARTS["st"] = f"""
SELECT *, CAST(sum(net) OVER (PARTITION BY gameId, sgseg ORDER BY orderNumber {UPTO}) AS BIGINT) AS streak FROM st3"""

PARTS["hm0"] = f"""
SELECT gameId, orderNumber, teamId, scoreHome - lag(scoreHome) OVER ({W}) AS d
FROM spine WHERE points_scored > 0 AND teamId > 0"""

PARTS["home"] = """
SELECT gameId, arg_min(teamId, orderNumber) AS home_teamId FROM hm0 WHERE d > 0 GROUP BY gameId"""

PARTS["away"] = """
SELECT gameId, min(s.teamId) AS away_teamId FROM spine s JOIN home USING (gameId)
WHERE s.teamId > 0 AND s.teamId <> home_teamId GROUP BY gameId"""

PARTS["pairs"] = """
SELECT a.gameId, a.teamId AS teamA, b.teamId AS teamB
FROM (SELECT DISTINCT gameId, teamId FROM spine WHERE teamId > 0) a
JOIN (SELECT DISTINCT gameId, teamId FROM spine WHERE teamId > 0) b ON a.gameId = b.gameId AND a.teamId <> b.teamId"""

PARTS["tos0"] = f"""
SELECT s.gameId, s.orderNumber, s.period, s.seconds_remaining, s.teamId, s.season, home_teamId, qualifiers,
  subType = 'challenge' AS ch, contains(qualifiers, 'mandatory') AS fl,
  sum(CASE WHEN contains(qualifiers, 'mandatory') THEN 1 ELSE 0 END)
    OVER (PARTITION BY s.gameId, s.period ORDER BY orderNumber {UPTO}) AS rk,
  sum(CASE WHEN subType <> 'challenge' THEN 1 ELSE 0 END)
    OVER (PARTITION BY s.gameId, s.period, s.teamId ORDER BY orderNumber {UPTO}) AS tk
FROM spine s LEFT JOIN home USING (gameId) WHERE actionType = 'timeout'"""

PARTS["tos"] = """
SELECT *, CASE rk WHEN 1 THEN 420 WHEN 2 THEN 180 END AS trig, (NOT ch AND tk = 1) AS is_first,
  CASE WHEN rk = 1 THEN home_teamId IS NULL OR teamId = home_teamId
       WHEN rk = 2 THEN home_teamId IS NULL OR teamId <> home_teamId ELSE TRUE END AS own
FROM tos0"""


def cause_case(buffer: str) -> str:
    return f"""CASE WHEN ch THEN 'challenge' WHEN NOT fl THEN 'coach_discretionary'
  WHEN rk > 2 THEN 'mistagged_discretionary'
  WHEN seconds_remaining <= trig THEN CASE WHEN own THEN 'tv_mandatory' ELSE 'mistagged_discretionary' END
  WHEN is_first AND own AND seconds_remaining - trig <= {buffer} THEN 'coach_absorb'
  ELSE 'mistagged_discretionary' END"""


PARTS["lab"] = f"""
SELECT gameId, orderNumber, CASE WHEN ch THEN 'challenge' WHEN fl THEN 'slot_' || least(rk, 2) || '_mandatory'
  ELSE 'discretionary' END AS timeout_role, {cause_case("80")} AS timeout_cause FROM tos"""

PARTS["pp"] = """
SELECT gameId, possession_id, CAST(sum(points_scored) AS BIGINT) AS possession_points
FROM st1 WHERE possession_id IS NOT NULL GROUP BY ALL"""

PARTS["en"] = """
SELECT st.* EXCLUDE (is_home, net, pflag, sg, psg, sgseg), scoreHome - scoreAway AS score_margin,
  abs(scoreHome - scoreAway) <= 5 AND game_seconds_elapsed >= 2400 AS is_clutch, possession_points,
  home_teamId, away_teamId, coalesce(timeout_role, '') AS timeout_role, coalesce(timeout_cause, '') AS timeout_cause
FROM st LEFT JOIN pp USING (gameId, possession_id) LEFT JOIN home USING (gameId) LEFT JOIN away USING (gameId)
LEFT JOIN lab USING (gameId, orderNumber)"""

PARTS["plays"] = """
SELECT * EXCLUDE (actionType, subType),
  CASE WHEN actionType IN ('2pt', '3pt', 'timeout') THEN CASE WHEN k % 3 = 0 THEN 'Missed' ELSE 'Made' END END AS shotResult,
  CASE WHEN actionType = 'stoppage' AND k % 6 = 0 THEN CASE WHEN k % 4 = 0 THEN 'offensive' ELSE 'defensive' END END AS subType,
  CASE WHEN actionType IN ('2pt', '3pt') THEN 1 ELSE 0 END AS isFieldGoal,
  CASE WHEN actionType = 'timeout' THEN 'freethrow' WHEN actionType = 'stoppage' THEN
    CASE k % 6 WHEN 0 THEN 'rebound' WHEN 1 THEN 'turnover' WHEN 2 THEN 'steal' WHEN 3 THEN 'block' WHEN 4 THEN 'violation'
    ELSE 'period' END ELSE actionType END AS actionType
FROM en"""

PARTS["possn"] = """
SELECT gameId, possession_id, arg_min(period, orderNumber) AS period,
  arg_min(game_seconds_elapsed, orderNumber) AS game_seconds_elapsed,
  arg_min(seconds_remaining, orderNumber) AS seconds_remaining, arg_min(score_margin, orderNumber) AS score_margin,
  arg_min(is_clutch, orderNumber) AS is_clutch,
  arg_min(streak, orderNumber) AS streak, arg_min(season, orderNumber) AS season,
  arg_min(season_type, orderNumber) AS season_type, arg_min(IsPlayoff, orderNumber) AS IsPlayoff,
  arg_min(possession, orderNumber) AS possession, max(possession_points) AS possession_points
FROM en WHERE possession_id IS NOT NULL GROUP BY gameId, possession_id"""

PARTS["outc0"] = """
SELECT gameId, possession_id, bool_or(actionType = 'steal') AS steal,
  bool_or(actionType = '2pt' AND coalesce(shotResult = 'Made', FALSE)) AS two,
  bool_or(actionType = '3pt' AND coalesce(shotResult = 'Made', FALSE)) AS three,
  bool_or(actionType IN ('2pt', '3pt') AND coalesce(shotResult = 'Missed', FALSE)) AS missed,
  count(*) FILTER (WHERE actionType = 'freethrow') AS ft,
  count(*) FILTER (WHERE actionType = 'freethrow' AND shotResult = 'Made') AS ftm,
  arg_max(actionType, orderNumber) AS la, arg_max(coalesce(subType, ''), orderNumber) AS ls
FROM plays WHERE possession_id IS NOT NULL GROUP BY ALL"""

PARTS["outc"] = """
SELECT gameId, possession_id, CASE WHEN three AND ftm > 0 THEN 'made_3pt_and1' WHEN two AND ftm > 0 THEN 'made_2pt_and1'
  WHEN three THEN 'made_3pt' WHEN two THEN 'made_2pt' WHEN ft > 0 THEN 'ft_' || ftm || '_of_' || ft
  WHEN la = 'turnover' AND steal THEN 'turnover_live' WHEN la = 'turnover' THEN 'turnover_dead'
  WHEN la = 'rebound' AND ls = 'defensive' THEN 'miss_def_reb' WHEN la = 'period' THEN 'end_of_period'
  WHEN la = 'violation' THEN 'violation' WHEN missed THEN 'miss' ELSE 'other' END AS possession_outcome FROM outc0"""

PARTS["fin"] = """
SELECT gameId, arg_max(scoreHome, orderNumber) AS final_home, arg_max(scoreAway, orderNumber) AS final_away,
  arg_min(season, orderNumber) AS season, arg_min(season_type, orderNumber) AS season_type,
  arg_max(scoreHome, orderNumber) > arg_max(scoreAway, orderNumber) AS home_won FROM spine GROUP BY gameId"""

PARTS["wins"] = """
SELECT p.gameId, teamA AS teamId, teamB AS opponent_team, f.season, f.season_type,
  CASE WHEN teamA = home_teamId THEN final_home > final_away ELSE final_away > final_home END AS won,
  CASE WHEN teamA = home_teamId THEN final_home - final_away ELSE final_away - final_home END AS pt_diff
FROM pairs p JOIN home USING (gameId) JOIN fin f USING (gameId)"""

PARTS["rec"] = """
SELECT season, teamId, count(*) FILTER (WHERE won) AS wins, count(*) FILTER (WHERE NOT won) AS losses,
  count(*) FILTER (WHERE won) / count(*) AS wpct FROM wins WHERE season_type = 'rg' GROUP BY ALL"""

PARTS["ppp"] = """
SELECT season, season_type, possession AS teamId, CAST(sum(possession_points) AS BIGINT) AS total_pts, count(*) AS n_poss,
  sum(possession_points) / count(*) AS ppp FROM possn GROUP BY season, season_type, possession"""

PARTS["h2h"] = """
SELECT w.season, w.season_type, w.teamId AS calling_team, opponent_team, count(*) AS n_games,
  CAST(sum(pt_diff) AS BIGINT) AS total_pt_diff, CAST(sum(np) AS BIGINT) AS total_poss, sum(pt_diff) / sum(np) AS pt_diff_per_poss
FROM wins w JOIN (SELECT gameId, count(*) AS np FROM possn GROUP BY gameId) USING (gameId) GROUP BY ALL"""

PARTS["clk"] = """
SELECT gameId, game_seconds_elapsed AS g, arg_max(scoreHome, orderNumber) AS h, arg_max(scoreAway, orderNumber) AS a,
  max(orderNumber) AS o FROM spine GROUP BY ALL"""


def nearest_part(seconds: float) -> str:
    """Brute-force nearest clock to ``g + seconds`` in the entity, later on ties."""
    return f"""
SELECT c.gameId, c.g, n.g AS ng, n.h, n.a, n.o FROM clk c JOIN clk n USING (gameId)
QUALIFY row_number() OVER (PARTITION BY c.gameId, c.g ORDER BY abs(n.g - (c.g + {seconds})), n.g DESC) = 1"""


PARTS["near180"] = nearest_part(180)
for _s in (30, 60, 90, 120, 150, 240, 300):
    PARTS[f"near{_s}"] = nearest_part(_s)


def group_case(apart: bool) -> str:
    ch = "WHEN actionType = 'timeout' AND timeout_cause = 'challenge' THEN 'challenge'" if apart else ""
    return f"""CASE WHEN actionType = 'timeout' AND timeout_cause IN ('coach_discretionary', 'mistagged_discretionary')
  AND coalesce((streak > 0 AND teamId <> home_teamId) OR (streak < 0 AND teamId = home_teamId), FALSE) THEN 'endogenous'
  WHEN actionType = 'timeout' AND timeout_cause IN ('tv_mandatory', 'coach_absorb') THEN 'exogenous'
  WHEN actionType = 'stoppage' THEN 'exogenous' {ch} ELSE 'control' END"""


def analysis(name: str, run: int, seconds: int, apart: bool) -> dict[str, str]:
    """The parts ``<name>_0 … <name>`` of a run-impact frame."""
    p = {}
    p[f"{name}_0"] = f"""
SELECT *, {group_case(apart)} AS grp, CASE WHEN actionType = 'timeout' AND timeout_cause IN ('tv_mandatory', 'coach_absorb',
  'coach_discretionary', 'mistagged_discretionary') THEN timeout_cause
  WHEN actionType = 'timeout' AND timeout_cause = 'challenge' THEN 'coach_challenge'
  WHEN actionType = 'stoppage' THEN 'stoppage' ELSE 'control' END AS subtype_fine,
  CASE WHEN lag(sign(streak)) OVER ({W}) = sign(streak) THEN 0 ELSE 1 END AS sgf
FROM en WHERE abs(streak) >= {run}"""
    p[f"{name}_1"] = f"SELECT *, sum(sgf) OVER ({W} {UPTO}) AS seg FROM {name}_0"
    p[f"{name}_2"] = f"""
SELECT * FROM {name}_1 WHERE grp <> 'control' UNION ALL
SELECT * FROM {name}_1 WHERE grp = 'control'
QUALIFY row_number() OVER (PARTITION BY gameId, seg ORDER BY orderNumber) = 1"""
    p[name] = f"""
SELECT x.*, {run} AS run_size, {seconds / 60.0} AS minutes, n.h - scoreHome AS home_pts_scored, n.a - scoreAway AS away_pts_scored,
  (n.h - scoreHome) - (n.a - scoreAway) AS lead_change,
  -sign(streak) * ((n.h - scoreHome) - (n.a - scoreAway)) AS recovery,
  -sign(streak) * (scoreHome - scoreAway) AS suffering_margin,
  CASE WHEN streak > 0 THEN n.h - scoreHome ELSE n.a - scoreAway END AS running_team_pts,
  CASE WHEN streak > 0 THEN 'away' ELSE 'home' END AS suffering_location,
  period >= 4 AND seconds_remaining <= 300 AND abs(scoreHome - scoreAway) <= 5 AS clutch
FROM {name}_2 x JOIN near{seconds} n ON x.gameId = n.gameId AND x.game_seconds_elapsed = n.g"""
    return p


PARTS.update(analysis("ana", 6, 180, False))
PARTS.update(analysis("rich", 6, 180, True))


def twin_part(source: str, on: str, dist: str) -> str:
    return f"""
SELECT t.*, c.orderNumber AS c_order, c.recovery AS c_recovery, t.recovery - c.recovery AS pair_diff, {dist} AS dist
FROM (SELECT * FROM {source} WHERE grp <> 'control') t JOIN (SELECT * FROM {source} WHERE grp = 'control') c
ON t.gameId = c.gameId AND sign(t.streak) = sign(c.streak) AND abs(t.streak - c.streak) <= 2
  AND abs(t.suffering_margin - c.suffering_margin) <= 3 AND {on}
QUALIFY row_number() OVER (PARTITION BY t.gameId, t.orderNumber ORDER BY {dist}, c.orderNumber) = 1"""


_SR = "abs(t.seconds_remaining - c.seconds_remaining)"
_GS = "abs(t.game_seconds_elapsed - c.game_seconds_elapsed)"
_SD = "60 * abs(t.streak - c.streak) + {gap} + 90 * abs(t.suffering_margin - c.suffering_margin)"
PARTS["twin"] = twin_part("rich", f"t.period = c.period AND {_SR} <= 120", _SD.format(gap=_SR))
PARTS["twin_dough"] = twin_part(
    "rich",
    f"{_GS} BETWEEN 180 AND 720",
    f"120 * abs(t.streak - c.streak) + {_GS} + 180 * abs(t.suffering_margin - c.suffering_margin)",
)
PARTS["twin_other"] = twin_part("rich", f"t.period <> c.period AND {_SR} <= 120", _SD.format(gap=_SR))

_LAGS = ", ".join(
    f"lag(possession_points, {i}) OVER w AS pl{i}, lag(possession, {i}) OVER w AS tl{i}, "
    f"lead(possession_points, {i}) OVER w AS pf{i}, lead(possession, {i}) OVER w AS tf{i}"
    for i in range(1, 7)
)
PARTS["lags"] = f"""
SELECT gameId, possession_id, possession_points, possession, {_LAGS} FROM possn
WINDOW w AS (PARTITION BY gameId ORDER BY possession_id)"""


def side_sum(side: str, own: str, op: str, count: bool = False) -> str:
    return " + ".join(
        f"CASE WHEN t{side}{i} {op} {own} THEN {'1' if count else f'p{side}{i}'} ELSE 0 END" for i in range(1, 7)
    )


PARTS["nets"] = f"""
SELECT gameId, possession_id, possession, ({side_sum('l', 'possession', '=')}) - ({side_sum('l', 'possession', '<>')}) AS trailing_net,
  ({side_sum('f', 'possession', '=')}) - ({side_sum('f', 'possession', '<>')}) AS forward_net
FROM lags WHERE pl6 IS NOT NULL AND pf6 IS NOT NULL"""

PARTS["tokeys"] = """
SELECT DISTINCT gameId, possession_id, teamId AS timeout_team FROM en
WHERE actionType = 'timeout' AND subType = 'full' AND possession_id IS NOT NULL"""

PARTS["evw0"] = """
SELECT e.gameId, e.orderNumber, e.possession_id, e.period, e.game_seconds_elapsed, e.seconds_remaining, e.score_margin, e.season,
  e.season_type, e.subType AS timeout_subtype, e.timeout_cause, e.streak, e.home_teamId, e.away_teamId,
  e.timeout_cause IN ('coach_discretionary', 'mistagged_discretionary') AS is_endogenous,
  CASE WHEN e.timeout_cause IN ('coach_discretionary', 'mistagged_discretionary') THEN e.teamId ELSE l.possession END AS calling_team,
  l.* EXCLUDE (gameId, possession_id, possession_points, possession)
FROM en e JOIN lags l ON e.gameId = l.gameId AND e.possession_id = l.possession_id
WHERE e.actionType = 'timeout' AND pl6 IS NOT NULL AND pf6 IS NOT NULL"""

PARTS["evw1"] = f"""
SELECT *, calling_team = home_teamId AS is_home_calling,
  CASE WHEN calling_team = home_teamId THEN away_teamId ELSE home_teamId END AS opponent_team,
  {side_sum('l', 'calling_team', '=')} AS pts_for_pre, {side_sum('l', 'calling_team', '<>')} AS pts_against_pre,
  {side_sum('f', 'calling_team', '=')} AS pts_for_post, {side_sum('f', 'calling_team', '<>')} AS pts_against_post,
  {side_sum('l', 'calling_team', '=', True)} AS n_for_pre, {side_sum('l', 'calling_team', '<>', True)} AS n_against_pre,
  {side_sum('f', 'calling_team', '=', True)} AS n_for_post, {side_sum('f', 'calling_team', '<>', True)} AS n_against_post
FROM evw0"""

PARTS["evw"] = """
SELECT *, pts_for_pre - pts_against_pre AS net_pre, pts_for_post - pts_against_post AS net_post,
  (pts_for_post - pts_against_post) - (pts_for_pre - pts_against_pre) AS net_change,
  pts_for_pre / nullif(n_for_pre, 0) AS ppp_for_pre, pts_for_post / nullif(n_for_post, 0) AS ppp_for_post,
  CASE WHEN is_home_calling THEN streak ELSE -streak END AS streak_signed,
  CASE WHEN is_home_calling THEN score_margin ELSE -score_margin END AS margin_calling,
  CASE WHEN period <= 3 THEN 'Q' || period WHEN period = 4 AND seconds_remaining > 300 THEN 'Q4_early'
    WHEN period = 4 THEN 'Q4_clutch' ELSE 'OT' END AS time_bucket
FROM evw1"""

PARTS["evb"] = """
SELECT e.*, a.ppp AS calling_team_ppp, b.ppp AS opponent_team_ppp, h.pt_diff_per_poss AS h2h_pt_diff_per_poss,
  net_post - 3 * (a.ppp - b.ppp) AS excess_net_post, net_post - 3 * h.pt_diff_per_poss AS excess_h2h_net_post,
  ppp_for_post - a.ppp AS excess_ppp_for_post
FROM evw e LEFT JOIN ppp a ON a.season = e.season AND a.season_type = e.season_type AND a.teamId = e.calling_team
LEFT JOIN ppp b ON b.season = e.season AND b.season_type = e.season_type AND b.teamId = e.opponent_team
LEFT JOIN h2h h ON h.season = e.season AND h.season_type = e.season_type AND h.calling_team = e.calling_team
  AND h.opponent_team = e.opponent_team"""

PARTS["stints0"] = f"""
SELECT gameId, orderNumber, personId, teamId, season, season_type, game_seconds_elapsed AS i,
  coalesce(lead(game_seconds_elapsed) OVER (PARTITION BY gameId, teamId ORDER BY orderNumber), 2880) AS o FROM spine WHERE actionType = 'substitution'"""

PARTS["stints"] = """
SELECT *, row_number() OVER (PARTITION BY gameId, personId ORDER BY i, orderNumber) AS stint_id FROM stints0"""

PARTS["rot"] = """
SELECT gameId, orderNumber, personId AS PERSON_ID, teamId AS TEAM_ID, i * 10 AS tin,
  o * 10 + CASE WHEN orderNumber % 10 = 0 THEN 15000 ELSE 0 END AS tout, orderNumber % 7 AS ppts, orderNumber % 11 - 5 AS pdiff FROM stints"""

PARTS["adv"] = """
SELECT c_custkey AS PLAYER_ID, 2020 + c_custkey % 3 AS season_int,
  CASE WHEN c_custkey % 17 < 10 THEN 100 + c_custkey % 17 ELSE 190 + c_custkey % 17 END AS TEAM_ID,
  c_acctbal / 1000 AS NET_RATING, c_custkey % 82 + 1 AS GP FROM customer"""

PARTS["net"] = """
SELECT TEAM_ID AS teamId, season_int AS season, sum(NET_RATING * GP) / sum(GP) AS team_net_rating FROM adv GROUP BY ALL"""

PARTS["pss0"] = """
SELECT o_custkey AS PLAYER_ID, 2020 + year(o_orderdate) % 3 AS season_int, 'rg' AS season_type,
  o_orderpriority AS TEAM_ABBREVIATION, count(*) AS GP, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS PTS
FROM orders GROUP BY ALL"""

PARTS["pss"] = """
SELECT * FROM pss0 UNION ALL
SELECT PLAYER_ID, season_int, season_type, 'TOT', CAST(sum(GP) AS BIGINT), CAST(sum(PTS) AS BIGINT)
FROM pss0 GROUP BY 1, 2, 3 HAVING count(*) > 1"""

PARTS["pss1"] = """
SELECT * FROM pss QUALIFY row_number() OVER (PARTITION BY PLAYER_ID, season_int, season_type
  ORDER BY TEAM_ABBREVIATION <> 'TOT', TEAM_ABBREVIATION) = 1"""

PARTS["box"] = """
SELECT gameId, personId, max(teamId) AS box_team, CAST(sum(points_scored) AS BIGINT) AS points,
  count(*) FILTER (WHERE actionType IN ('2pt', '3pt')) AS fieldGoalsAttempted,
  count(*) FILTER (WHERE actionType IN ('2pt', '3pt') AND points_scored > 1) AS fieldGoalsMade FROM spine GROUP BY ALL"""

PARTS["old"] = """
SELECT gameId, orderNumber, period, seconds_remaining, game_seconds_elapsed, teamId, scoreHome, scoreAway, points_scored,
  2013 + gameId % 6 AS season, orderNumber % 4 AS personId,
  CASE WHEN actionType = 'timeout' THEN 'Timeout' ELSE actionType END AS actionType,
  CASE WHEN actionType = 'timeout' THEN CASE WHEN orderNumber % 4 = 0 THEN 'Official TV' WHEN subType = 'challenge' THEN 'Coach Challenge'
    WHEN k % 3 = 0 THEN 'Short' ELSE 'Regular' END END AS subType
FROM spine"""

PARTS["oldto"] = """
SELECT *, subType = 'Coach Challenge' AS ch, season < 2017 AS early FROM old WHERE actionType = 'Timeout'"""

# samples of the hypothesis tests: points per possession, a = right after an
# intervention, b = the rest; and makes of shots at home against away
PARTS["samp"] = """
SELECT e.gameId, e.orderNumber, e.season_type, e.season, CAST(e.possession_points AS DOUBLE) AS x,
  CASE WHEN e.prev_action_type = 'timeout' THEN 'a' ELSE 'b' END AS sample
FROM en e JOIN (SELECT gameId, possession_id, min(orderNumber) AS orderNumber FROM en WHERE possession_id IS NOT NULL
  GROUP BY ALL) f USING (gameId, orderNumber)"""

PARTS["shots"] = """
SELECT gameId, orderNumber, season_type, CASE WHEN shotResult = 'Made' THEN 1.0 ELSE 0.0 END AS x,
  CASE WHEN teamId = home_teamId THEN 'a' ELSE 'b' END AS sample FROM plays WHERE isFieldGoal = 1"""



def oracle(body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` behind the CTEs it uses, each stated once in dependency order."""
    local = extra or {}
    known = {**PARTS, **local}
    used: list[str] = []

    def visit(sql: str):
        for name in known:
            if name not in used and known[name] is not sql and re.search(rf"(?:FROM|JOIN)\s+{name}\b", sql):
                visit(known[name])
                if name not in used:
                    used.append(name)

    visit(body)
    if not used:
        return body.strip()
    return "WITH " + ",\n".join(f"{n} AS ({known[n].strip()})" for n in used) + "\n" + body.strip()


def r6(expr: str, alias: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) + 0.0 AS {alias}"
