"""Registered queries: joins, aggregations, windows, sorting, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from eddyline.catalog.common import longs, r6, rounded
from eddyline.catalog.oracle_parts import BEFORE, UPTO, W, oracle
from eddyline.catalog.oracle_parts import r6 as R
from eddyline.functions import columns as C
from eddyline.operators import aggregates as A
from eddyline.operators import joins, matching
from eddyline.operators.asof import nearest_shifted
from eddyline.operators.scan import Changes, Lag, Max, Sum, scan
from eddyline.streaming import ordered
from eddyline.plans import classify, cleaning, impact, questions, state, windows
from eddyline.config import SPINE as S

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


def by_order(t, steps, rows=None, keys=("gameId",)):
    return scan(rows if rows is not None else t.enriched, list(keys), ["orderNumber"], S.order_block(), steps)


# --- joins ---------------------------------------------------------------------


@register("join_inner_key", "SELECT p.gameId, p.possession_id, timeout_team, possession_points FROM possn p JOIN tokeys USING (gameId, possession_id)")
def _(t):
    return t.possessions.join(windows.timeout_keys(t.enriched), ["gameId", "possession_id"]).select(
        "gameId", "possession_id", "timeout_team", "possession_points"
    )


@register("join_left_key", f"SELECT {KEY}, home_teamId, {R('ppp', 'ppp')} FROM spine s LEFT JOIN home USING (gameId) LEFT JOIN ppp p ON p.season = s.season AND p.season_type = s.season_type AND p.teamId = s.teamId")
def _(t):
    rates = state.team_season_ppp(t.possessions).select("season", "season_type", "teamId", "ppp")
    rows = t.spine.join(state.home_team(t.spine), "gameId", "left").join(rates, ["season", "season_type", "teamId"], "left")
    return rows.select(*key, "home_teamId", r6("ppp"))


@register("join_anti_key", "SELECT p.gameId, p.possession_id FROM possn p WHERE NOT EXISTS (SELECT 1 FROM tokeys k WHERE k.gameId = p.gameId AND k.possession_id = p.possession_id)")
def _(t):
    return t.possessions.join(windows.timeout_keys(t.enriched), ["gameId", "possession_id"], "left_anti").select("gameId", "possession_id")


@register("join_self_pairs", "SELECT gameId, teamA, teamB FROM pairs")
def _(t):
    return state.team_pairs(t.spine)


@register("join_offset_keys", "SELECT e.gameId, e.orderNumber, o.x AS off, p.possession_id AS target FROM en e JOIN (SELECT unnest(range(1, 6)) AS x) o ON TRUE JOIN possn p ON p.gameId = e.gameId AND p.possession_id = e.possession_id + o.x WHERE e.actionType = 'timeout'")
def _(t):
    rows = windows.post_event_possessions(t.enriched, t.possessions)
    return rows.select(*key, F.col("offset").alias("off"), (F.col("possession_id") + F.col("offset")).alias("target"))


@register("join_pre_post_keys", "SELECT e.gameId, e.orderNumber, a.score_margin AS pre_margin, b.score_margin AS post_margin FROM en e LEFT JOIN possn a ON a.gameId = e.gameId AND a.possession_id = e.possession_id - 6 LEFT JOIN possn b ON b.gameId = e.gameId AND b.possession_id = e.possession_id + 6 WHERE e.actionType = 'timeout'")
def _(t):
    look = t.possessions.select("gameId", "possession_id", "score_margin")
    rows = t.enriched.where("actionType = 'timeout'").select(*key, "possession_id")
    for name, shift in (("pre", -6), ("post", 6)):
        at = look.withColumnsRenamed({"possession_id": "_at", "score_margin": f"{name}_margin"})
        rows = rows.withColumn("_at", F.col("possession_id") + shift).join(at, ["gameId", "_at"], "left").drop("_at")
    return rows.drop("possession_id")


def _near(t, seconds):
    states = impact.clock_states(t.spine)
    return nearest_shifted(t.spine, states, ["gameId"], S.clock, [seconds], S.clock_span, ["h", "a", "o"])


@register("join_asof_nearest", f"SELECT s.gameId, s.orderNumber, n.ng AS match_clock, n.o AS match_order FROM spine s JOIN near180 n ON s.gameId = n.gameId AND s.game_seconds_elapsed = n.g")
def _(t):
    rows = t.spine.join(_near(t, 180), ["gameId", S.clock])
    return rows.select(*key, F.col("match")[S.clock].alias("match_clock"), F.col("match")["o"].alias("match_order"))


@register("join_asof_nearest_behind", "SELECT c.gameId, c.g, n.g AS ng FROM clk c JOIN clk n USING (gameId) QUALIFY row_number() OVER (PARTITION BY c.gameId, c.g ORDER BY abs(n.g - (c.g - 120)), n.g DESC) = 1")
def _(t):
    return _near(t, -120).select("gameId", F.col(S.clock).alias("g"), F.col("match")[S.clock].alias("ng"))


ASOF_SQL = """SELECT s.gameId, s.orderNumber, CASE WHEN s.game_seconds_elapsed < x.o THEN x.orderNumber END AS stint_order
FROM spine s LEFT JOIN (SELECT * FROM stints) x ON x.gameId = s.gameId AND x.personId = s.personId AND x.i <= s.game_seconds_elapsed
QUALIFY row_number() OVER (PARTITION BY s.gameId, s.orderNumber ORDER BY x.i DESC NULLS LAST, x.orderNumber DESC NULLS LAST) = 1"""


@register("join_asof_backward_bounded", ASOF_SQL)
def _(t):
    spans = t.stints.withColumn("stint_order", F.col("orderNumber")).drop("orderNumber")
    rows = joins.asof_backward_bounded(
        t.spine.select(*key, "personId", S.clock), spans, ["gameId", "personId"], S.clock, "in_game_seconds", "out_game_seconds",
        ["stint_order"], "stint_order", S.clock_span,
    )
    return rows.select(*key, "stint_order")


@register(
    "join_asof_rotations",
    """SELECT s.gameId, s.orderNumber, CASE WHEN s.game_seconds_elapsed * 10 < x.tout THEN x.orderNumber END AS rot_order
FROM spine s LEFT JOIN (SELECT * FROM rot) x ON x.gameId = s.gameId AND x.PERSON_ID = s.personId AND x.tin <= s.game_seconds_elapsed * 10
QUALIFY row_number() OVER (PARTITION BY s.gameId, s.orderNumber ORDER BY x.tin DESC NULLS LAST, x.orderNumber DESC NULLS LAST) = 1""",
)
def _(t):
    spans = t.rotations.select("gameId", F.col("PERSON_ID").alias("personId"), "IN_TIME_REAL", "OUT_TIME_REAL", F.col("orderNumber").alias("rot_order"))
    points = t.spine.select(*key, "personId", (F.col(S.clock) * 10).alias("tenths"))
    rows = joins.asof_backward_bounded(
        points, spans, ["gameId", "personId"], "tenths", "IN_TIME_REAL", "OUT_TIME_REAL", ["rot_order"], "rot_order", S.clock_span
    )
    return rows.select(*key, "rot_order")


@register("join_interval", "SELECT s.gameId, s.orderNumber, x.orderNumber AS stint_order FROM spine s JOIN (SELECT * FROM stints) x ON x.gameId = s.gameId AND x.teamId = s.teamId AND s.game_seconds_elapsed >= x.i AND s.game_seconds_elapsed < x.o")
def _(t):
    spans = t.stints.select("gameId", "teamId", F.col("orderNumber").alias("stint_order"), "in_game_seconds", "out_game_seconds")
    rows = joins.interval_join(t.spine.select(*key, "teamId", S.clock), spans, ["gameId", "teamId"], S.clock, "in_game_seconds", "out_game_seconds", 120)
    return rows.select(*key, "stint_order")


@register("join_band_match", "SELECT gameId, orderNumber, c_order FROM twin")
def _(t):
    rows = t.rich
    pairs = matching.matched_twins(rows.where("group <> 'control'"), rows.where("group = 'control'"))
    return pairs.select(*key, "c_order")


@register("join_window_count", "SELECT a.gameId, a.orderNumber, count(b.orderNumber) AS n_subs FROM spine a LEFT JOIN (SELECT * FROM spine WHERE actionType = 'substitution') b ON a.gameId = b.gameId AND abs(a.game_seconds_elapsed - b.game_seconds_elapsed) <= 30 GROUP BY ALL")
def _(t):
    subs = t.spine.where("actionType = 'substitution'")
    return joins.count_within(t.spine.select(*key, S.clock), subs, ["gameId"], S.clock, 30, "n_subs").select(*key, "n_subs")


@register(
    "join_nearest_outcome",
    """SELECT c.gameId, c.orderNumber, o.descriptor FROM (SELECT * FROM spine WHERE subType = 'challenge') c
LEFT JOIN (SELECT * FROM spine WHERE descriptor IS NOT NULL) o ON o.gameId = c.gameId AND o.period = c.period
AND abs(o.game_seconds_elapsed - c.game_seconds_elapsed) <= 60
QUALIFY row_number() OVER (PARTITION BY c.gameId, c.orderNumber ORDER BY abs(o.game_seconds_elapsed - c.game_seconds_elapsed) NULLS LAST,
o.game_seconds_elapsed DESC, o.orderNumber DESC) = 1""",
)
def _(t):
    calls = t.spine.where("subType = 'challenge'").select(*key, "period", S.clock)
    outcomes = t.spine.where("descriptor is not null")
    return joins.nearest_outcome(calls, outcomes, ["gameId", "period"], S.clock, ["descriptor"], "orderNumber", 60, S.clock_span).select(*key, "descriptor")


TRIG = {
    "sr0": f"SELECT *, CASE WHEN lag(teamId) OVER ({W}) = teamId THEN 0 ELSE 1 END AS nw FROM spine WHERE points_scored > 0",
    "sr1": f"SELECT *, sum(nw) OVER ({W} {UPTO}) AS run_id FROM sr0",
    "sr2": f"SELECT *, sum(points_scored) OVER (PARTITION BY gameId, run_id ORDER BY orderNumber {UPTO}) AS rp FROM sr1",
    "trg": "SELECT gameId, run_id, min(orderNumber) AS orderNumber, arg_min(game_seconds_elapsed, orderNumber) AS g, max(teamId) AS run_team FROM sr2 WHERE rp >= 6 GROUP BY gameId, run_id",
}


@register("join_first_after", "SELECT t.gameId, t.orderNumber, min(e.orderNumber) AS to_order FROM trg t LEFT JOIN (SELECT * FROM spine WHERE actionType = 'timeout') e ON e.gameId = t.gameId AND e.orderNumber > t.orderNumber AND e.game_seconds_elapsed BETWEEN t.g AND t.g + 60 GROUP BY ALL", TRIG)
def _(t):
    triggers = questions.run_triggers(t.spine)
    calls = t.spine.where("actionType = 'timeout'")
    found = joins.first_after(triggers.select(*key, S.clock), calls, ["gameId"], S, (), 60, "to_")
    return found.select(*key, F.col("to_orderNumber").alias("to_order"))


@register("join_forward_sum", "SELECT t.gameId, t.orderNumber, CAST(coalesce(sum(e.points_scored) FILTER (WHERE e.teamId = t.run_team), 0) AS BIGINT) AS mine, CAST(coalesce(sum(e.points_scored) FILTER (WHERE e.teamId <> t.run_team), 0) AS BIGINT) AS theirs FROM trg t LEFT JOIN spine e ON e.gameId = t.gameId AND e.game_seconds_elapsed > t.g AND e.game_seconds_elapsed <= t.g + 180 GROUP BY ALL", TRIG)
def _(t):
    rows = t.enriched.where("points_scored > 0")
    triggers = questions.run_triggers(t.spine).withColumnRenamed("teamId", "run_team")
    out = questions.next_points(triggers, rows, 180)
    zero = F.lit(0).cast("long")
    return out.select(*key, F.coalesce("next_run", zero).alias("mine"), F.coalesce("next_other", zero).alias("theirs"))


@register("lookup_boxscore", f"SELECT {KEY}, b.points, b.fieldGoalsMade FROM spine s LEFT JOIN box b USING (gameId, personId)")
def _(t):
    return t.spine.join(t.boxscores, ["gameId", "personId"], "left").select(*key, "points", "fieldGoalsMade")


@register("lookup_player_advanced", f"SELECT {KEY}, a.GP, {R('a.NET_RATING', 'net_rating')} FROM spine s LEFT JOIN adv a ON a.PLAYER_ID = s.personId AND a.season_int = s.season")
def _(t):
    look = t.player_advanced.select(F.col("PLAYER_ID").alias("personId"), F.col("season_int").alias("season"), "GP", "NET_RATING")
    return t.spine.join(look, ["personId", "season"], "left").select(*key, "GP", r6("NET_RATING", "net_rating"))


@register("lookup_player_season", f"SELECT {KEY}, p.TEAM_ABBREVIATION AS team, p.PTS FROM spine s LEFT JOIN pss1 p ON p.PLAYER_ID = s.personId AND p.season_int = s.season AND p.season_type = s.season_type")
def _(t):
    one = joins.prefer_total_row(t.player_season, ["PLAYER_ID", "season_int", "season_type"])
    one = one.withColumnsRenamed({"PLAYER_ID": "personId", "season_int": "season"})
    return t.spine.join(one, ["personId", "season", "season_type"], "left").select(*key, F.col("TEAM_ABBREVIATION").alias("team"), "PTS")


@register(
    "join_v2_wallclock",
    f"""SELECT {KEY}, w.m AS wc_minute FROM raw r LEFT JOIN (SELECT gameId, period, seconds_remaining, arg_min((hour(timeActual) % 12) * 60 + minute(timeActual), orderNumber) AS m
FROM raw WHERE orderNumber % 4 <> 0 GROUP BY 1, 2, 3) w USING (gameId, period, seconds_remaining)""",
)
def _(t):
    keys = ["gameId", "period", "seconds_remaining"]
    oldest = t.spine.withColumn("wc_minute", F.when(F.col("orderNumber") % 4 != 0, C.wall_minute(F.date_format("timeActual", "h:mm a"))))
    look = joins.first_per_clock(oldest, keys, "wc_minute", "orderNumber")
    return t.spine.join(look, keys, "left").select(*key, "wc_minute")


@register("join_shot_link", "SELECT a.gameId, a.orderNumber, b.orderNumber AS shot_order, b.points_scored AS shot_points FROM (SELECT *, orderNumber - 1 - orderNumber % 97 AS link FROM plays WHERE actionType = 'rebound') a JOIN plays b ON a.gameId = b.gameId AND a.link = b.orderNumber")
def _(t):
    o = F.col("orderNumber")
    rebounds = t.plays.where("actionType = 'rebound'").select(*key, (o - 1 - o % 97).alias("link"))
    shots = t.plays.select("gameId", o.alias("link"), o.alias("shot_order"), F.col("points_scored").alias("shot_points"))
    return rebounds.join(shots, ["gameId", "link"]).drop("link")


@register("join_correlated_first", "SELECT DISTINCT r.gameId, r.run_team, (SELECT min(teamB) FROM pairs p WHERE p.gameId = r.gameId AND p.teamA = r.run_team) AS opp_team FROM trg r", TRIG)
def _(t):
    runs = questions.run_triggers(t.spine).select("gameId", F.col("teamId").alias("run_team")).distinct()
    return runs.join(questions.opponents(t.spine), ["gameId", "run_team"], "left")


# --- aggregations -----------------------------------------------------------------

POSS = ["gameId", "possession_id", "period", S.clock, "seconds_remaining", "score_margin", "streak", "season", "season_type", "possession", "possession_points"]


@register("possessions", f"SELECT {', '.join(POSS)} FROM possn")
def _(t):
    return t.possessions.select(*POSS)


@register("possession_points", f"SELECT {KEY}, possession_points FROM en WHERE possession_id IS NOT NULL")
def _(t):
    rows = state.with_possession_points(state.with_possession_id(t.spine))
    return rows.where("possession_id is not null").select(*key, "possession_points")


@register("possession_outcome", "SELECT gameId, possession_id, possession_outcome FROM outc")
def _(t):
    return state.possession_outcomes(t.plays)


@register("final_score", "SELECT * FROM fin")
def _(t):
    return state.final_score(t.spine)


@register("home_team", "SELECT * FROM home")
def _(t):
    return state.home_team(t.spine)


@register("home_away", "SELECT gameId, teamA AS home_teamId, teamB AS away_teamId FROM pairs JOIN home ON pairs.gameId = home.gameId AND teamA = home_teamId".replace("SELECT gameId", "SELECT pairs.gameId"))
def _(t):
    return state.home_away(t.spine)


@register("away_team", "SELECT * FROM away")
def _(t):
    return state.away_team(t.spine)


@register("team_season_ppp", f"SELECT season, season_type, teamId, total_pts, n_poss, {R('ppp', 'ppp')} FROM ppp")
def _(t):
    return rounded(state.team_season_ppp(t.possessions), ["ppp"])


@register("team_season_record", f"SELECT season, teamId, wins, losses, {R('wpct', 'wpct')} FROM rec")
def _(t):
    return rounded(state.team_season_record(t.spine), ["wpct"])


@register("h2h_diff", f"SELECT season, season_type, calling_team, opponent_team, n_games, total_pt_diff, total_poss, {R('pt_diff_per_poss', 'pt_diff_per_poss')} FROM h2h")
def _(t):
    return rounded(state.head_to_head(t.spine, t.possessions), ["pt_diff_per_poss"])


@register("team_net_rating", f"SELECT teamId, season, {R('team_net_rating', 'team_net_rating')} FROM net")
def _(t):
    return rounded(state.team_net_rating(t.player_advanced), ["team_net_rating"])


STATS_SQL = f"count(*) AS n, {R('avg(x)', 'mean')}, {R('stddev_samp(x)', 'std_samp')}, {R('stddev_pop(x)', 'std_pop')}"


@register("group_stats", f"SELECT grp AS \"group\", {STATS_SQL} FROM (SELECT grp, recovery AS x FROM ana) q GROUP BY grp")
def _(t):
    return rounded(A.group_stats(impact.run_impact(t.enriched), ["group"], "recovery"), ["mean", "std_samp", "std_pop"])


@register("mean_ci95", f"SELECT season_type, count(*) AS n, {R('avg(possession_points)', 'mean')}, {R('avg(possession_points) - 1.96 * stddev_samp(possession_points) / sqrt(count(*))', 'ci_low')}, {R('avg(possession_points) + 1.96 * stddev_samp(possession_points) / sqrt(count(*))', 'ci_high')} FROM possn GROUP BY season_type")
def _(t):
    return rounded(A.mean_ci(t.possessions, ["season_type"], "possession_points"), ["mean", "ci_low", "ci_high"])


MASKS = {
    "timeout": "prev_action_type = 'timeout'",
    "clutch": "is_clutch",
    "home": "teamId = home_teamId",
}
MASKED = {"mk": " UNION ALL ".join(f"SELECT '{n}' AS mask, value AS v FROM en WHERE {c}" for n, c in MASKS.items())}


@register("masked_hist", f"SELECT mask, bin, n, (bin * 5.0)::DOUBLE AS bin_start, {R('n / sum(n) OVER (PARTITION BY mask)', 'probability')}, {R('n / sum(n) OVER (PARTITION BY mask) / 5', 'density')} FROM (SELECT mask, CASE WHEN v = 100 THEN 19 ELSE floor(v / 5)::BIGINT END AS bin, count(*) AS n FROM mk WHERE v BETWEEN 0 AND 100 GROUP BY ALL) q", MASKED)
def _(t):
    masks = {n: F.expr(c) for n, c in MASKS.items()}
    return rounded(A.masked_hist(t.enriched, masks, "value", 0, 5, 20), ["probability", "density"])


@register("masked_stats", f"SELECT mask, {STATS_SQL} FROM (SELECT mask, v AS x FROM mk) q GROUP BY mask", MASKED)
def _(t):
    masks = {n: F.expr(c) for n, c in MASKS.items()}
    return rounded(A.masked_stats(t.enriched, masks, "value"), ["mean", "std_samp", "std_pop"])


@register("ecdf", f"SELECT l_returnflag, l_quantity, n, {R('sum(n) OVER (PARTITION BY l_returnflag ORDER BY l_quantity) / sum(n) OVER (PARTITION BY l_returnflag)', 'ecdf')} FROM (SELECT l_returnflag, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL) q")
def _(t):
    return rounded(A.ecdf(t.raw("lineitem"), ["l_returnflag"], "l_quantity"), ["ecdf"])


@register("value_counts", "SELECT timeout_cause, count(*) AS n FROM en GROUP BY timeout_cause")
def _(t):
    return A.value_counts(t.enriched, "timeout_cause")


@register("crosstab_margins", """SELECT coalesce(timeout_role, 'All') AS timeout_role, count(*) FILTER (WHERE season_type = 'rg') AS rg, count(*) FILTER (WHERE season_type = 'po') AS po, count(*) AS "All"
FROM en WHERE actionType = 'timeout' GROUP BY ROLLUP (timeout_role)""")
def _(t):
    return A.crosstab_margins(t.enriched.where("actionType = 'timeout'"), "timeout_role", "season_type", ["rg", "po"])


def _share(within):
    base = "timeout_cause" if within == "row" else "season"
    sql = f"SELECT timeout_cause, season, n, {R(f'n / sum(n) OVER (PARTITION BY {base})', 'share')} FROM (SELECT timeout_cause, season, count(*) AS n FROM en WHERE actionType = 'timeout' GROUP BY ALL) q"

    @register(f"crosstab_normalized_{within}", sql)
    def query(t):
        return rounded(A.crosstab_normalized(t.enriched.where("actionType = 'timeout'"), "timeout_cause", "season", within), ["share"])


_share("row")
_share("column")


@register("counts_per_group_hist", "SELECT k, count(*) AS n_groups FROM (SELECT gameId, period, count(*) FILTER (WHERE timeout_cause = 'tv_mandatory') AS k FROM en GROUP BY ALL) q GROUP BY k")
def _(t):
    return A.counts_per_group_hist(t.enriched, t.enriched, ["gameId", "period"], F.col("timeout_cause") == "tv_mandatory")


@register("role_by_period", "SELECT period, timeout_role, count(*) AS n FROM en WHERE actionType = 'timeout' GROUP BY ALL")
def _(t):
    return t.enriched.where("actionType = 'timeout'").groupBy("period", "timeout_role").agg(F.count("*").alias("n"))


@register("share_by_key", f"SELECT teamId, count(*) AS n, {R('avg((timeout_cause = {0}tv_mandatory{0})::INT)'.format(chr(39)), 'share')} FROM en WHERE actionType = 'timeout' GROUP BY teamId")
def _(t):
    rows = t.enriched.where("actionType = 'timeout'")
    return rounded(A.share_by_key(rows, "teamId", F.col("timeout_cause") == "tv_mandatory"), ["share"])


@register("median_by_group", f"SELECT l_returnflag, count(*) AS n, {R('median(l_extendedprice)', 'median')} FROM lineitem GROUP BY l_returnflag")
def _(t):
    return rounded(A.exact_median(t.raw("lineitem"), ["l_returnflag"], "l_extendedprice"), ["median"])


@register("histogram", f"SELECT l_returnflag, bin, n, (1 + bin * 7.0)::DOUBLE AS bin_start, {R('n / sum(n) OVER (PARTITION BY l_returnflag)', 'probability')}, {R('n / sum(n) OVER (PARTITION BY l_returnflag) / 7', 'density')} FROM (SELECT l_returnflag, CASE WHEN l_quantity = 50 THEN 6 ELSE floor((l_quantity - 1) / 7)::BIGINT END AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 1 AND 50 GROUP BY ALL) q")
def _(t):
    return rounded(A.histogram(t.raw("lineitem"), ["l_returnflag"], "l_quantity", 1, 7, 7), ["probability", "density"])


@register("histogram_widths", "SELECT width, bin, count(*) AS n, bin * width AS bin_start FROM (SELECT w.width, least(floor(seconds_remaining / w.width), ceil(720 / w.width) - 1)::BIGINT AS bin FROM spine CROSS JOIN (SELECT unnest([10.0::DOUBLE, 30.0, 60.0]) AS width) w WHERE actionType = 'timeout') q GROUP BY ALL")
def _(t):
    return A.histogram_widths(t.spine.where("actionType = 'timeout'"), [], "seconds_remaining", 0, 720, [10, 30, 60])


@register("hexbin", f"""SELECT r AS "row", c AS "col", {R('c * w + sh', 'x')}, {R('r * 22.5', 'y')}, attempts, {R('100.0 * made / attempts', 'pct_made')} FROM (
SELECT r, c, w, any_value(sh) AS sh, count(*) AS attempts, count(*) FILTER (WHERE points_scored > 1) AS made FROM (
SELECT *, round_even((x - sh) / w, 0)::BIGINT AS c FROM (SELECT *, CASE WHEN abs(r) % 2 = 1 THEN w / 2 ELSE 0 END AS sh FROM (
SELECT points_scored, value * 4 - 200 AS x, (k * 4)::DOUBLE AS y, round_even((k * 4)::DOUBLE / 22.5::DOUBLE, 0)::BIGINT AS r, sqrt(3.0::DOUBLE) * 15 AS w
FROM spine WHERE actionType IN ('2pt', '3pt')) a) b) d GROUP BY r, c, w) e
WHERE attempts >= 5 AND r * 22.5 BETWEEN -60 AND 470 AND abs(c * w + sh) <= 260""")
def _(t):
    shots = t.spine.where("actionType in ('2pt', '3pt')")
    rows = shots.withColumn("x", F.col("value") * 4 - 200).withColumn("y", (F.col("k") * 4).cast("double"))
    return rounded(A.hexbin(rows, "x", "y", F.col("points_scored") > 1), ["x", "y", "pct_made"])


@register("heatmap_2d", f"SELECT floor(l_quantity / 10)::BIGINT AS x_bin, floor(l_discount * 100 / 2)::BIGINT AS y_bin, {R('avg(l_extendedprice)', 'mean_value')}, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 20")
def _(t):
    x, y = F.floor(F.col("l_quantity") / 10), F.floor(F.col("l_discount") * 100 / 2)
    return rounded(A.heatmap_2d(t.raw("lineitem"), x, y, "l_extendedprice", 20), ["mean_value"])


DESCRIBED = ("l_quantity", "l_extendedprice", "l_discount")


@register("describe", " UNION ALL ".join(f"""SELECT '{c}' AS "column", count({c}) AS n, {R(f'avg({c})', 'mean')}, {R(f'stddev_samp({c})', 'std')}, {R(f'min({c})', 'min')},
{R(f'quantile_cont({c}::DOUBLE, 0.25)', 'q25')}, {R(f'quantile_cont({c}::DOUBLE, 0.5)', 'q50')}, {R(f'quantile_cont({c}::DOUBLE, 0.75)', 'q75')}, {R(f'max({c})', 'max')} FROM lineitem""" for c in DESCRIBED))
def _(t):
    out = A.describe(t.raw("lineitem").select(*DESCRIBED))
    return rounded(out, ["mean", "std", "min", "q25", "q50", "q75", "max"])


@register("distinct_count", "SELECT count(DISTINCT gameId) AS \"n_gameId\", count(DISTINCT personId) AS \"n_personId\" FROM raw")
def _(t):
    return A.distinct_count(t.spine, ["gameId", "personId"])


@register("weighted_effect", f"SELECT {R('sum(e * n) / sum(n)', 'weighted_effect')}, CAST(sum(n) AS BIGINT) AS n FROM (SELECT l_returnflag, avg(l_discount) AS e, count(*) AS n FROM lineitem GROUP BY 1) q")
def _(t):
    parts = t.raw("lineitem").groupBy("l_returnflag").agg(F.avg("l_discount").alias("e"), F.count("*").alias("n"))
    return rounded(A.weighted_effect(parts, "e", "n"), ["weighted_effect"])


# --- windows ------------------------------------------------------------------------


@register("lag_lead_k", "SELECT gameId, possession_id, " + ", ".join(f"pl{i} AS pts_lag{i}, tl{i} AS tm_lag{i}, pf{i} AS pts_lead{i}, tf{i} AS tm_lead{i}" for i in range(1, 7)) + " FROM lags")
def _(t):
    rows = windows.lag_lead(t.possessions.select("gameId", "possession_id", "possession_points", "possession"), 6)
    cols = [f"{p}{i}" for i in range(1, 7) for p in ("pts_lag", "tm_lag", "pts_lead", "tm_lead")]
    return rows.select("gameId", "possession_id", *cols)


@register("trailing_forward_net", "SELECT gameId, possession_id, trailing_net, forward_net FROM nets")
def _(t):
    return windows.trailing_forward_net(t.possessions, 6).select("gameId", "possession_id", "trailing_net", "forward_net")


@register("prev_value", f"SELECT {KEY}, lag(actionType) OVER ({W}) AS prev_action, lag(subType) OVER ({W}) AS prev_sub FROM raw")
def _(t):
    rows = by_order(t, [Lag("prev_action", F.col("actionType")), Lag("prev_sub", F.col("subType"))], t.spine)
    return rows.select(*key, "prev_action", "prev_sub")


@register("wall_clock_delta", f"SELECT {KEY}, {R(f'(epoch_us(timeActual) - lag(epoch_us(timeActual)) OVER ({W})) / 1e6', 'wall_delta_s')} FROM raw")
def _(t):
    return rounded(cleaning.wall_clock_delta(t.spine).select(*key, "wall_delta_s"), ["wall_delta_s"])


@register("next_same_kind_delta", f"SELECT {KEY}, {R(f'(lead(epoch_us(timeActual)) OVER ({W}) - epoch_us(timeActual)) / 1e6', 'next_delta_s')} FROM raw WHERE actionType = 'timeout'")
def _(t):
    return rounded(classify.next_same_kind(t.spine), ["next_delta_s"])


@register("cummax_monotone", f"SELECT {KEY}, max(scoreHome - CASE WHEN orderNumber % 13 = 0 THEN 1 ELSE 0 END) OVER ({W} {UPTO}) AS scoreHome FROM spine")
def _(t):
    dip = F.when(F.col("orderNumber") % 13 == 0, F.lit(1)).otherwise(F.lit(0))
    rows = t.spine.withColumn("scoreHome", F.col("scoreHome") - dip)
    return cleaning.cummax_monotone(rows, ["scoreHome"]).select(*key, "scoreHome")


@register("next_resume_duration", f"""SELECT gameId, orderNumber, d AS timeout_duration_s FROM (SELECT gameId, orderNumber, actionType, CAST(floor((first_value(CASE WHEN actionType NOT IN ('substitution', 'stoppage') THEN epoch_us(timeActual) END IGNORE NULLS)
OVER ({W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - epoch_us(timeActual)) / 1000000.0) AS BIGINT) AS d FROM raw) q WHERE actionType = 'timeout' AND d BETWEEN 0 AND 36000""")
def _(t):
    rows = cleaning.next_resume_duration(t.spine, longest=36000)
    return rows.where("timeout_duration_s is not null").select(*key, "timeout_duration_s")


@register("cum_count_scope", f"""SELECT {KEY}, CAST(sum(f) OVER w AS BIGINT) AS cum_all, CAST(sum(f * h) OVER w AS BIGINT) AS cum_home, CAST(sum(f * v) OVER w AS BIGINT) AS cum_away FROM (
SELECT s.gameId, orderNumber, period, CASE WHEN actionType = 'timeout' AND subType <> 'challenge' THEN 1 ELSE 0 END AS f, CASE WHEN teamId = home_teamId THEN 1 ELSE 0 END AS h, CASE WHEN teamId <> home_teamId THEN 1 ELSE 0 END AS v
FROM spine s LEFT JOIN home USING (gameId)) q WINDOW w AS (PARTITION BY gameId, period ORDER BY orderNumber {UPTO})""")
def _(t):
    return classify.cumulative_by_scope(t.spine, state.home_team(t.spine)).select(*key, "cum_all", "cum_home", "cum_away")


@register("cum_mandatory", "SELECT gameId, orderNumber, CAST(rk AS BIGINT) AS rk FROM tos WHERE fl")
def _(t):
    rows = classify.prepare_interventions(t.spine, state.home_team(t.spine)).where("_flag")
    return rows.select(*key, F.col("_rank").alias("rk"))


@register("first_by_team", "SELECT gameId, orderNumber FROM tos WHERE is_first")
def _(t):
    return classify.prepare_interventions(t.spine, None).where("_is_first").select(*key)


@register("cum_ppp", f"SELECT gameId, possession_id, {R(f'sum(possession_points) OVER w / count(*) OVER w', 'team_cum_ppp')} FROM possn WINDOW w AS (PARTITION BY gameId, possession ORDER BY possession_id {UPTO})")
def _(t):
    return rounded(state.running_ppp(t.possessions).select("gameId", "possession_id", "team_cum_ppp"), ["team_cum_ppp"])


@register("segment_ids", f"SELECT {KEY}, CAST(sum(f) OVER ({W} {UPTO}) AS BIGINT) AS segment FROM (SELECT gameId, orderNumber, CASE WHEN lag(teamId) OVER ({W}) = teamId THEN 0 ELSE 1 END AS f FROM raw) q")
def _(t):
    return by_order(t, [Changes("segment", F.col("teamId"), F.lit(True))], t.spine).select(*key, "segment")


@register("stream_segment_ids", f"SELECT {KEY}, CAST(sum(f) OVER ({W} {UPTO}) AS BIGINT) AS segment FROM (SELECT gameId, orderNumber, CASE WHEN lag(teamId) OVER ({W}) = teamId THEN 0 ELSE 1 END AS f FROM raw) q")
def _(t):
    # the log as files that arrive in four chunks, a tenth of the rows one chunk late
    log = ordered.as_arrivals(t.spine.select(*key, "timeActual", "teamId"), "timeActual", "segments")
    return ordered.run_available(ordered.segment_ids(log, ["gameId"], "orderNumber", "timeActual", "teamId", "16 days"), "segments")


@register("first_in_group", "SELECT gameId, period, min(orderNumber) AS orderNumber, arg_min(actionType, orderNumber) AS actionType FROM raw GROUP BY gameId, period")
def _(t):
    return joins.first_in_group(t.spine.select("gameId", "period", "orderNumber", "actionType"), ["gameId", "period"], ["orderNumber"])


@register("first_value_per_key", "SELECT gameId, possession_id, arg_min(seconds_remaining, orderNumber) AS start_s FROM en WHERE possession_id IS NOT NULL GROUP BY ALL")
def _(t):
    rows = t.enriched.where("possession_id is not null")
    return rows.groupBy("gameId", "possession_id").agg(F.min_by("seconds_remaining", "orderNumber").alias("start_s"))


@register("threshold_crossing", "SELECT gameId, run_id::BIGINT AS run_id, orderNumber FROM trg", TRIG)
def _(t):
    return questions.run_triggers(t.spine).select("gameId", "run_id", "orderNumber")


@register("stint_number", "SELECT gameId, personId, orderNumber, stint_id FROM stints")
def _(t):
    return t.stints.select("gameId", "personId", "orderNumber", "stint_id")


@register("rank_avg", f"SELECT l_returnflag, l_quantity, n, {R('before + (n + 1) / 2', 'avg_rank')} FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY l_returnflag ORDER BY l_quantity {BEFORE}), 0) AS before FROM (SELECT l_returnflag, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL) a) b")
def _(t):
    from eddyline.plans import stats

    return rounded(stats.rank_avg(t.raw("lineitem"), ["l_returnflag"], "l_quantity"), ["avg_rank"])


@register("running_extremes", f"SELECT {KEY}, max(value) OVER ({W} {UPTO}) AS top, CAST(sum(points_scored) OVER ({W} {UPTO}) AS BIGINT) AS total FROM raw")
def _(t):
    return by_order(t, [Max("top", F.col("value")), Sum("total", F.col("points_scored"))], t.spine).select(*key, "top", "total")


# --- sort, limit, sets ------------------------------------------------------------------


@register("sort_event_order", f"SELECT {KEY}, timeActual::DATE AS day FROM raw")
def _(t):
    return t.spine.select(*key, F.to_date("timeActual").alias("day")).orderBy("day", "gameId", "orderNumber")


@register("sort_result", "SELECT time_bucket, sort_key::BIGINT AS sort_key, n FROM (SELECT time_bucket, count(*) AS n, CASE time_bucket WHEN 'Q1' THEN 0 WHEN 'Q2' THEN 1 WHEN 'Q3' THEN 2 WHEN 'Q4_early' THEN 3 WHEN 'Q4_clutch' THEN 4 ELSE 5 END AS sort_key FROM evw GROUP BY 1) q")
def _(t):
    order = ["Q1", "Q2", "Q3", "Q4_early", "Q4_clutch", "OT"]
    rows = t.events.groupBy("time_bucket").agg(F.count("*").alias("n"))
    position = F.array_position(F.array(*map(F.lit, order)), F.col("time_bucket")) - 1
    return rows.withColumn("sort_key", position.cast("long")).orderBy("sort_key")


@register("topk_values", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 5")
def _(t):
    return A.top_k_values(t.raw("part"), "p_brand", 5)


@register("keep_top_k", "SELECT p_partkey, p_brand FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 5)")
def _(t):
    return A.keep_top_k(t.raw("part"), "p_brand", 5).select("p_partkey", "p_brand")


@register("best_match", "SELECT gameId, orderNumber, c_order, (dist / 30.0)::DOUBLE AS dist FROM twin")
def _(t):
    rows = t.rich
    pairs = matching.matched_twins(rows.where("group <> 'control'"), rows.where("group = 'control'"))
    return pairs.select(*key, "c_order", F.col("dist").cast("double").alias("dist"))


@register("head_n", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity LIMIT 2000")
def _(t):
    cols = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"]
    return t.raw("lineitem").orderBy(*cols).limit(2000).select("l_orderkey", "l_partkey", "l_quantity")


@register("union_all", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def _(t):
    c = t.raw("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = t.raw("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return A.union_all([c, s])


@register("distinct_keys", "SELECT gameId, period, min(orderNumber) AS orderNumber FROM raw GROUP BY ALL")
def _(t):
    return joins.first_in_group(t.spine.select("gameId", "period", "orderNumber"), ["gameId", "period"], ["orderNumber"])


@register("set_difference", "SELECT DISTINCT l_partkey AS partkey FROM lineitem WHERE l_quantity > 45 EXCEPT SELECT l_partkey FROM lineitem WHERE l_discount < 0.02")
def _(t):
    li = t.raw("lineitem")
    many = li.where("l_quantity > 45").select(F.col("l_partkey").alias("partkey")).distinct()
    return many.join(li.where("l_discount < 0.02").select(F.col("l_partkey").alias("partkey")), "partkey", "left_anti")


@register("name_search", """SELECT term, p_partkey, name, rank FROM (SELECT term, p_partkey, lower(p_name) AS name, row_number() OVER (PARTITION BY term ORDER BY p_partkey) AS rank
FROM part JOIN (SELECT unnest(['red', 'widget', 'small', 'ring']) AS term) w ON contains(lower(p_name), term)) q WHERE rank <= 5""")
def _(t):
    name = F.lower(C.ascii_fold(F.col("p_name")))
    out = questions.name_search(t.raw("part"), "p_partkey", name, "Show me the red widget and small ring stats for 2024?")
    return longs(out, ["rank"])
