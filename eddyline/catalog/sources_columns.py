"""Registered queries: sources, projections, predicates."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from eddyline.catalog.common import longs, r6, rounded
from eddyline.catalog.oracle_parts import UPTO, W, oracle
from eddyline.catalog.oracle_parts import r6 as R
from eddyline.functions import columns as C
from eddyline.functions import predicates as P
from eddyline.operators import joins
from eddyline.plans import cleaning
from eddyline.session import shared_dir
from eddyline.sources import adapter, readers
from eddyline.tables import Tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return fn

    return keep


# --- sources -----------------------------------------------------------------

SEASON_COLUMNS = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"]
SEASON_SCHEMA = "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderpriority string, season int, season_type string"
SEASON_SQL = """SELECT *, year(o_orderdate) AS season, CASE WHEN month(o_orderdate) IN (5, 6) THEN 'po' ELSE 'rg' END AS season_type
FROM orders"""


def _season_rows(t: Tables):
    kind = F.when(F.month("o_orderdate").isin(5, 6), F.lit("po")).otherwise(F.lit("rg"))
    return t.raw("orders").withColumn("season", F.year("o_orderdate")).withColumn("season_type", kind)


@lru_cache(maxsize=8)
def _season_root(t: Tables) -> str:
    """Orders laid out as one CSV folder per season and type."""
    root = f"{shared_dir(t.spark)}/seasons-{abs(hash(t.folder))}-{t.spark.sparkContext.applicationId}"
    df = _season_rows(t).select(*SEASON_COLUMNS, "season", "season_type")
    df.write.mode("overwrite").option("header", True).partitionBy("season", "season_type").csv(root)
    return root


def _season_files(t: Tables):
    return t.spark.read.schema(SEASON_SCHEMA).option("header", True).csv(_season_root(t))


@register("scan_parquet", "SELECT l_orderkey, l_shipdate::DATE AS ship_date, l_quantity FROM lineitem WHERE l_quantity > 25")
def _(t):
    df = readers.scan_parquet(t.spark, f"{t.folder}/lineitem.parquet", ["l_orderkey", "l_shipdate", "l_quantity"])
    return df.where("l_quantity > 25").select("l_orderkey", F.to_date("l_shipdate").alias("ship_date"), "l_quantity")


@register(
    "scan_csv_season",
    f"SELECT o_orderkey, {R('o_totalprice', 'o_totalprice')} FROM ({SEASON_SQL}) x WHERE season = 1997 AND season_type = 'rg'",
)
def _(t):
    df = readers.scan_csv_season(
        t.spark, _season_root(t), SEASON_SCHEMA, 1997, "rg", ["o_orderkey", "o_totalprice"]
    )
    return rounded(df, ["o_totalprice"])


@register("list_seasons", f"SELECT DISTINCT season::BIGINT AS season, season_type FROM ({SEASON_SQL}) x")
def _(t):
    return longs(readers.list_seasons(_season_files(t)), ["season"])


@register(
    "resolve_seasons",
    f"""SELECT season::BIGINT AS season, count(*) AS n FROM ({SEASON_SQL}) x
WHERE year(o_orderdate) IN (SELECT DISTINCT year(o_orderdate) AS y FROM orders ORDER BY y DESC LIMIT 2) GROUP BY ALL""",
)
def _(t):
    last_two = readers.resolve_seasons(_season_files(t), -2)
    return last_two.groupBy(F.col("season").cast("long").alias("season")).agg(F.count("*").alias("n"))


@register(
    "stack_seasons",
    f"""SELECT season::BIGINT AS season, season_type = 'po' AS is_po, count(*) AS n, count(o_custkey) AS n_cust,
{R('sum(o_totalprice)', 'total')} FROM (SELECT * REPLACE (CASE WHEN season_type = 'rg' THEN o_custkey END AS o_custkey) FROM ({SEASON_SQL}) x) y GROUP BY ALL""",
)
def _(t):
    files = _season_files(t)
    frames = {
        "rg": [files.where("season_type = 'rg'")],
        "po": [files.where("season_type = 'po'").drop("o_custkey")],
    }
    out = readers.stack_seasons(frames, drop=["o_orderpriority"])
    return out.groupBy(F.col("season").cast("long").alias("season"), F.col("IsPlayoff").alias("is_po")).agg(
        F.count("*").alias("n"), F.count("o_custkey").alias("n_cust"), r6(F.sum("o_totalprice"), "total")
    )


@register(
    "game_dates_lookup",
    """SELECT gameId, min_by(d, p) AS game_date FROM (
SELECT o_custkey AS gameId, min(o_orderdate)::DATE AS d, 0 AS p FROM orders WHERE o_orderstatus = 'F' GROUP BY 1
UNION ALL SELECT user_id, min(ts)::DATE, 1 FROM events GROUP BY 1) x GROUP BY gameId""",
)
def _(t):
    preferred = t.raw("orders").where("o_orderstatus = 'F'").select(
        F.col("o_custkey").alias("gameId"), F.to_date("o_orderdate").alias("game_date")
    )
    fallback = t.raw("events").select(F.col("user_id").alias("gameId"), F.to_date("ts").alias("game_date"))
    return readers.game_dates_lookup([preferred, fallback], "gameId", "game_date")


@register(
    "merge_wide_stats",
    """WITH a AS (SELECT o_custkey AS k, year(o_orderdate) AS y, count(*) AS n_orders FROM orders GROUP BY ALL),
b AS (SELECT o_custkey AS k, year(o_orderdate) AS y, count(*) AS n_urgent, 99 AS n_orders FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2),
c AS (SELECT l_partkey AS k, year(l_shipdate) AS y, count(*) AS n_lines FROM lineitem GROUP BY ALL)
SELECT k, y::BIGINT AS y, n_orders, n_urgent, n_lines FROM a FULL JOIN b USING (k, y) FULL JOIN c USING (k, y)
""".replace("a FULL JOIN b USING (k, y)", "a FULL JOIN (SELECT k, y, n_urgent FROM b) b2 USING (k, y)"),
)
def _(t):
    orders = t.raw("orders").withColumn("k", F.col("o_custkey")).withColumn("y", F.year("o_orderdate").cast("long"))
    base = orders.groupBy("k", "y").agg(F.count("*").alias("n_orders"))
    urgent = orders.where("o_orderpriority = '1-URGENT'").groupBy("k", "y").agg(F.count("*").alias("n_urgent"))
    lines = t.raw("lineitem").groupBy(F.col("l_partkey").alias("k"), F.year("l_shipdate").cast("long").alias("y")).agg(
        F.count("*").alias("n_lines")
    )
    return readers.merge_wide_stats(base, [urgent.withColumn("n_orders", F.lit(99)), lines], ["k", "y"])


@register(
    "incremental_append",
    """SELECT k, src, o FROM (SELECT o_custkey AS k, 'saved' AS src, o_orderkey AS o, 0 AS p FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT o_custkey, 'fetched', o_orderkey, 1 FROM orders) x
QUALIFY row_number() OVER (PARTITION BY k ORDER BY p, o) = 1""",
)
def _(t):
    orders = t.raw("orders")
    view = lambda df, src: df.select(F.col("o_custkey").alias("k"), F.lit(src).alias("src"), F.col("o_orderkey").alias("o"))
    return readers.incremental_append(view(orders.where("o_orderstatus = 'F'"), "saved"), view(orders, "fetched"), ["k"], "o")


@register("pending_keys", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def _(t):
    saved = t.raw("orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return readers.pending_keys(t.raw("customer"), saved, ["c_custkey"])


@register("sink_parquet", "SELECT season, season_type, count(*) AS n FROM raw GROUP BY ALL")
def _(t):
    path = f"{shared_dir(t.spark)}/sink-parquet-{t.spark.sparkContext.applicationId}"
    readers.sink_parquet(t.spine, path)
    back = t.spark.read.schema(t.spine.schema).parquet(path)
    return back.groupBy("season", "season_type").agg(F.count("*").alias("n"))


@register("sink_csv", "SELECT actionType, count(*) AS n FROM raw GROUP BY ALL")
def _(t):
    path = f"{shared_dir(t.spark)}/sink-csv-{t.spark.sparkContext.applicationId}"
    table = t.spine.groupBy("actionType").agg(F.count("*").alias("n"))
    readers.sink_csv(table, path)
    return t.spark.read.schema(table.schema).option("header", True).csv(path)


@register(
    "table_views",
    f"""SELECT p.season, count(*) AS n, CAST(sum(p.seconds_remaining) AS BIGINT) AS clock_sum, count(DISTINCT a.PLAYER_ID) AS n_players
FROM en p LEFT JOIN adv a ON a.PLAYER_ID = p.personId AND a.season_int = p.season
WHERE p.prev_sub_type IS NOT NULL GROUP BY p.season""",
)
def _(t):
    readers.table_views(
        {
            "pbp": t.enriched,
            "player_stats": t.player_season,
            "player_advanced": t.player_advanced,
            "stints": t.stints,
            "boxscores": t.boxscores,
            "rotations": t.rotations,
        }
    )
    return t.spark.sql(
        """SELECT p.season, count(*) AS n, sum(p.clock_seconds) AS clock_sum, count(DISTINCT a.personId) AS n_players
        FROM pbp p LEFT JOIN player_advanced a ON a.personId = p.personId AND a.season = p.season
        WHERE p.prev_sub_type_clean IS NOT NULL GROUP BY p.season"""
    )


# --- projections --------------------------------------------------------------

ISO = "'PT' || lpad((seconds_remaining // 60)::VARCHAR, 2, '0') || 'M' || lpad((seconds_remaining % 60)::VARCHAR, 2, '0') || '.00S'"
KEY = "gameId, orderNumber"
key = ["gameId", "orderNumber"]


@register("strip_strings", "SELECT c_custkey, trim('  ' || c_name || ' ') AS c_name, trim(c_mktsegment || '  ') AS c_mktsegment FROM customer")
def _(t):
    padded = t.raw("customer").select(
        "c_custkey", F.concat(F.lit("  "), "c_name", F.lit(" ")).alias("c_name"), F.concat("c_mktsegment", F.lit("  ")).alias("c_mktsegment")
    )
    return C.strip_strings(padded)


@register("parse_iso_clock", f"SELECT {KEY}, seconds_remaining::DOUBLE AS remaining, (CASE WHEN period <= 4 THEN 720 ELSE 300 END - seconds_remaining)::DOUBLE AS elapsed FROM raw")
def _(t):
    clock = C.iso_clock_seconds(adapter.iso_clock(F.col("seconds_remaining")))
    return t.spine.select(*key, clock.alias("remaining"), C.elapsed_in_period(clock, F.col("period")).alias("elapsed"))


@register("parse_mmss_clock", f"SELECT {KEY}, seconds_remaining AS pc_seconds FROM raw")
def _(t):
    sr = F.col("seconds_remaining")
    text = F.concat(F.floor(sr / 60).cast("string"), F.lit(":"), F.lpad((sr % 60).cast("string"), 2, "0"))
    return t.spine.select(*key, C.mmss_seconds(text).alias("pc_seconds"))


@register("parse_wall_minute", f"SELECT {KEY}, (hour(timeActual) % 12) * 60 + minute(timeActual) AS wc_minute FROM raw")
def _(t):
    text = F.date_format("timeActual", "h:mm a")
    return t.spine.select(*key, C.wall_minute(text).alias("wc_minute"))


@register(
    "game_seconds_elapsed",
    f"""SELECT {KEY}, p AS period, least(p - 1, 4) * 720 + greatest(p - 5, 0) * 300 + el AS gse
FROM (SELECT gameId, orderNumber, 1 + orderNumber % 8 AS p, orderNumber % 300 AS el FROM raw) x""",
)
def _(t):
    rows = t.spine.select(*key, (F.col("orderNumber") % 8 + 1).alias("period"), (F.col("orderNumber") % 300).alias("el"))
    return rows.select(*key, "period", C.game_elapsed(F.col("period"), F.col("el")).alias("gse"))


@register("seconds_left_in_regulation", f"SELECT {KEY}, CASE WHEN p <= 4 THEN (4 - p) * 720 + seconds_remaining ELSE 0 END AS left_s FROM (SELECT *, 1 + orderNumber % 6 AS p FROM raw) x")
def _(t):
    p = F.col("orderNumber") % 6 + 1
    return t.spine.select(*key, C.left_in_regulation(p, F.col("seconds_remaining")).alias("left_s"))


@register("derive_game_date", f"SELECT {KEY}, min(CASE WHEN orderNumber % 17 <> 0 THEN timeActual END) OVER (PARTITION BY gameId)::DATE AS game_date FROM raw")
def _(t):
    raw = C.parse_timestamps(adapter.as_raw_feed(t.spine), ["timeActual"])
    return cleaning.derive_game_date(raw).select(*key, "game_date")


@register(
    "merge_game_date_ffill",
    f"""SELECT {KEY}, last_value(CASE WHEN orderNumber % 3 = 0 THEN timeActual::DATE END IGNORE NULLS) OVER ({W} {UPTO}) AS game_date FROM raw""",
)
def _(t):
    dates = t.spine.where("orderNumber % 3 = 0").select(*key, F.to_date("timeActual").alias("game_date"))
    return cleaning.merge_game_date_ffill(t.spine, dates).select(*key, "game_date")


@register("cast_float_to_int", "SELECT l_orderkey, l_partkey, l_linenumber::BIGINT AS ln, CASE WHEN l_quantity = floor(l_quantity) THEN l_quantity::BIGINT END AS qty, CASE WHEN l_extendedprice = floor(l_extendedprice) THEN l_extendedprice::BIGINT END AS price FROM lineitem")
def _(t):
    rows = t.raw("lineitem").select("l_orderkey", "l_partkey", F.col("l_linenumber").cast("long").alias("ln"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"))
    return C.cast_float_to_int(rows, ["qty", "price"])


@register("parse_timestamps", f"SELECT {KEY}, CASE WHEN orderNumber % 17 <> 0 THEN epoch_us(timeActual) END AS us FROM raw")
def _(t):
    raw = C.parse_timestamps(adapter.as_raw_feed(t.spine), ["timeActual"])
    return raw.select(*key, F.unix_micros("timeActual").alias("us"))


@register("reorder_columns", "SELECT o_orderdate::DATE AS o_orderdate, o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders")
def _(t):
    rows = t.raw("orders").withColumn("o_orderdate", F.to_date("o_orderdate")).drop("o_totalprice")
    return C.reorder_columns(rows, ["o_orderdate", "o_orderkey"], ["o_orderpriority", "absent"])


@register("ffill_to_int", f"SELECT {KEY}, coalesce(last_value(CASE WHEN orderNumber % 7 <> 0 THEN scoreAway END IGNORE NULLS) OVER ({W} {UPTO}), 0) AS scoreAway FROM spine")
def _(t):
    return cleaning.ffill_to_int(adapter.as_raw_feed(t.spine), ["scoreAway"]).select(*key, "scoreAway")


@register("season_from_id", "SELECT game, 2000 + (game % 10000000) // 100000 AS season, CASE WHEN game // 10000000 = 2 THEN 'rg' ELSE 'po' END AS season_type FROM (SELECT 20000000 + (o_orderkey % 2) * 20000000 + (20 + o_orderkey % 6) * 100000 + o_orderkey % 1231 AS game FROM orders) x")
def _(t):
    o = F.col("o_orderkey")
    game = F.lit(20000000) + (o % 2) * 20000000 + (o % 6 + 20) * 100000 + o % 1231
    rows = t.raw("orders").select(game.alias("game"))
    return rows.select("game", C.season_from_id(F.col("game")).alias("season"), C.season_type_from_id(F.col("game")).alias("season_type"))


@register(
    "shot_value",
    f"""SELECT {KEY}, CASE actionType WHEN '3pt' THEN 3 WHEN '2pt' THEN 2 WHEN 'freethrow' THEN 1 ELSE 0 END::BIGINT AS value,
CASE WHEN shotResult = 'Made' THEN CASE actionType WHEN '3pt' THEN 3 WHEN '2pt' THEN 2 WHEN 'freethrow' THEN 1 ELSE 0 END ELSE 0 END::BIGINT AS points FROM plays""",
)
def _(t):
    a = F.col("actionType")
    return longs(t.plays.select(*key, F.coalesce(C.shot_value(a), F.lit(0)).alias("value"), C.shot_points(a, F.col("shotResult")).alias("points")), ["value", "points"])


@register("score_margin", f"SELECT {KEY}, scoreHome - scoreAway AS lead FROM spine")
def _(t):
    return t.spine.select(*key, (F.col("scoreHome") - F.col("scoreAway")).alias("lead"))


@register("is_clutch", f"SELECT {KEY} FROM spine WHERE abs(scoreHome - scoreAway) <= 5 AND game_seconds_elapsed >= 2400")
def _(t):
    return t.spine.where(C.is_clutch(F.col("scoreHome") - F.col("scoreAway"), F.col("game_seconds_elapsed"))).select(*key)


@register("clutch_window", f"SELECT {KEY} FROM spine WHERE period >= 4 AND seconds_remaining <= 300 AND abs(scoreHome - scoreAway) <= 5")
def _(t):
    lead = F.col("scoreHome") - F.col("scoreAway")
    return t.spine.where(C.clutch_window(F.col("period"), F.col("seconds_remaining"), lead)).select(*key)


XY = "(k * 1.0)::DOUBLE AS x, value AS y, CASE k % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' END AS side"


def _xy(t):
    k = F.col("k")
    side = F.when(k % 3 == 0, F.lit("left")).when(k % 3 == 1, F.lit("right"))
    return t.spine.select(*key, k.cast("double").alias("x"), F.col("value").alias("y"), side.alias("side"), "k", "points_scored")


@register(
    "court_xy",
    f"""SELECT {KEY}, round_even(CASE side WHEN 'right' THEN 5 * (y - 50) WHEN 'left' THEN -5 * (y - 50) END, 0)::BIGINT AS cx,
round_even(CASE side WHEN 'right' THEN -9.4::DOUBLE * x + 887.5::DOUBLE WHEN 'left' THEN 9.4::DOUBLE * x - 52.5::DOUBLE END, 0)::BIGINT AS cy
FROM (SELECT gameId, orderNumber, {XY} FROM raw) q""",
)
def _(t):
    rows = _xy(t)
    return longs(rows.select(*key, C.court_x(F.col("y"), F.col("side")).alias("cx"), C.court_y(F.col("x"), F.col("side")).alias("cy")), ["cx", "cy"])


@register("bin_clock", f"SELECT {KEY}, (seconds_remaining // 30) * 30 AS bin FROM raw")
def _(t):
    return t.spine.select(*key, C.bin_clock(F.col("seconds_remaining"), 30).alias("bin"))


@register(
    "context_buckets",
    f"""SELECT {KEY}, CASE WHEN period <= 3 THEN 'Q' || period WHEN seconds_remaining > 300 THEN 'Q4_early' ELSE 'Q4_clutch' END AS time_bucket,
CASE WHEN score_margin <= -16 THEN 'down15+' WHEN score_margin <= -6 THEN 'down6-15' WHEN score_margin <= -1 THEN 'down1-5' WHEN score_margin = 0 THEN 'tied'
WHEN score_margin <= 5 THEN 'up1-5' WHEN score_margin <= 15 THEN 'up6-15' ELSE 'up15+' END AS margin_bucket,
CASE WHEN streak <= -10 THEN 'down10+' WHEN streak <= -6 THEN 'down6-9' WHEN streak <= -3 THEN 'down3-5' WHEN abs(streak) <= 2 THEN 'calm'
WHEN streak <= 5 THEN 'up3-5' WHEN streak <= 9 THEN 'up6-9' ELSE 'up10+' END AS streak_bucket FROM en""",
)
def _(t):
    return t.enriched.select(
        *key,
        C.time_bucket(F.col("period"), F.col("seconds_remaining")).alias("time_bucket"),
        C.margin_bucket(F.col("score_margin")).alias("margin_bucket"),
        C.streak_bucket(F.col("streak")).alias("streak_bucket"),
    )


@register("alias_columns", f"SELECT {KEY}, seconds_remaining AS clock_seconds, subType AS subType_clean FROM raw")
def _(t):
    return C.alias_columns(t.spine).select(*key, "clock_seconds", "subType_clean")


@register("rename_keys", "SELECT PLAYER_ID AS personId, TEAM_ID AS teamId, season_int AS season, GP FROM adv")
def _(t):
    return t.player_advanced.withColumnsRenamed(readers.VIEW_KEYS["player_advanced"]).select("personId", "teamId", "season", "GP")


@register(
    "derive_missing_columns",
    f"SELECT {KEY}, seconds_remaining::DOUBLE AS seconds_remaining, game_seconds_elapsed::DOUBLE AS game_seconds_elapsed, seconds_remaining AS pc_seconds, 0.0::DOUBLE AS shotValue, NULL::DATE AS game_date, NULL::DATE AS game_date_ffill FROM raw",
)
def _(t):
    feed = t.spine.select(*key, "period", adapter.iso_clock(F.col("seconds_remaining")).alias("clock"))
    return C.older_feed_columns(feed).select(*key, "seconds_remaining", "game_seconds_elapsed", "pc_seconds", "shotValue", F.to_date("game_date").alias("game_date"), F.to_date("game_date_ffill").alias("game_date_ffill"))


CLEAN_SQL = f"""SELECT gameId, orderNumber, actionType, seconds_remaining::DOUBLE AS seconds_remaining,
game_seconds_elapsed::DOUBLE AS game_seconds_elapsed, min(CASE WHEN orderNumber % 17 <> 0 THEN timeActual END) OVER (PARTITION BY gameId)::DATE AS game_date,
max(scoreHome - CASE WHEN orderNumber % 13 = 0 THEN 1 ELSE 0 END) OVER ({W} {UPTO}) AS scoreHome, teamId FROM spine"""


@register("clean_chain", CLEAN_SQL)
def _(t):
    cols = ["actionType", "seconds_remaining", "game_seconds_elapsed", "game_date", "scoreHome", "teamId"]
    return cleaning.clean_feed(adapter.as_raw_feed(t.spine)).select(*key, *cols)


@register(
    "clean_chain_older",
    f"""SELECT gameId, orderNumber, game_date, max(h) OVER ({W} {UPTO}) AS scoreHome, max(a) OVER ({W} {UPTO}) AS scoreAway FROM (
SELECT gameId, orderNumber, last_value(CASE WHEN orderNumber % 3 = 0 THEN timeActual::DATE END IGNORE NULLS) OVER ({W} {UPTO}) AS game_date,
scoreHome - CASE WHEN orderNumber % 13 = 0 THEN 1 ELSE 0 END AS h,
coalesce(last_value(CASE WHEN orderNumber % 7 <> 0 THEN scoreAway END IGNORE NULLS) OVER ({W} {UPTO}), 0) AS a FROM spine) x""",
)
def _(t):
    dates = t.spine.where("orderNumber % 3 = 0").select(*key, F.to_date("timeActual").alias("game_date"))
    return cleaning.clean_older_feed(adapter.as_raw_feed(t.spine), dates).select(*key, "game_date", "scoreHome", "scoreAway")


@register("perspective_flip", f"SELECT {KEY}, CASE WHEN teamId = home_teamId THEN score_margin ELSE -score_margin END AS mine, -sign(streak)::BIGINT * score_margin AS sufferer FROM en")
def _(t):
    margin = F.col("score_margin")
    flip = C.signed_for(margin, F.col("teamId") == F.col("home_teamId"))
    return t.enriched.select(
        *key, flip.alias("mine"), (-F.signum("streak").cast("long") * margin).alias("sufferer")
    )


# --- predicates -------------------------------------------------------------------


def _mask(name: str, sql: str, pick):
    @register(name, f"SELECT {KEY} FROM en WHERE {sql}")
    def query(t):
        return t.enriched.where(pick()).select(*key)

    return query


_mask("f_timeout", "actionType = 'timeout'", P.is_timeout)
_mask("f_timeout_endogenous", "timeout_cause IN ('coach_discretionary', 'mistagged_discretionary')", P.is_endogenous)
_mask("f_timeout_exogenous", "timeout_cause IN ('tv_mandatory', 'coach_absorb')", P.is_exogenous)
_mask("f_exogenous_break", "timeout_cause IN ('tv_mandatory', 'coach_absorb') OR actionType = 'stoppage'", P.is_exogenous_break)
_mask("f_stoppage", "actionType = 'stoppage'", P.is_stoppage)
_mask("f_coach_challenge", "actionType = 'timeout' AND subType = 'challenge'", P.is_challenge)
_mask("f_streak_n_home", "streak >= 6", lambda: P.streak_at_least(6, "home"))
_mask("f_streak_n_away", "streak <= -6", lambda: P.streak_at_least(6, "away"))
_mask("f_streak_n_either", "abs(streak) >= 6", lambda: P.streak_at_least(6, "either"))
_mask("season_range", "season BETWEEN 2021 AND 2022", lambda: P.season_range(2021, 2022))


@register("f_stoppage_subtype", f"SELECT {KEY} FROM plays WHERE actionType = 'rebound' AND subType = 'offensive'")
def _(t):
    return t.plays.where(P.action_subtype("rebound", "offensive")).select(*key)


@register("f_clock_reversal", f"SELECT {KEY} FROM (SELECT gameId, orderNumber, g < lag(g) OVER ({W}) AS rev FROM (SELECT *, game_seconds_elapsed - 40 * (orderNumber % 2) AS g FROM raw) q) x WHERE rev")
def _(t):
    jitter = t.spine.withColumn("game_seconds_elapsed", F.col("game_seconds_elapsed") - 40 * (F.col("orderNumber") % 2))
    return cleaning.clock_reversals(jitter).where("is_reversal").select(*key)


@register("f_timeout_older", f"SELECT {KEY}, subType IN ('Regular', 'Short', 'Coach Challenge') AS endogenous FROM old WHERE actionType = 'Timeout'")
def _(t):
    old = adapter.as_older_feed(t.spine).where(P.is_timeout("Timeout"))
    return old.select(*key, P.older_endogenous().alias("endogenous"))


@register("classifier_prep", f"SELECT {KEY}, season, season < 2017 AS early, CASE WHEN subType = 'Coach Challenge' THEN 'challenge' ELSE 'discretionary' END AS base_role FROM old WHERE actionType = 'Timeout' AND season BETWEEN 2014 AND 2017")
def _(t):
    return P.classifier_prep(adapter.as_older_feed(t.spine), (2014, 2017), "Timeout")


@register("structured_sample_filter", f"SELECT {KEY} FROM plays WHERE season IN (2020, 2021) AND season_type = 'rg' AND period BETWEEN 1 AND 4 AND actionType = '3pt' AND prev_action_type = 'timeout' AND NOT is_clutch AND teamId <> home_teamId AND personId IN (1, 2, 3)")
def _(t):
    spec = P.SampleSpec(
        seasons=(2020, 2021), season_type="rg", period="regulation", shot_type="3pt", prev_event="timeout", clutch=False,
        home_away="away", persons=(1, 2, 3),
    )
    return t.plays.where(spec.condition()).select(*key)


@register("is_gt_mask", f"SELECT {KEY}, contains(subType, 'Official') AS by_text, subType IN ('Official TV') AS by_list FROM old WHERE actionType = 'Timeout'")
def _(t):
    old = adapter.as_older_feed(t.spine).where("actionType = 'Timeout'")
    return old.select(*key, P.label_contains("subType", "Official").alias("by_text"), P.label_in("subType", ["Official TV"]).alias("by_list"))


@register("drop_nulls", f"SELECT {KEY}, possession_id, subType FROM en WHERE possession_id IS NOT NULL AND subType IS NOT NULL")
def _(t):
    return t.enriched.dropna(subset=["possession_id", "subType"]).select(*key, "possession_id", "subType")


@register(
    "nearby_rows",
    f"SELECT DISTINCT a.gameId, a.orderNumber FROM raw a JOIN (SELECT * FROM raw WHERE subType = 'challenge') b ON a.gameId = b.gameId AND abs(a.game_seconds_elapsed - b.game_seconds_elapsed) <= 20",
)
def _(t):
    chosen = t.spine.where("subType = 'challenge'")
    return joins.nearby_rows(t.spine, chosen, ["gameId"], "game_seconds_elapsed", 20).select(*key)


@register(
    "qualifier_array",
    f"SELECT {KEY}, list_contains(string_split(qualifiers, ', '), 'mandatory') AS mandatory FROM raw WHERE qualifiers IS NOT NULL",
)
def _(t):
    rows = t.spine.where("qualifiers is not null")
    return rows.select(*key, F.array_contains(C.qualifier_array(rows), "mandatory").alias("mandatory"))


FOLD_SQL = "regexp_replace(translate(text, '" + C.FOLD_FROM + "', '" + C.FOLD_TO + "'), '[^\\x00-\\x7F]', '', 'g')"


@register("ascii_fold", f"SELECT doc_id, {FOLD_SQL} AS folded FROM documents")
def _(t):
    return t.raw("documents").select("doc_id", C.ascii_fold(F.col("text")).alias("folded"))


