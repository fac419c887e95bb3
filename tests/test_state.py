import pytest
from frames import same_rows
from pyspark.sql import functions as F

from eddyline.functions import columns as C
from eddyline.functions import predicates as P
from eddyline.plans import cleaning, impact, quality, state


def spine(spark, rows):
    """(game, order, clock, home, away) plus what the operators read."""
    df = spark.createDataFrame(rows, "gameId long, orderNumber long, game_seconds_elapsed long, scoreHome long, scoreAway long")
    return df


def values(df, column):
    return [r[column] for r in df.orderBy("gameId", "orderNumber").collect()]


def test_streak_resets_at_entity_start_and_on_flip(spark):
    rows = [(1, 1, 0, 0, 0), (1, 2, 5, 2, 0), (1, 3, 6, 4, 0), (1, 4, 7, 4, 3), (1, 5, 8, 4, 5), (2, 6, 0, 9, 0), (2, 7, 1, 9, 2)]
    assert values(state.with_streak(spine(spark, rows)), "streak") == [0, 2, 4, -3, -5, 0, -2]


def test_both_sides_scoring_leaves_streak(spark):
    rows = [(1, 1, 0, 0, 0), (1, 2, 1, 3, 0), (1, 3, 2, 5, 2), (1, 4, 3, 6, 2)]
    assert values(state.with_streak(spine(spark, rows)), "streak") == [0, 3, 3, 4]


def test_dead_row_opens_a_new_possession(spark):
    df = spark.createDataFrame([(1, i, p) for i, p in enumerate([7, 7, 0, 7, 8, 0])], "gameId long, orderNumber long, possession long")
    assert values(state.with_possession_id(df), "possession_id") == [1, 1, None, 2, 3, None]


@pytest.mark.parametrize(
    ("plays", "outcome"),
    [
        ([("3pt", None, "Made"), ("freethrow", None, "Made")], "made_3pt_and1"),
        ([("2pt", None, "Made"), ("freethrow", None, "Missed")], "made_2pt"),
        ([("freethrow", None, "Made"), ("freethrow", None, "Missed")], "ft_1_of_2"),
        ([("steal", None, None), ("turnover", None, None)], "turnover_live"),
        ([("turnover", None, None)], "turnover_dead"),
        ([("2pt", None, "Missed"), ("rebound", "defensive", None)], "miss_def_reb"),
        ([("2pt", None, "Missed"), ("block", None, None)], "miss"),
        ([("2pt", None, "Missed"), ("period", None, None)], "end_of_period"),
        ([("foul", None, None)], "other"),
    ],
)
def test_possession_outcome_priority(spark, plays, outcome):
    data = [(1, i, 1, *p) for i, p in enumerate(plays)]
    df = spark.createDataFrame(data, "gameId long, orderNumber long, possession_id long, actionType string, subType string, shotResult string")
    assert state.possession_outcomes(df).first()["possession_outcome"] == outcome


def test_lead_change_clamps_to_the_last_event_and_prefers_later_clock(spark):
    # from clock 0 plus 60: clocks 50 and 70 are equally near, the later wins
    rows = [(1, 1, 0, 0, 0), (1, 2, 50, 2, 0), (1, 3, 70, 5, 0), (1, 4, 70, 5, 1), (1, 5, 90, 9, 1)]
    df = spine(spark, rows)
    assert values(impact.forward_scores(df, df, [1.0]), "lead_change") == [4, 6, 3, 4, 0]


def test_reversal_and_fills_stay_inside_the_entity(spark):
    df = spine(spark, [(1, 1, 10, 0, 0), (1, 2, 8, 0, 0), (2, 3, 1, 0, 0)])
    assert values(cleaning.clock_reversals(df), "is_reversal") == [False, True, False]
    scores = spark.createDataFrame([(1, 1, 5.0), (1, 2, None), (2, 3, None), (2, 4, 7.0)], "gameId long, orderNumber long, x double")
    assert values(cleaning.ffill_to_int(scores, ["x"]), "x") == [5, 5, 0, 7]


def test_resume_duration_rules(spark):
    data = [(1, 1, "timeout", 0), (1, 2, "substitution", 20), (1, 3, "2pt", 45), (2, 4, "timeout", 0), (2, 5, "2pt", 601), (3, 6, "timeout", 50), (3, 7, "2pt", 10), (4, 8, "timeout", 0)]
    df = spark.createDataFrame(data, "gameId long, orderNumber long, actionType string, s long")
    df = df.withColumn("timeActual", F.timestamp_seconds(F.col("s") + 1_700_000_000))
    assert values(cleaning.next_resume_duration(df), "timeout_duration_s") == [45, None, None, None, None, None, None, None]


def test_parsers_under_ansi(spark):
    df = spark.createDataFrame([("PT04M56.00S", "12:00", "7:12 PM"), ("", "", "12:05 AM"), (None, None, None), ("x", "1:2:3", "?")], "a string, b string, c string")
    out = df.select(C.iso_clock_seconds(F.col("a")), C.mmss_seconds(F.col("b")), C.wall_minute(F.col("c"))).collect()
    assert [tuple(r) for r in out] == [(296.0, 720, 432), (None, None, 5), (None, None, None), (None, None, None)]


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(50.5,), (49.5,), (51.5,), (48.5,)], "y double")
    got = [r[0] for r in df.select(C.court_x(F.col("y"), F.lit("right"))).collect()]
    assert got == [2, -2, 8, -8]  # 2.5, -2.5, 7.5 and -7.5 before rounding


def test_fold_tables_line_up(spark):
    assert len(C.FOLD_FROM) == len(C.FOLD_TO)
    df = spark.createDataFrame([("Dončić Šarić ¿é漢",)], "n string")
    assert df.select(C.ascii_fold(F.col("n"))).first()[0] == "Doncic Saric e"


def test_bad_direction_is_refused():
    with pytest.raises(ValueError):
        P.streak_at_least(3, "sideways")


def test_checks_flag_broken_rows(spark, tables):
    bad = tables.enriched.limit(40).withColumn("score_margin", F.lit(999).cast("long"))
    report = {r["check"]: r["n_bad"] for r in quality.check_consistency(bad).collect()}
    assert report["score_margin"] == 40
    with pytest.raises(quality.CheckError):
        quality.check_report({"c": (quality.check_consistency(bad), "error")}, raise_errors=True)
    missing = {r["column"] for r in quality.check_required_columns(bad, ["gameId", "nope"]).collect() if not r["present"]}
    assert missing == {"nope"}


def test_possession_points_add_up(tables):
    live = tables.enriched.where("possession_id is not null").agg(F.sum("points_scored")).first()[0]
    assert tables.possessions.agg(F.sum("possession_points")).first()[0] == live


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_rows_without_an_entity_keep_their_state(spark, tables):
    """One game's id is replaced by null: its rows get what they got with the id."""
    from eddyline.plans import classify
    from eddyline.session import reuse_layout

    game = tables.spine.first()["gameId"]
    nameless = tables.spine.withColumn("gameId", F.when(F.col("gameId") != game, F.col("gameId")))
    with reuse_layout(spark):
        found = {}
        for name, rows in (("known", tables.spine), ("null", nameless)):
            sides = state.sides(rows)
            labels = classify.classify_events(rows, sides.drop("away_teamId"))
            enriched = state.enrich(rows, labels, sides).cache()
            found[name] = enriched, impact.run_impact(enriched)
            assert enriched.columns == found["known"][0].columns and not [c for c in enriched.columns if c.startswith("_")]
        for known, null in zip(found["known"], found["null"]):
            known = known.where(F.col("gameId") == game).drop("gameId")
            null = null.where("gameId IS NULL").drop("gameId")
            assert known.count() > 0 and same_rows(known, null)
        assert state.with_streak(nameless).count() == nameless.count()
        assert _exchanges(state.with_streak(nameless)) <= 7


def _final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_enriched_log_is_not_sorted_for_its_joins(spark, tables):
    """Shuffled block summaries and labels are hashed, so the rows keep their order (21 sorts before)."""
    from eddyline.session import BROADCAST_KEYS, reuse_layout

    before = {key: spark.conf.get(key, None) for key in BROADCAST_KEYS}
    rows, labels, sides = tables.spine, tables.labels, tables.sides
    try:
        for key in BROADCAST_KEYS:
            spark.conf.set(key, "-1")
        with reuse_layout(spark):
            plan = _final_plan(state.enrich(rows, labels, sides))
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert plan.count("ShuffledHashJoin") >= 4 and plan.count("Sort [") <= 12


def test_enriched_log_is_staged_without_slivers(tables):
    """One file a task, none for each season in each task."""
    assert tables.enriched.where("season_type = 'rg'").count() > 0
    assert not [f for f in tables.enriched.inputFiles() if "season=" in f]


def test_clock_states_and_possession_starts_do_not_sort_the_log(tables):
    from eddyline.plans import impact, questions

    assert "SortAggregate" not in _final_plan(impact.clock_states(tables.spine))
    plan = _final_plan(questions.fatigue_by_stint_minute(tables.enriched, tables.stints, min_minutes=1))
    # the totals of a scan are boxed, those of the log are not
    assert "partial_min_by(struct" not in plan and "partial_min_by" in plan
