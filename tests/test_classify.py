import pytest

from eddyline.plans import classify
from eddyline.sources import adapter

COLUMNS = (
    "gameId long, orderNumber long, period long, seconds_remaining double, actionType string, subType string, qualifiers string, "
    "teamId long, personId long, season long"
)
M, D = "team, mandatory", "team"


def frame(spark, rows):
    return spark.createDataFrame([(g, o, p, sr, "timeout", sub, q, team, 1, 2021) for g, o, p, sr, sub, q, team in rows], COLUMNS)


def labels(df, home):
    out = classify.classify_events(df, home).orderBy("orderNumber").collect()
    return [(r["timeout_role"], r["timeout_cause"]) for r in out]


@pytest.fixture(scope="module")
def home(spark):
    return spark.createDataFrame([(1, 10)], "gameId long, home_teamId long")


def test_every_branch(spark, home):
    rows = [
        (1, 1, 1, 500.0, "full", D, 10),  # not mandatory
        (1, 2, 1, 410.0, "full", M, 10),  # slot 1, past the mark, home
        (1, 3, 1, 250.0, "full", M, 20),  # slot 2, 70 s early, first by the visitors
        (1, 4, 1, 100.0, "full", M, 20),  # slot 3 does not exist
        (1, 5, 2, 400.0, "full", M, 20),  # slot 1 charged to the visitors
        (1, 6, 2, 300.0, "full", M, 20),  # slot 2, 120 s early
        (1, 7, 3, 430.0, "full", M, 10),  # slot 1, 10 s early, first by home
        (1, 8, 5, 170.0, "full", M, 10),  # extra period has one slot
        (1, 9, 11, 170.0, "full", M, 10),  # beyond the table
        (1, 10, 4, None, "full", M, 10),  # no clock
    ]
    assert labels(frame(spark, rows), home) == [
        ("discretionary", "coach_discretionary"),
        ("slot_1_mandatory", "tv_mandatory"),
        ("slot_2_mandatory", "coach_absorb"),
        ("slot_2_mandatory", "mistagged_discretionary"),
        ("slot_1_mandatory", "mistagged_discretionary"),
        ("slot_2_mandatory", "mistagged_discretionary"),
        ("slot_1_mandatory", "coach_absorb"),
        ("slot_1_mandatory", "tv_mandatory"),
        ("discretionary", "coach_discretionary"),
        ("slot_1_mandatory", ""),
    ]


def test_flagged_challenge_moves_the_counter(spark, home):
    rows = [(1, 1, 1, 600.0, "challenge", M, 10), (1, 2, 1, 170.0, "full", M, 20)]
    assert labels(frame(spark, rows), home) == [("challenge", "challenge"), ("slot_2_mandatory", "tv_mandatory")]


def test_second_call_of_a_team_cannot_absorb(spark, home):
    rows = [(1, 1, 1, 600.0, "full", D, 10), (1, 2, 1, 430.0, "full", M, 10)]
    assert labels(frame(spark, rows), home)[1][1] == "mistagged_discretionary"


def test_null_team_is_never_first_and_unknown_home_matches_any(spark, home):
    rows = [(1, 1, 1, 430.0, "full", M, None), (2, 2, 1, 430.0, "full", M, 20), (2, 3, 1, 170.0, "full", M, 20)]
    assert [c for _, c in labels(frame(spark, rows), home)] == ["mistagged_discretionary", "coach_absorb", "tv_mandatory"]


def test_signals_need_their_column(spark, home):
    df = frame(spark, [(1, 1, 1, 1.0, "full", M, 10)])
    with pytest.raises(ValueError):
        classify.classify_events(df.drop("qualifiers"), home)
    with pytest.raises(ValueError):
        classify.is_flagged("other", df.columns)


def test_variants_label_every_intervention_once(tables):
    old = adapter.as_older_feed(tables.spine)
    n = old.where("actionType = 'Timeout'").count()
    for claim in classify.SLOT_CLAIMS.values():
        out = classify.slot_claim(old, claim, "Timeout")
        assert out.count() == n == out.select("gameId", "orderNumber").distinct().count()


def test_nearest_trigger_gives_one_mandatory_per_period(tables):
    out = classify.nearest_trigger(adapter.as_older_feed(tables.spine), "Timeout").where("timeout_role like 'slot%'")
    assert out.groupBy("gameId", "period").count().where("count > 1").isEmpty()
