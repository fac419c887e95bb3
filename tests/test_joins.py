import itertools
import random
import re
from dataclasses import replace

import pytest
from frames import same_rows
from pyspark.sql import functions as F

from eddyline import session
from eddyline.config import SPINE
from eddyline.operators import aggregates as A
from eddyline.operators import joins, matching
from eddyline.operators.asof import asof
from eddyline.plans import impact
from eddyline.sources import readers


def test_bounded_asof_edges(spark):
    spans = spark.createDataFrame([(1, 10, 20, 1), (1, 30, 40, 2), (1, 30, 35, 3)], "k int, i long, o long, id long")
    points = spark.createDataFrame([(1, t) for t in (5, 10, 19, 20, 25, 30, 34, 35, 39)], "k int, t long")
    out = joins.asof_backward_bounded(points, spans, ["k"], "t", "i", "o", ["id"], "id", 8)
    got = {r["t"]: r["id"] for r in out.collect()}
    assert got == {5: None, 10: 1, 19: 1, 20: None, 25: None, 30: 3, 34: 3, 35: None, 39: None}


@pytest.mark.parametrize("span", [3, 1000])
def test_asof_against_brute_force(spark, span):
    rng = random.Random(3)
    look = sorted({(rng.randint(1, 2), rng.randint(-20, 60)) for _ in range(40)})
    asks = sorted({(rng.randint(1, 3), rng.randint(-30, 70)) for _ in range(60)})
    out = asof(
        spark.createDataFrame([(k, t, t * 10) for k, t in look], "k int, t long, v long"),
        spark.createDataFrame(asks, "k int, t long"),
        ["k"], "t", ["v"], span,
    )
    for r in out.collect():
        mine = [t for k, t in look if k == r["k"]]
        back = max((t for t in mine if t <= r["t"]), default=None)
        ahead = min((t for t in mine if t > r["t"]), default=None)
        assert (r["backward"] and r["backward"]["t"]) == back
        assert (r["forward"] and r["forward"]["t"]) == ahead


def intervals(rng, n):
    out = []
    for i in range(n):
        a = rng.randint(0, 300)
        out.append((rng.randint(1, 2), a, a + rng.randint(0, 120), i))
    return out


@pytest.mark.parametrize("width", [7, 60, 1000])
def test_interval_join_and_sweep_against_brute_force(spark, width):
    rng = random.Random(11)
    spans, points = intervals(rng, 30), [(rng.randint(1, 2), rng.randint(0, 400), i) for i in range(80)]
    sdf = spark.createDataFrame(spans, "k int, a long, b long, s long")
    pdf = spark.createDataFrame(points, "k int, t long, p long")
    pairs = [(p, s, t - a) for (k, t, p), (j, a, b, s) in itertools.product(points, spans) if k == j and a <= t < b]
    got = joins.interval_join(pdf, sdf, ["k"], "t", "a", "b", width)
    assert sorted((r["p"], r["s"]) for r in got.collect()) == sorted((p, s) for p, s, _ in pairs)
    mean = joins.mean_time_since_start(sdf, pdf, ["k"], "t", "a", "b", "m", width)
    want = {}
    for p, _, gap in pairs:
        want.setdefault(p, []).append(gap)
    assert {r["p"]: pytest.approx(r["m"]) for r in mean.collect()} == {p: sum(g) / len(g) for p, g in want.items()}


def test_counts_and_forward_sums_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.randint(1, 2), rng.randint(0, 200), rng.randint(0, 3), i) for i in range(120)]
    df = spark.createDataFrame(rows, "k int, t long, v long, id long")
    near = joins.count_within(df, df.where("v = 3"), ["k"], "t", 10, "n")
    ahead = joins.forward_sum(df, df, ["k"], "t", ["v"], 25, 16)
    for r in near.collect():
        assert r["n"] == sum(1 for k, t, v, _ in rows if k == r["k"] and v == 3 and abs(t - r["t"]) <= 10)
    for r in ahead.collect():
        assert r["next_v"] == sum(v for k, t, v, _ in rows if k == r["k"] and r["t"] < t <= r["t"] + 25)


def test_nearest_outcome_keeps_events_without_one(spark):
    calls = spark.createDataFrame([(1, 1, 100), (1, 2, 300), (2, 3, 50)], "k int, id long, t long")
    outs = spark.createDataFrame([(1, 9, 110, "near"), (1, 8, 150, "far"), (1, 7, 390, "late")], "k int, o long, t long, d string")
    got = joins.nearest_outcome(calls, outs, ["k"], "t", ["d"], "o", 60, 64)
    assert {r["id"]: r["d"] for r in got.collect()} == {1: "near", 2: None, 3: None}


def test_total_row_is_preferred_without_fan_out(spark):
    rows = [(1, "AAA"), (1, "BBB"), (1, "TOT"), (2, "BBB"), (2, "AAA")]
    got = joins.prefer_total_row(spark.createDataFrame(rows, "p int, TEAM_ABBREVIATION string"), ["p"])
    assert {r["p"]: r["TEAM_ABBREVIATION"] for r in got.collect()} == {1: "TOT", 2: "AAA"}


def test_split_points_must_be_strictly_inside(spark):
    rows = [(1, 14000, 14400, 5), (2, 14400, 28800, 6), (3, 14000, 29000, 7), (4, 1, 2, 8)]
    df = spark.createDataFrame(rows, "id long, a long, b long, pts long")
    got = joins.split_intervals(df, "a", "b", joins.BREAK_POINTS, ["pts"])
    assert sorted((r["id"], r["a"], r["b"], r["pts"]) for r in got.collect()) == sorted(
        [(1, 14000, 14400, 5), (2, 14400, 28800, 6), (3, 14000, 14400, None), (3, 14400, 28800, None), (3, 28800, 29000, None), (4, 1, 2, 8)],
        key=lambda r: (r[0], r[1]),
    )


def states(rng, n, start):
    """Rows of one hot entity and a few small ones, many with equal states."""
    out = []
    for i in range(n):
        g = 1 if rng.random() < 0.7 else rng.randint(2, 4)
        p = rng.randint(1, 3)
        sr = rng.randint(1, 300)
        out.append((g, start + i, p, rng.choice([-8, -7, -6, 6, 7, 8, 9]), rng.randint(-5, 5), sr, p * 300 - sr, rng.randint(-9, 9)))
    return out


COLS = "gameId long, orderNumber long, period long, streak long, suffering_margin long, seconds_remaining long, game_seconds_elapsed long, recovery long"


@pytest.mark.parametrize("rule", [matching.STANDARD, matching.DOUGHNUT, matching.OTHER_PERIOD], ids=["standard", "doughnut", "other"])
@pytest.mark.parametrize("span", [25, 1 << 16])
def test_matching_against_brute_force(spark, rule, span):
    rng = random.Random(23)
    treated, controls = states(rng, 60, 0), states(rng, 90, 1000)
    col = {"seconds_remaining": 5, "game_seconds_elapsed": 6}[rule.clock]
    want = {}
    for t in treated:
        best = None
        for c in controls:
            gap = abs(t[col] - c[col])
            ok = t[0] == c[0] and (t[3] > 0) == (c[3] > 0) and abs(t[3] - c[3]) <= 2 and abs(t[4] - c[4]) <= 3
            ok = ok and rule.nearest <= gap <= rule.farthest
            ok = ok and (not rule.same_period or t[2] == c[2]) and (not rule.other_period or t[2] != c[2])
            if ok:
                d = (abs(t[3] - c[3]) * 2 + abs(t[4] - c[4]) * 3) * rule.clock_unit + gap
                best = min(best or (d, c[1]), (d, c[1]))
        if best:
            want[t[1]] = best[1]
    s = replace(SPINE, clock_span=span)
    got = matching.matched_twins(spark.createDataFrame(treated, COLS), spark.createDataFrame(controls, COLS), rule, s=s)
    assert {r["orderNumber"]: r["c_order"] for r in got.collect()} == want
    assert len(want) > 10


def test_states_of_a_large_log_are_not_merged_before_they_are_multiplied(spark):
    rng = random.Random(5)
    treated, controls = (spark.createDataFrame(states(rng, 200, start), COLS) for start in (0, 1000))
    kept = {k: spark.conf.get(k, None) for k in (session.INITIAL_KEY, session.ADVISORY_KEY)}
    try:
        want = matching.matched_twins(treated, controls).collect()
        session.spread(spark, 40 * session.TASK_ROWS)
        pairs = matching.matched_twins(treated, controls)
        assert sorted(pairs.collect()) == sorted(want) and want
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        # what is exploded comes from tasks that are not merged, a quarter of those of the log
        assert re.search(r"hashpartitioning\([^)]*, 10\), REPARTITION_BY_NUM", plan)
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("span", [41, 300])
def test_run_impact_does_not_depend_on_block_width(tables, span):
    small = replace(SPINE, block_span=span, clock_span=64)
    assert same_rows(tables.impact, impact.run_impact(tables.enriched, s=small))


def test_incremental_append_keeps_saved_rows(spark):
    saved = spark.createDataFrame([(1, "old", 1), (1, "older", 0)], "k int, v string, o int")
    new = spark.createDataFrame([(1, "new", 0), (2, "b", 2), (2, "a", 1)], "k int, v string, o int")
    assert sorted(tuple(r) for r in readers.incremental_append(saved, new, ["k"], "o").collect()) == [(1, "older", 0), (2, "a", 1)]


def test_value_blocks_give_the_same_ranks(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(rng.choice("xy"), float(rng.randint(0, 50))) for _ in range(400)], "g string, v double")
    measures = {"n": F.count("*")}
    one = A.value_prefix(df, ["g"], "v", measures)
    many = A.value_prefix(df, ["g"], "v", measures, rows_per_block=5)
    assert same_rows(one, many)


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (9.99,), (10.0,), (10.5,), (-1.0,)], "v double")
    assert {r["bin"]: r["n"] for r in A.histogram(df, [], "v", 0, 5, 2).collect()} == {0: 2, 1: 2}


def test_interval_join_splits_hot_buckets(spark):
    """One entity holds a third of the rows, all of them in one bucket."""
    points = [(1, i % 50, i) for i in range(600)] + [(2 + i % 40, (i * 7) % 300, 1000 + i) for i in range(1200)]
    intervals = [(1, a, a + 30, a) for a in range(0, 50, 2)] + [(k, a, a + 25, 100 * k + a) for k in range(2, 42) for a in range(0, 300, 60)]
    pts = spark.createDataFrame(points, "g long, t long, p long")
    spans = spark.createDataFrame(intervals, "g long, a long, b long, i long")
    got = {(r["p"], r["i"]) for r in joins.interval_join(pts, spans, ["g"], "t", "a", "b", width=60, pairs_per_key=200).collect()}
    want = {(p, i) for g, t, p in points for h, a, b, i in intervals if g == h and a <= t < b}
    assert got == want
    cut = spans.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("a") / 60), F.floor(F.col("b") / 60))))
    left, right = joins.salted_sides(pts.withColumn("_bucket", F.floor(F.col("t") / 60)), cut, ["g", "_bucket"], 200)
    key = ["g", "_bucket", "_salt"]
    load = left.groupBy(*key).count().join(right.groupBy(*key).agg(F.count("*").alias("m")), key).select((F.col("count") * F.col("m")).alias("n"))
    sizes = sorted(r["n"] for r in load.collect())
    assert sizes[-1] <= 2 * 200 and left.count() == len(points)
    whole = left.groupBy("g", "_bucket").count().join(right.dropDuplicates(["g", "_bucket", "i"]).groupBy("g", "_bucket").agg(F.count("*").alias("m")), ["g", "_bucket"])
    assert whole.agg(F.max(F.col("count") * F.col("m"))).first()[0] > 10_000


def test_total_before_is_strict(spark):
    rows = spark.createDataFrame([(1, 5.0, 2), (1, 5.0, 3), (1, 9.0, 10), (2, 1.0, 7), (None, 4.0, 1)], "g long, t double, v long")
    asked = spark.createDataFrame([(1, 5.0), (1, 5.5), (1, 9.0), (1, 100.0), (2, 0.0), (3, 8.0), (None, 5.0)], "g long, x double")
    got = {(r["g"], r["x"]): r["before"] for r in joins.total_before(asked, rows, ["g"], "t", "v", "x", 60).collect()}
    assert got == {(1, 5.0): 0, (1, 5.5): 5, (1, 9.0): 5, (1, 100.0): 15, (2, 0.0): 0, (3, 8.0): 0, (None, 5.0): 1}


def test_fatigue_forms_no_pairs(tables):
    from eddyline.plans import questions

    plan = questions.fatigue_by_stint_minute(tables.enriched, tables.stints, min_minutes=1)._jdf.queryExecution().executedPlan().toString()
    assert "_bucket" not in plan and "NestedLoop" not in plan


def test_ranges_cover_the_window_with_few_nodes(spark):
    rows = [(lo, lo + n) for lo in range(0, 70, 7) for n in (0, 1, 5, 31, 60, 61)] + [(5, 4)]
    df = spark.createDataFrame(rows, "lo long, hi long")
    for r in df.select("lo", "hi", joins.ranges_of(F.col("lo"), F.col("hi"), 6).alias("nodes")).collect():
        covered = sorted(x for n in r["nodes"] for x in range(n["node"] << n["level"], (n["node"] + 1) << n["level"]))
        assert covered == list(range(r["lo"], r["hi"] + 1)) and len(r["nodes"]) <= 2 * 6
