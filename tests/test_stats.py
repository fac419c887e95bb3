import itertools
import math
from collections import Counter

import numpy as np
import pytest

from eddyline.functions import distributions as D
from eddyline.functions import exact_tails
from eddyline.plans import decisions, resampling, stats, windows, winprob


def frame(spark, a, b):
    rows = [("a", float(x)) for x in a] + [("b", float(x)) for x in b]
    return spark.createDataFrame(rows, "sample string, value double")


def test_tail_probabilities():
    assert 1 - D.t_two_sided(2.228, 10) / 2 == pytest.approx(0.975, abs=1e-5)
    assert D.t_two_sided(np.array([0.0, 1e9]), 5) == pytest.approx([1.0, 0.0], abs=1e-9)
    assert D.critical_chi2(0.05, 1) == pytest.approx(3.841458820694124, abs=1e-9)
    assert D.chi2_sf(np.array([18.307038]), np.array([10.0]))[0] == pytest.approx(0.05, abs=1e-7)
    assert D.critical_norm(0.05) == pytest.approx(1.959963984540054, abs=1e-9)
    assert D.t_quantile(0.975, np.array([9.0]))[0] == pytest.approx(2.2621571628, abs=1e-8)
    assert D.kolmogorov_sf(np.array([1.3580986]))[0] == pytest.approx(0.05, abs=1e-5)


def test_welch_by_hand_and_small_groups(spark):
    a, b = [1, 2, 3, 4, 5.5], [2, 2, 7, 9]
    m = stats.welch_p(stats.two_sample(frame(spark, a, b), [], "value")).first()
    va, vb = np.var(a, ddof=1) / len(a), np.var(b, ddof=1) / len(b)
    assert m["t_stat"] == pytest.approx((np.mean(a) - np.mean(b)) / math.sqrt(va + vb))
    assert m["df"] == pytest.approx((va + vb) ** 2 / (va**2 / 4 + vb**2 / 3))
    assert 0.2 < m["p_value"] < 0.6 and m["sig"] == "n.s."
    one = stats.welch_p(stats.two_sample(frame(spark, [1], [2, 3]), [], "value")).first()
    assert one["t_stat"] is None and one["sig"] == "n/a"
    flat = stats.welch(stats.two_sample(frame(spark, [1, 1], [1, 1]), [], "value")).first()
    assert flat["t_stat"] is None and flat["diff"] == 0


@pytest.mark.parametrize(("x", "stat"), [([3.0], None), ([0.0, 0.0], 0.0), ([2.0, 2.0], math.inf)])
def test_glrt_degenerate_groups(spark, x, stat):
    got = stats.glrt_zero_mean(spark.createDataFrame([(v,) for v in x], "x double"), [], "x").first()
    assert got["glrt_stat"] == stat


def test_glrt_equals_its_t_form(spark):
    x = [0.3, -0.2, 1.5, 0.9, -0.4, 2.2]
    got = stats.glrt_zero_mean_p(stats.glrt_zero_mean(spark.createDataFrame([(v,) for v in x], "x double"), [], "x")).first()
    assert got["glrt_stat"] == pytest.approx(len(x) * math.log1p(got["t_stat"] ** 2 / (len(x) - 1)))
    assert got["ci_low"] < got["mean"] < got["ci_high"]


def test_chi2_by_hand(spark):
    rows = [("a", "x")] * 10 + [("a", "y")] * 20 + [("a", "z")] * 5 + [("b", "x")] * 15 + [("b", "y")] * 15 + [("b", "z")] * 8
    df = spark.createDataFrame(rows, "sample string, c string")
    table = np.array([[10, 20, 5], [15, 15, 8]])
    expected = table.sum(1, keepdims=True) * table.sum(0) / table.sum()
    got = stats.chi2_independence(df, [], "c").first()
    assert got["chi2"] == pytest.approx(((table - expected) ** 2 / expected).sum())
    assert got["dof"] == 2


def test_rank_and_ecdf_tests_against_numpy(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 12, 60), rng.integers(2, 14, 45)
    df = frame(spark, a, b)
    u = stats.mann_whitney(df, [], "value", rows_per_block=4).first()
    assert u["u_stat"] == sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    d = stats.ks_two_sample(df, [], "value", rows_per_block=3).first()
    points = np.unique(np.concatenate([a, b]))
    want = max(abs((a <= p).mean() - (b <= p).mean()) for p in points)
    assert d["d_stat"] == pytest.approx(want)


def test_neyman_pearson_can_reject(spark):
    rng = np.random.default_rng(5)
    far = frame(spark, rng.normal(3, 1, 80), rng.normal(0, 1, 80))
    assert stats.neyman_pearson(stats.two_sample(far, [], "value")).first()["reject"]
    same = rng.normal(0, 1, 80)
    near = frame(spark, same, same)
    assert not stats.neyman_pearson(stats.two_sample(near, [], "value")).first()["reject"]


def test_bernoulli_branch(spark):
    m = stats.two_sample(frame(spark, [1] * 30 + [0] * 10, [1] * 15 + [0] * 25), [], "value")
    got = stats.glrt_two_sample(m).first()
    def ll(x, n, p):
        return x * math.log(p) + (n - x) * math.log(1 - p)
    assert got["binary"] and got["dof"] == 1
    assert got["glrt_stat"] == pytest.approx(2 * (ll(30, 40, 0.75) + ll(15, 40, 0.375) - ll(45, 80, 45 / 80)))


def test_resampling_agrees_with_welch(spark):
    rng = np.random.default_rng(9)
    df = frame(spark, np.round(rng.normal(0.35, 1, 120), 1), np.round(rng.normal(0, 1, 150), 1))
    p_welch = stats.welch_p(stats.two_sample(df, [], "value")).first()["p_value"]
    perm = resampling.permutation_test(df, "value", replicates=4000).first()
    assert perm["p_value"] == pytest.approx(p_welch, abs=0.02)
    assert resampling.permutation_test(df, "value", replicates=4000).first()["p_value"] == perm["p_value"]
    ci = resampling.bootstrap_ci(df, "value", replicates=4000).first()
    assert ci["ci_low"] < perm["statistic"] == ci["statistic"] < ci["ci_high"]
    assert ci["decision"] == "significant" and perm["decision"] == "Reject H0"


@pytest.mark.parametrize("blocks", [4096, 16])
def test_replicates_keep_sizes_mean_and_variance(spark, blocks):
    rng = np.random.default_rng(2)
    df = frame(spark, rng.normal(0.3, 1, 90), rng.exponential(1, 140))
    out = resampling.null_checks(df, "value", replicates=4000, blocks=blocks).collect()
    assert all(r["ok"] for r in out) and len(out) == 6
    table = resampling.block_table(df, "value", blocks=blocks)
    assert table.sizes == (90, 140) and len(table.n[0]) <= blocks
    pooled = np.array([r["value"] for r in df.collect()])
    expected = {r["check"]: r["expected"] for r in out}
    assert expected["permutation variance"] == pytest.approx(pooled.var(ddof=1) * (1 / 90 + 1 / 140))


def test_permutations_of_a_tiny_sample_have_the_exact_distribution(spark):
    df = frame(spark, [1, 2, 4], [3, 8])
    null = resampling.permutation_null(df, resampling.block_table(df, "value"), replicates=20000)
    got = {round(r["diff"], 6): r["count"] / 20000 for r in null.groupBy("diff").count().collect()}
    x = [1, 2, 4, 3, 8]
    want = Counter(round(sum(c) / 3 - (18 - sum(c)) / 2, 6) for c in itertools.combinations(x, 3))
    assert set(got) == set(want) and all(abs(got[d] - n / 10) < 0.01 for d, n in want.items())


def test_resampling_without_a_second_sample(spark):
    df = frame(spark, [1.0, 2.0], [])
    assert resampling.permutation_test(df, "value").count() == 0 and resampling.bootstrap_ci(df, "value").count() == 0


def test_labels_split_down_the_tree():
    rng = np.random.default_rng(1)
    sizes = np.array([5, 0, 3, 7, 1])
    k = resampling.split_labels(rng, sizes, np.full(4000, 6))
    assert (k.sum(1) == 6).all() and (k <= sizes).all() and (k >= 0).all()
    assert k.mean(0) == pytest.approx(6 * sizes / 16, abs=0.08)
    huge = resampling.split_labels(rng, np.array([3e9, 5e9]), np.full(200, 2_000_000_000))
    assert (huge.sum(1) == 2e9).all() and huge[:, 0].mean() == pytest.approx(7.5e8, rel=1e-4)


def test_rank_tails_equal_enumeration():
    for n in range(1, 9):
        for m in range(1, 9 if n < 5 else 6):
            us = Counter(sum(a > b for a in c for b in set(range(n + m)) - set(c)) for c in itertools.combinations(range(n + m), n))
            total = math.comb(n + m, n)
            for u in range(n * m + 1):
                low = min(u, n * m - u)
                want = min(1.0, 2 * sum(c for v, c in us.items() if v <= low) / total)
                assert exact_tails.rank_p([n], [m], [u])[0] == pytest.approx(want, abs=1e-12)
    # beyond the counted sizes the smaller sample's ranks are like uniform draws
    near = exact_tails._rank_tail(3, 300_000, 250_000)
    far = exact_tails._rank_tail(3, 350_000, 291_666)
    assert near == pytest.approx(far, abs=1e-5)


def test_ks_tails_equal_enumeration_and_the_limit():
    for n in range(1, 9):
        for m in range(1, 9 if n < 5 else 6):
            gaps = Counter()
            for c in itertools.combinations(range(n + m), n):
                i, worst = 0, 0
                for k in range(n + m):
                    i += k in c
                    worst = max(worst, abs(i * m - (k + 1 - i) * n))
                gaps[worst] += 1
            total = math.comb(n + m, n)
            for h in gaps:
                want = sum(c for g, c in gaps.items() if g >= h) / total
                assert exact_tails.ks_p([n], [m], [h / (n * m)])[0] == pytest.approx(want, abs=1e-12)
    d = 1.2 / math.sqrt(5000)
    assert exact_tails.ks_p([10000], [10000], [d])[0] == pytest.approx(D.kolmogorov_sf(np.array([1.2]))[0], abs=5e-3)


def test_decisions_by_hand(spark):
    rows = [(1, "a", float(v)) for v in range(10, 16)] + [(1, "b", float(v)) for v in range(6)] + [(2, "a", 1.0), (2, "a", 4.0), (2, "b", 2.0), (2, "b", 3.0), (3, "a", 1.0)]
    df = spark.createDataFrame(rows, "g int, sample string, value double")
    got = {r["g"]: r for r in decisions.mann_whitney(df, ["g"], "value").collect()}
    assert got[1]["p_value"] == pytest.approx(2 / 924) and got[1]["method"] == "exact" and got[1]["decision"] == "Reject H0"
    assert got[2]["p_value"] == pytest.approx(1.0) and got[2]["decision"] == "Fail to Reject H0"
    assert got[3]["p_value"] is None and got[3]["decision"] == "Fail to Reject H0"
    ks = {r["g"]: r for r in decisions.ks_two_sample(df, ["g"], "value").collect()}
    assert ks[1]["d_stat"] == 1 and ks[1]["p_value"] == pytest.approx(2 / 924) and ks[2]["p_value"] == pytest.approx(1.0)
    w = {r["g"]: r for r in decisions.welch(stats.two_sample(df, ["g"], "value")).collect()}
    assert w[1]["critical_value"] == pytest.approx(2.5705818, abs=1e-6) and w[1]["decision"] == "Reject H0" and w[3]["critical_value"] is None
    joint = decisions.joint(stats.two_sample(df.where("g = 1"), [], "value")).first()
    assert joint["detected"]


def test_sprt_stops_at_the_first_crossing(spark):
    rows = [(1, i, "a", 1.0 + 0.1 * (i % 3)) for i in range(60)] + [(1, 100 + i, "b", 0.1 * (i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "g int, o long, sample string, value double")
    got = stats.sprt(df, ["g"], "value", "o").first()
    assert got["decision"] == "reject" and 1 <= got["decision_n"] < 60


def test_odd_windows_and_unknown_metrics_are_refused(tables):
    with pytest.raises(ValueError):
        windows.event_windows(tables.enriched, tables.possessions, 5)
    with pytest.raises(ValueError):
        windows.pre_post_summary(tables.enriched, [], "other")


def test_model_finds_a_planted_signal(spark):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(300):
        won = bool(g % 2)
        for p in range(4):
            margin = int(rng.normal(6 if won else -6, 6))
            rows.append((g, p, margin, 1 + p, 300, abs(margin) < 5, bool(p % 2), 0, False, 0.5, 0.5, 0.0, won))
    cols = "gameId long, possession_id long, score_margin long, period long, seconds_remaining long, is_clutch boolean, poss_is_home boolean, streak long, IsPlayoff boolean, home_wpct double, away_wpct double, wpct_diff double, home_won boolean"
    train_rows, test_rows = winprob.holdout_split(spark.createDataFrame(rows, cols))
    assert train_rows.select("gameId").intersect(test_rows.select("gameId")).isEmpty()
    model = winprob.train(train_rows, max_iter=50)
    score = winprob.evaluate(winprob.predict(model, test_rows)).first()
    assert score["auc"] > 0.85 and score["brier"] < 0.2
    assert winprob.coefficients(model, train_rows).first()["feature"] == "score_margin"
    proof = winprob.certificate(model, train_rows).collect()
    assert all(r["ok"] for r in proof) and len(proof) == 11
    early = winprob.train(train_rows, max_iter=2)
    assert not all(r["ok"] for r in winprob.certificate(early, train_rows).collect())
