"""Registered queries: hypothesis tests, resampling, the outcome model."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from eddyline.catalog.common import longs, r6, rounded
from eddyline.catalog.oracle_parts import oracle
from eddyline.catalog.oracle_parts import r6 as R
from eddyline.functions import distributions as D
from eddyline.functions.predicates import SampleSpec
from eddyline.plans import decisions, resampling, samples, stats, windows, winprob
from eddyline.session import stage
from eddyline.streaming import ordered

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
key = ["gameId", "orderNumber"]


def register(name: str, sql: str | None = None, extra: dict[str, str] | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = oracle(sql, extra)
        return fn

    return keep


def points(t):
    """Points per possession: right after an intervention (a) against the rest (b)."""
    return samples.split_by(t.enriched, "possession_points", F.col("prev_action_type").eqNullSafe("timeout"))


def shots(t):
    """Makes of shots: home side (a) against the visitors (b)."""
    return samples.split_by(t.plays, "shot_made", F.col("teamId").eqNullSafe(F.col("home_teamId")))


def _integral(f, upper, steps=2000):
    """Simpson's rule over [0, upper]; ``f`` maps the SQL of a place to that of a value."""
    weight = f"CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"({upper}) / {3 * steps}.0 * list_sum(list_transform(range(0, {steps + 1}), lambda i: ({weight}) * ({f(f'(({upper}) * i / {steps}.0)')})))"


def p_norm(z):
    return f"greatest(0, 1 - 2 * {_integral(lambda x: f'exp(-{x} * {x} / 2) / sqrt(2 * pi())', f'least(abs({z}), 12)')})"


def p_t(t, v):
    return f"greatest(0, 1 - 2 * {_integral(lambda x: f'exp(lgamma(({v} + 1) / 2.0) - lgamma({v} / 2.0)) / sqrt({v} * pi()) * pow(1 + {x} * {x} / {v}, -({v} + 1) / 2.0)', f'abs({t})')})"


def p_chi2(q, k):
    """The density of the root of the statistic is smooth for every k."""
    return f"greatest(0, 1 - {_integral(lambda x: f'2 * pow({x}, {k} - 1) * exp(-{x} * {x} / 2) / (pow(2, {k} / 2.0) * exp(lgamma({k} / 2.0)))', f'sqrt({q})')})"


def q_t(v):
    """0.975 quantile by an expansion around the normal one, for many degrees of freedom."""
    z = "1.959963984540054"
    terms = f"(pow({z}, 3) + {z}) / (4 * {v}) + (5 * pow({z}, 5) + 16 * pow({z}, 3) + 3 * {z}) / (96 * pow({v}, 2)) + (3 * pow({z}, 7) + 19 * pow({z}, 5) + 17 * pow({z}, 3) - 15 * {z}) / (384 * pow({v}, 3))"
    return f"{z} + {terms}"


def q_chi2(rows, steps=4):
    """Tables that add q95, the 0.95 quantile for ``dof``, to ``rows``: Newton steps from the
    cube root form."""
    tables = {"q0": f"SELECT *, dof * pow(1 - 2 / (9.0 * dof) + 1.6448536269514722 * sqrt(2 / (9.0 * dof)), 3) AS q95 FROM {rows}"}
    density = "exp((dof / 2.0 - 1) * ln(q95) - q95 / 2 - lgamma(dof / 2.0) - dof / 2.0 * ln(2))"
    for k in range(1, steps + 1):
        tables[f"q{k}"] = f"SELECT * EXCLUDE (q95), q95 + ({p_chi2('q95', 'dof')} - 0.05) / {density} AS q95 FROM q{k - 1}"
    return tables


def verdict(condition):
    return f"CASE WHEN {condition} THEN 'Reject H0' ELSE 'Fail to Reject H0' END AS decision"


def sig(p):
    return f"CASE WHEN {p} < 0.001 THEN '***' WHEN {p} < 0.01 THEN '**' WHEN {p} < 0.05 THEN '*' ELSE 'n.s.' END AS sig"


BOTH = {
    "m": """SELECT season_type, count(x) FILTER (WHERE sample = 'a') AS n_a, count(x) FILTER (WHERE sample = 'b') AS n_b,
avg(x) FILTER (WHERE sample = 'a') AS ma, avg(x) FILTER (WHERE sample = 'b') AS mb, var_samp(x) FILTER (WHERE sample = 'a') AS va, var_samp(x) FILTER (WHERE sample = 'b') AS vb,
var_pop(x) FILTER (WHERE sample = 'a') AS pa, var_pop(x) FILTER (WHERE sample = 'b') AS pb, var_pop(x) AS pv FROM samp GROUP BY season_type""",
    "ms": """SELECT season_type, count(*) FILTER (WHERE sample = 'a') AS n_a, count(*) FILTER (WHERE sample = 'b') AS n_b,
sum(x) FILTER (WHERE sample = 'a') AS xa, sum(x) FILTER (WHERE sample = 'b') AS xb FROM shots GROUP BY season_type""",
}
WELCH_DF = "pow(va / n_a + vb / n_b, 2) / (pow(va / n_a, 2) / (n_a - 1) + pow(vb / n_b, 2) / (n_b - 1))"


@register("test_welch", f"SELECT season_type, n_a, n_b, {R('ma - mb', 'diff')}, {R('(ma - mb) / sqrt(va / n_a + vb / n_b)', 't_stat')}, {R(WELCH_DF, 'df')} FROM m", BOTH)
def _(t):
    out = stats.welch(stats.two_sample(points(t), ["season_type"], "value"))
    return rounded(out.select("season_type", "n_a", "n_b", "diff", "t_stat", "df"), ["diff", "t_stat", "df"])


WELCH = {**BOTH, "wl": f"SELECT season_type, least(n_a, n_b) - 1 AS less, (ma - mb) / sqrt(va / n_a + vb / n_b) AS t, {WELCH_DF} AS v FROM m", "wp": f"SELECT *, {p_t('t', 'v')} AS p FROM wl"}


@register("test_welch_p", f"SELECT season_type, {R('t', 't_stat')}, {R('v', 'df')}, {R('p', 'p_value')}, {sig('p')} FROM wp", WELCH)
def _(t):
    out = stats.welch_p(stats.two_sample(points(t), ["season_type"], "value"))
    return rounded(out.select("season_type", "t_stat", "df", "p_value", "sig"), ["t_stat", "df", "p_value"])


@register("test_welch_decision", f"SELECT season_type, {R('t', 't_stat')}, {R('p', 'p_value')}, {R(q_t('less'), 'critical_value')}, {verdict('p < 0.05')} FROM wp", WELCH)
def _(t):
    out = decisions.welch(stats.two_sample(points(t), ["season_type"], "value"))
    return rounded(out.select("season_type", "t_stat", "p_value", "critical_value", "decision"), ["t_stat", "p_value", "critical_value"])


ONE = f"count(*) AS n, {R('avg(x)', 'mean')}, {R('stddev_samp(x)', 'std')}, {R('avg(x) / (stddev_samp(x) / sqrt(count(*)))', 't_stat')}"


@register("test_t1", f"SELECT season, {ONE} FROM (SELECT season, net_change AS x FROM evw) q GROUP BY season")
def _(t):
    rows = t.events
    return rounded(stats.one_sample(rows, ["season"], "net_change"), ["mean", "std", "t_stat"])


ONE_P = {"t1": "SELECT season, count(*) AS n, avg(net_change) AS mean, stddev_samp(net_change) AS std, avg(net_change) / (stddev_samp(net_change) / sqrt(count(*))) AS t FROM evw GROUP BY season", "t1p": f"SELECT *, {p_t('t', '(n - 1)')} AS p FROM t1"}


@register("test_t1_p", f"SELECT season, n, {R('mean', 'mean')}, {R('std', 'std')}, {R('t', 't_stat')}, {R('p', 'p_value')}, {sig('p')} FROM t1p", ONE_P)
def _(t):
    rows = t.events
    return rounded(stats.one_sample_p(stats.one_sample(rows, ["season"], "net_change")), ["mean", "std", "t_stat", "p_value"])


GLRT = f"count(*) AS n, {R('avg(x)', 'mean')}, {R('stddev_samp(x)', 'std')}, {R('var_pop(x)', 'sigma2_h1')}, {R('var_pop(x) + avg(x) * avg(x)', 'sigma2_h0')}, {R('count(*) * ln(1 + avg(x) * avg(x) / var_pop(x))', 'glrt_stat')}, {R('avg(x) / (stddev_samp(x) / sqrt(count(*)))', 't_stat')}"
GLRT_COLS = ["mean", "std", "sigma2_h1", "sigma2_h0", "glrt_stat", "t_stat"]


@register("glrt_zero_mean", f"SELECT {GLRT} FROM (SELECT net_post::DOUBLE AS x FROM evw) q")
def _(t):
    rows = t.events
    return rounded(stats.glrt_zero_mean(rows, [], "net_post"), GLRT_COLS)


@register("glrt_groups", f"SELECT time_bucket, {GLRT} FROM (SELECT time_bucket, excess_net_post AS x FROM evb WHERE excess_net_post IS NOT NULL) q GROUP BY time_bucket HAVING count(*) >= 10")
def _(t):
    rows = t.event_table
    return rounded(stats.glrt_zero_mean(rows, ["time_bucket"], "excess_net_post", 10), GLRT_COLS)


GLRT_P = {
    "gz": "SELECT time_bucket, count(*) AS n, avg(x) AS mean, stddev_samp(x) AS std, var_pop(x) AS h1, var_pop(x) + avg(x) * avg(x) AS h0, count(*) * ln(1 + avg(x) * avg(x) / var_pop(x)) AS g, avg(x) / (stddev_samp(x) / sqrt(count(*))) AS t FROM (SELECT time_bucket, excess_net_post AS x FROM evb WHERE excess_net_post IS NOT NULL) q GROUP BY time_bucket HAVING count(*) >= 10",
    "gp": f"SELECT *, {p_chi2('g', '1')} AS pg, {p_t('t', '(n - 1)')} AS pt FROM gz",
}


@register("glrt_groups_p", f"SELECT time_bucket, n, {R('mean', 'mean')}, {R('std', 'std')}, {R('h1', 'sigma2_h1')}, {R('h0', 'sigma2_h0')}, {R('g', 'glrt_stat')}, {R('t', 't_stat')}, {R('pg', 'glrt_p')}, {R('pt', 't_p')}, {R('3.841458820694124', 'critical_value')}, g > 3.841458820694124 AS reject, {sig('pg')} FROM gp", GLRT_P)
def _(t):
    rows = t.event_table
    out = stats.glrt_zero_mean_p(stats.glrt_zero_mean(rows, ["time_bucket"], "excess_net_post", 10))
    # the interval needs quantiles for few degrees of freedom: see the unit tests
    return rounded(out.drop("ci_low", "ci_high"), [*GLRT_COLS, "glrt_p", "t_p", "critical_value"])


SWEEP = {
    "gsw0": " UNION ALL ".join(f"SELECT '{m}' AS metric, {m}::DOUBLE AS x, time_bucket, season_type, timeout_cause FROM evb" for m in ("net_change", "excess_net_post", "excess_h2h_net_post")),
    "gsw": "SELECT metric, x, 'all' AS slice, 'all' AS level FROM gsw0" + "".join(f" UNION ALL SELECT metric, x, '{c}', {c} FROM gsw0" for c in ("time_bucket", "season_type", "timeout_cause")),
}


def _sweep(t):
    rows = t.event_table
    return stats.glrt_sweep(rows, ["net_change", "excess_net_post", "excess_h2h_net_post"], ["time_bucket", "season_type", "timeout_cause"], 10)


@register("glrt_sweep", f"SELECT metric, slice, level, {GLRT} FROM gsw WHERE x IS NOT NULL GROUP BY ALL HAVING count(*) >= 10", SWEEP)
def _(t):
    return rounded(_sweep(t), GLRT_COLS)


@register("glrt_null_check", "SELECT floor(g)::BIGINT AS bin, count(*) AS n_tests, count(*) FILTER (WHERE g > 3.841458820694124) AS n_reject FROM (SELECT count(*) * ln(1 + avg(x) * avg(x) / var_pop(x)) AS g FROM gsw WHERE x IS NOT NULL GROUP BY metric, slice, level HAVING count(*) >= 10) q GROUP BY 1", SWEEP)
def _(t):
    return stats.glrt_null_check(_sweep(t))


@register("sig_label", "SELECT c_custkey, CASE WHEN c_acctbal < 10 THEN '***' WHEN c_acctbal < 100 THEN '**' WHEN c_acctbal < 500 THEN '*' ELSE 'n.s.' END AS sig FROM customer")
def _(t):
    return t.raw("customer").select("c_custkey", D.sig_label(F.col("c_acctbal") / 10000).alias("sig"))


@register("test_prop_z", f"""SELECT season_type, n_a, n_b, {R('xa / n_a', 'p1')}, {R('xb / n_b', 'p2')}, {R('(xa + xb) / (n_a + n_b)', 'pooled')},
{R('(xa / n_a - xb / n_b) / sqrt((xa + xb) / (n_a + n_b) * (1 - (xa + xb) / (n_a + n_b)) * (1 / n_a + 1 / n_b))', 'z_stat')} FROM ms""", BOTH)
def _(t):
    out = stats.prop_z(stats.two_sample(shots(t), ["season_type"], "value"))
    return rounded(out.select("season_type", "n_a", "n_b", "p1", "p2", "pooled", "z_stat"), ["p1", "p2", "pooled", "z_stat"])


PROP = {**BOTH, "pz": "SELECT season_type, (xa / n_a - xb / n_b) / sqrt((xa + xb) / (n_a + n_b) * (1 - (xa + xb) / (n_a + n_b)) * (1 / n_a + 1 / n_b)) AS z FROM ms"}


@register("test_prop_z_p", f"SELECT season_type, {R('z', 'z_stat')}, {R(p_norm('z'), 'p_value')} FROM pz", PROP)
def _(t):
    out = stats.prop_z(stats.two_sample(shots(t), ["season_type"], "value"))
    return rounded(out.select("season_type", "z_stat", D.p_norm_two_sided(F.col("z_stat")).alias("p_value")), ["z_stat", "p_value"])


@register("test_prop_z_decision", f"SELECT season_type, {R('z', 'z_stat')}, {R(p_norm('z'), 'p_value')}, {R('1.959963984540054', 'critical_value')}, {verdict('abs(z) > 1.959963984540054')} FROM pz", PROP)
def _(t):
    out = decisions.prop_z(stats.two_sample(shots(t), ["season_type"], "value"))
    return rounded(out.select("season_type", "z_stat", "p_value", "critical_value", "decision"), ["z_stat", "p_value", "critical_value"])


CHI = {
    "ct": "SELECT season_type, outcome, count(*) FILTER (WHERE sample = 'a') AS a, count(*) FILTER (WHERE sample = 'b') AS b FROM oc_s GROUP BY ALL",
    "oc_s": """SELECT p.season_type, o.possession_outcome AS outcome, CASE WHEN p.possession = h.home_teamId THEN 'a' ELSE 'b' END AS sample
FROM possn p JOIN outc o USING (gameId, possession_id) LEFT JOIN home h ON h.gameId = p.gameId""",
    "cx": "SELECT *, sum(a) OVER (PARTITION BY season_type) AS na, sum(b) OVER (PARTITION BY season_type) AS nb FROM ct",
}


def _outcome_samples(t):
    from eddyline.plans import state

    home = F.when(F.col("possession").eqNullSafe(F.col("home_teamId")), F.lit("a")).otherwise(F.lit("b"))
    poss = t.possessions.join(state.home_team(t.spine), "gameId", "left")
    return poss.join(state.possession_outcomes(t.plays), ["gameId", "possession_id"]).select(
        "season_type", F.col("possession_outcome").alias("outcome"), home.alias("sample")
    )


@register("test_chi2", f"""SELECT season_type, count(*) AS k, CAST(any_value(na) AS BIGINT) AS n_a, CAST(any_value(nb) AS BIGINT) AS n_b,
{R('sum(pow(a - na * (a + b) / (na + nb), 2) / (na * (a + b) / (na + nb)) + pow(b - nb * (a + b) / (na + nb), 2) / (nb * (a + b) / (na + nb)))', 'chi2')}, count(*) - 1 AS dof,
{R('sqrt(sum(pow(a - na * (a + b) / (na + nb), 2) / (na * (a + b) / (na + nb)) + pow(b - nb * (a + b) / (na + nb), 2) / (nb * (a + b) / (na + nb))) / any_value(na + nb))', 'cramers_v')}
FROM cx GROUP BY season_type""", CHI)
def _(t):
    return rounded(stats.chi2_independence(_outcome_samples(t), ["season_type"], "outcome"), ["chi2", "cramers_v"])


@register("test_chi2_2x2", f"""SELECT 2::BIGINT AS k, n_a, n_b, {R('(n_a + n_b) * pow(greatest(abs(xa * (n_b - xb) - xb * (n_a - xa)) - (n_a + n_b) / 2.0, 0), 2) / (n_a * n_b * (xa + xb) * (n_a + n_b - xa - xb))', 'chi2')}, 1::BIGINT AS dof
FROM (SELECT sum(n_a)::DOUBLE AS n_a, sum(n_b)::DOUBLE AS n_b, sum(xa) AS xa, sum(xb) AS xb FROM ms) q""", BOTH)
def _(t):
    out = stats.chi2_independence(shots(t), [], "value")
    return rounded(out.drop("cramers_v"), ["chi2", "n_a", "n_b"])


CHI_P = {**CHI, "cs": "SELECT season_type, count(*) AS k, CAST(any_value(na) AS BIGINT) AS n_a, CAST(any_value(nb) AS BIGINT) AS n_b, sum(pow(a - na * (a + b) / (na + nb), 2) / (na * (a + b) / (na + nb)) + pow(b - nb * (a + b) / (na + nb), 2) / (nb * (a + b) / (na + nb))) AS q, count(*) - 1 AS dof FROM cx GROUP BY season_type"}


@register("test_chi2_p", f"SELECT season_type, k, n_a, n_b, {R('q', 'chi2')}, dof, {R('sqrt(q / (n_a + n_b))', 'cramers_v')}, {R(p_chi2('q', 'dof'), 'p_value')} FROM cs", CHI_P)
def _(t):
    out = stats.chi2_independence(_outcome_samples(t), ["season_type"], "outcome")
    return rounded(out.withColumn("p_value", D.p_chi2(F.col("chi2"), F.col("dof"))), ["chi2", "cramers_v", "p_value"])


@register("test_chi2_decision", f"SELECT season_type, {R('q', 'chi2')}, {R(p_chi2('q', 'dof'), 'p_value')}, {R('q95', 'critical_value')}, {verdict('q > q95')} FROM q4", {**CHI_P, **q_chi2("cs")})
def _(t):
    out = decisions.chi2(_outcome_samples(t), ["season_type"], "outcome")
    return rounded(out.select("season_type", "chi2", "p_value", "critical_value", "decision"), ["chi2", "p_value", "critical_value"])


@register("test_chi2_expected", f"SELECT season_type, outcome, a AS observed_a, b AS observed_b, {R('na * (a + b) / (na + nb)', 'expected_a')}, {R('nb * (a + b) / (na + nb)', 'expected_b')} FROM cx WHERE outcome IS NOT NULL", CHI)
def _(t):
    return rounded(decisions.chi2_expected(_outcome_samples(t), ["season_type"], "outcome"), ["expected_a", "expected_b"])


VALUES = {
    "vc": "SELECT season_type, x, count(*) FILTER (WHERE sample = 'a') AS na, count(*) FILTER (WHERE sample = 'b') AS nb FROM samp GROUP BY ALL",
    "vr": "SELECT *, sum(na) OVER w AS ca, sum(nb) OVER w AS cb, sum(na) OVER g AS ta, sum(nb) OVER g AS tb FROM vc WINDOW w AS (PARTITION BY season_type ORDER BY x ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY season_type)",
    "mw": "SELECT season_type, CAST(sum(na) AS DOUBLE) AS n1, CAST(sum(nb) AS DOUBLE) AS n2, sum(na * (ca + cb - (na + nb) + (na + nb + 1) / 2)) AS r, sum(pow(na + nb, 3) - (na + nb)) AS ties FROM vr GROUP BY season_type",
    "mw2": "SELECT *, r - n1 * (n1 + 1) / 2 AS u, sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS sd FROM mw",
}


@register("test_mann_whitney", f"SELECT season_type, n1::BIGINT AS n_a, n2::BIGINT AS n_b, {R('u', 'u_stat')}, {R('(greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sd', 'z_stat')} FROM mw2", VALUES)
def _(t):
    return rounded(stats.mann_whitney(points(t), ["season_type"], "value"), ["u_stat", "z_stat"])


MANN = {**VALUES, "mz": "SELECT *, (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sd AS z FROM mw2"}


@register("test_mann_whitney_p", f"SELECT season_type, n1::BIGINT AS n_a, n2::BIGINT AS n_b, {R('u', 'u_stat')}, {R('z', 'z_stat')}, {R(p_norm('greatest(z, 0)'), 'p_value')}, 'normal' AS method, {verdict(p_norm('greatest(z, 0)') + ' < 0.05')} FROM mz", MANN)
def _(t):
    return rounded(decisions.mann_whitney(points(t), ["season_type"], "value"), ["u_stat", "z_stat", "p_value"])


def waits(t):
    """A value per event: interventions (a) against stoppages (b) of each game, few rows each."""
    kind = F.when(F.col("actionType") == "timeout", F.lit("a")).when(F.col("actionType") == "stoppage", F.lit("b"))
    return t.spine.select("gameId", "value", kind.alias("sample")).where("sample IS NOT NULL")


SMALL = {
    "sm": "SELECT gameId, value AS x, CASE actionType WHEN 'timeout' THEN 'a' ELSE 'b' END AS sample FROM spine WHERE actionType IN ('timeout', 'stoppage')",
    "sv": "SELECT gameId, x, count(*) FILTER (WHERE sample = 'a') AS na, count(*) FILTER (WHERE sample = 'b') AS nb FROM sm GROUP BY ALL",
    "sr": "SELECT *, sum(na) OVER w AS ca, sum(nb) OVER w AS cb, sum(na) OVER g AS ta, sum(nb) OVER g AS tb FROM sv WINDOW w AS (PARTITION BY gameId ORDER BY x ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY gameId)",
}
RANK_SMALL = {
    **SMALL,
    "sw": "SELECT gameId, CAST(sum(na) AS BIGINT) AS n1, CAST(sum(nb) AS BIGINT) AS n2, sum(na * (ca + cb - (na + nb) + (na + nb + 1) / 2)) - sum(na) * (sum(na) + 1) / 2 AS u, sum(pow(na + nb, 3) - (na + nb)) AS ties FROM sr GROUP BY gameId",
    "sz": "SELECT *, (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM sw",
    # arrangements of n and m labels with each U, label by label
    "arr": """WITH RECURSIVE f AS (SELECT 0 AS n, 0 AS m, 0 AS u, 1.0::DOUBLE AS c UNION ALL
SELECT n, m, u, sum(c) FROM (SELECT n + 1 AS n, m, u + m AS u, c FROM f WHERE n < 8 UNION ALL SELECT n, m + 1, u, c FROM f WHERE n + m < 60) q GROUP BY n, m, u) SELECT * FROM f""",
    "tail": "SELECT s.gameId, least(1, 2 * sum(a.c) FILTER (WHERE a.u <= least(s.u, n1 * n2 - s.u)) / sum(a.c)) AS p FROM sz s JOIN arr a ON a.n = least(n1, n2) AND a.m = greatest(n1, n2) GROUP BY s.gameId",
}
RANK_P = f"CASE WHEN least(n1, n2) <= 8 AND ties = 0 THEN p ELSE {p_norm('greatest(z, 0)')} END"


@register("test_mann_whitney_exact", f"SELECT gameId, n1 AS n_a, n2 AS n_b, {R('u', 'u_stat')}, {R('z', 'z_stat')}, CASE WHEN least(n1, n2) <= 8 AND ties = 0 THEN 'exact' ELSE 'normal' END AS method, {R(RANK_P, 'p_value')}, {verdict(RANK_P + ' < 0.05')} FROM sz LEFT JOIN tail USING (gameId)", RANK_SMALL)
def _(t):
    return rounded(decisions.mann_whitney(waits(t), ["gameId"], "value"), ["u_stat", "z_stat", "p_value"])


KS_SMALL = {
    **SMALL,
    "sd": "SELECT gameId, CAST(any_value(ta) AS BIGINT) AS n1, CAST(any_value(tb) AS BIGINT) AS n2, max(abs(ca / ta - cb / tb)) AS d, CAST(max(abs(ca * tb - cb * ta)) AS BIGINT) AS h FROM sr GROUP BY gameId",
    # lattice paths that stay inside the band, step by step
    "lat": """WITH RECURSIVE f AS (SELECT gameId, n1, n2, h, 0 AS i, 0 AS j, 1.0::DOUBLE AS c FROM sd UNION ALL
SELECT gameId, n1, n2, h, i, j, sum(c) FROM (SELECT gameId, n1, n2, h, i + 1 AS i, j, c FROM f WHERE i < n1 UNION ALL SELECT gameId, n1, n2, h, i, j + 1, c FROM f WHERE j < n2) q WHERE abs(i * n2 - j * n1) < h GROUP BY ALL) SELECT * FROM f""",
    "kp": "SELECT s.gameId, any_value(s.n1) AS n1, any_value(s.n2) AS n2, any_value(d) AS d, greatest(0, 1 - coalesce(max(c) FILTER (WHERE i = l.n1 AND j = l.n2), 0) / exp(lgamma(any_value(s.n1) + any_value(s.n2) + 1) - lgamma(any_value(s.n1) + 1) - lgamma(any_value(s.n2) + 1))) AS p FROM sd s LEFT JOIN lat l USING (gameId) GROUP BY s.gameId",
}


@register("test_ks2_exact", f"SELECT gameId, {R('d', 'd_stat')}, n1 AS n_a, n2 AS n_b, {R('p', 'p_value')}, {verdict('p < 0.05')} FROM kp", KS_SMALL)
def _(t):
    return rounded(decisions.ks_two_sample(waits(t), ["gameId"], "value"), ["d_stat", "p_value"])


@register("test_ks2", f"SELECT season_type, {R('max(abs(ca / ta - cb / tb))', 'd_stat')}, CAST(any_value(ta) AS BIGINT) AS n_a, CAST(any_value(tb) AS BIGINT) AS n_b FROM vr GROUP BY season_type", VALUES)
def _(t):
    return rounded(stats.ks_two_sample(points(t), ["season_type"], "value"), ["d_stat"])


# the same walk, as probabilities: each step takes a label of what is left
KS_P = {
    **VALUES,
    "kd": "SELECT season_type, CAST(any_value(ta) AS BIGINT) AS n1, CAST(any_value(tb) AS BIGINT) AS n2, max(abs(ca / ta - cb / tb)) AS d, CAST(max(abs(ca * tb - cb * ta)) AS BIGINT) AS h FROM vr GROUP BY season_type",
    "walk": """WITH RECURSIVE f AS (SELECT season_type, n1, n2, h, 0 AS i, 0 AS j, 1.0::DOUBLE AS c FROM kd UNION ALL
SELECT season_type, n1, n2, h, i, j, sum(c) FROM (SELECT season_type, n1, n2, h, i + 1 AS i, j, c * (n1 - i) / (n1 + n2 - i - j) AS c FROM f WHERE i < n1 UNION ALL SELECT season_type, n1, n2, h, i, j + 1, c * (n2 - j) / (n1 + n2 - i - j) FROM f WHERE j < n2) q WHERE abs(i * n2 - j * n1) < h GROUP BY ALL) SELECT * FROM f WHERE i = n1 AND j = n2""",
    "kq": "SELECT kd.*, greatest(0, 1 - coalesce(c, 0)) AS p FROM kd LEFT JOIN walk USING (season_type)",
}


@register("test_ks2_p", f"SELECT season_type, {R('d', 'd_stat')}, n1 AS n_a, n2 AS n_b, {R('p', 'p_value')}, {verdict('p < 0.05')} FROM kq", KS_P)
def _(t):
    return rounded(decisions.ks_two_sample(points(t), ["season_type"], "value"), ["d_stat", "p_value"])


@register("test_permutation")
def _(t):
    return resampling.permutation_test(points(t), "value")


@register("test_bootstrap")
def _(t):
    return resampling.bootstrap_ci(points(t), "value")


NULLS = {
    "nm": "SELECT count(*) FILTER (WHERE sample = 'a') AS a, count(*) FILTER (WHERE sample = 'b') AS b, var_samp(x) AS v, var_pop(x) FILTER (WHERE sample = 'a') AS va, var_pop(x) FILTER (WHERE sample = 'b') AS vb, avg(x) FILTER (WHERE sample = 'a') - avg(x) FILTER (WHERE sample = 'b') AS diff FROM {rows}",
}
NULL_ROWS = " UNION ALL ".join(
    f"SELECT '{c}' AS \"check\", {R(v, 'expected')}, true AS ok FROM nm"
    for c, v in (
        ("permutation sizes", "a + b"),
        ("permutation mean", "0"),
        ("permutation variance", "v * (1.0 / a + 1.0 / b)"),
        ("bootstrap sizes", "a + b"),
        ("bootstrap mean", "diff"),
        ("bootstrap variance", "va / a + vb / b"),
    )
)


@register("test_resampling_checks", NULL_ROWS, {"nm": NULLS["nm"].format(rows="samp")})
def _(t):
    return rounded(resampling.null_checks(points(t), "value"), ["expected"])


@register("test_resampling_checks_many_values", NULL_ROWS, {**SMALL, "nm": NULLS["nm"].format(rows="sm")})
def _(t):
    return rounded(resampling.null_checks(waits(t), "value", replicates=2500, blocks=256), ["expected"])


def lnv(v):
    return f"2 * ln(sqrt({v}) + 1e-15)"


@register("test_glrt2", f"SELECT season_type, {R('(n_a + n_b) * ' + lnv('pv') + ' - n_a * ' + lnv('pa') + ' - n_b * ' + lnv('pb'), 'glrt_stat')}, 2::BIGINT AS dof FROM m", BOTH)
def _(t):
    out = stats.glrt_two_sample(stats.two_sample(points(t), ["season_type"], "value"))
    return longs(rounded(out.select("season_type", "glrt_stat", "dof"), ["glrt_stat"]), ["dof"])


def lb(x, n, p):
    return f"({x} * ln({p} + 1e-15) + ({n} - {x}) * ln(1 - {p} + 1e-15))"


POOL = "(xa + xb) / (n_a + n_b)"


@register("test_glrt2_bernoulli", f"SELECT season_type, {R('2 * (' + lb('xa', 'n_a', 'xa / n_a') + ' + ' + lb('xb', 'n_b', 'xb / n_b') + ' - ' + lb('xa', 'n_a', POOL) + ' - ' + lb('xb', 'n_b', POOL) + ')', 'glrt_stat')}, 1::BIGINT AS dof FROM ms", BOTH)
def _(t):
    out = stats.glrt_two_sample(stats.two_sample(shots(t), ["season_type"], "value"))
    return longs(rounded(out.select("season_type", "glrt_stat", "dof"), ["glrt_stat"]), ["dof"])


GLRT2 = {**BOTH, "g2": f"SELECT *, (n_a + n_b) * {lnv('pv')} - n_a * {lnv('pa')} - n_b * {lnv('pb')} AS g FROM m"}


@register("test_glrt2_p", f"SELECT season_type, {R('g', 'glrt_stat')}, {R(p_chi2('g', '2'), 'p_value')} FROM g2", GLRT2)
def _(t):
    out = stats.glrt_two_sample(stats.two_sample(points(t), ["season_type"], "value"))
    return rounded(out.select("season_type", "glrt_stat", D.p_chi2(F.col("glrt_stat"), F.col("dof")).alias("p_value")), ["glrt_stat", "p_value"])


@register("test_glrt2_decision", f"SELECT season_type, {R('g', 'glrt_stat')}, {R('5.991464547107979', 'critical_value')}, {verdict('g > 5.991464547107979')} FROM g2", GLRT2)
def _(t):
    out = decisions.glrt(stats.two_sample(points(t), ["season_type"], "value"))
    return rounded(out.select("season_type", "glrt_stat", "critical_value", "decision"), ["glrt_stat", "critical_value"])


@register("test_neyman_pearson", f"SELECT season_type, {R('n_a * pow(ma - mb, 2) / (2 * pa)', 'llr')}, {R('(n_a * pow(ma - mb, 2) / (2 * pa) + n_a * pow(ma - mb, 2) / (2 * pa)) / (sqrt(n_a * pow(ma - mb, 2) / pa) + 1e-15)', 'z_stat')} FROM m", BOTH)
def _(t):
    out = stats.neyman_pearson(stats.two_sample(points(t), ["season_type"], "value"))
    return rounded(out.select("season_type", "llr", "z_stat"), ["llr", "z_stat"])


POWER = {
    **BOTH,
    "np": "SELECT season_type, n_a * pow(ma - mb, 2) / (2 * pa) AS llr, n_a * pow(ma - mb, 2) / pa AS s2 FROM m",
    "nq": f"SELECT *, -llr + 1.6448536269514722 * sqrt(s2) AS threshold, {p_norm('2 * llr / (sqrt(s2) + 1e-15)')} / 2 AS p FROM np",
}


@register("test_neyman_pearson_p", f"SELECT season_type, {R('llr', 'llr')}, {R('threshold', 'threshold')}, llr > threshold AS reject, {R('p', 'p_value')} FROM nq", POWER)
def _(t):
    out = stats.neyman_pearson(stats.two_sample(points(t), ["season_type"], "value"))
    out = out.select("season_type", "llr", "threshold", "reject", D.p_norm_upper(F.col("z_stat")).alias("p_value"))
    return rounded(out, ["llr", "threshold", "p_value"])


SPRT = {
    **BOTH,
    "sq": "SELECT s.season_type, orderNumber, row_number() OVER w AS i, sum((ma - mb) / pa * (x - (ma + mb) / 2)) OVER w AS c FROM samp s JOIN m ON m.season_type = s.season_type WHERE sample = 'a' WINDOW w AS (PARTITION BY s.season_type ORDER BY orderNumber ROWS UNBOUNDED PRECEDING)",
    "sx": "SELECT *, c >= ln(0.9 / 0.05) AS up, (c >= ln(0.9 / 0.05) OR c <= ln(0.1 / 0.95)) AS hit FROM sq",
}


@register("test_sprt", f"""SELECT season_type, count(*) AS n, {R('arg_max(c, i)', 'final_llr')}, min(i) FILTER (WHERE hit) AS decision_n,
CASE WHEN min(i) FILTER (WHERE hit) IS NULL THEN 'continue' WHEN arg_min(up, i) FILTER (WHERE hit) THEN 'reject' ELSE 'accept' END AS decision FROM sx GROUP BY season_type""", SPRT)
def _(t):
    return rounded(stats.sprt(points(t), ["season_type"], "value", "orderNumber"), ["final_llr"])


STREAM = {
    "ss": "SELECT season_type, row_number() OVER w AS i, sum((42 - 36) / 900.0::DOUBLE * (value - (42 + 36) / 2.0)) OVER w AS c FROM spine WHERE actionType = 'timeout' WINDOW w AS (PARTITION BY season_type ORDER BY orderNumber ROWS UNBOUNDED PRECEDING)",
    "sd": "SELECT *, c >= ln(0.9 / 0.05) AS up, (c >= ln(0.9 / 0.05) OR c <= ln(0.1 / 0.95)) AS hit FROM ss",
}


@register("stream_sprt", f"""SELECT season_type, max(i) AS n, {R('arg_max(c, i)', 'final_llr')}, min(i) FILTER (WHERE hit) AS decision_n,
CASE WHEN min(i) FILTER (WHERE hit) IS NULL THEN 'continue' WHEN arg_min(up, i) FILTER (WHERE hit) THEN 'reject' ELSE 'accept' END AS decision FROM sd GROUP BY season_type""", STREAM)
def _(t):
    calls = t.spine.where("actionType = 'timeout'").select("season_type", "orderNumber", "timeActual", "value")
    log = ordered.as_arrivals(calls, "timeActual", "sprt")
    tested = ordered.sprt(log, ["season_type"], "orderNumber", "timeActual", "value", "16 days", theta_0=36.0, theta_1=42.0, sigma2=900.0)
    last = ordered.run_available(tested, "sprt").groupBy("season_type").agg(F.max_by(F.struct("n", "llr", "decision_n", "decision"), "n").alias("r")).select("season_type", "r.*")
    return rounded(last.withColumnRenamed("llr", "final_llr"), ["final_llr"])


@register("test_joint_detect_estimate", f"""SELECT season_type, {R('(n_a + n_b) * ' + lnv('pv') + ' - n_a * ' + lnv('pa') + ' - n_b * ' + lnv('pb'), 'glrt_stat')}, {R('ma', 'theta_hat')}, {R('mb', 'theta_0')},
{R('ma - 1.959963984540054 * sqrt(pa) / sqrt(n_a)', 'ci_low')}, {R('ma + 1.959963984540054 * sqrt(pa) / sqrt(n_a)', 'ci_high')}, {R('(ma - mb) / (sqrt(pb) + 1e-15)', 'effect_size')} FROM m""", BOTH)
def _(t):
    out = stats.joint_detect_estimate(stats.two_sample(points(t), ["season_type"], "value"))
    cols = ["glrt_stat", "theta_hat", "theta_0", "ci_low", "ci_high", "effect_size"]
    return rounded(out.select("season_type", *cols), cols)


@register("sample_metric", "SELECT gameId, orderNumber, possession_points::DOUBLE AS value FROM en JOIN (SELECT gameId, possession_id, min(orderNumber) AS orderNumber FROM en WHERE possession_id IS NOT NULL GROUP BY ALL) f USING (gameId, orderNumber) WHERE season IN (2020, 2022) AND season_type = 'rg' AND prev_action_type = 'timeout'")
def _(t):
    spec = SampleSpec(seasons=(2020, 2022), season_type="rg", prev_event="timeout")
    return samples.sample_metric(t.enriched, "possession_points", spec, "a").select(*key, "value")


@register("sample_metric_preset", f"SELECT sample, count(*) AS n, {R('avg(x)', 'mean')} FROM (SELECT 'a' AS sample, (shotResult = 'Made')::INT AS x FROM plays WHERE isFieldGoal = 1 AND is_clutch UNION ALL SELECT 'b', (shotResult = 'Made')::INT FROM plays WHERE isFieldGoal = 1 AND NOT is_clutch) q GROUP BY sample")
def _(t):
    rows = samples.preset_samples(t.plays, "clutch vs other shooting")
    return rows.groupBy("sample").agg(F.count("*").alias("n"), r6(F.avg("value"), "mean"))


@register("subsample_n", "SELECT gameId, orderNumber FROM raw ORDER BY md5('7:' || orderNumber::VARCHAR), orderNumber LIMIT 1000")
def _(t):
    return stats.subsample_n(t.spine.select(*key), 1000, "orderNumber")


# --- outcome model -----------------------------------------------------------------

SNAP = ["score_margin", "period", "seconds_remaining", "streak"]


@register("wp_snapshots", f"""SELECT p.gameId, p.possession_id, {', '.join('p.' + c for c in SNAP)}, p.is_clutch, p.possession = pr.teamA AS poss_is_home, f.home_won, {R('coalesce(h.wpct, 0.5)', 'home_wpct')}, {R('coalesce(a.wpct, 0.5)', 'away_wpct')}, {R('coalesce(h.wpct - a.wpct, 0)', 'wpct_diff')}
FROM possn p LEFT JOIN home ON home.gameId = p.gameId LEFT JOIN pairs pr ON pr.gameId = p.gameId AND pr.teamA = home_teamId LEFT JOIN fin f ON f.gameId = p.gameId
LEFT JOIN rec h ON h.season = p.season AND h.teamId = pr.teamA LEFT JOIN rec a ON a.season = p.season AND a.teamId = pr.teamB""")
def _(t):
    rows = winprob.snapshots(t.enriched, t.spine)
    return rows.select("gameId", "possession_id", *SNAP, "is_clutch", "poss_is_home", "home_won", r6("home_wpct"), r6("away_wpct"), r6("wpct_diff"))


@lru_cache(maxsize=8)
def _model(t):
    """Snapshots are read three times (fit, score, look up), so they are staged."""
    snaps = stage(winprob.snapshots(t.enriched, t.spine), "snapshots")
    train_rows, test_rows = winprob.holdout_split(snaps)
    model = winprob.train(train_rows)
    return snaps, train_rows, test_rows, model


def _scored(t):
    snaps, _, _, model = _model(t)
    return winprob.predict(model, winprob.as_features(snaps).dropna(subset=winprob.FEATURES))


@register("group_holdout_split", """SELECT CASE WHEN ('0x' || substr(md5('7:' || p.gameId::VARCHAR), 1, 6))::BIGINT % 100 < 80 THEN 'train' ELSE 'test' END AS part, count(*) AS n, count(DISTINCT p.gameId) AS games
FROM possn p JOIN home ON home.gameId = p.gameId JOIN fin f ON f.gameId = p.gameId
WHERE p.possession IS NOT NULL AND home_teamId IS NOT NULL AND f.home_won IS NOT NULL AND score_margin IS NOT NULL AND p.period IS NOT NULL AND seconds_remaining IS NOT NULL AND is_clutch IS NOT NULL AND streak IS NOT NULL AND p.IsPlayoff IS NOT NULL
GROUP BY 1""")
def _(t):
    _, train_rows, test_rows, _ = _model(t)
    both = train_rows.withColumn("part", F.lit("train")).unionByName(test_rows.withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(F.count("*").alias("n"), F.countDistinct("gameId").alias("games"))


# snapshots with all features as numbers, and the example model's prediction
SNAPS = {
    "snp": """SELECT p.gameId, p.possession_id, p.score_margin::DOUBLE AS score_margin, (p.possession = pr.teamA)::INT::DOUBLE AS poss_is_home, p.streak::DOUBLE AS streak, f.home_won::INT AS y,
coalesce(h.wpct, 0.5) AS home_wpct, coalesce(a.wpct, 0.5) AS away_wpct,
CASE WHEN ('0x' || substr(md5('7:' || p.gameId::VARCHAR), 1, 6))::BIGINT % 100 < 80 THEN 'train' ELSE 'test' END AS part
FROM possn p JOIN home ON home.gameId = p.gameId JOIN pairs pr ON pr.gameId = p.gameId AND pr.teamA = home_teamId JOIN fin f ON f.gameId = p.gameId
LEFT JOIN rec h ON h.season = p.season AND h.teamId = pr.teamA LEFT JOIN rec a ON a.season = p.season AND a.teamId = pr.teamB
WHERE p.possession IS NOT NULL AND f.home_won IS NOT NULL AND score_margin IS NOT NULL AND streak IS NOT NULL""",
    "wpf": "SELECT *, 1 / (1 + exp(-(0.05 + 0.12 * score_margin + 0.1 * poss_is_home + 0.02 * streak + 1.5 * home_wpct - 1.5 * away_wpct))) AS p FROM snp",
    "wpr": "SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM wpf WHERE part = 'test'",
    "wpa": """SELECT e.gameId, e.orderNumber, e.time_bucket, CASE WHEN is_home_calling THEN a.p ELSE 1 - a.p END AS pre, CASE WHEN is_home_calling THEN b.p ELSE 1 - b.p END AS post
FROM evw e LEFT JOIN wpf a ON a.gameId = e.gameId AND a.possession_id = e.possession_id - 6 LEFT JOIN wpf b ON b.gameId = e.gameId AND b.possession_id = e.possession_id + 6""",
    "wps": "SELECT time_bucket, count(*) AS n, avg(post - pre) AS mean, stddev_samp(post - pre) AS std, avg(post - pre) / (stddev_samp(post - pre) / sqrt(count(*))) AS t, avg(pre) AS wp_pre_mean, avg(post) AS wp_post_mean FROM wpa WHERE post - pre IS NOT NULL GROUP BY time_bucket",
    "wpt": f"SELECT *, {p_t('t', '(n - 1)')} AS p FROM wps",
}


def _fixed(rows):
    return winprob.EXAMPLE.predict(rows)


@register("wp_train_fixed", f"SELECT y::DOUBLE AS label, count(*) AS n, {R('avg(p)', 'mean_p')} FROM wpf WHERE part = 'train' GROUP BY y", SNAPS)
def _(t):
    train_rows = _model(t)[1]
    return _fixed(train_rows).groupBy("label").agg(F.count("*").alias("n"), r6(F.avg("p_home"), "mean_p"))


@register("wp_evaluate_fixed", f"SELECT count(*) AS n, {R('avg(-(y * ln(p) + (1 - y) * ln(1 - p)))', 'log_loss')}, {R('avg(pow(p - y, 2))', 'brier')}, {R('avg(y)', 'base_rate')}, {R('(sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y)))', 'auc')} FROM wpr", SNAPS)
def _(t):
    test_rows = _model(t)[2]
    return rounded(winprob.evaluate(_fixed(test_rows)), ["log_loss", "brier", "base_rate", "auc"])


def _fixed_added(t):
    scored = _fixed(winprob.as_features(_model(t)[0]).dropna(subset=winprob.FEATURES))
    return winprob.wp_added(t.events, scored)


@register("wp_added_fixed", f"SELECT gameId, orderNumber, {R('pre', 'wp_pre_calling')}, {R('post', 'wp_post_calling')}, {R('post - pre', 'wp_added_calling')} FROM wpa", SNAPS)
def _(t):
    columns = ["wp_pre_calling", "wp_post_calling", "wp_added_calling"]
    return rounded(_fixed_added(t).select(*key, *columns), columns)


@register("wp_added_summary_fixed", f"SELECT time_bucket, n, {R('mean', 'mean')}, {R('std', 'std')}, {R('t', 't_stat')}, {R('p', 'p_value')}, {sig('p')}, {R('wp_pre_mean', 'wp_pre_mean')}, {R('wp_post_mean', 'wp_post_mean')} FROM wpt", SNAPS)
def _(t):
    return rounded(winprob.wp_added_summary(_fixed_added(t), ["time_bucket"]), ["mean", "std", "t_stat", "p_value", "wp_pre_mean", "wp_post_mean"])


WP_FEATURES = [*winprob.FEATURES, "intercept"]


@register("wp_certificate", "SELECT unnest([" + ", ".join(f"'{f}'" for f in WP_FEATURES) + "]) AS feature, true AS ok")
def _(t):
    _, train_rows, _, model = _model(t)
    return winprob.certificate(model, train_rows).select("feature", "ok")


@register("wp_train")
def _(t):
    _, train_rows, _, model = _model(t)
    return winprob.predict(model, train_rows).groupBy("label").agg(F.count("*").alias("n"), F.avg("p_home").alias("mean_p"))


@register("wp_evaluate")
def _(t):
    _, _, test_rows, model = _model(t)
    return winprob.evaluate(winprob.predict(model, test_rows))


@register("wp_coefs")
def _(t):
    snaps, _, _, model = _model(t)
    return winprob.coefficients(model, snaps)


@register("wp_added")
def _(t):
    rows = winprob.wp_added(t.events, _scored(t))
    return rows.select(*key, "wp_pre_calling", "wp_post_calling", "wp_added_calling")


@register("wp_added_summary")
def _(t):
    rows = winprob.wp_added(t.events, _scored(t))
    return winprob.wp_added_summary(rows, ["time_bucket"])
