"""p value, critical value and decision of the two-sample tests.

Statistics come from ``stats``; these columns are added to their result rows. A missing
statistic has no p value and does not reject.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eddyline.functions import distributions as D
from eddyline.functions import exact_tails
from eddyline.operators.aggregates import ROWS_PER_BLOCK, with_totals
from eddyline.plans import stats

REJECT, KEEP = "Reject H0", "Fail to Reject H0"
ALPHA = 0.05


def _decision(reject: Column) -> Column:
    return F.when(F.coalesce(reject, F.lit(False)), F.lit(REJECT)).otherwise(F.lit(KEEP))


def _by_p(out: DataFrame, alpha: float) -> DataFrame:
    return out.withColumn("decision", _decision(~F.isnan("p_value") & (F.col("p_value") < alpha)))


def _by_statistic(out: DataFrame, statistic: Column) -> DataFrame:
    return out.withColumn("decision", _decision(statistic > F.col("critical_value")))


def welch(m: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Decides by p; the critical value is that of the smaller sample's degrees of freedom."""
    out = stats.welch(m).withColumn("p_value", D.p_t(F.col("t_stat"), F.col("df")))
    less = F.least("n_a", "n_b") - 1
    critical = F.when(less >= 1, D.q_t(1 - alpha / 2, F.greatest(less, F.lit(1))))
    return _by_p(out.withColumn("critical_value", critical), alpha)


def prop_z(m: DataFrame, alpha: float = ALPHA) -> DataFrame:
    out = stats.prop_z(m).withColumn("p_value", D.p_norm_two_sided(F.col("z_stat")))
    out = out.withColumn("critical_value", F.lit(D.critical_norm(alpha)))
    return _by_statistic(out, F.abs("z_stat"))


def chi2(df: DataFrame, by: Sequence[str], category: str, sample: str = "sample", alpha: float = ALPHA) -> DataFrame:
    out = stats.chi2_independence(df, by, category, sample)
    out = out.withColumn("p_value", D.p_chi2(F.col("chi2"), F.col("dof")))
    out = out.withColumn("critical_value", D.q_chi2(1 - alpha, F.col("dof")))
    return _by_statistic(out, F.col("chi2"))


def chi2_expected(df: DataFrame, by: Sequence[str], category: str, sample: str = "sample") -> DataFrame:
    """Observed and expected counts per category; a row per (group, category)."""
    na, nb = F.count_if(F.col(sample) == "a"), F.count_if(F.col(sample) == "b")
    table = df.where(F.col(category).isNotNull()).groupBy(*by, category).agg(na.alias("observed_a"), nb.alias("observed_b"))
    table = table.where("observed_a + observed_b > 0")
    table = with_totals(with_totals(table, by, "observed_a", "_a"), by, "observed_b", "_b")
    share = (F.col("observed_a") + F.col("observed_b")) / (F.col("_a") + F.col("_b"))
    return table.select(*by, category, "observed_a", "observed_b", (F.col("_a") * share).alias("expected_a"), (F.col("_b") * share).alias("expected_b"))


def glrt(m: DataFrame, alpha: float = ALPHA, dof: int = 2) -> DataFrame:
    out = stats.glrt_two_sample(m, dof).withColumn("p_value", D.p_chi2(F.col("glrt_stat"), F.col("dof")))
    critical = F.when(F.col("dof") == 1, D.critical_chi2(alpha, 1)).otherwise(D.critical_chi2(alpha, dof))
    return _by_statistic(out.withColumn("critical_value", critical), F.col("glrt_stat"))


def neyman_pearson(m: DataFrame, alpha: float = ALPHA) -> DataFrame:
    out = stats.neyman_pearson(m, alpha).withColumn("p_value", D.p_norm_upper(F.col("z_stat")))
    return out.withColumnRenamed("threshold", "critical_value").withColumn("decision", _decision(F.col("reject"))).drop("reject")


def joint(m: DataFrame, alpha: float = ALPHA, dof: int = 2) -> DataFrame:
    out = stats.joint_detect_estimate(m, alpha, dof).withColumn("p_value", D.p_chi2(F.col("glrt_stat"), F.col("dof")))
    return out.withColumn("detected", F.coalesce(F.col("p_value") < alpha, F.lit(False)))


def mann_whitney(
    df: DataFrame, by: Sequence[str], value: str, sample: str = "sample", alpha: float = ALPHA, rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """U with its two-sided p: exact where one sample is small and nothing is tied, else by
    the normal form. Groups with one sample only have no p."""
    out = stats.mann_whitney(df, by, value, sample, rows_per_block, ties=True)
    exact = (F.least("n_a", "n_b") <= exact_tails.SMALL_SAMPLE) & (F.col("ties") == 0)
    # one kind of p is computed where it is asked for; the other one is given harmless input
    p_exact = exact_tails.p_rank(F.when(exact, F.col("n_a")).otherwise(0), F.when(exact, F.col("n_b")).otherwise(0), F.col("u_stat"))
    p_normal = F.least(F.lit(1.0), D.p_norm_two_sided(F.greatest(F.col("z_stat"), F.lit(0.0))))
    some = (F.col("n_a") > 0) & (F.col("n_b") > 0)
    out = out.withColumn("method", F.when(exact, F.lit("exact")).otherwise(F.lit("normal")))
    return _by_p(out.withColumn("p_value", F.when(some, F.when(exact, p_exact).otherwise(p_normal))), alpha).drop("ties")


def ks_two_sample(
    df: DataFrame, by: Sequence[str], value: str, sample: str = "sample", alpha: float = ALPHA, rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """D with its two-sided p: exact up to 10,000 rows a sample, else the large-sample form."""
    out = stats.ks_two_sample(df, by, value, sample, rows_per_block)
    return _by_p(out.withColumn("p_value", exact_tails.p_ks(F.col("n_a"), F.col("n_b"), F.col("d_stat"))), alpha)
