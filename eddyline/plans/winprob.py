"""Outcome model at possession starts, and the change of its prediction at events."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddyline.config import SPINE, Spine
from eddyline.plans import state, stats

FEATURES = [
    "score_margin", "period", "seconds_remaining", "is_clutch", "poss_is_home", "streak", "IsPlayoff",
    "home_wpct", "away_wpct", "wpct_diff",
]
LABEL = "home_won"


def snapshots(enriched: DataFrame, spine: DataFrame, s: Spine = SPINE) -> DataFrame:
    """One row per possession: features at its first row, and the final result."""
    first = (s.period, s.remaining, s.clock, "score_margin", "is_clutch", "streak", s.season, s.season_type, "IsPlayoff", s.possession)
    rows = state.possessions(enriched.where(F.col(s.possession) > 0), s, first)
    record = state.team_season_record(spine, s)
    home = record.select(s.season, F.col("teamId").alias("home_teamId"), F.col("wpct").alias("home_wpct"))
    away = record.select(s.season, F.col("teamId").alias("away_teamId"), F.col("wpct").alias("away_wpct"))
    rows = (
        rows.join(state.home_away(spine, s), s.entity, "left")
        .join(state.final_score(spine, s).select(s.entity, LABEL), s.entity, "left")
        .join(home, [s.season, "home_teamId"], "left")
        .join(away, [s.season, "away_teamId"], "left")
    )
    diff = F.coalesce(F.col("home_wpct") - F.col("away_wpct"), F.lit(0.0))
    return (
        rows.withColumn("wpct_diff", diff)
        .withColumn("home_wpct", F.coalesce("home_wpct", F.lit(0.5)))
        .withColumn("away_wpct", F.coalesce("away_wpct", F.lit(0.5)))
        .withColumn("poss_is_home", F.col(s.possession) == F.col("home_teamId"))
    )


def as_features(snaps: DataFrame) -> DataFrame:
    """Features and label as doubles; rows with a missing one keep nulls."""
    doubles = {c: F.col(c).cast("double") for c in FEATURES}
    return snaps.withColumns(doubles).withColumn("label", F.col(LABEL).cast("double"))


def holdout_split(snaps: DataFrame, share: float = 0.2, max_rows: int | None = None, seed: int = 7, s: Spine = SPINE):
    """Whole entities go to train or test by a digest of their id.

    ``max_rows`` bounds the training part (a random share of its rows); the test part
    is whole in any case.
    """
    rows = as_features(snaps).dropna(subset=[*FEATURES, "label"])
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(s.entity).cast("string")).cast("binary"))
    bucket = F.conv(F.substring(digest, 1, 6), 16, 10).cast("long") % 100
    cut = round((1 - share) * 100)
    train_rows, test_rows = rows.where(bucket < cut), rows.where(bucket >= cut)
    if max_rows is not None:
        keep = min(1.0, max_rows / max(train_rows.count(), 1))
        train_rows = train_rows.where(F.pmod(F.xxhash64(s.entity, "possession_id", F.lit(seed)), F.lit(1_000_000)) < keep * 1_000_000)
    return train_rows, test_rows


def train(train_rows: DataFrame, c: float = 1.0, max_iter: int = 2000) -> PipelineModel:
    """Standardised logistic regression with an L2 penalty of strength 1 / (C·n)."""
    n = max(train_rows.count(), 1)
    stages = [
        VectorAssembler(inputCols=FEATURES, outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
        LogisticRegression(regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=max_iter),
    ]
    return Pipeline(stages=stages).fit(train_rows)


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    out = model.transform(rows)
    return out.withColumn("p_home", vector_to_array("probability")[1]).drop("raw", "features", "rawPrediction", "probability", "prediction")


@dataclass(frozen=True)
class Fixed:
    """A model given by its intercept and its weights on the features as they are: stored
    coefficients are applied without a fit."""

    intercept: float
    weights: dict[str, float]

    def predict(self, rows: DataFrame) -> DataFrame:
        score = sum((F.lit(w) * F.col(f) for f, w in self.weights.items()), F.lit(self.intercept))
        return rows.withColumn("p_home", 1 / (1 + F.exp(-score)))


# Parameters of an example model: the margin and the strength of the sides.
EXAMPLE = Fixed(0.05, {"score_margin": 0.12, "poss_is_home": 0.1, "streak": 0.02, "home_wpct": 1.5, "away_wpct": -1.5})


def certificate(model: PipelineModel, train_rows: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """(feature, gradient, curvature, distance, ok): whether the fitted coefficients are the
    optimum of the penalised likelihood. One aggregation gives the gradient and the matrix of
    second derivatives at the coefficients; a Newton step bounds how far the optimum is."""
    fitted, names = model.stages[-1], [*FEATURES, "intercept"]
    rows = model.transform(train_rows).select(F.col("label").alias("y"), vector_to_array("probability")[1].alias("p"), vector_to_array("features").alias("x"))
    x = [F.col("x")[k] for k in range(len(FEATURES))] + [F.lit(1.0)]
    gradient = [F.avg((F.col("p") - F.col("y")) * v).alias(f"g{k}") for k, v in enumerate(x)]
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    second = [F.avg(F.col("p") * (1 - F.col("p")) * x[i] * x[j]).alias(f"h{i}_{j}") for i, j in pairs]
    found = rows.agg(*gradient, *second).first()
    penalty = fitted.getRegParam() * np.array([1.0] * len(FEATURES) + [0.0])
    g = np.array([found[f"g{k}"] for k in range(len(x))]) + penalty * np.append(fitted.coefficients.toArray(), fitted.intercept)
    h = np.diag(penalty)
    for i, j in pairs:
        h[i, j] += found[f"h{i}_{j}"]
        h[j, i] = h[i, j]
    step = np.linalg.lstsq(h, g, rcond=None)[0]
    out = [(n, float(a), float(h[k, k]), float(abs(d)), bool(abs(a) <= tolerance and abs(d) <= 100 * tolerance)) for k, (n, a, d) in enumerate(zip(names, g, step))]
    return train_rows.sparkSession.createDataFrame(out, "feature string, gradient double, curvature double, distance double, ok boolean")


def evaluate(scored: DataFrame) -> DataFrame:
    """Log-loss, Brier score, AUC and base rate in exact arithmetic over all rows."""
    y, p = F.col("label"), F.least(F.greatest(F.col("p_home"), F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = -(y * F.log(p) + (1 - y) * F.log(1 - p))
    base = scored.agg(
        F.count("*").alias("n"), F.avg(loss).alias("log_loss"), F.avg(F.pow(p - y, 2)).alias("brier"), F.avg(y).alias("base_rate")
    )
    ranks = scored.withColumn("sample", F.when(y == 1, F.lit("a")).otherwise(F.lit("b")))
    auc = stats.mann_whitney(ranks, [], "p_home").select((F.col("u_stat") / (F.col("n_a") * F.col("n_b"))).alias("auc"))
    both = base.unionByName(auc, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def coefficients(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Standardised coefficients, largest first."""
    weights = model.stages[-1].coefficients.toArray().tolist()
    rows = list(zip(FEATURES, weights, strict=True))
    out = df.sparkSession.createDataFrame(rows, "feature string, coefficient double")
    return out.orderBy(F.desc(F.abs("coefficient")), "feature")


def wp_added(events: DataFrame, scored: DataFrame, width: int = 6, s: Spine = SPINE) -> DataFrame:
    """Prediction W possessions before and after each event, seen from the caller.

    ``scored`` is predicted once; two key joins look it up. A missing snapshot
    gives null.
    """
    table = scored.select(s.entity, F.col("possession_id").alias("_at"), "p_home")
    rows = events.withColumn("_pre", F.col("possession_id") - width).withColumn("_post", F.col("possession_id") + width)
    for name in ("pre", "post"):
        look = table.withColumnsRenamed({"_at": f"_{name}", "p_home": f"wp_{name}_home"})
        rows = rows.join(look, [s.entity, f"_{name}"], "left")
        p = F.col(f"wp_{name}_home")
        rows = rows.withColumn(f"wp_{name}_calling", F.when(F.col("is_home_calling"), p).otherwise(1 - p))
    return rows.withColumn("wp_added_calling", F.col("wp_post_calling") - F.col("wp_pre_calling")).drop("_pre", "_post")


def wp_added_summary(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    out = stats.one_sample_p(stats.one_sample(rows, by, "wp_added_calling"))
    means = rows.where("wp_added_calling is not null").groupBy(*by).agg(
        F.avg("wp_pre_calling").alias("wp_pre_mean"), F.avg("wp_post_calling").alias("wp_post_mean")
    )
    return out.join(means, list(by))
