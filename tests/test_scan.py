import random
from dataclasses import replace

import pandas as pd
import pytest
from frames import same_rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from eddyline.config import SPINE, block_of
from eddyline.operators import scan as sc
from eddyline.plans import state


@pytest.fixture(scope="module")
def rows(spark):
    """Half of all rows belong to one key, spread over many blocks."""
    rng = random.Random(5)
    data = []
    for o in range(600):
        k = 1 if rng.random() < 0.5 else rng.randint(2, 6)
        data.append((k, o, rng.choice([None, 1, 2, 3]), rng.choice(["a", "b", None]), rng.choice([-2, -1, 0, 0, 1, 3])))
    return spark.createDataFrame(data, "k int, o long, v long, c string, net long")


def windows():
    w = Window.partitionBy("k").orderBy("o")
    return w, w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)


@pytest.mark.parametrize("span", [3, 50, 100000])
def test_steps_equal_plain_windows(rows, span):
    w, upto, before = windows()
    ahead = w.rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy("k")
    steps = [
        sc.Sum("sum", F.col("v")),
        sc.Max("max", F.col("v")),
        sc.Last("last", F.col("c")),
        sc.Last("last_before", F.col("c"), inclusive=False),
        sc.Last("next", F.col("c"), inclusive=False, reverse=True),
        sc.Lag("lag", F.col("c")),
        sc.Lag("lead", F.col("c"), reverse=True),
        sc.Total("total", F.col("v")),
        sc.Changes("seg", F.col("c"), F.col("c").isNotNull()),
    ]
    got = sc.scan(rows, ["k"], ["o"], block_of("o", span), steps)
    changed = F.col("c").isNotNull() & (F.row_number().over(w).eqNullSafe(1) | ~F.lag("c").over(w).eqNullSafe(F.col("c")))
    want = (
        rows.withColumn("sum", F.sum(F.coalesce("v", F.lit(0))).over(upto))
        .withColumn("max", F.max("v").over(upto))
        .withColumn("last", F.last("c", True).over(upto))
        .withColumn("last_before", F.last("c", True).over(before))
        .withColumn("next", F.first("c", True).over(ahead))
        .withColumn("lag", F.lag("c").over(w))
        .withColumn("lead", F.lead("c").over(w))
        .withColumn("total", F.sum("v").over(whole))
        .withColumn("_f", changed.cast("long"))
        .withColumn("seg", F.sum("_f").over(upto))
        .drop("_f")
    )
    assert same_rows(want, got)


def streaks(pdf):
    out = []
    for _, g in pdf.sort_values("o").groupby("k"):
        sign = total = 0
        for r in g.itertuples():
            s = (r.net > 0) - (r.net < 0)
            if s and sign and s != sign:
                total = 0
            sign = s or sign
            total += r.net
            out.append((r.k, r.o, total))
    return pd.DataFrame(out, columns=["k", "o", "streak"]).sort_values(["k", "o"]).reset_index(drop=True)


@pytest.mark.parametrize("span", [1, 2, 7, 64, 100000])
def test_streak_composes_over_blocks(rows, span):
    got = sc.scan(rows, ["k"], ["o"], block_of("o", span), [sc.Streak("streak", F.col("net"))])
    got = got.select("k", "o", "streak").toPandas().sort_values(["k", "o"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, streaks(rows.toPandas()), check_dtype=False)


@pytest.mark.parametrize("span", [2, 5, 40, 100000])
def test_segment_total_spans_blocks(spark, span):
    # a segment of 12 rows with gaps covers several blocks of 2 and 5
    data = [(1, o, o // 12 if o % 4 else None, 1) for o in range(60)] + [(2, 3, 0, 5), (2, 30, 1, 7)]
    df = spark.createDataFrame(data, "k int, o long, seg long, v long")
    got = sc.scan(df, ["k"], ["o"], block_of("o", span), [sc.SegmentTotal("t", "seg", F.col("v"), ["k"])])
    want = df.join(df.where("seg is not null").groupBy("k", "seg").agg(F.sum("v").alias("t")), ["k", "seg"], "left")
    assert same_rows(want, got)


def test_attach_adds_key_columns(rows, spark):
    names = spark.createDataFrame([(1, "one"), (2, "two")], "k int, name string")
    got = sc.scan(rows, ["k"], ["o"], block_of("o", 20), [], attach=names)
    assert same_rows(rows.join(names, "k", "left"), got)


@pytest.mark.parametrize("span", [6, 10, 100000])
def test_halo_equals_lag_and_lead(spark, span):
    df = spark.createDataFrame([(k, p, p * k) for k in (1, 2) for p in range(1, 45)], "k int, p long, v long")
    w = sc.halo_window(["k"], "p")
    plain = Window.partitionBy("k").orderBy("p")
    got = sc.drop_halo(
        sc.with_halo(df, ["k"], "p", 6, 6, span).withColumns({"a": F.lag("v", 6).over(w), "b": F.lead("v", 6).over(w)})
    )
    want = df.withColumn("a", F.lag("v", 6).over(plain)).withColumn("b", F.lead("v", 6).over(plain))
    assert same_rows(want, got)


def test_halo_wider_than_block_is_refused(spark):
    with pytest.raises(ValueError):
        sc.with_halo(spark.range(3).withColumn("k", F.lit(1)), ["k"], "id", 6, 6, 5)


@pytest.mark.parametrize("span", [37, 400])
def test_enriched_spine_does_not_depend_on_block_width(tables, span):
    small = replace(SPINE, block_span=span, clock_span=50)
    got = state.enrich(tables.spine, tables.labels, tables.sides, small)
    assert same_rows(tables.enriched, got)
