import math
import random

import pytest
from pyspark.sql import functions as F

from eddyline.operators.scan import Changes, scan
from eddyline.config import SPINE
from eddyline.streaming import ordered

SCHEMA = "gameId long, orderNumber long, at timestamp, teamId long, x double"


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(3)
    rows = [(g, 10 * g + 100 * i, 1_700_000_000 + 3600 * i + rng.randrange(3000), rng.choice([1, 1, 2, None]), rng.choice([rng.gauss(0.4, 1), None])) for g in range(5) for i in range(60)]
    df = spark.createDataFrame(rows, "gameId long, orderNumber long, s long, teamId long, x double")
    return df.select("gameId", "orderNumber", F.timestamp_seconds("s").alias("at"), "teamId", "x")


def test_segments_equal_the_batch_with_late_rows(spark, log):
    stream = ordered.as_arrivals(log, "at", "test", chunks=3, late=4, files=1)
    got = ordered.run_available(ordered.segment_ids(stream, ["gameId"], "orderNumber", "at", "teamId", "3 days"), "test")
    batch = scan(log, ["gameId"], ["orderNumber"], SPINE.order_block(), [Changes("segment", F.col("teamId"), F.lit(True))])
    want = batch.select("gameId", "orderNumber", "segment")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_sprt_equals_the_rows_one_by_one(spark, log):
    stream = ordered.as_arrivals(log, "at", "test", chunks=3, late=4, files=1)
    got = ordered.run_available(ordered.sprt(stream, ["gameId"], "orderNumber", "at", "x", "3 days", 0.0, 0.5, 1.0), "test").collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["gameId"], r["orderNumber"])):
        by.setdefault(r["gameId"], []).append(r)
    rows = {}
    for r in sorted(log.collect(), key=lambda r: (r["gameId"], r["orderNumber"])):
        rows.setdefault(r["gameId"], []).append(r["x"])
    for g, xs in rows.items():
        n, llr, at, decision = 0, 0.0, None, "continue"
        for x, r in zip(xs, by[g], strict=True):
            if x is not None:
                n, llr = n + 1, llr + 0.5 * (x - 0.25)
                if at is None and (llr >= math.log(0.9 / 0.05) or llr <= math.log(0.1 / 0.95)):
                    at, decision = n, "reject" if llr > 0 else "accept"
            assert (r["n"], r["decision_n"], r["decision"]) == (n, at, decision) and r["llr"] == pytest.approx(llr)


def test_rows_later_than_the_delay_are_left_out(spark, log):
    stream = ordered.as_arrivals(log, "at", "test", chunks=3, late=4, files=1)
    got = ordered.run_available(ordered.segment_ids(stream, ["gameId"], "orderNumber", "at", "teamId", "1 second"), "test")
    assert 0 < got.count() < log.count()


def test_many_small_keys_share_groups(spark, log):
    assert ordered.GROUPS < 2000
    many = log.withColumn("gameId", F.col("gameId") + 5 * (F.col("orderNumber") % 400))
    stream = ordered.as_arrivals(many, "at", "test", chunks=2, late=4, files=1)
    out = ordered.segment_ids(stream, ["gameId"], "orderNumber", "at", "teamId", "3 days")
    assert "_group" in out._jdf.queryExecution().analyzed().toString()
    batch = scan(many, ["gameId"], ["orderNumber"], SPINE.order_block(), [Changes("segment", F.col("teamId"), F.lit(True))])
    got = ordered.run_available(out, "test")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.select("gameId", "orderNumber", "segment").collect()))
