"""As-of lookups built from scans.

Lookup and query rows are interleaved on the time column; the latest lookup row
seen from each side answers the query. Cost is linear in both inputs: no pair of
rows is ever formed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eddyline.config import block_of
from eddyline.operators.scan import Last, scan

SIDE = "_asof_side"


def asof(
    lookup: DataFrame,
    queries: DataFrame,
    keys: Sequence[str],
    time: str,
    payload: Sequence[str],
    span: int,
    directions: Sequence[str] = ("backward", "forward"),
) -> DataFrame:
    """Attach ``backward`` / ``forward`` structs (time + payload) to each query.

    ``lookup`` holds one row per (keys, time) and so does ``queries`` per (keys,
    time, its other columns). A lookup row at the query time answers ``backward``.
    """
    keys = list(keys)
    extra = [c for c in queries.columns if c not in (*keys, time)]
    found = F.struct(F.col(time), *[F.col(c) for c in payload])
    left = lookup.select(*keys, time, found.alias("_found"), F.lit(0).alias(SIDE))
    right = queries.withColumn(SIDE, F.lit(1))
    rows = left.unionByName(right, allowMissingColumns=True)
    steps = []
    if "backward" in directions:
        steps.append(Last("backward", F.col("_found")))
    if "forward" in directions:
        steps.append(Last("forward", F.col("_found"), reverse=True))
    out = scan(rows, keys, [time, SIDE], block_of(time, span), steps)
    return out.where(F.col(SIDE) == 1).select(*keys, time, *extra, *[s.out for s in steps])


def nearest(time: str) -> Column:
    """The closer of the two structs; on equal distance the later one."""
    back = F.col(time) - F.col("backward")[time]
    ahead = F.col("forward")[time] - F.col(time)
    return F.when(back < ahead, F.col("backward")).otherwise(F.coalesce("forward", "backward"))


def nearest_shifted(
    rows: DataFrame, lookup: DataFrame, keys: Sequence[str], clock: str, shifts: Sequence[float], span: int, payload: Sequence[str]
) -> DataFrame:
    """For each distinct (keys, clock) of ``rows`` and each shift, the lookup row
    nearest to ``clock + shift``. Returns keys, clock, ``shift`` and ``match``.
    """
    keys = list(keys)
    offsets = F.explode(F.array(*[F.lit(x) for x in shifts]))
    queries = (
        rows.select(*keys, F.col(clock).alias("_from"))
        .distinct()
        .withColumn("shift", offsets)
        .withColumn(clock, F.col("_from") + F.col("shift"))
    )
    found = asof(lookup, queries, keys, clock, payload, span)
    match = nearest(clock)
    return found.withColumn("match", match).select(*keys, F.col("_from").alias(clock), "shift", "match")
