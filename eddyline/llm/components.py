"""Connected components of an edge table, by alternating star steps.

Every round hangs the neighbours of a node on the smallest of them (first the larger
neighbours, then the smaller ones). Rounds are written to the shared folder, and the
number of rounds grows with the logarithm of the longest chain. The centre of a star may
have any number of neighbours: they meet it in salted groups. Nothing but a row count reaches
the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddyline.llm.common import with_least
from eddyline.session import stage


def _swapped_too(edges: DataFrame) -> DataFrame:
    """Each edge both ways, from one evaluation of ``edges``."""
    ways = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    return edges.select(F.explode(ways).alias("e")).select("e.*")


def _unsettled(edges: DataFrame) -> int:
    """How many nodes hang on two others, or on one while others hang on them. Without any,
    the edges (u > v, distinct) are stars around the smallest node of their component."""
    ends = F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = edges.select(F.explode(ends).alias("e")).select("e.*").groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where("up > 1 OR (up = 1 AND down = 1)").count()


def _large(edges: DataFrame) -> DataFrame:
    least = with_least(_swapped_too(edges), ["u"], F.least("u", "v"), "m")
    return least.where("v > u AND v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = with_least(down, ["u"], F.col("v"), "m")
    hung = least.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return hung.where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns u, v) that is not the
    smallest of its component."""
    now = stage(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    while _unsettled(now):
        now = stage(_small(_large(now)), "stars")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
