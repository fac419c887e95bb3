"""Array expressions over the matches of a pattern, for the operators without Python.

``cut`` splits a text once into the pieces between matches and the matches themselves;
places follow from the lengths. All expressions are linear in the text: prefix sums go
block by block, so a text with very many matches stays cheap.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 512


def _running(lengths: Column) -> Column:
    """[0, a, a + b, …]: one entry more than ``lengths``."""
    return F.aggregate(lengths, F.array(F.lit(0).cast("bigint")), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))


def prefix_sums(lengths: Column) -> Column:
    """Sum of the entries before each entry. ``lengths`` must be a column of the frame,
    as it is named several times."""
    size = F.size(lengths)
    starts = F.sequence(F.lit(0), F.floor((size - 1) / BLOCK).cast("int"))
    local = F.transform(starts, lambda k: _running(F.slice(lengths, k * BLOCK + 1, F.lit(BLOCK))))
    both = F.struct(local.alias("local"), _running(F.transform(local, lambda b: F.element_at(b, -1))).alias("before"))
    spread = F.transform(
        F.array(both),
        lambda s: F.flatten(F.zip_with(s["local"], F.slice(s["before"], 1, F.size(s["local"])), lambda b, at: F.transform(F.slice(b, 1, F.size(b) - 1), lambda v: v + at))),
    )
    return F.when(size > 0, spread[0]).otherwise(F.array().cast("array<bigint>"))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def pieces(text: Column, pattern: str, found: Column) -> Column:
    """What lies between the matches; empty where nothing matches, which spares the split."""
    return F.when(F.size(found) > 0, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>"))


def gap_lengths(between: Column, found: Column) -> Column:
    """Length of the piece before each match plus the match, in code points."""
    return F.zip_with(F.slice(between, 1, F.size(found)), found, lambda p, m: (F.length(p) + F.length(m)).cast("bigint"))


def normal_below(z: Column) -> Column:
    """P(Z <= z) by a rational approximation (error below 1e-7)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = poly * F.exp(-x * x / 2) * 0.3989422804014327
    return F.when(z < 0, tail).otherwise(1 - tail)
