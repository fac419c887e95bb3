"""Exact links between members of large candidate lists, without a row per pair.

Sets whose similarity is just below the threshold can share many long lists with each other,
and the pairs to be ruled out then grow with the square of the lists. Here they are ruled
out in blocks of members that carry their whole sets: a block is a matrix product, and only
links that join two groups leave it.

Each member has a home, the largest of its lists. Members of one list are members of few
homes, as alike sets share most of their lists. Two homes that occur together in any list
are compared, once, however many lists they share; homes are dealt over parts of at most
``PART`` members on the average. A member so moves once per pair of homes, not once per list.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddyline.session import stage

PART = 512
COLUMNS = 8192


def split_by_size(lists: DataFrame, key: str, small: int) -> tuple[DataFrame, DataFrame]:
    """The rows of lists of at most ``small`` members, and the others with column ``size``."""
    sizes = lists.groupBy(key).agg(F.count("*").alias("size"))
    sized = stage(lists.join(sizes, key), "sized-lists")
    return sized.where(F.col("size") <= small).drop("size"), sized.where(F.col("size") > small)


def overlaps(rows: list[np.ndarray], columns: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sorted sets, by products of their incidence matrices
    over ``COLUMNS`` shingles at a time."""
    flat = np.concatenate([*rows, *columns, np.zeros(0, np.int64)])
    owner = np.repeat(np.arange(len(rows) + len(columns)), [len(s) for s in (*rows, *columns)])
    names, place = np.unique(flat, return_inverse=True)
    left = np.bincount(place[owner < len(rows)], minlength=len(names)) > 0
    right = np.bincount(place[owner >= len(rows)], minlength=len(names)) > 0
    number = np.cumsum(left & right) - 1
    met = (left & right)[place]
    owner, place = owner[met], number[place[met]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    out = np.zeros((len(rows), len(columns)), np.int64)
    for at in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):
        a, b = np.searchsorted(place, [at, at + COLUMNS])
        hit = np.zeros((len(rows) + len(columns), COLUMNS), np.float32)
        hit[owner[a:b], place[a:b] - at] = 1
        out += (hit[: len(rows)] @ hit[len(rows) :].T).astype(np.int64)
    return out


def block_links(m: dict, one: np.ndarray, two: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (places in ``m``) between members ``one`` and ``two`` of different groups: enough
    of them that the groups they join are joined."""
    group, n, shared = m["group"], m["n"], m["shared"]
    both = np.unique(np.concatenate([one, two]))
    names, count = np.unique(group[both], return_counts=True)
    if len(names) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    main = names[count.argmax()]
    found = []
    # a pair of different groups has a member outside the most frequent one
    for rows, columns in ((one[group[one] != main], two), (two[group[two] != main], one)):
        most = np.minimum(shared[rows][:, None], shared[columns])
        sizes = n[rows][:, None] + n[columns]
        able = (group[rows][:, None] != group[columns]) & (den * most >= num * (sizes - most))
        i, j = np.flatnonzero(able.any(1)), np.flatnonzero(able.any(0))
        if len(i):
            met = overlaps([m["set"][k] for k in rows[i]], [m["set"][k] for k in columns[j]])
            sub = np.ix_(i, j)
            a, b = np.nonzero(able[sub] & (den * met >= num * (sizes[sub] - met)))
            found.append((rows[i[a]], columns[j[b]]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (np.concatenate(z) for z in zip(*found))
    pairs = np.stack([np.minimum(group[a], group[b]), np.maximum(group[a], group[b])], axis=1)
    _, first = np.unique(pairs, axis=0, return_index=True)
    return a[first], b[first]


def home_blocks(large: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(id, home, part) of every member, and the blocks (number, home, part, side) to compare."""
    best = F.max(F.struct("size", key))[key]
    home = stage(large.groupBy("id").agg(best.alias("home")), "homes")
    parts = home.groupBy("home").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    dealt = home.join(parts, "home").select("id", "home", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    seen = large.select(key, "id").join(home, "id").select(key, "home").distinct()
    pairs = seen.withColumnRenamed("home", "h1").join(seen.withColumnRenamed("home", "h2"), key).where("h1 <= h2").select("h1", "h2").distinct()
    for side in ("1", "2"):
        count = parts.select(F.col("home").alias(f"h{side}"), F.col("parts").alias(f"n{side}"))
        pairs = pairs.join(count, f"h{side}").withColumn(f"p{side}", F.explode(F.sequence(F.lit(0), F.col(f"n{side}") - 1)))
    blocks = stage(pairs.where("h1 < h2 OR p1 <= p2").select("h1", "p1", "h2", "p2"), "home-blocks")
    number = F.xxhash64("h1", "p1", "h2", "p2").alias("number")
    sides = [blocks.select(number, F.col(f"h{k}").alias("home"), F.col(f"p{k}").alias("part"), F.lit(k).alias("side")) for k in (1, 2)]
    same = blocks.where("h1 = h2 AND p1 = p2").select(number)
    return dealt, sides[0].unionByName(sides[1].join(same, "number", "left_anti"))


def large_list_links(large: DataFrame, key: str, parts: DataFrame, buckets: int, num: int, den: int) -> DataFrame:
    """(a, b): links that join the groups of ``large`` (key, id, group, n, shared, size), whose
    sets are in ``parts`` (id, f, part)."""
    dealt, blocks = home_blocks(large, key)
    who = large.select("id", "group", "n", "shared").distinct()
    whole = parts.join(dealt.select("id"), "id", "left_semi").groupBy("id").agg(F.array_sort(F.collect_set(F.struct("f", "part"))).alias("pieces"))
    whole = whole.select("id", F.flatten(F.transform("pieces", lambda p: p["part"])).alias("set"))
    members = stage(dealt.join(who, "id").join(whole, "id"), "home-members")
    shipped = members.join(blocks, ["home", "part"]).withColumn("bucket", F.pmod("number", F.lit(buckets)).cast("int")).drop("home", "part")

    def run(key, rows):
        rows = rows.sort_by([("number", "ascending"), ("id", "ascending")]).combine_chunks()
        m = {c: rows.column(c).to_numpy() for c in ("number", "side", "id", "group", "n", "shared")}
        sets = rows.column("set").combine_chunks()
        flat, ends = sets.flatten().to_numpy(), sets.offsets.to_numpy()
        ends = ends - ends[0]
        m["set"] = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
        edges = [0, *(np.flatnonzero(np.diff(m["number"])) + 1).tolist(), len(ends) - 1]
        found = [(np.zeros(0, np.int64),) * 2]
        for x, y in zip(edges, edges[1:]):
            place = np.arange(x, y)
            first, second = place[m["side"][x:y] == 1], place[m["side"][x:y] == 2]
            found.append(block_links(m, first, second if len(second) else first, num, den))
        a, b = (m["id"][np.concatenate(z)] for z in zip(*found))
        return pa.table([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], ["a", "b"])

    return shipped.groupBy("bucket").applyInArrow(run, "a long, b long")
