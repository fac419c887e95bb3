"""Joins on time that keep an equality key, so no plan needs a nested loop."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eddyline.config import SPINE, Spine, block_of
from eddyline.operators.asof import asof
from eddyline.operators.scan import Last, Max, Sum, scan
from eddyline.session import stage


def first_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row per key, as an aggregation with map-side combine.

    Unlike a ranking window this never sorts a whole key in one task.
    """
    columns = df.columns
    picked = F.min_by(F.struct(*columns), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(picked).select("_row.*")


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Like a join on ``keys``, but a null key meets a null key."""
    own = {k: f"_r_{k}" for k in keys}
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(r)) for k, r in own.items()])
    return left.join(right.withColumnsRenamed(own), same, how).drop(*own.values())


PAIRS_PER_KEY = 1_000_000


def hot_buckets(pts: DataFrame, pieces: DataFrame, cells: Sequence[str], pairs: int) -> DataFrame:
    """(cells, _salts): the cells whose points times intervals exceed ``pairs``, and over how
    many salts their points go. A cell of one interval and many points counts too."""
    n = pts.groupBy(*cells).agg(F.count("*").alias("_np"))
    m = pieces.groupBy(*cells).agg(F.count("*").alias("_ni"))
    load = F.col("_np").cast("double") * F.col("_ni")
    salts = F.least(F.ceil(load / pairs), F.col("_np")).cast("int")
    return n.join(m, list(cells)).where(load > pairs).select(*cells, salts.alias("_salts"))


def salted_sides(pts: DataFrame, pieces: DataFrame, cells: Sequence[str], pairs: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on (cells, _salt): the points of a hot cell are dealt over salts
    and its intervals are repeated for each of them. There are few hot cells, at most all
    pairs divided by ``pairs``, so marking the rows moves no more than they would anyway."""
    hot = hot_buckets(pts, pieces, cells, pairs)
    one = F.coalesce("_salts", F.lit(1))
    left = pts.join(hot, list(cells), "left").withColumn("_salt", F.pmod(F.xxhash64(*pts.columns), one).cast("int")).drop("_salts")
    right = pieces.join(hot, list(cells), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("_salts")
    return left, right


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    time: str,
    start: str,
    end: str,
    width: int = 60,
    pairs_per_key: int = PAIRS_PER_KEY,
) -> DataFrame:
    """Each point with every interval of its key that contains it: start <= t < end.

    Intervals are cut into clock buckets, which join on equality; a bucket holds
    only the intervals alive in it. Counts of both sides per bucket tell which buckets
    are hot; these are split over salts.
    """
    lo, hi = F.floor(F.col(start) / width), F.floor(F.col(end) / width)
    pieces = intervals.where(F.col(start) < F.col(end)).withColumn("_bucket", F.explode(F.sequence(lo, hi)))
    pts = points.withColumn("_bucket", F.floor(F.col(time) / width))
    left, right = salted_sides(pts, pieces, [*keys, "_bucket"], pairs_per_key)
    joined = left.join(right, [*keys, "_bucket", "_salt"])
    return joined.where((F.col(time) >= F.col(start)) & (F.col(time) < F.col(end))).drop("_bucket", "_salt")


def asof_backward_bounded(
    points: DataFrame, intervals: DataFrame, keys: Sequence[str], time: str, start: str, end: str, payload: Sequence[str], tie: str, span: int
) -> DataFrame:
    """Latest interval that started at or before the point, null once it has ended.

    ``points`` may hold many rows per (keys, time); ``tie`` decides between
    intervals with one start (the largest wins).
    """
    latest = F.max_by(F.struct(end, *payload), tie).alias("_i")
    lookup = intervals.groupBy(*keys, F.col(start).alias(time)).agg(latest)
    queries = points.select(*keys, time).distinct()
    found = asof(lookup, queries, keys, time, ["_i"], span, directions=("backward",))
    hit = F.col("backward")["_i"]
    match = F.when(F.col(time) < hit[end], hit)
    found = found.select(*keys, time, *[match[c].alias(c) for c in payload])
    return points.join(found, [*keys, time], "left")


def count_within(
    rows: DataFrame, events: DataFrame, keys: Sequence[str], clock: str, radius: int, out: str
) -> DataFrame:
    """Number of ``events`` within ``radius`` of each row's clock, in the same key.

    Both sides shrink to distinct clock values first, so the pairs formed are
    bounded by the clock values in the window, not by the rows.
    """
    width = 2 * radius
    counts = events.groupBy(*keys, F.col(clock).alias("_c")).agg(F.count("*").alias("_n"))
    lo, hi = F.floor((F.col("_c") - radius) / width), F.floor((F.col("_c") + radius) / width)
    counts = counts.withColumn("_bucket", F.explode(F.sequence(lo, hi)))
    ticks = rows.select(*keys, clock).distinct().withColumn("_bucket", F.floor(F.col(clock) / width))
    near = ticks.join(counts, [*keys, "_bucket"]).where(F.abs(F.col(clock) - F.col("_c")) <= radius)
    sums = near.groupBy(*keys, clock).agg(F.sum("_n").alias(out))
    return rows.join(sums, [*keys, clock], "left").withColumn(out, F.coalesce(out, F.lit(0).cast("long")))


def nearby_rows(rows: DataFrame, chosen: DataFrame, keys: Sequence[str], clock: str, radius: int) -> DataFrame:
    """Rows within ``radius`` of any chosen row of the same key."""
    near = count_within(rows, chosen, keys, clock, radius, "_near")
    return near.where("_near > 0").drop("_near")


def cumulative_at(rows: DataFrame, keys: Sequence[str], clock: str, values: Sequence[str], span: int) -> DataFrame:
    """Running totals of ``values`` after each distinct clock: one row per clock."""
    sums = rows.groupBy(*keys, clock).agg(*[F.sum(v).alias(v) for v in values])
    steps = [Sum(f"cum_{v}", F.col(v)) for v in values]
    out = scan(sums, keys, [clock], block_of(clock, span), steps)
    return out.select(*keys, clock, *[s.out for s in steps])


def total_before(
    asked: DataFrame, rows: DataFrame, keys: Sequence[str], clock: str, value: str, at: str, span: int
) -> DataFrame:
    """``asked`` with column ``before``: the sum of ``value`` over the rows of its key whose
    clock is earlier than ``at``; 0 where there is none. One lookup per distinct question."""
    sums = rows.where(F.col(clock).isNotNull()).groupBy(*keys, F.col(clock).cast("double").alias("_t")).agg(F.coalesce(F.sum(value), F.lit(0)).alias("_v"))
    totals = scan(sums, keys, ["_t"], block_of("_t", span), [Sum("_c", F.col("_v"))])
    lookup = totals.select(*keys, "_t", "_c", "_v")
    questions = asked.select(*keys, F.col(at).cast("double").alias("_t")).distinct()
    hit = F.col("backward")
    # a lookup row at the very time is counted in its running total, but is not earlier
    found = asof(lookup, questions, keys, "_t", ["_c", "_v"], span, directions=("backward",))
    before = F.coalesce(hit["_c"] - F.when(hit["_t"] == F.col("_t"), hit["_v"]).otherwise(F.lit(0)), F.lit(0)).alias("before")
    answers = found.select(*keys, F.col("_t").alias("_at_time"), before)
    named = asked.withColumn("_at_time", F.col(at).cast("double"))
    return join_null_safe(named, answers, [*keys, "_at_time"], "left").drop("_at_time")


def forward_sum(
    queries: DataFrame, rows: DataFrame, keys: Sequence[str], clock: str, values: Sequence[str], horizon: int, span: int
) -> DataFrame:
    """Sum of ``values`` over (t, t + horizon] for each query row, by prefix sums.

    Two as-of lookups on the running totals replace the range join.
    """
    totals = cumulative_at(rows, keys, clock, values, span)
    cums = [f"cum_{v}" for v in values]
    ticks = queries.select(*keys, F.col(clock).alias("_t")).distinct()
    ends = F.explode(F.array(F.struct(F.col("_t").alias("at"), F.lit(0).alias("end")), F.struct((F.col("_t") + horizon).alias("at"), F.lit(1).alias("end"))))
    probes = ticks.withColumn("_p", ends).select(*keys, "_t", F.col("_p")["end"].alias("_end"), F.col("_p")["at"].alias(clock))
    found = asof(totals, probes, keys, clock, cums, span, directions=("backward",))
    def part(v, end):
        return F.sum(F.when(F.col("_end") == end, F.coalesce(F.col("backward")[f"cum_{v}"], F.lit(0))))

    diffs = found.groupBy(*keys, F.col("_t").alias(clock)).agg(*[(part(v, 1) - part(v, 0)).alias(f"next_{v}") for v in values])
    return queries.join(diffs, [*keys, clock], "left")


def ranges_of(lo: Column, hi: Column, levels: int) -> Column:
    """The whole numbers lo … hi as an array of (level, node): node n of a level stands for
    the 2^level numbers from n 2^level on. There are at most two nodes a level."""
    kind = "array<struct<level:int,node:bigint>>"
    start = F.struct(lo.cast("long").alias("l"), (hi + 1).cast("long").alias("r"), F.array().cast(kind).alias("nodes"))

    def one(take: Column, level: Column, node: Column) -> Column:
        return F.when(take, F.array(F.struct(level.alias("level"), node.alias("node")))).otherwise(F.array().cast(kind))

    def step(acc: Column, level: Column) -> Column:
        l, r = acc["l"], acc["r"]
        from_left = (l < r) & (F.pmod(l, F.lit(2)) == 1)
        after = F.when(from_left, l + 1).otherwise(l)
        from_right = (after < r) & (F.pmod(r, F.lit(2)) == 1)
        upto = F.when(from_right, r - 1).otherwise(r)
        nodes = F.concat(acc["nodes"], one(from_left, level, l), one(from_right, level, upto))
        return F.struct(F.floor(after / 2).alias("l"), F.floor(upto / 2).alias("r"), nodes.alias("nodes"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(levels)), start, step, lambda acc: acc["nodes"])


def first_after(
    triggers: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    s: Spine,
    payload: Sequence[str] = (),
    within: int = 60,
    prefix: str = "ev_",
) -> DataFrame:
    """For each trigger row, the first event of its key that comes after it by order and
    whose clock is at most ``within`` later; nulls where there is none.

    One scan finds the next event by order, which is the answer if its clock is in the
    window, and the earliest clock of all later events, which tells whether there is any
    answer. Only where the clock runs back is neither so: there the window is cut into
    ranges of seconds, at most two per power of two, each is asked for its next event by
    order, and the smallest order wins. No pair is formed.
    """
    names = [s.order, s.clock, *payload]
    boxed = F.struct(*names)
    left = events.where(F.col(s.clock).isNotNull()).select(*keys, s.order, F.col(s.clock).alias("_at"), boxed.alias("_ev"), F.lit(0).alias("_q"))
    asked = triggers.where(F.col(s.clock).isNotNull()).select(*keys, s.order, F.col(s.clock).alias("_tc")).distinct().withColumn("_q", F.lit(1))
    steps = [Last("_next", F.col("_ev"), inclusive=False, reverse=True), Max("_soon", -F.col("_at"), reverse=True)]
    seen = scan(left.unionByName(asked, allowMissingColumns=True), keys, [s.order, "_q"], s.order_block(), steps).where("_q = 1")
    hit = F.col("_next")[s.clock]
    state = F.when(F.col("_next").isNull() | (-F.col("_soon") > F.col("_tc") + within), "none").when((hit >= F.col("_tc")) & (hit <= F.col("_tc") + within), "next").otherwise("open")
    seen = stage(seen.select(*keys, s.order, "_tc", "_next", state.alias("_state")), "next-events")

    found = seen.where("_state = 'next'").select(*keys, s.order, "_next").unionByName(_in_ranges(left, seen.where("_state = 'open'"), keys, s, within, names))
    first = found.groupBy(*keys, s.order).agg(F.min_by("_next", F.col("_next")[s.order]).alias("_next"))
    first = first.select(*keys, s.order, *[F.col("_next")[c].alias(prefix + c) for c in names])
    return triggers.join(first, [*keys, s.order], "left")


def _in_ranges(left: DataFrame, open_: DataFrame, keys: Sequence[str], s: Spine, within: int, names: Sequence[str]) -> DataFrame:
    """(keys, order, _next) of triggers after which the clock runs back."""
    second = F.floor("_at").cast("long")
    low, high = F.floor("_tc").cast("long"), F.floor(F.col("_tc") + within).cast("long")
    whole = dict(left.dtypes)["_at"] not in ("double", "float") and not dict(left.dtypes)["_at"].startswith("decimal")
    levels = max(1, math.ceil(math.log2(within + 2)))
    of_interest = left.join(open_.select(*keys).distinct(), list(keys), "left_semi")
    nodes = F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda k: F.struct(k.alias("level"), F.floor(second / F.pow(F.lit(2), k)).cast("long").alias("node")))
    by_range = of_interest.withColumn("_n", F.explode(nodes)).select(*keys, s.order, "_ev", "_q", F.col("_n.level").alias("_level"), F.col("_n.node").alias("_node"))
    inner = ranges_of(low, high, levels) if whole else ranges_of(low + 1, high - 1, levels)
    asked = open_.select(*keys, s.order, F.lit(1).alias("_q"), F.explode(inner).alias("_n"))
    asked = asked.select(*keys, s.order, "_q", F.col("_n.level").alias("_level"), F.col("_n.node").alias("_node"))
    found = _next_in(by_range, asked, keys, s, ["_level", "_node"], names)
    if whole:
        return found
    # inside the first and the last second the clock itself decides
    seconds = F.explode(F.array_distinct(F.array(low, high)))
    outer = open_.select(*keys, s.order, "_tc", F.lit(1).alias("_q"), seconds.alias("_sec"))
    exact = of_interest.withColumn("_sec", second)
    outer = outer.join(exact.select(*keys, "_sec", "_at").distinct(), [*keys, "_sec"]).where((F.col("_at") >= F.col("_tc")) & (F.col("_at") <= F.col("_tc") + within))
    return found.unionByName(_next_in(exact, outer, keys, s, ["_sec", "_at"], names))


def _next_in(left: DataFrame, right: DataFrame, keys: Sequence[str], s: Spine, within: Sequence[str], names: Sequence[str]) -> DataFrame:
    """For each asked row, the next event by order that shares ``keys`` and ``within``."""
    rows = left.select(*keys, s.order, *within, "_ev", "_q").unionByName(right.select(*keys, s.order, *within, "_q"), allowMissingColumns=True)
    step = Last("_next", F.col("_ev"), inclusive=False, reverse=True)
    found = scan(rows, [*keys, *within], [s.order, "_q"], s.order_block(), [step]).where("_q = 1 AND _next IS NOT NULL")
    return found.select(*keys, s.order, "_next")


def nearest_outcome(
    events: DataFrame, outcomes: DataFrame, keys: Sequence[str], clock: str, payload: Sequence[str], order: str, within: int, span: int
) -> DataFrame:
    """Nearest outcome row within ``within``; the event stays, with nulls, if none.

    Equal distances go to the later clock, equal clocks to the larger order.
    """
    latest = F.max_by(F.struct(*payload), order).alias("_o")
    lookup = outcomes.groupBy(*keys, clock).agg(latest)
    queries = events.select(*keys, clock).distinct()
    found = asof(lookup, queries, keys, clock, ["_o"], span)
    back = F.col(clock) - F.col("backward")[clock]
    ahead = F.col("forward")[clock] - F.col(clock)
    hit = F.when(ahead <= F.coalesce(back, ahead), F.col("forward")).otherwise(F.col("backward"))
    match = F.when(F.abs(hit[clock] - F.col(clock)) <= within, hit)
    found = found.select(*keys, clock, *[match["_o"][c].alias(c) for c in payload])
    return events.join(found, [*keys, clock], "left")


def prefer_total_row(stats: DataFrame, keys: Sequence[str], team: str = "TEAM_ABBREVIATION", total: str = "TOT") -> DataFrame:
    """One row per key: the TOT row where there is one, else the smallest team."""
    return first_in_group(stats, keys, [(F.col(team) != total).alias("_not_total"), F.col(team).alias("_team")])


def first_per_clock(rows: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """First non-null ``value`` per key by order (wall-clock lookup of the oldest feed)."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(value, order).alias(value))


def split_intervals(
    intervals: DataFrame, start: str, end: str, breaks: Sequence[int], stats: Sequence[str]
) -> DataFrame:
    """Cut each interval at the break points strictly inside it.

    ``stats`` describe the whole interval and become null on the pieces of a cut.
    """
    marks = F.array(*[F.lit(b).cast("long") for b in breaks])
    inside = F.filter(marks, lambda b: (b > F.col(start)) & (b < F.col(end)))
    bounds = F.concat(F.array(F.col(start)), inside, F.array(F.col(end)))
    pieces = F.zip_with(F.slice(bounds, F.lit(1), F.size(bounds) - 1), F.slice(bounds, F.lit(2), F.size(bounds) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    out = intervals.withColumn("_cut", F.size(inside) > 0).withColumn("_piece", F.explode(pieces))
    blank = {c: F.when(~F.col("_cut"), F.col(c)) for c in stats}
    return (
        out.withColumn(start, F.col("_piece")["a"])
        .withColumn(end, F.col("_piece")["b"])
        .withColumns(blank)
        .drop("_cut", "_piece")
    )


BREAK_POINTS = [14400, 28800, 31800, 34800, 37800, 40800]


def build_stints(rotations: DataFrame, s: Spine = SPINE) -> DataFrame:
    """Rotations in tenths of a second → numbered stints in seconds."""
    cut = split_intervals(rotations, "IN_TIME_REAL", "OUT_TIME_REAL", BREAK_POINTS, ["PLAYER_PTS", "PT_DIFF"])
    rows = cut.select(
        s.entity,
        s.order,
        F.col("PERSON_ID").alias(s.person),
        F.col("TEAM_ID").alias(s.team),
        (F.col("IN_TIME_REAL") / 10).alias("in_game_seconds"),
        (F.col("OUT_TIME_REAL") / 10).alias("out_game_seconds"),
        ((F.col("OUT_TIME_REAL") - F.col("IN_TIME_REAL")) / 600).alias("stint_duration_minutes"),
        F.col("PLAYER_PTS").alias("player_pts"),
        F.col("PT_DIFF").alias("pt_diff"),
    )
    return number_by_clock(rows, [s.entity, s.person], "in_game_seconds", s.order, "stint_id", s)


def number_by_clock(rows: DataFrame, keys: Sequence[str], clock: str, order: str, out: str, s: Spine = SPINE) -> DataFrame:
    """1, 2, … per key by (clock, order), however many rows share a clock value.

    First the rows before each clock value (one row per value is scanned), then the place
    among the rows of one value, by blocks of the order.
    """
    kind = dict(rows.dtypes)[clock]
    sizes = rows.groupBy(*keys, clock).agg(F.count("*").alias("_n"))
    before = scan(sizes, keys, [clock], block_of(clock, s.clock_span), [Sum("_upto", F.col("_n"))])
    before = before.select(*keys, clock, (F.col("_upto") - F.col("_n")).alias("_before"))
    named = rows.withColumn("_at", F.col(clock))
    before = before.withColumnRenamed(clock, "_at")
    out_rows = scan(named, [*keys, "_at"], [order], s.order_block(order), [Sum("_place", F.lit(1).cast("long"))], attach=before)
    wanted = [c for c in rows.columns if c != out]
    return out_rows.select(*wanted, (F.col("_before") + F.col("_place")).cast("long").alias(out)).withColumn(clock, F.col(clock).cast(kind))


def mean_time_since_start(
    intervals: DataFrame, points: DataFrame, keys: Sequence[str], time: str, start: str, end: str, out: str, span: int
) -> DataFrame:
    """Mean of ``t - start`` over the intervals alive at each point: start <= t < end.

    A sweep line: +1 at each start, -1 at each end, running sums in between. No
    (point, interval) pair is formed. Points without a live interval are dropped.
    """
    live = intervals.where(F.col(start) < F.col(end))
    opened = live.select(*keys, F.col(start).alias(time), F.lit(1).cast("long").alias("_n"), F.col(start).alias("_s"))
    closed = live.select(*keys, F.col(end).alias(time), F.lit(-1).cast("long").alias("_n"), (-F.col(start)).alias("_s"))
    totals = cumulative_at(opened.unionByName(closed), keys, time, ["_n", "_s"], span)
    ticks = points.select(*keys, time).distinct()
    found = asof(totals, ticks, keys, time, ["cum__n", "cum__s"], span, directions=("backward",))
    n, total = F.col("backward")["cum__n"], F.col("backward")["cum__s"]
    mean = F.when(n > 0, F.col(time) - F.try_divide(total, n))
    found = found.select(*keys, time, mean.alias(out)).where(F.col(out).isNotNull())
    return points.join(found, [*keys, time])
