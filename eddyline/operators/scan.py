"""Ordered scans over entities of any size.

A plain window partitioned by entity puts a whole entity into one task. A scan
here works in three steps that never do:

1. ``local``: windows over (keys, block). A block is a bounded stretch of the
   order column, so one task sorts at most a block at a time.
2. ``carry``: one row per block, and a window over those rows yields the state
   in which each block starts. There are ``order range / block width`` of them.
3. ``finish``: the carried state is joined back on (keys, block) and combined.

The join in step 3 meets the layout of step 1, so only the block summaries move. Where they are
hashed (``session.spread``) the rows keep their order, and a later step on it sorts nothing again.
A null key is a key of its own. A join drops nulls, so keys that may be null are laid out by
(is null, value or a default). These columns stay on the rows together with the block number
(``keep_block``), and later scans and joins in the same layout use them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, NumericType

BLOCK = "_block"
UNBOUNDED = Window.unboundedPreceding


class Step:
    """One running quantity. Subclasses fill in the three phases."""

    reverse = False

    def layers(self, w: WindowSpec) -> list[dict[str, Column]]:
        """Columns of the local phase; a layer may use the ones before it. The same
        layer of all steps is computed together, in one window operator."""
        return []

    def totals(self, rank: Column) -> list[Column]:
        """Aggregates of a block; ``rank`` orders its rows in scan direction."""
        return []

    def carry(self, blocks: DataFrame, w: WindowSpec) -> DataFrame:
        return blocks

    def carried(self) -> list[str]:
        return []

    def finish(self, df: DataFrame) -> DataFrame:
        return df


def _latest(value: Column, rank: Column, reverse: bool, where: Column | None = None) -> Column:
    """The value at the end of a block in scan direction."""
    key = rank if where is None else F.when(where, rank)
    return F.min_by(value, key) if reverse else F.max_by(value, key)


def _earliest(value: Column, rank: Column, reverse: bool, where: Column | None = None) -> Column:
    return _latest(value, rank, not reverse, where)


@dataclass
class Sum(Step):
    """Running sum including the current row; nulls add nothing."""

    out: str
    expr: Column
    reverse: bool = False

    def layers(self, w):
        value = F.coalesce(self.expr, F.lit(0))
        return [{f"_{self.out}_l": F.sum(value).over(w.rowsBetween(UNBOUNDED, 0))}]

    def totals(self, rank):
        return [F.sum(F.coalesce(self.expr, F.lit(0))).alias(f"_{self.out}_t")]

    def carry(self, blocks, w):
        before = F.sum(f"_{self.out}_t").over(w.rowsBetween(UNBOUNDED, -1))
        return blocks.withColumn(f"_{self.out}_c", before)

    def carried(self):
        return [f"_{self.out}_c"]

    def finish(self, df):
        return df.withColumn(self.out, F.col(f"_{self.out}_l") + F.coalesce(f"_{self.out}_c", F.lit(0)))


@dataclass
class Max(Step):
    """Running maximum including the current row."""

    out: str
    expr: Column
    reverse: bool = False

    def layers(self, w):
        return [{f"_{self.out}_l": F.max(self.expr).over(w.rowsBetween(UNBOUNDED, 0))}]

    def totals(self, rank):
        return [F.max(self.expr).alias(f"_{self.out}_t")]

    def carry(self, blocks, w):
        return blocks.withColumn(f"_{self.out}_c", F.max(f"_{self.out}_t").over(w.rowsBetween(UNBOUNDED, -1)))

    def carried(self):
        return [f"_{self.out}_c"]

    def finish(self, df):
        return df.withColumn(self.out, F.greatest(f"_{self.out}_l", f"_{self.out}_c"))


@dataclass
class Last(Step):
    """Most recent non-null value; with ``reverse`` the next one."""

    out: str
    expr: Column
    inclusive: bool = True
    reverse: bool = False

    def layers(self, w):
        frame = w.rowsBetween(UNBOUNDED, 0 if self.inclusive else -1)
        return [{f"_{self.out}_l": F.last(self.expr, ignorenulls=True).over(frame)}]

    def totals(self, rank):
        value = _latest(self.expr, rank, self.reverse, self.expr.isNotNull())
        return [value.alias(f"_{self.out}_t")]

    def carry(self, blocks, w):
        before = F.last(f"_{self.out}_t", ignorenulls=True).over(w.rowsBetween(UNBOUNDED, -1))
        return blocks.withColumn(f"_{self.out}_c", before)

    def carried(self):
        return [f"_{self.out}_c"]

    def finish(self, df):
        return df.withColumn(self.out, F.coalesce(f"_{self.out}_l", f"_{self.out}_c"))


@dataclass
class Lag(Step):
    """Value of the previous row, null or not; with ``reverse`` the next row's."""

    out: str
    expr: Column
    reverse: bool = False

    def layers(self, w):
        o = self.out
        return [{f"_{o}_l": F.lag(self.expr).over(w), f"_{o}_in": F.lag(F.lit(True)).over(w)}]

    def totals(self, rank):
        return [_latest(self.expr, rank, self.reverse).alias(f"_{self.out}_t")]

    def carry(self, blocks, w):
        return blocks.withColumn(f"_{self.out}_c", F.lag(f"_{self.out}_t").over(w))

    def carried(self):
        return [f"_{self.out}_c"]

    def finish(self, df):
        o = self.out
        value = F.when(F.col(f"_{o}_in"), F.col(f"_{o}_l")).otherwise(F.col(f"_{o}_c"))
        return df.withColumn(o, value)


@dataclass
class Changes(Step):
    """Number of changes of ``value`` so far: the id of a gaps-and-islands segment.

    A row counts when ``counted`` holds and its value differs from the previous
    row's; the first row of a key counts too.
    """

    out: str
    value: Column
    counted: Column

    def layers(self, w):
        o = self.out
        inside = F.lag(F.lit(True)).over(w).isNotNull()
        flag = inside & F.coalesce(self.counted, F.lit(False)) & ~F.lag(self.value).over(w).eqNullSafe(self.value)
        running = F.sum(f"_{o}_f").over(w.rowsBetween(UNBOUNDED, 0))
        return [{f"_{o}_f": flag.cast("long")}, {f"_{o}_l": running}]

    def totals(self, rank):
        o = self.out
        boxed = F.struct(self.value.alias("v"), F.coalesce(self.counted, F.lit(False)).alias("ok"))
        return [
            F.sum(f"_{o}_f").alias(f"_{o}_n"),
            _earliest(boxed, rank, False).alias(f"_{o}_first"),
            _latest(boxed, rank, False).alias(f"_{o}_last"),
        ]

    def carry(self, blocks, w):
        o = self.out
        previous = F.lag(f"_{o}_last").over(w)
        first = F.col(f"_{o}_first")
        opens = first["ok"] & (previous.isNull() | ~previous["v"].eqNullSafe(first["v"]))
        blocks = blocks.withColumn(f"_{o}_open", opens.cast("long"))
        before = F.sum(F.col(f"_{o}_n") + F.col(f"_{o}_open")).over(w.rowsBetween(UNBOUNDED, -1))
        return blocks.withColumn(f"_{o}_c", F.coalesce(before, F.lit(0)) + F.col(f"_{o}_open"))

    def carried(self):
        return [f"_{self.out}_c"]

    def finish(self, df):
        return df.withColumn(self.out, F.col(f"_{self.out}_l") + F.col(f"_{self.out}_c"))


@dataclass
class Streak(Step):
    """Running sum of ``net`` that restarts when the sign of scoring flips.

    The state of a block is one (sign, sum) pair, so blocks compose: a block that
    contains a flip ends in its own last stretch, one without a flip extends the
    stretch it inherits if the signs agree.
    """

    out: str
    net: Column

    def layers(self, w):
        o = self.out
        upto, before = w.rowsBetween(UNBOUNDED, 0), w.rowsBetween(UNBOUNDED, -1)
        sign = F.when(self.net != 0, F.signum(self.net))
        first = {
            f"_{o}_s": sign,
            f"_{o}_sum": F.sum(self.net).over(upto),
            f"_{o}_seen": F.last(sign, ignorenulls=True).over(upto),
            f"_{o}_flip": sign != F.last(sign, ignorenulls=True).over(before),
        }
        start = F.when(F.col(f"_{o}_flip"), F.col(f"_{o}_sum") - self.net)
        base = {f"_{o}_base": F.last(start, ignorenulls=True).over(upto)}
        return [first, base, {f"_{o}_l": F.col(f"_{o}_sum") - F.coalesce(f"_{o}_base", F.lit(0))}]

    def totals(self, rank):
        o = self.out
        sign = F.col(f"_{o}_s")
        return [
            _earliest(sign, rank, False, sign.isNotNull()).alias(f"_{o}_first"),
            _latest(sign, rank, False, sign.isNotNull()).alias(f"_{o}_lastsign"),
            F.max(F.coalesce(F.col(f"_{o}_flip"), F.lit(False))).alias(f"_{o}_flips"),
            _latest(F.col(f"_{o}_l"), rank, False).alias(f"_{o}_tail"),
        ]

    def carry(self, blocks, w):
        o = self.out
        upto, before = w.rowsBetween(UNBOUNDED, 0), w.rowsBetween(UNBOUNDED, -1)
        scored = F.col(f"_{o}_first").isNotNull()
        blocks = blocks.withColumn(f"_{o}_cs", F.last(f"_{o}_lastsign", ignorenulls=True).over(before))
        tail = F.when(scored, F.col(f"_{o}_tail")).otherwise(F.lit(0))
        blocks = blocks.withColumn(f"_{o}_run", F.sum(tail).over(upto))
        restart = scored & (
            F.col(f"_{o}_flips") | F.col(f"_{o}_cs").isNull() | (F.col(f"_{o}_cs") != F.col(f"_{o}_first"))
        )
        start = F.when(restart, F.col(f"_{o}_run") - tail)
        blocks = blocks.withColumn(f"_{o}_start", F.last(start, ignorenulls=True).over(upto))
        after = F.col(f"_{o}_run") - F.coalesce(f"_{o}_start", F.lit(0))
        return blocks.withColumn(f"_{o}_after", after).withColumn(f"_{o}_c", F.lag(f"_{o}_after").over(w))

    def carried(self):
        return [f"_{self.out}_cs", f"_{self.out}_c"]

    def finish(self, df):
        o = self.out
        carry, local = F.coalesce(f"_{o}_c", F.lit(0)), F.col(f"_{o}_l")
        extends = F.col(f"_{o}_seen") == F.col(f"_{o}_cs")
        value = (
            F.when(F.col(f"_{o}_seen").isNull(), carry)
            .when(F.col(f"_{o}_base").isNotNull(), local)
            .when(extends, carry + local)
            .otherwise(local)
        )
        return df.withColumn(o, value.cast("long"))


@dataclass
class Total(Step):
    """An aggregate over all rows of the key, attached to each row."""

    out: str
    expr: Column
    how: str = "sum"

    def totals(self, rank):
        return [getattr(F, self.how)(self.expr).alias(f"_{self.out}_t")]

    def carry(self, blocks, w):
        whole = w.rowsBetween(UNBOUNDED, Window.unboundedFollowing)
        return blocks.withColumn(self.out, getattr(F, self.how)(f"_{self.out}_t").over(whole))

    def carried(self):
        return [self.out]


@dataclass
class SegmentTotal(Step):
    """Sum of ``value`` over all rows of the row's segment, null outside segments.

    ``segment`` does not decrease along the order, so only the first and the last
    segment of a block can reach into another block; their parts are added up on
    the block summaries.
    """

    out: str
    segment: str
    value: Column

    keys: Sequence[str]

    def layers(self, w):
        # after the layers of all other steps: its rows are sorted by segment
        own = Window.partitionBy(*self.keys, BLOCK, self.segment)
        part = F.when(F.col(self.segment).isNotNull(), F.sum(self.value).over(own))
        return [{}, {}, {}, {f"_{self.out}_l": part}]

    def totals(self, rank):
        o, seg = self.out, F.col(self.segment)
        pair = F.struct(seg.alias("seg"), F.col(f"_{o}_l").alias("part"))
        return [
            _earliest(pair, rank, False, seg.isNotNull()).alias(f"_{o}_first"),
            _latest(pair, rank, False, seg.isNotNull()).alias(f"_{o}_last"),
        ]

    def carry(self, blocks, w):
        # two edge rows per block, summed by segment and folded back; every window
        # is partitioned by the key and more, so the summaries do not move again
        o, keys = self.out, list(self.keys)
        first, last = F.col(f"_{o}_first"), F.col(f"_{o}_last")
        tail = F.when(~last["seg"].eqNullSafe(first["seg"]), last["part"])
        edges = F.array(
            F.struct(F.lit("first").alias("end"), first["seg"].alias("seg"), first["part"].alias("part")),
            F.struct(F.lit("last").alias("end"), last["seg"].alias("seg"), tail.alias("part")),
        )
        rows = blocks.withColumn("_e", F.explode(edges))
        rows = rows.withColumn("_eseg", F.col("_e")["seg"]).withColumn("_epart", F.col("_e")["part"])
        rows = rows.withColumn("_esum", F.sum("_epart").over(Window.partitionBy(*keys, "_eseg")))
        own = Window.partitionBy(*keys, BLOCK)
        for end in ("first", "last"):
            total = F.max(F.when(F.col("_e")["end"] == end, F.col("_esum"))).over(own)
            rows = rows.withColumn(f"_{o}_{end}_sum", total).withColumn(f"_{o}_{end}_seg", F.col(f"_{o}_{end}")["seg"])
        return rows.where(F.col("_e")["end"] == "first").drop("_e", "_eseg", "_epart", "_esum")

    def carried(self):
        return [f"_{self.out}_{end}_{part}" for end in ("first", "last") for part in ("seg", "sum")]

    def finish(self, df):
        o, seg = self.out, F.col(self.segment)
        value = (
            F.when(seg == F.col(f"_{o}_first_seg"), F.col(f"_{o}_first_sum"))
            .when(seg == F.col(f"_{o}_last_seg"), F.col(f"_{o}_last_sum"))
            .otherwise(F.col(f"_{o}_l"))
        )
        return df.withColumn(o, value)


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column | None,
    steps: Sequence[Step],
    attach: DataFrame | None = None,
    keep_block: bool = False,
) -> DataFrame:
    """Add the running quantities of ``steps`` to every row of ``df``.

    ``order`` is ascending and unique inside a key; ``block`` must not decrease
    along it. Reverse steps read the rows from the far end. ``attach`` holds at most
    one row per key; its columns ride on the block summaries, so joining it costs
    no shuffle of the rows and a hot key stays split. ``keep_block`` leaves the
    layout on the rows (``layout_of``); a later scan with ``block`` None then works in
    the layout of this one, without another shuffle.
    """
    keys, order = list(keys), list(order)
    wanted = [c for c in df.columns if not _is_layout(c)] + [s.out for s in steps]
    if attach is not None:
        wanted += [c for c in attach.columns if c not in keys and c not in wanted]
    loose = _loose(df, keys) if block is not None else [k for k in keys if f"_k_{k}" in df.columns]
    if block is not None and loose:
        df = df.withColumns(_surrogates(df, loose))
    if loose:
        attach = attach.withColumns(_surrogates(attach, loose)).drop(*loose) if attach is not None else None
        keys = _split(keys, loose)
        steps = [replace(s, keys=keys) if hasattr(s, "keys") else s for s in steps]
    # a plain column keeps the aggregation buffers flat, a struct would force sorting
    rank = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    ahead = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    back = Window.partitionBy(*keys, BLOCK).orderBy(*[F.col(c).desc() for c in order])
    local = df if block is None else df.withColumn(BLOCK, block)
    per_step = [s.layers(back if s.reverse else ahead) for s in steps]
    for depth in range(max((len(p) for p in per_step), default=0)):
        local = local.withColumns({n: c for p in per_step if depth < len(p) for n, c in p[depth].items()})

    aggregates = [a for s in steps for a in s.totals(rank)]
    grouped = local.groupBy(*keys, BLOCK)
    blocks = grouped.agg(*aggregates) if aggregates else grouped.count()
    blocks_ahead = Window.partitionBy(*keys).orderBy(BLOCK)
    blocks_back = Window.partitionBy(*keys).orderBy(F.col(BLOCK).desc())
    blocks = reduce(lambda d, s: s.carry(d, blocks_back if s.reverse else blocks_ahead), steps, blocks)
    carried = [c for s in steps for c in s.carried()]
    if attach is not None:
        carried = carried + [c for c in attach.columns if c not in keys]
        blocks = blocks.join(attach, keys, "left") if keys else blocks.join(attach)
    if keep_block:
        wanted += [BLOCK, *(k for k in keys if _is_layout(k))]

    joined = local.join(blocks.select(*keys, BLOCK, *carried), [*keys, BLOCK], "inner")
    return reduce(lambda d, s: s.finish(d), steps, joined).select(*wanted)


def _filler(kind: DataType) -> Column:
    if isinstance(kind, NumericType):
        return F.lit(0).cast(kind)
    return F.lit(False) if isinstance(kind, BooleanType) else F.lit("").cast("string")


def _is_layout(column: str) -> bool:
    return column == BLOCK or column.startswith(("_k_", "_z_"))


def _loose(df: DataFrame, keys: Sequence[str]) -> list[str]:
    """The keys that may be null."""
    return [f.name for f in df.schema.fields if f.name in keys and f.nullable]


def _split(keys: Sequence[str], loose: Sequence[str]) -> list[str]:
    return [c for k in keys for c in ([f"_z_{k}", f"_k_{k}"] if k in loose else [k])]


def _surrogates(df: DataFrame, loose: Sequence[str]) -> dict[str, Column]:
    """Columns without nulls that stand for each of the keys: (is null, value or a default)."""
    kinds, columns = {f.name: f.dataType for f in df.schema.fields}, {}
    for k in loose:
        plain = F.col(k) if isinstance(kinds[k], (NumericType, BooleanType)) else F.col(k).cast("string")
        columns[f"_k_{k}"] = F.coalesce(plain, _filler(kinds[k]))
        columns[f"_z_{k}"] = F.col(k).isNull()
    return columns


def layout_of(df: DataFrame, keys: Sequence[str]) -> list[str]:
    """The columns rows are laid out by after a scan with ``keep_block``."""
    return _split(keys, [k for k in keys if f"_k_{k}" in df.columns]) + [BLOCK]


def into_layout(other: DataFrame, df: DataFrame, keys: Sequence[str], block: Column) -> DataFrame:
    """``other`` with the layout columns of ``df`` in place of its keys, for a join in that
    layout."""
    loose = [k for k in keys if f"_k_{k}" in df.columns]
    return other.withColumns({**_surrogates(other, loose), BLOCK: block}).drop(*loose)


def drop_layout(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if _is_layout(c)])


def with_halo(df: DataFrame, keys: Sequence[str], position: str, before: int, after: int, span: int) -> DataFrame:
    """Copy rows near a block edge into the neighbouring block.

    ``position`` is a dense row number inside the key. Afterwards a window over
    (keys, ``_block``) sees ``before`` rows back and ``after`` rows on for every
    row with ``_own`` true; the copies are dropped with ``drop_halo``.
    """
    if max(before, after) > span:
        raise ValueError("a block must be at least as wide as the halo")
    home = F.floor(F.col(position) / span).cast("long")
    offset = F.col(position) - home * span
    nxt = F.when(offset >= span - before, home + 1)
    prv = F.when(offset < after, home - 1)
    blocks = F.array_compact(F.array(home, nxt, prv))
    return df.withColumn("_home", home).withColumn(BLOCK, F.explode(blocks)).withColumn(
        "_own", F.col(BLOCK) == F.col("_home")
    )


def halo_window(keys: Sequence[str], position: str) -> WindowSpec:
    return Window.partitionBy(*keys, BLOCK).orderBy(position)


def drop_halo(df: DataFrame) -> DataFrame:
    return df.where("_own").drop("_own", "_home", BLOCK)
