"""Hard negatives by exact integer scores from a residue number system.

Components are scaled to whole numbers. A block of anchors is multiplied with a block of
rows modulo several primes below 1024: with residues between -p/2 and p/2 a float32 product
over ``SPAN`` components is a whole number below 2^24, hence exact. The norms of the two
blocks bound the scores (Cauchy-Schwarz) and thus say how many primes are needed; mixed
radix digits (Chinese remaindering) give the exact signed score.

1. Rows are dealt over blocks by a hash of the whole row. Every block also gets all anchors,
   as a stream that is never held whole; a block of rows is bounded by ``BLOCK_BYTES``.
2. Each block selects its first positives per anchor, a window over the blocks the first
   ones of all.
3. The second pass gives the anchors their positives' scores. Each block selects the first
   different-label rows within each positive's window of scores; a window over the blocks
   selects among those.

Anchors are a stated query set, so every anchor meets every row once a pass. No anchor and
no row passes through the driver.

Defined cases: rows with a null id or label, a null vector, or a null or non-finite
component take no part; nor do rows whose scaled vector has a norm of 2^28 or more, as their
scores may not fit a long. A vector that is shorter than another has zeros in its place; an
empty one scores 0. Rows that are equal in id, label and scaled vector count once; rows that
share only the id are rows of their own. Without a positive or without a row in the window
an anchor has no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eddyline.llm.common import bound_batches, table
from eddyline.session import stage

# The largest primes below 1024.
PRIMES = (1021, 1019, 1013, 1009, 997, 991, 983)
SPAN = 64
ROWS, ANCHORS = 4096, 128
BLOCK_BYTES = 32 << 20
LIMIT = 2.0**28
POSITIVES = "array<struct<id:long,score:long>>"


def primes_for(bound: int) -> tuple[int, ...]:
    """Primes whose product exceeds twice ``bound``, so that signed scores are unique."""
    product, n = 1, 0
    while product <= 2 * bound + 1:
        product *= PRIMES[n]
        n += 1
    return PRIMES[:n]


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """``x`` modulo p in float32, between -p/2 and p/2."""
    r = x % p
    return np.where(r > p // 2, r - p, r).astype(np.float32)


def residue_product(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """a @ b.T modulo p, exactly, for two matrices of residues."""
    total = np.zeros((len(a), len(b)), np.int32)
    for at in range(0, a.shape[1], SPAN):
        total += (a[:, at : at + SPAN] @ b[:, at : at + SPAN].T).astype(np.int32) % p
    return total % p


def remainder(parts: list[np.ndarray], primes: tuple[int, ...]) -> np.ndarray:
    """The signed numbers with these residues: mixed radix digits, one prime at a time."""
    value, product = parts[0].astype(np.int64), primes[0]
    for part, p in zip(parts[1:], primes[1:]):
        digit = (part - value % p) * pow(product, -1, p) % p
        value += digit * product
        product *= p
    return np.where(value > product // 2, value - product, value)


@dataclass
class Rows:
    """Distinct rows, in the order they were dealt in."""

    ids: np.ndarray
    labels: np.ndarray
    keys: np.ndarray
    x: np.ndarray

    def __post_init__(self):
        self.norm = float(np.sqrt((self.x.astype(np.float64) ** 2).sum(1).max(initial=0)))
        self._residues: dict[int, np.ndarray] = {}

    def residues(self, p: int) -> np.ndarray:
        if p not in self._residues:
            self._residues[p] = residues(self.x, p)
        return self._residues[p]

    def part(self, at: slice) -> Rows:
        return Rows(self.ids[at], self.labels[at], self.keys[at], self.x[at])

    def width(self, d: int) -> Rows:
        """With at least ``d`` components: zeros where a vector has none."""
        return self if self.x.shape[1] >= d else Rows(self.ids, self.labels, self.keys, np.pad(self.x, ((0, 0), (0, d - self.x.shape[1]))))


def scores(a: Rows, b: Rows) -> np.ndarray:
    """Exact inner products of all rows of two blocks."""
    d = max(a.x.shape[1], b.x.shape[1])
    a, b = a.width(d), b.width(d)
    primes = primes_for(int(a.norm * b.norm * (1 + 1e-9)) + 1)
    return remainder([residue_product(a.residues(p), b.residues(p), p) for p in primes], primes)


def first_of(score: np.ndarray, allowed: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, column) of the highest, second highest … allowed score of each row; of equal
    scores the leftmost column comes first."""
    least = np.iinfo(np.int64).min
    open_ = np.where(allowed, score, least)
    rows = np.arange(len(score))
    for _ in range(min(k, score.shape[1])):
        column = open_.argmax(1)
        some = open_[rows, column] != least
        if not some.any():
            return
        yield rows[some], column[some]
        open_[rows[some], column[some]] = least


def first_in_group(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each group: higher scores first, ties by smaller id."""
    order = np.lexsort((ids, -score, group))
    head = np.ones(len(order), bool)
    head[1:] = group[order][1:] != group[order][:-1]
    start = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - start < k]


def scaled(df: DataFrame, id_col: str, vector_col: str, label: Column, scale: int) -> DataFrame:
    """(vec_id, label, dims, x, key): the rows that take part, x as packed 32 bit integers,
    key a hash that tells rows of one id apart."""
    bound_batches(df.sparkSession)
    columns = [F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v")]
    taken = df.select(*columns).where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")

    def run(batches):
        for batch in batches:
            column = batch.column("v")
            v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null becomes NaN
            edges = column.offsets.to_numpy() - column.offsets[0].as_py()
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(scale * v)
            bad = np.concatenate([np.zeros(1, np.int64), np.cumsum(~(np.abs(x) < LIMIT))])
            whole = np.where(np.abs(x) < LIMIT, x, 0)
            packed = whole.astype("<i4")
            kept, blobs, sizes = [], [], []
            for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                if bad[a] == bad[b] and float(whole[a:b] @ whole[a:b]) < LIMIT**2:
                    kept.append(i), blobs.append(packed[a:b].tobytes()), sizes.append(int(b - a))
            named = [batch.column(c).take(pa.array(kept, pa.int32())) for c in ("vec_id", "label")]
            yield pa.RecordBatch.from_arrays([*named, pa.array(sizes, pa.int32()), pa.array(blobs, pa.binary())], ["vec_id", "label", "dims", "x"])

    out = taken.mapInArrow(run, "vec_id long, label long, dims int, x binary")
    return out.withColumn("key", F.xxhash64("label", "x"))


def _deal(rows: DataFrame, anchors: DataFrame, blocks: int, order: list[str]) -> DataFrame:
    """Every block's rows in the given order, followed by all anchors."""
    columns = ["block", "kind", "vec_id", "label", "key", "x", "positives"]
    own_block = F.pmod(F.xxhash64("vec_id", "key"), F.lit(blocks)).cast("int")
    own = rows.withColumns({"block": own_block, "kind": F.lit(0), "positives": F.lit(None).cast(POSITIVES)})
    theirs = anchors.withColumns({"block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), "kind": F.lit(1)})
    both = own.select(columns).unionByName(theirs.select(columns))
    return both.repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "kind", *order)


def _as_rows(parts: list[pa.RecordBatch]) -> Rows:
    """The distinct rows of some batches. Equal ones lie side by side."""
    ids, labels, keys = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("vec_id", "label", "key"))
    fresh = np.ones(len(ids), bool)
    fresh[1:] = (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])
    vectors = [np.frombuffer(b.as_py(), "<i4") for p in parts for b in p.column("x")]
    vectors = [v for v, f in zip(vectors, fresh) if f]
    x = np.zeros((len(vectors), max((len(v) for v in vectors), default=0)), np.int32)
    for row, v in zip(x, vectors):
        row[: len(v)] = v
    return Rows(ids[fresh], labels[fresh], keys[fresh], x)


def _by_label(rows: Rows) -> dict[int, list[Rows]]:
    """Parts of at most ``ROWS`` rows of one label; ``rows`` are in the order of labels."""
    edges = [0, *(np.flatnonzero(np.diff(rows.labels)) + 1).tolist(), len(rows.labels)]
    return {int(rows.labels[a]): [rows.part(slice(k, min(b, k + ROWS))) for k in range(a, b, ROWS)] for a, b in zip(edges, edges[1:]) if a < b}


def _by_place(rows: Rows) -> list[Rows]:
    return [rows.part(slice(k, k + ROWS)) for k in range(0, len(rows.ids), ROWS)]


def _visits(batches, cut):
    """(cut(rows), anchors, their batch) of each block: anchors come by a bounded number."""
    block, held, parts = None, [], cut(Rows(*(np.zeros(0, np.int64),) * 3, np.zeros((0, 0), np.int32)))
    nothing = parts
    for batch in batches:
        blocks, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
        edges = [0, *(np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            if blocks[a] != block:
                block, held, parts = blocks[a], [], nothing
            if kinds[a] == 0:
                held.append(batch.slice(a, b - a))
                continue
            if held:
                parts, held = cut(_as_rows(held)), []
            for k in range(a, b, ANCHORS):
                piece = batch.slice(k, min(ANCHORS, b - k))
                yield parts, _as_rows([piece]), piece


def _batch(names: list[str], columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def _schema(names: list[str]) -> str:
    return ", ".join(f"{n} long" for n in names)


def find_positives(rows: DataFrame, anchors: DataFrame, blocks: int, count: int) -> DataFrame:
    """(vec_id, key, positives): the first ``count`` other rows of an anchor's label."""
    names = ["anchor_id", "anchor_key", "positive_id", "positive_score"]

    def run(batches):
        for by_label, a, _ in _visits(batches, _by_label):
            found = []
            for label in np.unique(a.labels).tolist():
                mine = np.flatnonzero(a.labels == label)
                some = a.part(mine)
                for part in by_label.get(label, ()):
                    s = scores(some, part)
                    other = (some.ids[:, None] != part.ids) | (some.keys[:, None] != part.keys)
                    found += [(mine[r], part.ids[c], s[r, c]) for r, c in first_of(s, other, count)]
            if found:
                r, ids, score = (np.concatenate(z) for z in zip(*found))
                best = first_in_group(r, score, ids, count)
                yield _batch(names, [a.ids[r[best]], a.keys[r[best]], ids[best], score[best]])

    dealt = _deal(rows, anchors.withColumn("positives", F.lit(None).cast(POSITIVES)), blocks, ["label", "vec_id", "key"])
    first = Window.partitionBy("anchor_id", "anchor_key").orderBy(F.desc("positive_score"), "positive_id")
    best = dealt.mapInArrow(run, _schema(names)).withColumn("place", F.row_number().over(first)).where(F.col("place") <= count)
    one = F.struct("place", F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))
    listed = best.groupBy("anchor_id", "anchor_key").agg(F.sort_array(F.collect_list(one)).alias("found"))
    slim = F.transform("found", lambda f: F.struct(f["id"].alias("id"), f["score"].alias("score")))
    return listed.select(F.col("anchor_id").alias("vec_id"), F.col("anchor_key").alias("key"), slim.alias("positives"))


def find_negatives(rows: DataFrame, anchors: DataFrame, blocks: int, count: int, window: tuple[int, int]) -> DataFrame:
    """For anchors with their positives, a row per negative: the first ``count`` rows of
    another label whose score is within ``window`` percent of the positive's."""
    names = ["anchor_id", "anchor_key", "place", "positive_id", "positive_score", "negative_id", "negative_score"]
    low, high = window

    def run(batches):
        for parts, a, piece in _visits(batches, _by_place):
            lists = piece.column("positives").to_pylist()
            places = max(map(len, lists))
            have = np.array([[k < len(p) for k in range(places)] for p in lists])
            ids, score = (np.array([[p[k][c] if k < len(p) else 0 for k in range(places)] for p in lists], np.int64) for c in ("id", "score"))
            found = []
            for part in parts:
                s = scores(a, part)
                other, hundred = a.labels[:, None] != part.labels, 100 * s
                for k in range(places):
                    bound = score[:, k, None]
                    inside = other & have[:, k, None] & (hundred >= low * bound) & (hundred <= high * bound)
                    found += [(r * places + k, part.ids[c], s[r, c]) for r, c in first_of(s, inside, count)]
            if found:
                group, other_ids, other_score = (np.concatenate(z) for z in zip(*found))
                best = first_in_group(group, other_score, other_ids, count)
                r, k = group[best] // places, group[best] % places
                yield _batch(names, [a.ids[r], a.keys[r], k, ids[r, k], score[r, k], other_ids[best], other_score[best]])

    dealt = _deal(rows, anchors, blocks, ["vec_id", "key"])
    first = Window.partitionBy("anchor_id", "anchor_key", "place").orderBy(F.desc("negative_score"), "negative_id")
    return dealt.mapInArrow(run, _schema(names)).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= count)


def hard_negatives(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label: Column | None = None,
    every: int = 50,
    n_positives: int = 5,
    n_negatives: int = 3,
    window: tuple[int, int] = (50, 95),
    scale: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows
    whose id is divisible by ``every``."""
    rows = stage(scaled(df, id_col, vector_col, F.col("label") if label is None else label, scale), "negatives-rows")
    size = 4 * (rows.agg(F.sum("dims")).first()[0] or 0)
    blocks = max(df.sparkSession.sparkContext.defaultParallelism, size // BLOCK_BYTES + 1)
    anchors = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "key"])
    known = stage(anchors.join(find_positives(rows, anchors, blocks, n_positives), ["vec_id", "key"]), "negatives-anchors")
    found = find_negatives(rows, known, blocks, n_negatives, window)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op11_residue_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), label=label)


OP11_SQL = """
WITH given AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other_id, list_dot_product(a.x, b.x)::BIGINT AS score
  FROM given a JOIN given b ON a.vec_id % 50 = 0 AND a.vec_id != b.vec_id
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id,
       row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
