"""Document fingerprints: quartile bucket digests.

Of the bytes in a sliding window of twelve, three triplets are hashed, each into one of ``BUCKETS`` counters. A counter is written as the quarter its count falls
in, two bits each, after one byte for the logarithm of the length, as hex. Two digests
differ by the sum of their bucket steps plus a bounded step for the length; likeness is
one minus that difference over its largest value, so it lies between 0 and 1.

Defined cases: a null text is empty, and an empty text has the digest of zeros; equal
texts have equal digests. ``with_next`` orders by descending id, null ids last, ties by
text in descending order; equal rows stay apart. A frame of one row is its own next.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from eddyline.llm.common import by_bytes, id_type, shuffle_parts, table, two_columns

BUCKETS = 256
SKIPS = ((3, 7), (4, 9), (5, 11))
LENGTH_STEP = 6.0
CHUNK = 1 << 22


def counts_of(raw: bytes, buckets: int = BUCKETS) -> np.ndarray:
    """Hashed triplets per bucket. Long texts are read in chunks that overlap by a triplet."""
    total = np.zeros(buckets, np.int64)
    reach = max(b for _, b in SKIPS)
    for a in range(0, max(len(raw), 1), CHUNK):
        x = np.frombuffer(raw[a : a + CHUNK + reach], np.uint8).astype(np.uint32)
        room = min(CHUNK, len(raw) - a)
        for k, (i, j) in enumerate(SKIPS):
            n = min(len(x) - j, room)
            if n > 0:
                h = x[:n] * np.uint32(2654435761) + x[i : i + n] * np.uint32(2246822519) + x[j : j + n] * np.uint32(3266489917) + np.uint32(668265263 * (k + 1) & 0xFFFFFFFF)
                h ^= h >> np.uint32(15)
                h *= np.uint32(2246822519)
                total += np.bincount(h >> np.uint32(32 - buckets.bit_length() + 1), minlength=buckets)
    return total


def digest(raw: bytes, buckets: int = BUCKETS) -> np.ndarray:
    """Length byte, then four buckets to a byte."""
    counts = counts_of(raw, buckets)
    ordered = np.sort(counts)
    q1, q2, q3 = (ordered[buckets * k // 4 - 1] for k in (1, 2, 3))
    step = ((counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)).astype(np.uint8).reshape(-1, 4)
    packed = step[:, 0] << 6 | step[:, 1] << 4 | step[:, 2] << 2 | step[:, 3]
    length = min(255, int(round(np.log2(1 + len(raw)) * 8)))
    return np.concatenate([np.array([length], np.uint8), packed.astype(np.uint8)])


_A, _B = np.divmod(np.arange(65536, dtype=np.int64), 256)
_STEPS = sum(np.abs(((_A >> s) & 3) - ((_B >> s) & 3)) for s in (0, 2, 4, 6)).astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """One minus the bounded difference of two digests over its largest value."""
    steps = int(_STEPS[a[1:].astype(np.int64) * 256 + b[1:]].sum())
    length = min(LENGTH_STEP * 8, abs(float(a[0]) - float(b[0])))
    most = 3.0 * 4 * (len(a) - 1) + LENGTH_STEP * 8
    return max(0.0, 1.0 - (steps + length) / most)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: (doc_id, fingerprint)."""

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch, "text"):
                prints = [digest(t.encode()).tobytes().hex() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(prints, pa.string())], ["doc_id", "fingerprint"])

    return two_columns(df, id_col, text_col).mapInArrow(run, f"doc_id {id_type(df, id_col)}, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last half of the text, rounded down, gives way to as much of the next one's start."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _blocks(rows: DataFrame) -> tuple[list, list]:
    """Cuts of the id range into blocks of about equal size, and the largest id of each
    block that has rows. Both lists are as long as the number of shuffle partitions."""
    n = shuffle_parts(rows.sparkSession)
    shares = [k / n for k in range(1, n)]
    cuts = sorted(set(rows.agg(F.percentile_approx("doc_id", F.lit(shares), F.lit(max(1000, 20 * n))).alias("c")).first()["c"] or [])) if shares else []
    block = _block_of(cuts)
    tops = rows.groupBy(block.alias("block")).agg(F.max("doc_id").alias("top")).collect()
    return cuts, sorted([(r["block"], r["top"]) for r in tops])


def _block_of(cuts: list):
    """Block of an id; null ids are in the lowest one."""
    return F.coalesce(_count_below(cuts), F.lit(0))


def _count_below(cuts: list):
    """Number of cuts below an id, by halving the sorted list."""
    if not cuts:
        return F.lit(0)

    def halve(a: int, b: int):
        if a == b:
            return F.lit(a)
        mid = (a + b) // 2
        return F.when(F.col("doc_id") > F.lit(cuts[mid]), halve(mid + 1, b)).otherwise(halve(a, mid))

    return F.when(F.col("doc_id").isNotNull(), halve(0, len(cuts)))


def with_next(df: DataFrame, work, schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Run ``work(ids, texts, following)`` over all rows in descending order of id, each
    with the text of the row after it; the last row is followed by the first.

    Rows are dealt by id range. The first row of a block also travels, as a guest, to
    the block before it, so one shuffle brings every row next to its follower.
    """
    rows = two_columns(df, id_col, text_col)
    cuts, tops = _blocks(rows)
    if not tops:
        return rows.sparkSession.createDataFrame([], schema)
    ordered = [b for b, _ in reversed(tops)]  # blocks in reading order
    host_of = {b: ordered[i - 1] for i, b in enumerate(ordered)}
    tops_by = dict(tops)
    pairs = [F.lit(v) for b in ordered for v in (b, host_of[b])]
    known = [F.lit(v) for b in ordered if tops_by[b] is not None for v in (b, tops_by[b])]
    block = F.col("block")
    is_top = F.col("doc_id").eqNullSafe(F.create_map(*known)[block]) if known else F.col("doc_id").isNull()
    guest_key = F.when(is_top, F.create_map(*pairs)[block])
    placed = rows.withColumn("block", _block_of(cuts))
    visits = F.array_compact(F.array(F.struct(F.col("block").alias("home"), F.lit(False).alias("guest")), F.when(guest_key.isNotNull(), F.struct(guest_key.alias("home"), F.lit(True).alias("guest")))))
    dealt = placed.select("doc_id", "text", F.explode(visits).alias("v")).select("doc_id", "text", "v.home", "v.guest")
    n = shuffle_parts(rows.sparkSession)
    sorted_rows = dealt.repartition(n, "home").sortWithinPartitions("home", "guest", F.col("doc_id").desc_nulls_last(), F.col("text").desc())

    def run(batches):
        held = None  # the last row of a batch waits for its follower
        for batch in batches:
            for part in by_bytes(batch, "text"):
                ids, texts, follow = [], [], []
                for i, t, home, guest in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), part.column("home").to_pylist(), part.column("guest").to_pylist()):
                    if held is not None and held[2] == home:
                        ids.append(held[0]), texts.append(held[1]), follow.append(t)
                    held = None if guest else (i, t, home)
                if ids:
                    yield from work(ids, texts, follow)

    return sorted_rows.mapInArrow(run, schema)


def edited_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text against its edited text and the next one: (doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next)."""
    kind = id_type(df, id_col)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def work(ids, texts, following):
        seen: dict[str, np.ndarray] = {}

        def of(t):
            if t not in seen:
                seen[t] = digest(t.encode())
            return seen[t]

        new = [edited(t, f) for t, f in zip(texts, following)]
        raw = [t.encode() for t in new]
        own, other, then = [of(t) for t in texts], [digest(r) for r in raw], [of(f) for f in following]
        columns = [
            pa.array(ids, arrow_id),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string()),
            pa.array([d.tobytes().hex() for d in own], pa.string()),
            pa.array([d.tobytes().hex() for d in other], pa.string()),
            pa.array([likeness(a, b) for a, b in zip(own, other)], pa.float64()),
            pa.array([likeness(a, b) for a, b in zip(own, then)], pa.float64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names)

    arrow_id = to_arrow_type(df.schema[id_col].dataType)
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(df, work, schema, id_col, text_col)


def op10_quartile_digest(spark, sf_dir: str) -> DataFrame:
    return edited_pairs(table(spark, sf_dir, "documents"))
