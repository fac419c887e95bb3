"""Columns of numbers packed into binary values.

A scan that makes millions of small records sends them to buckets as a few packed rows
(one per bucket and batch) instead of a row each: Spark deals out and spills the rows,
numpy sorts inside a bucket. The number of buckets is the number of shuffle partitions,
so a bucket's size follows the cluster's own setting.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard

_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """Splitmix finaliser: spreads 64 bit values evenly."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def pack(columns: list[np.ndarray], deltas: tuple[int, ...] = ()) -> bytes:
    """Arrays of equal length as one compressed value. Columns numbered in ``deltas`` are
    stored as differences, which suits sorted ones."""
    body = [np.uint32(len(columns[0])).tobytes()]
    for k, c in enumerate(columns):
        body.append(np.diff(c, prepend=c.dtype.type(0)).astype(c.dtype).tobytes() if k in deltas else np.ascontiguousarray(c).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(body))


def unpack(value: bytes, dtypes: list, deltas: tuple[int, ...] = ()) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(value)
    n, at, out = int(np.frombuffer(raw, np.uint32, 1)[0]), 4, []
    for k, kind in enumerate(dtypes):
        c = np.frombuffer(raw, kind, n, at)
        at += c.nbytes
        out.append(np.cumsum(c, dtype=c.dtype) if k in deltas else c)
    return out


def deal(bucket: np.ndarray, columns: list[np.ndarray], deltas: tuple[int, ...] = ()) -> pa.RecordBatch:
    """Rows (bucket, blob): the records of each bucket, in their present order."""
    order = np.argsort(bucket, kind="stable")
    sorted_bucket = bucket[order]
    edges = np.flatnonzero(np.diff(sorted_bucket, prepend=-1, append=-1))
    columns = [c[order] for c in columns]
    blobs = [pack([c[a:b] for c in columns], deltas) for a, b in zip(edges, edges[1:])]
    keys = sorted_bucket[edges[:-1]].astype(np.int32) if len(bucket) else np.zeros(0, np.int32)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])


def gather(blobs: list[bytes], dtypes: list, deltas: tuple[int, ...] = ()) -> list[np.ndarray]:
    """The records of several blobs, one after another."""
    parts = [unpack(b, dtypes, deltas) for b in blobs]
    return [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, kind) for k, kind in enumerate(dtypes)]
