"""Exact substring deduplication with per-shard suffix arrays.

Every byte that a repeated string of ``LENGTH`` bytes covers goes, unless no equal string
starts earlier (smaller id, or same document and smaller place).

Suffix arrays over all bytes would sort what is not repeated anywhere, so the shards hold
candidate regions only, chosen without loss:

1. The smallest hash among the ``GRAM``-byte strings of a window is its anchor. Equal
   windows have equal anchors. Neighbouring windows with one anchor form a run, so each
   window belongs to exactly one run.
2. Runs meet by anchor. Of runs with equal bytes, all but the earliest are repeats. What
   is left is of interest only where one anchor has runs with different bytes (the edges of
   repeated passages) or a run holds its anchor twice.
3. The bytes of those runs form shards. Each shard is sorted into a suffix array by
   Larsson-Sadakane refinement (only groups that are not yet told apart are sorted again),
   Kasai's rule gives the common prefixes of neighbours, and stretches of at least
   ``LENGTH`` are classes of equal windows; all but the earliest are repeats.
4. An anchor with very many different runs (a passage in a large part of all documents)
   is dealt over as many shards as its bytes fill. The sorted class lists of its shards are
   merged: each list is looked up in the joint key list by binary search, and the earliest
   window of a key stays.

Runs travel as packed rows; a task sends one of equal runs and settles the others itself.
Documents are met with their repeats by buckets of the id, one shuffle of the texts to cut
the regions and one for the result.

Defined cases: a null text is empty; texts shorter than ``LENGTH`` stay; windows never
cross documents; overlapping repeats count, so of a periodic text the first period and
``LENGTH`` - 1 bytes more stay at most; rows that repeat an id and a text are one document,
as none starts earlier; rows with one id and different texts are told apart by their text,
and equal windows at equal places of them both stay. A row with a null id takes no part.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddyline.llm.blobs import deal, gather, mix
from eddyline.llm.common import by_bytes, shuffle_parts, table, two_columns
from eddyline.session import stage

LENGTH = 100
GRAM = 32
SPAN = LENGTH - GRAM + 1
CHUNK = 1 << 20
REGION = 4096
CROWD = 64
SPREAD = 16
SHARD_BYTES = 1 << 20
BASE = np.uint64(0xD1342543DE82EF95)
_BYTES = np.random.default_rng(3).integers(1, 2**63, 256, dtype=np.uint64)

RUN = [np.int64, np.int64, np.int64, np.int32, np.uint64, np.uint64, np.uint8]  # id, text key, start, windows, anchor, bytes' hash, mark
SPANS = [np.int64, np.int64, np.int64, np.int64]  # id, text key, start, end
NEED = [np.int64, np.int64, np.int64, np.int32, np.uint64, np.uint16]  # id, text key, start, windows, anchor, shards (0: one)
SELF, MARKER, CROWDED = 1, 2, 4


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    up = np.ones(2 * CHUNK + LENGTH, np.uint64)
    down = up.copy()
    up[1:], down[1:] = BASE, np.uint64(pow(int(BASE), -1, 1 << 64))
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def runs_of(buffer: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of the windows of a buffer: (start, windows, anchor, hash of the bytes, self).
    ``last`` numbers the piece each byte is in; windows do not cross pieces."""
    n = len(buffer)
    if n < LENGTH:
        return tuple(np.zeros(0, k) for k in (np.int64, np.int32, np.uint64, np.uint64, bool))
    up, down = _powers()
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[buffer] * up[:n], out=sums[1:])
    gram = mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    low, width = gram, 1
    while width * 2 <= SPAN:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: n - LENGTH + 1], low[SPAN - width : SPAN - width + n - LENGTH + 1])
    whole = last[: n - LENGTH + 1] == last[LENGTH - 1 :]
    change = np.ones(len(low), bool)
    change[1:] = (low[1:] != low[:-1]) | (last[1 : len(low)] != last[: len(low) - 1]) | (whole[1:] != whole[:-1])
    start = np.flatnonzero(change)
    size = np.diff(np.append(start, len(low)))
    start, size = start[whole[start]], size[whole[start]]
    anchor = low[start]
    stop = start + size - 1 + LENGTH
    key = mix((sums[stop] - sums[start]) * down[start] + size.astype(np.uint64))
    place = np.arange(SPAN)
    head, tail = gram[start[:, None] + place] == anchor[:, None], gram[(start + size - 1)[:, None] + place] == anchor[:, None]
    twice = (size > SPAN) | (head.sum(axis=1) > 1) | (tail.sum(axis=1) > 1) | (start + head.argmax(axis=1) != start + size - 1 + tail.argmax(axis=1))
    return start, size.astype(np.int32), anchor, key, twice


def _pieces(ids: list, texts: list[str]):
    """(buffer, piece number per byte, id, text key and place of each piece), chunk by chunk."""
    held, total = [], 0
    for doc_id, text in zip(ids, texts):
        if doc_id is None:
            continue
        raw = text.encode()
        if len(raw) < LENGTH:
            continue
        key = text_key(raw)
        for at in range(0, len(raw) - LENGTH + 1, CHUNK):
            part = raw[at : at + CHUNK + LENGTH - 1]
            held.append((part, doc_id, key, at))
            total += len(part)
            if total >= CHUNK:
                yield _joined(held)
                held, total = [], 0
    if held:
        yield _joined(held)


def _joined(held: list):
    sizes = np.array([len(h[0]) for h in held])
    number = np.repeat(np.arange(len(held), dtype=np.int32), sizes)
    first = np.cumsum(sizes) - sizes
    return np.frombuffer(b"".join(h[0] for h in held), np.uint8), number, *(np.array([h[k] for h in held], np.int64) for k in (1, 2, 3)), first


def text_key(raw: bytes) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(raw)).astype(np.int64))


def _bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(ids.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _firsts(order_keys: tuple, group: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Order by group, then by the keys; and which places begin a group."""
    order = np.lexsort((*order_keys[::-1], *group[::-1]))
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([g[order][1:] != g[order][:-1] for g in group]) if len(order) else False
    return order, new


def _repeats(order: np.ndarray, new: np.ndarray, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places (in order) that are not at the group's first (id, start)."""
    head = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else order
    return (ids[order] != ids[head]) | (at[order] != at[head])


def _send(buckets: int):
    """Runs to the bucket of their anchor; repeats that a batch settles itself go to the
    bucket of their document, under a negative number."""

    def send(batches):
        for batch in batches:
            for part in by_bytes(batch, "text", 4 * CHUNK):
                got = []
                for buffer, number, ids, keys, at, first in _pieces(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    start, size, anchor, key, twice = runs_of(buffer, number)
                    piece = number[start]
                    got.append((ids[piece], keys[piece], at[piece] + start - first[piece], size, anchor, key, twice.astype(np.uint8) * SELF))
                if not got:
                    continue
                run = [np.concatenate([g[k] for g in got]).astype(kind) for k, kind in enumerate(RUN)]
                order, new = _firsts((run[0], run[2]), (run[4], run[5]))
                again = order[_repeats(order, new, run[0], run[2])]
                if len(again):
                    yield _removed(run, np.sort(again), buckets)
                keep = np.sort(np.setdiff1d(order, again, assume_unique=True))
                run = [c[keep] for c in run]
                _, inverse, count = np.unique(run[4], return_inverse=True, return_counts=True)
                crowd = count[inverse] >= CROWD
                run[6] = run[6] | (crowd * CROWDED).astype(np.uint8)
                to = (run[4] % np.uint64(buckets)).astype(np.int64)
                to[crowd] = ((run[4] + run[5] % np.uint64(SPREAD)) % np.uint64(buckets)).astype(np.int64)[crowd]
                if crowd.any():  # one marker tells an anchor's own bucket that it is crowded
                    _, one = np.unique(run[4][crowd], return_index=True)
                    one = np.flatnonzero(crowd)[one]
                    extra = [c[one] for c in run]
                    extra[6] = extra[6] | MARKER
                    run = [np.concatenate([c, x]) for c, x in zip(run, extra)]
                    to = np.concatenate([to, (extra[4] % np.uint64(buckets)).astype(np.int64)])
                yield deal(to, run, (0, 2))

    return send


def _removed(run: list, rows: np.ndarray, buckets: int) -> pa.RecordBatch:
    ids, keys, start, size = (run[k][rows] for k in range(4))
    made = deal(_bucket(ids, buckets), [ids, keys, start, start + size.astype(np.int64) - 1 + LENGTH], (0, 2))
    return pa.RecordBatch.from_arrays([pa.array(-1 - made.column("bucket").to_numpy(), pa.int32()), made.column("blob")], ["bucket", "blob"])


def _meet(buckets: int):
    """Equal runs settled, and the runs whose anchor has others: rows (kind, bucket, blob)."""

    def meet(key, rows):
        number, blobs = key[0].as_py(), rows.column("blob").to_pylist()
        if number < 0:
            return pa.table([pa.array(["span"] * len(blobs)), pa.array([-1 - number] * len(blobs), pa.int32()), pa.array(blobs, pa.binary())], ["kind", "bucket", "blob"])
        run = gather(blobs, RUN, (0, 2))
        marker = (run[6] & MARKER) > 0
        crowded = np.unique(run[4][(run[6] & CROWDED) > 0])
        run = [c[~marker] for c in run]
        order, new = _firsts((run[0], run[2]), (run[4], run[5]))
        again = _repeats(order, new, run[0], run[2])
        heads = order[new]
        anchors = run[4][heads]
        fresh = np.ones(len(heads), bool)
        fresh[1:] = anchors[1:] != anchors[:-1]
        count = np.diff(np.append(np.flatnonzero(fresh), len(heads)))
        crowd = np.isin(anchors, crowded)
        wanted = heads[(np.repeat(count, count) > 1) | ((run[6][heads] & SELF) > 0) | crowd]
        out = []
        if again.any():
            made = _removed(run, order[again], buckets)
            out.append(("span", -1 - made.column("bucket").to_numpy(), made.column("blob").to_pylist()))
        if len(wanted):
            wanted = wanted[np.lexsort((run[2][wanted], run[0][wanted]))]
            need = [run[k][wanted] for k in range(5)] + [_shards_of(run[4][wanted], run[3][wanted], crowded)]
            made = deal(_bucket(need[0], buckets), need, (0, 2))
            out.append(("need", made.column("bucket").to_numpy(), made.column("blob").to_pylist()))
        return _rows(out)

    return meet


def _shards_of(anchors: np.ndarray, windows: np.ndarray, crowded: np.ndarray) -> np.ndarray:
    """Over how many shards the runs of each run's anchor go, from their bytes; 0 for one. A
    bucket has all runs of an anchor, or about one in ``SPREAD`` of a crowded one."""
    names, place = np.unique(anchors, return_inverse=True)
    many = np.isin(names, crowded)
    total = np.bincount(place, windows.astype(np.int64) - 1 + LENGTH, minlength=len(names)) * np.where(many, SPREAD, 1)
    shards = np.ceil(total / SHARD_BYTES)
    shards = np.where(many, np.maximum(shards, SPREAD), np.where(shards > 1, shards, 0))
    return np.minimum(shards, 65535).astype(np.uint16)[place]


def _rows(out: list) -> pa.Table:
    return pa.table(
        [
            pa.array([k for k, b, _ in out for _ in b], pa.string()),
            pa.array([int(x) for _, b, _ in out for x in b], pa.int32()),
            pa.array([x for _, _, blobs in out for x in blobs], pa.binary()),
        ],
        ["kind", "bucket", "blob"],
    )


ROWS = "kind string, bucket int, blob binary"


def _cut(buckets: int):
    """The bytes of needed runs, for the shard of their anchor: rows (shard, header, bytes)."""

    def cut(key, docs, rows):
        ids, keys, start, size, anchor, crowd = gather(rows.column("blob").to_pylist(), NEED, (0, 2))
        texts = _texts(docs, set(zip(ids.tolist(), keys.tolist())))
        shard = (anchor % np.uint64(buckets)).astype(np.int64)
        salt = mix(ids.astype(np.uint64) + np.uint64(11)) % np.maximum(crowd, 1).astype(np.uint64)
        shard[crowd > 0] = ((anchor + salt) % np.uint64(buckets)).astype(np.int64)[crowd > 0]
        out: dict[int, list] = {}
        for i, k, s, n, a, c, to in zip(*(x.tolist() for x in (ids, keys, start, size, anchor, crowd, shard))):
            raw = texts[i, k]
            for at in range(s, s + n, REGION):
                windows = min(REGION, s + n - at)
                out.setdefault(to, []).append((i, k, at, windows, a, c, raw[at : at + windows - 1 + LENGTH]))
        kinds, heads, bodies = [], [], []
        for to, found in out.items():
            columns = [np.array([f[k] for f in found], kind) for k, kind in enumerate(NEED)]
            made = deal(np.zeros(len(found), np.int64), columns)
            kinds.append(to), heads.append(made.column("blob")[0].as_py()), bodies.append(b"".join(f[6] for f in found))
        return pa.table([pa.array(kinds, pa.int32()), pa.array(heads, pa.binary()), pa.array(bodies, pa.binary())], ["shard", "head", "body"])

    return cut


def _texts(docs: pa.Table, wanted: set) -> dict:
    out = {}
    ids = {i for i, _ in wanted}
    for i, text in zip(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist()):
        if i in ids:
            raw = text.encode()
            if (i, k := text_key(raw)) in wanted:
                out[i, k] = raw
    return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places sorted by the text from them on, by refinement: each round doubles the
    compared length and sorts only groups that are still equal. It goes on until none is:
    Kasai's rule holds for the complete order alone."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    first = np.zeros(n, np.uint64)
    for k in range(8):
        first = first << np.uint64(8) | padded[k : n + k]
    left = np.minimum(n - np.arange(n), 8)  # a text that ends is smaller than one with zeros
    order = np.lexsort((left, first))
    new = np.ones(n, bool)
    new[1:] = (first[order][1:] != first[order][:-1]) | (left[order][1:] != left[order][:-1])
    rank = np.empty(n + 1, np.int64)
    rank[order], rank[n] = np.flatnonzero(new)[np.cumsum(new) - 1], -1
    h = 8
    while True:
        single = new & np.append(new[1:], True)
        slots = np.flatnonzero(~single)
        if not len(slots):
            break
        at = order[slots]
        second = rank[np.minimum(at + h, n)]
        inner = np.lexsort((second, rank[at]))
        at, second = at[inner], second[inner]
        order[slots] = at
        split = np.ones(len(at), bool)
        split[1:] = (rank[at][1:] != rank[at][:-1]) | (second[1:] != second[:-1])
        new[slots] = split
        heads = slots[np.flatnonzero(split)]
        fresh = heads[np.cumsum(split) - 1]
        rank[at] = fresh
        h *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, first: np.ndarray, sizes: np.ndarray, cap: int = LENGTH) -> np.ndarray:
    """Common prefix of each place with the one before it in the order, up to ``cap``.
    Kasai's rule, the prefix falls by at most one from a place to the next, is followed
    along all regions (``first``, ``sizes``) at once."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    lcp = np.zeros(n, np.int64)
    longest = np.argsort(-sizes, kind="stable")
    first, sizes = first[longest], sizes[longest]
    now = np.zeros(len(first), np.int64)
    for step in range(int(sizes[0]) if len(sizes) else 0):
        live = int(np.searchsorted(-sizes, -step, side="left"))  # regions longer than step
        here = first[:live] + step
        there = before[here]
        now[:live] = np.where(there < 0, 0, np.maximum(now[:live] - 1, 0))
        grow = np.flatnonzero(there >= 0)
        while len(grow):
            a, b = here[grow] + now[grow], there[grow] + now[grow]
            fits = (now[grow] < cap) & (a < n) & (b < n)
            fits[fits] = text[a[fits]] == text[b[fits]]
            grow = grow[fits]
            now[grow] += 1
        lcp[here] = now[:live]
    return lcp[order]


def _shard(buckets: int):
    """Repeats inside one shard; class lists of crowded anchors for the merge."""

    def sort(key, rows):
        heads = [gather([h], NEED) for h in rows.column("head").to_pylist()]
        bodies = rows.column("body").to_pylist()
        columns = [np.concatenate([h[k] for h in heads]) for k in range(len(NEED))]
        sizes = columns[3].astype(np.int64) - 1 + LENGTH
        text = np.frombuffer(b"".join(bodies), np.uint8)
        starts = np.cumsum(sizes) - sizes
        by_anchor = np.argsort(columns[4], kind="stable")
        spans, merge = [], []
        a = 0
        while a < len(by_anchor):  # anchors are independent: sort them in parts of bounded size
            total = np.cumsum(sizes[by_anchor[a:]])
            b = a + max(1, int(np.searchsorted(total, SHARD_BYTES)))
            while b < len(by_anchor) and columns[4][by_anchor[b]] == columns[4][by_anchor[b - 1]]:
                b += 1
            part = by_anchor[a:b]
            found, lists = _classes(text, starts[part], sizes[part], [c[part] for c in columns])
            spans.append(found), merge.append(lists)
            a = b
        out = []
        ids, keys, at = (np.concatenate([s[k] for s in spans]) for k in range(3))
        if len(ids):
            out.append(_span_rows(ids, keys, at, buckets))
        lists = [np.concatenate([m[k] for m in merge]) for k in range(5)]
        if len(lists[0]):
            order = np.lexsort((lists[1], lists[0]))
            made = deal((lists[0][order] % np.uint64(buckets)).astype(np.int64), [c[order] for c in lists])
            out.append(("list", made.column("bucket").to_numpy(), made.column("blob").to_pylist()))
        return _rows(out)

    return sort


def _span_rows(ids, keys, at, buckets: int):
    """Starts of repeats as spans: neighbouring starts become one."""
    order = np.lexsort((at, keys, ids))
    ids, keys, at = ids[order], keys[order], at[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]) | (at[1:] > at[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(ids)) - 1
    made = deal(_bucket(ids[head], buckets), [ids[head], keys[head], at[head], at[tail] + LENGTH], (0, 2))
    return ("span", made.column("bucket").to_numpy(), made.column("blob").to_pylist())


LIST = [np.uint64, np.uint64, np.int64, np.int64, np.int64]  # window's two hashes, id, text key, start


def _classes(text, starts, sizes, columns):
    """Windows of the regions that repeat an earlier one: (ids, text keys, starts); and the
    earliest windows of crowded anchors with their keys."""
    own = np.concatenate([text[s : s + n] for s, n in zip(starts, sizes)])
    first = np.cumsum(sizes) - sizes
    region = np.repeat(np.arange(len(sizes)), sizes)
    order = suffix_array(own)
    lcp = common_prefixes(own, order, first, sizes)
    number = np.cumsum(lcp < LENGTH)
    offset = np.arange(len(own)) - first[region]
    window = (offset[order] < columns[3][region[order]]).nonzero()[0]  # LENGTH bytes of the region are left
    at, number = order[window], number[window]
    r = region[at]
    ids, keys, where = columns[0][r], columns[1][r], columns[2][r] + offset[at]
    by, new = _firsts((ids, where), (number,))
    again = _repeats(by, new, ids, where)
    late = by[again]
    early = by[~again]
    early = early[columns[5][r[early]] > 0]
    lists = [np.zeros(0, k) for k in LIST]
    if len(early):
        raw = own.tobytes()
        hashes = np.array([xxhash.xxh3_128_intdigest(raw[p : p + LENGTH]).to_bytes(16, "little") for p in at[early].tolist()], dtype="S16")
        pair = np.frombuffer(b"".join(h.ljust(16, b"\0") for h in hashes.tolist()), np.uint64).reshape(-1, 2)
        lists = [pair[:, 0], pair[:, 1], ids[early], keys[early], where[early]]
    return (ids[late], keys[late], where[late]), lists


def _merge(buckets: int):
    """Class lists of several shards: each is looked up in the joint keys by binary search."""

    def merge(key, rows):
        lists = [gather([b], LIST) for b in rows.column("blob").to_pylist()]
        joint = np.unique(np.concatenate([x[0] for x in lists]))
        number = np.concatenate([np.searchsorted(joint, x[0]) for x in lists])
        _, second, ids, keys, at = (np.concatenate([x[k] for x in lists]) for k in range(5))
        by, new = _firsts((ids, at), (number, second))
        late = by[_repeats(by, new, ids, at)]
        return _rows([_span_rows(ids[late], keys[late], at[late], buckets)] if len(late) else [])

    return merge


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Packed repeats by bucket of the document: (bucket, blob of ``SPANS``)."""
    buckets = shuffle_parts(docs.sparkSession)
    runs = docs.mapInArrow(_send(buckets), "bucket int, blob binary").groupBy("bucket").applyInArrow(_meet(buckets), ROWS)
    runs = stage(runs, "suffix-runs")
    need = runs.where("kind = 'need'").select("bucket", "blob")
    regions = dealt(docs, buckets).groupBy("bucket").cogroup(need.groupBy("bucket")).applyInArrow(_skip_empty(_cut(buckets)), "shard int, head binary, body binary")
    found = stage(regions.groupBy("shard").applyInArrow(_shard(buckets), ROWS), "suffix-shards")
    merged = stage(found.where("kind = 'list'").groupBy("bucket").applyInArrow(_merge(buckets), ROWS), "suffix-merged")
    each = [x.where("kind = 'span'").select("bucket", "blob") for x in (runs, found, merged)]
    return each[0].unionByName(each[1]).unionByName(each[2])


def _skip_empty(cut):
    """Buckets without documents or without needed runs give no region."""

    def work(key, docs, rows):
        if docs.num_rows and rows.num_rows:
            return cut(key, docs, rows)
        return pa.table([pa.array([], pa.int32()), pa.array([], pa.binary()), pa.array([], pa.binary())], ["shard", "head", "body"])

    return work


def dealt(docs: DataFrame, buckets: int) -> DataFrame:
    """Documents with their bucket; the arithmetic of ``_bucket`` happens in Python."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").fill_null(0).to_numpy().copy()
            for i in np.flatnonzero(batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)):
                ids[i] = text_key(batch.column("text")[int(i)].as_py().encode())
            bucket = pa.array(_bucket(ids, buckets).astype(np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), bucket], ["doc_id", "text", "bucket"])

    return docs.mapInArrow(run, "doc_id long, text string, bucket int")


def kept_of(raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[bytes, list[tuple[int, int]]]:
    """What the spans leave, and the spans joined where they touch or overlap."""
    joined: list[tuple[int, int]] = []
    for a, b in sorted(zip(start.tolist(), end.tolist())):
        if joined and a <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
        else:
            joined.append((a, b))
    out, at = [], 0
    for a, b in joined:
        out.append(raw[at:a])
        at = b
    out.append(raw[at:])
    return b"".join(out), joined


def _apply(docs: DataFrame, work, schema: str) -> DataFrame:
    """``work(id, raw, kept, spans)`` for every document with its repeats."""
    buckets = shuffle_parts(docs.sparkSession)
    spans = repeated_spans(docs)
    names = [c.split()[0] for c in schema.split(", ")]

    def finish(key, rows, blobs):
        ids, keys, start, end = gather(blobs.column("blob").to_pylist(), SPANS, (0, 2)) if blobs.num_rows else (np.zeros(0, k) for k in SPANS)
        order = np.lexsort((keys, ids))
        ids, keys, start, end = ids[order], keys[order], start[order], end[order]
        out = []
        for i, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()):
            raw = text.encode()
            a = b = 0
            if i is not None and len(raw) >= LENGTH:
                a, b = np.searchsorted(ids, i), np.searchsorted(ids, i, side="right")
            mine = np.arange(a, b)[keys[a:b] == text_key(raw)] if b > a else slice(0, 0)
            out.append(work(i, raw, *kept_of(raw, start[mine], end[mine])))
        columns = list(zip(*out)) if out else [() for _ in names]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}[c.split()[1]] for c in schema.split(", ")]
    return dealt(docs, buckets).groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInArrow(finish, schema)


def _documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return two_columns(df, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: (doc_id, kept, starts, ends): the bytes left and the removed spans."""
    work = lambda i, raw, kept, spans: (i, kept, [a for a, _ in spans], [b for _, b in spans])
    return _apply(_documents(df, id_col, text_col), work, "doc_id long, kept binary, starts array<long>, ends array<long>")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``deduplicate`` with sizes and a digest instead of the bytes."""
    work = lambda i, raw, kept, spans: (i, len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
    return _apply(_documents(df, id_col, text_col), work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


OP5_SQL = """
WITH texts AS MATERIALIZED (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), windows AS (
  SELECT doc_id, s, md5_number(substr(h, 2 * s + 1, 200)) AS w FROM texts, unnest(range(0, n - 99)) AS t(s) WHERE n >= 100
), late AS MATERIALIZED (
  SELECT doc_id, s FROM windows
  QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, s) > 1
), edges AS (
  SELECT doc_id, s, coalesce(s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100, true) AS opens FROM late
), numbered AS (
  SELECT doc_id, s, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM edges
), spans AS MATERIALIZED (
  SELECT doc_id, k, min(s) AS a, max(s) + 100 AS b FROM numbered GROUP BY doc_id, k
), pieces AS (
  SELECT t.doc_id, p.k, CASE WHEN p.k IS NULL THEN h ELSE substr(h, 2 * coalesce(lag(p.b) OVER w, 0) + 1, 2 * (p.a - coalesce(lag(p.b) OVER w, 0))) END AS piece
  FROM texts t LEFT JOIN spans p USING (doc_id) WINDOW w AS (PARTITION BY t.doc_id ORDER BY p.k)
), ends AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last FROM spans GROUP BY doc_id
), joined AS (
  SELECT doc_id, string_agg(piece, '' ORDER BY k) AS body FROM pieces GROUP BY doc_id
)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE body || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM texts LEFT JOIN ends USING (doc_id) LEFT JOIN joined USING (doc_id)
"""
