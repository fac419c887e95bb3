"""N-gram Jaccard self-join by vertical partitioning, and its connected components.

A text is the set of its five-word shingles, each a 64 bit hash. The order of the hashes
is the global n-gram order, and ranges of it are the fragments.

1. Texts with the same set form a class; classes, not texts, are compared. A class is
   named by a 64 bit key of its set, and read through the text with its smallest id.
2. Candidates. Two sets with Jaccard similarity of at least t differ in at most
   d = (|A| + |B|) (1 - t) / (1 + t) shingles. With m > d fragments of the order, at least
   m - d fragments hold the same part of both sets, so equal hashes of (fragment, part)
   bring every such pair together; texts that merely share a common passage rarely have a
   fragment of nothing else. m depends on the size, so sets are compared within size
   classes and with the next one. A set with so many empty fragments that the equal ones
   could all be empty also sends its single shingles; then both sets of such a pair do.
   A set of k fragments that are not empty shares at least k - d of them with a similar
   one, so sets that share fewer with all others together have no partner and leave; of
   the others those leave that share less than t of their shingles with all others.
3. Counting. Candidate pairs are counted fragment by fragment (a few coarse fragments of
   the same order), the partial overlaps are summed per pair, and the sum decides.
4. Candidate lists are first read as stars around the member with the largest overlap with
   all sets on the average, which of edited copies is the one nearest to all. What the stars
   link is one component and needs no more pairs. Then every pair of members of a list that
   are still in different components is a candidate as well, if what either set shares with
   any other allows t: in lists of at most ``SMALL_LIST`` members as a row, if it shares
   enough fragments (k - d of either set) or else meets in a larger list; in larger lists
   in blocks of members (``list_links``). No similar pair is in two components at the end, so
   components are exact without the pairs of a large group.

Texts send their fragments, once per class and task, as packed rows to buckets whose number
follows the shingles of the corpus; copies of a class meet there as one. Texts meet their
class, classes their component and edges their star in salted groups, so a class or component
may hold any share of the rows.

Defined cases: a null text is empty; a text without words has no shingle and is linked
with nothing; fewer words than ``WORDS`` make one shingle. Rows are judged by their text:
rows that repeat an id get the component of their own text each. A row with a null id is
in no component (null).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from eddyline.llm.blobs import deal, gather, mix
from eddyline.llm.common import by_bytes, fresh, likely_among, shuffle_parts, table, tidy, two_columns, with_least
from eddyline.llm.components import components
from eddyline.llm.list_links import large_list_links, split_by_size
from eddyline.session import stage

WORDS = 5
SIMILARITY = (80, 100)
FRAGMENTS = 4
SMALL_LIST = 32
CHUNK = 1 << 18
BUCKET_RECORDS = 4 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACES = np.random.default_rng(5).integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES = np.random.default_rng(9).integers(1, 2**63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    up = np.ones(CHUNK + 1, np.uint64)
    down = np.ones(CHUNK + 1, np.uint64)
    up[1:], down[1:] = BASE, inverse
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash per word. Long texts are read in chunks; the sum and the length of a word that
    is still open at the end of a chunk go on in the next one."""
    up, down = _powers()
    out, open_sum, open_size = [], 0, 0
    for at in range(0, len(raw), CHUNK):
        x = np.frombuffer(raw, np.uint8, min(CHUNK, len(raw) - at), at)
        blank = _BLANK[x]
        edge = np.diff(blank.astype(np.int8), prepend=1, append=1)
        start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[_LOWER[x]] * up[: len(x)])])
        value, size = (sums[stop] - sums[start]) * down[start], (stop - start).astype(np.uint64)
        if open_size:
            if not blank[0]:
                value[0] = (open_sum + int(value[0]) * pow(int(BASE), open_size, 1 << 64)) % (1 << 64)
                size[0] += np.uint64(open_size)
            else:
                value, size = np.append(np.uint64(open_sum), value), np.append(np.uint64(open_size), size)
        goes_on = at + CHUNK < len(raw) and not blank[-1]
        open_sum, open_size = (int(value[-1]), int(size[-1])) if goes_on else (0, 0)
        done = len(value) - goes_on
        out.append(mix(value[:done] + size[:done]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The sorted set of a text's shingle hashes."""
    w = word_hashes(text.encode())
    if not len(w):
        return w
    n = min(words, len(w))
    total = np.zeros(len(w) - n + 1, np.uint64)
    for k in range(n):
        total += w[k : len(w) - n + 1 + k] * _PLACES[k]
    return np.unique(mix(total + np.uint64(n)))


def set_key(s: np.ndarray) -> tuple[int, int]:
    """Two 64 bit numbers that sets have in common only if they are equal."""
    with np.errstate(over="ignore"):
        a, b = s.sum(dtype=np.uint64), mix(s ^ np.uint64(0x5BF03635)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def sets(docs: DataFrame, num: int, den: int) -> DataFrame:
    """(doc_id, n, k1, k2, need_even, need_odd): size and key of each text's set, and how
    many fragments it must share in its join class of that parity to have a partner."""

    @tidy
    def run(batches):
        for batch in batches:
            for part in by_bytes(batch, "text"):
                found = [shingles(t) for t in part.column("text").to_pylist()]
                keys = [set_key(s) for s in found]
                needs = [needed(s, num, den) for s in found]
                columns = [part.column("doc_id"), pa.array([len(s) for s in found], pa.int64())]
                columns += [pa.array([row[k] for row in rows], pa.int64()) for rows in (keys, needs) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "k1", "k2", "need_even", "need_odd"])

    return docs.mapInArrow(run, "doc_id long, n long, k1 long, k2 long, need_even long, need_odd long")


@lru_cache(maxsize=4)
def size_edges(num: int, den: int) -> np.ndarray:
    """First size of each size class: a partner is in the same class or the next one."""
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(edges[-1] * den // num + 1)
    return np.array(edges, np.int64)


def parameters(join_class: int, num: int, den: int) -> tuple[int, int]:
    """(m, d) of a join class: number of fragments, most shingles that differ."""
    largest = int(size_edges(num, den)[join_class + 1]) - 1
    d = 2 * largest * (den - num) // (den + num)
    return d + 1 + max(1, largest // 25), d


def cut_set(s: np.ndarray, num: int, den: int):
    """(join class, d, fragment of each shingle, first shingle of each fragment that is not
    empty) for the two join classes of a sorted set."""
    own = int(np.searchsorted(size_edges(num, den), len(s), side="right")) - 1
    for join_class in (own, own + 1):
        m, d = parameters(join_class, num, den)
        place = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        yield join_class, d, place, np.flatnonzero(np.diff(place, prepend=np.uint64(m)))


def needed(s: np.ndarray, num: int, den: int) -> tuple[int, int]:
    """Fragments a set shares with a similar one at least, by parity of the join class."""
    out = [0, 0]
    if len(s):
        for join_class, d, _, first in cut_set(s, num, den):
            out[join_class % 2] = max(1, len(first) - d)
    return out[0], out[1]


def fragment_hashes(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """Hashes of (join class, fragment, part) of a sorted set, for its two join classes.
    The highest bit is the parity of the join class."""
    out = []
    for join_class, d, place, first in cut_set(s, num, den):
        tag = mix(np.array([join_class + 1], np.uint64))[0]
        part = np.add.reduceat(mix(s ^ tag), first)
        found = [mix(part + place[first] * BASE + tag)]
        if len(first) <= d:
            found.append(mix(s + tag))
        out.append(np.concatenate(found) >> np.uint64(1) | np.uint64(join_class % 2) << np.uint64(63))
    return np.concatenate(out)


def shared_fragments(docs: DataFrame, buckets: int, num: int, den: int) -> DataFrame:
    """(fragment, odd, id): every fragment part that more than one class has, and whether its
    join class is odd."""

    @tidy
    def send(batches):
        seen: set[tuple] = set()
        for batch in batches:
            for part in by_bytes(batch, "text", 4 << 20):
                hashes, ids = [], []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    s = shingles(text) if doc_id is not None else ()
                    if len(s) and (key := (len(s), *set_key(s))) not in seen:
                        seen.add(key)
                        h = fragment_hashes(s, num, den)
                        hashes.append(h), ids.append(np.full(len(h), key[1], np.int64))
                if hashes:
                    h = np.concatenate(hashes)
                    odd, body = (h >> np.uint64(63)).astype(np.uint8), h & np.uint64((1 << 63) - 1)
                    rest = body // np.uint64(buckets)
                    high = ((rest >> np.uint64(32)) & np.uint64(0x7F)).astype(np.uint8) | odd << np.uint8(7)
                    columns = [np.concatenate(ids), (rest & np.uint64(0xFFFFFFFF)).astype(np.uint32), high]
                    yield deal((body % np.uint64(buckets)).astype(np.int64), columns)

    def meet(key, rows):
        ids, low, high = gather(rows.column("blob").to_pylist(), [np.int64, np.uint32, np.uint8])
        h = high.astype(np.int64) << 32 | low
        order = np.lexsort((ids, h))
        h, ids = h[order], ids[order]
        fresh_row = np.ones(len(h), bool)
        fresh_row[1:] = (h[1:] != h[:-1]) | (ids[1:] != ids[:-1])
        h, ids = h[fresh_row], ids[fresh_row]
        twin = np.zeros(len(h), bool)
        twin[1:] = h[1:] == h[:-1]
        twin[:-1] |= twin[1:]
        bucket = key[0].as_py()
        columns = [pa.array(h[twin] * buckets + bucket, pa.int64()), pa.array(h[twin] >> 39 == 1, pa.bool_()), pa.array(ids[twin], pa.int64())]
        return pa.table(columns, ["fragment", "odd", "id"])

    return docs.mapInArrow(send, "bucket int, blob binary").groupBy("bucket").applyInArrow(meet, "fragment long, odd boolean, id long")


def coarse_fragments(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """(id, f, n, part): the sets of ``texts`` (text, id), cut into a few fragments."""

    @tidy
    def cut(batches):
        edges = (np.arange(1, FRAGMENTS, dtype=np.uint64) << np.uint64(32)) // np.uint64(FRAGMENTS) << np.uint64(32)
        for batch in batches:
            for part in by_bytes(batch, "text"):
                out = []
                for text, key in zip(part.column("text").to_pylist(), part.column("id").to_pylist()):
                    s = shingles(text, words)
                    if set_key(s)[0] == key:
                        out += [(key, f, len(s), x.astype(np.int64)) for f, x in enumerate(np.split(s, np.searchsorted(s, edges)))]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["id", "f", "n", "part"])

    return texts.mapInArrow(cut, "id long, f int, n long, part array<long>")


def shared_shingles(parts: DataFrame, buckets: int) -> DataFrame:
    """(id, shared, met): how many shingles of each set at least one other set of ``parts``
    has, and the sum of its overlaps with all sets. Buckets of shingles send their counts on
    as packed rows, a bucket of ids each."""

    @tidy
    def send(batches):
        for batch in batches:
            column = batch.column("part")
            h = column.flatten().to_numpy(zero_copy_only=False).astype(np.uint64)
            ids = np.repeat(batch.column("id").to_numpy(), np.diff(column.offsets.to_numpy()))
            if len(h):
                yield deal((h % np.uint64(buckets)).astype(np.int64), [ids, h // np.uint64(buckets)])

    def meet(key, rows):
        ids, h = gather(rows.column("blob").to_pylist(), [np.int64, np.uint64])
        order = np.lexsort((ids, h))
        h, ids = h[order], ids[order]
        fresh_row = np.ones(len(h), bool)
        fresh_row[1:] = (h[1:] != h[:-1]) | (ids[1:] != ids[:-1])
        h, ids = h[fresh_row], ids[fresh_row]
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        head = np.flatnonzero(first)
        last = np.append(head[1:], len(h)) - 1
        times = np.repeat(last - head + 1, last - head + 1)
        who, place = np.unique(ids[times > 1], return_inverse=True)
        shared = np.bincount(place, minlength=len(who))
        met = np.bincount(place, times[times > 1], minlength=len(who))
        return pa.Table.from_batches([deal((mix(who) % np.uint64(buckets)).astype(np.int64), [who, shared.astype(np.int64), met.astype(np.int64)])])

    def add(key, rows):
        who, shared, met = gather(rows.column("blob").to_pylist(), [np.int64] * 3)
        ids, place = np.unique(who, return_inverse=True)
        sums = [np.bincount(place, c, minlength=len(ids)).astype(np.int64) for c in (shared, met)]
        return pa.table([pa.array(c, pa.int64()) for c in (ids, *sums)], ["id", "shared", "met"])

    packed = "bucket int, blob binary"
    met = parts.select("id", "part").mapInArrow(send, packed).groupBy("bucket").applyInArrow(meet, packed)
    return met.groupBy("bucket").applyInArrow(add, "id long, shared long, met long")


def count_overlaps(parts: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that are similar enough: overlaps per coarse fragment, summed. A set
    that was read from several rows counts once."""
    side = lambda x: parts.select(F.col("id").alias(x), "f", F.col("n").alias(f"n{x}"), F.col("part").alias(f"p{x}"))
    met = pairs.select("a", "b").join(side("a"), "a").join(side("b"), ["b", "f"])
    partial = met.select("a", "b", "f", "na", "nb", F.size(F.array_intersect("pa", "pb")).cast("long").alias("overlap"))
    by_part = [F.coalesce(F.max(F.when(F.col("f") == f, F.col("overlap"))), F.lit(0)) for f in range(FRAGMENTS)]
    total = partial.groupBy("a", "b").agg(F.min("na").alias("na"), F.min("nb").alias("nb"), sum(by_part[1:], by_part[0]).alias("overlap"))
    return total.where(den * F.col("overlap") >= num * (F.col("na") + F.col("nb") - F.col("overlap"))).select("a", "b")


def linked_sets(docs: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """For (doc_id, text): the size and key of each row's set, (doc_id, n, k1, k2, …), and the
    group of each class, (n, k1, k2, component), component being its smallest id."""
    size = stage(sets(docs, num, den), "ngram-sets")
    some = size.where("n > 0 AND doc_id IS NOT NULL")
    classes = some.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep"), F.min("need_even").alias("need_even"), F.min("need_odd").alias("need_odd"))
    classes = stage(classes.withColumnRenamed("k1", "id"), "ngram-classes")
    buckets = max(shuffle_parts(docs.sparkSession), (classes.agg(F.sum("n")).first()[0] or 0) // BUCKET_RECORDS + 1)

    lists = stage(shared_fragments(docs, buckets, num, den), "ngram-lists")
    sizes = classes.select("id", "n", "need_even", "need_odd")
    counts = lists.groupBy("id").agg(F.count_if("odd").alias("n_odd"), F.count_if(~F.col("odd")).alias("n_even"))
    able = counts.join(classes, "id").where("n_odd >= need_odd OR n_even >= need_even").select("rep", "id")
    able = stage(able, "ngram-able")
    texts = likely_among(docs, "doc_id", able.select("rep")).join(able, F.col("doc_id") == F.col("rep")).select("text", "id")
    parts = stage(coarse_fragments(texts), "ngram-fragments")
    near = shared_shingles(parts, buckets).join(sizes.select("id", "n"), "id").where(den * F.col("shared") >= num * F.col("n"))
    near = stage(near.select("id", "n", "shared", (-F.col("met") / F.col("n")).alias("apart")), "ngram-near")
    lists = stage(lists.join(near, "id"), "ngram-open")
    center = lists.groupBy("fragment").agg(F.min(F.struct("apart", "id"))["id"].alias("a"))
    stars = lists.join(center, "fragment").where("id != a").select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b"), "odd")
    stars = stage(_sharing_enough(stars, sizes, num, den), "ngram-stars")
    links = stage(count_overlaps(parts, stars, num, den), "ngram-links")
    groups = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))

    placed = lists.join(groups.withColumnRenamed("node", "id"), "id", "left").select("fragment", "odd", "id", "n", "shared", F.coalesce("component", "id").alias("group"))
    placed = stage(placed, "ngram-placed")
    mixed = placed.groupBy("fragment").agg(F.min("group").alias("g1"), F.max("group").alias("g2")).where("g1 < g2").select("fragment")
    small, large = split_by_size(placed.join(mixed, "fragment", "left_semi"), "fragment", SMALL_LIST)
    left, right = (small.select("fragment", "odd", F.col("id").alias(i), F.col("group").alias(f"g{i}"), F.col("n").alias(f"n{i}"), F.col("shared").alias(f"s{i}")) for i in "ab")
    most = F.least("sa", "sb")  # no overlap is larger
    apart = (F.col("a") < F.col("b")) & (F.col("ga") != F.col("gb")) & (den * most >= num * (F.col("na") + F.col("nb") - most))
    more = left.join(right, ["fragment", "odd"]).where(apart).select("a", "b", "odd")
    more = stage(_sharing_enough(more, sizes, num, den).join(stars, ["a", "b"], "left_anti"), "ngram-pairs")
    links = links.unionByName(count_overlaps(parts, more, num, den)).unionByName(large_list_links(large, "fragment", parts, buckets, num, den))
    groups = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))

    joined = classes.join(groups, classes["id"] == groups["node"], "left").select("n", "k2", "rep", "id", F.coalesce("component", "id").alias("group"))
    named = with_least(joined, ["group"], F.col("rep"), "component").select("n", F.col("id").alias("k1"), "k2", "component")
    return size, named


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """One row per row of ``df``: (doc_id, n_shingles, component_id)."""
    num, den = similarity
    docs = two_columns(df, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    size, named = linked_sets(docs, num, den)
    placed = by_class(size, named)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return placed.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def by_class(size: DataFrame, named: DataFrame) -> DataFrame:
    """The rows of ``size`` with the component of their class. A class of any number of rows
    is read in as many parts as there are salts among its rows."""
    keys = ["n", "k1", "k2"]
    salted = size.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(shuffle_parts(size.sparkSession))))
    parts = salted.where("n > 0 AND doc_id IS NOT NULL").select(*keys, "salt").distinct()
    spread = parts.join(named, keys)
    return salted.join(spread, [*keys, "salt"], "left")


def _sharing_enough(shared: DataFrame, sizes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs of ``shared`` (a row per fragment) whose sizes and whose number of shared
    fragments allow the similarity."""
    pairs = shared.groupBy("a", "b").agg(F.count_if("odd").alias("odd"), F.count_if(~F.col("odd")).alias("even"))
    for side in "ab":
        pairs = pairs.join(sizes.select(F.col("id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("n", "need_odd", "need_even")]), side)
    fits = den * F.least("n_a", "n_b") >= num * F.greatest("n_a", "n_b")
    enough = (F.col("odd") >= F.greatest("need_odd_a", "need_odd_b")) | (F.col("even") >= F.greatest("need_even_a", "need_even_b"))
    return pairs.where(fits & enough).select("a", "b").distinct()


@F.pandas_udf(LongType())
def _class_key(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: set_key(shingles(t))[0])


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """The rows of ``df``, all columns, that are the smallest of their group. Rows whose id
    is null, or whose text has no words, stay. Of rows that repeat an id each is judged by
    its own text."""
    num, den = similarity
    docs = two_columns(df, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = by_class(*linked_sets(docs, num, den)).select("doc_id", "k1", F.coalesce(F.col("component") != F.col("doc_id"), F.lit(False)).alias("goes"))
    name, key = fresh(df, "similar_to_smaller"), fresh(df, "class_key")
    rows = stage(rows.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(name), F.col("k1").alias(key)).agg(F.max("goes").alias("goes")), "ngram-kept")
    ids = rows.groupBy(name).agg(F.max("goes").alias("some"), F.min("goes").alias("all")).where("some")
    same_id = F.col(id_col) == F.col(name)
    whole = df.join(ids.select(name), same_id, "left_anti")
    split = ids.where("NOT all").select(name)  # ids with texts of both kinds
    some = df.join(split, same_id, "left_semi").withColumn(key, _class_key(F.coalesce(F.col(text_col), F.lit(""))))
    gone = rows.join(split, name).where("goes").select(name, F.col(key).alias(key + "_"))
    some = some.join(gone, same_id & (F.col(key) == F.col(key + "_")), "left_anti").drop(key)
    return whole.unionByName(some)


def op9_ngram_join(spark, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"))


SHINGLE_GROUPS_SQL = """
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + {words} - 1], ' ') AS shingle
  FROM words, unnest(range(1, greatest(len(w) - {words} + 1, 1) + 1)) AS t(i) WHERE len(w) > 0
), sizes AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id != b.doc_id
    JOIN sizes na ON na.doc_id = a.doc_id JOIN sizes nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(na.n) + any_value(nb.n) - count(*))
), reached AS (
  SELECT doc_id, doc_id AS node FROM sizes
  UNION
  SELECT doc_id, b FROM reached JOIN links ON node = a
), least AS (
  SELECT doc_id, min(node) AS component_id FROM reached GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id{more}
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""
OP9_SQL = SHINGLE_GROUPS_SQL.format(words=WORDS, more="")
