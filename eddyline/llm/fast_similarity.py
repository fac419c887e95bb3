"""Near-duplicate groups by fast similarity sketches, banding and exact verification.

A text is the set of its four-word shingles. Its sketch has ``COORDINATES`` coordinates,
filled in rounds: round i throws every shingle into a bin, and a bin keeps the smallest
(round, hash) it has seen. A set is done after the first round that leaves no bin empty.
From round ``COORDINATES`` on, round i throws all shingles into bin i - ``COORDINATES``, so
every coordinate is filled after twice as many rounds at the latest, a set of one shingle
included; a long text needs a round or two. Two sets agree in a coordinate with the
probability of their Jaccard similarity, and the share that agrees is as concentrated as
that of independent draws.

1. Texts with the same set form a class, named by a 64 bit key; classes are compared.
2. Coordinates are kept as 16 bits. ``BAND`` of them in a row are a band, and classes that
   share a band form a list. A pair at the threshold shares none of the 40 bands with
   probability (1 - 0.8^4)^40 < 10^-9.
3. Classes whose shingles are too seldom found in other listed sets cannot have a partner
   and leave.
4. Exact verification on the full sets: first of the pairs with the member of a list that has
   the largest overlaps on the average; these links make components. Then of all pairs of
   list members that are still in different components, if sizes and shared shingles allow
   the similarity: in lists of at most ``SMALL_LIST`` members if the sketches agree in ``LEAST``
   of the coordinates (at the threshold that fails with probability < 10^-9), in larger
   lists in blocks of members (``list_links``).

Defined cases: a null text is empty; a text without words has no shingle, is linked with
nothing and is kept; fewer words than ``WORDS`` make one shingle. Rows are judged by their
text: rows that repeat an id get the component of their own text each. A row with a null id
is in no component (null) and kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eddyline.llm.blobs import deal, gather, mix
from eddyline.llm.common import by_bytes, likely_among, shuffle_parts, table, tidy, two_columns, with_least
from eddyline.llm.components import components
from eddyline.llm.list_links import large_list_links, split_by_size
from eddyline.llm.ngram_join import SHINGLE_GROUPS_SQL, by_class, coarse_fragments, count_overlaps, set_key, shared_shingles, shingles
from eddyline.session import stage

WORDS = 4
SIMILARITY = (80, 100)
COORDINATES = 160
BAND = 4
LEAST = 0.6
BUCKET_RECORDS = 4 << 20
SMALL_LIST = 32
_EMPTY = np.iinfo(np.uint64).max
_SEEDS = np.random.default_rng(12).integers(1, 2**63, 2 * COORDINATES, dtype=np.uint64)


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """The coordinates of each set, (round, 32 bit hash) as one number; all of them
    ``_EMPTY`` for a set without shingles."""
    out = np.full((len(sets), COORDINATES), _EMPTY, np.uint64)
    flat = out.reshape(-1)
    items = np.concatenate([*sets, np.zeros(0, np.uint64)])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for i in range(2 * COORDINATES):
        if not len(items):
            break
        h = mix(items ^ _SEEDS[i])
        place = ((h >> np.uint64(32)) * np.uint64(COORDINATES) >> np.uint64(32)).astype(np.int64) if i < COORDINATES else i - COORDINATES
        np.minimum.at(flat, owner * COORDINATES + place, np.uint64(i) << np.uint64(32) | h & np.uint64(0xFFFFFFFF))
        goes_on = (out == _EMPTY).any(1)[owner]
        items, owner = items[goes_on], owner[goes_on]
    return out


def short_sketch(sets: list[np.ndarray]) -> np.ndarray:
    """16 bits a coordinate."""
    return (mix(sketch(sets)) >> np.uint64(48)).astype(np.uint16)


def sketched(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, k1, k2, sketch): size and key of each text's set, and its sketch."""

    @tidy
    def run(batches):
        for batch in batches:
            for part in by_bytes(batch, "text", 2 << 20):
                found = [shingles(t, words) for t in part.column("text").to_pylist()]
                keys = [set_key(s) for s in found]
                columns = [part.column("doc_id"), pa.array([len(s) for s in found], pa.int64())]
                columns += [pa.array([row[k] for row in keys], pa.int64()) for k in (0, 1)]
                columns.append(pa.array([row.tobytes() for row in short_sketch(found)], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "k1", "k2", "sketch"])

    return docs.mapInArrow(run, "doc_id long, n long, k1 long, k2 long, sketch binary")


def _matrix(column: pa.Array) -> np.ndarray:
    """Sketches as rows of coordinates."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, COORDINATES)


def band_lists(classes: DataFrame, buckets: int) -> DataFrame:
    """(band, place, id): the bands, with their place in the sketch, of more than one class."""
    bands = COORDINATES // BAND
    places = np.arange(bands, dtype=np.uint64)

    @tidy
    def send(batches):
        for batch in batches:
            if batch.num_rows:
                h = mix(mix(_matrix(batch.column("sketch")).view(np.uint64)) + places)
                ids = np.repeat(batch.column("id").to_numpy(), bands)
                rest = (h // np.uint64(buckets) & np.uint64(0xFFFFFFFFFF)).reshape(-1)
                columns = [ids, (rest & np.uint64(0xFFFFFFFF)).astype(np.uint32), (rest >> np.uint64(32)).astype(np.uint8), np.tile(places.astype(np.uint8), batch.num_rows)]
                yield deal((h % np.uint64(buckets)).reshape(-1).astype(np.int64), columns)

    def meet(key, rows):
        ids, low, high, place = gather(rows.column("blob").to_pylist(), [np.int64, np.uint32, np.uint8, np.uint8])
        h = (place.astype(np.int64) << 40 | high.astype(np.int64) << 32 | low)
        order = np.lexsort((ids, h))
        h, ids, place = h[order], ids[order], place[order]
        fresh_row = np.ones(len(h), bool)
        fresh_row[1:] = (h[1:] != h[:-1]) | (ids[1:] != ids[:-1])
        h, ids, place = h[fresh_row], ids[fresh_row], place[fresh_row]
        twin = np.zeros(len(h), bool)
        twin[1:] = h[1:] == h[:-1]
        twin[:-1] |= twin[1:]
        columns = [pa.array(h[twin] * buckets + key[0].as_py(), pa.int64()), pa.array(place[twin].astype(np.int32)), pa.array(ids[twin], pa.int64())]
        return pa.table(columns, ["band", "place", "id"])

    return classes.select("id", "sketch").mapInArrow(send, "bucket int, blob binary").groupBy("bucket").applyInArrow(meet, "band long, place int, id long")


def open_pairs(members: DataFrame, buckets: int, num: int, den: int) -> DataFrame:
    """(a, b): the pairs of ``members`` (band, id, group, n, shared, sketch) of short lists that
    are in one list but in different groups, and may be similar."""
    dealt = members.withColumn("bucket", F.pmod("band", F.lit(buckets)).cast("int"))

    def run(key, rows):
        rows = rows.sort_by([("band", "ascending"), ("id", "ascending")]).combine_chunks()
        band, ids, group, n, shared = (rows.column(c).to_numpy() for c in ("band", "id", "group", "n", "shared"))
        sketches = _matrix(rows.column("sketch"))
        edges = [0, *(np.flatnonzero(np.diff(band)) + 1).tolist(), len(band)]
        found = [(np.zeros(0, np.int64),) * 2]
        for x, y in zip(edges, edges[1:]):
            i, j = np.triu_indices(y - x, 1)
            i, j = i + x, j + x
            most = np.minimum(shared[i], shared[j])
            able = (group[i] != group[j]) & (den * most >= num * (n[i] + n[j] - most))
            i, j = i[able], j[able]
            close = np.count_nonzero(sketches[i] == sketches[j], axis=1) >= LEAST * COORDINATES
            found.append((ids[i[close]], ids[j[close]]))
        a, b = (np.concatenate(z) for z in zip(*found))
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return dealt.groupBy("bucket").applyInArrow(run, "a long, b long").distinct()


def linked_sets(docs: DataFrame, words: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """For (doc_id, text): (doc_id, n, k1, k2) of each row, and (n, k1, k2, component) of each
    class, component being the smallest id of its group."""
    size = stage(sketched(docs, words), "similarity-sets")
    named = size.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("doc_id"))
    classes = size.join(named, ["doc_id", "n", "k1", "k2"]).dropDuplicates(["doc_id", "n", "k1", "k2"])
    classes = stage(classes.select(F.col("doc_id").alias("rep"), "n", F.col("k1").alias("id"), "k2", "sketch"), "similarity-classes")
    total, shingle_sum = classes.agg(F.count("*"), F.sum("n")).first()
    parts_set = shuffle_parts(docs.sparkSession)
    by_bands = max(parts_set, total * (COORDINATES // BAND) // BUCKET_RECORDS + 1)
    lists = stage(band_lists(classes, by_bands), "similarity-lists")

    able = stage(classes.join(lists.select("id").distinct(), "id").select("rep", "id"), "similarity-able")
    texts = likely_among(docs, "doc_id", able.select("rep")).join(able, F.col("doc_id") == F.col("rep")).select("text", "id")
    parts = stage(coarse_fragments(texts, words), "similarity-fragments")
    near = shared_shingles(parts, max(parts_set, (shingle_sum or 0) // BUCKET_RECORDS + 1))
    near = near.join(classes.select("id", "n"), "id").where(den * F.col("shared") >= num * F.col("n"))
    near = stage(near.select("id", "n", "shared", (-F.col("met") / F.col("n")).alias("apart")), "similarity-near")
    lists = stage(lists.join(near, "id"), "similarity-open")
    center = lists.groupBy("band").agg(F.min(F.struct("apart", "id", "n", "shared")).alias("best"))
    most = F.least("shared", "best.shared")  # no overlap is larger
    stars = lists.join(center, "band").where((F.col("id") != F.col("best.id")) & (den * most >= num * (F.col("n") + F.col("best.n") - most)))
    stars = stage(stars.select(F.least("id", "best.id").alias("a"), F.greatest("id", "best.id").alias("b")).distinct(), "similarity-stars")
    links = stage(count_overlaps(parts, stars, num, den), "similarity-links")
    groups = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))

    placed = lists.join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("group", F.coalesce("component", "id"))
    placed = stage(placed.select("band", "place", "id", "n", "shared", "group"), "similarity-placed")
    mixed = placed.groupBy("band").agg(F.min("group").alias("g1"), F.max("group").alias("g2")).where("g1 < g2").select("band")
    small, large = split_by_size(placed.join(mixed, "band", "left_semi"), "band", SMALL_LIST)
    more = open_pairs(small.join(classes.select("id", "sketch"), "id"), parts_set, num, den).join(stars, ["a", "b"], "left_anti")
    links = links.unionByName(count_overlaps(parts, stage(more, "similarity-pairs"), num, den))
    links = links.unionByName(large_list_links(large, "band", parts, parts_set, num, den))
    groups = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))

    joined = classes.drop("sketch").join(groups, classes["id"] == groups["node"], "left").select("n", "k2", "rep", "id", F.coalesce("component", "id").alias("group"))
    return size.drop("sketch"), with_least(joined, ["group"], F.col("rep"), "component").select("n", F.col("id").alias("k1"), "k2", "component")


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """One row per row of ``df``: (doc_id, n_shingles, component_id, kept)."""
    num, den = similarity
    docs = two_columns(df, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = by_class(*linked_sets(docs, words, num, den))
    rows = rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op12_fast_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


OP12_SQL = SHINGLE_GROUPS_SQL.format(words=WORDS, more=", coalesce(component_id, doc_id) = doc_id AS kept")
