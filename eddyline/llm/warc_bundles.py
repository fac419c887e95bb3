"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames; a bundle ends with a seek table (a
skippable frame that holds the sizes of all frames, and a nine byte footer). The index
maps a record identifier to its bundle, frame and place inside the frame, so one record
is read by decompressing one frame.

Of records with equal payloads (at least ``min_bytes`` long) the one with the smallest
id is a response and the others are revisits that name it; a revisit has headers only.

Tasks write bundles of bounded size under ``spark.checkpoint.dir``, named by attempt, so
a retried task never meets a half-written file: readers follow the index, which lists
the files of the attempts that succeeded.

Defined cases: a null html is an empty payload; null urls give an empty target; rows
with the same id and payload are all responses if they hold the smallest id; a null id
is never smallest unless all ids of a group are null. Empty tables give no bundle.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddyline.llm.common import bound_batches, by_bytes, shuffle_parts, table
from eddyline.session import shared_dir, stage

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 64 << 20
LEVEL = 3
# Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1

INDEX = "record_id string, page_id long, bundle string, frame int, frame_at long, frame_size long, at long, size long"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(record_id: str, target: str, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC/1.1 record. The block of a response is an HTTP reply around the payload."""
    head = {
        "WARC-Type": "revisit" if refers_to else "response",
        "WARC-Record-ID": f"<{record_id}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": target.replace("\r", "").replace("\n", ""),
        "WARC-Payload-Digest": f"sha1:{digest_of(payload)}",
        "Content-Type": "application/http; msgtype=response",
    }
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to:
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        head["WARC-Refers-To"] = f"<{refers_to}>"
    block = http if refers_to else http + payload
    head["Content-Length"] = str(len(block))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record that starts at ``at``."""
    end = raw.index(b"\r\n\r\n", at)
    version, *lines = raw[at:end].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record at {at}")
    head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    start = end + 4
    stop = start + int(head["Content-Length"])
    return head, raw[start:stop], stop + 4


class Bundle:
    """Collects records into frames, and frames into one file with its seek table."""

    def __init__(self, frame_bytes: int = FRAME_BYTES):
        self.frame_bytes = frame_bytes
        self.packer = zstandard.ZstdCompressor(level=LEVEL)
        self.body, self.frames, self.open = bytearray(), [], bytearray()
        self.places: list[tuple[int, int, int]] = []

    def add(self, raw: bytes) -> None:
        self.places.append((len(self.frames), len(self.open), len(raw)))
        self.open += raw
        if len(self.open) >= self.frame_bytes:
            self.close_frame()

    def close_frame(self) -> None:
        if self.open:
            packed = self.packer.compress(bytes(self.open))
            self.frames.append((len(self.body), len(packed), len(self.open)))
            self.body += packed
            self.open = bytearray()

    def finish(self) -> bytes:
        self.close_frame()
        entries = b"".join(struct.pack("<II", packed, plain) for _, packed, plain in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEK_MAGIC)
        return bytes(self.body) + struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer


def seek_table(tail: bytes) -> list[tuple[int, int, int]]:
    """(offset, packed size, plain size) of every frame, from the last bytes of a bundle."""
    count, _, magic = struct.unpack("<IBI", tail[-9:])
    if magic != SEEK_MAGIC:
        raise ValueError("no seek table")
    sizes = struct.iter_unpack("<II", tail[-9 - 8 * count : -9])
    frames, at = [], 0
    for packed, plain in sizes:
        frames.append((at, packed, plain))
        at += packed
    return frames


def read_frames(uri: str) -> Iterator[tuple[int, bytes]]:
    """Number and plain bytes of each frame of a bundle, one at a time."""
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as file:
        size = file.size()
        count = struct.unpack("<I", file.read_at(4, size - 9))[0]
        for number, (at, packed, plain) in enumerate(seek_table(file.read_at(9 + 8 * count, size - 9 - 8 * count))):
            yield number, zstandard.ZstdDecompressor().decompress(file.read_at(packed, at), max_output_size=plain)


def read_record(uri: str, frame_at: int, frame_size: int, at: int) -> tuple[dict[str, str], bytes]:
    """One record by its index entry: one seek, one frame."""
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as file:
        raw = zstandard.ZstdDecompressor().decompressobj().decompress(file.read_at(frame_size, frame_at))
    head, block, _ = parse(raw, at)
    return head, block


def revisits(rows: DataFrame, min_bytes: int) -> DataFrame:
    """(digest, salt, first_id) of the payloads of ``rows`` (page_id, digest, salt, n) that
    come again under another id or without one. A payload has a row per salt, so that the
    pages of a popular one meet it in many tasks."""
    some = rows.where(F.col("n") >= min_bytes).groupBy("digest", "salt").agg(F.min("page_id").alias("low"), F.max("page_id").alias("high"), F.count_if(F.col("page_id").isNull()).alias("unnamed"))
    groups = some.groupBy("digest").agg(F.min("low").alias("first_id"), F.max("high").alias("last_id"), F.sum("unnamed").alias("unnamed"))
    groups = groups.where("first_id < last_id OR unnamed > 0 AND first_id IS NOT NULL").select("digest", "first_id")
    return some.select("digest", "salt").join(groups, "digest")


def uri_of(folder: str) -> str:
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write all pages; returns the index, one row per record (columns of ``INDEX``)."""
    spark = pages.sparkSession
    bound_batches(spark)
    folder = uri_of(f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    page_id = F.col(id_col).cast("long").alias("page_id")
    salt = F.pmod(F.xxhash64(F.col(id_col), F.col(url_col)), F.lit(shuffle_parts(spark))).alias("salt")
    rows = pages.select(page_id, F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"), salt)
    first = stage(revisits(rows.select("page_id", "digest", "salt", F.length("payload").alias("n")), min_bytes), "warc-first")
    known = rows.join(first, ["digest", "salt"], "left").select("page_id", "url", "payload", F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("first_id")), F.col("first_id")).alias("refers_to"))

    def run(batches):
        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        task = TaskContext.get()
        stem, number, bundle, ids = f"part-{task.partitionId():05d}-{uuid.uuid4().hex}", 0, Bundle(frame_bytes), []

        def close():
            data = bundle.finish()
            name = f"{stem}-{number:04d}.warc.zst"
            with fs.open_output_stream(f"{path}/{name}", compression=None) as out:
                out.write(data)
            frames = bundle.frames
            rows = [(r, p, f"{folder}/{name}", f, frames[f][0], frames[f][1], at, n) for (r, p), (f, at, n) in zip(ids, bundle.places)]
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), *[pa.int64()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in INDEX.split(", ")])

        for batch in batches:
            for part in by_bytes(batch, "payload"):
                for page, url, raw, ref in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to"))):
                    name = f"urn:page:{page}"
                    bundle.add(record(name, url, raw, None if ref is None else f"urn:page:{ref}"))
                    ids.append((name, page))
                    if len(bundle.body) >= bundle_bytes:
                        yield close()
                        number, bundle, ids = number + 1, Bundle(frame_bytes), []
        if ids:
            yield close()

    return stage(known.mapInArrow(run, INDEX), "warc-index")


def read(index: DataFrame) -> DataFrame:
    """All records of the bundles an index names: (record_id, page_id, record_type,
    payload, payload_bytes, payload_digest, refers_to). ``payload`` of a revisit is null.
    The digest of a response is taken anew and held against its header. A task reads about
    one bundle: the number of tasks is that of the bundles."""
    bundles = index.select("bundle").distinct()
    bundles = bundles.repartition(max(1, bundles.count()), "bundle")

    def run(batches):
        for batch in batches:
            for uri in batch.column("bundle").to_pylist():
                for _, raw in read_frames(uri):
                    out, at = [], 0
                    while at < len(raw):
                        head, block, at = parse(raw, at)
                        named = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        page = head["WARC-Record-ID"].strip("<>").removeprefix("urn:page:")
                        http, _, body = block.partition(b"\r\n\r\n")
                        refers = head.get("WARC-Refers-To", "").strip("<>").removeprefix("urn:page:")
                        if head["WARC-Type"] == "response" and digest_of(body) != named:
                            raise ValueError(f"digest of {head['WARC-Record-ID']} differs in {uri}")
                        size = int(http.rpartition(b"Content-Length: ")[2])
                        payload = body if head["WARC-Type"] == "response" else None
                        out.append((f"urn:page:{page}", None if page == "None" else int(page), head["WARC-Type"], payload, size, named, int(refers) if refers else None))
                    kinds = [pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
                    names = ["record_id", "page_id", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return bundles.mapInArrow(run, "record_id string, page_id long, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long")


def op8_warc_bundles(spark, sf_dir: str) -> DataFrame:
    records = read(write(table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH given AS (
  SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages
), digests AS (
  SELECT *, unhex(sha1(html))::BIT::VARCHAR AS bits FROM given
)
SELECT page_id, octet_length(encode(html)) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + list_sum(list_transform(range(5), lambda k: substr(bits, 1 + 5 * i + k, 1)::INTEGER * (16 >> k::INTEGER)))::INTEGER, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM digests
"""
