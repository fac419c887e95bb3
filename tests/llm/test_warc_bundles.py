import base64
import hashlib

import pytest
from eddyline.llm import warc_bundles as w


def brute(rows, least=0):
    first = {}
    for page, html in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        first.setdefault((html or "").encode(), page)
    out = []
    for page, html in rows:
        raw = (html or "").encode()
        again = len(raw) >= least and first[raw] is not None and first[raw] != page
        out.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first[raw] if again else None))
    return sorted(out, key=str)


def got(records):
    return sorted((tuple(r) for r in records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_pages(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "html").collect()]
    assert got(w.op8_warc_bundles(spark, folder)) == brute(rows)


@pytest.mark.parametrize("least", [0, 5])
def test_odd_rows_small_frames_and_seeks(spark, least):
    rows = [(i, f"http://x/{i}\r\nWARC-Type: evil", ["<p>é\r\n\r\nWARC/1.1\r\n</p>", "", None, "abc", "z" * 5000][i % 5] + ("" if i % 3 or i % 5 == 2 else str(i)) if i % 5 != 2 else None) for i in range(90)]
    rows += [rows[0], (None, None, "abc")]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, digest string, bundle int").repartition(3)
    index = w.write(pages, min_bytes=least, frame_bytes=900, bundle_bytes=300)
    entries = index.collect()
    assert len({e["bundle"] for e in entries}) > 3 and max(e["frame"] for e in entries) > 0
    assert got(w.read(index)) == brute([(r[0], r[2]) for r in rows], least)
    for e in entries[:20]:
        head, block = w.read_record(e["bundle"], e["frame_at"], e["frame_size"], e["at"])
        assert head["WARC-Record-ID"] == f"<{e['record_id']}>" and head["WARC-Type"] in ("response", "revisit")
        assert "\n" not in head["WARC-Target-URI"]


def test_a_row_without_an_id_refers_to_the_known_one(spark):
    rows = [(1, "same"), (1, "same"), (None, "same"), (None, "only here"), (None, "only here"), (2, "other"), (3, "other"), (None, "other")]
    index = w.write(spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string"))
    assert got(w.read(index)) == brute(rows)


def test_bundles_are_read_by_many_tasks_and_long_payloads_are_whole(spark):
    rows = [(i, "y" * (3 << 20) + str(i % 4)) for i in range(8)] + [(i, "popular") for i in range(10, 300)]
    pages = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string").repartition(8)
    index = w.write(pages, bundle_bytes=64)
    records = w.read(index)
    assert records.rdd.getNumPartitions() == index.select("bundle").distinct().count() > 4
    assert got(records) == brute(rows)


def test_no_pages(spark):
    index = w.write(spark.createDataFrame([], "page_id long, url string, html string"))
    assert index.count() == 0 and w.read(index).count() == 0


def test_a_damaged_footer_is_noticed():
    bundle = w.Bundle()
    bundle.add(w.record("urn:page:1", "u", b"x", None))
    with pytest.raises(ValueError):
        w.seek_table(bundle.finish()[:-1] + b"\0")
