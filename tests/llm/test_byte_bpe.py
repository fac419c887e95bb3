import base64
import hashlib

import numpy as np
import public_tokenizers
import tiktoken
from eddyline.llm import byte_bpe as b
from hypothesis import given, settings
from hypothesis import strategies as st


def library():
    lines = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb")
    ranks = {base64.b64decode(a): int(r) for a, r in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


TIKTOKEN = library()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    bpe = b.load(b.MODEL, b.PATTERN)
    ids = bpe.encode([text])[0].tolist()
    assert ids == TIKTOKEN.encode_ordinary(text) and bpe.decode(ids) == text.encode()


def test_every_piece_of_the_documents(spark):
    bpe = b.load(b.MODEL, b.PATTERN)
    for (text,) in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        assert bpe.encode([text])[0].tolist() == TIKTOKEN.encode_ordinary(text)


def test_query(spark, documents):
    got = {r["doc_id"]: r for r in b.op6_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    for doc_id, text in documents.select("doc_id", "text").collect():
        ids = TIKTOKEN.encode_ordinary(text or "")
        row = got.pop(doc_id)
        assert row["n_tokens"] == len(ids) and row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert not got


def test_round_trip_offsets_and_odd_rows(spark, frame, empty):
    df = frame("naïve 😀😀 <|endoftext|> 漢字", "  spaces \n\n ", "word " * 400_000)
    coded = b.encode(df)
    assert coded.count() == df.count() and b.encode(empty).count() == 0
    back = b.decode(coded).join(df.select("doc_id", "text").withColumnRenamed("text", "want").distinct(), "doc_id")
    assert all(r["text"] == (r["want"] or "") for r in back.collect())
    row = coded.where("doc_id = 0").first()
    text = df.where("doc_id = 0").first()["text"]
    ends = [0, *row["byte_end"]]
    pieces = [text.encode()[a:z] for a, z in zip(ends, ends[1:])]
    assert pieces == [TIKTOKEN.decode_single_token_bytes(i) for i in row["ids"]]
    for piece, a, z in zip(pieces, row["char_start"], row["char_end"]):
        assert piece in text[a:z].encode() and len(text[a:z].encode()) - len(piece) < 4


def test_split_characters_come_together(spark):
    ids = TIKTOKEN.encode_ordinary("漢😀")
    bpe = b.load(b.MODEL, b.PATTERN)
    assert len(ids) > 2 and b"".join(bpe.decode([i]) for i in ids).decode() == "漢😀"
    part = b.decode(spark.createDataFrame([(1, ids[:1]), (2, None)], "doc_id long, ids array<int>"))
    assert {r["doc_id"]: r["text"] for r in part.collect()} == {1: "�", 2: ""}


def test_cuts_do_not_change_the_ids():
    text = "it's a test of  cuts, don't 12 fail\n" * 200
    whole = b.load(b.MODEL, b.PATTERN)
    parts = [p for p in b.cuts(text, 37)]
    assert "".join(parts) == text and len(parts) > 20
    assert np.concatenate(whole.encode(parts)).tolist() == TIKTOKEN.encode_ordinary(text)
