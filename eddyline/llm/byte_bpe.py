"""Byte-level BPE encoding and decoding with the ``tokenizers`` library.

A text is cut into pieces by the pre-tokeniser pattern. The distinct pieces of an
Arrow batch are encoded once by the library (each piece on its own, no special
tokens) and the ids are laid out again in text order; a bounded memo carries the
pieces of former batches. Tokens are strings over a byte alphabet, so decoding maps
each character back to its byte, and characters that are split between tokens come
together again when the bytes are joined.

Defined cases: a null text is empty and has no token; every row is encoded, repeated
rows and repeated ids too; a text of any length is cut at places where the pattern
has a boundary in any case, so memory follows the cut, not the text.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from eddyline.llm.common import by_bytes, id_type, leave_no_memory, table, two_columns

MODEL = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN
MEMO_BYTES = 64 << 20
PIECE_BYTES = 160  # of an entry, besides its characters
PART_BYTES = 512 << 10
CUT_CHARS = 1 << 20
_SAFE_CUT = regex.compile(r"(?<=\p{L}) (?=\p{L})")


def byte_alphabet() -> dict[str, int]:
    """Character -> byte: printable Latin-1 stands for itself, the others follow from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def cuts(text: str, limit: int = CUT_CHARS) -> Iterator[str]:
    """The text in runs of about ``limit`` characters. A run ends after a letter that a
    single space and another letter follow, where no match of the pattern goes on."""
    start = 0
    while len(text) - start > limit:
        found = _SAFE_CUT.search(text, start + limit)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:] if start else text


class ByteBpe:
    """One tokeniser with its byte table; kept per Python worker by ``load``."""

    def __init__(self, model: str, pattern: str):
        self.tokenizer = Tokenizer.from_file(model)
        self.tokenizer.encode_special_tokens = True
        # pieces come cut by the pattern: no second search inside them
        self.tokenizer.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
        self.pattern = regex.compile(pattern)
        alphabet = byte_alphabet()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.bytes_of = [b""] * size
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            if all(c in alphabet for c in token):
                self.bytes_of[i] = bytes(alphabet[c] for c in token)
        self.widths = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.held = 0
        self.start, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self, pieces: set[str]) -> None:
        """Pieces and their ids, all ids in one array. The memo is emptied where it is full."""
        new = [p for p in pieces if p not in self.number]
        need = sum(map(len, new)) + PIECE_BYTES * len(new)
        if self.held + need > MEMO_BYTES and self.number:
            self._clear()
            new = list(pieces)
            need = sum(map(len, new)) + PIECE_BYTES * len(new)
        self.held += need
        for a in range(0, len(new), 4_000):
            part = new[a : a + 4_000]
            codes = [code.ids for code in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            size = np.fromiter(map(len, codes), np.int64, len(codes))
            self.number.update(zip(part, range(len(self.number), len(self.number) + len(part))))
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(codes), np.uint32, int(size.sum()))])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        split = [self.pattern.findall(t) for t in texts]
        self._learn(set(chain.from_iterable(split)))
        pieces = np.fromiter(map(self.number.__getitem__, chain.from_iterable(split)), np.int64, sum(map(len, split)))
        size = self.size[pieces]
        ends = np.cumsum(size)
        flat = self.ids[np.repeat(self.start[pieces] - (ends - size), size) + np.arange(int(size.sum()))]
        edges = np.concatenate([np.zeros(1, np.int64), ends])[np.cumsum([0, *map(len, split)])]
        return [flat[a:b] for a, b in zip(edges[:-1], edges[1:])]

    def encode_text(self, text: str) -> np.ndarray:
        """Like ``encode`` for one text of any length."""
        return np.concatenate([self.encode([part])[0] for part in cuts(text)])

    def decode(self, ids) -> bytes:
        """Bytes of the ids. Not every slice of a token list is whole characters."""
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def offsets(self, text: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per token: end byte, first character, end character. A token that holds a
        part of a character counts that character, so two tokens can share one."""
        ends = np.cumsum(self.widths[ids])
        starts = ends - self.widths[ids]
        head = (np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80
        seen = np.cumsum(head)
        if not len(ids):
            return ends, ends, ends
        return ends, seen[starts] - 1, seen[ends - 1]


    @contextmanager
    def task(self):
        """Memory for the pieces of one task; an idle worker keeps the model alone."""
        try:
            yield self
        finally:
            self._clear()
            leave_no_memory()


@lru_cache(maxsize=2)
def load(model: str, pattern: str) -> ByteBpe:
    # Spark's tasks are the parallelism; threads of their own would each keep a heap
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ByteBpe(model, pattern)


def _encoded(batches: Iterator[pa.RecordBatch], bpe: ByteBpe) -> Iterator[tuple[pa.RecordBatch, list[str], list[np.ndarray]]]:
    for part in (p for batch in batches for p in by_bytes(batch, "text", PART_BYTES)):
        texts = part.column("text").to_pylist()
        if max(map(len, texts)) > CUT_CHARS:
            yield part, texts, [bpe.encode_text(t) for t in texts]
        else:
            yield part, texts, bpe.encode(texts)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, pattern: str = PATTERN) -> DataFrame:
    """One row per text: (doc_id, ids, byte_end, char_start, char_end), arrays by token."""

    def run(batches):
        with load(model, pattern).task() as bpe:
            for part, texts, ids in _encoded(batches, bpe):
                spans = [bpe.offsets(t.encode(), i) for t, i in zip(texts, ids)]
                columns = [part.column("doc_id"), pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32()))]
                columns += [pa.array([s[k].astype(np.int32) for s in spans], pa.list_(pa.int32())) for k in range(3)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "byte_end", "char_start", "char_end"])

    schema = f"doc_id {id_type(df, id_col)}, ids array<int>, byte_end array<int>, char_start array<int>, char_end array<int>"
    return two_columns(df, id_col, text_col).mapInArrow(run, schema)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL, pattern: str = PATTERN) -> DataFrame:
    """One row per id list: (doc_id, bytes, text). ``text`` replaces bytes that are no
    whole character, as a list cut in the middle of one has them; a null list is empty."""

    def run(batches):
        bpe = load(model, pattern)
        for batch in batches:
            raw = [bpe.decode(ids or ()) for ids in batch.column("ids").to_pylist()]
            texts = [r.decode("utf-8", "replace") for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary()), pa.array(texts, pa.string())], ["doc_id", "bytes", "text"])

    narrow = df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return narrow.mapInArrow(run, f"doc_id {id_type(df, id_col)}, bytes binary, text string")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, pattern: str = PATTERN) -> DataFrame:
    """Encode and decode in one pass; counts and digests instead of the arrays:
    (doc_id, n_tokens, n_bytes, ids_sha256, decoded_sha256)."""

    def run(batches):
        with load(model, pattern).task() as bpe:
            for part, texts, ids in _encoded(batches, bpe):
                decoded = [bpe.decode(i.tolist()) for i in ids]
                columns = [
                    part.column("doc_id"),
                    pa.array([len(i) for i in ids], pa.int64()),
                    pa.array([len(d) for d in decoded], pa.int64()),
                    pa.array([hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids], pa.string()),
                    pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_bytes", "ids_sha256", "decoded_sha256"])

    schema = f"doc_id {id_type(df, id_col)}, n_tokens long, n_bytes long, ids_sha256 string, decoded_sha256 string"
    return two_columns(df, id_col, text_col).mapInArrow(run, schema)


def op6_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
