"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may be met with up to e = floor(``ERROR_RATE`` * m) edits. It is
split into e + 1 pieces, so any occurrence within the budget holds one piece unchanged.
All pieces are found in one pass over a text (Aho-Corasick); each hit names a window,
overlapping windows of an item are joined, and Myers' bit-parallel distance over the
window decides. Texts and items are compared in lower case with white space collapsed;
the reported spans are code points of the original text.

The benchmark is read in blocks of bounded size (``BLOCK_CHARS`` of item text), each
matched against all rows, so neither the driver nor a task holds a benchmark of any size.

Defined cases: null and blank texts match nothing; null and blank items are skipped;
equal items are all reported; an item shorter than ``MIN_CHARS`` must occur unchanged. Overlapping occurrences of one item are
reported once, with the smallest distance.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddyline.llm.common import bound_batches, by_bytes, id_type, table, two_columns, tidy
from eddyline.session import stage

ERROR_RATE = 0.06
MIN_CHARS = 24
BLOCK_CHARS = 1 << 21
_WORD = re.compile(r"\S+")


def lower(text: str) -> str:
    """Lower case that keeps the number of characters."""
    small = text.lower()
    return small if len(small) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def normal(text: str) -> str:
    return " ".join(lower(text).split())


def places(text: str) -> list[int]:
    """Place in ``text`` of every character of ``normal(text)``."""
    out: list[int] = []
    for m in _WORD.finditer(text):
        if out:
            out.append(m.start() - 1)
        out.extend(range(m.start(), m.end()))
    return out


def budget(length: int, rate: float = ERROR_RATE) -> int:
    return int(rate * length) if length >= MIN_CHARS else 0


def split_pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces of about equal length, with their places."""
    edges = [len(item) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:])]


def myers(pattern: str, text: str) -> list[int]:
    """Smallest distance of the pattern to any part of the text that ends at each place."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    plus, minus, score, out = full, 0, m, []
    for c in text:
        eq = masks.get(c, 0)
        vertical = eq | minus
        carry = (((eq & plus) + plus) ^ plus) | eq
        up = (minus | ~(carry | plus)) & full
        down = plus & carry
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = up << 1 & full
        plus = (down << 1 | ~(vertical | up)) & full
        minus = up & vertical
        out.append(score)
    return out


def occurrences(item: str, text: str, errors: int) -> list[tuple[int, int, int]]:
    """(start, end, distance) of the disjoint best matches of ``item`` in ``text``."""
    found: list[tuple[int, int, int]] = []
    scores = myers(item, text)
    ends = [(s, e + 1) for e, s in enumerate(scores) if s <= errors]
    for score, end in sorted(ends):
        if any(a < end <= b + errors for a, b, _ in found):
            continue
        back = myers(item[::-1], text[max(0, end - len(item) - errors) : end][::-1])
        lengths = [k + 1 for k, s in enumerate(back) if s == score]
        start = end - min(lengths, key=lambda n: (abs(n - len(item)), n)) if lengths else end - len(item)
        if all(start >= b or end <= a for a, b, _ in found):
            found.append((start, end, score))
    return sorted(found)


class Matcher:
    """One block of items as an automaton over their pieces."""

    def __init__(self, items: list[tuple[object, str]], rate: float):
        self.items = [(i, t, budget(len(t), rate)) for i, t in items]
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, errors) in enumerate(self.items):
            for at, piece in split_pieces(text, errors):
                where.setdefault(piece, []).append((n, at))
        self.auto = ahocorasick.Automaton()
        for piece, uses in where.items():
            self.auto.add_word(piece, (len(piece), uses))
        self.auto.make_automaton()

    def search(self, text: str) -> list[tuple[object, int, int, int, int]]:
        """(item id, start, end, distance, budget) in the normal form of a text."""
        starts: dict[int, list[int]] = {}
        for end, (size, uses) in self.auto.iter(text):
            for n, at in uses:
                starts.setdefault(n, []).append(end + 1 - size - at)
        out = []
        for n, hits in starts.items():
            item_id, item, errors = self.items[n]
            hits.sort()
            low = high = hits[0]
            spans = []
            for h in hits[1:]:
                if h > high + len(item) + 2 * errors:
                    spans.append((low, high))
                    low = h
                high = h
            spans.append((low, high))
            for low, high in spans:
                a = max(0, low - errors)
                window = text[a : high + len(item) + errors]
                for start, end, distance in occurrences(item, window, errors):
                    out.append((item_id, a + start, a + end, distance, errors))
        return out


@lru_cache(maxsize=1)
def _matcher(items: tuple, rate: float) -> Matcher:
    return Matcher(list(items), rate)


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = BLOCK_CHARS) -> Iterator[tuple]:
    """The items in normal form, in runs of about ``size`` characters."""
    run, chars = [], 0
    for item_id, text in benchmark.select(id_col, text_col).toLocalIterator():
        text = normal(text or "")
        if text:
            run.append((item_id, text))
            chars += len(text)
            if chars >= size:
                yield tuple(run)
                run, chars = [], 0
    if run:
        yield tuple(run)


def _scan(docs: DataFrame, items: tuple, rate: float, schema: str) -> DataFrame:
    """Occurrences of one block of items in all texts."""

    @tidy
    def run(batches):
        matcher = _matcher(items, rate)
        for batch in batches:
            for part in by_bytes(batch, "text"):
                rows: list[tuple] = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    hits = matcher.search(normal(text))
                    if hits:
                        at = places(text)
                        rows += [(doc_id, i, at[a], at[b - 1] + 1, d, e) for i, a, b, d, e in sorted(hits, key=lambda h: h[1:3])]
                if rows:
                    names = ["doc_id", "item_id", "start", "end", "distance", "budget"]
                    kinds = [part.schema.field("doc_id").type, None, pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return docs.mapInArrow(run, schema)


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = ERROR_RATE, block: int = BLOCK_CHARS) -> DataFrame:
    """One row per occurrence: (doc_id, item_id, start, end, distance, budget)."""
    docs = two_columns(df, id_col, text_col)
    schema = f"doc_id {id_type(df, id_col)}, item_id {id_type(benchmark, item_id)}, start long, end long, distance int, budget int"
    found = None
    for items in blocks(benchmark, item_id, item_text, block):
        if found is not None:  # a block's rows are written before the next block is read
            found = stage(found, "decontamination")
        part = _scan(docs, items, rate, schema)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else df.sparkSession.createDataFrame([], schema)


def drop_contaminated(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = ERROR_RATE, block: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``df``, all columns, without any occurrence of an item."""

    def clean(items: tuple):
        @tidy
        def run(batches):
            matcher = _matcher(items, rate)
            for batch in batches:
                for part in by_bytes(batch, text_col):
                    keep = [not matcher.search(normal(t or "")) for t in part.column(text_col).to_pylist()]
                    yield part.filter(pa.array(keep, pa.bool_()))

        return run

    bound_batches(df.sparkSession)
    schema, first = df.schema, True
    for items in blocks(benchmark, item_id, item_text, block):
        df = df if first else stage(df, "decontaminated")
        df, first = df.mapInArrow(clean(items), schema), False
    return df


def op2_pigeonhole(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
