"""Language identification with a byte convolutional network in numpy.

A text is cut into windows of a fixed number of bytes. Filters of several widths run
over the bytes of a window (a filter is a weight per place and byte value), each keeps
its largest response, and a softmax layer turns the responses into probabilities. A
text's probabilities are the mean over all its windows, weighted by their bytes.

Training takes a bounded sample: at most ``docs_per_lang`` documents of a language and
``WINDOWS`` windows of each, drawn by a hash of the id over all labelled rows. The
prediction sees the bytes alone.

Defined cases: a null text or one without a letter is ``und`` with score 0, as is every
text when nothing is labelled; rows are judged one by one, so repeated rows and ids
agree; texts of any length are read whole, in batches of windows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddyline.llm.common import bound_batches, by_bytes, held_out, id_type, table, tidy

WIDTHS = (2, 3, 4)
FILTERS = 16
WINDOW = 512
WINDOWS = 2
BATCH_WINDOWS = 128
SAMPLE_DOCS = 20_000
FEW_LANGS = 100_000
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Net:
    """Filters per width as (place, byte, filter) weights, and the softmax layer."""

    langs: list[str]
    kernels: dict[int, np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def start(cls, langs: list[str], seed: int = 7) -> "Net":
        rng = np.random.default_rng(seed)
        small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        kernels = {w: small(w, 256, FILTERS) for w in WIDTHS}
        return cls(langs, kernels, np.zeros(FILTERS * len(WIDTHS), np.float32), small(FILTERS * len(WIDTHS), len(langs)), np.zeros(len(langs), np.float32))

    def pairs(self) -> dict[int, list[np.ndarray]]:
        """Filters as tables over byte pairs (and a last single byte for odd widths)."""
        made = {}
        for w, k in self.kernels.items():
            rows = [(k[j][:, None, :] + k[j + 1][None, :, :]).reshape(65536, FILTERS) for j in range(0, w - 1, 2)]
            made[w] = [*rows, k[w - 1]] if w % 2 else rows
        return made

    def pool(self, x: np.ndarray, tables: dict[int, list[np.ndarray]], where: bool = False):
        """Largest response of every filter in each window, and its place if asked."""
        pair = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        best, places = [], []
        for w in WIDTHS:
            n = x.shape[1] - w + 1
            total = None
            for j, rows in enumerate(tables[w]):
                index = x[:, w - 1 : w - 1 + n] if len(rows) == 256 else pair[:, 2 * j : 2 * j + n]
                got = np.take(rows, index, axis=0)
                total = got if total is None else np.add(total, got, out=total)
            if where:
                places.append(total.argmax(axis=1))
            best.append(total.max(axis=1))
        return np.concatenate(best, axis=1) + self.bias, places

    def probabilities(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled, 0) @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def windows_of(raw: bytes, window: int = WINDOW) -> np.ndarray:
    """All bytes as rows of ``window``, the last one filled up with zeros."""
    n = max(1, -(-len(raw) // window))
    x = np.zeros(n * window, np.uint8)
    x[: len(raw)] = np.frombuffer(raw, np.uint8)
    return x.reshape(n, window)


def train(x: np.ndarray, y: np.ndarray, langs: list[str], epochs: int = 6, rate: float = 0.02, seed: int = 7) -> Net:
    """Adam on the cross entropy. A filter learns from the place it responds to most."""
    net, rng = Net.start(langs, seed), np.random.default_rng(seed)
    params = [*net.kernels.values(), net.bias, net.out, net.out_bias]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(order), BATCH_WINDOWS):
            rows = order[a : a + BATCH_WINDOWS]
            bx, by = x[rows], y[rows]
            pooled, places = net.pool(bx, net.pairs(), where=True)
            p = net.probabilities(pooled)
            p[np.arange(len(by)), by] -= 1
            p /= len(by)
            hidden = np.maximum(pooled, 0)
            back = (p @ net.out.T) * (pooled > 0)
            grads = []
            for i, w in enumerate(WIDTHS):
                g = back[:, i * FILTERS : (i + 1) * FILTERS]
                grad = np.empty_like(net.kernels[w])
                for j in range(w):
                    byte = np.take_along_axis(bx, places[i] + j, axis=1).astype(np.int64)
                    cell = byte * FILTERS + np.arange(FILTERS)
                    grad[j] = np.bincount(cell.ravel(), g.ravel(), 256 * FILTERS).reshape(256, FILTERS)
                grads.append(grad)
            grads += [back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]
            step += 1
            for param, m, v, g in zip(params, first, second, grads):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                param -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = 1000) -> Net | None:
    """Train on a bounded sample of the labelled rows outside the held-out fold: about
    ``docs_per_lang`` documents of each language, ``SAMPLE_DOCS`` in all."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & ~F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("labelled"))
    known = sizes.count()
    if not known:
        return None
    wanted = min(docs_per_lang, max(1, SAMPLE_DOCS // known))
    if known <= FEW_LANGS:  # a checked size: the texts need not move
        sizes = F.broadcast(sizes)
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 40))
    share = (F.least(F.lit(1.0), wanted / F.col("labelled")) * (1 << 40)).cast("long")
    chosen = rows.withColumn("draw", draw).join(sizes, "lang").where(F.col("draw") < share).where(F.col("text").rlike("\\p{L}"))
    raw = chosen.select("lang", "draw", F.encode("text", "UTF-8").alias("raw")).withColumn("n", F.length("raw"))
    last = F.greatest(F.col("n") - WINDOW, F.lit(0)) + 1
    cut = [F.substring("raw", (F.lit(1) + F.pmod(F.xxhash64("draw", F.lit(k)), last)).cast("int"), F.lit(WINDOW)) for k in range(WINDOWS)]
    sample = raw.select("lang", "draw", F.array(*cut).alias("windows")).orderBy("draw", "lang").limit(2 * wanted * known).collect()
    if not sample:
        return None
    langs = sorted({r["lang"] for r in sample})
    x = np.concatenate([windows_of(bytes(w))[:1] for r in sample for w in r["windows"]])
    y = np.array([langs.index(r["lang"]) for r in sample for _ in r["windows"]])
    return train(x, y, langs)


def judge(texts: list[str | None], net: Net, tables) -> tuple[list[str], list[float]]:
    """Language and probability of each text."""
    known = [bool(t) and _LETTER.search(t) is not None for t in texts]
    raw = [t.encode() if ok else b"" for t, ok in zip(texts, known)]
    x = [windows_of(r) for r, ok in zip(raw, known) if ok]
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if not x:
        return langs, scores
    counts = np.array([len(w) for w in x])
    x = np.concatenate(x)
    p = np.concatenate([net.probabilities(net.pool(x[a : a + BATCH_WINDOWS], tables)[0]) for a in range(0, len(x), BATCH_WINDOWS)])
    weight = np.full(len(x), float(WINDOW))
    ends = np.cumsum(counts)
    weight[ends - 1] = [len(r) - (c - 1) * WINDOW for r, c in zip((r for r, ok in zip(raw, known) if ok), counts)]
    mean = np.add.reduceat(p * weight[:, None], ends - counts, axis=0) / np.add.reduceat(weight, ends - counts)[:, None]
    for row, i in zip(mean, np.flatnonzero(known)):
        langs[i], scores[i] = net.langs[int(row.argmax())], float(min(1.0, row.max()))
    return langs, scores


def predict(df: DataFrame, net: Net | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: (doc_id, lang_pred, score)."""

    @tidy
    def run(batches):
        tables = net.pairs() if net else None
        for batch in batches:
            for part in by_bytes(batch, "text", 4 << 20):
                texts = part.column("text").to_pylist()
                langs, scores = judge(texts, net, tables) if net else ([UNKNOWN] * len(texts), [0.0] * len(texts))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    bound_batches(df.sparkSession)
    narrow = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, f"doc_id {id_type(df, id_col)}, lang_pred string, score double")


def keep_known(df: DataFrame, net: Net | None, text_col: str = "text", min_score: float = 0.25) -> DataFrame:
    """The rows of ``df``, all columns, whose language is known with at least ``min_score``."""

    @tidy
    def run(batches):
        tables = net.pairs() if net else None
        for batch in batches:
            for part in by_bytes(batch, text_col, 4 << 20):
                if net:
                    langs, scores = judge(part.column(text_col).to_pylist(), net, tables)
                    yield part.filter(pa.array([l != UNKNOWN and s >= min_score for l, s in zip(langs, scores)], pa.bool_()))

    bound_batches(df.sparkSession)
    return df.mapInArrow(run, df.schema)


def op4_byte_cnn(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, fit(docs))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
