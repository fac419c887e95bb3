"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = sigmoid(threshold_k - w . x): one weight vector, shared by all grades,
and ordered thresholds. x marks which of the chosen words and word beginnings a text holds
once, twice or more often. They are chosen by the log odds of their document frequency among toxic and other texts of the sample.
The thresholds are moved by the log odds between the sample's and all labelled rows' share.

Labels say only toxic or not, so grades come from the sample: 0 for the others, and 1 to
3 for the thirds of toxic texts by the number of features in them that lean toxic.

The fit takes a bounded sample: ``MAX_TOXIC`` toxic and ``MAX_OTHER`` other labelled rows,
drawn by a hash of the id over all rows outside the held-out fold. Everything else runs
over whole texts of all rows.

Defined cases: a null or empty text has no feature and gets what the thresholds alone
say; null labels are left out, repeated labels of one document count as their largest;
without toxic labels the severity is 0 for all. Repeated rows are judged one by one.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddyline.llm.common import by_bytes, held_out, id_type, table, two_columns

MAX_TOXIC, MAX_OTHER = 3000, 5000
GRADES = 4
PREFIXES = (4, 5, 6, 7)
HASHES, LEVELS, NONE = 1 << 20, 3, -1
MIN_SHARE, MIN_Z = 0.03, 4.0
MEMO_WORDS = 500_000
_WORD = re.compile(r"[^\W_]+")


class Features(dict):
    """Word -> row of ``table``, which holds the hashes of the word and of its prefixes.
    Both are kept while they are small."""

    def __init__(self):
        super().__init__()
        self.table = np.zeros((1 << 12, 1 + len(PREFIXES)), np.int32)

    def __missing__(self, word: str) -> int:
        row = len(self)
        if row == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        for k, part in enumerate([word + " ", *(word[:n] if len(word) >= n else "" for n in PREFIXES)]):
            self.table[row, k] = zlib.crc32(part.encode("utf-8", "surrogatepass")) & (HASHES - 1) if part else NONE
        self[word] = row
        return row

    def of(self, text: str) -> np.ndarray:
        """Hashes of all words of a text and their prefixes, as often as they occur."""
        if len(self) > MEMO_WORDS:
            self.clear()
        found = _WORD.findall(text.lower())
        rows = np.fromiter(map(self.__getitem__, found), np.int64, len(found))
        hashes = self.table[rows].ravel()
        return hashes[hashes != NONE]


def levels(hashes: np.ndarray) -> np.ndarray:
    """Features of a text: a hash that occurs once, twice, three times or more."""
    base, count = np.unique(hashes, return_counts=True)
    return np.concatenate([base[count >= n] * np.int64(LEVELS) + (n - 1) for n in range(1, LEVELS + 1)]) if len(base) else np.zeros(0, np.int64)


@dataclass
class Ordinal:
    weights: dict[int, float]
    thresholds: np.ndarray

    def beyond(self, score: float) -> np.ndarray:
        """P(grade > k) for every threshold k."""
        return 1 / (1 + np.exp(self.thresholds - score))


def cumulative_fit(x: np.ndarray, y: np.ndarray, grades: int, steps: int = 600, rate: float = 0.05, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood with Adam. Thresholds are a first one plus positive gaps."""
    w = np.zeros(x.shape[1])
    share = np.clip(np.array([(y <= k).mean() for k in range(grades - 1)]), 1e-4, 1 - 1e-4)
    cuts = np.log(share / (1 - share))
    raw = np.concatenate([cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-3))])
    params = np.concatenate([w, raw])
    m, v, n = np.zeros_like(params), np.zeros_like(params), x.shape[1]
    for step in range(1, steps + 1):
        w, raw = params[:n], params[n:]
        cuts = np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))
        f = 1 / (1 + np.exp(-np.clip(cuts[None, :] - (x @ w)[:, None], -40, 40)))
        upper = np.concatenate([f, np.ones((len(x), 1))], axis=1)[np.arange(len(x)), y]
        lower = np.concatenate([np.zeros((len(x), 1)), f], axis=1)[np.arange(len(x)), y]
        inside = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / inside, lower * (1 - lower) / inside
        dcut = np.zeros(grades - 1)
        np.add.at(dcut, y[y < grades - 1], du[y < grades - 1])
        np.add.at(dcut, y[y > 0] - 1, -dl[y > 0])
        tail = np.cumsum(dcut[::-1])[::-1] / len(x)
        grad_raw = np.concatenate([tail[:1], tail[1:] * np.exp(raw[1:])])
        grad = np.concatenate([(x.T @ (dl - du)) / len(x) - ridge * w, grad_raw])  # of the log likelihood
        m += 0.1 * (grad - m)
        v += 0.001 * (grad * grad - v)
        params = params + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    w, raw = params[:n], params[n:]
    return w, np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_toxic: int = MAX_TOXIC, max_other: int = MAX_OTHER) -> Ordinal | None:
    """Train on a bounded sample; None if no toxic text is labelled."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where(F.col("id").isNotNull() & F.col("y").isNotNull())
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg((F.max("y") > 0).alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    draw = F.xxhash64("id", F.lit("sample"))
    chosen = [known.where(side).orderBy(draw, "id").limit(n) for side, n in ((F.col("toxic"), max_toxic), (~F.col("toxic"), max_other))]
    sample = chosen[0].unionByName(chosen[1])  # at most max_toxic + max_other ids
    texts = two_columns(df, id_col, text_col).join(F.broadcast(sample), F.col("doc_id") == F.col("id")).select("doc_id", "text", "toxic")

    def features(batches):
        memo = Features()
        for batch in batches:
            for part in by_bytes(batch, "text"):
                held = [levels(memo.of(t)).astype(np.int32) for t in part.column("text").to_pylist()]
                columns = [part.column("doc_id"), part.column("toxic"), pa.array(held, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "toxic", "ids"])

    rows = texts.mapInArrow(features, f"doc_id {id_type(df, id_col)}, toxic boolean, ids array<int>")
    got = rows.toArrow()
    order = np.argsort(np.array(got.column("doc_id").to_pylist()), kind="stable")
    toxic = np.array(got.column("toxic").to_pylist(), dtype=bool)[order]
    if not toxic.any() or toxic.all():
        return None
    held = [part for chunk in got.column("ids").chunks for part in np.split(chunk.flatten().to_numpy(), np.cumsum(np.diff(chunk.offsets.to_numpy()))[:-1])]
    ids = [held[i].astype(np.int64) for i in order]
    size = HASHES * LEVELS
    seen = [np.bincount(np.concatenate([i for i, t in zip(ids, toxic) if t == side] or [np.zeros(0, np.int64)]), minlength=size) for side in (False, True)]
    n0, n1 = (~toxic).sum(), toxic.sum()
    a, b = seen[1] + 0.5, seen[0] + 0.5
    odds = np.log(a / (n1 - seen[1] + 0.5)) - np.log(b / (n0 - seen[0] + 0.5))
    z = odds / np.sqrt(1 / a + 1 / (n1 - seen[1] + 0.5) + 1 / b + 1 / (n0 - seen[0] + 0.5))
    common = np.maximum(seen[1] / n1, seen[0] / n0) >= MIN_SHARE  # a group of near copies alone makes no feature
    picked = np.flatnonzero((np.abs(z) >= MIN_Z) & common)
    if not len(picked):
        return None
    place = np.full(size, -1)
    place[picked] = np.arange(len(picked))
    x = np.zeros((len(ids), len(picked)))
    lean = np.zeros(len(ids))
    for row, i in enumerate(ids):
        x[row, place[i][place[i] >= 0]] = 1
        lean[row] = ((z[i] >= MIN_Z) & common[i]).sum()
    y = np.zeros(len(ids), np.int64)
    thirds = np.quantile(lean[toxic], [k / (GRADES - 1) for k in range(1, GRADES - 1)])
    y[toxic] = 1 + np.searchsorted(thirds, lean[toxic], side="left")
    w, cuts = cumulative_fit(x, y, GRADES)
    cuts += math.log(n1 / n0) - math.log(sizes[True] / sizes[False])  # the sample holds more toxic texts than the corpus
    return Ordinal({int(k): float(v) for k, v in zip(picked, w)}, cuts)


def predict(df: DataFrame, model: Ordinal | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: (doc_id, severity, p_toxic, grade, toxic). ``severity`` is the
    expected grade, ``grade`` the likeliest, ``toxic`` whether grade 0 is less likely than not."""

    def run(batches):
        memo = Features()
        weight, used = np.zeros(HASHES * LEVELS), np.zeros(HASHES, bool)
        for feature, value in (model.weights if model else {}).items():
            weight[feature], used[feature // LEVELS] = value, True
        for batch in batches:
            for part in by_bytes(batch, "text"):
                severity, p_toxic, grade = [], [], []
                for text in part.column("text").to_pylist():
                    if model is None:
                        above = np.zeros(GRADES - 1)
                    else:
                        hashes = memo.of(text)
                        above = model.beyond(float(weight[levels(hashes[used[hashes]])].sum()))
                    severity.append(float(above.sum())), p_toxic.append(float(above[0]))
                    grade.append(int(np.argmax(-np.diff(np.concatenate([[1.0], above, [0.0]])))))
                columns = [part.column("doc_id"), pa.array(severity), pa.array(p_toxic), pa.array(grade, pa.int32()), pa.array([p >= 0.5 for p in p_toxic], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "severity", "p_toxic", "grade", "toxic"])

    return two_columns(df, id_col, text_col).mapInArrow(run, f"doc_id {id_type(df, id_col)}, severity double, p_toxic double, grade int, toxic boolean")


def op7_ordinal_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs, table(spark, sf_dir, "labels")))
