"""Running quantities of an ordered log that arrives as a stream, with late rows.

Rows of a key are kept until the watermark has passed them: then no earlier row can come
any more, and they are folded in the order column into a small state, one result row each.
A row that is late by less than the delay gets the result a batch run gives it; one that
the watermark has passed when it comes is dropped. What a key keeps are its rows within the delay and its state, so
the delay bounds the memory however long the log is.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import reduce
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, IntegralType, LongType, StringType, StructField, StructType

from eddyline.session import shared_dir

PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# Groups of keys a stream is dealt over; a group goes through the state store as one.
GROUPS = 1024


class OrderedFold(StatefulProcessor):
    """Keeps rows until the watermark has passed them and folds them in order, key by key.

    A group holds many keys: a call of the state store costs far more than a row, and a log
    of many small keys would else make several calls a key and trigger.
    """

    def __init__(self, n_keys: int, kept: StructType, state: StructType, start: tuple, fold: Callable, out: Sequence[str]):
        self.n_keys, self.kept, self.state_type = n_keys, kept, state
        self.start, self.fold, self.out = start, fold, list(out)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.kept)
        self.current = handle.getListState("current", self.state_type)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # pandas holds whole numbers beside nulls as floats
        whole = [isinstance(f.dataType, IntegralType) for f in self.kept.fields]
        at, mark = self.n_keys + 1, timerValues.getCurrentWatermarkInMs()
        fresh = []
        for pdf in rows:
            columns = [_values(pdf[c], w) for c, w in zip(self.kept.names, whole)]
            fresh += [r for r in zip(*columns) if r[at] > mark]
        yield from self._release(fresh, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._release([], timerValues)

    def _release(self, fresh: list[tuple], timerValues) -> Iterator[pd.DataFrame]:
        k, t = self.n_keys, self.n_keys + 1
        mark = timerValues.getCurrentWatermarkInMs()
        waited = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        rows = waited + fresh
        ready = sorted((r for r in rows if r[t] <= mark), key=itemgetter(k))
        rest = [r for r in rows if r[t] > mark] if ready else rows
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if rest:
            if ready or not waited:
                self.waiting.put(rest)
            elif fresh:
                self.waiting.appendList(fresh)
            self.handle.registerTimer(min(r[t] for r in rest))
        elif waited:
            self.waiting.clear()
        if ready:
            held = (tuple(r) for r in self.current.get()) if self.current.exists() else ()
            states, out = {r[:k]: r[k:] for r in held}, []
            for row in ready:
                key = row[:k]
                states[key], result = self.fold(states.get(key, self.start), row[t + 1 :])
                out.append(row[: k + 1] + tuple(result))
            self.current.put([key + tuple(state) for key, state in states.items()])
            yield pd.DataFrame(out, columns=self.out)

    def close(self) -> None:
        pass


def _values(column: pd.Series, whole: bool) -> list:
    """The values as Python's own, which the state's schema asks for; missing ones as None."""
    absent = column.isna()
    if not absent.any():
        return [int(v) for v in column] if whole else [_plain(v) for v in column]
    return [None if gone else int(v) if whole else _plain(v) for v, gone in zip(column, absent)]


def _plain(value):
    """Numpy scalars as Python's own, which the state's schema asks for."""
    return value.item() if hasattr(value, "item") else value


@contextmanager
def state_in_rocksdb(spark: SparkSession):
    before = spark.conf.get(PROVIDER_KEY, None)
    spark.conf.set(PROVIDER_KEY, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER_KEY) if before is None else spark.conf.set(PROVIDER_KEY, before)


def ordered_fold(
    rows: DataFrame, keys: Sequence[str], order: str, time: str, delay: str, values: Sequence[str], state: StructType, start: tuple, fold: Callable, results: Sequence[StructField]
) -> DataFrame:
    """(keys, order, results) of a streaming frame. ``fold(state, values)`` gives the next state and
    the result values of a row; ``time`` is a timestamp that does not fall along ``order``.
    Rows without a key or a time are dropped."""
    kinds = {f.name: f for f in rows.schema.fields}
    millis = f"{time}_ms"
    own = [StructField(k, kinds[k].dataType) for k in keys]
    kept = StructType([*own, StructField(order, LongType()), StructField(millis, LongType()), *[StructField(f"{v}_v", kinds[v].dataType) for v in values]])
    out = StructType([*[kinds[k] for k in keys], StructField(order, LongType()), *results])
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    # names the time, so that the filter stays above the watermark: rows without a key move it on
    stream = rows.withWatermark(time, delay).where(F.when(F.col(time).isNotNull(), known).otherwise(False))
    # rounded up: a row waits until the watermark has passed its last microsecond
    stream = stream.select(*keys, time, F.col(order).cast("long").alias(order), F.ceil(F.unix_micros(F.col(time).cast("timestamp")) / 1000).cast("long").alias(millis), *[F.col(v).alias(f"{v}_v") for v in values], F.pmod(F.xxhash64(*keys), F.lit(GROUPS)).alias("_group"))
    processor = OrderedFold(len(keys), kept, StructType([*own, *state.fields]), start, fold, out.names)
    return stream.groupBy("_group").transformWithStateInPandas(statefulProcessor=processor, outputStructType=out, outputMode="append", timeMode="eventtime")


def segment_ids(rows: DataFrame, keys: Sequence[str], order: str, time: str, value: str, delay: str) -> DataFrame:
    """(keys, order, segment): the number of changes of ``value`` so far, the first row counts."""
    kind = {f.name: f.dataType for f in rows.schema.fields}[value]

    def fold(state, row):
        count, previous = state
        count += count == 0 or previous != row[0]
        return (count, row[0]), (count,)

    state = StructType([StructField("count", LongType()), StructField("previous", kind)])
    return ordered_fold(rows, keys, order, time, delay, [value], state, (0, None), fold, [StructField("segment", LongType())])


def sprt(
    rows: DataFrame, keys: Sequence[str], order: str, time: str, value: str, delay: str, theta_0: float, theta_1: float, sigma2: float, alpha: float = 0.05, beta: float = 0.1
) -> DataFrame:
    """(keys, order, n, llr, decision_n, decision): the sequential ratio test of a normal mean
    after each row; the decision is that of the first crossing and stays. A null value
    changes nothing."""
    upper, lower = math.log((1 - beta) / alpha), math.log(beta / (1 - alpha))

    def fold(state, row):
        n, llr, at, decision = state
        if row[0] is None:
            return state, state
        n, llr = n + 1, llr + (theta_1 - theta_0) / sigma2 * (row[0] - (theta_0 + theta_1) / 2)
        if at is None and (llr >= upper or llr <= lower):
            at, decision = n, "reject" if llr >= upper else "accept"
        return (n, llr, at, decision), (n, llr, at, decision)

    fields = [StructField("n", LongType()), StructField("llr", DoubleType()), StructField("decision_n", LongType()), StructField("decision", StringType())]
    numbers = rows.withColumn(value, F.col(value).cast("double"))
    return ordered_fold(numbers, keys, order, time, delay, [value], StructType(fields), (0, 0.0, None, "continue"), fold, fields)


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all files its sources have now; returns a reader over the results."""
    spark = stream.sparkSession
    folder = f"{shared_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"
    with state_in_rocksdb(spark):
        query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def as_arrivals(df: DataFrame, time: str, name: str, chunks: int = 4, late: int = 10, files: int = 2) -> DataFrame:
    """A finite log as a stream of files in the order of ``time``: one chunk of files a
    trigger, every ``late``-th row (by hash) one chunk later than due, and a last chunk that
    holds one row without values, late enough for the watermark to pass all others."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"
    low, high = df.agg(F.min(F.col(time).cast("timestamp")), F.max(F.col(time).cast("timestamp"))).first()
    seconds = max((high - low).total_seconds(), 1.0)
    at = F.col(time).cast("timestamp")
    due = F.least(F.floor((F.unix_micros(at) - F.unix_micros(F.lit(low))) / 1e6 / seconds * chunks), F.lit(chunks - 1))
    arrival = F.least(due + F.when(F.pmod(F.xxhash64(*df.columns), F.lit(late)) == 0, 1).otherwise(0), F.lit(chunks - 1))
    rows = df.withColumn(time, at)
    for k in range(chunks):
        rows.where(arrival == k).repartition(files).write.mode("append").parquet(folder)
    end = spark.range(1).select(*[(F.lit(high) + F.expr("INTERVAL 1000 DAYS")).alias(time) if c == time else F.lit(None).cast(dict(rows.dtypes)[c]).alias(c) for c in rows.columns])
    end.write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)
