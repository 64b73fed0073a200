"""Signatures of growing paths whose points come out of order: a stream by event time.

Products of signatures don't commute, so a late point can't be multiplied on; it must go in before its successors. The state of a
series is a settled signature, of the points at or before the watermark, which no later point may precede, and a list of the
open points after it. Each trigger answers with the settled signature times that of the open points in order; what the watermark
passes is folded into the settled part, on input or by a timer. A point later than the watermark allows is dropped.

State is bounded by the signature's length and the points of a series within the watermark's delay. A group of the stream is a
bucket of series, not one: what a group costs beside its points (calls to the state store, a timer, array kernels) is paid by
bucket and trigger, and the kernels take the bucket's series at once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import chain
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DataType, DoubleType, LongType, StringType, StructField, StructType

from braidpath.functions import chen
from braidpath.functions.vectors import signature_length
from braidpath.sources.staging import staged_path

#: The store that list state and timers need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

#: Groups of a stream, whatever the number of its series.
BUCKETS = 4_096

#: Open points in one row of state: a row costs about as much as many points.
PACKED = 1_024


def _arrays(**kinds: DataType) -> list[StructField]:
    return [StructField(name, ArrayType(kind)) for name, kind in kinds.items()]


#: Of a bucket: its settled points; then by series, flat: name, settled points, time of the last, the last, signature.
SETTLED = StructType([StructField("n", LongType()), *_arrays(series=StringType(), counts=LongType(), at=LongType(), last=DoubleType(), signature=DoubleType())])
#: Of some open points of a bucket, flat: name of the series, micros, tie, point.
OPEN = StructType(_arrays(series=StringType(), at=LongType(), tie=StringType(), points=DoubleType()))


class Paths:
    """Of several series the count of points, the time of the last, the last and the signature, by row; ``index`` gives a name's row."""

    def __init__(self, channels: int, depth: int, names: Sequence = (), n: Sequence = (), at: Sequence = (), last: Sequence = (), signature: Sequence = ()) -> None:
        self.depth, self.index = depth, {name: row for row, name in enumerate(names)}
        self.n, self.at = np.array(n, np.int64), np.array(at, np.int64)
        self.last = np.array(last, np.float64).reshape(-1, channels)
        self.signature = np.array(signature, np.float64).reshape(-1, signature_length(channels, depth))

    def rows(self, names: Iterable) -> np.ndarray:
        """Their rows; a new name has a path without points."""
        found = np.array([self.index.setdefault(name, len(self.index)) for name in names], np.int64)
        if new := len(self.index) - len(self.n):
            self.n = np.append(self.n, np.zeros(new, np.int64))
            self.at = np.append(self.at, np.full(new, np.iinfo(np.int64).min))
            self.last, self.signature = (np.vstack([x, np.zeros((new, x.shape[1]))]) for x in (self.last, self.signature))
        return found

    def extend(self, rows: np.ndarray, at: np.ndarray, points: np.ndarray) -> None:
        """More points, in order of row and time."""
        if not len(rows):
            return
        first = np.flatnonzero(np.diff(rows, prepend=-1))
        own, counts = rows[first], np.diff(np.append(first, len(rows)))
        dx = np.diff(points, axis=0, prepend=points[:1])
        # a path begins at its first point: no step leads there
        dx[first] = np.where(self.n[own, None] > 0, points[first] - self.last[own], 0.0)
        # steps of zero change no signature, so paths of like length are filled up to one
        widths = 1 << np.ceil(np.log2(counts)).astype(int)
        d = points.shape[1]
        for width in np.unique(widths):
            alike = np.flatnonzero(widths == width)
            size = chen.safe_batch(len(alike), int(width), d, self.depth)
            for part in (alike[k : k + size] for k in range(0, len(alike), size)):
                steps = np.zeros((len(part), width, d))
                held = np.arange(width) < counts[part, None]
                steps[held] = dx[(first[part, None] + np.arange(width))[held]]
                self.signature[own[part]] = chen.product(self.signature[own[part]], chen.signatures(steps, self.depth), d, self.depth)
        end = first + counts - 1
        self.n[own] += counts
        self.at[own], self.last[own] = at[end], points[end]


class OrderedSignatures(StatefulProcessor):
    """Of each series and trigger (key, n_points, signature) of all points so far, in the order of their times.

    A group may hold many series; ``packed`` open points share a row of state.
    """

    def __init__(self, key: str, channels: Sequence[str], depth: int, packed: int = 1) -> None:
        self.key, self.channels, self.depth, self.packed = key, list(channels), depth, packed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", SETTLED)
        self.open = handle.getListState("open", OPEN)

    def _settle(self, more: tuple, watermark: int) -> tuple[Paths, tuple]:
        """The settled paths and the open points (row, micros, point) in order, after ``more`` (names, micros, ties, points) and up to the watermark (millis)."""
        paths = Paths(len(self.channels), self.depth, *(self.settled.get()[1:] if self.settled.exists() else ()))
        names, at, tie, points = more
        if self.open.exists():
            old = [list(chain.from_iterable(parts)) for parts in zip(*self.open.get())]
            names, at, tie, points = old[0] + names, np.append(np.array(old[1], np.int64), at), old[2] + tie, np.vstack([np.reshape(old[3], (-1, points.shape[1])), points])
        rows, tie = paths.rows(names), np.array(tie, str)
        order = np.lexsort((tie, at, rows))
        order = order[at[order] > paths.at[rows[order]]]
        rows, at, tie, points = rows[order], at[order], tie[order], points[order]
        passed = at <= watermark * 1_000
        paths.extend(rows[passed], at[passed], points[passed])
        known = paths.n > 0
        if passed.any():
            named = [name for name, row in paths.index.items() if known[row]]
            self.settled.update((int(paths.n.sum()), named, *(x[known].reshape(-1).tolist() for x in (paths.n, paths.at, paths.last, paths.signature))))
        left = ~passed
        if left.any():
            named, keep = list(paths.index), np.flatnonzero(left)
            parts = (keep[k : k + self.packed] for k in range(0, len(keep), self.packed))
            self.open.put([([named[r] for r in rows[p].tolist()], at[p].tolist(), tie[p].tolist(), points[p].reshape(-1).tolist()) for p in parts])
        elif self.open.exists():
            self.open.clear()
        return paths, (rows[left], at[left], points[left])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        # by place, as names with underscores don't come through: series, time, micros, tie, channels
        frame = pd.concat(list(rows))
        names = [name if isinstance(name, str) else None for name in frame.iloc[:, 0].tolist()]
        points = frame.iloc[:, 4 : 4 + len(self.channels)].to_numpy(float)
        paths, open_points = self._settle((names, frame.iloc[:, 2].to_numpy(np.int64), frame.iloc[:, 3].tolist(), points), timerValues.getCurrentWatermarkInMs())
        if len(open_points[1]):
            # when the watermark has passed the newest point, all are settled
            due = int(open_points[1].max()) // 1_000 + 1
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old if isinstance(old, int) else old[0])
            self.handle.registerTimer(due)
            paths.extend(*open_points)
        seen = list(dict.fromkeys(names))
        own = paths.rows(seen)
        yield pd.DataFrame({self.key: seen, "n_points": paths.n[own], "signature": list(paths.signature[own])})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self._settle(([], np.zeros(0, np.int64), [], np.zeros((0, len(self.channels)))), timerValues.getCurrentWatermarkInMs())
        return iter(())

    def close(self) -> None:
        pass


def ordered_signatures(stream: DataFrame, channels: Sequence[str], depth: int, delay: str, key: str = "series", order: str = "ts", tie: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(key, n_points, signature) of each series that a trigger has points of, over all its points so far in order of ``order``.

    ``delay`` is how far behind the latest time points may come; ``tie`` orders points of one time, as text of fixed form. Points
    that lack a time or a channel are left out. Series are dealt to ``buckets`` by a hash, and told apart by their key as text. A
    stream keeps its number of buckets for life, as it does its partitions; a task holds one bucket at a time.
    """
    kind = stream.schema[key].dataType.simpleString()
    ready = stream.dropna(subset=[order, *channels]).withWatermark(order, delay)
    text = F.lit("") if tie is None else F.lpad(F.col(tie).cast("string"), 20, "0")
    name = F.base64(key) if kind == "binary" else F.col(key).cast("string")
    ready = ready.select(
        name.alias(key), order, F.unix_micros(F.col(order).cast("timestamp")).alias("__at"), text.alias("__tie"), *[F.col(c).cast("double").alias(c) for c in channels],
        F.pmod(F.xxhash64(name), F.lit(buckets)).cast("int").alias("__bucket"),
    )
    found = ready.groupBy("__bucket").transformWithStateInPandas(
        OrderedSignatures(key, channels, depth, PACKED), outputStructType=f"{key} string, n_points bigint, signature array<double>", outputMode="Update", timeMode="EventTime"
    )
    return found.withColumn(key, F.unbase64(key) if kind == "binary" else F.col(key).cast(kind))


def latest_of(spark: SparkSession, stream: DataFrame, key: str = "series") -> DataFrame:
    """Run a stream over all that is there; of each key the row of its latest trigger.

    A trigger's rows are written under its number, so one that is run again after a failure replaces what it left.
    """
    out, marks = staged_path(spark, "stream-out"), staged_path(spark, "stream-marks")

    def keep(rows: DataFrame, trigger: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/trigger={trigger}")

    stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("trigger", LongType())])).parquet(out)
    values = [c for c in stream.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*values), "trigger").alias("v")).select(key, "v.*")
