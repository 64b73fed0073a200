"""Signatures of paths of any length: an ordered, associative reduction by Chen's identity.

Points are range-sorted by path and order, so a path may lie over many partitions and a partition may hold many paths.
Each partition reads its rows once and reduces each stretch of a path to one row: its first and last point and its signature. Two
neighbouring stretches make one, with the straight line between them. Stretches merge in the order of their partitions, in two
rounds: neighbouring ones first, then what these leave. Neither a row nor a task ever holds a path.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidpath.functions import chen
from braidpath.functions.vectors import signature_length

#: Points that the array kernel takes at once.
STEPS = 1_024


class Stretch:
    """A stretch of a path: how many points, the first and the last, and the signature in between."""

    def __init__(self, points: np.ndarray, depth: int) -> None:
        self.n, self.first, self.last, self.depth = 0, points[0], points[0], depth
        self.signature = np.zeros((1, signature_length(points.shape[1], depth)))
        self.add(points)

    def _then(self, signature: np.ndarray) -> None:
        self.signature = chen.product(self.signature, signature, len(self.first), self.depth)

    def add(self, points: np.ndarray) -> None:
        """More points, which follow."""
        for at in range(0, len(points), STEPS):
            part = points[at : at + STEPS]
            self._then(chen.signatures(np.diff(np.vstack([self.last, part]), axis=0)[None], self.depth))
            self.last = part[-1]
        self.n += len(points)

    def join(self, n: int, first: np.ndarray, last: np.ndarray, signature: np.ndarray) -> None:
        """The stretch that follows, after the line that leads there."""
        self._then(chen.signatures((first - self.last)[None, None], self.depth))
        self._then(signature[None])
        self.n, self.last = self.n + n, last


VALUES = "n_points bigint, first array<double>, last array<double>, signature array<double>"


def stretches(points: DataFrame, channels: Sequence[str], depth: int, keys: Sequence[str], order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """(keys, block, n_points, first, last, signature): each path's stretch in each partition of the range-sorted points.

    Points that lack a channel are left out. ``order`` must tell a path's points apart.
    """
    partitions = partitions or int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c) for c in (*keys, *order)]
    dealt = points.dropna(subset=list(channels)).repartitionByRange(partitions, *by).sortWithinPartitions(*by)
    dealt = dealt.select(*keys, *[F.col(c).cast("double").alias(f"__x{k}") for k, c in enumerate(channels)], F.spark_partition_id().alias("__block"))
    n_keys, d = len(keys), len(channels)
    schema = ", ".join([f"`{c}` {points.schema[c].dataType.simpleString()}" for c in keys] + ["block int", VALUES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, own = None, None

        def row() -> pa.RecordBatch:
            values = [pa.array([own.n]), *[pa.array([v.tolist()], pa.list_(pa.float64())) for v in (own.first, own.last, own.signature[0])]]
            return pa.RecordBatch.from_arrays([*open_key, *values], names=[*keys, "block", "n_points", "first", "last", "signature"])

        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[n_keys : n_keys + d]], 1)
            codes = [c.dictionary_encode(null_encoding="encode").indices.to_numpy() for c in batch.columns[:n_keys]]
            changes = np.flatnonzero(np.any([c[1:] != c[:-1] for c in codes], axis=0)) + 1 if codes and len(x) > 1 else []
            cuts = [0, *changes, len(x)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                key = [c.slice(a, 1) for c in (*batch.columns[:n_keys], batch.column(n_keys + d))]
                if own is not None and all(p.to_pylist() == q.to_pylist() for p, q in zip(key, open_key)):
                    own.add(x[a:b])
                    continue
                if own is not None:
                    yield row()
                open_key, own = key, Stretch(x[a:b], depth)
        if own is not None:
            yield row()

    return dealt.mapInArrow(run, schema)


def path_signatures(points: DataFrame, channels: Sequence[str], depth: int, keys: Sequence[str], order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """(keys, n_points, signature): one row a path, from its points in long form; the path begins at its first point."""
    partitions = partitions or int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = stretches(points, channels, depth, keys, order, partitions)
    types = ", ".join(f"`{c}` {points.schema[c].dataType.simpleString()}" for c in keys)

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        own = None
        for r in group.sort_values("block").itertuples():
            values = [np.asarray(v, np.float64) for v in (r.first, r.last, r.signature)]
            if own is None:
                own = Stretch(values[0][None], depth)
                own.n, own.last, own.signature = r.n_points, values[1], values[2][None]
            else:
                own.join(r.n_points, *values)
        head = group.iloc[:1][[*keys, "block"]].assign(block=int(group["block"].min()))
        return head.assign(n_points=own.n, first=[own.first.tolist()], last=[own.last.tolist()], signature=[own.signature[0].tolist()])

    schema = f"{types}, block int, {VALUES}"
    # about the root of the number of partitions in each round
    found = found.withColumn("__near", F.floor(F.col("block") / math.isqrt(partitions)))
    found = found.groupBy(*keys, "__near").applyInPandas(merge, schema)
    return found.groupBy(*keys).applyInPandas(merge, schema).select(*keys, "n_points", "signature")
