"""Signatures in SQL text: a table function over a partitioned and ordered table.

    SELECT * FROM path_signature(TABLE(steps) PARTITION BY series ORDER BY step, channels => 'x_1, x_2', depth => 3, keys => 'series')

A partition is a path, its rows the increments or, with ``points => true``, the points in order; Spark deals out and sorts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import ArrayType, DoubleType, LongType, Row, StructType

from braidpath.functions import chen
from braidpath.functions.vectors import signature_length

#: Rows that are taken together by the array kernel; a path keeps no more of them.
STEPS = 1_024


@dataclass
class Shape(AnalyzeResult):
    """What the arguments say, from the analysis to each partition."""

    keys: tuple[str, ...] = ()
    channels: tuple[str, ...] = ()
    depth: int = 1
    points: bool = False


def _names(argument: AnalyzeArgument | None) -> tuple[str, ...]:
    return tuple(n.strip() for n in (argument.value if argument else "").split(",") if n.strip())


class PathSignature:
    """(keys, n_rows, signature), one row a partition; ``keys`` are columns that are constant in it."""

    def __init__(self, shape: Shape) -> None:
        self.shape, self.rows, self.keys, self.n, self.last = shape, [], None, 0, None
        self.signature = np.zeros((1, signature_length(len(shape.channels), shape.depth)))

    @staticmethod
    def analyze(steps: AnalyzeArgument, channels: AnalyzeArgument, depth: AnalyzeArgument, keys: AnalyzeArgument | None = None, points: AnalyzeArgument | None = None) -> Shape:
        if not steps.isTable:
            raise ValueError("the first argument is a table: TABLE(...) PARTITION BY ... ORDER BY ...")
        for a, name in ((channels, "channels"), (depth, "depth"), (keys, "keys"), (points, "points")):
            if a is not None and not a.isConstantExpression:
                raise ValueError(f"{name} is a constant")
        own, fields = {f.name: f for f in steps.dataType.fields}, StructType()
        if missing := [n for n in (*_names(keys), *_names(channels)) if n not in own]:
            raise ValueError(f"the table has no columns {missing}")
        if not _names(channels) or depth.value < 1:
            raise ValueError("a signature has channels and a depth of at least 1")
        for n in _names(keys):
            fields.add(n, own[n].dataType)
        fields.add("n_rows", LongType()).add("signature", ArrayType(DoubleType()))
        return Shape(schema=fields, keys=_names(keys), channels=_names(channels), depth=int(depth.value), points=bool(points.value) if points else False)

    def _take(self) -> None:
        if not self.rows:
            return
        x = np.array(self.rows, float)
        self.rows = []
        if self.shape.points:
            x, self.last = np.diff(x if self.last is None else np.vstack([self.last, x]), axis=0), x[-1]
        d, depth = len(self.shape.channels), self.shape.depth
        self.signature = chen.product(self.signature, chen.signatures(x[None], depth), d, depth)

    def eval(self, row: Row, channels: str, depth: int, keys: str = "", points: bool = False) -> None:
        if self.keys is None:
            self.keys = tuple(row[k] for k in self.shape.keys)
        self.rows.append([row[c] for c in self.shape.channels])
        self.n += 1
        if len(self.rows) >= STEPS:
            self._take()

    def terminate(self) -> Iterator[tuple]:
        if self.n:
            self._take()
            yield (*self.keys, self.n, self.signature[0].tolist())


def register(spark: SparkSession, name: str = "path_signature") -> None:
    """Make the function known to the session's SQL."""
    spark.udtf.register(name, udtf(PathSignature))
