"""Truncated signatures: a SQL form for small depth, an array form for any, and their statistics over many paths.

Paths are given by their increments. A path that starts at its first point loses nothing by that; a path whose first
increment leads from zero to the first point (a base point) includes that increment. The two differ, so callers say
which they mean through the increments they pass.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from braidpath.functions import chen
from braidpath.functions.vectors import level_of, signature_length
from braidpath.operators.panel import WINDOW, blocked, numbered

#: Coordinates that travel in one row of partial sums.
CHUNK = 4096


def signature_sql(rows: DataFrame, channels: Sequence[str], depth: int, keys: Sequence[str], order: str = "step") -> DataFrame:
    """One row a path: keys, s_1..s_n, from increments in long form. Depth 1 to 3.

    Level k needs the levels below ahead of each step, which are running sums over the path; all windows and the last
    aggregation share one partitioning by ``keys``.
    """
    if depth not in (1, 2, 3):
        raise ValueError("the SQL form has depth 1 to 3; use signatures for more")
    d = len(channels)
    ahead = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    dx = [F.col(c) for c in channels]
    letters = range(d)
    sums = list(dx)
    if depth > 1:
        rows = rows.withColumns({f"__p{i}": F.coalesce(F.sum(dx[i]).over(ahead), F.lit(0.0)) for i in letters})
        p = [F.col(f"__p{i}") for i in letters]
        two = {(i, j): p[i] * dx[j] + dx[i] * dx[j] / 2 for i in letters for j in letters}
        sums += [two[i, j] for i in letters for j in letters]
    if depth > 2:
        rows = rows.withColumns({f"__q{i}_{j}": F.coalesce(F.sum(two[i, j]).over(ahead), F.lit(0.0)) for i in letters for j in letters})
        sums += [F.col(f"__q{i}_{j}") * dx[k] + p[i] * dx[j] * dx[k] / 2 + dx[i] * dx[j] * dx[k] / 6 for i in letters for j in letters for k in letters]
    return rows.groupBy(*keys).agg(*[F.sum(s).alias(f"s_{n}") for n, s in enumerate(sums, 1)])


def pack(rows: DataFrame, channels: Sequence[str], keys: Sequence[str], order: str = "step") -> DataFrame:
    """keys and steps: the rows of each path as an array of arrays, in order."""
    row = F.struct(F.col(order), F.array(*[F.col(c) for c in channels]).alias("x"))
    return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["x"]).alias("steps"))


def _tensors(column: pa.ListArray, channels: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, increments) of an Arrow column of paths, grouped by the number of steps."""
    outer = np.diff(column.offsets.to_numpy())
    flat = column.flatten().flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(outer) - outer
    for steps in np.unique(outer):
        rows = np.flatnonzero(outer == steps)
        at = (starts[rows, None] + np.arange(steps)[None, :]).reshape(-1)
        yield rows, flat.reshape(-1, channels)[at].reshape(len(rows), steps, channels) if steps else np.zeros((len(rows), 0, channels))


def _points_to_increments(x: np.ndarray) -> np.ndarray:
    return np.diff(x, axis=1) if x.shape[1] else x


def signatures(paths: DataFrame, channels: int, depth: int, points: bool = False, column: str = "steps") -> DataFrame:
    """``paths`` with a column ``signature`` in place of ``column``; paths may differ in length.

    ``column`` holds increments, or with ``points`` the path's points. Nothing is shuffled; the batch in work is
    bounded by the size of the running sums.
    """
    keep = [c for c in paths.columns if c != column]
    schema = ", ".join([f"`{c}` {paths.schema[c].dataType.simpleString()}" for c in keep] + ["signature array<double>"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, own = batch.num_rows, np.zeros((batch.num_rows, signature_length(channels, depth)))
            for rows, x in _tensors(batch.column(len(keep)), channels):
                x = _points_to_increments(x) if points else x
                size = chen.safe_batch(len(rows), x.shape[1], channels, depth)
                for at in range(0, len(rows), size):
                    own[rows[at : at + size]] = chen.signatures(x[at : at + size], depth)
            lists = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * own.shape[1], pa.array(own.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], lists], names=[*keep, "signature"])

    return paths.select(*keep, column).mapInArrow(run, schema)


def sliding_signatures(returns: DataFrame, channels: int, depth: int, window: int = WINDOW) -> DataFrame:
    """(series, window_idx, end_date, signature) of all windows of returns, from prefixes within blocks of rows."""
    rows, _ = blocked(numbered(returns), window - 1)
    columns = [f"r_{k}" for k in range(1, channels + 1)]
    kinds = {f.name: f.dataType.simpleString() for f in returns.schema}
    schema = f"series {kinds['series']}, window_idx bigint, end_date {kinds['date']}, signature array<double>"

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("idx")
        own = np.flatnonzero(block["__own"].to_numpy() & (block["idx"].to_numpy() >= window - 1))
        x = np.stack([block[c].to_numpy() for c in columns], 1)
        found = chen.sliding(x, depth, window, own - (window - 1)) if len(own) else np.zeros((0, signature_length(channels, depth)))
        lists = pa.ListArray.from_arrays(np.arange(len(own) + 1, dtype=np.int32) * found.shape[1], pa.array(found.reshape(-1)))
        at = block.take(pa.array(own))
        return pa.table([at["series"], pa.array(at["idx"].to_numpy() - (window - 1)), at["date"], lists], names=["series", "window_idx", "end_date", "signature"])

    return rows.select("series", "__block", "__own", "idx", "date", *columns).groupBy("series", "__block").applyInArrow(run, schema)


class Moments:
    """Count, mean and sum of squared deviations of vectors, merged without cancellation."""

    def __init__(self) -> None:
        self.n, self.mean, self.m2 = 0, 0.0, 0.0

    def add(self, x: np.ndarray) -> None:
        mean = x.mean(axis=0)
        self.merge(len(x), mean, ((x - mean) ** 2).sum(axis=0))

    def merge(self, n: int, mean: np.ndarray, m2: np.ndarray) -> None:
        if not n:
            return
        both = self.n + n
        delta = mean - self.mean
        self.m2 = self.m2 + m2 + delta**2 * (self.n * n / both)
        self.mean = self.mean + delta * (n / both)
        self.n = both


PARTIAL = "process string, chunk int, n bigint, mean array<double>, m2 array<double>"


def partial_rows(process: str, own: Moments) -> Iterator[dict]:
    for chunk, at in enumerate(range(0, len(np.atleast_1d(own.mean)), CHUNK)):
        yield {"process": process, "chunk": chunk, "n": own.n, "mean": own.mean[at : at + CHUNK].tolist(), "m2": own.m2[at : at + CHUNK].tolist()}


def _merged(group: pd.DataFrame) -> Moments:
    own = Moments()
    for r in group.itertuples():
        own.merge(r.n, np.asarray(r.mean), np.asarray(r.m2))
    return own


def merge_partials(partials: DataFrame, channels: int, depth: int) -> DataFrame:
    """(process, coord, level, n_paths, mean, std): a task has sent one row a process and CHUNK coordinates.

    The rows of one process and chunk, as many as there were tasks, are merged together; chunks spread the rest.
    """

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        own = _merged(group)
        at = int(group["chunk"].iloc[0]) * CHUNK
        return pd.DataFrame({"process": group["process"].iloc[0], "coord": np.arange(at, at + len(own.mean)), "n_paths": own.n, "mean": own.mean, "std": np.sqrt(np.maximum(own.m2 / own.n, 0.0))})

    out = partials.groupBy("process", "chunk").applyInPandas(merge, "process string, coord int, n_paths bigint, mean double, std double")
    return out.select("process", "coord", level_of(F.col("coord"), channels, depth).alias("level"), "n_paths", "mean", "std")


def fewer_partials(partials: DataFrame) -> DataFrame:
    """The same as one row a process and chunk."""

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        own = _merged(group)
        return pd.DataFrame({"process": group["process"].iloc[:1], "chunk": group["chunk"].iloc[:1], "n": [own.n], "mean": [own.mean.tolist()], "m2": [own.m2.tolist()]})

    return partials.groupBy("process", "chunk").applyInPandas(merge, PARTIAL)


def partial_signatures(paths: DataFrame, channels: int, depth: int, points: bool = False) -> DataFrame:
    """PARTIAL rows from (process, steps): what each task saw of each process; no signature leaves its task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, Moments] = {}
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            for rows, x in _tensors(batch.column(1), channels):
                x = _points_to_increments(x) if points else x
                size = chen.safe_batch(len(rows), x.shape[1], channels, depth)
                for name in dict.fromkeys(names[rows]):
                    mine = x[names[rows] == name]
                    for at in range(0, len(mine), size):
                        own.setdefault(name, Moments()).add(chen.signatures(mine[at : at + size], depth))
        found = [r for name, m in own.items() for r in partial_rows(name, m)]
        if found:
            yield pa.RecordBatch.from_pylist(found, schema=_partial_schema())

    return paths.select("process", "steps").mapInArrow(run, PARTIAL)


def expected_signature(paths: DataFrame, channels: int, depth: int, points: bool = False) -> DataFrame:
    """(process, coord, level, n_paths, mean, std) from (process, steps)."""
    return merge_partials(partial_signatures(paths, channels, depth, points), channels, depth)


def _partial_schema() -> pa.Schema:
    doubles = pa.list_(pa.float64())
    return pa.schema([("process", pa.string()), ("chunk", pa.int32()), ("n", pa.int64()), ("mean", doubles), ("m2", doubles)])


def expected_signature_sql(signature_rows: DataFrame, channels: int, depth: int) -> DataFrame:
    """The same from rows (process, s_1..s_n) of the SQL form."""
    n = signature_length(channels, depth)
    means = signature_rows.groupBy("process").agg(F.count("*").alias("n_paths"), *[F.struct(F.avg(f"s_{k}").alias("mean"), F.stddev_pop(f"s_{k}").alias("std")).alias(f"m_{k}") for k in range(1, n + 1)])
    rows = means.select("process", "n_paths", F.posexplode(F.array(*[F.col(f"m_{k}") for k in range(1, n + 1)])).alias("coord", "m"))
    return rows.select("process", "coord", level_of(F.col("coord"), channels, depth).alias("level"), "n_paths", "m.mean", "m.std")


def signed_area(rows: DataFrame, channels: Sequence[str], keys: Sequence[str], order: str = "step") -> DataFrame:
    """keys, area_i_j for i < j: half the antisymmetric part of level 2, from increments."""
    ahead = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"__p{i}": F.coalesce(F.sum(c).over(ahead), F.lit(0.0)) for i, c in enumerate(channels)})
    pairs = [(i, j) for i in range(len(channels)) for j in range(i + 1, len(channels))]
    area = lambda i, j: F.sum(F.col(f"__p{i}") * F.col(channels[j]) - F.col(f"__p{j}") * F.col(channels[i])) / 2
    return rows.groupBy(*keys).agg(*[area(i, j).alias(f"area_{i + 1}_{j + 1}") for i, j in pairs])


def largest_difference(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """(max_abs_difference, agrees): two computations of the same columns held against each other."""
    both = a.alias("a").join(b.alias("b"), list(keys))
    worst = F.greatest(*[F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) for c in columns]) if len(columns) > 1 else F.abs(F.col(f"a.{columns[0]}") - F.col(f"b.{columns[0]}"))
    return both.agg(F.max(worst).alias("max_abs_difference")).withColumn("agrees", F.col("max_abs_difference") < tolerance)


