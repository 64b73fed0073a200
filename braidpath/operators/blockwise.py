"""Features and scores of windows as arrays, by one Arrow kernel a block of rows.

A block of returns has the rows ahead of it that its first windows need, so its windows' features come from array expressions over
the block: no row is copied to the windows that hold it, and what several features need is computed once. Standardising and trailing
scores take another kernel a block. In between stand the features' means and deviations over a series, which tasks sum up to one
row and each block gets once, beside its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidpath.functions import chen
from braidpath.functions.vectors import TINY
from braidpath.operators.panel import BLOCK, WINDOW, YEAR, blocked, numbered
from braidpath.operators.signature import Moments

#: From windows (n, steps, channels), the increments (rows, channels) and each window's first row, features (n, columns).
Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def flat(windows: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """All returns of a window, steps outermost."""
    return windows.reshape(len(windows), -1)


def covariance(windows: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The upper triangle of the sample covariance, row by row."""
    centred = windows - windows.mean(axis=1, keepdims=True)
    found = centred.transpose(0, 2, 1) @ centred / (windows.shape[1] - 1)
    return found[:, *np.triu_indices(windows.shape[2])]


def volatility(windows: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Annualised sample deviations."""
    return windows.std(axis=1, ddof=1) * YEAR**0.5


def signature_kernel(depth: int) -> Kernel:
    return lambda windows, rows, starts: chen.sliding(rows, depth, windows.shape[1], starts)


def window_features(returns: DataFrame, channels: int, kernels: Mapping[str, Kernel], window: int = WINDOW) -> DataFrame:
    """(series, window_idx, end_date, features), for each window one row a kernel.

    With several kernels the series is named ``<series>|<kernel>``; with one it keeps its name.
    """
    rows, _ = blocked(numbered(returns), window - 1)
    columns, kinds = [f"r_{k}" for k in range(1, channels + 1)], {f.name: f.dataType.simpleString() for f in returns.schema}
    one = len(kernels) == 1

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("idx")
        idx = block["idx"].to_numpy()
        at = np.flatnonzero(block["__own"].to_numpy() & (idx >= window - 1))
        names = ["series", "window_idx", "end_date", "features"]
        x = np.stack([block[c].to_numpy() for c in columns], 1)
        if not len(at):
            return pa.table([block["series"].slice(0, 0), pa.array([], pa.int64()), block["date"].slice(0, 0), pa.array([], pa.list_(pa.float64()))], names=names)
        starts = at - (window - 1)
        windows = np.lib.stride_tricks.sliding_window_view(x, window, axis=0)[starts].transpose(0, 2, 1)
        parts = []
        for name, kernel in kernels.items():
            found = kernel(windows, x, starts)
            lists = pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * found.shape[1], pa.array(found.reshape(-1)))
            own = block.take(pa.array(at))
            series = own["series"] if one else pa.array([f"{s}|{name}" for s in own["series"].to_pylist()])
            parts.append(pa.table([series, pa.array(idx[starts]), own["date"], lists], names=names))
        return pa.concat_tables(parts)

    schema = f"series {kinds['series'] if one else 'string'}, window_idx bigint, end_date {kinds['date']}, features array<double>"
    return rows.filter("series is not null").select("series", "__block", "__own", "idx", "date", *columns).groupBy("series", "__block").applyInArrow(run, schema)


def together(*kernels: Kernel) -> Kernel:
    """Several features side by side."""
    return lambda *args: np.concatenate([k(*args) for k in kernels], axis=1)


def _array(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    flat_values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat_values.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _stats(dealt: DataFrame, kind: str, size: int) -> DataFrame:
    """(series, __block, mean, std): of each series' own rows, copied to its blocks."""
    lists = pa.list_(pa.float64())

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[object, tuple[Moments, int]] = {}
        for batch in batches:
            batch = batch.filter(batch["__own"])
            if not batch.num_rows:
                continue
            x, idx = _array(batch["features"], batch.num_rows), batch["window_idx"].to_numpy()
            coded = batch["series"].dictionary_encode()
            for code, name in enumerate(coded.dictionary.to_pylist()):
                mine = coded.indices.to_numpy() == code
                moments, last = own.get(name, (Moments(), -1))
                moments.add(x[mine])
                own[name] = (moments, max(last, int(idx[mine].max())))
        for name, (m, last) in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([m.n]), pa.array([m.mean.tolist()], lists), pa.array([m.m2.tolist()], lists), pa.array([last])], names=["series", "n", "mean", "m2", "last"])

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        own = Moments()
        for r in group.itertuples():
            own.merge(r.n, np.asarray(r.mean), np.asarray(r.m2))
        return pd.DataFrame({"series": group["series"].iloc[:1], "mean": [own.mean.tolist()], "std": [np.sqrt(own.m2 / own.n).tolist()], "last": [int(group["last"].max())]})

    found = dealt.mapInArrow(partial, f"series {kind}, n bigint, mean array<double>, m2 array<double>, last bigint")
    found = found.groupBy("series").applyInPandas(merge, f"series {kind}, mean array<double>, std array<double>, last bigint")
    return found.select("series", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("last") / size))).alias("__block"), "mean", "std")


def array_scores(table: DataFrame, scores: Mapping[str, tuple[int, int]], lookback: int, consecutive: Mapping[str, tuple[int, int]] | None = None) -> DataFrame:
    """(series, window_idx, end_date, one column a score) from (series, window_idx, end_date, features).

    A score is the distance of a stretch of the standardised features, from its first place to the one after its last, to their mean
    over the ``lookback`` windows before, null for the first ones; those of ``consecutive`` are distances to the window before.
    """
    before, kinds = max(lookback if scores else 1, 1), {f.name: f.dataType.simpleString() for f in table.schema}
    size = max(BLOCK, 8 * before)
    rows, _ = blocked(table.filter("series is not null and window_idx is not null"), before, "window_idx", size)
    dealt = rows.select("series", "__block", "__own", "window_idx", "end_date", "features").repartition("series", "__block")
    names = [*scores, *(consecutive or {})]

    def column(values: np.ndarray) -> pa.Array:
        return pa.array(values, mask=np.isnan(values))

    def run(block: pa.Table, stats: pa.Table) -> pa.Table:
        block = block.sort_by("window_idx")
        n, own = block.num_rows, block["__own"].to_numpy() if block.num_rows else np.zeros(0, bool)
        out = {}
        if n:
            std = _array(stats["std"], 1)
            z = (_array(block["features"], n) - _array(stats["mean"], 1)) / np.where(std > TINY, std, 1.0)
            up_to = np.vstack([np.zeros(z.shape[1]), np.cumsum(z, axis=0)])
            at = np.flatnonzero(np.arange(n) >= lookback)
            away = z[at] - (up_to[at] - up_to[at - lookback]) / lookback
            step = np.diff(z, axis=0)
            for name, (a, b) in scores.items():
                out[name] = np.full(n, np.nan)
                out[name][at] = np.sqrt((away[:, a:b] ** 2).sum(axis=1))
            for name, (a, b) in (consecutive or {}).items():
                out[name] = np.concatenate([[np.nan], np.sqrt((step[:, a:b] ** 2).sum(axis=1))])
        own = pa.array(own)
        kept = block.select(["series", "window_idx", "end_date"]).filter(own)
        values = [column(out[c][own.to_numpy(zero_copy_only=False)]) if n else pa.array([], pa.float64()) for c in names]
        return pa.table([*kept.columns, *values], names=["series", "window_idx", "end_date", *names])

    schema = f"series {kinds['series']}, window_idx bigint, end_date {kinds['end_date']}, " + ", ".join(f"`{c}` double" for c in names)
    facts = _stats(dealt, kinds["series"], size)
    return dealt.groupBy("series", "__block").cogroup(facts.groupBy("series", "__block")).applyInArrow(run, schema)
