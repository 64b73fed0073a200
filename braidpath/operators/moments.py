"""Classical moments of increments and endpoints, in the population and sample forms that each table asks for."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from braidpath.functions.vectors import total

#: From so many channels on, co-moments come from matrix products in Arrow batches rather than an aggregate a pair. Both ways
#: take each pair over the rows that have both, so the number of channels changes no result.
WIDE = 6
#: Channels of a tile: co-moments travel as tiles of the matrix, one row each.
TILE = 32
#: Tiles that a task holds at once; matrices of more are summed in several passes over the rows.
TILES_AT_ONCE = 2_048


def sample_moments(rows: DataFrame, columns: Sequence[str], by: str = "process") -> DataFrame:
    """(by, channel, n, mean, variance, skewness, excess_kurtosis): all with the population denominator."""
    if len(columns) > WIDE:
        # a row a channel, so that the aggregates stay few; tasks send one row a process and channel
        long = rows.select(F.col(by), *columns).unpivot([by], list(columns), "channel", "x")
        return long.groupBy(by, "channel").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("variance"), F.skewness("x").alias("skewness"), F.kurtosis("x").alias("excess_kurtosis"))
    names = [f"__m_{c}" for c in columns]
    stats = [F.struct(F.lit(c).alias("channel"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.var_pop(c).alias("variance"), F.skewness(c).alias("skewness"), F.kurtosis(c).alias("excess_kurtosis")).alias(n) for c, n in zip(columns, names)]
    return rows.groupBy(by).agg(*stats).select(by, F.explode(F.array(*names)).alias("m")).select(by, "m.*")


def covariances(rows: DataFrame, columns: Sequence[str], by: str = "process", sample: bool = False) -> DataFrame:
    """(by, i, j, covariance) of every pair of columns, both orders, i and j from 1: each over the rows that have both.

    Null where no row has both, or for the sample form only one.
    """
    if len(columns) > WIDE:
        found = co_moments(rows, columns, by)
        value = F.when(F.col("n") > int(sample), F.col("co") / (F.col("n") - int(sample)))
        own = found.select(by, "i", "j", value.alias("covariance"))
        return own.unionByName(own.filter("i < j").select(by, F.col("j").alias("i"), F.col("i").alias("j"), "covariance"))
    cov = F.covar_samp if sample else F.covar_pop
    d = len(columns)
    own = {(i, j): cov(columns[i], columns[j]).alias(f"__c_{i}_{j}") for i in range(d) for j in range(i, d)}
    cells = [F.struct(F.lit(i + 1).alias("i"), F.lit(j + 1).alias("j"), F.col(f"__c_{min(i, j)}_{max(i, j)}").alias("covariance")) for i in range(d) for j in range(d)]
    return rows.groupBy(by).agg(*own.values()).select(by, F.explode(F.array(*cells)).alias("c")).select(by, "c.*")


class PairMoments:
    """Of each pair of a left and a right channel, over the rows that have both: count, means and co-moment, merged without cancellation."""

    def __init__(self, n: np.ndarray, left: np.ndarray, right: np.ndarray, co: np.ndarray) -> None:
        self.n, self.left, self.right, self.co = n, left, right, co

    @classmethod
    def of(cls, x: np.ndarray, has_x: np.ndarray, y: np.ndarray, has_y: np.ndarray) -> PairMoments:
        """From rows of left and right channels, and which of them are there."""
        a, b = has_x.astype(float), has_y.astype(float)
        at_x, at_y = (np.where(h, v, 0.0).sum(axis=0) / np.maximum(h.sum(axis=0), 1) for v, h in ((x, has_x), (y, has_y)))
        x, y = np.where(has_x, x - at_x, 0.0), np.where(has_y, y - at_y, 0.0)
        n = a.T @ b
        some = np.maximum(n, 1.0)
        left, right = (x.T @ b) / some, (a.T @ y) / some
        return cls(n, left + at_x[:, None], right + at_y[None, :], x.T @ y - n * left * right)

    def merge(self, other: PairMoments) -> None:
        n = self.n + other.n
        share = other.n / np.maximum(n, 1.0)
        left, right = other.left - self.left, other.right - self.right
        self.co = self.co + other.co + np.where((self.n > 0) & (other.n > 0), left * right * self.n * share, 0.0)
        self.left, self.right = (np.where(self.n > 0, mine + d * share, theirs) for mine, d, theirs in ((self.left, left, other.left), (self.right, right, other.right)))
        self.n = n


def _tile_pairs(d: int) -> list[tuple[int, int]]:
    tiles = range(-(-d // TILE))
    return [(i, j) for i in tiles for j in tiles if i <= j]


def co_moments(rows: DataFrame, columns: Sequence[str], by: str = "process") -> DataFrame:
    """(by, i, j, n, mean_i, mean_j, co) for i <= j from 1: co-moments of each pair over the rows that have both.

    A task sends one row for each process and tile of the matrix; tiles merge by themselves. Neither a row nor a task holds
    the whole matrix of many channels.
    """
    d, kind = len(columns), rows.schema[by].dataType.simpleString()
    pairs, names = _tile_pairs(d), ["tile_i", "tile_j", "n", "left", "right", "co"]
    lists = pa.list_(pa.float64())

    def partials(own_pairs: list[tuple[int, int]]) -> DataFrame:
        needed = sorted({t for p in own_pairs for t in p})
        at = {t: k for k, t in enumerate(needed)}

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own: dict[object, dict[tuple[int, int], PairMoments]] = {}
            for batch in batches:
                keys = batch.column(0).dictionary_encode(null_encoding="encode")
                codes = keys.indices.to_numpy()
                x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], 1)
                has = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns[1:]], 1)
                for code, key in enumerate(keys.dictionary.to_pylist()):
                    mine = codes == code
                    tiles = [(x[mine, k * TILE : (k + 1) * TILE], has[mine, k * TILE : (k + 1) * TILE]) for k in range(len(needed))]
                    held = own.setdefault(key, {})
                    for i, j in own_pairs:
                        found = PairMoments.of(*tiles[at[i]], *tiles[at[j]])
                        if (i, j) in held:
                            held[i, j].merge(found)
                        else:
                            held[i, j] = found
            for key, held in own.items():
                for (i, j), m in held.items():
                    values = [pa.array([v.reshape(-1).tolist()], lists) for v in (m.n, m.left, m.right, m.co)]
                    yield pa.RecordBatch.from_arrays([pa.array([key], key_type), pa.array([i], pa.int32()), pa.array([j], pa.int32()), *values], names=[by, *names])

        used = [c for t in needed for c in columns[t * TILE : (t + 1) * TILE]]
        own = rows.select(by, *[F.col(c).cast("double").alias(c) for c in used])
        key_type = to_arrow_type(rows.schema[by].dataType)
        return own.mapInArrow(run, f"`{by}` {kind}, tile_i int, tile_j int, " + ", ".join(f"{c} array<double>" for c in names[2:]))

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        i, j = int(group["tile_i"].iloc[0]), int(group["tile_j"].iloc[0])
        shape = (min(TILE, d - i * TILE), min(TILE, d - j * TILE))
        own = None
        for r in group.itertuples():
            other = PairMoments(*(np.asarray(v, float).reshape(shape) for v in (r.n, r.left, r.right, r.co)))
            own = own.merge(other) or own if own else other
        left, right = np.indices(shape)
        out = {"i": left + i * TILE + 1, "j": right + j * TILE + 1, "n": own.n.astype(np.int64), "mean_i": own.left, "mean_j": own.right, "co": own.co}
        return pd.DataFrame({by: group[by].iloc[0]} | {c: v.reshape(-1) for c, v in out.items()}).query("i <= j")

    found = partials(pairs[:TILES_AT_ONCE])
    for at in range(TILES_AT_ONCE, len(pairs), TILES_AT_ONCE):
        found = found.unionByName(partials(pairs[at : at + TILES_AT_ONCE]))
    return found.groupBy(by, "tile_i", "tile_j").applyInPandas(merge, f"`{by}` {kind}, i int, j int, n bigint, mean_i double, mean_j double, co double")


def means(rows: DataFrame, columns: Sequence[str], by: str = "process") -> DataFrame:
    """(by, i, mean): the mean of each column over the rows that have it, i from 1."""
    if len(columns) > WIDE:
        long = rows.select(by, *columns).unpivot([by], list(columns), "__column", "x")
        place = F.create_map(*[v for k, c in enumerate(columns, 1) for v in (F.lit(c), F.lit(k))])
        return long.groupBy(by, "__column").agg(F.avg("x").alias("mean")).select(by, place[F.col("__column")].alias("i"), "mean")
    cells = [F.struct(F.lit(k).alias("i"), F.col(f"__m{k}").alias("mean")) for k in range(1, len(columns) + 1)]
    return rows.groupBy(by).agg(*[F.avg(c).alias(f"__m{k}") for k, c in enumerate(columns, 1)]).select(by, F.explode(F.array(*cells)).alias("c")).select(by, "c.*")


def endpoints(paths: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("process", "series"), order: str = "step") -> DataFrame:
    """The last point of each path."""
    return paths.groupBy(*keys).agg(*[F.max_by(c, order).alias(c) for c in columns])


def process_summary(paths: DataFrame, steps: DataFrame, columns: Sequence[str], by: str = "process") -> DataFrame:
    """Of each process: mean vectors and covariance matrices of endpoints and of increments, and their norms.

    (by, terminal_mean, terminal_cov, increment_mean, increment_cov: arrays, matrices row by row;
    terminal_mean_norm, avg_terminal_variance, avg_increment_variance)
    """
    d = len(columns)
    if d > WIDE:
        return vector_summary(endpoints(paths, columns, (by, "series")), steps, columns, by)

    def of(rows: DataFrame, name: str) -> DataFrame:
        means = F.array(*[F.avg(c) for c in columns]).alias(f"{name}_mean")
        cov = F.array(*[F.covar_pop(columns[min(i, j)], columns[max(i, j)]) for i in range(d) for j in range(d)]).alias(f"{name}_cov")
        return rows.groupBy(by).agg(means, cov)

    return _with_norms(of(endpoints(paths, columns, (by, "series")), "terminal").join(of(steps, "increment"), by), d)


def _with_norms(both: DataFrame, d: int) -> DataFrame:
    diagonal = lambda name: total([F.col(f"{name}_cov")[i * d + i] for i in range(d)]) / d
    norm = F.sqrt(F.aggregate("terminal_mean", F.lit(0.0), lambda s, x: s + x * x))
    return both.withColumns({"terminal_mean_norm": norm, "avg_terminal_variance": diagonal("terminal"), "avg_increment_variance": diagonal("increment")})


class VectorMoments:
    """Count, mean vector and matrix of co-moments, merged without cancellation."""

    def __init__(self, d: int) -> None:
        self.n, self.mean, self.co = 0, np.zeros(d), np.zeros((d, d))

    def add(self, x: np.ndarray) -> None:
        mean = x.mean(axis=0)
        centred = x - mean
        self.merge(len(x), mean, centred.T @ centred)

    def merge(self, n: int, mean: np.ndarray, co: np.ndarray) -> None:
        if not n:
            return
        both = self.n + n
        delta = mean - self.mean
        self.co = self.co + co + np.outer(delta, delta) * (self.n * n / both)
        self.mean = self.mean + delta * (n / both)
        self.n = both

    def row(self, process: str, kind: str) -> dict:
        return {"process": process, "kind": kind, "n": self.n, "mean": self.mean.tolist(), "co": self.co.reshape(-1).tolist()}


VECTOR_PARTIAL = "process string, kind string, n bigint, mean array<double>, co array<double>"
VECTOR_SCHEMA = pa.schema([("process", pa.string()), ("kind", pa.string()), ("n", pa.int64()), ("mean", pa.list_(pa.float64())), ("co", pa.list_(pa.float64()))])


def summarised(partials: DataFrame, d: int) -> DataFrame:
    """Partial moments of kinds ``terminal`` and ``increment`` merged to the table of ``process_summary``."""

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        own = VectorMoments(d)
        for r in group.itertuples():
            own.merge(r.n, np.asarray(r.mean), np.asarray(r.co).reshape(d, d))
        return pd.DataFrame({"process": group["process"].iloc[:1], "kind": group["kind"].iloc[:1], "mean": [own.mean.tolist()], "cov": [(own.co / own.n).reshape(-1).tolist()]})

    merged = partials.groupBy("process", "kind").applyInPandas(merge, "process string, kind string, mean array<double>, cov array<double>")
    side = lambda kind: merged.filter(F.col("kind") == kind).select("process", F.col("mean").alias(f"{kind}_mean"), F.col("cov").alias(f"{kind}_cov"))
    return _with_norms(side("terminal").join(side("increment"), "process"), d)


def vector_summary(ends: DataFrame, steps: DataFrame, columns: Sequence[str], by: str = "process") -> DataFrame:
    """``process_summary`` of many channels; the matrices, summed by tiles, are put together here, as its rows hold them whole."""

    def of(rows: DataFrame, name: str) -> DataFrame:
        listed = lambda df, value, *place: df.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct(*place, value))), lambda r: r[value]).alias(f"{name}_{value}"))
        own = listed(means(rows, columns, by), "mean", "i")
        cov = listed(covariances(rows, columns, by), "covariance", "i", "j")
        return own.join(cov.withColumnRenamed(f"{name}_covariance", f"{name}_cov"), by)

    return _with_norms(of(ends, "terminal").join(of(steps, "increment"), by), len(columns))
