"""Baseline features of return windows, in long form: (series, window_idx, step, r_1..r_d)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("series", "window_idx", "end_date")


def flat_columns(channels: int, steps: int, prefix: str = "f_") -> list[Column]:
    """Aggregates of a window: one column a step and channel, steps outermost."""
    return [F.max(F.when(F.col("step") == s, F.col(f"r_{c}"))).alias(f"{prefix}{s * channels + c}") for s in range(steps) for c in range(1, channels + 1)]


def covariance_columns(channels: int, prefix: str = "f_") -> list[Column]:
    """Aggregates of a window: the upper triangle of its sample covariance, row by row."""
    pairs = [(i, j) for i in range(1, channels + 1) for j in range(i, channels + 1)]
    return [F.covar_samp(f"r_{i}", f"r_{j}").alias(f"{prefix}{n}") for n, (i, j) in enumerate(pairs, 1)]


def volatility_columns(channels: int, year: int = 252, prefix: str = "f_") -> list[Column]:
    """Aggregates of a window: annualised sample deviations."""
    return [(F.stddev_samp(f"r_{c}") * year**0.5).alias(f"{prefix}{c}") for c in range(1, channels + 1)]


def flat_returns(windows: DataFrame, channels: int, steps: int) -> DataFrame:
    return windows.groupBy(*KEYS).agg(*flat_columns(channels, steps))


def covariance_features(windows: DataFrame, channels: int) -> DataFrame:
    return windows.groupBy(*KEYS).agg(*covariance_columns(channels))


def volatility_features(windows: DataFrame, channels: int) -> DataFrame:
    return windows.groupBy(*KEYS).agg(*volatility_columns(channels))


def spread(df: DataFrame, column: str, n: int, prefix: str = "f_") -> DataFrame:
    """An array column as n columns."""
    return df.select(*[c for c in df.columns if c != column], *[F.col(column)[k].alias(f"{prefix}{k + 1}") for k in range(n)])


def feature_table(raw: DataFrame, z: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """Raw and standardised features side by side: name_raw_000.., name_z_000.."""
    own = raw.select(*KEYS, *[F.col(c).alias(f"{name}_raw_{k:03d}") for k, c in enumerate(columns)])
    return own.join(z.select("series", "window_idx", *[F.col(c).alias(f"{name}_z_{k:03d}") for k, c in enumerate(columns)]), ["series", "window_idx"])
