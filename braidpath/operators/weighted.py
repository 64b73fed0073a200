"""Exponentially weighted path features: clocks, decayed increments, displacement, signed areas, path statistics.

A window's path starts at zero and is augmented by a clock from 0 to 1, linear in the steps or in the length moved.
The increment of a step weighs exp(-alpha (1 - clock at its beginning)), so alpha 0 leaves it as it is.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from braidpath.functions.vectors import TINY, norm, safe
from braidpath.operators import blockwise, scoring
from braidpath.operators.panel import WINDOW
from braidpath.sources.staging import stage

ALPHAS = (0.0, 0.15, 0.35, 0.70, 1.20)
CLOCKS = ("linear", "movement")
KEYS = ("series", "window_idx", "end_date")
STATISTICS = ("total_length", "mean_length", "std_length", "min_length", "max_length", "displacement_norm", "straightness", "mean_squared_length", "mean_length_change")


def with_clocks(windows: DataFrame, channels: int, kinds: Sequence[str]) -> DataFrame:
    """``windows`` with clocks, a map from a kind to the clock at the begin and the end of each step."""
    if unknown := set(kinds) - set(CLOCKS):
        raise ValueError(f"a clock is one of {CLOCKS}, not {unknown}")
    window = Window.partitionBy("series", "window_idx")
    n = F.count("*").over(window)
    ordered = window.orderBy("step")
    length = norm([F.col(f"r_{c}") for c in range(1, channels + 1)])
    moved = lambda to: F.coalesce(F.sum("__length").over(ordered.rowsBetween(Window.unboundedPreceding, to)), F.lit(0.0))
    whole = safe(F.sum("__length").over(window))
    ends = {"linear": (F.col("step") / n, (F.col("step") + 1) / n), "movement": (moved(-1) / whole, moved(0) / whole)}
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), ends[k][0].alias("clock"), ends[k][1].alias("clock_end")) for k in kinds])
    return windows.withColumn("__length", length).withColumn("clocks", pairs).drop("__length")


def clocked(windows: DataFrame, channels: int, kind: str) -> DataFrame:
    """``windows`` with the clock at the begin (clock) and end (clock_end) of each step."""
    timed = with_clocks(windows, channels, [kind])
    return timed.select(*windows.columns, F.col("clocks")[0]["clock"].alias("clock"), F.col("clocks")[0]["clock_end"].alias("clock_end"))


def weighted_increments(clocked_windows: DataFrame, channels: int, alpha: float | Column) -> DataFrame:
    """(keys, step, w_1..w_d+1): decayed increments, the clock's own last; ``alpha`` may be a column."""
    last = F.max("clock_end").over(Window.partitionBy("series", "window_idx"))
    decay = -alpha if isinstance(alpha, Column) else F.lit(-alpha)
    x = clocked_windows.withColumn("__weight", F.exp(decay * (last - F.col("clock"))))
    own = [F.col(f"r_{c}") for c in range(1, channels + 1)] + [F.col("clock_end") - F.col("clock")]
    return x.select(*KEYS, "step", *[(F.col("__weight") * v).alias(f"w_{k}") for k, v in enumerate(own, 1)])


def _statistics(weighted: DataFrame, n: int, areas: bool) -> DataFrame:
    """One aggregation a window: summed increments, STATISTICS, and if asked for the signed areas."""
    columns = [f"w_{k}" for k in range(1, n + 1)]
    ordered = Window.partitionBy("series", "window_idx").orderBy("step")
    ahead = ordered.rowsBetween(Window.unboundedPreceding, -1)
    x = weighted.withColumn("l", norm([F.col(c) for c in columns]))
    x = x.withColumns({"change": F.abs(F.col("l") - F.lag("l").over(ordered))} | ({f"__p{k}": F.coalesce(F.sum(c).over(ahead), F.lit(0.0)) for k, c in enumerate(columns, 1)} if areas else {}))
    pairs = [(i, j) for i in range(1, n + 1) for j in range(i + 1, n + 1)] if areas else []
    out = x.groupBy(*KEYS).agg(
        *[F.sum(c).alias(f"d_{k}") for k, c in enumerate(columns, 1)],
        F.sum("l").alias("total_length"),
        F.avg("l").alias("mean_length"),
        F.stddev_pop("l").alias("std_length"),
        F.min("l").alias("min_length"),
        F.max("l").alias("max_length"),
        F.avg(F.col("l") * F.col("l")).alias("mean_squared_length"),
        F.coalesce(F.avg("change"), F.lit(0.0)).alias("mean_length_change"),
        *[(F.sum(F.col(f"__p{i}") * F.col(f"w_{j}") - F.col(f"__p{j}") * F.col(f"w_{i}")) / 2).alias(f"area_{i}_{j}") for i, j in pairs],
    )
    out = out.withColumn("displacement_norm", norm([F.col(f"d_{k}") for k in range(1, n + 1)]))
    return out.withColumn("straightness", F.col("displacement_norm") / safe(F.col("total_length")))


def path_statistics(weighted: DataFrame, n: int) -> DataFrame:
    """(keys, w_1..w_n summed, STATISTICS) of weighted increments."""
    return _statistics(weighted, n, False).select(*KEYS, *[f"d_{k}" for k in range(1, n + 1)], *STATISTICS)


def features_of(weighted: DataFrame, n: int) -> DataFrame:
    """(keys, f_1..f_m) of weighted increments of n channels: displacement, signed areas, statistics, in that order."""
    names = [f"d_{k}" for k in range(1, n + 1)] + [f"area_{i}_{j}" for i in range(1, n + 1) for j in range(i + 1, n + 1)] + list(STATISTICS)
    return _statistics(weighted, n, True).select(*KEYS, *[F.col(c).alias(f"f_{k}") for k, c in enumerate(names, 1)])


def weighted_features(windows: DataFrame, channels: int, alpha: float, kind: str) -> DataFrame:
    return features_of(weighted_increments(clocked(windows, channels, kind), channels, alpha), channels + 1)


def feature_count(channels: int) -> int:
    n = channels + 1
    return n + n * (n - 1) // 2 + len(STATISTICS)


def weighted_kernel(alpha: float, kind: str) -> blockwise.Kernel:
    """The same features from windows as arrays."""
    if kind not in CLOCKS:
        raise ValueError(f"a clock is one of {CLOCKS}, not {kind}")

    def run(windows: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
        n, steps, _ = windows.shape
        if kind == "linear":
            clock = np.broadcast_to(np.arange(steps + 1) / steps, (n, steps + 1))
        else:
            moved = np.concatenate([np.zeros((n, 1)), np.cumsum(np.linalg.norm(windows, axis=2), axis=1)], axis=1)
            clock = moved / np.where(moved[:, -1:] > TINY, moved[:, -1:], 1.0)
        weight = np.exp(-alpha * (clock[:, -1:] - clock[:, :-1]))
        w = weight[:, :, None] * np.concatenate([windows, np.diff(clock, axis=1)[:, :, None]], axis=2)
        length, whole = np.linalg.norm(w, axis=2), w.sum(axis=1)
        ahead = np.cumsum(w, axis=1) - w
        level = ahead.transpose(0, 2, 1) @ w
        areas = ((level - level.transpose(0, 2, 1)) / 2)[:, *np.triu_indices(w.shape[2], 1)]
        total, displaced = length.sum(axis=1), np.linalg.norm(whole, axis=1)
        change = np.abs(np.diff(length, axis=1)).mean(axis=1) if steps > 1 else np.zeros(n)
        stats = [total, length.mean(axis=1), length.std(axis=1), length.min(axis=1), length.max(axis=1), displaced, displaced / np.where(total > TINY, total, 1.0), (length**2).mean(axis=1), change]
        return np.concatenate([whole, areas, np.stack(stats, 1)], axis=1)

    return run


def score_configuration(returns: DataFrame, channels: int, alpha: float, kind: str, window: int = WINDOW, lookback: int = scoring.LOOKBACK) -> DataFrame:
    """(series, window_idx, end_date, score) of one weighting of all windows of returns."""
    table = blockwise.window_features(returns, channels, {"own": weighted_kernel(alpha, kind)}, window)
    return blockwise.array_scores(table, {"score": (0, feature_count(channels))}, lookback)


def grid_search(returns: DataFrame, channels: int, periods: Sequence[tuple[str, str, str]], alphas: Sequence[float] = ALPHAS, clocks: Sequence[str] = CLOCKS, focus: str | None = None, window: int = WINDOW, lookback: int = scoring.LOOKBACK) -> DataFrame:
    """A row a weighting, best first: the mean over the periods of mean score by overall median, and its best episode.

    The weightings become part of the series' name: a block of returns gives its windows' features under each of them, and one plan
    scores all. ``focus`` names the period whose ratio breaks ties and is reported.
    """
    focus = focus or periods[0][0]
    kernels = {f"{float(a)!r}|{c}": weighted_kernel(a, c) for a in alphas for c in clocks}
    table = blockwise.window_features(returns, channels, kernels, window)
    if len(kernels) == 1:
        table = table.withColumn("series", F.concat_ws("|", "series", F.lit(next(iter(kernels)))))
    scored = blockwise.array_scores(table, {"score": (0, feature_count(channels))}, lookback)
    # the periods are few and literal: each is a conditional mean of the one aggregation
    means = {f"__m{k}": F.avg(F.when(F.col("end_date").between(F.to_date(F.lit(a)), F.to_date(F.lit(b))), F.col("score"))) for k, (_, a, b) in enumerate(periods)}
    peak = F.max(F.struct(F.col("score").alias("s"), (-F.col("window_idx")).alias("i"), F.col("end_date").alias("d")))
    scored = stage(scored, "grid-scores")
    tops = scored.groupBy("series").agg(peak.alias("peak"), *[m.alias(n) for n, m in means.items()])
    tops = tops.join(scoring.thresholds(scored, "score", 0.5).withColumnRenamed("threshold", "global_median_score"), "series", "left")
    ratios = F.filter(F.array(*[F.try_divide(n, "global_median_score") for n in means]), lambda r: r.isNotNull())
    tops = tops.withColumn("mean_stress_ratio", F.try_divide(F.aggregate(ratios, F.lit(0.0), lambda s, r: s + r), F.size(ratios)))
    focus_ratio = F.try_divide(f"__m{[p for p, _, _ in periods].index(focus)}", "global_median_score")
    part = [F.regexp_extract("series", r"^(.*)\|([^|]*)\|([^|]*)$", k) for k in (1, 2, 3)]
    return tops.select(
        part[0].alias("series"), part[1].cast("double").alias("alpha"), part[2].alias("clock_type"), F.lit(feature_count(channels)).alias("feature_dim"), "global_median_score",
        "mean_stress_ratio", focus_ratio.alias("focus_ratio"), F.col("mean_stress_ratio").alias("objective_score"), F.col("peak.d").alias("top_episode_peak_date"), F.col("peak.s").alias("top_episode_peak_score"),
    ).orderBy(F.desc("objective_score"), F.desc("focus_ratio"))
