"""Anomaly scores of windows: standardised features, distances to the recent past, episodes, periods, rankings.

Not scored is null, never NaN. Standardisation uses the whole sample, so it looks ahead; a live score would fix the
means first. ``window_idx`` numbers the windows of a series from 0 without gaps. What needs a whole series (means,
quantiles) is aggregated to one row and joined back; what looks back works on blocks of windows with the rows before.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from braidpath.functions.vectors import norm, safe
from braidpath.operators.intervals import interval_join
from braidpath.operators.panel import BLOCK, blocked, with_facts
from braidpath.operators.selection import quantiles
from braidpath.sources.staging import stage

LOOKBACK, QUANTILE, TOP = 60, 0.95, 15


def standardise(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each feature minus its mean over the series, divided by its population deviation, or by 1 where it is constant.

    The features are dealt out by blocks of windows once, which both the aggregation and the rows then read.
    """
    keep = [c for c in features.columns if c not in set(columns)]
    dealt = features.withColumn("__home", F.floor(F.col("window_idx") / BLOCK)).filter("series is not null and __home is not null").repartition("series", "__home").drop("__home")
    # the struct keeps all columns in use on this side too, so that both sides share one exchange
    last = F.max(F.struct("window_idx", *[c for c in keep if c not in ("series", "window_idx")]))["window_idx"].alias("__last")
    stats = dealt.groupBy("series").agg(*[F.avg(c).alias(f"__a_{c}") for c in columns], *[F.stddev_pop(c).alias(f"__s_{c}") for c in columns], last)
    both = with_facts(dealt, stats)
    return both.select(*keep, *[((F.col(c) - F.col(f"__a_{c}")) / safe(F.col(f"__s_{c}"))).alias(c) for c in columns])


def trailing_scores(features: DataFrame, groups: Mapping[str, Sequence[str]], lookback: int = LOOKBACK, consecutive: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """(series, window_idx, end_date, one score a group of columns), all from one ordering of the windows.

    A score is the distance to the mean of the ``lookback`` windows before, null for the first ones; those of
    ``consecutive`` are distances to the window before, null for the first. The means are differences of running sums
    within a block.
    """
    x, order = blocked(features, max(lookback if groups else 1, 1), "window_idx")
    up_to = order.rowsBetween(Window.unboundedPreceding, -1)
    own = [c for g in groups.values() for c in g]
    x = x.withColumns({f"__t_{c}": F.sum(c).over(up_to) for c in own} | {"__at": F.row_number().over(order)})
    x = x.withColumns({f"__o_{c}": F.coalesce(F.lag(f"__t_{c}", lookback).over(order), F.lit(0.0)) for c in own} | {f"__b_{c}": F.lag(c).over(order) for g in (consecutive or {}).values() for c in g})
    away = lambda c: F.col(c) - (F.col(f"__t_{c}") - F.col(f"__o_{c}")) / lookback
    scores = [F.when(F.col("__at") > lookback, norm([away(c) for c in g])).alias(n) for n, g in groups.items()]
    scores += [norm([F.col(c) - F.col(f"__b_{c}") for c in g]).alias(n) for n, g in (consecutive or {}).items()]
    return x.filter("__own").select("series", "window_idx", "end_date", *scores)


def trailing_score(features: DataFrame, columns: Sequence[str], name: str = "score", lookback: int = LOOKBACK) -> DataFrame:
    """The one score of all ``columns``."""
    return trailing_scores(features, {name: columns}, lookback)


def require_scored(features: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    if features.groupBy("series").count().filter(F.col("count") <= lookback).isEmpty():
        return features
    raise ValueError(f"a series has no more than {lookback} windows")


def consecutive_distance(features: DataFrame, columns: Sequence[str], name: str = "distance") -> DataFrame:
    """(series, window_idx, end_date, name): distance to the window before, null for the first."""
    return trailing_scores(features, {}, consecutive={name: columns})


def score_table(tables: Sequence[DataFrame]) -> DataFrame:
    """Score tables of the same windows side by side, matched by window rather than by position."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t.drop("end_date"), ["series", "window_idx"])
    return out


def thresholds(scores: DataFrame, score: str, quantile: float = QUANTILE) -> DataFrame:
    """(series, threshold): the exact interpolated quantile of the scored rows; no task gets a series."""
    return quantiles(scores, score, [quantile], names=["threshold"])


#: Runs are merged over cells of so many windows, and at last over the whole series.
CELLS = (BLOCK, BLOCK**2)


def _joined_runs(runs: DataFrame, cell: Column) -> DataFrame:
    """Runs of a cell that touch become one."""
    by = Window.partitionBy("series", "__cell").orderBy("first")
    apart = F.coalesce((F.lag("last").over(by) + 1 != F.col("first")).cast("int"), F.lit(1))
    rows = runs.withColumn("__cell", cell).withColumn("__apart", apart).withColumn("__run", F.sum("__apart").over(by))
    merged = [F.min("first").alias("first"), F.max("last").alias("last"), F.min("begin").alias("begin"), F.max("end").alias("end"), F.max("peak").alias("peak"), F.sum("n").alias("n"), F.first("threshold").alias("threshold")]
    return rows.groupBy("series", "__cell", "__run").agg(*merged).drop("__cell", "__run")


def episodes(scores: DataFrame, score: str, quantile: float = QUANTILE) -> DataFrame:
    """Runs of adjacent windows at or above the threshold, the first peak on ties, highest first.

    Runs merge like intervals, by a tree over the windows' numbers: first within blocks, then those that touch an edge of
    their cell with their neighbours in the next larger cell. A run inside its cell is whole, and is alone from there on,
    so no task orders the runs of a series, only those that reach an edge: two a cell.
    """
    scored = stage(scores.select("series", "window_idx", "end_date", F.col(score).alias("s")), "episode-scores")
    limits = thresholds(scored, "s", quantile).join(scored.groupBy("series").agg(F.max("window_idx").alias("__last")), "series")
    high = with_facts(scored, limits).filter(F.col("s") >= F.col("threshold"))
    peak = F.struct("s", (-F.col("window_idx")).alias("i"), F.col("end_date").alias("d")).alias("peak")
    runs = high.select("series", F.col("window_idx").alias("first"), F.col("window_idx").alias("last"), F.col("end_date").alias("begin"), F.col("end_date").alias("end"), peak, F.lit(1).cast("bigint").alias("n"), "threshold")
    runs = _joined_runs(runs, F.floor(F.col("first") / BLOCK))
    for size, larger in zip(CELLS, [*CELLS[1:], None]):
        touches = (F.col("first") % size == 0) | ((F.col("last") + 1) % size == 0)
        cell = F.floor(F.col("first") / larger) if larger else F.lit(0).cast("bigint")
        runs = _joined_runs(runs, F.when(touches, cell).otherwise(-1 - F.col("first")))
    return runs.select("series", F.col("begin").alias("episode_start"), F.col("end").alias("episode_end"), F.col("peak.d").alias("peak_date"), F.col("peak.s").alias("peak_score"), F.col("n").alias("duration_windows"), "threshold").orderBy(F.desc("peak_score"), "episode_start")


def period_summary(scores: DataFrame, score: str, periods: DataFrame | Sequence[tuple[str, str, str]]) -> DataFrame:
    """Of each inclusive date range with windows: how many, mean, max, median, and the mean against the median of all.

    ``periods`` is a table (period, start_date, end_date), or a literal list of such rows; a window counts for each range
    that holds it.
    """
    if not isinstance(periods, DataFrame):
        periods = scores.sparkSession.createDataFrame([tuple(p) for p in periods], "period string, start_date string, end_date string")
    periods = periods.select("period", F.to_date("start_date").alias("start_date"), F.to_date("end_date").alias("end_date"))
    scored = stage(scores.select("series", F.col("end_date").alias("at"), F.col(score).alias("s")), "period-scores")
    inside = stage(interval_join(scored, periods, ("at", "at"), ("start_date", "end_date")), "period-windows")
    by = ["series", "period", "start_date", "end_date"]
    out = inside.groupBy(*by).agg(F.count("*").alias("window_count"), F.avg("s").alias("mean_score"), F.max("s").alias("max_score"))
    same = functools.reduce(operator.and_, [F.col(f"o.{c}").eqNullSafe(F.col(f"m.{c}")) for c in by])
    out = out.alias("o").join(quantiles(inside, "s", [0.5], by, ["median_score"]).alias("m"), same, "left").select("o.*", "m.median_score")
    out = out.join(thresholds(scored, "s", 0.5).withColumnRenamed("threshold", "global_median_score"), "series", "left")
    return out.withColumn("mean_vs_global_median_ratio", F.try_divide("mean_score", "global_median_score")).orderBy(F.desc("mean_score"), "period")


def top_dates(scores: DataFrame, metrics: Sequence[str], top: int = TOP) -> DataFrame:
    """(series, metric, rank, end_date, score): the highest scores of each metric, the earlier date first on ties."""
    long = scores.unpivot(["series", "end_date"], list(metrics), "metric", "score").filter(F.col("score").isNotNull())
    rank = F.row_number().over(Window.partitionBy("series", "metric").orderBy(F.desc("score"), "end_date"))
    return long.withColumn("rank", rank).filter(F.col("rank") <= top).select("series", "metric", "rank", "end_date", "score")


def correlations(scores: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(series, metric, one column a metric): Pearson correlations over the rows that have all metrics."""
    d = range(len(metrics))
    pairs = {(i, j): F.corr(metrics[i], metrics[j]).alias(f"__c_{i}_{j}") for i in d for j in d if i < j}
    own = scores.dropna(subset=list(metrics)).groupBy("series").agg(F.count("*").alias("__n"), *pairs.values())
    cell = lambda i, j: F.lit(1.0) if i == j else F.col(f"__c_{min(i, j)}_{max(i, j)}")
    rows = [F.struct(F.lit(metrics[i]).alias("metric"), *[cell(i, j).alias(metrics[j]) for j in d]) for i in d]
    return own.select("series", F.explode(F.array(*rows)).alias("r")).select("series", "r.*")


def zscored(scores: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """The metrics in units of their own deviation over scored rows, for series drawn together."""
    return standardise(scores.select("series", "window_idx", "end_date", *metrics), metrics)
