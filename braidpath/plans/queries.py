"""The registered queries of the path-signature engine. Doubles are rounded, as sums differ in their last bits by order."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidpath.functions import sql
from braidpath.functions.vectors import signature_length, truncate
from braidpath.operators import distance, features, long_paths, moments, panel, scoring, signature, weighted
from braidpath.plans import market
from braidpath.plans.market import METRICS, PERIODS, TRAILING
from braidpath.sources import bars
from braidpath.sources.expected import ExpectedSignatures
from braidpath.sources.staging import stage, staged_path
from braidpath.sources.tables import TICKERS, daily_bars, event_series, labelled_vectors, order_prices, table
from braidpath.streaming import event_time

Query = Callable[[SparkSession, str], DataFrame]
D = len(TICKERS)
#: Values of events are taken in this unit, so that high levels stay of a size that survives rounding, and few land half-way.
EVENT_UNIT = 97.3
#: 2024-01-01 in microseconds; time runs from there.
EVENT_START = 1_704_067_200_000_000
VECTOR_DIMENSIONS = 64
VECTOR_COLUMNS = [f"x_{k}" for k in range(1, VECTOR_DIMENSIONS + 1)]
VECTOR_PAIRS = tuple((f"L{a}", f"L{b}") for a in range(10) for b in range(a + 1, 10))
EVENT_PAIRS = (("A", "B"), ("A", "C"), ("B", "C"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _prices(spark: SparkSession, sf: str) -> DataFrame:
    return order_prices(spark, sf)


def _returns(spark: SparkSession, sf: str) -> DataFrame:
    return market.returns_of(_prices(spark, sf), TICKERS)


def _windows(spark: SparkSession, sf: str) -> DataFrame:
    return panel.windows(_returns(spark, sf), D)


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return event_series(spark, sf).withColumn("x_1", F.col("x") / EVENT_UNIT).drop("x")


def _event_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Increments of value and time along each user's path, which begins at its first point."""
    from pyspark.sql.window import Window

    rows = _events(spark, sf)
    n = F.count("*").over(Window.partitionBy("series"))
    timed = rows.withColumn("x_2", panel.clock(F.col("step"), n))
    return panel.increments(timed, ["x_1", "x_2"], keep_first=False)


def align_panel(spark, sf):
    return rounded(panel.clean(panel.align(_prices(spark, sf), TICKERS), TICKERS).drop("series"))


def price_profile(spark, sf):
    whole = _prices(spark, sf).filter(F.col("ticker").isin(*TICKERS)).groupBy("series", "date").pivot("ticker", list(TICKERS)).agg(F.avg("price"))
    return panel.profile(whole, TICKERS).drop("series")


def repeated_dates(spark, sf):
    """Of each ticker the dates with several trades."""
    return panel.repeated_dates(_prices(spark, sf).withColumn("series", F.col("ticker"))).withColumnRenamed("series", "ticker")


def align_fields(spark, sf):
    """Prices and volumes of all tickers side by side."""
    return rounded(panel.align_fields(daily_bars(spark, sf), TICKERS).drop("series"))


def stored_bars(spark, sf):
    """Four years of two tickers' bars from a table of all."""
    path = staged_path(spark, "bars")
    bars.write_bars(daily_bars(spark, sf), path)
    return rounded(bars.require_bars(bars.read_bars(spark, path, ["A", "R"], "1996-01-01", "1999-12-31"), ["A", "R"]))


def log_returns(spark, sf):
    return rounded(_returns(spark, sf).drop("series", "idx"))


def rolling_volatility(spark, sf):
    return rounded(panel.rolling_volatility(_returns(spark, sf), D).drop("series"))


def rolling_windows(spark, sf):
    return rounded(_windows(spark, sf).drop("series"))


def cumulative_paths(spark, sf):
    return rounded(panel.cumulative(_windows(spark, sf), [f"r_{k}" for k in range(1, D + 1)]).drop("series", "end_date"))


def window_signature(spark, sf, depth=3):
    return rounded(market.signature_features(_returns(spark, sf), D, depth).drop("series"))


def sliding_signature(spark, sf):
    """The same from prefixes and their inverses."""
    found = signature.sliding_signatures(_returns(spark, sf), D, 3)
    return rounded(features.spread(found, "signature", signature_length(D, 3)).drop("series"))


def long_path_signature(spark, sf):
    """All events of a type as one path of value and time in days, whatever its length."""
    events = table(spark, sf, "events").select("event_type", "ts", "event_id", (F.col("value") / EVENT_UNIT).alias("x_1"), ((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(EVENT_START)) / F.lit(86_400e6)).alias("x_2"))
    found = long_paths.path_signatures(events, ["x_1", "x_2"], 3, ["event_type"], ["ts", "event_id"])
    return rounded(features.spread(found, "signature", signature_length(2, 3), "s_"), 5)


def signature_in_sql(spark, sf):
    """Signatures of windows asked for in SQL text."""
    sql.register(spark)
    asked = """SELECT window_idx, end_date, signature FROM path_signature(TABLE({windows}) PARTITION BY (series, window_idx, end_date) ORDER BY step,
        channels => 'r_1, r_2, r_3', depth => 3, keys => 'window_idx, end_date')"""
    return rounded(features.spread(spark.sql(asked, windows=_windows(spark, sf)), "signature", signature_length(D, 3)))


def streamed_signature(spark, sf, slices=4, files=4):
    """Each user's path of value and time as a stream: events arrive up to two days late, so later slices have points that belong into earlier ones."""
    late = F.make_dt_interval(hours=F.pmod(F.xxhash64("event_id"), F.lit(48)).cast("int"))
    seen = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", (F.col("value") / EVENT_UNIT).alias("x_1"), ((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(EVENT_START)) / F.lit(86_400e6)).alias("x_2"))
    seen = seen.withColumn("arrival", F.col("ts") + late)
    first, last = seen.agg(F.min(F.unix_micros("arrival")), F.max(F.unix_micros("arrival"))).first()
    part = F.floor((F.unix_micros("arrival") - F.lit(first or 0)) * slices / F.lit((last or 0) - (first or 0) + 1))
    path = staged_path(spark, "arrivals")
    for k in range(slices):  # one after the other, as a stream reads files in the order of their making
        seen.filter(part == k).drop("arrival").repartition(files).write.mode("append").parquet(path)
    spark.conf.set(*event_time.STORE)
    stream = spark.readStream.schema(seen.drop("arrival").schema).option("maxFilesPerTrigger", files).parquet(path)
    found = event_time.latest_of(spark, event_time.ordered_signatures(stream, ["x_1", "x_2"], 3, "3 days", "user_id", "ts", "event_id"), "user_id")
    return rounded(features.spread(found, "signature", signature_length(2, 3), "s_"), 5)


def window_signature_sql(spark, sf):
    rows = signature.signature_sql(_windows(spark, sf), [f"r_{k}" for k in range(1, D + 1)], 3, ["series", "window_idx", "end_date"])
    return rounded(rows.drop("series"))


def signature_forms_agree(spark, sf):
    """Both forms of the signature, the largest difference rounded to what must be nothing."""
    columns = [f"f_{k}" for k in range(1, signature_length(D, 3) + 1)]
    sql = signature.signature_sql(_windows(spark, sf), [f"r_{k}" for k in range(1, D + 1)], 3, ["series", "window_idx"])
    sql = sql.withColumnsRenamed({f"s_{k}": f"f_{k}" for k in range(1, len(columns) + 1)})
    found = signature.largest_difference(market.signature_features(_returns(spark, sf), D), sql, ["series", "window_idx"], columns)
    return found.select(F.round("max_abs_difference", 8).alias("max_abs_difference"), "agrees")


def signature_prefix(spark, sf):
    """Depth 2 as a prefix of depth 3."""
    packed = panel.packed_windows(_returns(spark, sf), D)
    deep = signature.signatures(packed, D, 3).withColumn("signature", truncate(F.col("signature"), D, 2))
    return rounded(features.spread(deep, "signature", signature_length(D, 2)).drop("series"))


def time_augmented_signature(spark, sf):
    return rounded(signature.signature_sql(_event_steps(spark, sf), ["x_1", "x_2"], 3, ["process", "series"]))


def expected_signature(spark, sf):
    paths = signature.pack(_event_steps(spark, sf), ["x_1", "x_2"], ["process", "series"])
    return rounded(signature.expected_signature(paths, 2, 3))


def expected_signature_batches(spark, sf):
    """The same from a table of partial states: users enter in three batches, one of them twice."""
    steps = _event_steps(spark, sf).withColumn("batch", F.pmod(F.floor(F.col("series") / 3), F.lit(3)))
    paths = stage(signature.pack(steps, ["x_1", "x_2"], ["batch", "process", "series"]), "event-paths")
    kept = ExpectedSignatures(spark, staged_path(spark, "expected"), 2, 3)
    for batch in (0, 1, 2, 1):
        kept.add(paths.filter(F.col("batch") == batch), f"users_{batch}")
    return rounded(kept.read())


def expected_signature_sql(spark, sf):
    rows = signature.signature_sql(_event_steps(spark, sf), ["x_1", "x_2"], 3, ["process", "series"])
    return rounded(signature.expected_signature_sql(rows, 2, 3))


def levy_area(spark, sf):
    return rounded(signature.signed_area(_windows(spark, sf), [f"r_{k}" for k in range(1, D + 1)], ["window_idx", "end_date"]))


def _signature_z(spark, sf):
    own = market.signature_features(_returns(spark, sf), D)
    return own, scoring.standardise(own, market.columns_of(own))


def standardised_signature(spark, sf):
    return rounded(_signature_z(spark, sf)[1].drop("series"), 5)


def signature_feature_table(spark, sf):
    own, z = _signature_z(spark, sf)
    return rounded(features.feature_table(own, z, market.columns_of(own), "signature").drop("series"), 5)


def trailing_score(spark, sf):
    return rounded(market.signature_scores(_returns(spark, sf), D, "score").drop("series"), 5)


def checked_scores(spark, sf):
    """The same with every guard on: tickers, repeated dates, complete windows, enough of them."""
    return rounded(market.checked_scores(_prices(spark, sf), TICKERS, "score").drop("series"), 5)


def consecutive_distance(spark, sf):
    _, z = _signature_z(spark, sf)
    return rounded(scoring.consecutive_distance(z, market.columns_of(z)).drop("series"), 5)


def covariance_features(spark, sf):
    return rounded(features.covariance_features(_windows(spark, sf), D).drop("series"))


def volatility_features(spark, sf):
    return rounded(features.volatility_features(_windows(spark, sf), D).drop("series"))


def flat_returns(spark, sf):
    return rounded(features.flat_returns(_windows(spark, sf), D, panel.WINDOW).drop("series"))


def _scores(spark, sf):
    return market.score_table(_returns(spark, sf), D)


def score_table(spark, sf):
    return rounded(_scores(spark, sf).drop("series"), 5)


def threshold_q95(spark, sf):
    return rounded(scoring.thresholds(market.signature_scores(_returns(spark, sf), D, "score"), "score").drop("series"), 5)


def episodes(spark, sf):
    return rounded(scoring.episodes(market.signature_scores(_returns(spark, sf), D, "score"), "score").drop("series"), 5)


def stress_periods(spark, sf):
    return rounded(scoring.period_summary(market.signature_scores(_returns(spark, sf), D, "score"), "score", PERIODS).drop("series"), 5)


def order_periods(spark, sf):
    """Scores over the stretches in which orders of each priority came in each quarter: many ranges, from a table, that overlap."""
    quarter = F.concat_ws(" ", "o_orderpriority", F.year("o_orderdate").cast("string"), F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string")))
    periods = table(spark, sf, "orders").groupBy(quarter.alias("period")).agg(F.to_date(F.min("o_orderdate")).alias("start_date"), F.to_date(F.max("o_orderdate")).alias("end_date"))
    return rounded(scoring.period_summary(market.signature_scores(_returns(spark, sf), D, "score"), "score", periods).drop("series"), 5)


def top_dates(spark, sf):
    return rounded(scoring.top_dates(_scores(spark, sf), METRICS).drop("series"), 5)


def metric_correlations(spark, sf):
    return rounded(scoring.correlations(_scores(spark, sf), TRAILING).drop("series"), 5)


def zscored_series(spark, sf):
    return rounded(scoring.zscored(_scores(spark, sf), TRAILING).drop("series"), 5)


def sample_moments(spark, sf):
    return rounded(moments.sample_moments(labelled_vectors(spark, sf, VECTOR_DIMENSIONS), VECTOR_COLUMNS))


def sample_covariances(spark, sf):
    return rounded(moments.covariances(labelled_vectors(spark, sf, VECTOR_DIMENSIONS), VECTOR_COLUMNS, sample=True))


def mean_covariance(spark, sf):
    return rounded(moments.covariances(labelled_vectors(spark, sf, VECTOR_DIMENSIONS), VECTOR_COLUMNS))


def _event_summary(spark, sf):
    rows = _events(spark, sf)
    return moments.process_summary(rows, panel.increments(rows, ["x_1"]), ["x_1"])


def terminal_increment_summary(spark, sf):
    s = _event_summary(spark, sf)
    flat = [F.col(c)[0].alias(c) for c in ("terminal_mean", "terminal_cov", "increment_mean", "increment_cov")]
    return rounded(s.select("process", *flat, "terminal_mean_norm", "avg_terminal_variance", "avg_increment_variance"))


def statistical_distances(spark, sf):
    return rounded(distance.statistical_distances(_event_summary(spark, sf), EVENT_PAIRS))


def vector_distances(spark, sf):
    """Means and covariances of labelled vectors, all pairs of labels, endpoints being the vectors themselves."""
    rows = labelled_vectors(spark, sf, VECTOR_DIMENSIONS)
    return rounded(distance.moment_distances(moments.means(rows, VECTOR_COLUMNS), moments.covariances(rows, VECTOR_COLUMNS), VECTOR_PAIRS))


def _event_expected(spark, sf):
    return signature.expected_signature(signature.pack(_event_steps(spark, sf), ["x_1", "x_2"], ["process", "series"]), 2, 3)


def signature_distances(spark, sf):
    return rounded(distance.signature_distances(_event_expected(spark, sf), EVENT_PAIRS, 2, 3), 5)


def levelwise_distances(spark, sf):
    return rounded(distance.levelwise_distances(_event_expected(spark, sf), EVENT_PAIRS, 2, 3, "A"), 5)


def cumulative_depth_distance(spark, sf):
    out = distance.cumulative_distances(distance.levelwise_distances(_event_expected(spark, sf), EVENT_PAIRS, 2, 3))
    return rounded(out.withColumn("interpretation", distance.interpretation(F.col("comparison"), F.col("level"), {"A_vs_B": (1,), "A_vs_C": (2,), "B_vs_C": (1, 2)})), 5)


def movement_clock(spark, sf, kind="movement"):
    return rounded(weighted.clocked(_windows(spark, sf), D, kind).select("window_idx", "step", "clock", "clock_end"))


def weighted_increments(spark, sf):
    return rounded(weighted.weighted_increments(weighted.clocked(_windows(spark, sf), D, "movement"), D, 0.7).drop("series", "end_date"))


def path_statistics(spark, sf):
    w = weighted.weighted_increments(weighted.clocked(_windows(spark, sf), D, "linear"), D, 0.35)
    return rounded(weighted.path_statistics(w, D + 1).drop("series"))


def weighted_features(spark, sf):
    return rounded(weighted.weighted_features(_windows(spark, sf), D, 0.35, "movement").drop("series"))


def grid_search(spark, sf):
    return rounded(weighted.grid_search(_returns(spark, sf), D, PERIODS).drop("series"), 5)


def unweighted_baseline(spark, sf):
    """The weightings with alpha 0."""
    return rounded(weighted.grid_search(_returns(spark, sf), D, PERIODS, alphas=(0.0,)).drop("series"), 5)


def comparison_correlations(spark, sf):
    returns = _returns(spark, sf)
    tables = [
        weighted.score_configuration(returns, D, 0.35, "movement").withColumnRenamed("score", "weighted_trailing_score"),
        weighted.score_configuration(returns, D, 0.0, "linear").withColumnRenamed("score", "unweighted_trailing_score"),
        market.signature_scores(returns, D, "signature_trailing_score"),
    ]
    names = ["weighted_trailing_score", "unweighted_trailing_score", "signature_trailing_score"]
    return rounded(scoring.correlations(scoring.score_table(tables), names).drop("series"), 5)


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    align_panel, align_fields, stored_bars, price_profile, repeated_dates, log_returns, rolling_volatility, rolling_windows, cumulative_paths,
    window_signature, sliding_signature, long_path_signature, streamed_signature, signature_in_sql, window_signature_sql, signature_forms_agree, signature_prefix, time_augmented_signature,
    expected_signature, expected_signature_batches, expected_signature_sql, levy_area, standardised_signature, signature_feature_table, trailing_score, checked_scores, consecutive_distance,
    covariance_features, volatility_features, flat_returns, score_table, threshold_q95, episodes, stress_periods, order_periods, top_dates,
    metric_correlations, zscored_series, sample_moments, sample_covariances, mean_covariance, terminal_increment_summary,
    statistical_distances, vector_distances, signature_distances, levelwise_distances, cumulative_depth_distance, movement_clock,
    weighted_increments, path_statistics, weighted_features, grid_search, unweighted_baseline, comparison_correlations,
)}
QUERIES["window_signature_depth1"] = partial(window_signature, depth=1)
QUERIES["window_signature_depth2"] = partial(window_signature, depth=2)
QUERIES["linear_clock"] = partial(movement_clock, kind="linear")
