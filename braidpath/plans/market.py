"""End-to-end plans over a panel of prices: from observations to scores, episodes and tables."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import DataFrame

from braidpath.functions.vectors import signature_length
from braidpath.operators import blockwise, features, panel, scoring, signature

DEPTH = 3
#: Inclusive date ranges that scores are summarised over.
PERIODS = (
    ("1996 spring", "1996-03-01", "1996-05-31"),
    ("1997 autumn", "1997-10-01", "1997-12-15"),
    ("1998 summer", "1998-07-15", "1998-10-15"),
    ("2000 spring", "2000-03-10", "2000-05-30"),
    ("2001 autumn", "2001-09-01", "2001-10-15"),
)


def returns_of(prices: DataFrame, tickers: Sequence[str], check: bool = False) -> DataFrame:
    """Log returns of the dates on which every ticker has a price; ``check``: an error if a ticker has none at all."""
    prices = panel.require_tickers(prices, tickers) if check else prices
    return panel.log_returns(panel.align(prices, tickers), tickers)


def returns_of_panel(prices: DataFrame, tickers: Sequence[str]) -> DataFrame:
    """Log returns of a panel made elsewhere, (series, date, one column a ticker); a repeated date is an error."""
    return panel.log_returns(panel.check_unique_dates(prices), tickers)


def signature_features(returns: DataFrame, channels: int, depth: int = DEPTH, window: int = panel.WINDOW) -> DataFrame:
    """(series, window_idx, end_date, f_1..f_n): signatures of each window's path from zero, so all returns count."""
    packed = panel.packed_windows(returns, channels, window)
    return features.spread(signature.signatures(packed, channels, depth), "signature", signature_length(channels, depth))


def columns_of(table: DataFrame) -> list[str]:
    return [c for c in table.columns if c.startswith("f_")]


def scores_of(table: DataFrame, name: str, lookback: int = scoring.LOOKBACK) -> DataFrame:
    columns = columns_of(table)
    return scoring.trailing_score(scoring.standardise(table, columns), columns, name, lookback)


def checked_scores(prices: DataFrame, tickers: Sequence[str], name: str, window: int = panel.WINDOW, depth: int = DEPTH, lookback: int = scoring.LOOKBACK) -> DataFrame:
    """Trailing scores of the signature from prices, or an error: a ticker without prices, a price that isn't positive, a
    repeated date, a window that isn't whole, a series with too few windows for a score.

    What a row shows by itself is checked where the row is made; what takes a count, by aggregations before.
    """
    whole = panel.check_unique_dates(panel.clean(panel.align(panel.require_tickers(prices, tickers), tickers), tickers))
    packed = panel.whole_windows(panel.packed_windows(panel.log_returns(whole, tickers), len(tickers), window), len(tickers), window)
    table = features.spread(signature.signatures(packed, len(tickers), depth), "signature", signature_length(len(tickers), depth))
    return scores_of(scoring.require_scored(table, lookback), name, lookback)


def signature_scores(returns: DataFrame, channels: int, name: str, depth: int = DEPTH, window: int = panel.WINDOW, lookback: int = scoring.LOOKBACK) -> DataFrame:
    """(series, window_idx, end_date, name): trailing scores of all windows' signatures."""
    table = blockwise.window_features(returns, channels, {"signature": blockwise.signature_kernel(depth)}, window)
    return blockwise.array_scores(table, {name: (0, signature_length(channels, depth))}, lookback)


def score_table(returns: DataFrame, channels: int, depth: int = DEPTH, window: int = panel.WINDOW, lookback: int = scoring.LOOKBACK) -> DataFrame:
    """Trailing scores of the signature and three baselines, and the signature's consecutive distance, by window.

    A block of returns gives all features of its windows at once, and one kernel a block scores them.
    """
    sizes = (signature_length(channels, depth), window * channels, channels * (channels + 1) // 2, channels)
    ends = list(itertools.accumulate(sizes))
    own = blockwise.together(blockwise.signature_kernel(depth), blockwise.flat, blockwise.covariance, blockwise.volatility)
    table = blockwise.window_features(returns, channels, {"all": own}, window)
    return blockwise.array_scores(table, dict(zip(TRAILING, zip([0, *ends], ends))), lookback, {METRICS[-1]: (0, ends[0])})


TRAILING = ("signature_trailing_score", "returns_trailing_score", "covariance_trailing_score", "volatility_trailing_score")
METRICS = (*TRAILING, "signature_consecutive_distance")
