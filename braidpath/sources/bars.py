"""Daily bars of many tickers, kept so that a reader touches only the tickers and dates it asks for.

Two layouts are read: a table partitioned by ticker and sorted by date, as ``write_bars`` makes it, and a folder with one CSV
file a ticker, as downloads come. Tickers choose folders or files before anything is opened, and dates are pushed to the scan.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VALUES = "open double, high double, low double, close double, adj_close double, volume double"
Day = str | datetime.date | None


def write_bars(bars: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``bars`` (date, ticker, open .. volume) by ticker, each ticker's files sorted by date."""
    columns = ["date", *[c.split()[0] for c in VALUES.split(", ")], "ticker"]
    # a ticker may hold a large part of all bars, so years are dealt out one by one
    dealt = bars.select(*columns).repartition("ticker", F.year("date")).sortWithinPartitions("ticker", "date")
    dealt.write.mode(mode).partitionBy("ticker").parquet(path)


def _between(bars: DataFrame, start: Day, end: Day) -> DataFrame:
    bars = bars if start is None else bars.filter(F.col("date") >= F.to_date(F.lit(str(start))))
    return bars if end is None else bars.filter(F.col("date") <= F.to_date(F.lit(str(end))))


def read_bars(spark: SparkSession, path: str, tickers: Sequence[str] | None = None, start: Day = None, end: Day = None) -> DataFrame:
    """(date, ticker, open .. volume) of the tickers and of the dates from ``start`` to ``end``, both included, of a table by ticker."""
    bars = spark.read.schema(f"date date, {VALUES}, ticker string").parquet(path)
    bars = bars if tickers is None else bars.filter(F.col("ticker").isin(*tickers))
    return _between(bars, start, end).select("date", "ticker", *[c.split()[0] for c in VALUES.split(", ")])


def read_downloads(spark: SparkSession, path: str, tickers: Sequence[str], start: Day = None, end: Day = None) -> DataFrame:
    """The same from ``<path>/<ticker>.csv``, whose columns are the date and the values in order; no other file is opened."""
    if not tickers:
        raise ValueError("no tickers")
    files = [f"{path.rstrip('/')}/{t}.csv" for t in tickers]
    bars = spark.read.schema(f"date date, {VALUES}").option("header", True).csv(files)
    ticker = F.regexp_replace(F.url_decode(F.element_at(F.split("_metadata.file_path", "/"), -1)), r"\.csv$", "")
    return _between(bars, start, end).select("date", ticker.alias("ticker"), *[c.split()[0] for c in VALUES.split(", ")])


def require_bars(bars: DataFrame, tickers: Sequence[str]) -> DataFrame:
    """``bars``, if each ticker has one; at most a row a ticker comes back."""
    found = {r["ticker"] for r in bars.filter(F.col("ticker").isin(*tickers)).select("ticker").distinct().collect()}
    if missing := [t for t in tickers if t not in found]:
        raise ValueError(f"no bars for {missing}")
    return bars
