"""Panels of prices: alignment, cleaning, returns, rolling windows.

Many panels are worked on side by side, told apart by ``series``; no task gets a whole series. Rows are numbered by
chunks of dates, and what looks back over rows works on blocks of them, each with as many rows before it as it needs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

WINDOW, YEAR = 20, 252
#: Rows of a block, and days of a chunk.
BLOCK, CHUNK_DAYS = 1_024, 4_096


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with idx, the 0-based place of a row in its series by date; rows that have one keep it."""
    if "idx" in rows.columns:
        return rows
    # said here, as the join would only say it for one side, and both sides should share what is below
    chunked = rows.withColumn("__chunk", F.floor(F.unix_date("date") / CHUNK_DAYS)).filter("series is not null and __chunk is not null")
    before = Window.partitionBy("series").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = chunked.groupBy("series", "__chunk").agg(F.count("*").alias("__n"))
    offsets = counts.select("series", "__chunk", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    own = F.row_number().over(Window.partitionBy("series", "__chunk").orderBy("date")) - 1
    return chunked.withColumn("__own", own).join(offsets, ["series", "__chunk"]).withColumn("idx", (F.col("__own") + F.col("__offset")).cast("long")).drop("__chunk", "__own", "__offset")


def blocked(rows: DataFrame, before: int, order: str = "idx", size: int = BLOCK) -> tuple[DataFrame, WindowSpec]:
    """``rows`` dealt to blocks of ``order``, a number without gaps, and the window over a block in that order.

    A block also has copies of the ``before`` rows ahead of it, marked by __own being false; drop them with ``own_rows``.
    """
    size = max(size, 8 * before)
    home, last = F.floor(F.col(order) / size), F.floor((F.col(order) + before) / size)
    out = rows.withColumn("__block", F.explode(F.sequence(home, last)) if before else home).withColumn("__own", F.col("__block") == home)
    return out, Window.partitionBy("series", "__block").orderBy(order)


def with_facts(rows: DataFrame, facts: DataFrame, order: str = "window_idx") -> DataFrame:
    """``rows`` with the columns of ``facts``, which has one row a series and in ``__last`` the last ``order`` of the series.

    The facts are copied to each block of the series and meet it there, so no series is gathered.
    """
    facts = facts.withColumn("__home", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("__last") / BLOCK)))).drop("__last")
    return rows.withColumn("__home", F.floor(F.col(order) / BLOCK)).join(facts, ["series", "__home"]).drop("__home")


def own_rows(rows: DataFrame) -> DataFrame:
    return rows.filter("__own").drop("__own", "__block")


def align(prices: DataFrame, tickers: Sequence[str], agg=F.avg) -> DataFrame:
    """(series, date, one column a ticker): dates on which every ticker has a price; one shuffle for all tickers."""
    if not tickers:
        raise ValueError("no tickers")
    return prices.filter(F.col("ticker").isin(*tickers)).groupBy("series", "date").pivot("ticker", list(tickers)).agg(agg("price")).dropna(subset=list(tickers))


FIELDS = ("open", "high", "low", "close", "adj_close", "volume")


def align_fields(bars: DataFrame, tickers: Sequence[str], fields: Sequence[str] = FIELDS, agg=F.first, on: str = "close") -> DataFrame:
    """(series, date, <ticker>_<field>..): all fields of all tickers side by side, for dates on which each ticker has ``on``.

    ``bars`` has (series, date, ticker, one column a field), one row a ticker and date; other fields may be null.
    """
    if not tickers:
        raise ValueError("no tickers")
    if missing := [f for f in fields if f not in bars.columns] or [on] * (on not in fields):
        raise ValueError(f"no fields {missing}")
    wide = bars.filter(F.col("ticker").isin(*tickers)).groupBy("series", "date").pivot("ticker", list(tickers)).agg(*[agg(f).alias(f) for f in fields])
    if len(fields) == 1:  # Spark then names the columns by ticker alone
        wide = wide.withColumnsRenamed({t: f"{t}_{fields[0]}" for t in tickers})
    return wide.dropna(subset=[f"{t}_{on}" for t in tickers])


def require_tickers(prices: DataFrame, tickers: Sequence[str]) -> DataFrame:
    """``prices``, if each ticker has a row; one aggregation, at most one row a ticker comes back."""
    found = {r["ticker"] for r in prices.filter(F.col("ticker").isin(*tickers)).select("ticker").distinct().collect()}
    if missing := [t for t in tickers if t not in found]:
        raise ValueError(f"no prices for {missing}")
    return prices


def clean(panel: DataFrame, tickers: Sequence[str]) -> DataFrame:
    """Rows with a price for every ticker that isn't NaN; other columns may be null."""
    return panel.dropna(subset=list(tickers))


def repeated_dates(panel: DataFrame) -> DataFrame:
    """Dates that a series has more than once: must be empty before returns are taken."""
    return panel.groupBy("series", "date").agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def check_unique_dates(panel: DataFrame) -> DataFrame:
    if not repeated_dates(panel).isEmpty():
        raise ValueError("a series has a date more than once")
    return panel


def profile(panel: DataFrame, tickers: Sequence[str]) -> DataFrame:
    """Of each series its first and last date, its rows, and the nulls of each column, in one pass."""
    nulls = [F.count_if(F.col(t).isNull()).alias(f"null_{t}") for t in tickers]
    return panel.groupBy("series").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("n_rows"), *nulls)


def log_returns(panel: DataFrame, tickers: Sequence[str]) -> DataFrame:
    """(series, date, idx, r_1..r_d): log of the ratio to the date before, the first date dropped.

    Dates without all prices are left out first. A price that isn't positive is an error, not a missing value.
    """
    rows, order = blocked(numbered(clean(panel, tickers)), 1)
    price = lambda t: F.when(F.col(t) > 0, F.col(t)).otherwise(F.raise_error(F.lit(f"a price of {t} isn't positive")).cast("double"))
    rows = rows.withColumns({t: price(t) for t in tickers})
    rows = rows.withColumns({f"r_{k}": F.ln(F.col(t) / F.lag(t).over(order)) for k, t in enumerate(tickers, 1)})
    return own_rows(rows).filter("idx > 0").select("series", "date", (F.col("idx") - 1).alias("idx"), *[f"r_{k}" for k in range(1, len(tickers) + 1)])


def rolling_volatility(returns: DataFrame, channels: int, window: int = WINDOW, year: int = YEAR) -> DataFrame:
    """Annualised sample deviation over the trailing rows; null until there are enough of them."""
    rows, order = blocked(numbered(returns), window - 1)
    spec = order.rowsBetween(1 - window, 0)
    full = F.col("idx") >= window - 1
    rows = rows.withColumns({f"vol_{k}": F.when(full, F.stddev_samp(f"r_{k}").over(spec) * (year**0.5)) for k in range(1, channels + 1)})
    return own_rows(rows).select("series", "date", *[f"vol_{k}" for k in range(1, channels + 1)])


def windows(returns: DataFrame, channels: int, window: int = WINDOW) -> DataFrame:
    """Overlapping windows, stride 1: (series, window_idx, end_date, step, r_1..r_d).

    Each row is scattered to the windows that hold it, which needs no range join; a window is complete if all its
    steps arrive, and others go.
    """
    if window < 1:
        raise ValueError("a window has at least one row")
    first = F.greatest(F.col("idx") - (window - 1), F.lit(0))
    rows = numbered(returns).withColumn("window_idx", F.explode(F.sequence(first, F.col("idx"))))
    whole = Window.partitionBy("series", "window_idx")
    rows = rows.withColumns({"step": (F.col("idx") - F.col("window_idx")).cast("int"), "end_date": F.max("date").over(whole), "__n": F.count("*").over(whole)})
    return rows.filter(F.col("__n") == window).select("series", "window_idx", "end_date", "step", *[f"r_{k}" for k in range(1, channels + 1)])


def packed_windows(returns: DataFrame, channels: int, window: int = WINDOW) -> DataFrame:
    """(series, window_idx, end_date, steps): each window as an array of its rows, for the array kernels."""
    rows, order = blocked(numbered(returns), window - 1)
    row = F.array(*[F.col(f"r_{k}") for k in range(1, channels + 1)])
    rows = own_rows(rows.withColumn("steps", F.collect_list(row).over(order.rowsBetween(1 - window, 0)))).filter(F.size("steps") == window)
    return rows.select("series", (F.col("idx") - (window - 1)).alias("window_idx"), F.col("date").alias("end_date"), "steps")


def _not_whole(channels: int, window: int) -> Column:
    return (F.size("steps") != window) | F.exists("steps", lambda s: (F.size(s) != channels) | F.exists(s, lambda x: x.isNull() | F.isnan(x)))


def whole_windows(packed: DataFrame, channels: int, window: int = WINDOW) -> DataFrame:
    """``packed``, in which a window that isn't of ``window`` rows of ``channels`` numbers is an error, raised where its row is read."""
    wrong = F.raise_error(F.concat(F.lit("a window is not of so many rows of numbers: "), F.col("window_idx").cast("string")))
    return packed.withColumn("steps", F.when(_not_whole(channels, window), wrong.cast(packed.schema["steps"].dataType)).otherwise(F.col("steps")))


def check_windows(packed: DataFrame, channels: int, window: int = WINDOW, least: int | None = None) -> DataFrame:
    """``packed``, if every window has ``window`` rows of ``channels`` numbers and each series at least ``least`` windows."""
    wrong = _not_whole(channels, window)
    found = packed.groupBy("series").agg(F.count("*").alias("n"), F.count_if(wrong).alias("wrong"))
    found = found.agg(F.min("n"), F.sum("wrong")).first()
    if found[0] is None or found[0] < (least or 1):
        raise ValueError(f"a series has {found[0] or 0} windows, fewer than {least or 1}")
    if found[1]:
        raise ValueError(f"{found[1]} windows are not of {window} rows of {channels} numbers")
    return packed


def cumulative(rows: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("series", "window_idx"), order: str = "step") -> DataFrame:
    """Running sums of increments along ``order``: the path, without its zero start."""
    spec = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({c: F.sum(c).over(spec) for c in columns})


def increments(rows: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("series",), order: str = "step", keep_first: bool = True) -> DataFrame:
    """First differences along ``order``; the first row keeps its own value, or is dropped."""
    spec = Window.partitionBy(*keys).orderBy(order)
    before = {c: F.lag(c).over(spec) for c in columns}
    out = rows.withColumns({c: F.coalesce(F.col(c) - before[c], F.col(c)) for c in columns} | {"__first": F.row_number().over(spec) == 1})
    return (out if keep_first else out.filter(~F.col("__first"))).drop("__first")


def clock(step: Column, n_steps: Column | int, end: float = 1.0) -> Column:
    """A time channel that runs end/T, 2 end/T, ..., end."""
    return F.lit(end) * (step + 1) / n_steps
