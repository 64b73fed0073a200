import datetime
import datetime as dt
import math

import numpy as np
import pytest

from braidpath.operators import panel
from braidpath.plans import market

DAY = dt.date(2020, 1, 1)


def prices(spark, values, ticker="A", series="m"):
    rows = [(series, DAY + dt.timedelta(k), ticker, float(v)) for k, v in enumerate(values) if v is not None]
    return spark.createDataFrame(rows, "series string, date date, ticker string, price double")


def test_alignment_needs_every_ticker(spark):
    both = prices(spark, [1, 2, 3, 4]).unionByName(prices(spark, [5, None, 7, 8], "B")).unionByName(prices(spark, [9], "C"))
    got = panel.align(both, ["A", "B"]).orderBy("date").collect()
    assert [(r["A"], r["B"]) for r in got] == [(1, 5), (3, 7), (4, 8)]
    with pytest.raises(ValueError):
        panel.align(both, [])


def test_cleaning_looks_at_prices_only(spark):
    df = spark.createDataFrame([("m", DAY, 1.0, None), ("m", DAY, None, "x"), ("m", DAY, float("nan"), "y")], "series string, date date, A double, other string")
    assert [r["A"] for r in panel.clean(df, ["A"]).collect()] == [1.0]


def test_repeated_dates_are_refused(spark):
    df = prices(spark, [1, 2])
    with pytest.raises(ValueError):
        panel.check_unique_dates(df.unionByName(df))
    assert panel.check_unique_dates(df) is df


def test_profile(spark):
    df = spark.createDataFrame([("m", DAY, 1.0), ("m", DAY + dt.timedelta(1), None)], "series string, date date, A double")
    r = panel.profile(df, ["A"]).first()
    assert (r["n_rows"], r["null_A"], r["last_date"] - r["first_date"]) == (2, 1, dt.timedelta(1))


def returns(spark, n, series="m"):
    return panel.log_returns(panel.align(prices(spark, [math.exp(k) for k in range(n + 1)], series=series), ["A"]), ["A"])


def test_returns(spark):
    got = returns(spark, 3).orderBy("date").collect()
    assert [round(r["r_1"], 12) for r in got] == [1.0, 1.0, 1.0] and got[0]["date"] == DAY + dt.timedelta(1)


@pytest.mark.parametrize(("n", "count"), [(0, 0), (3, 0), (4, 1), (6, 3)])
def test_windows(spark, n, count):
    rows = panel.windows(returns(spark, n), 1, 4).collect()
    assert len(rows) == 4 * count
    assert {(r["window_idx"], r["step"]) for r in rows} == {(w, s) for w in range(count) for s in range(4)}
    assert all(r["end_date"] == DAY + dt.timedelta(r["window_idx"] + 4) for r in rows)
    packed = panel.packed_windows(returns(spark, n), 1, 4).collect()
    assert sorted(r["window_idx"] for r in packed) == list(range(count)) and all(len(r["steps"]) == 4 for r in packed)


def test_series_are_apart(spark):
    both = returns(spark, 4).unionByName(returns(spark, 5, "other"))
    got = panel.windows(both, 1, 4).select("series", "window_idx").distinct().collect()
    assert sorted((r[0], r[1]) for r in got) == [("m", 0), ("other", 0), ("other", 1)]


def test_volatility_is_null_until_the_window_is_full(spark):
    got = panel.rolling_volatility(returns(spark, 6), 1, window=4).orderBy("date").collect()
    assert [r["vol_1"] is None for r in got] == [True] * 3 + [False] * 3


def test_increments_keep_or_drop_the_first(spark):
    df = spark.createDataFrame([("a", 0, 5.0), ("a", 1, 7.0)], "series string, step int, x double")
    assert [r["x"] for r in panel.increments(df, ["x"]).orderBy("step").collect()] == [5.0, 2.0]
    assert [r["x"] for r in panel.increments(df, ["x"], keep_first=False).collect()] == [2.0]


def test_blocks_and_chunks_give_what_one_ordering_gives(spark, monkeypatch):
    """A series of many chunks and blocks: numbering, returns, volatility and windows against numpy."""
    monkeypatch.setattr(panel, "CHUNK_DAYS", 100)
    rng = np.random.default_rng(4)
    n = 2_600
    days = np.cumsum(rng.integers(1, 4, n))
    price = np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    start = datetime.date(1969, 1, 1)  # some before the epoch
    rows = [("s", start + datetime.timedelta(int(d)), float(p)) for d, p in zip(days, price)] + [("t", start, 1.0)]
    df = spark.createDataFrame(rows, "series string, date date, A double").repartition(5)
    returns = panel.log_returns(df, ["A"])
    got = sorted((r["idx"], r["date"], r["r_1"]) for r in returns.collect())
    want = np.log(price[1:] / price[:-1])
    assert [i for i, _, _ in got] == list(range(n - 1)) and [d for _, d, _ in got] == [r[1] for r in rows[1:n]]
    np.testing.assert_allclose([x for _, _, x in got], want)
    vol = sorted((r["date"], r["vol_1"]) for r in panel.rolling_volatility(returns, 1).collect())
    assert [v for _, v in vol[:19]] == [None] * 19
    np.testing.assert_allclose([v for _, v in vol[19:]], [want[k - 19 : k + 1].std(ddof=1) * 252**0.5 for k in range(19, n - 1)])
    packed = sorted((r["window_idx"], [s[0] for s in r["steps"]]) for r in panel.packed_windows(returns, 1).collect())
    assert len(packed) == n - 20
    np.testing.assert_allclose([s for _, s in packed], [want[k : k + 20] for k in range(n - 20)])
    counts = panel.windows(returns, 1).groupBy("window_idx").count().collect()
    assert len(counts) == n - 20 and {r["count"] for r in counts} == {20}
    assert panel.check_windows(panel.packed_windows(returns, 1), 1).count() == n - 20
    with pytest.raises(ValueError):
        panel.check_windows(panel.packed_windows(returns, 1), 2)
    with pytest.raises(ValueError):
        panel.check_windows(panel.packed_windows(returns, 1), 1, least=n)


def test_prices_that_are_no_prices(spark):
    day = datetime.date
    for bad in (0.0, -1.0):
        df = spark.createDataFrame([("s", day(2020, 1, 1), 1.0), ("s", day(2020, 1, 2), bad), ("s", day(2020, 1, 3), 2.0)], "series string, date date, A double")
        with pytest.raises(Exception, match="isn't positive"):
            panel.log_returns(df, ["A"]).collect()
    with pytest.raises(ValueError):
        market.returns_of_panel(spark.createDataFrame([("s", day(2020, 1, 1), 1.0)] * 2, "series string, date date, A double"), ["A"])
    prices = spark.createDataFrame([("s", day(2020, 1, 1), "A", 1.0)], "series string, date date, ticker string, price double")
    with pytest.raises(ValueError):
        market.returns_of(prices, ["A", "B"], check=True)


def test_fields_side_by_side(spark):
    day = datetime.date
    bars = [("s", day(2020, 1, d), t, 10.0 * d, None if t == "B" else 5.0) for d in (1, 2) for t in "AB"] + [("s", day(2020, 1, 3), "A", 1.0, 2.0)]
    df = spark.createDataFrame(bars, "series string, date date, ticker string, close double, volume double")
    got = panel.align_fields(df, ["A", "B"], ["close", "volume"])
    assert got.columns == ["series", "date", "A_close", "A_volume", "B_close", "B_volume"]
    assert sorted(tuple(r)[2:] for r in got.collect()) == [(10.0, 5.0, 10.0, None), (20.0, 5.0, 20.0, None)]
    assert panel.align_fields(df, ["A", "B"], ["close"]).columns == ["series", "date", "A_close", "B_close"]
    with pytest.raises(ValueError):
        panel.align_fields(df, ["A"], ["open"])
