"""Features and scores by block against the SQL forms and numpy."""

import numpy as np
import pytest

from braidpath.operators import blockwise, features, panel, scoring, weighted
from braidpath.plans import market


@pytest.fixture(scope="module")
def returns(spark):
    """A series over three blocks, a short one, one too short for a window, and one without a name."""
    rng = np.random.default_rng(21)
    rows = [("s", k, *map(float, x)) for k, x in enumerate(rng.normal(size=(2_200, 2)) / 10)]
    rows += [("t|1", k, 0.1 * (k % 3), 0.0) for k in range(90)] + [("short", k, 1.0, 2.0) for k in range(4)] + [(None, k, 1.0, 2.0) for k in range(30)]
    df = spark.createDataFrame(rows, "series string, idx bigint, r_1 double, r_2 double")
    return df.selectExpr("series", "date_add(date'2000-01-01', cast(idx as int)) as date", "idx", "r_1", "r_2").repartition(6).cache()


def by_window(df, value):
    return {(r["series"], r["window_idx"], r["end_date"]): value(r) for r in df.collect()}


def same(got, want, **tolerance):
    assert got.keys() == want.keys() and len(got)
    for key, own in want.items():
        np.testing.assert_allclose(np.array(got[key], float), np.array(own, float), **tolerance)


@pytest.mark.parametrize("name", ["flat", "covariance", "volatility", "signature"])
def test_features(returns, name):
    kernel = {"flat": blockwise.flat, "covariance": blockwise.covariance, "volatility": blockwise.volatility, "signature": blockwise.signature_kernel(3)}[name]
    got = blockwise.window_features(returns, 2, {"own": kernel}, 5)
    if name == "signature":
        plain = market.signature_features(returns.filter("series is not null"), 2, 3, 5)
    else:
        windows = panel.windows(returns.filter("series is not null"), 2, 5)
        plain = {"flat": lambda: features.flat_returns(windows, 2, 5), "covariance": lambda: features.covariance_features(windows, 2), "volatility": lambda: features.volatility_features(windows, 2)}[name]()
    columns = sorted((c for c in plain.columns if c.startswith("f_")), key=lambda c: int(c[2:]))
    same(by_window(got, lambda r: r["features"]), by_window(plain, lambda r: [r[c] for c in columns]), rtol=1e-8, atol=1e-10)


@pytest.mark.parametrize("kind", weighted.CLOCKS)
@pytest.mark.parametrize("alpha", [0.0, 0.7])
def test_weighted_features(returns, alpha, kind):
    got = blockwise.window_features(returns, 2, {"own": weighted.weighted_kernel(alpha, kind)}, 5)
    plain = weighted.weighted_features(panel.windows(returns.filter("series is not null"), 2, 5), 2, alpha, kind)
    columns = [f"f_{k}" for k in range(1, weighted.feature_count(2) + 1)]
    same(by_window(got, lambda r: r["features"]), by_window(plain, lambda r: [r[c] for c in columns]), rtol=1e-8, atol=1e-10)
    with pytest.raises(ValueError):
        weighted.weighted_kernel(alpha, "other")


def test_several_kernels_become_series(returns):
    got = blockwise.window_features(returns, 2, {"a|1": blockwise.flat, "b": blockwise.volatility}, 5)
    assert {r["series"]: r["count"] for r in got.groupBy("series").count().collect()} == {"s|a|1": 2_196, "s|b": 2_196, "t|1|a|1": 86, "t|1|b": 86}
    both = blockwise.window_features(returns, 2, {"x": blockwise.together(blockwise.flat, blockwise.volatility)}, 5)
    assert {len(r["features"]) for r in both.collect()} == {12}
    assert blockwise.window_features(returns.limit(0), 2, {"x": blockwise.flat}, 5).count() == 0


@pytest.mark.parametrize("lookback", [3, 60])
def test_scores_equal_the_sql_form(returns, lookback):
    table = blockwise.window_features(returns, 2, {"own": blockwise.together(blockwise.flat, blockwise.volatility)}, 5)
    got = blockwise.array_scores(table, {"flat": (0, 10), "vol": (10, 12)}, lookback, {"step": (0, 10)})
    wide = features.spread(table, "features", 12)
    f = [f"f_{k}" for k in range(1, 13)]
    plain = scoring.trailing_scores(scoring.standardise(wide, f), {"flat": f[:10], "vol": f[10:]}, lookback, {"step": f[:10]})
    values = lambda r: [r["flat"], r["vol"], r["step"]]
    same(by_window(got, values), by_window(plain, values), rtol=1e-8, atol=1e-7)
    assert got.filter("isnan(flat) or isnan(vol) or isnan(step)").count() == 0
    assert got.filter("flat is null").count() == 2 * lookback and got.filter("step is null").count() == 2
    alone = blockwise.array_scores(table, {}, lookback, {"step": (0, 10)})
    assert alone.columns == ["series", "window_idx", "end_date", "step"] and alone.count() == got.count()
    assert blockwise.array_scores(table.limit(0), {"flat": (0, 10)}, lookback).count() == 0


def test_one_exchange_for_rows_and_their_means(spark, returns, tmp_path):
    """The features are computed and dealt out once, by block; of a series only one row a task meets."""
    returns.write.parquet(str(tmp_path / "returns"))
    table = blockwise.window_features(spark.read.parquet(str(tmp_path / "returns")), 2, {"own": blockwise.flat}, 5)
    out = blockwise.array_scores(table, {"score": (0, 10)}, 60)
    assert len(out.collect()) == 2_196 + 86
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ReusedExchange") == 1 and plan.count("FlatMapGroupsInArrow") == 1 and "Window [" not in plan
    by_series = [line for line in plan.split("\n") if "Exchange hashpartitioning(series" in line and "__block" not in line]
    assert len(by_series) == 1


def test_constant_features_and_nulls(spark):
    rows = [("m", k, [4.0, float(k % 2)]) for k in range(80)] + [("n", k, [1.0, None if k == 5 else 2.0]) for k in range(80)]
    table = spark.createDataFrame(rows, "series string, window_idx bigint, features array<double>").selectExpr("series", "window_idx", "date'2020-01-01' as end_date", "features")
    got = {(r["series"], r["window_idx"]): r["a"] for r in blockwise.array_scores(table, {"a": (0, 1), "b": (1, 2)}, 10).collect()}
    assert {v for (s, k), v in got.items() if k >= 10} == {0.0}
    lost = {r["window_idx"]: r["b"] for r in blockwise.array_scores(table.filter("series = 'n'"), {"b": (1, 2)}, 10).collect()}
    assert set(lost.values()) == {None}  # a mean over a missing value is not known
