import datetime
import datetime as dt

import numpy as np
import pytest

from braidpath.operators import scoring, weighted

DAY = dt.date(2020, 1, 1)


def frame(spark, values, column="score"):
    rows = [("m", k, DAY + dt.timedelta(k), None if v is None else float(v)) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, f"series string, window_idx bigint, end_date date, {column} double")


def test_trailing_and_consecutive(spark):
    df = frame(spark, [1, 3, 2, 10], "f_1")
    got = [r["score"] for r in scoring.trailing_score(df, ["f_1"], lookback=2).orderBy("window_idx").collect()]
    assert got == [None, None, 0.0, 7.5]
    got = [r["distance"] for r in scoring.consecutive_distance(df, ["f_1"]).orderBy("window_idx").collect()]
    assert got == [None, 2.0, 1.0, 8.0]


def test_too_few_windows_are_refused(spark):
    df = frame(spark, range(4), "f_1")
    with pytest.raises(ValueError):
        scoring.require_scored(df, 4)
    assert scoring.require_scored(df, 3) is df


def test_constant_feature_is_divided_by_one(spark):
    got = scoring.standardise(frame(spark, [4, 4, 4], "f_1"), ["f_1"]).collect()
    assert [r["f_1"] for r in got] == [0.0, 0.0, 0.0]


def test_episodes(spark):
    # quantile 0.5 of the scored rows is 5: equal to the threshold counts; the last run ends on the last row
    df = frame(spark, [None, 9, 9, 1, 5, 1, 1, 7, 8])
    got = scoring.episodes(df, "score", 0.5).collect()
    seen = [((r["episode_start"] - DAY).days, (r["episode_end"] - DAY).days, (r["peak_date"] - DAY).days, r["peak_score"], r["duration_windows"]) for r in got]
    assert seen == [(1, 2, 1, 9.0, 2), (7, 8, 8, 8.0, 2)] or seen[-1][3] == 5.0
    assert {r["threshold"] for r in got} == {scoring.thresholds(df, "score", 0.5).first()["threshold"]}


def test_periods(spark):
    df = frame(spark, [None, None, 2, 4])
    periods = [("warm-up", "2020-01-01", "2020-01-02"), ("late", "2020-01-03", "2020-01-04"), ("never", "1999-01-01", "1999-02-01")]
    got = {r["period"]: r for r in scoring.period_summary(df, "score", periods).collect()}
    assert got.keys() == {"warm-up", "late"}
    assert got["warm-up"]["window_count"] == 2 and got["warm-up"]["mean_score"] is None
    assert (got["late"]["mean_score"], got["late"]["mean_vs_global_median_ratio"]) == (3.0, 1.0)


def test_top_dates_break_ties_by_date(spark):
    got = scoring.top_dates(frame(spark, [3, None, 3, 1]), ["score"], 2).orderBy("rank").collect()
    assert [((r["end_date"] - DAY).days, r["rank"]) for r in got] == [(0, 1), (2, 2)]


def test_correlations_use_complete_rows(spark):
    rows = [("m", k, DAY, a, b) for k, (a, b) in enumerate([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0), (None, 0.0)])]
    df = spark.createDataFrame(rows, "series string, window_idx bigint, end_date date, a double, b double")
    got = {r["metric"]: (r["a"], r["b"]) for r in scoring.correlations(df, ["a", "b"]).collect()}
    assert got["a"][0] == 1.0 and abs(got["a"][1] - 1.0) < 1e-12


def windows(spark, steps):
    rows = [("m", 0, DAY, k, *map(float, x)) for k, x in enumerate(steps)]
    return spark.createDataFrame(rows, "series string, window_idx bigint, end_date date, step int, r_1 double, r_2 double")


def test_constant_path_has_no_features(spark):
    for kind in weighted.CLOCKS:
        r = weighted.path_statistics(weighted.weighted_increments(weighted.clocked(windows(spark, [(0, 0)] * 3), 2, kind), 2, 0.7), 3).first()
        assert r["d_1"] == r["d_2"] == 0.0
        assert r["straightness"] == (0.0 if kind == "movement" else pytest.approx(1.0))
    with pytest.raises(ValueError):
        weighted.clocked(windows(spark, [(0, 0)]), 2, "other")


def test_clocks_and_weights(spark):
    x = weighted.clocked(windows(spark, [(3, 4), (0, 5)]), 2, "movement").orderBy("step").collect()
    assert [(r["clock"], r["clock_end"]) for r in x] == [(0.0, 0.5), (0.5, 1.0)]
    plain = weighted.weighted_increments(weighted.clocked(windows(spark, [(3, 4), (0, 5)]), 2, "linear"), 2, 0.0).orderBy("step").collect()
    assert [(r["w_1"], r["w_2"], r["w_3"]) for r in plain] == [(3.0, 4.0, 0.5), (0.0, 5.0, 0.5)]
    one = weighted.path_statistics(weighted.weighted_increments(weighted.clocked(windows(spark, [(3, 4)]), 2, "linear"), 2, 0.0), 3).first()
    assert one["mean_length_change"] == 0.0
    assert weighted.feature_count(3) == 19


def test_scores_over_many_blocks(spark):
    """Means and lags over 3,000 windows of two series against numpy, and episodes across the border of a block."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3_000, 2)) * [1.0, 50.0]
    rows = [("s", k, float(a), float(b)) for k, (a, b) in enumerate(x)] + [("t", k, 1.0, 2.0) for k in range(70)]
    df = spark.createDataFrame(rows, "series string, window_idx bigint, f_1 double, f_2 double").selectExpr("*", "date_add(date'2000-01-01', cast(window_idx as int)) as end_date").repartition(6)
    z = scoring.standardise(df, ["f_1", "f_2"])
    got = scoring.trailing_scores(z, {"score": ["f_1", "f_2"]}, 60, {"step": ["f_1"]}).collect()
    own = sorted((r["window_idx"], r["score"], r["step"]) for r in got if r["series"] == "s")
    want = (x - x.mean(axis=0)) / x.std(axis=0)
    assert len(own) == 3_000 and all(s is None for _, s, _ in own[:60]) and own[0][2] is None
    np.testing.assert_allclose([s for _, s, _ in own[60:]], [np.linalg.norm(want[k] - want[k - 60 : k].mean(axis=0)) for k in range(60, 3_000)], rtol=1e-9)
    np.testing.assert_allclose([d for _, _, d in own[1:]], np.abs(np.diff(want[:, 0])), rtol=1e-9, atol=1e-12)
    assert {r["score"] for r in got if r["series"] == "t"} == {None, 0.0}
    high = [(("s", k, 5.0 if 1_020 <= k < 1_030 or k == 2_048 or 2_999 <= k else k / 1e6)) for k in range(3_000)]
    scores = spark.createDataFrame(high, "series string, window_idx bigint, score double").selectExpr("*", "date_add(date'2000-01-01', cast(window_idx as int)) as end_date")
    found = [(r["duration_windows"], (r["episode_start"] - datetime.date(2000, 1, 1)).days, (r["peak_date"] - datetime.date(2000, 1, 1)).days) for r in scoring.episodes(scores, "score", 0.999).collect()]
    assert found == [(10, 1_020, 1_020), (1, 2_048, 2_048), (1, 2_999, 2_999)]


def test_a_series_is_not_gathered(spark):
    """Rows of one series go to tasks by block: no exchange of the features by series alone."""
    df = spark.range(5_000).selectExpr("'one' || cast(id % 1 as string) as series", "id as window_idx", "date_add(date'2000-01-01', cast(id as int)) as end_date", "cast(id as double) as f_1")
    out = scoring.trailing_scores(scoring.standardise(df, ["f_1"]), {"score": ["f_1"]})
    plan = out._jdf.queryExecution().executedPlan().toString()
    single = [line for line in plan.split("\n") if "Exchange hashpartitioning(series" in line and "__home" not in line and "__block" not in line]
    # only the aggregates, one row a series and task
    at = plan.split("\n")
    assert all("partial_" in at[at.index(line) + 1] for line in single)
