import datetime as dt
import glob
import random

import numpy as np
import pytest

from braidpath.operators import intervals, scoring, selection
from braidpath.sources import staging

DAY = dt.date(2020, 1, 1)


def plan_of(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("partitions", [1, 7])
def test_quantiles(spark, partitions):
    """Hot and small groups, ties, nulls, one value, against numpy's interpolation."""
    rng = random.Random(5)
    groups = {
        "hot": [rng.gauss(0, 1) for _ in range(5_000)],
        "ties": [float(rng.randrange(3)) for _ in range(3_000)],
        "same": [7.0] * 1_000,
        "one": [2.5],
        "two": [1.0, 4.0],
        "far": [1e300, -1e300, 1e-300, 0.0, -0.0],
        None: [1.0, 2.0, 3.0],
        "none": [],
    }
    rows = [(g, v) for g, values in groups.items() for v in values] + [("none", None), ("two", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "series string, v double").repartition(partitions)
    wanted = [0.0, 0.1, 0.5, 0.95, 1.0]
    got = {r["series"]: r[1:] for r in selection.quantiles(df, "v", wanted).collect()}
    assert got.keys() == groups.keys() - {"none"}
    for g, own in got.items():
        np.testing.assert_allclose(own, np.quantile(groups[g], wanted), rtol=1e-12, atol=1e-300)
    with pytest.raises(ValueError):
        selection.quantiles(df, "v", [1.5])


def test_quantiles_of_several_keys_and_nothing(spark):
    df = spark.createDataFrame([(a, b, float(a * b)) for a in range(3) for b in range(1, 40)], "a int, b int, v double").withColumn("c", (selection.F.col("b") % 2).cast("int"))
    got = {(r["c"], r["a"]): r["m"] for r in selection.quantiles(df, "v", [0.5], ["c", "a"], ["m"]).collect()}
    assert got == {(c, a): float(np.median([a * b for b in range(1, 40) if b % 2 == c])) for c in (0, 1) for a in range(3)}
    assert selection.quantiles(df.limit(0), "v", [0.5], ["c", "a"]).count() == 0


def test_no_task_gets_a_series(spark):
    """Neither a percentile nor a window over a series' values or runs: what is ordered by series alone are counts of ranges and runs at edges."""
    df = spark.range(4_000).selectExpr("'s' as series", "id as window_idx", "date_add(date'2000-01-01', cast(id as int)) as end_date", "cast(pmod(id * 7919, 4001) as double) as score")
    for out in (scoring.thresholds(df, "score"), scoring.episodes(df, "score"), scoring.period_summary(df, "score", [("p", "2001-01-01", "2002-01-01")])):
        assert "percentile" not in plan_of(out).lower()
    # ranges hold parts of the series, each counted by itself
    before = set(glob.glob(f"{staging.staged_dir(spark)}/quantiles-*"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows become one range
    try:
        scoring.thresholds(df, "score")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    (path,) = set(glob.glob(f"{staging.staged_dir(spark)}/quantiles-*")) - before
    assert spark.read.parquet(path).select("__range").distinct().count() > 1


def frame(spark, scores, start=0):
    rows = [("m", start + k, None if v is None else float(v)) for k, v in enumerate(scores)]
    return spark.createDataFrame(rows, "series string, window_idx bigint, score double").selectExpr("*", "date_add(date'2000-01-01', cast(window_idx as int)) as end_date")


def runs_of(scores, threshold):
    out, k = [], 0
    while k < len(scores):
        if scores[k] is not None and scores[k] >= threshold:
            z = k
            while z + 1 < len(scores) and scores[z + 1] is not None and scores[z + 1] >= threshold:
                z += 1
            peak = max(range(k, z + 1), key=lambda i: (scores[i], -i))
            out.append((k, z, peak, scores[peak], z - k + 1))
            k = z
        k += 1
    return sorted(out)


def found(df, q):
    return sorted(((r["episode_start"] - dt.date(2000, 1, 1)).days, (r["episode_end"] - dt.date(2000, 1, 1)).days, (r["peak_date"] - dt.date(2000, 1, 1)).days, r["peak_score"], r["duration_windows"]) for r in scoring.episodes(df, "score", q).collect())


@pytest.mark.parametrize("shape", ["alternating", "one run", "two at the edge", "random", "whole blocks"])
def test_episodes_by_merging(spark, shape, monkeypatch):
    """Runs over many cells of both sizes, against a plain loop."""
    monkeypatch.setattr(scoring, "BLOCK", 8)
    monkeypatch.setattr(scoring, "CELLS", (8, 64))
    rng, n = random.Random(2), 700
    scores = {
        "alternating": [float(k % 2) for k in range(n)],
        "one run": [1.0] * n,
        "two at the edge": [float(k in (63, 64, 511, 512, 7, 8, n - 1)) for k in range(n)],
        "random": [None if k < 9 else float(rng.random() < 0.9) * (1 + rng.randrange(3)) for k in range(n)],
        "whole blocks": [float((k // 8) % 3 != 0) for k in range(n)],
    }[shape]
    df = frame(spark, scores).repartition(5)
    threshold = float(np.quantile([s for s in scores if s is not None], 0.55))
    assert found(df, 0.55) == runs_of(scores, threshold)


def test_interval_join(spark):
    """Points and ranges against all pairs; each hit once, whatever the cells."""
    rng = random.Random(4)
    day = lambda: DAY + dt.timedelta(rng.randrange(-400, 400))
    spans = [(k, a, a + dt.timedelta(rng.choice([0, 1, 5, 63, 64, 300, -1]))) for k, a in ((k, day()) for k in range(60))] + [(60, None, DAY), (61, DAY, None)]
    points = [(k, day()) for k in range(200)] + [(200, None)]
    left = spark.createDataFrame(points, "a int, at date")
    right = spark.createDataFrame(spans, "b int, start date, end date")
    want = sorted((k, m) for k, at in points for m, s, e in spans if at and s and e and s <= at <= e)
    for days in (1, 64, 10_000):
        assert sorted((r["a"], r["b"]) for r in intervals.interval_join(left, right, ("at", "at"), ("start", "end"), days=days).collect()) == want
    more = right.withColumnsRenamed({"b": "c", "start": "from", "end": "to"})
    got = intervals.interval_join(right, more, ("start", "end"), ("from", "to"), days=7)
    want = sorted((k, m) for k, a, b in spans for m, c, d in spans if a and b and c and d and a <= b and c <= d and max(a, c) <= min(b, d))
    assert sorted((r["b"], r["c"]) for r in got.collect()) == want
    assert got.columns == ["b", "start", "end", "c", "from", "to"]
    plan = plan_of(intervals.interval_join(left.hint("merge"), right, ("at", "at"), ("start", "end")))
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    with pytest.raises(ValueError):
        intervals.interval_join(left, right.withColumnRenamed("b", "A"), ("at", "at"), ("start", "end"))


def test_interval_join_by_key(spark):
    left = spark.createDataFrame([("x", DAY), ("y", DAY)], "k string, at date")
    right = spark.createDataFrame([("x", DAY, DAY, 1), ("z", DAY, DAY, 2)], "k string, s date, e date, v int")
    assert [tuple(r) for r in intervals.interval_join(left, right, ("at", "at"), ("s", "e"), ["k"]).collect()] == [("x", DAY, DAY, DAY, 1)]


def test_periods_as_a_table(spark):
    """Overlapping ranges, repeated names: a window counts for each range that holds it."""
    df = frame(spark, [None, 1, 2, 3, 4, 5, 6, 7])
    at = lambda k: str(dt.date(2000, 1, 1) + dt.timedelta(k))
    rows = [("all", at(0), at(7)), ("late", at(5), at(7)), ("late", at(6), at(7)), ("warm-up", at(0), at(0)), ("never", at(90), at(99))]
    table = spark.createDataFrame(rows, "period string, start_date string, end_date string")
    got = sorted((r["period"], str(r["start_date"]), r["window_count"], r["median_score"], r["mean_score"]) for r in scoring.period_summary(df, "score", table).collect())
    assert got == sorted([("all", at(0), 8, 4.0, 4.0), ("late", at(5), 3, 6.0, 6.0), ("late", at(6), 2, 6.5, 6.5), ("warm-up", at(0), 1, None, None)], key=repr)
