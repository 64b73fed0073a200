"""Co-moments by tiles against pair-by-pair numpy, with nulls; the number of columns changes no result."""

import numpy as np
import pytest

from braidpath.operators import distance, moments


def table_of(spark, x, names, keys):
    rows = [(k, *[None if np.isnan(v) else float(v) for v in r]) for k, r in zip(keys, x)]
    return spark.createDataFrame(rows, "process string, " + ", ".join(f"{n} double" for n in names)).repartition(4)


def pairwise(x, i, j, sample):
    both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
    n = both.sum()
    if n == 0 or sample and n < 2:
        return None
    a, b = x[both, i], x[both, j]
    return ((a - a.mean()) * (b - b.mean())).sum() / (n - 1 if sample else n)


@pytest.mark.parametrize("sample", [False, True])
@pytest.mark.parametrize("d", [3, 7, 70])
def test_pairs_over_the_rows_that_have_both(spark, d, sample):
    rng = np.random.default_rng(d)
    x = rng.normal(size=(90, d)) * rng.uniform(0.1, 30, d) + 1e4
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 1] = np.nan  # never there
    x[1:, 2] = np.nan  # once
    keys = ["a" if k % 3 else "b" for k in range(90)]
    names = [f"x_{k}" for k in range(1, d + 1)]
    got = {(r["process"], r["i"], r["j"]): r["covariance"] for r in moments.covariances(table_of(spark, x, names, keys), names, sample=sample).collect()}
    assert len(got) == 2 * d * d
    for key in "ab":
        own = x[[k == key for k in keys]]
        for i in range(d):
            for j in range(d):
                want, found = pairwise(own, i, j, sample), got[key, i + 1, j + 1]
                assert (want is None) == (found is None), (key, i, j)
                if want is not None:
                    assert abs(found - want) <= 1e-9 * max(1.0, abs(want)) * 10


def test_width_changes_nothing(spark):
    """One null in a column: as much is known of it beside six columns as beside seven."""
    x = np.arange(56, dtype=float).reshape(8, 7) ** 1.5
    x[0, 0] = np.nan
    names = [f"x_{k}" for k in range(1, 8)]
    df = table_of(spark, x, names, ["p"] * 8)
    of = lambda n: {(r["i"], r["j"]): r["covariance"] for r in moments.covariances(df, names[:n], sample=True).collect()}
    six, seven = of(6), of(7)
    for place, value in six.items():
        assert value is not None and abs(seven[place] - value) < 1e-9 * abs(value)
    mean = lambda n: {r["i"]: r["mean"] for r in moments.means(df, names[:n]).collect()}
    assert all(abs(mean(7)[i] - m) < 1e-9 for i, m in mean(6).items())
    columns = lambda n: {r["channel"]: r[2:] for r in moments.sample_moments(df, names[:n]).collect()}
    for channel, own in columns(6).items():
        np.testing.assert_allclose(columns(7)[channel], own, rtol=1e-9)


def test_tiles_in_several_passes(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x, names = rng.normal(size=(40, 9)), [f"x_{k}" for k in range(1, 10)]
    df = table_of(spark, x, names, [None if k % 2 else "p" for k in range(40)])
    once = sorted(map(tuple, moments.covariances(df, names).collect()), key=repr)
    monkeypatch.setattr(moments, "TILE", 2)
    monkeypatch.setattr(moments, "TILES_AT_ONCE", 4)
    again = sorted(map(tuple, moments.covariances(df, names).collect()), key=repr)
    assert [r[:3] for r in once] == [r[:3] for r in again]
    np.testing.assert_allclose([r[3] for r in once], [r[3] for r in again], rtol=1e-9)
    sizes = moments.co_moments(df, names).groupBy("process").count().collect()
    assert sorted(r["count"] for r in sizes) == [45, 45]
    assert moments.covariances(df.limit(0), names).count() == 0


def test_distances_from_long_rows(spark):
    rng = np.random.default_rng(1)
    x, names = rng.normal(size=(60, 8)), [f"x_{k}" for k in range(1, 9)]
    keys = ["ABC"[k % 3] for k in range(60)]
    df = table_of(spark, x, names, keys)
    got = {r["comparison"]: r[1:] for r in distance.moment_distances(moments.means(df, names), moments.covariances(df, names), [("A", "B"), ("B", "C")]).collect()}
    of = {k: x[[key == k for key in keys]] for k in "ABC"}
    for a, b in ("AB", "BC"):
        want = (np.linalg.norm(of[a].mean(0) - of[b].mean(0)), np.linalg.norm(np.cov(of[a].T, bias=True) - np.cov(of[b].T, bias=True)))
        np.testing.assert_allclose(got[f"{a}_vs_{b}"], want, rtol=1e-9)
    summary = {r["process"]: r for r in moments.vector_summary(df, df, names).collect()}
    np.testing.assert_allclose(np.reshape(summary["A"]["terminal_cov"], (8, 8)), np.cov(of["A"].T, bias=True), rtol=1e-9)
