"""Signatures of long paths and of sliding windows against whole-path signatures."""

import random

import numpy as np
import pytest

from braidpath.functions import chen
from braidpath.functions.vectors import signature_length
from braidpath.operators import long_paths, panel, signature


@pytest.fixture(scope="module")
def walks():
    rng = np.random.default_rng(11)
    return {"hot": rng.normal(size=(6_000, 2)).cumsum(axis=0) / 20, "other": rng.normal(size=(300, 2)), "two": np.array([[1.0, 2.0], [4.0, -1.0]]), "one": np.array([[5.0, 5.0]]), None: rng.normal(size=(50, 2))}


def points_of(spark, walks):
    rows = [(key, k // 7, k % 7, *map(float, x)) for key, walk in walks.items() for k, x in enumerate(walk)]
    rows += [("hot", 3, 9, None, 1.0), ("gone", 0, 0, 1.0, None)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "key string, day int, tick int, a double, b double")


@pytest.mark.parametrize("partitions,depth", [(1, 3), (3, 2), (23, 4)])
def test_long_paths(spark, walks, partitions, depth):
    """One path over all partitions, and many in one; points without a channel are left out."""
    got = {r["key"]: r for r in long_paths.path_signatures(points_of(spark, walks), ["a", "b"], depth, ["key"], ["day", "tick"], partitions).collect()}
    assert got.keys() == walks.keys()
    for key, walk in walks.items():
        want = chen.signatures(np.diff(walk, axis=0)[None], depth)[0]
        np.testing.assert_allclose(got[key]["signature"], want, rtol=1e-8, atol=1e-8 * max(1.0, np.abs(want).max()))
        assert got[key]["n_points"] == len(walk)


def test_equals_the_sql_form(spark, walks):
    rows = [(k, i, *map(float, x)) for k, walk in walks.items() if k for i, x in enumerate(np.diff(walk, axis=0))]
    sql = signature.signature_sql(spark.createDataFrame(rows, "key string, step int, a double, b double"), ["a", "b"], 3, ["key"])
    got = {r["key"]: r["signature"] for r in long_paths.path_signatures(points_of(spark, walks), ["a", "b"], 3, ["key"], ["day", "tick"], 9).collect()}
    for r in sql.collect():
        np.testing.assert_allclose(got[r["key"]], r[1:], rtol=1e-7, atol=1e-7)


def test_no_path_is_gathered(spark, walks):
    """The plan lists no points; only stretches, one a path and partition, meet by path."""
    df = points_of(spark, walks)
    plan = long_paths.path_signatures(df, ["a", "b"], 3, ["key"], ["day", "tick"], 16)._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "rangepartitioning" in plan
    found = long_paths.stretches(df, ["a", "b"], 3, ["key"], ["day", "tick"], 16).collect()
    assert len(found) <= 16 + len(walks) and len({r["block"] for r in found if r["key"] == "hot"}) > 5
    assert max(r["n_points"] for r in found) < 3_000
    assert long_paths.path_signatures(df.limit(0), ["a", "b"], 3, ["key"], ["day", "tick"], 4).count() == 0


@pytest.mark.parametrize("channels,depth", [(1, 5), (2, 4), (3, 3)])
def test_inverse_and_product(channels, depth):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(5, 9, channels)), rng.normal(size=(5, 4, channels))
    s, t = chen.signatures(a, depth), chen.signatures(b, depth)
    np.testing.assert_allclose(chen.product(s, t, channels, depth), chen.signatures(np.concatenate([a, b], axis=1), depth), rtol=1e-9, atol=1e-9)
    np.testing.assert_allclose(chen.inverse(s, channels, depth), chen.signatures(-a[:, ::-1], depth), rtol=1e-9, atol=1e-9)
    np.testing.assert_allclose(chen.product(s, chen.inverse(s, channels, depth), channels, depth), 0, atol=1e-7)
    steps = chen.prefixes(a, depth)
    for k in range(10):
        np.testing.assert_allclose(steps[:, k], chen.signatures(a[:, :k], depth), rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("depth,bound", [(3, 1e-12), (5, 1e-10)])
def test_error_of_sliding_windows(depth, bound):
    """What prefixes cancel, against each window by itself, in units of the length of the window's path; trending paths cancel most."""
    rng = np.random.default_rng(5)
    for drift in (0.0, 1.0, 20.0):
        x = rng.normal(size=(1_500, 3)) + drift
        starts = np.arange(1_481)
        got = chen.sliding(x, depth, 20, starts)
        whole = np.stack([x[s : s + 20] for s in starts])
        want = chen.signatures(whole, depth)
        lengths = np.linalg.norm(whole, axis=2).sum(axis=1)
        at = 0
        for k in range(1, depth + 1):
            error = np.abs(got[:, at : at + 3**k] - want[:, at : at + 3**k]).max(axis=1)
            assert (error / lengths**k).max() < bound
            at += 3**k


def test_sliding_over_blocks(spark):
    """Two series, one over three blocks; as many windows as rows allow."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2_300, 2))
    rows = [("s", k, float(a), float(b)) for k, (a, b) in enumerate(x)] + [("t", k, 1.0, 2.0) for k in range(5)] + [("short", 0, 1.0, 2.0)]
    returns = spark.createDataFrame(rows, "series string, idx bigint, r_1 double, r_2 double").selectExpr("series", "date_add(date'2000-01-01', cast(idx as int)) as date", "idx", "r_1", "r_2").repartition(5)
    got = signature.sliding_signatures(returns, 2, 3, 5)
    plain = signature.signatures(panel.packed_windows(returns, 2, 5), 2, 3)
    assert got.columns == plain.columns
    got, plain = ({(r["series"], r["window_idx"], r["end_date"]): r["signature"] for r in df.collect()} for df in (got, plain))
    assert got.keys() == plain.keys() and len(got) == 2_296 + 1
    for key, own in got.items():
        np.testing.assert_allclose(own, plain[key], rtol=1e-9, atol=1e-10)
    assert signature.sliding_signatures(returns.limit(0), 2, 3, 5).count() == 0
    assert len(next(iter(got.values()))) == signature_length(2, 3)
