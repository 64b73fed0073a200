"""Algebraic laws of the signature, and the SQL form against the array form."""

import math

import numpy as np
import pytest

from braidpath.functions import chen, vectors
from braidpath.operators import signature
from braidpath.streaming.signature import concatenated

RNG = np.random.default_rng(7)


def test_layout():
    assert vectors.signature_length(20, 3) == 8_420
    assert vectors.signature_length(10, 5) == 111_110
    assert vectors.signature_length(2, 5, scalar=True) == 63
    assert vectors.level_slices(3, 3) == [(0, 3), (3, 12), (12, 39)]
    assert vectors.words(2, 2) == [(0,), (1,), (0, 0), (0, 1), (1, 0), (1, 1)]
    with pytest.raises(ValueError):
        vectors.level_size(0, 1)
    with pytest.raises(ValueError):
        chen.signatures(np.zeros((1, 2, 1)), 0)


def test_one_channel_has_powers_over_factorials():
    dx = RNG.normal(size=(5, 9, 1))
    got = chen.signatures(dx, 5)
    for k in range(1, 6):
        np.testing.assert_allclose(got[:, k - 1], dx.sum(axis=(1, 2)) ** k / math.factorial(k), atol=1e-12)


def test_one_segment_is_an_exponential():
    dx = RNG.normal(size=(1, 1, 3))
    got, x = chen.signatures(dx, 3)[0], dx[0, 0]
    np.testing.assert_allclose(got, np.concatenate([x, np.outer(x, x).ravel() / 2, np.einsum("i,j,k->ijk", x, x, x).ravel() / 6]), atol=1e-12)


def test_shuffle_identity():
    got = chen.signatures(RNG.normal(size=(4, 12, 3)), 2)
    one, two = got[:, :3], got[:, 3:].reshape(-1, 3, 3)
    np.testing.assert_allclose(np.einsum("ni,nj->nij", one, one), two + two.transpose(0, 2, 1), atol=1e-10)


def test_concatenation_and_refinement():
    dx = RNG.normal(size=(1, 10, 2))
    whole = chen.signatures(dx, 4)[0]
    parts = [chen.signatures(dx[:, :6], 4)[0], chen.signatures(dx[:, 6:], 4)[0]]
    np.testing.assert_allclose(concatenated(*parts, 2, 4), whole, atol=1e-9)
    np.testing.assert_allclose(chen.signatures(np.repeat(dx / 2, 2, axis=1), 4)[0], whole, atol=1e-9)
    np.testing.assert_allclose(chen.signatures(np.insert(dx, 4, 0.0, axis=1), 4)[0], whole, atol=1e-9)


def test_closed_and_constant_paths():
    loop = np.array([[[1.0, 0], [0, 1], [-1, 0], [0, -1]]])
    got = chen.signatures(loop, 2)[0]
    np.testing.assert_allclose(got, [0, 0, 0, 1, -1, 0], atol=1e-12)
    assert not chen.signatures(np.zeros((2, 5, 3)), 3).any()
    assert not chen.signatures(np.zeros((2, 0, 3)), 3).any()


def test_batches_are_bounded():
    assert chen.safe_batch(100, 20, 2, 3) == 100
    assert chen.safe_batch(100, 300, 10, 5) < 100
    assert chen.safe_batch(100, 300, 30, 5) >= 1


def test_sql_and_array_forms_agree(spark):
    rows = [("P" if s % 2 else "Q", s, t, *map(float, RNG.normal(size=2))) for s in range(8) for t in range(5 + s)]
    df = spark.createDataFrame(rows, "process string, series int, step int, a double, b double")
    sql = signature.signature_sql(df, ["a", "b"], 3, ["process", "series"])
    packed = signature.pack(df, ["a", "b"], ["process", "series"])
    arrays = signature.signatures(packed, 2, 3)
    left = {r["series"]: [r[f"s_{k}"] for k in range(1, 15)] for r in sql.collect()}
    right = {r["series"]: r["signature"] for r in arrays.collect()}
    assert left.keys() == right.keys() == set(range(8))
    for k in left:
        np.testing.assert_allclose(left[k], right[k], atol=1e-10)
    one = {(r["process"], r["coord"]): (r["n_paths"], r["mean"], r["std"]) for r in signature.expected_signature(packed, 2, 3).collect()}
    two = {(r["process"], r["coord"]): (r["n_paths"], r["mean"], r["std"]) for r in signature.expected_signature_sql(sql, 2, 3).collect()}
    assert one.keys() == two.keys() and len(one) == 28
    for k in one:
        np.testing.assert_allclose(one[k], two[k], atol=1e-10)
    other = signature.expected_signature(packed.repartition(7), 2, 3).collect()
    for r in other:
        np.testing.assert_allclose((r["n_paths"], r["mean"], r["std"]), one[r["process"], r["coord"]], atol=1e-10)


def test_points_lose_the_way_to_the_first_one(spark):
    df = spark.createDataFrame([("P", 1, [[5.0], [6.0], [8.0]]), ("P", 2, [[1.0]])], "process string, series int, steps array<array<double>>")
    got = {r["series"]: r["signature"] for r in signature.signatures(df, 1, 2, points=True).collect()}
    assert got == {1: [3.0, 4.5], 2: [0.0, 0.0]}
