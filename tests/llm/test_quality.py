"""Statistics, boosted trees, quality rules and the rule ensemble."""

import re
from collections import Counter

import numpy as np
import pytest

from braidpath.llm import quality_rules, rule_ensemble, text_stats, trees
from tests.conftest import DATA
from tests.llm.conftest import ROWS

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {k + j for k, w in enumerate(windows) if w in often for j in range(3)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered)


@pytest.mark.parametrize("text", [t for _, t, *_ in ROWS] + ["a b a b a b a", "x\nx\n \n\nx y", "a b c d\na b c\n", "w " * 10, "#a *b* <c>"])
def test_counts(text):
    assert text_stats.counts(text or "")[:5] == brute(text)


def test_counts_with_many_distinct_words():
    words = [b"%d" % k for k in range(300)] * 2
    assert text_stats.repeated_words(words, {w: k for k, w in enumerate(dict.fromkeys(words))}) == 600


def test_monotone_trees():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 3))
    y = (rng.random(3000) < 1 / (1 + np.exp(2 * np.sin(2 * x[:, 0]) + x[:, 1]))).astype(float)
    free = trees.fit_boosted(x, y, n_trees=30)
    bound = trees.fit_boosted(x, y, n_trees=30, monotone=(-1, -1, 0))
    grid = np.stack([np.linspace(-3, 3, 200), np.zeros(200), np.zeros(200)], 1)
    assert (np.diff(bound.margin(grid)) <= 1e-12).all() and (np.diff(free.margin(grid)) > 1e-6).any()
    for _ in range(20):
        base = np.repeat(rng.normal(size=(1, 3)), 100, 0)
        base[:, 1] = np.linspace(-3, 3, 100)
        assert (np.diff(bound.margin(base)) <= 1e-12).all()
    # the node arrays against walking each tree
    for row in x[:20]:
        total = bound.base
        for t in range(len(bound.feature)):
            at = 0
            while bound.left[t, at] != at:
                at = bound.left[t, at] if row[bound.feature[t, at]] <= bound.threshold[t, at] else bound.right[t, at]
            total += bound.value[t, at]
        assert abs(total - bound.margin(row[None])[0]) < 1e-9


def test_one_class_is_a_constant():
    forest = trees.fit_boosted(np.zeros((4, 2)), np.ones(4))
    assert forest.margin(np.zeros((0, 2))).shape == (0,) and forest.probability(np.zeros((2, 2))).min() > 0.9
    assert len(trees.fit_boosted(np.zeros((0, 2)), np.zeros(0)).feature) == 0


def test_verdicts(spark, docs, no_docs):
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(1, 10)] + [(None, 1), (2, None)], "doc_id bigint, quality int")
    forest = quality_rules.fit(docs, labels)
    got = quality_rules.judge(docs, forest).collect()
    assert len(got) == len(ROWS)
    texts = {i: t for i, t, *_ in ROWS}
    for r in got:
        b = brute(texts[r["doc_id"]])
        assert tuple(r)[1:6] == b
        assert r["base_failed"] == (b[0] < 50 or 100 * b[4] > 50 * b[0])
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.judge(no_docs, forest).count() == 0
    kept = quality_rules.keep_good(docs, forest)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)


def test_held_out_quality(spark):
    sf = DATA.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = rule_ensemble.classify(docs, rule_ensemble.fit(docs, labels)).join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 50 and np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
    got = quality_rules.judge(docs, quality_rules.fit(docs, labels)).join(labels, "doc_id").filter("not base_failed and crc32(cast(cast(doc_id as string) as binary)) % 4 = 2").collect()
    assert np.mean([r["kept"] == bool(r["quality"]) for r in got]) > 0.95


def test_rules_as_a_column_equal_their_definition(spark, docs, no_docs):
    rng = np.random.default_rng(2)
    x = np.abs(rng.normal(size=(800, len(text_stats.RATES))))
    y = ((x[:, 2] > 0.8) ^ (x[:, 1] > 1.5)).astype(float)
    model = rule_ensemble.fit_rules(x, y)
    assert 0 < len(model.rules) < 400
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x[:100]], list(text_stats.RATES))
    got = [r[0] for r in frame.select(model.score()).collect()]
    want = []
    for row in x[:100]:
        values = dict(zip(text_stats.RATES, row))
        total = model.intercept + sum(w for rule, w in zip(model.rules, model.weights) if all(values[n] <= c if low else values[n] > c for n, low, c in rule))
        want.append(1 / (1 + np.exp(-total)))
    np.testing.assert_allclose(got, want, atol=1e-9)
    assert np.mean((np.array(want) >= 0.5) == y[:100]) > 0.9
    out = rule_ensemble.classify(docs, model).collect()
    assert len(out) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in out)
    assert rule_ensemble.classify(no_docs, model).count() == 0


def test_lasso_leaves_out_what_says_nothing():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2, (2000, 12)).astype(float)
    y = (rng.random(2000) < 1 / (1 + np.exp(-(3 * x[:, 0] - 1.5)))).astype(float)
    w, _ = rule_ensemble.lasso_logistic(x, y, 0.02)
    assert w[0] > 1.5 and (w[1:] == 0).sum() >= 9
