import numpy as np
import xxhash

from braidpath.llm import toxicity
from tests.conftest import DATA
from tests.llm.conftest import ROWS


def test_thresholds_ascend_and_severity_follows_the_grade():
    rng = np.random.default_rng(0)
    grades = rng.integers(0, 4, 800)
    cols = np.tile([0, 1], 800)
    values = np.stack([grades + rng.normal(0, 0.4, 800), rng.normal(size=800)], 1).ravel()
    texts = toxicity.Sparse(np.full(800, 2), cols, values, 2)
    each = toxicity.Sparse(np.ones(2, int), np.arange(2), np.ones(2), 2)
    w, theta = toxicity.fit_ordinal(texts, each, np.ones(2), grades, 4, steps=1500)
    assert (np.diff(theta) > 0).all() and w[0] > 10 * abs(w[1])
    # brute force: no step in any direction is better
    loss = lambda w_, t_: toxicity.likelihood(texts.times(w_), t_, grades)[0] + toxicity.L2 * (w_ @ w_) / 2
    for move in np.vstack([np.eye(5), -np.eye(5)]) * 0.02:
        assert loss(w + move[:2], theta + move[2:]) >= loss(w, theta) - 1e-6
    model = toxicity.OrdinalModel(np.zeros(0), tuple(theta))
    severity = model.at_least(w[0] * np.arange(4.0)).sum(1)
    assert (np.diff(severity) > 0.5).all() and np.abs(severity - np.arange(4)).max() < 0.5
    p = model.at_least(rng.normal(size=50) * 5)
    assert (np.diff(p, axis=1) <= 0).all()


def test_held_out_documents(spark):
    sf = DATA.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    held = labels.filter("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2")
    rows = toxicity.score(docs, model).withColumnRenamed("toxic", "flag").join(held, "doc_id").collect()
    hit = [r["flag"] for r in rows if r["toxic"]]
    false = [r["flag"] for r in rows if not r["toxic"]]
    assert len(hit) > 5 and sum(hit) >= 0.5 * len(hit) and sum(false) <= 0.02 * len(false)


def test_edges(spark, docs, no_docs):
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 10)] + [(None, 1), (1, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r["severity"] <= 3 for r in got)
    alone = toxicity.fit(docs, labels.filter("toxic = 0"))
    assert all(r["severity"] < 1e-6 and not r["toxic"] for r in toxicity.score(docs, alone).collect())
    assert toxicity.score(no_docs, model).count() == 0
    assert len(toxicity.fit(no_docs, labels).weights) == 0


def test_likelihood_and_its_slopes():
    rng = np.random.default_rng(1)
    s, theta, grades = rng.normal(size=30) * 2, np.array([-1.0, 0.5, 1.5]), rng.integers(0, 4, 30)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    plain = lambda s_, t_: -np.mean([np.log((sigmoid(x - t_[g - 1]) if g else 1.0) - (sigmoid(x - t_[g]) if g < 3 else 0.0)) for x, g in zip(s_, grades)])
    value, ds, dtheta = toxicity.likelihood(s, theta, grades)
    assert np.isclose(value, plain(s, theta))
    for k in range(30):
        assert np.isclose(ds[k], (plain(s + 1e-5 * (np.arange(30) == k), theta) - plain(s - 1e-5 * (np.arange(30) == k), theta)) / 2e-5, atol=1e-7)
    for k in range(3):
        assert np.isclose(dtheta[k], (plain(s, theta + 1e-5 * (np.arange(3) == k)) - plain(s, theta - 1e-5 * (np.arange(3) == k))) / 2e-5, atol=1e-7)


def test_scores_equal_brute_force(spark, docs):
    """Every word and part of every text looked up by itself, and every probability added up."""
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 10)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    weights = np.random.default_rng(2).normal(size=1 << toxicity.FEATURE_BITS)
    model = toxicity.OrdinalModel(weights, model.thresholds)

    def plain(text):
        words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        total = 0.0
        for w in sorted(set(words)):
            marked = "^" + w + "$"
            names = {w} | {"#" + marked[k : k + 4] for k in range(len(marked)) if k == 0 or k + 4 <= len(marked)}
            places = {xxhash.xxh32_intdigest(n) // 2 ** (32 - toxicity.FEATURE_BITS) for n in names}
            total += np.log(1 + words.count(w)) * sum(weights[p] for p in places)
        above = [1.0, *(1 / (1 + np.exp(t - total)) for t in model.thresholds), 0.0]
        each = [a - b for a, b in zip(above, above[1:])]
        return sum(k * p for k, p in enumerate(each)), int(np.argmax(each)), above[1]

    short = docs.filter("length(text) < 1000 or text is null")
    by = sorted((plain(r["text"]) for r in short.collect()))
    got = sorted((r["severity"], r["grade"], r["p_toxic"]) for r in toxicity.score(short, model).collect())
    assert np.allclose(by, got)


def test_rare_forms_are_known_by_their_parts(spark):
    """No form of the word comes twice, so none is in the vocabulary; those scored were not learned from."""
    form = lambda k: "grumbl" + "".join(chr(97 + int(c)) for c in str(1000 + k))
    rows = [(k, f"plain words of the day number and {form(k) if k % 4 == 0 else ''} else") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    new = spark.createDataFrame([(1, f"words of the day and {form(901)} else"), (2, "words of the day and else")], docs.schema)
    assert {r["doc_id"]: r["toxic"] for r in toxicity.score(new, model).collect()} == {1: True, 2: False}


def test_sparse_products():
    rng = np.random.default_rng(6)
    sizes = np.array([3, 0, 2, 0, 4, 0])
    cols, values = rng.integers(0, 7, 9).astype(np.int32), rng.normal(size=9)
    dense, ones = np.zeros((6, 9)), np.zeros((6, 9))
    for r, c, v in zip(np.repeat(np.arange(6), sizes), cols, values):
        dense[r, c] += v
        ones[r, c] += 1
    m, w, t = toxicity.Sparse(sizes, cols, values, 9), rng.normal(size=9), rng.normal(size=6)
    np.testing.assert_allclose(m.times(w), dense @ w)
    np.testing.assert_allclose(m.transposed(t), dense.T @ t)
    np.testing.assert_allclose(m.holding(t), ones.T @ t)
    np.testing.assert_allclose(toxicity.Sparse(sizes, cols, None, 9).times(w), ones @ w)
    assert not toxicity.Sparse(np.zeros(2, int), cols[:0], None, 9).times(w).any()


def test_sample_is_bounded_in_rows(spark, monkeypatch):
    """One labelled id may have any number of rows: one of them is learned from, the same whatever the order."""
    rows = [(k, f"word{k} and more") for k in range(20)] + [(3, f"copy {j}") for j in range(5_000)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id bigint, toxic int")
    seen, counted = [], toxicity._counted
    monkeypatch.setattr(toxicity, "_counted", lambda sample: seen.append(counted(sample)) or seen[-1])
    for parts in (1, 7):
        toxicity.fit(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts), labels)
    assert seen[0].num_rows <= 20 and seen[0].equals(seen[1])


def test_derived_grades_equal_brute_force():
    """Marked words and cuts from the definition, text by text."""
    rng = np.random.default_rng(12)
    n_words, marked = 40, set(range(5))
    toxic = rng.random(300) < 0.4
    rows = []
    for t in toxic:
        own = {int(w): int(rng.integers(1, 4)) for w in rng.choice(np.arange(5, n_words), 8, replace=False)}
        if t:
            own |= {int(w): int(rng.integers(1, 5)) for w in rng.choice(5, rng.integers(1, 5), replace=False)}
        rows.append(own)
    sizes = np.array([len(r) for r in rows])
    cols = np.array([w for r in rows for w in r], np.int32)
    values = np.log1p(np.array([c for r in rows for c in r.values()], np.float32))
    got = toxicity.derived_grades(toxicity.Sparse(sizes, cols, values, n_words), toxic, 4)

    def is_marked(w):
        a, b = (sum(w in r for r, t in zip(rows, toxic) if t == kind) for kind in (True, False))
        odds = np.log((a + 0.5) / (toxic.sum() - a + 0.5)) - np.log((b + 0.5) / ((~toxic).sum() - b + 0.5))
        return odds > toxicity.MARKED_ODDS and odds / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)) > toxicity.MARKED_Z

    assert {w for w in range(n_words) if is_marked(w)} == marked
    hits = [sum(c for w, c in r.items() if w in marked) for r in rows]
    cuts = sorted(set(np.quantile([h for h, t in zip(hits, toxic) if t], [1 / 3, 2 / 3]).tolist()))
    assert got.tolist() == [1 + sum(c < h for c in cuts) if t else 0 for h, t in zip(hits, toxic)]
    assert set(got) == {0, 1, 2, 3}


def test_evidence_equals_brute_force():
    rng = np.random.default_rng(13)
    toxic = rng.random(120) < 0.5
    words = [set(rng.choice(30, 6, replace=False).tolist()) | ({0} if t else set()) for t in toxic]
    features = [sorted(set(rng.choice(12, 3, replace=False).tolist())) for _ in range(30)]
    texts = toxicity.Sparse(np.array([len(w) for w in words]), np.array([k for w in words for k in sorted(w)], np.int32), np.ones(sum(map(len, words))), 30)
    spread = toxicity.Sparse(np.array([3] * 30), np.array([f for own in features for f in own], np.int32), None, 12)
    got = toxicity.evidence(texts, spread, toxic)
    for f in range(12):
        # a document counts once for each of its words that has the feature
        a, b = (sum(f in features[w] for own, t in zip(words, toxic) if t == kind for w in own) for kind in (True, False))
        z = (np.log((a + 0.5) / (toxic.sum() + 1)) - np.log((b + 0.5) / ((~toxic).sum() + 1))) / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        assert np.isclose(got[f], np.sign(z) * max(abs(z) - toxicity.SHRINK, 0) / 5)


def test_features_without_evidence_change_nothing():
    rng = np.random.default_rng(14)
    sizes, n_words, n_features = rng.integers(0, 6, 80), 25, 40
    words_of = rng.integers(0, n_words, sizes.sum()).astype(np.int32)
    counts = rng.integers(1, 4, sizes.sum())
    per_word = rng.integers(1, 5, n_words)
    places = rng.integers(0, n_features, per_word.sum()).astype(np.int32)
    scale = np.where(rng.random(n_features) < 0.3, rng.normal(size=n_features), 0.0)
    grades = rng.integers(0, 3, 80)
    texts = toxicity.Sparse(sizes, words_of, np.log1p(counts.astype(np.float32)), n_words)
    spread = toxicity.Sparse(per_word, places, None, n_features)
    whole, theta = toxicity.fit_ordinal(texts, spread, scale, grades, 3, steps=60)
    small_texts, small_spread, used = toxicity.without_evidence(sizes, words_of, counts, per_word, places, scale)
    own, own_theta = toxicity.fit_ordinal(small_texts, small_spread, scale[used], grades, 3, steps=60)
    np.testing.assert_allclose(own * scale[used], (whole * scale)[used], rtol=1e-6, atol=1e-9)
    np.testing.assert_allclose(own_theta, theta, rtol=1e-6)
    assert not (whole * scale)[scale == 0].any() and small_spread.n_cols == len(used) == (scale != 0).sum()
