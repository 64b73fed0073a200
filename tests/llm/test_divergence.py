import random
import re
from collections import Counter, defaultdict

import pytest

from braidpath.llm import divergence
from tests.llm.conftest import ROWS

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, min_docs, top, scale, prior):
    counts, having = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = terms(text)
        counts[lang or "", source or ""].update(found)
        having[lang or ""].update(set(found))
    out = []
    for lang in having:
        kept = [t for t, n in having[lang].items() if n >= min_docs]
        groups = {s: c for (g, s), c in counts.items() if g == lang}
        whole = sum(groups.values(), Counter())

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + scale * (c[t] + prior) // (total + prior * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in groups.items()}, shares(whole)
        for s in groups:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in groups if o != s))
            out += [(lang, s, "pair", o.decode(), -v, k) for k, (v, o) in enumerate(pairs, 1)]
            over = sorted(((q[t] - p[s][t], t.encode()) for t in kept if groups[s][t] and p[s][t] > q[t]))[:top]
            out += [(lang, s, "term", t.decode(), -v, k) for k, (v, t) in enumerate(over, 1)]
    return sorted(out)


def rows_of(rng, n):
    """Texts of a few sources over terms of falling frequency, each source with a taste of its own."""
    out = []
    for _ in range(n):
        lang, source = rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "É", "", None, "hot", "hot", "hot"])
        words = [f"{'Tt'[rng.random() < 0.5]}{chr(97 + min(25, int(rng.expovariate(0.2))))}{(source or 'x')[0] if rng.random() < 0.2 else ''}" for _ in range(rng.randrange(30))]
        out.append((" ".join(words) + "é漢" * rng.randrange(2), lang, source))
    return out


@pytest.mark.parametrize("min_docs,top,scale,prior", [(30, 50, 1_000_000_000, 5), (2, 3, 1000, 1), (10, 50, 1_000_000_000, 5)])
def test_brute_force(spark, min_docs, top, scale, prior):
    rows = rows_of(random.Random(7), 900)
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    got = divergence.audit(docs, min_docs, top, scale, prior).collect()
    want = brute(rows, min_docs, top, scale, prior)
    assert len({r[1] for r in want}) > 4 and any(r[2] == "term" for r in want)
    assert sorted(tuple(r) for r in got) == want


@pytest.mark.parametrize("min_docs", [1, 2, 30])
def test_odd_rows(docs, no_docs, min_docs):
    """Nulls as empty, groups without terms, languages without kept terms or with one source."""
    got = divergence.audit(docs, min_docs).collect()
    assert sorted(tuple(r) for r in got) == brute([(t, lang, s) for _, t, lang, s, _ in ROWS], min_docs, 50, 1_000_000_000, 5)
    assert divergence.audit(no_docs, min_docs).count() == 0


def test_counting_in_pieces(spark, monkeypatch):
    """How often a task sends its counts on changes nothing."""
    docs = spark.createDataFrame(rows_of(random.Random(3), 200), "text string, lang string, source string")
    once = sorted(tuple(r) for r in divergence.audit(docs, 5).collect())
    monkeypatch.setattr(divergence, "MAX_COUNTED", 10)
    assert sorted(tuple(r) for r in divergence.audit(docs, 5).collect()) == once


def test_shares_past_long(spark):
    """Counts whose product with the scale passes 64 bits."""
    rows = spark.createDataFrame([(10**12, 3 * 10**12, 7)], "n bigint, total bigint, v bigint")
    assert rows.select(divergence.share("n", "total", "v", 10**9, 5)).first()[0] == 1 + 10**9 * (10**12 + 5) // (3 * 10**12 + 35)
