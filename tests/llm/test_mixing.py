import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from braidpath.llm import mixing
from tests.conftest import DATA
from tests.llm.conftest import ROWS


def fill(sizes, weights, share=1.5, epochs=2):
    """Shares by weight, the excess over the caps dealt again until there is none."""
    left, target, open_ = share * sum(sizes.values()), dict.fromkeys(sizes, 0.0), set(sizes)
    while open_ and left > 1e-9:
        whole = sum(weights[s] for s in open_)
        want = {s: target[s] + left * weights[s] / whole for s in open_}
        full = {s for s in open_ if want[s] >= epochs * sizes[s]}
        if not full:
            target |= want
            break
        for s in full:
            left -= epochs * sizes[s] - target[s]
            target[s] = epochs * sizes[s]
        open_ -= full
    return target


def weights_of(sources):
    order = sorted((s for s in sources if s is not None), key=lambda s: s.encode()) + [None] * (None in sources)
    return {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 50, "c": 10}, {"a": 5, "b": 5, "c": 500, None: 7}, {"x": 0, "y": 10}, {f"s{k}": k * k for k in range(11)}, {"only": 9}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([("=" + s if s is not None else "", s, n) for s, n in sizes.items()], "key string, source string, source_size bigint")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    want = fill(sizes, weights_of(sizes))
    assert got.keys() == want.keys()
    for s in sizes:
        assert got[s] == pytest.approx(want[s], abs=1e-6)


def test_training_time_inverts_the_integral(spark):
    for a, b in ((1.5, 0.5), (0.5, 1.5), (1.0, 1.0), (2.0, 0.0)):
        for t in (0.0, 0.2, 0.5, 1.0):
            u = (a * t + (b - a) * t * t / 2) / ((a + b) / 2)
            got = spark.range(1).select(mixing.training_time(F.lit(u), F.lit(a), F.lit(b))).first()[0]
            assert got == pytest.approx(t, abs=1e-6)


def check(rows, n):
    assert len(rows) == n
    by = defaultdict(list)
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert (r["first_position"] is None) == (r["taken"] == 0)
        assert all(0 <= p <= 1 for p in r["starts"]) and r["starts"] == sorted(r["starts"])
        by[r["source"]].append(r)
    sizes = {s: sum(r["size"] for r in own) for s, own in by.items()}
    want = fill(sizes, weights_of(sizes))
    for s, own in by.items():
        assert {r["source_size"] for r in own} == {sizes[s]}
        assert abs(sum(r["taken"] for r in own) - want[s]) <= 1


def test_documents(docs, no_docs):
    rows = mixing.mix(docs).collect()
    check(rows, len(ROWS))
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in ROWS}
    assert all(r["size"] == words[r["doc_id"]] for r in rows)
    assert mixing.mix(no_docs).count() == 0
    again = mixing.curriculum(docs)
    assert again.columns == docs.columns and again.count() == sum(len(r["starts"]) for r in rows)
    assert mixing.curriculum(no_docs).count() == 0


def test_reruns_agree(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    key = lambda r: (r["doc_id"], r["taken"], tuple(r["starts"]))
    one = mixing.mix(df).collect()
    check(one, df.count())
    assert sorted(map(key, one)) == sorted(map(key, mixing.mix(df.repartition(7)).collect()))


def test_equal_steps_of_position_hold_equal_words(spark):
    """The position of a visit is the share of all words taken before it, up to a document of each source."""
    rows = mixing.mix(spark.read.parquet(f"{DATA}/documents.parquet")).collect()
    visits = sorted((p, r["size"]) for r in rows for p in r["starts"])
    whole, largest, sources = sum(n for _, n in visits), max(n for _, n in visits), len({r["source"] for r in rows})
    seen = 0
    for p, n in visits:
        assert abs(p - seen / whole) <= sources * largest / whole
        seen += n
    # and the shares move as scheduled: the first source gives more words at first than later
    first = min(r["source"] for r in rows)
    early, late = (sum(r["size"] for r in rows if r["source"] == first for p in r["starts"] if a <= p < a + 0.3) for a in (0.0, 0.7))
    assert early > 1.5 * late
    assert [r["first_position"] for r in rows if r["taken"]] == sorted(r["first_position"] for r in rows if r["taken"])


def test_copies_of_one_row(spark, monkeypatch):
    """Rows that share id, source and text, a third of all: each has a stretch, none is lost or doubled."""
    rows = [(1, "the same words again", "a", k) for k in range(300)] + [(None, f"null id {k}", "a", k) for k in range(300)] + [(k, f"text {k} " * (k % 5), "b", k) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, __position bigint").repartition(5)
    mixed = mixing.mix(df).collect()
    check(mixed, 900)
    got = [tuple(r) for r in mixing.curriculum(df, partitions=3).collect()]
    assert len(got) == sum(len(r["starts"]) for r in mixed) and set(got) <= set(rows)
    assert max(map(got.count, set(got))) <= 2
    by = lambda rows_: sum(t == "the same words again" for t in rows_)
    assert by(r[1] for r in got) == sum(len(r["starts"]) for r in mixed if r["doc_id"] == 1 and r["source"] == "a")


def test_many_sources(spark):
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 29).cast("int")).alias("text"))
    check(mixing.mix(df).collect(), 400)


def test_curriculum(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    visits = {r["doc_id"]: r["starts"] for r in mixing.mix(df).collect()}
    got = mixing.curriculum(df, partitions=3)
    assert got.columns == df.columns
    order = [r["doc_id"] for r in got.collect()]
    want = [i for _, i in sorted((p, i) for i, starts in visits.items() for p in starts)]
    assert order == want


def test_a_source_with_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 2)
    df = spark.range(1500).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 11).cast("string"))).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 13).cast("int")).alias("text"))
    check(mixing.mix(df).collect(), 1500)
