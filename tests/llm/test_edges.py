"""Every operator on documents over the odd rows of the shared fixture, whose other columns clash with all self-made names."""

from collections import defaultdict
from types import SimpleNamespace

import pytest

from braidpath.llm import bpe, exact_dedup, mixing, quality_rules, rule_ensemble, secret_scan, simhash, text_stats, toxicity
from braidpath.llm import common
from tests.llm.conftest import ROWS


def labels(spark):
    return spark.createDataFrame([(k, k % 2, k % 2) for k in range(1, 10)] + [(1, 0, 0), (None, 1, 1), (2, None, None)], "doc_id bigint, quality int, toxic int")


OPERATORS = {
    "bpe": lambda spark, d: bpe.encode_documents(d, bpe.rank_file()),
    "toxicity": lambda spark, d: toxicity.score(d, toxicity.fit(d, labels(spark))),
    "quality_rules": lambda spark, d: quality_rules.judge(d, quality_rules.fit(d, labels(spark))),
    "simhash": lambda spark, d: simhash.near_components(d),
    "rule_ensemble": lambda spark, d: rule_ensemble.classify(d, rule_ensemble.fit(d, labels(spark))),
    "exact_dedup": lambda spark, d: exact_dedup.dedup_batch(d, slices=2),
    "secret_scan": lambda spark, d: secret_scan.scan_documents(d),
    "text_stats": lambda spark, d: text_stats.text_stats(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_rows(spark, docs, no_docs, name):
    """One row a row, null ids kept, repeated rows alike, nothing for an empty table."""
    got = OPERATORS[name](spark, docs).collect()
    assert sorted((r["doc_id"] for r in got), key=repr) == sorted((r[0] for r in ROWS), key=repr)
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add(repr(r))
    assert all(len(found) == 1 for found in by.values())
    assert OPERATORS[name](spark, no_docs).count() == 0


@pytest.mark.parametrize("name", ["quality", "exact", "near", "mixed"])
def test_stages(docs, no_docs, spark, name):
    forest = quality_rules.fit(docs, labels(spark))
    step = {"quality": lambda d: quality_rules.keep_good(d, forest), "exact": exact_dedup.drop_copies, "near": simhash.drop_near_copies, "mixed": mixing.curriculum}[name]
    out = step(docs)
    assert out.columns == docs.columns
    rows = {tuple(r) for r in docs.collect()}
    assert all(tuple(r) in rows for r in out.collect())
    assert step(no_docs).count() == 0


def test_shared_dir():
    """The session's folder, or one of this machine in local mode alone."""

    def session(folder, master):
        conf = SimpleNamespace(get=lambda key, default=None: folder or default)
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, getConf=lambda: conf)
        return SimpleNamespace(conf=conf, sparkContext=context)

    assert common.shared_dir(session("hdfs://x/y/", "yarn")) == "hdfs://x/y"
    assert common.shared_dir(session(None, "local[4]")) == common.FALLBACK_CHECKPOINT_DIR
    for master in ("yarn", "local-cluster[3,2,1024]", "spark://host:7077"):
        with pytest.raises(ValueError):
            common.shared_dir(session(None, master))


def test_sums_before(spark):
    rows = spark.createDataFrame([(k % 5, k, float(k)) for k in range(50)], "a int, b int, c double").repartition(4)
    got = common.sums_before(rows, ["a", "b"], {"n": common.F.lit(1).cast("bigint"), "s": common.F.col("c")}, "test").collect()
    order = sorted(got, key=lambda r: (r["a"], r["b"]))
    for k, r in enumerate(order):
        assert r["n"] == k and r["s"] == sum(x["c"] for x in order[:k])


def test_one_row_each(spark):
    rows = spark.createDataFrame([(k % 3 if k < 3000 else k, "x") for k in range(3100)], "k int, __row string").repartition(4)
    stay = rows.groupBy(common.F.col("k").alias("key")).agg(common.F.count("*").alias("n")).filter("key <> 1")
    got = common.one_row_each(rows, common.F.col("k"), stay, "n")
    assert got.columns == rows.columns
    assert sorted(r["k"] for r in got.collect()) == [0, 2, *range(3000, 3100)]
