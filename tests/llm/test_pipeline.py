"""The pipeline against the same steps in plain Python, and the registered queries against their SQL."""

import hashlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from braidpath.llm import bpe, mixing, quality_rules
from braidpath.llm.queries import QUERIES, SQL
from braidpath.llm.text_stats import counts, rates
from tests.conftest import DATA
from tests.llm.test_exact_dedup import lower
from tests.llm.test_simhash import brute_components, brute_fingerprint
from tests.test_queries import rows


def test_run_equals_plain_python(spark):
    got = corpus_pipeline.run(spark, DATA).collect()
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    forest = quality_rules.fit(docs, labels)
    left = {}
    for r in docs.collect():
        c = np.array([counts(r["text"])])
        if c[0, 0] >= 50 and 100 * c[0, 4] <= 50 * c[0, 0] and forest.probability(rates(c))[0] >= quality_rules.KEEP_FROM:
            left[r["doc_id"]] = r
    last = {lower(r["text"]): i for i, r in sorted(left.items())}
    left = {i: left[i] for i in sorted(last.values())}
    ids = list(left)
    left = {ids[c]: left[ids[c]] for c in set(brute_components([brute_fingerprint(left[i]["text"]) for i in ids], 2))}
    rest = docs.filter(docs["doc_id"].isin(list(left)))
    visits = {r["doc_id"]: len(r["starts"]) for r in mixing.mix(rest).collect()}
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, n in visits.items() for _ in range(n))
    for r in got:
        text = left[r["doc_id"]]["text"]
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert r["ids"] == np.frombuffer(bpe.encoder(bpe.rank_file()).encode([text])[0], "<u4").tolist()


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, DATA)
        assert out.columns == docs.columns and out.count() > 0
        assert step(spark, docs.limit(0), DATA).count() == 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    want, got = con.sql(SQL[name]), QUERIES[name](spark, DATA)
    assert sorted(want.columns) == sorted(got.columns)
    assert rows(want.columns, want.fetchall()) == rows(got.columns, got.collect())


def test_there_is_one_query_an_operator():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 14))
