import glob
import hashlib
import os
import uuid
from collections import defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from braidpath.llm import common, exact_dedup
from braidpath.llm.queries import QUERIES
from braidpath.sources import staging
from tests.conftest import DATA
from tests.llm.conftest import ROWS


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("slices", [1, 2, 5])
def test_decisions(spark, docs, slices):
    got = exact_dedup.dedup_batch(docs, exact_dedup.DigestIndex(spark, buckets=4), slices=slices).collect()
    groups = defaultdict(list)
    for i, t, *_ in ROWS:
        groups[lower(t)].append(i)
    assert len(got) == len(ROWS)
    by = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by[bytes(r["digest"]).hex()]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == max((i for i in ids if i is not None), default=None)
    assert sum(r["kept"] for r in got) == len(groups)
    # repeated rows: one of them stays
    assert sorted(r["kept"] for r in got if r["doc_id"] == 6) == [False, False]
    assert [r["kept"] for r in got if r["doc_id"] == 7] == [True]
    assert [r["kept"] for r in got if r["doc_id"] is None] == [True]


def test_rows_that_go_and_stay(docs, no_docs, make_docs):
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(lower(r["text"]) for r in kept.collect()) == sorted({lower(t) for _, t, *_ in ROWS})
    assert exact_dedup.drop_copies(no_docs).count() == 0
    twice = exact_dedup.drop_copies(make_docs([(1, "same", None, None, None)] * 5 + [(None, "x", None, None, None)] * 3))
    assert sorted(r["text"] for r in twice.collect()) == ["same", "x"]


def test_batches_meet_the_index(spark, make_docs):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    row = lambda i, t: (i, t, None, None, None)
    exact_dedup.dedup_batch(make_docs([row(1, "one"), row(2, "two")]), index)
    second = {r["doc_id"]: r for r in exact_dedup.dedup_batch(make_docs([row(9, "ONE"), row(8, "three"), row(7, "three")]), index).collect()}
    assert (second[9]["kept"], second[9]["keep_id"]) == (False, 1)
    assert second[8]["kept"] and not second[7]["kept"]
    assert exact_dedup.DigestIndex(spark, index.name).buckets == 4
    assert index.read().count() == index.read().select("digest").distinct().count() == 3
    # an index of an earlier application, under a new name
    again = exact_dedup.DigestIndex(spark, f"{index.name}_again", index.path, 4)
    assert again.buckets == 4 and again.read().count() == 3
    batch = make_docs([row(20, "Three"), row(21, "four")])
    for _ in range(2):  # a batch that is run again is decided alike
        third = exact_dedup.dedup_batch(batch, again, batch="third").collect()
        assert {(r["doc_id"], r["kept"], r["keep_id"]) for r in third} == {(20, False, 8), (21, True, 21)}
    assert exact_dedup.drop_copies(batch, again, batch="fourth").count() == 0
    assert [r["doc_id"] for r in exact_dedup.drop_copies(make_docs([row(1, "FOUR"), row(2, "five")]), again, batch="fifth").collect()] == [2]


@pytest.mark.parametrize("ids", [[-3, -2, None, 4, 4], ["b", "a", None, "z", "z"]])
def test_ids_of_any_kind(spark, ids):
    kind = "string" if "a" in ids else "bigint"
    df = spark.createDataFrame([(i, t) for i in ids for t in ("One", "one", f"own {i}")], f"doc_id {kind}, text string")
    got = exact_dedup.dedup_batch(df, slices=3).collect()
    assert len(got) == 15 and {r["keep_id"] for r in got if r["group_size"] == 10} == {max(i for i in ids if i is not None)}
    assert sum(r["kept"] for r in got) == 1 + len(set(ids)) == exact_dedup.drop_copies(df).count()


@pytest.mark.parametrize("run", [lambda spark: QUERIES["op9_exact_dedup"](spark, DATA).count(), lambda spark: exact_dedup.drop_copies(spark.read.parquet(f"{DATA}/documents.parquet")).count()])
def test_query_and_stage_meet_the_index(spark, monkeypatch, run):
    """Each slice is anti-joined with the index by sort-merge, without moving the index, and what is new is appended."""
    seen, append = [], exact_dedup.DigestIndex.append

    def spied(self, new):
        seen.append((new._jdf.queryExecution().executedPlan().toString(), self.read().count()))
        append(self, new)

    monkeypatch.setattr(exact_dedup.DigestIndex, "append", spied)
    assert run(spark) > 0
    assert len(seen) == 2 and seen[0][1] == 0 < seen[1][1]
    for plan, _ in seen:
        assert "SortMergeJoin" in plan and "LeftAnti" in plan and "SelectedBucketsCount" in plan
        # the index's side: a bucketed scan without an exchange above it
        scan = plan[plan.index("FileScan parquet spark_catalog") - 400 : plan.index("FileScan parquet spark_catalog")]
        assert "Exchange" not in scan


def test_hot_group(spark, make_docs):
    rows = [(k, "HOT" if k % 3 else "hot", None, None, None) for k in range(2000)] + [(5000 + k, f"t{k}", None, None, None) for k in range(1000)]
    got = exact_dedup.dedup_batch(make_docs(rows), exact_dedup.DigestIndex(spark, buckets=4)).collect()
    assert len(got) == 3000 and sum(r["kept"] for r in got) == 1001
    assert {r["keep_id"] for r in got if r["group_size"] == 2000} == {1999}


def test_copies_of_one_row_come_from_many_tasks(spark, monkeypatch):
    """Copies are made in pieces, wherever these land; each is one row, and one of them stays."""
    n = 300_000
    df = spark.range(n).selectExpr("7L as doc_id", "'Same' as text").unionByName(spark.createDataFrame([(1, "same"), (2, "other")], "doc_id bigint, text string"))
    got = exact_dedup.dedup_batch(df)
    tasks = got.filter("doc_id = 7").groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in tasks) == n and len(tasks) > 2 and max(r["count"] for r in tasks) < n / 2
    assert got.filter("kept").select("doc_id").distinct().count() == got.filter("kept").count() == 2
    monkeypatch.setattr(common, "COPIES_AT_ONCE", 3)
    few = spark.createDataFrame([(k, c, "x") for k, c in enumerate([1, 2, 3, 4, 6, 7, 50])], "k int, n bigint, __piece string").repartition(2)
    made = common.each_copy(few, "n", "copy", 50)
    assert sorted((r["k"], r["copy"]) for r in made.collect()) == [(k, i) for k, c in enumerate([1, 2, 3, 4, 6, 7, 50]) for i in range(c)]
    assert made.columns == ["k", "n", "__piece", "copy"]


def test_own_indexes_go_with_the_staged_tables(spark, make_docs, monkeypatch):
    """A named index stays; one that an application made for itself leaves neither a table nor files."""
    folder = f"{common.staged_dir(spark)}-own"
    monkeypatch.setattr(exact_dedup, "staged_dir", lambda spark: folder)
    monkeypatch.setattr(staging, "staged_dir", lambda spark: folder)
    monkeypatch.setattr(common, "_TEMPORARY", {})
    before = {t.name for t in spark.catalog.listTables()}
    assert exact_dedup.drop_copies(make_docs([(1, "a", None, None, None), (2, "A", None, None, None)])).count() == 1
    assert len({t.name for t in spark.catalog.listTables()} - before) == 1 and os.path.isdir(folder)
    common.clear_staged(spark)
    assert {t.name for t in spark.catalog.listTables()} == before and not os.path.exists(folder)


def test_compaction(spark, make_docs):
    """One sorted file a bucket, with as many or other buckets; decisions stay, and a join then sorts no index."""
    index = exact_dedup.DigestIndex(spark, f"digests_{uuid.uuid4().hex}", f"/tmp/braidpath-index-{uuid.uuid4().hex}", 4)
    row = lambda i, t: (i, t, None, None, None)
    for k in range(3):
        exact_dedup.dedup_batch(make_docs([row(100 * k + j, f"text {10 * k + j}") for j in range(30)]), index, batch=str(k))
    files = lambda: sorted(glob.glob(f"{index.path.removeprefix('file:')}/*.parquet"))
    held, old = sorted(map(tuple, index.read().collect())), index.path.removeprefix("file:")
    assert os.path.isdir(old)
    assert len(files()) > 4
    for buckets in (None, 8):
        index.compact(buckets)
        assert len(files()) == (buckets or 4) and sorted(map(tuple, index.read().collect())) == held
        for f in files():
            own = [bytes(v) for v in pq.read_table(f)["digest"].to_pylist()]
            assert own == sorted(own)
    assert not os.path.exists(old)
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    try:
        again = exact_dedup.DigestIndex(spark, index.name)
        assert again.buckets == 8
        plan = again.new(again.read().limit(3))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Sort [digest") == 1
    finally:
        spark.conf.unset("spark.sql.legacy.bucketedTableScan.outputOrdering")
    late = {r["doc_id"]: r["kept"] for r in exact_dedup.dedup_batch(make_docs([row(900, "TEXT 5"), row(901, "text 99")]), again).collect()}
    assert late == {900: False, 901: True}
    spark.sql(f"DROP TABLE {index.name}")
