"""Exact dedup against a persistent digest index, bucketed and sorted by digest.

Texts are equal when identical after lower-casing A-Z only; null counts as empty. A text's digest is the SHA-256
of that form in UTF-8. The index is a table of one row a digest, written in buckets of the digest and sorted within
them. Every batch meets it in a sort-merge anti-join that doesn't move the index, and the digests that are new are
appended in the same layout; an index begins empty, so the first batch takes the same way. A batch may enter in slices
of falling id: a later slice finds the digests of the earlier ones in the index, and all decisions are read from there.

What is defined:

* of equal rows of one batch the one with the largest id stays (a null id is smaller than any other; ids may be of any
  type with an order); of rows that share id and text, one stays;
* a digest that an earlier batch brought stays with the row it came with, so all rows of the batch that have it go;
* a batch is known by its name: one that fails after its digests are in the index is decided alike when run again;
* null and empty texts are equal; very long texts are digested whole; an empty table adds nothing and gives no rows;
* other columns are not looked at, and may have any names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braidpath.llm.common import each_copy, hot_lookup, one_row_each, shared_dir, stage, staged_dir, temporary_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """A-Z lower-cased, all else kept; ``lower`` does the same, and faster, where a text is ASCII."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


class DigestIndex:
    """A catalog table (digest, keep_id, batch) in buckets of the digest, at a place in the shared folder.

    The number of buckets holds until ``compact`` changes it; a name that the catalog has is attached as it is. Without a name
    the index is one of the application's own, which ``clear_staged`` removes.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None, buckets: int = 32, id_type: str = "bigint"):
        self.spark, self.name = spark, name or f"digest_index_{uuid.uuid4().hex}"
        if not name:  # of this application alone
            temporary_table(spark, self.name)
        if not spark.catalog.tableExists(self.name):
            at = path or f"{shared_dir(spark) if name else staged_dir(spark)}/{self.name}"
            self._create(at, buckets, id_type)
        made = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED `{self.name}`").collect()}
        self.buckets, self.path = int(made["Num Buckets"]), made["Location"]

    def _create(self, at: str, buckets: int, id_type: str) -> None:
        self.spark.sql(f"CREATE TABLE `{self.name}` (digest BINARY, keep_id {id_type}, batch STRING) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{at}'")

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def new(self, groups: DataFrame) -> DataFrame:
        """The rows of ``groups`` (one a digest) whose digest the index lacks; only they are dealt out, by the bucketing hash."""
        return groups.repartition(self.buckets, "digest").hint("merge").join(self.read(), "digest", "left_anti")

    def append(self, new: DataFrame) -> None:
        """One file a bucket and call: ``new`` is already dealt out by bucket."""
        new.write.bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).mode("append").saveAsTable(self.name)

    def compact(self, buckets: int | None = None) -> None:
        """Write the index anew, one sorted file a bucket, in ``buckets`` buckets if given; the old files go when the new ones are there.

        With one file a bucket and ``spark.sql.legacy.bucketedTableScan.outputOrdering`` a join needs no sort of the index.
        """
        # read by path: Spark would take a scan of the table as dealt out, and then split its files
        own, buckets, old = self.spark.read.schema(self.read().schema).parquet(self.path), buckets or self.buckets, self.path
        id_type = own.schema["keep_id"].dataType.simpleString()
        at, made = f"{old.rstrip('/')}-{uuid.uuid4().hex}", f"{self.name}_{uuid.uuid4().hex}"
        own.repartition(buckets, "digest").write.bucketBy(buckets, "digest").sortBy("digest").option("path", at).saveAsTable(made)
        # both are external tables: dropping them leaves the files
        self.spark.sql(f"DROP TABLE `{made}`")
        self.spark.sql(f"DROP TABLE `{self.name}`")
        self._create(at, buckets, id_type)
        self.buckets, self.path = buckets, at
        gone = self.spark._jvm.org.apache.hadoop.fs.Path(old)
        gone.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(gone, True)


def bucket_count(n_rows: int) -> int:
    """Buckets for an index that begins with so many rows: half a million each, and some to spare for growth."""
    return max(8, min(20_000, n_rows // 250_000))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(digest, doc_id, copies), written: rows that share id and text become one with a count."""
    rows = docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("digest"))
    return stage(rows.groupBy("digest", "doc_id").agg(F.count("*").alias("copies")), "digests")


def _slices(rows: DataFrame, n: int) -> list[DataFrame]:
    """``rows`` cut into n by falling id, null ids last; the cuts are places in the sorted ids of 1,000 rows of least hash."""
    if n == 1:
        return [rows]
    seen = sorted(r["doc_id"] for r in rows.filter("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(1_000).select("doc_id").collect())
    cuts = [seen[len(seen) * k // n] for k in range(n - 1, 0, -1)] if seen else []
    at = F.col("doc_id")
    # a cut of the ids' own type: the greater ones first
    below = [F.lit(True), *[F.coalesce(at < F.lit(c), F.lit(True)) for c in cuts]]
    above = [*[F.coalesce(at >= F.lit(c), F.lit(False)) for c in cuts], F.lit(True)]
    return [rows.filter(b & a) for b, a in zip(below, above)]


def admit(rows: DataFrame, index: DigestIndex, batch: str, slices: int = 1) -> None:
    """Let the digests of ``rows`` (as from ``digests``) that the index lacks into it."""
    for part in _slices(rows, slices):
        # written, as the optimiser would else join before it aggregates and gather the rows of a hot digest
        groups = stage(part.groupBy("digest").agg(F.max("doc_id").alias("keep_id")), "digest-slice")
        index.append(index.new(groups).select("digest", "keep_id", F.lit(batch).alias("batch")))


def decisions(rows: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """(digest, keep_id, own, group_size, n_rows): one row a digest of ``rows``; own: this batch brought it."""
    groups = rows.groupBy("digest").agg(F.sum("copies").alias("group_size"), F.count("*").alias("n_rows"))
    held = index.read().select("digest", "keep_id", (F.col("batch") == batch).alias("own"))
    return stage(groups.repartition(index.buckets, "digest").hint("merge").join(held, "digest"), "digest-groups")


def dedup_batch(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None, slices: int = 1) -> DataFrame:
    """Decide on each row of ``docs`` and append its new digests to ``index`` (None: one of its own).

    Returns one row for each of ``docs``: doc_id, digest, keep_id (of the row that stays, maybe from an earlier
    batch), group_size (equal rows in this batch), kept.
    """
    rows, batch = digests(docs, id_col, text_col), batch or uuid.uuid4().hex
    index = index or _own_index(rows)
    admit(rows, index, batch, slices)
    found = hot_lookup(rows, decisions(rows, index, batch), "digest", "n_rows")
    found = each_copy(found, "copies", "copy", rows.agg(F.max("copies")).first()[0] or 0)
    kept = F.col("own") & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 0)
    return found.select("doc_id", "digest", "keep_id", "group_size", kept.alias("kept"))


def _own_index(rows: DataFrame) -> DigestIndex:
    return DigestIndex(rows.sparkSession, buckets=bucket_count(rows.count()), id_type=rows.schema["doc_id"].dataType.simpleString())


def drop_copies(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None, slices: int = 2) -> DataFrame:
    """``docs`` with one row of each group of equal texts that no earlier batch of ``index`` had, all columns kept."""
    rows, batch = digests(docs, id_col, text_col), batch or uuid.uuid4().hex
    index = index or _own_index(rows)
    admit(rows, index, batch, slices)
    own = index.read().filter(F.col("batch") == batch).select("digest", F.col("keep_id").alias("doc_id"))
    # the row that stays is known by digest and id, up to repeats of both
    of = rows.withColumn("key", F.struct("digest", "doc_id"))
    stay = stage(of.join(own.select(F.struct("digest", "doc_id").alias("key")), "key", "left_semi").select("key", F.col("copies").alias("n_rows")), "exact-stay")
    return one_row_each(docs, F.struct(digest(F.col(text_col)).alias("digest"), F.col(id_col).alias("doc_id")), stay, "n_rows")
