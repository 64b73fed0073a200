"""Importance resampling of documents towards a target distribution, over hashed word n-grams.

A feature is a run of up to ``n_max`` consecutive words and falls into one of ``n_buckets`` by the CRC-32 of its UTF-8
bytes. DuckDB counts inside each partition: SQL unnests the words of a bounded block of texts, windows over them make the
runs, and a registered zlib function hashes each different run once. Each text's bucket counts are written as Parquet;
Spark merges them into the counts of the corpus, weighs every document by its buckets' log ratios of target to corpus, adds
Gumbel noise that depends on the id alone, and ranks by range-sorting. Drawing the highest noisy scores is sampling
without replacement in proportion to the importance weights.

What is defined:

* words are runs of digits, letters a-z (after lower-casing A-Z only) and all characters beyond ASCII; null texts have none;
* scores are whole thousandths, rounded down, so that sums are exact and reruns agree;
* equal scores are ordered by id (null first; its noise is that of an empty id), then by the number of features; rows that
  agree in all of these are alike, and which of them comes first is open;
* a text without words weighs 0; one of fewer than ``min_words`` words has a score but is never drawn;
* very long texts are counted whole, in a block of their own; an empty corpus or target leaves all counts at zero;
* other columns are not looked at, and may have any names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidpath.llm.common import stage, sums_before

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that one SQL statement gets, about; the last text whole.
BLOCK_BYTES = 4_000_000
FEATURES = "n_words bigint, n_features bigint, buckets array<struct<bucket: int, n: bigint>>"


def _crc32(grams: pa.Array) -> pa.Array:
    return pa.array(np.fromiter((zlib.crc32(g.encode()) for g in grams.to_pylist()), np.int64, len(grams)))


def _statement(n_max: int, n_buckets: int) -> str:
    """Bucket counts of the rows of ``block`` (place, text), one row each."""
    runs = ["SELECT place, word AS gram FROM words"]
    for n in range(2, n_max + 1):
        run = " || ' ' || ".join(["word", *[f"lead(word, {k}) OVER w" for k in range(1, n)]])
        runs.append(f"SELECT place, gram FROM (SELECT place, {run} AS gram FROM words WINDOW w AS (PARTITION BY place ORDER BY nth)) WHERE gram IS NOT NULL")
    return f"""
WITH texts AS MATERIALIZED (SELECT place, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORDS}') AS found FROM block),
words AS (SELECT place, unnest(found) AS word, generate_subscripts(found, 1) AS nth FROM texts),
grams AS MATERIALIZED (SELECT place, gram, count(*) AS n FROM ({" UNION ALL ".join(runs)}) GROUP BY ALL),
hashed AS (SELECT gram, CAST(crc32_of(gram) % {n_buckets} AS INTEGER) AS bucket FROM (SELECT DISTINCT gram FROM grams)),
counted AS (SELECT place, bucket, CAST(sum(n) AS BIGINT) AS n FROM grams JOIN hashed USING (gram) GROUP BY ALL),
listed AS (SELECT place, CAST(sum(n) AS BIGINT) AS n_features, list({{'bucket': bucket, 'n': n}} ORDER BY bucket) AS buckets FROM counted GROUP BY place)
SELECT CAST(len(found) AS BIGINT) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(buckets, []) AS buckets
FROM texts LEFT JOIN listed USING (place) ORDER BY place"""


def _blocks(texts: pa.Array) -> Iterator[slice]:
    """Stretches of rows of some BLOCK_BYTES each; a longer text is alone."""
    sizes = np.array([0 if v is None else v for v in pc.binary_length(texts).to_pylist()], np.int64)
    first, held = 0, 0
    for k, size in enumerate(sizes):
        if k > first and held + size > BLOCK_BYTES:
            yield slice(first, k)
            first, held = k, 0
        held += size
    if len(sizes) > first:
        yield slice(first, len(sizes))


def features(docs: DataFrame, n_max: int = 1, n_buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features and the counts of the buckets that each row's text has."""
    statement = _statement(n_max, n_buckets)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with duckdb.connect(config={"threads": 1}) as con:
            con.create_function("crc32_of", _crc32, [duckdb.sqltype("VARCHAR")], duckdb.sqltype("BIGINT"), type="arrow")
            for batch in batches:
                for part in _blocks(batch.column(1)):
                    own = batch.slice(part.start, part.stop - part.start)
                    con.register("block", pa.table({"place": pa.array(np.arange(own.num_rows)), "text": own.column(1)}))
                    found = con.sql(statement).to_arrow_table()
                    con.unregister("block")
                    yield from pa.table([own.column(0), *found.columns], names=["doc_id", *found.column_names]).combine_chunks().to_batches()

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"doc_id {id_type}, {FEATURES}")


def bucket_counts(found: DataFrame) -> DataFrame:
    """(bucket, n) of all rows together: at most as many rows as buckets."""
    return found.select(F.explode("buckets").alias("x")).groupBy("x.bucket").agg(F.sum("x.n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, n_buckets: int = 10_000) -> list[int]:
    """Each bucket's log ratio of target to corpus, with one added to every count, in whole thousandths.

    The two tables have a row a bucket at most, and so has the answer: its bound is the parameter.
    """
    own, other = (bucket_counts(x) for x in (corpus, target))
    both = corpus.sparkSession.range(n_buckets).select(F.col("id").cast("int").alias("bucket"))
    both = both.join(own.withColumnRenamed("n", "s"), "bucket", "left").join(other.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    rows = sorted(both.select("bucket", "s", "t").collect())
    all_s, all_t = (sum(r[c] for r in rows) for c in ("s", "t"))
    s, t = (np.array([r[c] for r in rows], float) for c in ("s", "t"))
    return np.floor(1000 * np.log((t + 1) * (all_s + n_buckets) / ((s + 1) * (all_t + n_buckets)))).astype(int).tolist()


def gumbel(doc_id: Column, seed: str = "2024") -> Column:
    """Noise of the extreme value law from the id alone, in whole thousandths."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def weigh(found: DataFrame, values: list[int]) -> Column:
    """The sum of the gains over a row's features; the gains are one literal array of fixed length."""
    table = F.from_json(F.lit(str(values)), "array<bigint>")
    return F.aggregate("buckets", F.lit(0).cast("bigint"), lambda sum_, x: sum_ + x["n"] * F.get(table, x["bucket"]))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, n_max: int = 1, n_buckets: int = 10_000, seed: str = "2024", id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_features, weight, score, rank.

    Of the documents with ``min_words`` words, ``percent`` in a hundred are drawn, those of highest score; ``rank`` counts
    them from 1 and is null for all others. No task sees all scores: they are range-sorted and numbered by partition.
    """
    own = stage(features(docs, n_max, n_buckets, id_col, text_col), "importance-buckets")
    target = target.select(F.lit(0).alias("id"), F.col(target_col).alias("text"))
    values = gains(own, features(target, n_max, n_buckets, "id", "text"), n_buckets)
    rows = own.withColumn("weight", weigh(own, values)).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    enough, columns = F.col("n_words") >= min_words, ["doc_id", "n_features", "weight", "score"]
    drawn = own.filter(enough).count() * percent // 100
    ranked = rows.filter(enough).select(*columns, (-F.col("score")).alias("down"))
    ranked = sums_before(ranked, ["down", "doc_id", "n_features"], {"before": F.lit(1).cast("bigint")}, "importance-ranks")
    ranked = ranked.select(*columns, F.when(F.col("before") < drawn, F.col("before") + 1).alias("rank"))
    return ranked.unionByName(rows.filter(~enough).select(*columns, F.lit(None).cast("bigint").alias("rank")))


def draw(docs: DataFrame, ranked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that ``resample`` drew, all columns kept; ids must tell the rows apart."""
    own = ranked.filter(F.col("rank").isNotNull()).select(F.col("doc_id").alias(id_col))
    return docs.join(own, id_col, "left_semi")
