"""Helpers shared by the training-data operators: staging, lookups that survive hot keys, Arrow mapping."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from braidpath.sources import staging
from braidpath.sources.staging import FALLBACK_CHECKPOINT_DIR, shared_dir, stage, staged_dir  # noqa: F401
from braidpath.sources.tables import table  # noqa: F401

#: ASCII white space; words are maximal runs of anything else.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


#: Tables of the catalog that live no longer than the application's staged tables, by application.
_TEMPORARY: dict[str, set[str]] = {}


def temporary_table(spark: SparkSession, name: str) -> None:
    """Have ``clear_staged`` drop the table; its files should lie in ``staged_dir``."""
    _TEMPORARY.setdefault(spark.sparkContext.applicationId, set()).add(name)


def clear_staged(spark: SparkSession) -> None:
    """Remove the application's staged and temporary tables; results that are still lazy read from them, so write these before."""
    for name in _TEMPORARY.pop(spark.sparkContext.applicationId, ()):
        spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    staging.clear_staged(spark)


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores before it until no column of ``frames`` is called so."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema) -> DataFrame:
    """Apply ``fn`` to each Arrow batch of ``df`` inside its own task; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield fn(batch)

    return df.mapInArrow(run, schema)


def each_text(column: pa.Array) -> Iterator[str]:
    """Texts one at a time, null as empty, so that only one Python copy lives at once."""
    for value in column:
        yield value.as_py() or ""


def hot_lookup(rows: DataFrame, facts: DataFrame, key: str, n_rows: str, total: int | None = None, hot_share: int = 1000) -> DataFrame:
    """Inner-join ``rows`` with ``facts`` (one row a key; column ``n_rows`` holds how many rows the key has).

    A key with over 1/hot_share of all rows is hot. There can be at most ``hot_share`` such keys, so that
    part of ``facts`` may be broadcast and the rows of hot keys are never gathered; the others join by a
    plain shuffle, where no key holds more than 1/hot_share of the rows. ``total`` is the number of rows, if known.
    """
    if total is None:
        total = facts.agg(F.sum(n_rows)).first()[0] or 0
    is_hot = F.col(n_rows) > max(1, total // hot_share)
    hot = F.broadcast(facts.filter(is_hot))
    return rows.join(hot, key).unionByName(rows.join(F.broadcast(facts.filter(is_hot).select(key)), key, "left_anti").join(facts.filter(~is_hot), key))


#: Copies of one row that a task makes at most.
COPIES_AT_ONCE = 10_000


def each_copy(rows: DataFrame, count: str, name: str, most: int) -> DataFrame:
    """``rows`` as often as ``count`` says, with ``name`` numbering the copies of a row from 0; ``most`` is the largest count.

    The copies of a row that has very many are dealt out in pieces, so that no task makes them all.
    """

    def numbered(part: DataFrame, first: Column, last: Column) -> DataFrame:
        return part.withColumn(name, F.explode(F.sequence(first, last)))

    zero, last = F.lit(0).cast("bigint"), F.col(count).cast("bigint") - 1
    if most <= COPIES_AT_ONCE:
        return numbered(rows, zero, last)
    piece, many = fresh("__piece", rows), F.col(count) > COPIES_AT_ONCE
    # a row a piece, dealt out evenly and, the number of tasks being given, not gathered again for being few
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = rows.filter(many).withColumn(piece, F.explode(F.sequence(zero, F.floor(last / COPIES_AT_ONCE)))).repartition(tasks)
    pieces = numbered(pieces, F.col(piece) * COPIES_AT_ONCE, F.least(last, (F.col(piece) + 1) * COPIES_AT_ONCE - 1))
    return numbered(rows.filter(~many), zero, last).unionByName(pieces.drop(piece))


def one_row_each(rows: DataFrame, key: Column, stay: DataFrame, n_rows: str, hot_share: int = 1000) -> DataFrame:
    """One of the rows of each key that is in ``stay`` (one row a key: ``key``, and ``n_rows``, how many rows have it).

    The rows of keys with over 1/hot_share of all rows, at most ``hot_share`` keys, are reduced to one in each task
    before they move; no other key holds more than 1/hot_share of the rows.
    """
    total = stay.agg(F.sum(n_rows)).first()[0] or 0
    is_hot, name = F.col(n_rows) > max(1, total // hot_share), fresh("__row", rows)
    # of one type on both sides, so that what deals out the join also serves the reduction after it
    keyed, keys = rows.withColumn(name, key.cast(stay.schema["key"].dataType)), stay.withColumnRenamed("key", name)
    parts = [keyed.join(side, name, "left_semi").dropDuplicates([name]) for side in (keys.filter(~is_hot), F.broadcast(keys.filter(is_hot)))]
    return parts[0].unionByName(parts[1]).select(rows.columns)


def sums_before(rows: DataFrame, order: Sequence[str], sums: Mapping[str, Column], name: str) -> DataFrame:
    """``rows`` with, for each of ``sums``, the sum over all rows that come before in ``order`` (which tells all rows apart).

    No task gets all rows: they are range-sorted and written, and each partition adds the totals of those before it,
    of which there are as many as partitions.
    """
    dealt = rows.withColumns(dict(sums)).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = stage(dealt.withColumn("__bucket", F.spark_partition_id()), name)
    earlier = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = dealt.groupBy("__bucket").agg(*[F.sum(c).alias(c) for c in sums])
    whole = whole.select("__bucket", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"__to_{c}") for c in sums])
    inside = Window.partitionBy("__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumns({c: F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums}).join(F.broadcast(whole), "__bucket")
    return out.withColumns({c: F.col(c) + F.col(f"__to_{c}") for c in sums}).drop("__bucket", *[f"__to_{c}" for c in sums])


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))
