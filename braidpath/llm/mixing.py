"""Mixing sources to target weights along a time-varying curriculum.

Sources have base weights that set how many words each gives to the mix: a share of the budget by weight, at most
``max_epochs`` times the source's size, with the excess shared anew among the others until none is above. Over the
mix, time t running from 0 to 1, a source's weight moves linearly from ``start`` to ``end`` times its mean; its
integral is the part of the target demanded by time t. A document holds a stretch of its source's stream of words, in
an order given by a digest of its id and text; inverting the integral at the stretch's beginning gives the time at which
the mix comes to the document. Its training position is the demand of all sources together up to that time, as a share of
the whole: equal steps of position hold equal numbers of words, however the sum of the weights moves. Range-sorting
by position is the curriculum.

A source's stream goes round its documents until the target is reached, so the words taken sum to the target rounded
to a word; only the last document of a stream is taken in part. Reruns agree, whatever the partitions. Defined are:

* null and empty texts have size 0 and are never visited; very long texts are counted whole;
* a null source is a source of its own, last in order; a null id orders like an empty one;
* repeated ids are separate rows; rows that share id, source and text are copies of one: each has a stretch of its own,
  and which copy has which is open;
* equal positions are ordered by id; an empty table gives an empty mix;
* other columns may have any names; ``curriculum`` returns them, ``mix`` doesn't look at them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from braidpath.llm.common import WORD_PATTERN, each_copy, hot_lookup, stage, sums_before

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: A source's weight at the begin and the end of training, as multiples of its mean weight, repeating like WEIGHTS.
SCHEDULES = ((1.5, 0.5), (0.5, 1.5), (1.0, 1.0))
#: Rows of a source that one window task sorts at most, about.
BUCKET_ROWS = 50_000


def n_words(text: Column) -> Column:
    """Words of ASCII white space: what is left between separators after trimming, counted without making strings."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, max_epochs: int = 2, weights=WEIGHTS, schedules=SCHEDULES) -> DataFrame:
    """From (key, source, source_size) one row a source with its weight, target and schedule.

    All targets are min(cap, level x weight) for one level that spends the budget. With the sources in order of
    cap / weight, those before some place are at their cap; running sums give the level for each place at once. Both orders
    are range-sorted, so there may be as many sources as documents.
    """
    k = len(weights)
    x = sums_before(sizes.withColumn("none", F.col("source").isNull()), ["none", "source"], {"place": F.lit(1).cast("bigint")}, "mix-places")
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.col("place") % k + 1).cast("int"))
    x = x.withColumns({"weight": pick(weights), "w_start": pick([a for a, _ in schedules]), "w_end": pick([b for _, b in schedules])})
    x = x.withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    x = sums_before(x, ["ratio", "none", "source"], {"caps": F.col("cap"), "weights": F.col("weight")}, "mix-levels")
    words, whole = x.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(share * (words or 0)) - F.col("caps")) / (F.lit(whole) - F.col("weights"))
    # the level of the first place at which it stays under that place's own cap; none: all are at their caps
    level = x.withColumn("level", level).filter("level <= ratio").agg(F.min_by("level", F.struct("ratio", "none", "source"))).first()[0]
    target = F.col("cap") if level is None else F.least(F.col("cap"), F.lit(level) * F.col("weight"))
    return x.select("key", "source", "source_size", "weight", target.alias("target"), "w_start", "w_end")


def training_time(consumed: Column, w_start: Column, w_end: Column) -> Column:
    """The time by which the integral of a linear weight, scaled to 1 over the whole, has reached ``consumed``."""
    # integral: (a t + (b - a) t^2 / 2) / ((a + b) / 2) = u, solved for t in a form without cancellation
    a, slope, u = w_start, w_end - w_start, consumed * (w_start + w_end) / 2
    return F.when(u > 0, F.least(F.lit(1.0), 2 * u / (a + F.sqrt(F.greatest(a * a + 2 * slope * u, F.lit(0.0)))))).otherwise(0.0)


def demand_curve(targets: DataFrame) -> tuple[float, float, float]:
    """(a, b, all): by time t the sources together demand a t + b t^2 words, of ``all``; three sums over the sources."""
    mean = (F.col("w_start") + F.col("w_end")) / 2
    return tuple(v or 0.0 for v in targets.agg(F.sum(F.col("target") * F.col("w_start") / mean), F.sum(F.col("target") * (F.col("w_end") - F.col("w_start")) / (2 * mean)), F.sum("target")).first())


def source_key(source: Column) -> Column:
    """The source as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def order_key(doc_id: Column, text: Column) -> Column:
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))


def _stretches(docs: DataFrame, share: float, max_epochs: int, weights, schedules, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """(identities, places): a written row for each id, source and text with its number of copies, and a row a copy.

    ``places`` has identity, copies, copy (from 0) and the columns of ``mix``.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), order_key(F.col(id_col), F.col(text_col)).alias("order_key"))
    # copies become one row with a count, so nothing later meets them singly
    rows = rows.withColumn("key", source_key(F.col("source"))).groupBy("key", "order_key").agg(*[F.first(c).alias(c) for c in ("doc_id", "source", "size")], F.count("*").alias("copies"))
    rows = stage(rows.withColumn("identity", F.struct("key", "order_key")), "mix-sizes")
    # a source is cut by the first digits of the order key, so that no window holds a whole source
    digits = 2
    while rows.count() / 16**digits > BUCKET_ROWS:
        digits += 1
    x = rows.withColumns({"bucket": F.substring("order_key", 1, digits), "words": F.col("size") * F.col("copies")})
    buckets = x.groupBy("key", "bucket").agg(F.min("source").alias("source"), F.sum("words").alias("bucket_size"))
    up_to = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = buckets.groupBy("key").agg(F.min("source").alias("source"), F.sum("bucket_size").alias("source_size"))
    targets = stage(source_targets(sizes, share, max_epochs, weights, schedules), "mix-targets")
    slope, bend, whole = demand_curve(targets)
    facts = buckets.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(up_to), F.lit(0))).drop("source", "bucket_size")
    facts = facts.join(targets.drop("source", "weight"), "key")
    inside = Window.partitionBy("key", "bucket").orderBy("order_key").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("inner_start", F.coalesce(F.sum("words").over(inside), F.lit(0))).join(facts, ["key", "bucket"])
    x = each_copy(x, "copies", "copy", rows.agg(F.max("copies")).first()[0] or 0)
    start, goal = F.col("bucket_start") + F.col("inner_start") + F.col("copy") * F.col("size"), F.round("target").cast("long")
    # of each round of the stream: the words of this document before the target is reached
    begins = [start + r * F.col("source_size") for r in range(max_epochs)]
    taken = [F.greatest(F.lit(0), F.least(F.col("size"), goal - b)) for b in begins]
    when = [F.when(t > 0, training_time(b / F.col("target"), F.col("w_start"), F.col("w_end"))) for b, t in zip(begins, taken)]
    x = x.withColumn("taken", sum(taken[1:], taken[0]).cast("long")).withColumn("times", F.filter(F.array(*when), lambda t: t.isNotNull()))
    x = x.withColumn("starts", F.transform("times", lambda t: t * (F.lit(slope) + t * F.lit(bend)) / F.lit(whole)))
    return rows, x.select("identity", "copies", "copy", "doc_id", "source", "size", "source_size", "target", "taken", F.get("starts", F.lit(0)).alias("first_position"), "starts")


def mix(docs: DataFrame, share: float = 1.5, max_epochs: int = 2, weights=WEIGHTS, schedules=SCHEDULES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, taken, first_position, starts.

    ``starts`` lists the position (0 to 1) of each round's visit that takes words, and ``first_position`` is its
    first, null where nothing is taken. Rows are range-sorted by it, those that the mix leaves out coming last.
    """
    places = _stretches(docs, share, max_epochs, weights, schedules, id_col, text_col, source_col)[1].drop("identity", "copies", "copy")
    order = [F.col("first_position").asc_nulls_last(), F.col("doc_id")]
    return places.repartitionByRange(*order).sortWithinPartitions(*order)


def _numbered(docs: DataFrame, identity: str, copies: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose identity is in ``copies``, with ``copy``, a number from 0 within the identity.

    They are written with the partition that they lie in; a partition's rows are numbered together and after those of the
    partitions before, so that no task gets all copies of a row.
    """
    rows = hot_lookup(docs, copies, identity, "copies").drop("copies")
    rows = stage(rows.withColumn("__part", F.spark_partition_id()), "mix-copies")
    parts = rows.groupBy(identity, "__part").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(identity).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(identity, "__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy(identity, "__part").orderBy(F.lit(0))) - 1
    return rows.withColumn("__own", own).join(parts, [identity, "__part"]).withColumn("copy", F.col("__own") + F.col("__before")).drop("__own", "__part", "__before")


def curriculum(docs: DataFrame, share: float = 1.5, max_epochs: int = 2, weights=WEIGHTS, schedules=SCHEDULES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", partitions: int | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as the mix visits it, range-sorted by training position.

    A document is never cut: the one at which a source's target ends comes whole.
    """
    identities, places = _stretches(docs, share, max_epochs, weights, schedules, id_col, text_col, source_col)
    visits = places.filter(F.size("starts") > 0).select("identity", "copies", "copy", "starts")
    # as one column, so that no name of a caller's meets one of these
    own = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.struct(source_key(F.col(source_col)).alias("key"), order_key(F.col(id_col), F.col(text_col)).alias("order_key")).alias("identity"))
    rows = own.join(visits.filter("copies = 1").drop("copies", "copy"), "identity")
    many = identities.filter("copies > 1").select("identity", "copies")
    if not many.isEmpty():
        copies = _numbered(own, "identity", many)
        rows = rows.unionByName(copies.join(visits.filter("copies > 1").drop("copies"), ["identity", "copy"]).drop("copy"))
    rows = rows.select("row", "identity", F.explode("starts").alias("position"))
    order = [F.col("position"), F.col(f"row.`{id_col}`"), F.col("identity")]
    rows = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    return rows.sortWithinPartitions(*order).select(*[F.col(f"row.`{c}`") for c in docs.columns])
