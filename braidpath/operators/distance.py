"""Distances between processes: of their moments, and of their expected signatures whole, by level and by depth.

The comparisons are a literal list of pairs, so they are broadcast; what they join is a row a process, or a row a
process and coordinate.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from braidpath.functions.vectors import TINY, array_distance, level_size, signature_length


def comparison_list(spark: SparkSession, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    if not pairs:
        raise ValueError("nothing to compare")
    return spark.createDataFrame([(f"{a}_vs_{b}", a, b) for a, b in pairs], "comparison string, first string, second string")


def statistical_distances(summary: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(comparison and four distances) from ``process_summary``: L2 of means, Frobenius of covariances."""
    cols = ("terminal_mean", "terminal_cov", "increment_mean", "increment_cov")
    side = lambda name: summary.select(F.col("process").alias(name), F.struct(*cols).alias(f"of_{name}"))
    x = F.broadcast(comparison_list(summary.sparkSession, pairs)).join(side("first"), "first").join(side("second"), "second")
    d = lambda c: array_distance(F.col(f"of_first.{c}"), F.col(f"of_second.{c}"))
    return x.select(
        "comparison",
        d("terminal_mean").alias("mean_vector_l2_distance"),
        d("terminal_cov").alias("covariance_frobenius_distance"),
        d("increment_mean").alias("increment_mean_l2_distance"),
        d("increment_cov").alias("increment_covariance_frobenius_distance"),
    )


def moment_distances(means: DataFrame, covariances: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(comparison and two distances) from (process, i, mean) and (process, i, j, covariance): no row holds a vector or a matrix."""
    cmp = F.broadcast(comparison_list(means.sparkSession, pairs))

    def apart(rows: DataFrame, place: Sequence[str], value: str, name: str) -> DataFrame:
        left = rows.join(cmp, rows["process"] == cmp["first"]).select("comparison", "second", *place, F.col(value).alias("a"))
        right = rows.select(F.col("process").alias("second"), *place, F.col(value).alias("b"))
        return left.join(right, ["second", *place]).groupBy("comparison").agg(F.sqrt(F.sum(F.pow(F.col("a") - F.col("b"), F.lit(2)))).alias(name))

    return apart(means, ["i"], "mean", "mean_vector_l2_distance").join(apart(covariances, ["i", "j"], "covariance", "covariance_frobenius_distance"), "comparison")


def _compared(expected: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """A row a comparison and coordinate: the difference of the two means."""
    cmp = F.broadcast(comparison_list(expected.sparkSession, pairs))
    left = expected.join(cmp, expected["process"] == cmp["first"]).select("comparison", "second", "coord", "level", F.col("mean").alias("a"))
    right = expected.select(F.col("process").alias("second"), "coord", F.col("mean").alias("b"))
    return left.join(right, ["second", "coord"]).withColumn("difference", F.col("a") - F.col("b"))


def signature_distances(expected: DataFrame, pairs: Sequence[tuple[str, str]], channels: int, depth: int) -> DataFrame:
    """(comparison, depth, raw, normalised by the root of the number of coordinates)."""
    raw = F.sqrt(F.sum(F.pow("difference", F.lit(2))))
    out = _compared(expected, pairs).groupBy("comparison").agg(raw.alias("raw_signature_l2_distance"))
    scale = signature_length(channels, depth) ** 0.5
    return out.withColumns({"depth": F.lit(depth), "level_normalized_signature_distance": F.col("raw_signature_l2_distance") / scale})


def levelwise_distances(expected: DataFrame, pairs: Sequence[tuple[str, str]], channels: int, depth: int, baseline: str | None = None) -> DataFrame:
    """(comparison, level, coordinates, raw, normalised[, standardised]) of each level's block.

    With ``baseline`` differences are also divided by that process's deviations; coordinates that hardly vary are
    left out, and a level without others is 0.
    """
    rows = _compared(expected, pairs)
    aggs = [F.sqrt(F.sum(F.pow("difference", F.lit(2)))).alias("raw_level_l2_distance")]
    if baseline is not None:
        rows = rows.join(expected.filter(F.col("process") == baseline).select("coord", F.col("std").alias("base_std")), "coord")
        used = F.col("base_std") > TINY
        square = F.when(used, F.pow(F.col("difference") / F.col("base_std"), F.lit(2)))
        aggs.append(F.coalesce(F.sqrt(F.sum(square) / F.nullif(F.count_if(used).cast("double"), F.lit(0.0))), F.lit(0.0)).alias("standardized_level_distance"))
    out = rows.groupBy("comparison", "level").agg(*aggs)
    size = F.element_at(F.array(*[F.lit(level_size(channels, k)) for k in range(1, depth + 1)]), F.col("level"))
    return out.withColumns({"number_of_level_coordinates": size.cast("bigint"), "normalized_level_distance": F.col("raw_level_l2_distance") / F.sqrt(size)})


def cumulative_distances(levelwise: DataFrame) -> DataFrame:
    """(comparison, level, distance of the signatures cut at that level), from the blocks."""
    spec = Window.partitionBy("comparison").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    return levelwise.select("comparison", "level", F.sqrt(F.sum(F.pow("raw_level_l2_distance", F.lit(2))).over(spec)).alias("l2_distance"))


#: What an order of moments tells, by level.
TELLS = {1: "mean", 2: "spread", 3: "asymmetry", 4: "tails"}


def interpretation(comparison: Column, level: Column, orders: Mapping[str, Sequence[int]]) -> Column:
    """What a distance at a level shows, given the orders of moments in which the processes of each comparison differ."""
    out = F.lit("distance of the expected signatures")
    for name, own in orders.items():
        first, last = min(own), max(own)
        told = " and ".join(TELLS[k] for k in own)
        text = F.when(level < first, f"nothing yet: they differ in {told}, from level {first}")
        for k in own:
            text = text.when(level == k, f"the difference in {TELLS[k]} enters here")
        text = text.when(level < last, f"between their differences in {told}").otherwise(f"the difference in {told} is known by level {last}; what is added is scale")
        out = F.when(comparison == name, text).otherwise(out)
    return out
