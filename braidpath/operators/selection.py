"""Exact quantiles of groups of any size: distributed selection by ranges of value.

Values are counted, range-sorted by group and value, and written with the range that they lie in. Of each range only its
count is summed; the ranges before give a value's rank, so the two order statistics that a quantile lies between are
looked for in the one or two ranges that hold them. No task gets a group: ranges are balanced by the sort, and equal
values, however many, are one row with a count.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from braidpath.sources.staging import stage


def quantiles(rows: DataFrame, value: str, wanted: Sequence[float], by: Sequence[str] = ("series",), names: Sequence[str] | None = None) -> DataFrame:
    """(by, one column a quantile): interpolated between the two order statistics around it, over rows with a value.

    Groups without a value have no row; null is a group of its own. NaN counts as the greatest value.
    """
    if bad := [q for q in wanted if not 0 <= q <= 1]:
        raise ValueError(f"quantiles lie between 0 and 1, not {bad}")
    names, keys = list(names or [f"q_{k}" for k in range(1, len(wanted) + 1)]), [f"__k{k}" for k in range(len(by))]
    own = rows.filter(F.col(value).isNotNull()).select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(value).cast("double").alias("__v"))
    counted = own.groupBy(*keys, "__v").agg(F.count("*").alias("__n"))
    order = [*keys, "__v"]
    # written, as a second run might cut the ranges elsewhere
    dealt = stage(counted.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__range", F.spark_partition_id()), "quantiles")
    up_to = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy(*keys, "__range").agg(F.sum("__n").alias("__in"))
    ranges = ranges.withColumns({"__before": F.coalesce(F.sum("__in").over(up_to), F.lit(0)), "__all": F.sum("__in").over(Window.partitionBy(*keys))})
    at = [F.lit(float(q)) * (F.col("__all") - 1) for q in wanted]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(h), F.ceil(h)) for h in at])))
    # the ranks that a range holds, 0-based; ranges that hold none go
    ranges = ranges.withColumn("__ranks", F.filter(ranks, lambda r: (r >= F.col("__before")) & (r < F.col("__before") + F.col("__in")))).filter(F.size("__ranks") > 0)
    same = [F.col(f"v.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*keys, "__range"]]
    found = dealt.alias("v").join(ranges.alias("r"), functools.reduce(operator.and_, same)).select("v.*", "r.__before", "r.__ranks", "r.__all")
    inside = Window.partitionBy(*keys, "__range").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("__from", F.col("__before") + F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    held = found.withColumn("__rank", F.explode(F.filter("__ranks", lambda r: (r >= F.col("__from")) & (r < F.col("__from") + F.col("__n")))))
    # at most two rows a quantile and group are left
    picked = held.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("__rank", "__v"))).alias("__of"), F.first("__all").alias("__all"))

    def interpolated(q: float):
        h = F.lit(float(q)) * (F.col("__all") - 1)
        low, high = F.col("__of")[F.floor(h)], F.col("__of")[F.ceil(h)]
        return F.when(low == high, low).otherwise(low + (h - F.floor(h)) * (high - low))

    return picked.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], *[interpolated(q).alias(n) for q, n in zip(wanted, names)])

