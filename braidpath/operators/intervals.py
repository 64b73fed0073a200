"""Interval joins: rows of two tables whose date ranges meet, by an equality join on cells of days.

Both sides are cut into cells of some days, so candidates meet by an equality that Spark can hash, sort or split as it does
for any join; an exact filter follows. Two ranges may share several cells; the hit counts in the first one that both have, so
it comes once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days of a cell. A range of n days is copied to about n / CELL_DAYS cells.
CELL_DAYS = 64


def _cell(day: Column, days: int) -> Column:
    return F.floor(F.unix_date(day) / days)


def interval_join(left: DataFrame, right: DataFrame, left_range: tuple[str, str], right_range: tuple[str, str], on: Sequence[str] = (), days: int = CELL_DAYS) -> DataFrame:
    """The columns of both sides (those of ``on`` once) for each pair of rows whose inclusive date ranges meet and whose ``on`` agree.

    A range that is null at one end, or ends before it begins, meets nothing. A point in time is a range that begins and
    ends at it.
    """
    if clash := sorted({c.lower() for c in left.columns} & {c.lower() for c in right.columns} - {c.lower() for c in on}):
        raise ValueError(f"both sides have columns {clash}")

    def cut(rows: DataFrame, ends: tuple[str, str], side: str) -> DataFrame:
        start, end = (F.to_date(F.col(c)) for c in ends)
        rows = rows.withColumns({f"__start_{side}": start, f"__end_{side}": end}).filter(F.col(f"__start_{side}") <= F.col(f"__end_{side}"))
        if ends[0] == ends[1]:
            return rows.withColumn("__cell", _cell(F.col(f"__start_{side}"), days))
        return rows.withColumn("__cell", F.explode(F.sequence(_cell(F.col(f"__start_{side}"), days), _cell(F.col(f"__end_{side}"), days))))

    both = cut(left, left_range, "l").join(cut(right, right_range, "r"), ["__cell", *on])
    first = F.greatest("__start_l", "__start_r")
    meets = (first <= F.least("__end_l", "__end_r")) & (F.col("__cell") == _cell(first, days))
    return both.filter(meets).select(*left.columns, *[c for c in right.columns if c not in set(on)])
