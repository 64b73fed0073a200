"""Column helpers: distances, guards, and the layout of truncated signatures.

A signature of depth N over d channels is a flat array without the scalar term: level 1 first, level k holding d**k
coordinates, words in row-major order (the first letter outermost).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Below this a standard deviation or a total counts as nothing.
TINY = 1e-12


def level_size(channels: int, level: int) -> int:
    if channels < 1 or level < 1:
        raise ValueError("channels and level start at 1")
    return channels**level


def signature_length(channels: int, depth: int, scalar: bool = False) -> int:
    return int(scalar) + sum(level_size(channels, k) for k in range(1, depth + 1))


def level_slices(channels: int, depth: int) -> list[tuple[int, int]]:
    """Of each level the first position and the one after its last."""
    ends = list(itertools.accumulate(level_size(channels, k) for k in range(1, depth + 1)))
    return list(zip([0, *ends], ends))


def words(channels: int, depth: int) -> list[tuple[int, ...]]:
    """The words of all levels in layout order, letters from 0."""
    return [w for k in range(1, depth + 1) for w in itertools.product(range(channels), repeat=k)]


def level_of(coord: Column, channels: int, depth: int) -> Column:
    """The level of a 0-based coordinate, as an expression."""
    out = F.lit(depth)
    for level, (_, end) in reversed(list(enumerate(level_slices(channels, depth), 1))):
        out = F.when(coord < end, level).otherwise(out)
    return out.cast("int")


def truncate(signature: Column, channels: int, depth: int) -> Column:
    """The signature of a lesser depth is a prefix."""
    return F.slice(signature, 1, signature_length(channels, depth))


def safe(value: Column) -> Column:
    """A denominator: the value, or 1 where it is next to nothing."""
    return F.when(value > TINY, value).otherwise(1.0)


def total(columns: Iterable[Column]) -> Column:
    """A sum over columns, associated left to right."""
    out = None
    for c in columns:
        out = c if out is None else out + c
    return F.lit(0.0) if out is None else out


def norm(columns: Sequence[Column]) -> Column:
    return F.sqrt(total([c * c for c in columns]))


def array_distance(a: Column, b: Column) -> Column:
    """L2 distance of two arrays of equal length."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def format_bytes(n: Column) -> Column:
    """A count of bytes in the largest binary unit that leaves at least 1."""
    out = F.format_string("%d B", n.cast("long"))
    for power, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        out = F.when(n >= 1024**power, F.format_string(f"%.2f {unit}", n / float(1024**power))).otherwise(out)
    return out
