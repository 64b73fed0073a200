"""Expected signatures that are kept and updated: a table of partial states by batch.

A batch of paths leaves one row a process and chunk of coordinates: count, mean and squared deviations. Batches merge in any
order without cancellation, so the expected signature of all paths so far needs no path twice. A batch is known by its name:
one that is run again, after a failure or with corrected paths, replaces what it left before.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidpath.operators import signature

NAME = re.compile(r"[A-Za-z0-9_.-]+")


class ExpectedSignatures:
    """The table at ``path``; one folder a shape of signature and batch."""

    def __init__(self, spark: SparkSession, path: str, channels: int, depth: int) -> None:
        self.spark, self.channels, self.depth = spark, channels, depth
        self.path = f"{path.rstrip('/')}/channels={channels}/depth={depth}"

    def add(self, paths: DataFrame, batch: str, points: bool = False) -> None:
        """Let a batch of paths (process, steps) in, in place of what a batch of this name left."""
        if not NAME.fullmatch(batch):
            raise ValueError(f"a batch is named by letters, digits and _ . -, not {batch!r}")
        found = signature.fewer_partials(signature.partial_signatures(paths, self.channels, self.depth, points))
        found.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def states(self) -> DataFrame:
        """(process, chunk, n, mean, m2, batch)"""
        return self.spark.read.schema(f"{signature.PARTIAL}, batch string").parquet(self.path)

    def read(self, batches: list[str] | None = None) -> DataFrame:
        """(process, coord, level, n_paths, mean, std) of all paths, or of those of some batches."""
        states = self.states()
        states = states if batches is None else states.filter(F.col("batch").isin(batches))
        return signature.merge_partials(states.drop("batch"), self.channels, self.depth)
