"""Experiments on simulated processes: their configuration, moments, and distances of moments and signatures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidpath.operators import distance, simulate
from braidpath.operators.simulate import Process


#: Heston's leverage shows as asymmetry; jumps as variance; memory and roughness from the second order on.
ADVANCED_ORDERS = {"BS_vs_HEST": (3,), "BS_vs_MERT": (2, 3), "BS_vs_BATES": (2, 3), "BS_vs_FBM": (1, 2), "MERT_vs_BATES": (3,), "BS_vs_RVOL": (1, 3), "FBM_vs_RVOL": (1, 2)}


@dataclass(frozen=True)
class Experiment:
    """The tables of one run, each lazy."""

    configuration: DataFrame
    moments: DataFrame
    summary: DataFrame
    expected: DataFrame
    statistical: DataFrame
    signature: DataFrame
    levelwise: DataFrame
    cumulative: DataFrame


def compare(spark: SparkSession, processes: Sequence[Process], pairs: Sequence[tuple[str, str]], depth: int, n_paths: int, steps: int, dt: float = 1.0, seed: int = 42, time_augmented: bool = False, batch: int = simulate.BLOCK, baseline: str | None = None, name: str = "run", orders: Mapping[str, Sequence[int]] | None = None) -> Experiment:
    """Simulate, summarise and compare. Signatures and moments come from the same paths, as streams depend on blocks alone.

    ``orders`` says in which orders of moments the processes of a comparison differ, for the interpretation of levels.
    """
    d = processes[0].channels
    channels = d + time_augmented
    channel_moments = simulate.simulated_moments(spark, processes, n_paths, steps, dt, seed, batch)
    summary = simulate.simulated_summary(spark, processes, n_paths, steps, dt, seed, batch)
    expected = simulate.simulated_signatures(spark, processes, depth, n_paths, steps, dt, seed, time_augmented, batch)
    known = {p.name for p in processes}
    pairs = [(a, b) for a, b in pairs if a in known and b in known]
    levels = distance.levelwise_distances(expected, pairs, channels, depth, baseline or processes[0].name)
    table = [(name, p.name, p.kind, d, depth, time_augmented, steps, n_paths, batch, p.notes or ", ".join(f"{k}={v}" for k, v in p.params.items())) for p in processes]
    configuration = spark.createDataFrame(table, "config_name string, process string, kind string, dimension int, signature_depth int, time_augmented boolean, time_steps int, num_paths int, batch_size int, notes string")
    named = lambda df: df.select(F.lit(name).alias("config_name"), *df.columns)
    told = lambda df, level="level": df.withColumn("interpretation", distance.interpretation(F.col("comparison"), F.col(level), orders or {}))
    return Experiment(
        configuration,
        named(channel_moments),
        named(summary),
        named(expected),
        named(distance.statistical_distances(summary, pairs)),
        named(told(distance.signature_distances(expected, pairs, channels, depth), "depth")),
        named(told(levels)),
        named(told(distance.cumulative_distances(levels))),
    )


def one_dimensional(spark: SparkSession, n_paths: int = 1_000, steps: int = 20, depth: int = 5, seed: int = 42) -> Experiment:
    return compare(spark, simulate.one_dimensional(), [("A", "B"), ("A", "C"), ("B", "C")], depth, n_paths, steps, seed=seed, name="one_dimensional", orders={"A_vs_B": (1,), "A_vs_C": (2,), "B_vs_C": (1, 2)})


def higher_moments(spark: SparkSession, n_paths: int = 4_000, steps: int = 20, depth: int = 5, seed: int = 42) -> Experiment:
    return compare(spark, simulate.higher_moments(), [("G", "S"), ("G", "T"), ("S", "T")], depth, n_paths, steps, seed=seed, name="higher_moments", orders={"G_vs_S": (3, 4), "G_vs_T": (4,), "S_vs_T": (3, 4)})


def high_dimensional(spark: SparkSession, preset: str = "d20_depth3", n_paths: int = 10_000, steps: int = 300, seed: int = 42, time_augmented: bool = False) -> Experiment:
    if preset not in simulate.PRESETS:
        raise ValueError(f"a preset is one of {sorted(simulate.PRESETS)}")
    channels, depth, batch = simulate.PRESETS[preset]
    return compare(spark, simulate.high_dimensional(channels), simulate.HIGH_DIMENSIONAL_PAIRS, depth, n_paths, steps, seed=seed, batch=batch, time_augmented=time_augmented, name=preset, orders={"A_vs_B": (1,), "A_vs_C": (2,), "B_vs_C": (1, 2), "A_vs_D": (2,)})


def advanced(spark: SparkSession, n_paths: int = 5_000, steps: int = 100, horizon: float = 1.0, sigma: float = 0.2, depth: int = 5, seed: int = 42, rough: bool = True, time_augmented: bool = True) -> Experiment:
    return compare(spark, simulate.advanced(sigma, rough), simulate.ADVANCED_PAIRS, depth, n_paths, steps, horizon / steps, seed, time_augmented, 500, "BS", "advanced", ADVANCED_ORDERS)


def stacked(experiments: Sequence[Experiment], table: str) -> DataFrame:
    """One table of several experiments, one under the other."""
    out = getattr(experiments[0], table)
    for e in experiments[1:]:
        out = out.unionByName(getattr(e, table))
    return out
