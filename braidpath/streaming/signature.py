"""Signatures of growing paths, as a stream: by Chen's identity the state of a series is one signature and its last point."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from braidpath.functions import chen
from braidpath.functions.vectors import level_slices, signature_length


def concatenated(a: np.ndarray, b: np.ndarray, channels: int, depth: int) -> np.ndarray:
    """The signature of path a followed by path b."""
    cut = level_slices(channels, depth)
    left, right = ([np.ones(1), *(s[i:j] for i, j in cut)] for s in (a, b))
    return np.concatenate([sum(np.multiply.outer(left[i], right[k - i]).reshape(-1) for i in range(k + 1)) for k in range(1, depth + 1)])


def running_signatures(stream: DataFrame, channels: list[str], depth: int, key: str = "series", order: str = "ts") -> DataFrame:
    """Of each series and trigger the signature of all points so far: (key, n_points, signature).

    Points of a trigger are put in order among themselves; they are expected to follow those of triggers before. The state of a series is
    bounded by the signature's length, whatever the number of its points.
    """
    d, size = len(channels), signature_length(len(channels), depth)

    def update(group: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        points = rows[channels].to_numpy(np.float64)
        n, sig = 0, np.zeros(size)
        if state.exists:
            n, last, old = state.get
            points, sig = np.vstack([np.array(last), points]), np.array(old)
        new = chen.signatures(np.diff(points, axis=0)[None], depth)[0] if len(points) > 1 else np.zeros(size)
        sig = concatenated(sig, new, d, depth)
        n += len(rows)
        state.update((n, points[-1].tolist(), sig.tolist()))
        yield pd.DataFrame({key: [group[0]], "n_points": [n], "signature": [sig.tolist()]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.select(key, order, *channels).groupBy(key).applyInPandasWithState(
        update, f"{key} {kind}, n_points bigint, signature array<double>", "n bigint, last array<double>, signature array<double>", "update", GroupStateTimeout.NoTimeout
    )
