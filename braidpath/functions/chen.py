"""Truncated signatures of batches of piecewise-linear paths, vectorised over paths and time.

By Chen's identity the level k signature is the sum over steps t of C(t) (x) dx(t), where C gathers the levels before
step t with the powers of dx(t) over factorials. All C of one level are known at once from running sums over time of
the level below, so there is no loop over steps. The last level, which holds most of the coordinates, is never
summed step by step: its last two letters are either both in one step or in two, so it is a matrix product of
levels two below it with pairs of increments, and running sums stop two levels short of the depth.
"""

from __future__ import annotations

import numpy as np

from braidpath.functions.vectors import level_slices, signature_length


def _times(c: np.ndarray, dx: np.ndarray) -> np.ndarray:
    """The tensor product at each step, flattened."""
    n, steps, _ = dx.shape
    return (c[..., None] * dx[:, :, None, :]).reshape(n, steps, -1)


def _gathered(before: list[np.ndarray], dx: np.ndarray, level: int, letters: int) -> np.ndarray:
    """S_(letters) + (S_(letters-1) + (... + dx / level) ...) dx / (level - letters + 1), from the inside out."""
    c = np.ones((*dx.shape[:2], 1))
    for j in range(1, letters + 1):
        c = _times(c, dx / (level - j + 1))
        c += before[j - 1]
    return c


def _to_level_three(dx: np.ndarray, out: np.ndarray) -> None:
    """Depth 3 from two matrix products. With h the path at the middle of each step and m what lies behind it, level 3 is

    the sum over steps of h (x) dx (x) m, less that of dx (x) dx (x) dx / 12, which is symmetric and so needs each pair once.
    """
    n, steps, d = dx.shape
    run = np.cumsum(dx, axis=1)
    half = run - dx / 2
    out[:, :d] = run[:, -1]
    out[:, d : d + d * d] = np.matmul(half.transpose(0, 2, 1), dx).reshape(n, -1)
    by_step, middle = (np.ascontiguousarray(x.transpose(0, 2, 1)) for x in (dx, half))
    third = np.matmul((middle[:, :, None, :] * by_step[:, None, :, :]).reshape(n, d * d, steps), run[:, -1:] - half)
    i, j = np.triu_indices(d)
    place = np.zeros((d, d), int)
    place[i, j] = place[j, i] = np.arange(len(i))
    third -= np.matmul(by_step[:, i] * by_step[:, j], dx / 12)[:, place.reshape(-1)]
    out[:, d + d * d :] = third.reshape(n, -1)


def signatures(increments: np.ndarray, depth: int) -> np.ndarray:
    """From increments (paths, steps, channels) the signatures (paths, coordinates)."""
    dx = np.ascontiguousarray(increments, np.float64)
    n, steps, d = dx.shape
    if depth < 1:
        raise ValueError("depth starts at 1")
    out = np.zeros((n, signature_length(d, depth)))
    if not steps:
        return out
    if depth == 3:
        _to_level_three(dx, out)
        return out
    out[:, :d] = dx.sum(axis=1)
    if depth == 1:
        return out
    before: list[np.ndarray] = []  # before[k - 1]: level k ahead of each step, (n, steps, d ** k)
    at = 0
    for level in range(1, depth):
        size = d**level
        c = _gathered(before, dx, level, level - 1)
        if level < depth - 1:
            run = np.zeros((n, steps + 1, size))
            np.cumsum(_times(c, dx), axis=1, out=run[:, 1:])
            out[:, at : at + size] = run[:, -1]
            before.append(run[:, :-1])
        elif level > 1:
            out[:, at : at + size] = np.matmul(c.transpose(0, 2, 1), dx).reshape(n, size)
        at += size
    # the last level: its last letter in a later step than the one before it, or in the same
    later = dx.sum(axis=1, keepdims=True) - np.cumsum(dx, axis=1)
    same = _gathered(before, dx, depth, depth - 2)
    left = np.concatenate([c, same], axis=1)
    right = np.concatenate([_times(dx, later), _times(dx, dx / 2)], axis=1)
    out[:, at:] = np.matmul(left.transpose(0, 2, 1), right).reshape(n, -1)
    return out


def safe_batch(requested: int, steps: int, channels: int, depth: int, budget_bytes: int | None = None) -> int:
    """Paths in a batch so that signatures and what is summed on the way stay within a budget, small enough for caches; at least one."""
    sums = signature_length(channels, depth - 2) if depth > 2 else 0
    one = 8 * (signature_length(channels, depth) + steps * (4 * sums + 2 * channels**2 + 4 * channels))
    # at depth 3 one product's operands should stay in the cache
    return max(1, min(requested, (budget_bytes or (2**23 if depth == 3 else 2**25)) // one))


def _levels(s: np.ndarray, channels: int, depth: int) -> list[np.ndarray]:
    """Levels 0 to depth of signatures (n, coordinates)."""
    return [np.ones((len(s), 1)), *(s[:, a:b] for a, b in level_slices(channels, depth))]


def product(a: np.ndarray, b: np.ndarray, channels: int, depth: int) -> np.ndarray:
    """Chen's identity: the signatures of paths a, each followed by the path of the same row of b."""
    left, right = _levels(a, channels, depth), _levels(b, channels, depth)
    return np.concatenate([sum((left[i][:, :, None] * right[k - i][:, None, :]).reshape(len(a), -1) for i in range(k + 1)) for k in range(1, depth + 1)], axis=1)


def inverse(s: np.ndarray, channels: int, depth: int) -> np.ndarray:
    """The signatures of the reversed paths: every word backwards, odd levels with the other sign."""
    out = []
    for k, level in enumerate(_levels(s, channels, depth)[1:], 1):
        out.append((-1) ** k * level.reshape(len(s), *[channels] * k).transpose(0, *range(k, 0, -1)).reshape(len(s), -1))
    return np.concatenate(out, axis=1)


def prefixes(increments: np.ndarray, depth: int) -> np.ndarray:
    """From increments (paths, steps, channels) the signatures (paths, steps + 1, coordinates) up to each step."""
    dx = np.ascontiguousarray(increments, np.float64)
    n, steps, d = dx.shape
    before: list[np.ndarray] = []
    out = np.zeros((n, steps + 1, signature_length(d, depth)))
    for level, (a, b) in enumerate(level_slices(d, depth), 1):
        np.cumsum(_times(_gathered(before, dx, level, level - 1), dx), axis=1, out=out[:, 1:, a:b])
        before.append(out[:, :-1, a:b])
    return out


#: Windows whose prefixes begin at one place: so many times a window's length. Longer prefixes cancel more digits.
STRETCH = 4


def sliding(increments: np.ndarray, depth: int, window: int, starts: np.ndarray) -> np.ndarray:
    """The signatures of the windows of ``window`` steps that begin at ``starts``, from the increments (steps, channels) of one path.

    A window is the inverse of the prefix before it times the prefix up to its end, so a step enters one running sum and not
    all the windows that hold it. Prefixes begin anew every STRETCH windows, which bounds what cancels.
    """
    steps, d = increments.shape
    size = STRETCH * window
    at = starts // size
    stretches = np.unique(at)
    held = np.zeros((len(stretches), size + window, d))
    for row, k in enumerate(stretches):
        part = increments[k * size : k * size + size + window]
        held[row, : len(part)] = part
    found = prefixes(held, depth)
    row, a = np.searchsorted(stretches, at), starts - at * size
    return product(inverse(found[row, a], d, depth), found[row, a + window], d, depth)
