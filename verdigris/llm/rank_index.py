"""Piecewise-linear learned index from rank to value over many sorted lists at once.

A list's values are approximated by straight segments between two of them; a segment whose
largest error is over the bound is halved until it is not (two neighbors are always exact). A
value is the segment's prediction for its rank plus a stored residual of one byte, so lookups
are exact and the index takes little more than a byte a value.
"""

from __future__ import annotations

import numpy as np

ERROR = 127


class RankIndex:
    """``values[first[k]:first[k + 1]]`` is list k, rising and not empty."""

    def __init__(self, values: np.ndarray, first: np.ndarray):
        values, first = np.asarray(values, np.int64), np.asarray(first, np.int64)
        self.first = first
        self.residual = np.zeros(len(values), np.int8)
        low, high = first[:-1], first[1:] - 1
        done = []
        while len(low):
            n = high - low + 1
            begin = np.cumsum(n) - n
            owner = np.repeat(np.arange(len(low)), n)
            at = low[owner] + np.arange(int(n.sum())) - begin[owner]
            rise, run = values[high] - values[low], np.maximum(high - low, 1)
            error = values[at] - (values[low][owner] + (at - low[owner]) * rise[owner] // run[owner])
            fits = np.maximum.reduceat(np.abs(error), begin) <= ERROR
            done.append((low[fits], values[low[fits]], rise[fits], run[fits]))
            inside = fits[owner]
            self.residual[at[inside]] = error[inside]  # a border has error 0 on both sides
            low, high, middle = low[~fits], high[~fits], (low[~fits] + high[~fits]) // 2
            low, high = np.concatenate([low, middle]), np.concatenate([middle, high])
        parts = [np.concatenate(p) for p in zip(*done)] if done else [np.zeros(0, np.int64)] * 4
        by = np.argsort(parts[0], kind="stable")
        self.start, self.value, self.rise, self.run = (p[by] for p in parts)

    def __call__(self, lists: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The value of the given rank in each of the given lists."""
        at = self.first[lists] + rank
        s = np.searchsorted(self.start, at, "right") - 1
        return self.value[s] + (at - self.start[s]) * self.rise[s] // self.run[s] + self.residual[at]
