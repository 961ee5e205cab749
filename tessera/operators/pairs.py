"""Order statistics of the distances between all pairs of a series' values, without the pairs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def within(values: np.ndarray, limit: float) -> int:
    """Ordered pairs, each value with itself among them, that lie no more than ``limit`` apart; ``values`` ascending.

    Differences from one value grow with the other's place, so each value's last near one is found by halving, for
    all values at once; differences are rounded as those of the pairs would be.
    """
    n = len(values)
    low, high = np.arange(n), np.full(n, n)  # the first place beyond the limit lies in (low, high]
    while (high - low > 1).any():
        middle = (low + high) // 2
        near = values[np.minimum(middle, n - 1)] - values <= limit
        low, high = np.where(near, middle, low), np.where(near, high, middle)
    return int(2 * (high - np.arange(n) - 1).sum() + n)


def distance_at(values: np.ndarray, place: int) -> float:
    """The distance at ``place``, counted from 0, of all ordered pairs' distances in ascending order: by halving the numbers' bits."""
    low, high = -1, int(np.float64(values[-1] - values[0]).view(np.int64))
    while high - low > 1:
        middle = (low + high) // 2
        if within(values, float(np.int64(middle).view(np.float64))) > place:
            high = middle
        else:
            low = middle
    return float(np.int64(high).view(np.float64))


def near_pairs(values: np.ndarray, share: float) -> int:
    """Pairs no farther apart than the interpolated ``share`` quantile of all distances."""
    if not len(values):
        return 0
    place = share * (len(values) ** 2 - 1)
    first = int(place)
    a = distance_at(values, first)
    b = a if within(values, a) > first + 1 or first == place else distance_at(values, first + 1)
    part = place - first
    return within(values, math.fma(a, 1 - part, b * part))  # as SQL interpolates, to the last bit: many distances differ in that only


def recurrent(values: Column, share: float) -> Column:
    """``near_pairs`` of an array column in ascending order; nulls are left out."""

    @F.pandas_udf("long")
    def counted(arrays: pd.Series) -> pd.Series:
        return pd.Series([near_pairs(np.asarray(a, dtype=float), share) for a in arrays])

    return counted(F.filter(values, lambda x: x.isNotNull()))
