"""Line simplification by largest deviation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kept_points(x: np.ndarray, y: np.ndarray, first: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points of all shapes stay; shape k has the points first[k] to first[k + 1] - 1.

    All open spans of a level are measured at once, so the rounds follow the depth of the splits."""
    kept = np.zeros(len(x), bool)
    some = np.diff(first) > 0
    low, high = first[:-1][some], first[1:][some] - 1
    kept[low] = kept[high] = True
    while True:
        wide = high - low >= 2
        low, high = low[wide], high[wide]
        if len(low) == 0:
            return kept
        inner = high - low - 1
        begin = np.cumsum(inner) - inner
        span = np.repeat(np.arange(len(low)), inner)
        at = np.arange(len(span)) - begin[span] + low[span] + 1
        lx, ly = x[high] - x[low], y[high] - y[low]
        square = lx * lx + ly * ly
        px, py = x[at] - x[low][span], y[at] - y[low][span]
        along = np.clip((px * lx[span] + py * ly[span]) / np.where(square < 1e-10, 1.0, square)[span], 0.0, 1.0)
        t = np.where(square[span] < 1e-10, 0.0, along)
        away = np.hypot(px - t * lx[span], py - t * ly[span])
        most = np.maximum.reduceat(away, begin)
        hit = np.flatnonzero((away == most[span]) & (most[span] > tolerance))
        which, place = np.unique(span[hit], return_index=True)  # the first of equals
        middle = at[hit[place]]
        kept[middle] = True
        low, high = np.concatenate([low[which], middle]), np.concatenate([middle, high[which]])


def _kept_numbers(tolerance: float):
    """Arrow-batched function from the coordinates of shapes to the numbers of the points kept."""

    @F.pandas_udf("array<int>")
    def numbers(xs: pd.Series, ys: pd.Series) -> pd.Series:
        first = np.zeros(len(xs) + 1, np.int64)
        np.cumsum([len(v) for v in xs], out=first[1:])
        flat = [np.concatenate(list(v)) if len(v) else np.empty(0) for v in (xs, ys)]
        at = np.flatnonzero(kept_points(*flat, first, tolerance))
        shape = np.searchsorted(first, at, "right") - 1
        return pd.Series(np.split(at - first[shape], np.searchsorted(at, first[1:-1])))

    return numbers


def simplify(features: DataFrame, shape: str, tolerance: float) -> DataFrame:
    """Replace ``shape`` by its simplified form: points no farther than ``tolerance`` are dropped.

    The split rule is recursive and has no built-in form, so numpy decides for a whole Arrow batch which points
    stay; the coordinates go as plain number lists.  Shapes of fewer than three points keep all of them
    and are sent as empty lists.  It needs no shuffle: a shape lives in its row."""
    long = F.size(shape) >= 3
    none = F.array().cast("array<double>")
    x, y = (F.when(long, F.col(shape)[k]).otherwise(none) for k in "xy")
    numbered = features.withColumn("__kept", _kept_numbers(tolerance)(x, y))
    picked = F.when(long, F.transform("__kept", lambda k: F.get(shape, k))).otherwise(F.col(shape))
    return numbered.withColumn(shape, picked).drop("__kept")
