"""Frames that slide over series, a batch of sorted bars at a time.

A window of the last n rows adds them up anew for each row.  Here the frames of all bars of a batch
are added up together, a step of numpy for each of the n places of a frame, in the order
and by the recurrences that the SQL functions have, so sums, means and slopes are the same to the last digit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Frame = tuple[np.ndarray, np.ndarray]


def _behind(x: np.ndarray, back: int) -> np.ndarray:
    """x as it was so many rows before."""
    return x if back == 0 else np.concatenate([np.zeros(min(back, len(x)), x.dtype), x[:-back]])


def count(valid: np.ndarray, n: int) -> np.ndarray:
    c = np.cumsum(valid, dtype=np.int64)
    return c - _behind(c, n)


def total(x: Frame, n: int) -> Frame:
    """The sum of the last n rows, and how many of them are there."""
    filled, out = np.where(x[1], x[0], 0.0), np.zeros(len(x[0]))
    for back in range(n - 1, -1, -1):
        out[back:] += filled[: len(filled) - back]
    return out, count(x[1], n)


def mean(x: Frame, n: int) -> Frame:
    s, k = total(x, n)
    return s / k, k


def extreme(x: Frame, n: int, greatest: bool) -> Frame:
    """The greatest or least of the last n rows; NaN counts as greater than all numbers, as in SQL."""
    of, none = (np.maximum, -np.inf) if greatest else (np.fmin, np.nan)
    filled = np.where(x[1], x[0], none)
    out = filled.copy()
    for back in range(1, n):
        of(out[back:], filled[: len(filled) - back], out=out[back:])
    return out, count(x[1], n)


def trend(y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the last n rows over their number: slope, r2 and the sum of squares around the mean."""
    m = len(y)
    mean_, cross, own, squares = (np.zeros(m) for _ in range(4))
    for k in range(n):
        back = n - 1 - k
        v = y[: m - back] if back < m else y[:0]
        at = slice(back, None)
        off = v - mean_[at]
        mean_[at] += off / (k + 1)
        rest = v - mean_[at]
        cross[at] += (k + 1) / 2 * rest  # numbers of rows follow each other, so their distance from their mean is known
        own[at] += off * (k / 2)
        squares[at] += off * rest
    whole = n * (n * n - 1) / 12
    likeness = own / np.sqrt(squares * whole)
    return cross / whole, likeness * likeness, squares


_READ = ("i", "close", "ln", "step", "tr", "obv", "volume", "up", "down", "high", "low")
_MADE = ("past", "ma", "ma_back", "ma_far", "slope", "r2", "spread", "slope_late", "slope_early", "path", "up_sum", "down_sum", "atr_new", "atr_old", "top", "bottom", "usual", "obv_slope")
_KEPT = ("code", "bar_date", "close", "volume")


def held(n: int, ma: int, lookback: int) -> int:
    """So many bars the frames of a bar look back on, itself among them."""
    return max(n, ma + max(ma, lookback))


def stage_frames(bars: DataFrame, frames: dict[str, tuple[int, int, int]], last: bool = False) -> DataFrame:
    """bars: code, bar_date and what _READ names, in order of code and i, the bar's number.  The frames of each bar, for each window, average and look-back that frames names (column frame).

    enough: all n logarithms are there.  Frames but the average are missing without it.  A task holds a batch and the rows that its frames look back on.
    last: of bars with ahead, how many follow of the same code, only those that none follows are given.
    """
    most = max(held(*f) for f in frames.values())

    def made_of(x: dict[str, Frame], n: int, ma: int, lookback: int) -> dict[str, Frame]:
        i, half = x["i"][0], n // 2
        average, there = mean(x["close"], ma)
        full = (there == ma) & (i >= ma)
        enough = (count(x["ln"][1], n) == n) & (i >= n)
        slope, r2, spread = trend(x["ln"][0], n)
        part = trend(x["ln"][0], half + 1)[0]
        made: dict[str, Frame] = {"ma": (average, full), "enough": (enough, np.ones(len(i), bool)), "past": (_behind(x["close"][0], n - 1), _behind(x["close"][1], n - 1) & (i >= n))}
        for name, back in (("ma_back", lookback), ("ma_far", ma)):
            made[name] = _behind(average, back), _behind(full, back) & (i > back)
        always = np.ones(len(i), np.int64)
        given = {
            "slope": (slope, always, 0), "r2": (r2, always, 0), "spread": (spread, always, 0), "slope_late": (part, always, 0), "slope_early": (part, always, n - 1 - half),
            "path": (*total(x["step"], n - 1), 0), "up_sum": (*total(x["up"], n - 1), 1), "down_sum": (*total(x["down"], n - 1), 1),
            "atr_new": (*mean(x["tr"], half), 0), "atr_old": (*mean(x["tr"], n - half), half), "usual": (*mean(x["volume"], n - 1), 1),
            "top": (*extreme(x["high"], n - 1, True), 1), "bottom": (*extreme(x["low"], n - 1, False), 1), "obv_slope": (trend(x["obv"][0], n - 1)[0], always, 1),
        }
        for name, (value, known, back) in given.items():
            made[name] = _behind(value, back), enough & (_behind(known, back) > 0)
        return made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = {c: (np.zeros(most), np.zeros(most, bool)) for c in _READ}
        for batch in batches:
            x = {}
            for c in _READ:
                column = batch.column(c)
                value, there = column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64), column.is_valid().to_numpy(zero_copy_only=False)
                x[c] = np.concatenate([before[c][0], value]), np.concatenate([before[c][1], there])
            before = {c: (v[-most:], t[-most:]) for c, (v, t) in x.items()}
            for frame, (n, ma, lookback) in frames.items():
                with np.errstate(all="ignore"):  # rows whose frames aren't full are masked
                    made = made_of(x, n, ma, lookback)
                arrays = [pa.array([frame] * batch.num_rows, pa.string())] + [batch.column(c) for c in _KEPT] + [pa.array(made[c][0][most:], mask=~made[c][1][most:]) for c in (*_MADE, "enough")]
                out = pa.RecordBatch.from_arrays(arrays, names=["frame", *_KEPT, *_MADE, "enough"])
                yield out.filter(pa.array(batch.column("ahead").to_numpy() == 0)) if last else out

    double = [F.col(c).cast("double").alias(c) for c in dict.fromkeys((*_READ, *_KEPT)) if c not in ("code", "bar_date")]
    read = bars.select("code", "bar_date", *double, *(["ahead"] if last else []))
    code, day = (read.schema[c].dataType.simpleString() for c in ("code", "bar_date"))
    kinds = ["frame string", f"code {code}", f"bar_date {day}", *[f"{c} double" for c in (*_KEPT[2:], *_MADE)], "enough boolean"]
    return read.mapInArrow(run, ", ".join(kinds))
