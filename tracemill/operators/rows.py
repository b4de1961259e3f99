"""Cleaning, smoothing and phase of whole traces, row by row.

The long operators of ``clean`` and ``windows`` take frames at any places. Where a unit's frames are one
array, these give the same values from the row itself: no row is exploded, shuffled or sorted.
Missing values are NULL in the arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as k
from ..functions.batches import matrices
from ..sources.staging import bounded_batches
from .clean import UNIT


def on_rows(arrays: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], keys: list[str] = UNIT, col: str = "trace") -> DataFrame:
    """(keys..., trace): a kernel on matrices of equally long rows, missing values NaN on both sides. NULL rows stay NULL."""
    kinds = dict(arrays.dtypes)
    bounded_batches(arrays.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(keys))
            lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy()), 0)
            offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
            flat = np.empty(offsets[-1])
            for at, x in matrices(column):
                if x.shape[1]:
                    flat[offsets[at][:, None] + np.arange(x.shape[1])] = kernel(x)
            values = pa.array(flat, pa.float64(), from_pandas=True)
            rows = pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array(~column.is_valid().to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], rows], names=[*keys, "trace"])

    schema = ", ".join([*[f"{c} {kinds[c]}" for c in keys], "trace array<double>"])
    return arrays.select(*keys, F.col(col).cast("array<double>").alias("trace")).mapInArrow(run, schema)


def _shifted(x: np.ndarray, by: int) -> np.ndarray:
    """Each row's value ``by`` frames later, NaN beyond its ends."""
    out = np.full(x.shape, np.nan)
    if abs(by) < x.shape[1]:
        out[:, max(-by, 0) : x.shape[1] - max(by, 0)] = x[:, max(by, 0) : x.shape[1] - max(-by, 0)]
    return out


def _weighted(x: np.ndarray, weights: dict[int, float]) -> np.ndarray:
    """Weighted mean over neighbours, renormalised at the ends and over missing values; NaN where nothing is known."""
    total, norm = np.zeros(x.shape), np.zeros(x.shape)
    for by, w in weights.items():
        v = _shifted(x, by)
        known = np.isfinite(v)
        total += np.where(known, v, 0.0) * w
        norm += known * w
    return np.where(norm > 0, total / np.where(norm > 0, norm, 1.0), np.nan)


def fill_missing(arrays: DataFrame, keys: list[str] = UNIT) -> DataFrame:
    """Linear between neighbours, nearest at the ends, 0 for a row without values."""
    return on_rows(arrays, k.finite, keys)


def zscored(arrays: DataFrame, keys: list[str] = UNIT) -> DataFrame:
    """(x - mean) / sd (n - 1); sd 0 or unknown counts as 1, missing results as 0."""
    def kernel(x):
        known = np.isfinite(x)
        n = known.sum(axis=1, keepdims=True)
        gap = x - np.where(known, x, 0.0).sum(axis=1, keepdims=True) / np.maximum(n, 1)
        sd = np.sqrt(np.where(known, gap, 0.0) ** 2 @ np.ones((x.shape[1], 1)) / np.maximum(n - 1, 1))
        return np.where(known, gap / np.where((sd > 0) & (n > 1), sd, 1.0), 0.0)

    return on_rows(arrays, kernel, keys)


def detrended(arrays: DataFrame, keys: list[str] = UNIT) -> DataFrame:
    """Removes each row's least-squares line; missing values count as 0."""
    def kernel(x):
        x = np.where(np.isfinite(x), x, 0.0)
        if x.shape[1] < 2:
            return np.full(x.shape, np.nan)
        t = np.arange(x.shape[1]) - (x.shape[1] - 1) / 2
        return x - x.mean(axis=1, keepdims=True) - (x @ t / (t @ t))[:, None] * t

    return on_rows(arrays, kernel, keys)


def moving_mean(arrays: DataFrame, frames: int, keys: list[str] = UNIT) -> DataFrame:
    """Centred mean with shrinking ends over the known values; an even number of frames reaches one further back."""
    def kernel(x):
        known = np.isfinite(x)
        total, n = (np.pad(np.cumsum(v, axis=1), ((0, 0), (1, 0))) for v in (np.where(known, x, 0.0), known.astype(float)))
        at = np.arange(x.shape[1])
        low, high = np.maximum(at - frames // 2, 0), np.minimum(at + frames - frames // 2, x.shape[1])
        n = n[:, high] - n[:, low]
        return np.where(n > 0, (total[:, high] - total[:, low]) / np.maximum(n, 1), np.nan)

    return on_rows(arrays, kernel, keys)


def _gaussian(frames: int) -> dict[int, float]:
    return {i: float(np.exp(-0.5 * (i / (frames / 5)) ** 2)) for i in range(-(frames // 2), frames - frames // 2)}


def gaussian_smooth(arrays: DataFrame, frames: int, keys: list[str] = UNIT) -> DataFrame:
    """Gaussian-weighted mean (sigma a fifth of the frames), renormalised at the ends and over missing values."""
    return on_rows(arrays, lambda x: _weighted(x, _gaussian(frames)), keys)


def exp_causal_filter(arrays: DataFrame, tau: float, rate: float, keys: list[str] = UNIT) -> DataFrame:
    """Convolution with exp(-t / tau) over the last 2 tau seconds; missing values count as 0."""
    def kernel(x):
        x = np.where(np.isfinite(x), x, 0.0)
        return sum(np.nan_to_num(_shifted(x, -i)) * np.exp(-i / (tau * rate)) for i in range(int(2 * tau * rate) + 1))

    return on_rows(arrays, kernel, keys)


def gradient(arrays: DataFrame, keys: list[str] = UNIT) -> DataFrame:
    """Central differences per frame, one-sided at the ends and beside gaps."""
    def kernel(x):
        before, after = _shifted(x, -1), _shifted(x, 1)
        parts = [(after - before) / 2, after - x, x - before]
        return np.where(np.isfinite(parts[0]), parts[0], np.where(np.isfinite(parts[1]), parts[1], parts[2]))

    return on_rows(arrays, kernel, keys)


def difference(arrays: DataFrame, rectify: bool = False, keys: list[str] = UNIT) -> DataFrame:
    """First difference, 0 at the first frame and beside gaps; optionally only increases."""
    def kernel(x):
        d = np.nan_to_num(x - _shifted(x, -1))
        return np.maximum(d, 0.0) if rectify else d

    return on_rows(arrays, kernel, keys)


def _unwrapped(x: np.ndarray) -> np.ndarray:
    turns = np.round(np.nan_to_num(x - _shifted(x, -1)) / (2 * np.pi))
    return x - 2 * np.pi * np.cumsum(turns, axis=1)


def unwrap_phase(arrays: DataFrame, keys: list[str] = UNIT, col: str = "phase") -> DataFrame:
    """(keys..., trace): phase without jumps of more than pi."""
    return on_rows(arrays, _unwrapped, keys, col)


def instantaneous_freq(arrays: DataFrame, fps: float, keys: list[str] = UNIT, col: str = "phase", smooth: int | None = None) -> DataFrame:
    """(keys..., trace): frequency from the phase's first difference, NULL at the first frame."""
    def kernel(x):
        u = _unwrapped(x)
        freq = (u - _shifted(u, -1)) * fps / (2 * np.pi)
        return _weighted(freq, _gaussian(max(3, smooth))) if smooth else freq

    return on_rows(arrays, kernel, keys, col)
