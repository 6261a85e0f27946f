"""Measures of gray rasters held as bytes: detail and exposure, computed over Arrow batches.

A raster is a binary column with width, height and stride; rows start ``stride`` bytes apart, and what lies between width
and stride is not looked at. Rasters of one shape in a batch are views of the batch's own buffer, a few megabytes of
them are worked on at a time, and all sums are whole numbers, so no result depends on any order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from fernsieve.functions.scalar import BLACK, WHITE
from fernsieve.plans.staging import let_workers_import

#: Bytes of rasters of one shape that are worked on together; larger ones go one by one.
STACK_BYTES = 1 << 18


def shapes_of(pixels: pa.Array, width: pa.Array, height: pa.Array, stride: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, stack) for each shape in a batch: rasters as one array of (raster, height, width), without their padding.

    Left out are null rasters, sizes that are null or negative, strides under the width, and rasters with too few bytes.
    """
    n = len(pixels)
    w, h, s = (np.asarray(a.cast(pa.int64()).fill_null(-1)) for a in (width, height, stride))
    wide = pa.types.is_large_binary(pixels.type)
    offsets = np.frombuffer(pixels.buffers()[1], np.int64 if wide else np.int32, n + 1, pixels.offset * (8 if wide else 4)).astype(np.int64)
    data = np.frombuffer(pixels.buffers()[2] or b"", np.uint8)
    there = np.asarray(pixels.is_valid()) & (w >= 0) & (h >= 0) & (s >= w)
    there &= np.where((w > 0) & (h > 0), (h - 1) * s + w, 0) <= np.diff(offsets)
    shapes: dict[tuple[int, int, int], list[int]] = {}
    for k in np.flatnonzero(there).tolist():
        shapes.setdefault((int(w[k]), int(h[k]), int(s[k])), []).append(k)
    for (across, down, step), rows in shapes.items():
        many = max(1, STACK_BYTES // max(1, step * down))
        for at in range(0, len(rows), many):
            some = rows[at : at + many]
            if not across or not down:
                yield np.array(some), np.zeros((len(some), 0, 0), np.uint8)
                continue
            views = [np.lib.stride_tricks.as_strided(data[offsets[k] :], (down, across), (step, 1), writeable=False) for k in some]
            yield np.array(some), np.stack(views) if len(views) > 1 else views[0][None]


def variances(stack: np.ndarray) -> np.ndarray:
    """Variance of the four-neighbour Laplacian over the interior of each raster; 0 for a side of fewer than three pixels."""
    _, h, w = stack.shape
    if h < 3 or w < 3:
        return np.zeros(len(stack))
    small = stack.astype(np.int16)
    value = small[:, 1:-1, 1:-1] << 2
    for part in (small[:, 1:-1, :-2], small[:, 1:-1, 2:], small[:, :-2, 1:-1], small[:, 2:, 1:-1]):
        value -= part
    flat = value.reshape(len(stack), -1)
    n = flat.shape[1]
    total = flat.sum(axis=1, dtype=np.int64)
    wide = flat.astype(np.float64)  # a value is 1,020 at most, so sums of 8 * 10 ** 9 squares are exact
    squares = np.einsum("ij,ij->i", wide, wide)
    mean = total / n
    return squares / n - mean * mean


def exposures(stack: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean luma from 0 to 1 and the shares of black and of white pixels of each raster, from its histogram; zeros without pixels."""
    n = stack.shape[1] * stack.shape[2]
    if not n:
        return (np.zeros(len(stack)),) * 3
    flat = stack.reshape(len(stack), -1)
    tally = np.stack([np.bincount(row, minlength=256) for row in flat])
    return tally @ np.arange(256) / n / 255.0, tally[:, : BLACK + 1].sum(axis=1) / n, tally[:, WHITE:].sum(axis=1) / n


def kernel(names: Sequence[str], measure: Callable[[np.ndarray], Sequence[np.ndarray]]) -> Callable[..., Column]:
    """An Arrow UDF of (pixels, width, height, stride): a double, or a struct if there are several ``names``."""

    def work(pixels: pa.Array, width: pa.Array, height: pa.Array, stride: pa.Array) -> pa.Array:
        out, known = np.zeros((len(names), len(pixels))), np.zeros(len(pixels), bool)
        for rows, stack in shapes_of(pixels, width, height, stride):
            out[:, rows], known[rows] = measure(stack), True
        columns = [pa.array(c, pa.float64(), mask=~known) for c in out]
        return pa.StructArray.from_arrays(columns, names=list(names), mask=pa.array(~known)) if len(names) > 1 else columns[0]

    kind = StructType([StructField(n, DoubleType()) for n in names]) if len(names) > 1 else DoubleType()
    udf = F.arrow_udf(work, kind)

    def column(pixels: Column, width: Column, height: Column, stride: Column) -> Column:
        let_workers_import(SparkSession.getActiveSession())
        return udf(pixels, width, height, stride)

    column.work = work
    return column


EXPOSURE = ("luma", "shadow", "highlight")
_laplacian = kernel(["laplacian"], lambda stack: [variances(stack)])
_exposure = kernel(EXPOSURE, exposures)
_both = kernel(("laplacian", *EXPOSURE), lambda stack: [variances(stack), *exposures(stack)])


def laplacian_variance(pixels: Column, width: Column, height: Column, stride: Column) -> Column:
    """Variance of the four-neighbour Laplacian over the interior of a raster, the measure of its detail.

    0 for a side of fewer than three pixels; null for a raster that is null, has a null size or fewer bytes than its sizes ask for.
    """
    return _laplacian(pixels, width, height, stride)


def exposure_stats(pixels: Column, width: Column, height: Column, stride: Column) -> Column:
    """Struct of mean luma (0 to 1) and the shares of pixels that are black (``shadow``) or white (``highlight``).

    Zeros for a raster without pixels; null as for ``laplacian_variance``.
    """
    return _exposure(pixels, width, height, stride)


def raster_measures(pixels: Column, width: Column, height: Column, stride: Column) -> Column:
    """Both in one pass over the bytes: struct of laplacian, luma, shadow and highlight; null as for ``laplacian_variance``."""
    return _both(pixels, width, height, stride)


def packed(values: Column) -> Column:
    """Bytes of an array of whole numbers from 0 to 255."""
    return F.unhex(F.array_join(F.transform(values, lambda x: F.lpad(F.hex(x), 2, "0")), ""))
