"""Frame-quality expressions over arrays of pixel or gray values."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retrace.functions.text import let

CELL = 8
BLACK_LUMA = 16
BLACK_SHARE = 0.85
DARK_LEVEL = 8


def luma(argb: Column) -> Column:
    """Integer BT.601 luminance of a packed ARGB value."""
    red = F.shiftright(argb, 16).bitwiseAND(F.lit(255))
    green = F.shiftright(argb, 8).bitwiseAND(F.lit(255))
    blue = argb.bitwiseAND(F.lit(255))
    return F.floor((red * 299 + green * 587 + blue * 114) / 1000).cast("int")


def mean_abs_diff(a: Column, b: Column) -> Column:
    """Mean absolute difference of two signatures; 255 when they cannot be compared."""
    total = F.aggregate(
        F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v
    )
    return F.when((F.size(a) != F.size(b)) | (F.size(a) <= 0), F.lit(255.0)).otherwise(total / F.size(a))


def mean_luminance(sig: Column) -> Column:
    """Mean gray level scaled to 0..1."""
    return F.aggregate(sig, F.lit(0.0), lambda s, v: s + v.cast("double")) / F.size(sig) / F.lit(255.0)


def dark_fraction(gray: Column, level: int = DARK_LEVEL) -> Column:
    """Share of grid cells darker than `level` of 255."""
    return F.size(F.filter(gray, lambda v: v < level)) / F.size(gray)


def uninformative(pixels: Column, width: Column, height: Column) -> Column:
    """True when at least 85 % of the 8x8 cells hold no pixel brighter than 16.

    Counting whole black cells instead of black pixels keeps dark-mode text apart from blanked screens.
    Cells at the right and bottom edge may be smaller. Impossible dimensions count as informative.
    """
    tops = F.sequence(F.lit(0), height - 1, F.lit(CELL))
    lefts = F.sequence(F.lit(0), width - 1, F.lit(CELL))

    def lit_cell(px, top, left):
        rows = F.sequence(top, F.least(top + CELL, height) - 1)
        wide = F.least(left + CELL, width) - left
        return F.exists(
            rows,
            lambda y: F.exists(F.slice(px, y * width + left + 1, wide), lambda p: luma(p) > BLACK_LUMA),
        )

    def black_share(px):
        black = F.aggregate(
            tops,
            F.lit(0),
            lambda n, top: n + F.size(F.filter(lefts, lambda left: ~lit_cell(px, top, left))),
        )
        valid = (width > 0) & (height > 0) & (F.size(px) >= width * height)
        return F.when(valid, black / (F.size(tops) * F.size(lefts)) >= BLACK_SHARE).otherwise(F.lit(False))

    return let(pixels, black_share)


# -- pixels as bytes ------------------------------------------------------------------------------
#
# Whole screens have millions of pixels; as bytes they reach numpy without a value per pixel.


def _black_share(raw: bytes | None, width: int, height: int) -> float | None:
    """Share of cells without a lit pixel; None where the dimensions don't fit the bytes."""
    if raw is None or not (width > 0 and height > 0 and len(raw) >= 4 * width * height):
        return None
    argb = np.frombuffer(raw, dtype="<u4", count=width * height).reshape(height, width)
    level = ((argb >> 16 & 255) * 299 + (argb >> 8 & 255) * 587 + (argb & 255) * 114) // 1000
    rows = np.maximum.reduceat(level, np.arange(0, height, CELL), axis=0)
    cells = np.maximum.reduceat(rows, np.arange(0, width, CELL), axis=1)
    return float((cells <= BLACK_LUMA).mean())


@F.pandas_udf(T.BooleanType())
def uninformative_bytes(pixels: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """`uninformative` for pixels as little-endian ARGB bytes, four for each, row by row; null pixels count as informative."""
    shares = [_black_share(*x) for x in zip(pixels, width.fillna(0).astype(int), height.fillna(0).astype(int))]
    return pd.Series([x is not None and x >= BLACK_SHARE for x in shares], dtype=bool)


def _byte_difference(a: bytes | None, b: bytes | None) -> float:
    if not a or not b or len(a) != len(b):
        return 255.0
    x, y = (np.frombuffer(v, dtype=np.uint8).astype(np.int16) for v in (a, b))
    return float(np.abs(x - y).sum(dtype=np.int64) / len(x))


@F.pandas_udf(T.DoubleType())
def mean_abs_diff_bytes(a: pd.Series, b: pd.Series) -> pd.Series:
    """`mean_abs_diff` for signatures of one byte a cell; null ones cannot be compared."""
    return pd.Series([_byte_difference(*x) for x in zip(a, b)], dtype=float)


@F.pandas_udf(T.BinaryType())
def packed(values: pd.Series, size: pd.Series) -> pd.Series:
    """Numbers of an array as bytes, as many for each as the second column says (1 or 4, little-endian).

    Like any Python function it must not be handed an expression in which a lambda uses the variable of one around it: Spark
    looks for that variable among the columns and leaves the call unplanned.
    """
    return pd.Series([None if v is None else np.asarray(v).astype("u1" if n == 1 else "<u4").tobytes() for v, n in zip(values, size)])
