"""Scalar functions whose meaning must not drift."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: what counts as a number in a label line; casts alone would take 0.5f, 1_0 and the like
INTEGER = r"^\s*[+-]?[0-9]+\s*$"
DECIMAL = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def strict_int(text: Column) -> Column:
    return F.when(text.rlike(INTEGER), F.trim(text).try_cast("bigint"))


def strict_double(text: Column) -> Column:
    return F.when(text.rlike(DECIMAL), F.trim(text).try_cast("double"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def hamming(a: Column, b: Column) -> Column:
    """Different bits of two 64-bit values."""
    return F.bit_count(a.bitwiseXOR(b))


def rmse(a: Column, b: Column) -> Column:
    """Root of the mean squared difference of two arrays of equal length."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v) / F.size(a))


def dhash_bits(row: Column, bits: int) -> Column:
    """Bit k is set where element k + 1 is greater than element k; a signed 64-bit value."""
    value = F.lit(0).cast("bigint")
    for k in range(bits):
        value = value.bitwiseOR(F.when(row[k + 1] > row[k], F.shiftleft(F.lit(1).cast("bigint"), k)).otherwise(F.lit(0).cast("bigint")))
    return value


@F.pandas_udf(T.DoubleType())
def binary_round(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Six decimals, half to even on the exact binary value, for byte parity; native rounding is the default elsewhere."""
    for v in values:
        yield v.map(lambda x: None if x is None or np.isnan(x) else round(float(x), 6))


@F.pandas_udf(T.LongType())
def gray_dhash(gray: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Fingerprint of 8 rows of 9 gray values each, row by row: is a pixel brighter than its left neighbour?"""
    for column in gray:
        rows = np.stack([np.asarray(g, dtype=np.int64).reshape(8, 9) for g in column])
        bits = (rows[:, :, 1:] > rows[:, :, :-1]).reshape(len(rows), 64).astype(np.uint64)
        yield pd.Series((bits << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64))
