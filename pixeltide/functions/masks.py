"""Validity of band values as Column expressions.  NULL is the only mark of a missing value: NaN sorts above every
number in Spark, so it becomes NULL on the way in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pixeltide import defaults as D


def clean(x: Column) -> Column:
    """NaN and infinities to NULL."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def range_mask(x: Column, low: float = D.VALID_RANGE[0], high: float = D.VALID_RANGE[1], threshold: float = D.VALID_THRESHOLD) -> Column:
    """Values above ``threshold`` and within [low, high]; all others NULL."""
    return F.when(~F.isnan(x) & (x > threshold) & (x >= low) & (x <= high), x)


def range_mask_zero(x: Column, low: float = D.VALID_RANGE[0], high: float = D.VALID_RANGE[1], threshold: float = D.VALID_THRESHOLD) -> Column:
    """The same with 0 instead of NULL."""
    return F.coalesce(range_mask(x, low, high, threshold), F.lit(0.0))


def _all(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def valid_observation(bands: list[Column], threshold: float = D.VALID_THRESHOLD, high: float = D.VALID_RANGE[1]) -> Column:
    """Every band finite and in (threshold, high]; never NULL."""
    return _all([F.coalesce(~F.isnan(b) & (b > threshold) & (b <= high), F.lit(False)) for b in bands])


def nodata(bands: list[Column]) -> Column:
    """Every band exactly zero."""
    return _all([F.coalesce(b == 0, F.lit(False)) for b in bands])


def any_missing(bands: list[Column]) -> Column:
    """Some band missing: the training loader's rule."""
    return ~_all([b.isNotNull() for b in bands])


def trainable(bands: list[Column], threshold: float = D.VALID_THRESHOLD) -> Column:
    return _all([F.coalesce(b > threshold, F.lit(False)) for b in bands])


def select_bands(raw: Column, indices: list[int]) -> Column:
    """One-based band numbers out of an array column."""
    if not indices or len(set(indices)) != len(indices) or min(indices) < 1:
        raise ValueError("source_band_indices must be one-based and unique")
    return F.array(*[F.element_at(raw, i) for i in indices])


def scaled(x: Column, factor: float = D.SCALE_FACTOR) -> Column:
    return x * factor


def auto_scaled(x: Column, scene_max: Column, factor: float = D.SCALE_FACTOR, above: float = D.AUTO_SCALE_ABOVE) -> Column:
    """Scale only where the whole scene's maximum says the values are counts."""
    return F.when(scene_max > above, x * factor).otherwise(x)


def input_message(rows: Column, n_dims: Column, n_bands: Column, expected: int, acquired: Column) -> Column:
    """NULL if an input is usable, else why not."""
    return (
        F.when(rows == 0, "empty image").when(n_dims != 3, "image must have three dimensions").when(n_bands != expected, F.concat(F.lit("expected "), F.lit(str(expected)), F.lit(" bands"))).when(acquired.isNull(), "missing acquisition date")
    )
