"""Scores, model curves and codecs as Column expressions over named band columns."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pixeltide import defaults as D


def total(terms) -> Column:
    return reduce(lambda a, b: a + b, terms)


def d2(observed: list[Column], mean: list[Column], std: list[Column], offset: float = D.STD_OFFSET) -> Column:
    """Sum over bands of ((obs - mean) / (std + offset))^2."""
    return total([F.pow((o - m) / (s + offset), 2) for o, m, s in zip(observed, mean, std, strict=True)])


def sam(a: list[Column], b: list[Column]) -> Column:
    """Spectral angle; the cosine is clipped, since acos beyond 1 is NaN."""
    dot = total([x * y for x, y in zip(a, b, strict=True)])
    norms = F.sqrt(total([x * x for x in a])) * F.sqrt(total([y * y for y in b]))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / (norms + 1e-9))))


def ratio(x: Column, threshold: Column, epsilon: float = D.RATIO_EPSILON) -> Column:
    return F.greatest(x / (threshold + epsilon), F.lit(0.0))


def joint_null_score(d2_: Column, cfar: Column, sam_: Column, d2_ref: Column, cfar_ref: Column, sam_ref: Column, epsilon: float = D.RATIO_EPSILON) -> Column:
    return F.least(d2_ / (d2_ref + epsilon), F.greatest(cfar / (cfar_ref + epsilon), sam_ / (sam_ref + epsilon)))


def log_variance_to_std(lv: Column, low: float = D.LOG_VARIANCE_RANGE[0], high: float = D.LOG_VARIANCE_RANGE[1]) -> Column:
    return F.exp(0.5 * F.least(F.greatest(lv, F.lit(low)), F.lit(high)))


def log_variance_at(lv: Column, slope: Column, t: Column, decay: Column) -> Column:
    """Variance law: drifts inside the training range, inflates with the horizon beyond it."""
    inside = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)) - 1
    return lv + 2 * F.tanh(slope) * inside + 2 * F.log1p((4.9 * sigmoid(decay) + 0.1) * F.greatest(t - 1, F.lit(0.0)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def harmonic_curve(t: Column, years: float, dynamic: Column, trend: Column, cos: list[Column], sin: list[Column], cos_drift: list[Column], sin_drift: list[Column]) -> Column:
    """d + 0.5 + trend + drifting harmonics; the drift freezes at t = 1 while the harmonics go on."""
    frozen, omega = F.least(t, F.lit(1.0)), 2 * math.pi * years
    out = dynamic + 0.5 + 0.2 * F.tanh(trend) * frozen
    for k, (c, s, dc, ds) in enumerate(zip(cos, sin, cos_drift, sin_drift, strict=True), 1):
        out = out + (c + 0.02 * F.tanh(dc) * frozen) * F.cos(omega * k * t) + (s + 0.02 * F.tanh(ds) * frozen) * F.sin(omega * k * t)
    return out


def step_state(t: Column, steps: list[tuple[Column, Column]], width: float) -> Column:
    """Sum of smooth steps (centre, amplitude), zero at t = 0."""
    return total([(sigmoid((t - c) / width) - sigmoid(-c / width)) * a for c, a in steps])


def seasonal_terms(day: Column, period: float = D.PERIOD_DAYS, harmonics: int = D.HARMONICS) -> list[Column]:
    """1, cos and sin of each harmonic at a day count."""
    out = [F.lit(1.0)]
    for k in range(1, harmonics + 1):
        angle = day * (2 * math.pi * k / period)
        out += [F.cos(angle), F.sin(angle)]
    return out


def linear_correction(day: Column, coefficients: list[Column], period: float = D.PERIOD_DAYS) -> Column:
    return total([a * b for a, b in zip(seasonal_terms(day, period, (len(coefficients) - 1) // 2), coefficients, strict=True)])


def normalized_time(ts: Column, start: Column, end: Column) -> Column:
    """Seconds since start over the range, at least 0, not cut at 1."""
    span = (F.unix_micros(end) - F.unix_micros(start)) / 1e6
    return F.greatest((F.unix_micros(ts) - F.unix_micros(start)) / 1e6 / span, F.lit(0.0))


def log_in(x: Column) -> Column:
    return F.log1p(x)


def log_out(x: Column) -> Column:
    return F.expm1(x)


def denormalized(mean: Column, std: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """Mean moves and scales, std only scales."""
    return mean * (high - low) + low, std * (high - low)


def nll(mean: Column, y: Column, lv: Column, weight: Column | None = None) -> Column:
    """Heteroscedastic negative log-likelihood of one observation."""
    v = F.least(F.greatest(lv, F.lit(D.LOG_VARIANCE_RANGE[0])), F.lit(D.LOG_VARIANCE_RANGE[1]))
    one = 0.5 * F.exp(-v) * F.pow(mean - y, 2) + 0.5 * v
    return one if weight is None else one * weight


def recency_weight(years_before: Column, decay: float) -> Column:
    return F.exp(-decay * years_before * 0.5) + 0.5


def quantized(x: Column, factor: float = D.QUANT_RESIDUAL, low: int = -32768, high: int = 32767) -> Column:
    """Half-even rounding and clipping to a 16-bit number."""
    return F.least(F.greatest(F.bround(x * factor), F.lit(float(low))), F.lit(float(high))).cast("smallint")


def quantized_byte(x: Column, factor: float = D.QUANT_BYTE) -> Column:
    return F.least(F.greatest(F.bround(x * factor), F.lit(-128.0)), F.lit(127.0)).cast("tinyint")


def dequantized(q: Column, factor: float = D.QUANT_RESIDUAL) -> Column:
    return q.cast("double") / factor


def quantized_weights(w: Column, largest: Column, bits: int = 16) -> tuple[Column, Column]:
    """Codes and scale of model weights: scale = qmax / max|w|."""
    qmax = 2 ** (bits - 1)
    scale = F.lit(float(qmax)) / F.when(largest > 0, largest).otherwise(F.lit(1.0))
    return F.least(F.greatest(F.bround(w * scale), F.lit(float(-qmax))), F.lit(float(qmax - 1))).cast("int"), scale
