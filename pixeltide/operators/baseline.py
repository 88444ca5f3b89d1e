"""Seasonal baseline per pixel and band: normal equations by aggregation, a small solve per group, prediction as columns.

mean(t) = intercept + trend * min(t, 1) + harmonics; weighted ridge regression needs only sums of products, which
combine map-side; the solve sees one row per pixel and band.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixeltide import defaults as D
from pixeltide.functions import scores as S


def design(day: Column, t: Column, harmonics: int = D.HARMONICS, period: float = D.PERIOD_DAYS) -> list[Column]:
    """1, min(t, 1), then cos and sin of each harmonic."""
    out = [F.lit(1.0), F.least(t, F.lit(1.0))]
    for k in range(1, harmonics + 1):
        angle = day * (2 * math.pi * k / period)
        out += [F.cos(angle), F.sin(angle)]
    return out


def long_form(cube: DataFrame, bands: list[str], start, end) -> DataFrame:
    """pixel_id, band, day (since start), t, y of all present values."""
    day = F.datediff("acq_date", F.lit(start).cast("date")).cast("double")
    span = F.datediff(F.lit(end).cast("date"), F.lit(start).cast("date")).cast("double")
    values = F.explode(F.array(*[F.struct(F.lit(i).alias("band"), F.col(b).alias("y")) for i, b in enumerate(bands)])).alias("v")
    return cube.select("pixel_id", day.alias("day"), F.greatest(day / span, F.lit(0.0)).alias("t"), values).select("pixel_id", "v.band", "day", "t", "v.y").where("y IS NOT NULL")


def gram_sums(rows: DataFrame, terms: list[Column], weight: Column | None = None, keys: tuple[str, ...] = ("pixel_id", "band")) -> DataFrame:
    """Per group the weighted sums phi_i phi_j (i <= j), phi_i y, y^2 and the count."""
    w = weight if weight is not None else F.lit(1.0)
    n = len(terms)
    sums = [F.sum(w * terms[i] * terms[j]).alias(f"g_{i}_{j}") for i in range(n) for j in range(i, n)]
    sums += [F.sum(w * terms[i] * F.col("y")).alias(f"v_{i}") for i in range(n)]
    return rows.groupBy(*keys).agg(*sums, F.sum(w * F.col("y") * F.col("y")).alias("yy"), F.sum(w).alias("ww"), F.count("*").alias("n"))


def solve(sums: DataFrame, n_terms: int, ridge: float = 1e-6, keys: tuple[str, ...] = ("pixel_id", "band")) -> DataFrame:
    """beta and residual variance of every group: batched linear solves over Arrow batches."""
    kinds = dict(sums.dtypes)

    def run(batches):
        for pdf in batches:
            m = len(pdf)
            g = np.zeros((m, n_terms, n_terms))
            for i in range(n_terms):
                for j in range(i, n_terms):
                    g[:, i, j] = g[:, j, i] = pdf[f"g_{i}_{j}"]
            v = pdf[[f"v_{i}" for i in range(n_terms)]].to_numpy()
            lift = np.eye(n_terms) * ridge
            lift[0, 0] = 1e-9  # the intercept is hardly shrunk
            a = g + lift * np.maximum(pdf["ww"].to_numpy(), 1e-9)[:, None, None]
            beta = np.linalg.solve(a, v[:, :, None])[:, :, 0] if m else v
            rss = pdf["yy"].to_numpy() - 2 * (beta * v).sum(1) + np.einsum("ni,nij,nj->n", beta, g, beta)
            out = pdf[list(keys)].copy()
            out["beta"] = list(beta)
            out["variance"] = np.maximum(rss / np.maximum(pdf["ww"].to_numpy(), 1e-9), 0)
            out["n"] = pdf["n"]
            yield out

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", beta array<double>, variance double, n bigint"
    return sums.mapInPandas(run, schema)


MODES = ("full", "no_spatial", "no_temporal", "no_prob")


def fit(cube: DataFrame, bands: list[str], start, end, harmonics: int = D.HARMONICS, ridge: float = 1e-6, recency: float = 0.0, years: float | None = None, mode: str = "full") -> DataFrame:
    """model_coef: pixel_id, band, beta, log_var, n.

    Ablations: ``no_spatial`` fits one curve for all pixels, ``no_temporal`` a constant, ``no_prob`` takes unit variance.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    rows = long_form(cube, bands, start, end)
    total_years = years or (pd.Timestamp(end) - pd.Timestamp(start)).days / D.PERIOD_DAYS
    weight = S.recency_weight((F.lit(1.0) - F.col("t")) * total_years, recency) if recency else None
    terms = design(F.col("day"), F.col("t"), harmonics)
    used = terms[:1] if mode == "no_temporal" else terms
    keys = ("band",) if mode == "no_spatial" else ("pixel_id", "band")
    made = solve(gram_sums(rows, used, weight, keys), len(used), ridge, keys)
    if mode == "no_spatial":
        made = cube.select("pixel_id").distinct().crossJoin(F.broadcast(made))  # a row per band
    if len(used) < len(terms):
        made = made.withColumn("beta", F.concat("beta", F.array_repeat(F.lit(0.0), len(terms) - len(used))))
    log_var = F.lit(0.0) if mode == "no_prob" else F.log(F.greatest("variance", F.lit(1e-9)))
    return made.select("pixel_id", "band", "beta", log_var.alias("log_var"), "n")


def wide_model(coef: DataFrame, n_bands: int) -> DataFrame:
    """One row per pixel with struct columns beta_i and log_var_i, ready for one join to the cube."""
    aggs = []
    for i in range(n_bands):
        mine = F.col("band") == i
        aggs += [F.first(F.when(mine, F.col("beta")), ignorenulls=True).alias(f"beta_{i}"), F.first(F.when(mine, F.col("log_var")), ignorenulls=True).alias(f"log_var_{i}")]
    return coef.groupBy("pixel_id").agg(*aggs)


def predict(grid: DataFrame, coef: DataFrame, bands: list[str], start, end, harmonics: int = D.HARMONICS, horizon_decay: float = 0.0) -> DataFrame:
    """Adds <band>_mean and <band>_std at each row's acq_date; beyond the training range the variance inflates."""
    day = F.datediff("acq_date", F.lit(start).cast("date")).cast("double")
    span = F.datediff(F.lit(end).cast("date"), F.lit(start).cast("date")).cast("double")
    t = F.greatest(day / span, F.lit(0.0))
    terms = design(day, t, harmonics)
    joined = grid.join(wide_model(coef, len(bands)), "pixel_id", "left")
    made = {}
    for i, b in enumerate(bands):
        made[f"{b}_mean"] = S.total([F.element_at(f"beta_{i}", k + 1) * x for k, x in enumerate(terms)])
        late = 2 * F.log1p(F.lit(horizon_decay) * F.greatest(t - 1, F.lit(0.0)))
        made[f"{b}_std"] = S.log_variance_to_std(F.col(f"log_var_{i}") + late)
    return joined.withColumns(made).drop(*[f"{p}_{i}" for i in range(len(bands)) for p in ("beta", "log_var")])


def corrected(predicted: DataFrame, correction: DataFrame, bands: list[str], day: Column) -> DataFrame:
    """Adds the per-pixel seasonal correction and takes its residual scale as std; pixels it lacks are an error."""
    joined = predicted.join(correction, "pixel_id", "left")
    covered = F.assert_true(F.col("coef").isNotNull(), "pixel without correction coefficients")
    joined = joined.where(covered.isNull())
    made = {}
    for i, b in enumerate(bands):
        made[f"{b}_mean"] = F.col(f"{b}_mean") + S.linear_correction(day, [F.element_at(F.element_at("coef", k + 1), i + 1) for k in range(1 + 2 * D.HARMONICS)])
        made[f"{b}_std"] = F.element_at("scale", i + 1)
    return joined.withColumns(made).drop("coef", "scale")


def score(observed: DataFrame, bands: list[str]) -> DataFrame:
    """valid, d2 and sam against <band>_mean and <band>_std; NULL where not valid."""
    from pixeltide.functions.masks import valid_observation

    obs, mean, std = ([F.col(f"{b}{s}") for b in bands] for s in ("", "_mean", "_std"))
    fine = valid_observation(obs)
    for c in (*mean, *std):
        fine = fine & F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))
    step = observed.withColumn("valid", fine)
    return step.withColumns({"d2": F.when(F.col("valid"), S.d2(obs, mean, std)), "sam": F.when(F.col("valid"), S.sam(obs, mean))})


def residuals(observed: DataFrame, bands: list[str]) -> DataFrame:
    """<band>_q: 16-bit codes of observation minus prediction."""
    return observed.withColumns({f"{b}_q": S.quantized(F.col(b) - F.col(f"{b}_mean")) for b in bands})


def reconstructed(coded: DataFrame, bands: list[str], use_log: bool = False) -> DataFrame:
    """<band>_rec: prediction plus decoded residual."""
    def back(b: str) -> Column:
        x = F.col(f"{b}_mean") + S.dequantized(F.col(f"{b}_q"))
        return F.expm1(x) if use_log else x
    return coded.withColumns({f"{b}_rec": back(b) for b in bands})


def residual_std(cube: DataFrame, bands: list[str], residual: Callable[[str], Column]) -> DataFrame:
    """Population deviation of the residual over time, per pixel and band."""
    return cube.groupBy("pixel_id").agg(*[F.stddev_pop(residual(b)).alias(f"{b}_std") for b in bands])
