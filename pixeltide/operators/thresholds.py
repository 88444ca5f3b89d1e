"""Sampling of frames, date quality control, pooled empirical thresholds and the choice of alpha."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixeltide import defaults as D
from pixeltide.functions import scores as S


def sample_per_frame(scored: DataFrame, k: int = D.SAMPLES_PER_FRAME, seed: int = 42, frame: str = "acq_date", pixel: str = "pixel_id") -> DataFrame:
    """At most k rows of each frame, without replacement, by the order of a seeded digest; the same on every run."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(frame).cast("string"), F.col(pixel).cast("string")))
    ranked = scored.withColumn("_place", F.row_number().over(W.partitionBy(frame).orderBy(order, pixel)))
    return ranked.where(F.col("_place") <= k).drop("_place")


def fixed_support_sample(scored: DataFrame, support: DataFrame, k: int = D.SAMPLES_PER_FRAME, seed: int = 42, frame: str = "acq_date", pixel: str = "pixel_id") -> DataFrame:
    """Samples of valid pixels inside a given support (pixel, frame, support); a frame without a support is an error.

    The digest holds the frame, so that the draws of different dates are independent.
    """
    if not scored.select(frame).distinct().join(support.select(frame).distinct(), frame, "left_anti").isEmpty():
        raise ValueError("frame without support")
    inside = support.where("support").select(frame, pixel)
    return sample_per_frame(scored.where("valid").join(inside, [frame, pixel], "left_semi"), k, seed, frame, pixel)


def date_quality(selected: DataFrame, min_valid: float = D.MIN_VALID_FRACTION, min_stable: int = D.MIN_STABLE_PIXELS, frame: str = "acq_date") -> DataFrame:
    """Per frame: pixel counts, valid fraction, accepted, and the reasons against it."""
    by = selected.groupBy(frame).agg(F.count("*").alias("pixel_count"), F.count_if("valid").alias("valid_pixels"), F.count_if("stable").alias("stable_pixels"))
    fraction = F.col("valid_pixels") / F.col("pixel_count")
    reasons = F.array_compact(F.array(F.when(fraction < min_valid, F.lit("low_valid_fraction")), F.when(F.col("stable_pixels") < min_stable, F.lit("few_stable_pixels"))))
    return by.select(frame, "pixel_count", "valid_pixels", "stable_pixels", fraction.alias("valid_fraction"), (F.size(reasons) == 0).alias("accepted"), F.array_join(reasons, ",").alias("reasons"))


def accepted_frames(selected: DataFrame, minimum: int = D.MIN_FRAMES, **limits) -> tuple[DataFrame, DataFrame]:
    """Rows of the accepted frames and the audit; an error if fewer than ``minimum`` frames pass."""
    audit = date_quality(selected, **limits)
    if audit.where("accepted").limit(minimum).count() < minimum:
        raise ValueError(f"fewer than {minimum} dates passed quality control")
    return selected.join(audit.where("accepted").select("acq_date"), "acq_date", "left_semi"), audit


def split_frames(frames: DataFrame, frame: str = "acq_date", minimum: int = D.MIN_FRAMES, check: bool = True) -> DataFrame:
    """Every third frame in time order is for validation."""
    dates = frames.select(frame).distinct()
    if check and dates.limit(minimum).count() < minimum:
        raise ValueError("at least four frames are required")
    place = F.row_number().over(W.orderBy(frame)) - 1  # one row per date
    return dates.select(frame, F.when(place % 3 == 2, F.lit("validation")).otherwise(F.lit("calibration")).alias("role"))


def weighted_quantile(values: DataFrame, q: float, value: str, weight: str, by: list[str]) -> DataFrame:
    """Interpolation over mid-weights of the sorted values, per group; clamped at the ends."""
    fine = values.where((F.col(weight) > 0) & F.col(value).isNotNull() & ~F.isnan(value))
    w = W.partitionBy(*by).orderBy("_v", "_w")
    rows = fine.select(*by, F.col(value).cast("double").alias("_v"), F.col(weight).cast("double").alias("_w"))
    upto = F.sum("_w").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    every = F.sum("_w").over(W.partitionBy(*by))
    placed = rows.withColumn("_c", (upto - 0.5 * F.col("_w")) / every)
    order = W.partitionBy(*by).orderBy("_c", "_v")
    paired = placed.withColumn("_c2", F.lead("_c").over(order)).withColumn("_v2", F.lead("_v").over(order))
    inside = (F.col("_c") <= q) & (F.col("_c2") > q)
    part = F.when(inside, F.col("_v") + (F.col("_v2") - F.col("_v")) * ((F.lit(q) - F.col("_c")) / (F.col("_c2") - F.col("_c"))))
    return paired.groupBy(*by).agg(
        F.coalesce(F.max(part), F.when(F.min("_c") > q, F.min_by("_v", "_c")), F.max_by("_v", "_c")).alias("quantile"), F.count("*").alias("sample_count")
    )


def _finite(samples: DataFrame) -> DataFrame:
    fine = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < F.lit(float("inf"))) for c in ("d2", "cfar", "sam")]
    return samples.where(fine[0] & fine[1] & fine[2]).select("d2", "cfar", "sam", *[c for c in samples.columns if c not in ("d2", "cfar", "sam")])


def reference_levels(samples: DataFrame, trims: Iterable[float], q: float = D.REFERENCE_QUANTILE, minimum: int = D.MIN_SAMPLES) -> DataFrame:
    """Per trim level: counts, median, trim limit and the three reference quantiles of the trimmed null.

    The trim keeps d2 up to its limit; if fewer than ``minimum`` samples stay, all are used.
    """
    fine = _finite(samples)
    levels = sorted(set(trims))
    first = fine.agg(F.count("*").alias("sample_count"), F.percentile("d2", F.array(F.lit(0.5), *[F.lit(1.0 - t) for t in levels])).alias("p"))
    limits = first.select("sample_count", F.element_at("p", 1).alias("robust_scale"), F.posexplode(F.slice("p", 2, len(levels))).alias("i", "null_limit"))
    limits = limits.withColumn("trim", F.element_at(F.array(*map(F.lit, levels)), F.col("i") + 1)).drop("i")
    joined = fine.crossJoin(F.broadcast(limits))  # one row per trim level
    inside = F.col("d2") <= F.col("null_limit")
    by = ["trim", "null_limit", "robust_scale", "sample_count"]
    cut = joined.groupBy(*by).agg(
        F.count_if(inside).alias("inside_count"),
        *[F.percentile(F.when(inside, F.col(c)), F.lit(q)).alias(f"in_{c}") for c in ("d2", "cfar", "sam")],
        *[F.percentile(c, F.lit(q)).alias(f"all_{c}") for c in ("d2", "cfar", "sam")],
    )
    few = F.col("inside_count") < minimum
    return cut.select(*by, few.alias("untrimmed"), F.when(few, F.col("sample_count")).otherwise(F.col("inside_count")).alias("null_count"), *[F.when(few, F.col(f"all_{c}")).otherwise(F.col(f"in_{c}")).alias(f"{c}_reference") for c in ("d2", "cfar", "sam")])


def trim_for(alpha: float, trim: float = D.NULL_TRIM) -> float:
    return min(trim, alpha / 2)


def null_thresholds(samples: DataFrame, alphas: Iterable[float] = (D.ALPHA,), q: float = D.REFERENCE_QUANTILE, trim: float | None = None, minimum: int = D.MIN_SAMPLES, check: bool = True) -> DataFrame:
    """One row per alpha: trim, counts, references and the joint multiplier.  Alphas of one trim level share a pass."""
    alphas = sorted(set(alphas), reverse=True)
    if any(not 0 < a < 0.5 for a in alphas):
        raise ValueError("alpha must be between 0 and 0.5")
    if not 0.5 < q < 1:
        raise ValueError("reference_quantile must be between 0.5 and 1.0")
    trims = {a: trim if trim is not None else trim_for(a) for a in alphas}
    if any(not 0 < t < a for a, t in trims.items()):
        raise ValueError("null_trim_alpha must be positive and smaller than alpha")
    fine = _finite(samples)
    if check and fine.limit(minimum).count() < minimum:
        raise ValueError(f"At least {minimum} finite normal calibration samples are required")
    levels = reference_levels(samples, trims.values(), q, minimum)
    joined = fine.crossJoin(F.broadcast(levels))
    used = joined.where(F.col("untrimmed") | (F.col("d2") <= F.col("null_limit")))
    joint = S.joint_null_score(F.col("d2"), F.col("cfar"), F.col("sam"), F.col("d2_reference"), F.col("cfar_reference"), F.col("sam_reference"))
    made = used.groupBy("trim").agg(F.percentile(joint, F.array(*[F.lit(1.0 - a) for a in alphas])).alias("js"))
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("alpha"), F.lit(trims[a]).alias("t"), F.lit(i + 1).alias("i")) for i, a in enumerate(alphas)])).alias("x")
    rows = made.select("trim", "js", pairs).where(F.col("x.t") == F.col("trim")).select(F.col("x.alpha").alias("alpha"), "trim", F.element_at("js", F.col("x.i")).alias("fusion_threshold"))
    return rows.join(F.broadcast(levels), "trim").select("alpha", "trim", "sample_count", "null_count", "null_limit", "robust_scale", "d2_reference", "cfar_reference", "sam_reference", "fusion_threshold")


def decide(scored: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Adds ratios, score and mask under every threshold row (a handful), broadcast to all pixels."""
    limits = thresholds.select("alpha", "d2_reference", "cfar_reference", "sam_reference", "fusion_threshold")
    joined = scored.crossJoin(F.broadcast(limits))
    return with_decision(joined)


def with_decision(joined: DataFrame) -> DataFrame:
    j = F.greatest(F.col("fusion_threshold"), F.lit(D.JOINT_FLOOR))
    step = joined.withColumns({f"{c}_ratio": F.when(F.col("valid"), S.ratio(F.col(c), F.col(f"{c}_reference"))) for c in ("d2", "cfar", "sam")})
    over = {c: F.coalesce(F.col(f"{c}_ratio") > j, F.lit(False)) for c in ("d2", "cfar", "sam")}
    score = F.when(F.col("valid"), F.least(F.col("d2_ratio"), F.greatest("cfar_ratio", "sam_ratio")) / j)
    return step.withColumns({"score": score, "d2_over": over["d2"], "cfar_over": over["cfar"], "sam_over": over["sam"], "mask": over["d2"] & (over["cfar"] | over["sam"])})


def diagnostics(decided: DataFrame, by: list[str]) -> DataFrame:
    return decided.groupBy(*by).agg(F.count_if("valid").alias("valid_pixels"), F.count_if("d2_over").alias("d2_exceedances"), F.count_if("cfar_over").alias("cfar_exceedances"), F.count_if("sam_over").alias("sam_exceedances"), F.count_if("mask").alias("anomaly_pixels"))


def false_alarm_rates(decided: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per frame (and alpha): anomalies among valid pixels; NULL without any."""
    out = diagnostics(decided, by or ["alpha", "acq_date"])
    return out.withColumn("far", F.when(F.col("valid_pixels") > 0, F.col("anomaly_pixels") / F.col("valid_pixels")))


def select_alpha(rates: DataFrame, target: float = D.TARGET_FAR, date_quantile: float = D.DATE_QUANTILE) -> DataFrame:
    """Per alpha the mean and the date-quantile of the rates, and which alpha is chosen: the largest within the target,
    else the smallest of all."""
    by = rates.groupBy("alpha").agg(F.avg("far").alias("mean_far"), F.percentile("far", F.lit(date_quantile)).alias("selection_far"))
    fits = F.when(F.col("selection_far") <= target, F.col("alpha"))
    chosen = F.coalesce(F.max(fits).over(W.partitionBy()), F.min("alpha").over(W.partitionBy()))  # a row per alpha
    return by.withColumn("selected", F.col("alpha") == chosen)


def evaluate_alphas(calibration: DataFrame, validation: DataFrame, alphas: Iterable[float] = D.ALPHA_CANDIDATES, target: float = D.TARGET_FAR, date_quantile: float = D.DATE_QUANTILE, **options) -> DataFrame:
    """Thresholds of all candidates in one pass, rates of all on the held-out frames in another."""
    return select_alpha(false_alarm_rates(decide(validation, null_thresholds(calibration, alphas, **options))), target, date_quantile)


def profile_row(thresholds: DataFrame, n_bands: int, **facts) -> DataFrame:
    """The 26-field threshold profile as one row."""
    given = {k: facts.get(k) for k in ("case", "method", "calibration_source", "state_selection_method", "calibration_start_date", "calibration_end_date")}
    numbers = {k: facts.get(k) for k in ("calibration_frame_count", "transition_guard_frames", "minimum_stable_observations", "minimum_stable_days")}
    def put(value, kind) -> Column:
        return F.lit(value).cast(kind)
    return thresholds.select(
        "alpha", F.col("d2_reference").alias("d2_threshold"), F.col("cfar_reference").alias("cfar_threshold"), F.col("sam_reference").alias("sam_threshold"), F.col("sam_reference").alias("empirical_sam_threshold"),
        F.col("sample_count").cast("int"), F.col("sample_count").cast("int").alias("stable_sample_count"), F.col("null_count").cast("int").alias("null_sample_count"), put(n_bands, "int").alias("n_bands"),
        F.col("null_limit").alias("preliminary_null_limit"), "robust_scale", "fusion_threshold", put(facts.get("reference_quantile", D.REFERENCE_QUANTILE), "double").alias("reference_quantile"),
        *[put(v, "int").alias(k) for k, v in numbers.items()], put(facts.get("transition_multiplier"), "double").alias("transition_multiplier"), *[put(v, "string").alias(k) for k, v in given.items()],
        F.lit(D.PROFILE_VERSION).alias("schema_version"), F.lit(D.DECISION_RULE).alias("decision_rule"),
    )
