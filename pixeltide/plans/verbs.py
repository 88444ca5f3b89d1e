"""The public verbs - train, calibrate, detect, evaluate, check - as lazy plans over cube tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixeltide import defaults as D
from pixeltide.operators import baseline as B, composite as C, evaluate as E, regions as R, states as T, thresholds as H
from pixeltide.operators.cfar import cfar
from pixeltide.plans.shared import settled
from pixeltide.sources import models as M


@dataclass(frozen=True)
class Config:
    """Parameters of a run, with the method's defaults."""

    bands: tuple[str, ...]
    height: int
    width: int
    start: str | None = None
    end: str | None = None
    harmonics: int = D.HARMONICS
    ridge: float = 1e-6
    recency: float = 0.0
    horizon_decay: float = 0.5
    use_log: bool = False
    mode: str = "full"
    input_quality_screened: bool = False
    scales: tuple[tuple[int, int], ...] = D.CFAR_SCALES
    alpha: float = D.ALPHA
    reference_quantile: float = D.REFERENCE_QUANTILE
    samples_per_frame: int = D.SAMPLES_PER_FRAME
    min_valid_fraction: float = D.MIN_VALID_FRACTION
    min_stable_pixels: int = D.MIN_STABLE_PIXELS
    min_samples: int = D.MIN_SAMPLES
    states: T.StateSettings = field(default_factory=T.StateSettings)
    state_source: str = "model"  # or "observation"
    cleanup: bool = False
    pixel_size_m: float = D.PIXEL_SIZE_M
    transform: tuple[float, ...] = (1, 0, 0, 0, 1, 0)
    seed: int = 42

    @classmethod
    def from_yaml(cls, path: str) -> Config:
        import yaml

        with open(path, encoding="utf-8") as f:
            given = yaml.safe_load(f) or {}
        known = cls.__dataclass_fields__
        if unknown := sorted(set(given) - set(known) - {"loss"}):
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        values = {k: tuple(tuple(x) if isinstance(x, list) else x for x in v) if isinstance(v, list) else v for k, v in given.items() if k in known}
        if isinstance(values.get("states"), dict):
            values["states"] = T.StateSettings(**values["states"])
        if given.get("loss", "nll") != "nll":
            raise ValueError("only the nll loss is supported")
        return cls(**values)


Predictor = Callable[[DataFrame], DataFrame]


def time_domain(cube: DataFrame, config: Config) -> tuple[str, str]:
    """First and last observed days within the configured ones."""
    days = cube
    if config.start:
        days = days.where(F.col("acq_date") >= F.lit(config.start).cast("date"))
    if config.end:
        days = days.where(F.col("acq_date") <= F.lit(config.end).cast("date"))
    first, last = days.agg(F.min("acq_date"), F.max("acq_date")).first()
    if first is None or first == last:
        raise ValueError("no observations within the configured days")
    return str(first), str(last)


def train(cube: DataFrame, config: Config) -> tuple[dict, DataFrame]:
    """Fit the seasonal baseline; returns the model's facts and coefficients."""
    if not config.input_quality_screened:
        raise ValueError("input_quality_screened must be true: training needs cloud-free observations")
    start, end = time_domain(cube, config)
    inside = cube.where(F.col("acq_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    bands = list(config.bands)
    if config.use_log:
        inside = inside.withColumns({b: F.log1p(b) for b in bands})
    coef = B.fit(inside, bands, start, end, config.harmonics, config.ridge, config.recency, mode=config.mode)
    meta = {"start": start, "end": end, "n_bands": len(bands), "bands": bands, "harmonics": config.harmonics, "mode": config.mode, "composite": D.COMPOSITE_TAG, "quality_screened": True, "use_log": config.use_log, "horizon_decay": config.horizon_decay}
    return meta, coef


def predictor(meta: dict, coef: DataFrame) -> Predictor:
    """Adds mean and std of every band at each row's pixel and date."""
    bands = list(meta["bands"])

    def run(rows: DataFrame) -> DataFrame:
        made = B.predict(rows, coef, bands, meta["start"], meta["end"], meta["harmonics"], meta["horizon_decay"])
        return made.withColumns({f"{b}_mean": F.expm1(f"{b}_mean") for b in bands}) if meta.get("use_log") else made

    return run


def query_points(points: DataFrame, meta: dict, coef: DataFrame) -> DataFrame:
    """Mean and std at any (pixel_id, acq_date): the point query."""
    return predictor(meta, coef)(points)


def scored(cube: DataFrame, predict: Predictor, config: Config) -> DataFrame:
    """valid, d2, sam and cfar of every cell of the cube (pixel_id = row * width + col)."""
    bands = list(config.bands)
    rows = predict(cube.select("pixel_id", "acq_date", *bands))
    placed = B.score(rows, bands)
    placed = settled(placed.withColumn("row", F.expr(f"pixel_id div {config.width}").cast("int")).withColumn("col", (F.col("pixel_id") % config.width).cast("int")), "responses")
    rings = cfar(placed, config.height, config.width, config.scales, "acq_date")
    return placed.join(rings, ["acq_date", "row", "col"], "left")


def calibrate(cube: DataFrame, predict: Predictor, config: Config, check: bool = True) -> tuple[DataFrame, DataFrame]:
    """Profile (one row) and date audit, from the history of a cube.

    Scores of all frames; the latest stable period per pixel; date quality; a capped sample of each accepted frame;
    pooled quantiles.  The state is the model's mean, or the observation itself.
    """
    bands = list(config.bands)
    dates = T.check_frames(cube) if check else []
    grid = C.with_validity(C.dense(cube, bands), bands)
    if config.state_source == "model":
        states = predict(grid.select("pixel_id", "frame_id", "acq_date", *bands, "valid"))
        states = states.select("pixel_id", "frame_id", "acq_date", "valid", *[F.col(f"{b}_mean").alias(b) for b in bands])
    else:
        states = grid
    selected = settled(T.stable_states(states, bands, config.states).select("pixel_id", "acq_date", "valid", "stable"), "states")
    audit = H.date_quality(selected, config.min_valid_fraction, config.min_stable_pixels)
    accepted = audit.where("accepted").select("acq_date")
    if check and accepted.limit(D.MIN_FRAMES).count() < D.MIN_FRAMES:
        raise ValueError(f"fewer than {D.MIN_FRAMES} dates passed quality control")
    rows = scored(cube, predict, config).where("valid").select("pixel_id", "acq_date", "d2", "cfar", "sam")
    support = selected.where("stable").join(accepted, "acq_date", "left_semi").select("pixel_id", "acq_date")
    sample = settled(H.sample_per_frame(rows.join(support, ["pixel_id", "acq_date"], "left_semi"), config.samples_per_frame, config.seed), "sample")
    found = H.null_thresholds(sample, [config.alpha], config.reference_quantile, minimum=config.min_samples, check=check)
    facts = {
        "reference_quantile": config.reference_quantile, "calibration_frame_count": len(dates), "state_selection_method": f"{config.state_source}_state", "transition_multiplier": config.states.multiplier, "transition_guard_frames": config.states.guard_frames,
        "minimum_stable_observations": config.states.min_observations, "minimum_stable_days": config.states.min_days, "calibration_start_date": str(dates[0]) if dates else None, "calibration_end_date": str(dates[-1]) if dates else None,
    }
    return H.profile_row(found, len(bands), **facts), audit


def detect(cube: DataFrame, predict: Predictor, profile: DataFrame, config: Config) -> DataFrame:
    """Score and mask of every cell under a profile; with ``cleanup`` small regions go and gaps close."""
    made = H.decide(scored(cube, predict, config), M.thresholds_of(profile))
    out = made.select("acq_date", "pixel_id", "row", "col", "valid", "d2", "cfar", "sam", "score", "mask")
    if not config.cleanup:
        return out
    clean = R.cleaned(out, config.height, config.width, frame="acq_date").withColumnRenamed("mask", "_clean")
    return out.join(clean, ["acq_date", "row", "col"], "left").withColumn("mask", F.coalesce("_clean", F.lit(False))).drop("_clean")


def summarised(decided: DataFrame, config: Config) -> DataFrame:
    """Per frame: valid and anomalous pixels, area, top score, number of 4-connected regions."""
    by = decided.groupBy("acq_date").agg(F.count_if("valid").alias("valid_pixels"), F.count_if("mask").alias("anomaly_pixels"), F.max("score").alias("top_score"))
    regions = R.region_table(decided.select("acq_date", "row", "col", "mask"), config.transform, config.pixel_size_m, "acq_date").groupBy("acq_date").agg(F.count("*").alias("regions"))
    joined = by.join(regions, "acq_date", "left").withColumn("regions", F.coalesce("regions", F.lit(0)))
    return joined.withColumn("area_km2", F.col("anomaly_pixels") * config.pixel_size_m**2 / 1e6)


def evaluate(decided: DataFrame, points: DataFrame, config: Config) -> DataFrame:
    """Confusion metrics of a frame's mask at labelled points (x, y, label)."""
    placed = E.labels_on_grid(points, config.transform, config.height, config.width)
    joined = placed.join(decided.select("row", "col", "mask"), ["row", "col"])
    return E.confusion_metrics(joined, F.col("label"), F.col("mask"))


def extrapolation_rmse(cube: DataFrame, predict: Predictor, config: Config, after: str, through: str) -> DataFrame:
    """RMSE per held-out date after training, over valid pixels and all bands."""
    bands = list(config.bands)
    late = cube.where((F.col("acq_date") > F.lit(after).cast("date")) & (F.col("acq_date") <= F.lit(through).cast("date")))
    rows = B.score(predict(late.select("pixel_id", "acq_date", *bands)), bands).where("valid")
    return E.pooled_rmse(rows, [F.col(b) - F.col(f"{b}_mean") for b in bands], ["acq_date"])


def check(spark: SparkSession, folder: str, manifest_path: str) -> DataFrame:
    """Problems of a folder against its manifest (path or relative_path, sha256), by paths relative to the folder: missing,
    untracked, modified.  A manifest inside the folder is no part of it."""
    found = M.file_digests(spark, folder).select(M.relative_path(F.col("path"), folder).alias("path"), "sha256")
    found = found.where(F.col("path") != M.relative_path(F.lit(manifest_path), folder))
    listed = M.read_manifest(spark, manifest_path)
    declared = listed.select(M.relative_path(F.col("relative_path" if "relative_path" in listed.columns else "path"), folder).alias("path"), "sha256")
    return E.manifest_diff(declared, found)
