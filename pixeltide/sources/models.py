"""Models, profiles, labels and manifests: readers and writers of their tables and files."""

from __future__ import annotations

import json
import os
import re
import struct
import tempfile
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixeltide import defaults as D
from pixeltide.functions import scores as S

#: The fields of a threshold profile and their types.
PROFILE = {
    "alpha": "double", "d2_threshold": "double", "cfar_threshold": "double", "sam_threshold": "double", "empirical_sam_threshold": "double", "sample_count": "int", "stable_sample_count": "int", "null_sample_count": "int", "n_bands": "int",
    "preliminary_null_limit": "double", "robust_scale": "double", "fusion_threshold": "double", "reference_quantile": "double", "calibration_frame_count": "int", "case": "string", "method": "string", "calibration_source": "string",
    "state_selection_method": "string", "transition_multiplier": "double", "transition_guard_frames": "int", "minimum_stable_observations": "int", "minimum_stable_days": "int", "calibration_start_date": "string", "calibration_end_date": "string",
    "schema_version": "int", "decision_rule": "string",
}
PROFILE_SCHEMA = ", ".join(f"`{k}` {v}" for k, v in PROFILE.items())


def profile_from(spark: SparkSession, values: Mapping) -> DataFrame:
    """One row; unknown keys are ignored, an old version or another rule is an error."""
    if int(values.get("schema_version", 0)) < D.PROFILE_VERSION:
        raise ValueError("the threshold profile is of an older version; calibrate again")
    if values.get("decision_rule") != D.DECISION_RULE:
        raise ValueError(f"unsupported decision rule {values.get('decision_rule')!r}")
    cast = {"double": float, "int": int, "string": str}
    row = tuple(None if values.get(k) is None else cast[t](values[k]) for k, t in PROFILE.items())
    return spark.createDataFrame([row], PROFILE_SCHEMA)


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path, wholetext=True).first()
    return profile_from(spark, json.loads(lines[0]))


def write_profile(profile: DataFrame, path: str) -> None:
    """One JSON file in a folder."""
    profile.coalesce(1).write.mode("overwrite").json(path)


def thresholds_of(profile: DataFrame) -> DataFrame:
    """The columns a decision needs."""
    return profile.select("alpha", F.col("d2_threshold").alias("d2_reference"), F.col("cfar_threshold").alias("cfar_reference"), F.col("sam_threshold").alias("sam_reference"), "fusion_threshold")


# ---- model tables


def write_model(path: str, meta: dict, coef: DataFrame, profile: DataFrame | None = None) -> None:
    spark = coef.sparkSession
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")
    coef.write.mode("overwrite").parquet(f"{path}/coef")
    if profile is not None:
        embed_profile(path, profile)


def embed_profile(path: str, profile: DataFrame) -> None:
    """Put a profile beside a model; the coefficients are not touched, the writer's commit makes it all or nothing."""
    write_profile(profile, f"{path}/profile")


def read_meta(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.json(f"{path}/meta").first()["meta"])


def read_model(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    return read_meta(spark, path), spark.read.parquet(f"{path}/coef")


def check_contract(meta: dict, bands: int, mode: str = "full") -> None:
    """All that is wrong with a model for this use, in one error."""
    wrong = [f"{k}: expected {v!r}, found {meta.get(k)!r}" for k, v in (("n_bands", bands), ("mode", mode), ("composite", D.COMPOSITE_TAG)) if meta.get(k) != v]
    if not meta.get("quality_screened"):
        wrong.append("input_quality_screened is not set")
    if wrong:
        raise ValueError("incompatible model: " + "; ".join(wrong))


def write_correction(coefficients: DataFrame, scales: DataFrame, path: str) -> None:
    """The deployment table pixel_id, coef, scale; the two sides must have the same pixels."""
    from pyspark.errors import PySparkValueError

    from pixeltide.operators.evaluate import same_keys

    keys = same_keys(coefficients, scales, ["pixel_id"]).first()
    if keys["only_left"] or keys["only_right"]:
        raise PySparkValueError(f"coefficients and scales differ in {keys['only_left']} and {keys['only_right']} pixels")
    coefficients.join(scales, "pixel_id").select("pixel_id", "coef", "scale").write.mode("overwrite").parquet(path)


# ---- containers


def container_headers(spark: SparkSession, path: str) -> DataFrame:
    """path and JSON header of model containers: a little-endian length, then the header; the payload is not decoded."""
    found = spark.read.format("binaryFile").load(path)
    raw = F.hex(F.substring("content", 1, 4))
    little = F.concat(*[F.substring(raw, i, 2) for i in (7, 5, 3, 1)])
    size = F.conv(little, 16, 10).cast("int")
    return found.select("path", F.decode(F.substring("content", F.lit(5), size), "utf-8").alias("header"))


def container(header: dict, payload: bytes) -> bytes:
    """The container layout: header length, header, payload length, payload."""
    text = json.dumps(header).encode()
    return struct.pack("<I", len(text)) + text + struct.pack("<I", len(payload)) + payload


def quantized_coefficients(coef: DataFrame, bits: int = 16) -> DataFrame:
    """Codes and the common scale of all model coefficients; rounding is half-even."""
    top = coef.select(F.explode("beta").alias("w")).agg(F.max(F.abs("w")).alias("_top"))
    joined = coef.crossJoin(F.broadcast(top))
    scale = S.quantized_weights(F.lit(0.0), F.col("_top"), bits)[1]
    return joined.withColumn("scale", scale).withColumn("codes", F.transform("beta", lambda w: S.quantized_weights(w, F.col("_top"), bits)[0])).drop("_top", "beta")


def dequantized_coefficients(coded: DataFrame) -> DataFrame:
    return coded.withColumn("beta", F.transform("codes", lambda q: q / F.col("scale"))).drop("codes", "scale")


# ---- labels, manifests, alerts


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """x, y, label of a CSV file with LON/LAT or X/Y and GT_LABEL or LABEL, in any letter case."""
    raw = spark.read.csv(path, header=True)
    by = {c.strip().lower(): c for c in raw.columns}

    def one(*names: str):
        for n in names:
            if n in by:
                return F.col(f"`{by[n]}`")
        raise ValueError(f"the label file has none of the columns {names}")

    return raw.select(one("lon", "x").cast("double").alias("x"), one("lat", "y").cast("double").alias("y"), one("gt_label", "label").cast("int").alias("label"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True)


def relative_path(path, folder: str):
    """A path below ``folder`` without that folder; any scheme, ``./`` and doubled slashes do not matter."""
    plain = F.regexp_replace(F.regexp_replace(path, "^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*(?=/))?", ""), "/+", "/")
    root = re.sub("/+", "/", re.sub("^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*(?=/))?", "", folder)).rstrip("/") + "/"
    below = F.when(F.startswith(plain, F.lit(root)), F.substring(plain, len(root) + 1, 1 << 30)).otherwise(plain)
    return F.regexp_replace(below, r"^(\./)+", "")


def source_paths(record: DataFrame) -> DataFrame:
    """paths of each record: its JSON list, else its single path; an empty list is an error."""
    listed = F.from_json("source_paths", "array<string>")
    checked = F.when(F.size(listed) == 0, F.raise_error(F.lit("empty source_paths")).cast("array<string>")).otherwise(listed)
    return record.withColumn("paths", F.coalesce(checked, F.array("path")))


def file_digests(spark: SparkSession, path: str, text: bool = False, pattern: str = "*") -> DataFrame:
    """path and sha256 of every file; text files with CRLF read as LF."""
    from pixeltide.functions.digests import binary_digest, text_digest

    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    digest = text_digest(F.decode("content", "utf-8")) if text else binary_digest(F.col("content"))
    return found.select("path", F.col("length").alias("bytes"), digest.alias("sha256"))


def write_metrics(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def alerts(summary: DataFrame, created: str) -> DataFrame:
    """One JSON document per frame: the full alert where anomalies were found, else four fields.

    ``summary`` has acq_date, anomaly_pixels, area_km2, top_score and regions; ``created`` stands for the wall clock.
    """
    full = F.to_json(F.struct(F.lit("anomaly").alias("type"), F.lit(created).alias("created"), F.col("acq_date").alias("date"), F.round("area_km2", 4).alias("area_km2"), "anomaly_pixels", "top_score", "regions"))
    compact = F.to_json(F.struct(F.lit("no_anomaly").alias("type"), F.lit(created).alias("created"), F.col("acq_date").alias("date"), F.lit(0.0).alias("area_km2")))
    return summary.select("acq_date", F.when(F.col("anomaly_pixels") > 0, full).otherwise(compact).alias("alert"))


def batch_summary(summary: DataFrame) -> DataFrame:
    return summary.agg(F.count("*").alias("scenes"), F.count_if(F.col("anomaly_pixels") > 0).alias("with_anomaly"), F.coalesce(F.sum("area_km2"), F.lit(0.0)).alias("area_km2"))


def write_geojson(regions: DataFrame, outlines: DataFrame, path: str, frame: str = "frame_id") -> None:
    """Features of regions as lines of GeoJSON text."""
    joined = regions.join(outlines, [frame, "region_id"])
    shape = F.from_json("geometry", "type string, coordinates array<array<array<double>>>")
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.col(frame), "region_id", "area_m2").alias("properties"), shape.alias("geometry")))
    joined.select(feature.alias("value")).write.mode("overwrite").text(path)


def write_text_atomically(path: str, text: str) -> None:
    """A local file, replaced whole."""
    handle, name = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(name, path)
