"""Scenes: raster files to pixel rows, with band selection, scaling, windows and same-day composites."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixeltide import defaults as D
from pixeltide.functions import dates, masks
from pixeltide.operators import composite

PIXELS = "path string, row int, col int, raw array<float>"
SCENES = "path string, height int, width int, n_bands int, transform array<double>, crs string, scene_max double, error string"


def files(spark: SparkSession, path: str, pattern: str = "*.tif*", recursive: bool = True) -> DataFrame:
    """path, length, content; contents are read only where a later step asks for them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)


def dated(found: DataFrame, strict: bool = False) -> DataFrame:
    """Adds acq_ts and acq_date from the file name."""
    name = F.element_at(F.split("path", "/"), -1)
    return found.withColumn("acq_ts", dates.acquisition_time(name, strict=strict)).withColumn("acq_date", F.to_date("acq_ts"))


def dated_before(found: DataFrame, target: str) -> DataFrame:
    """Files acquired strictly before a time."""
    return dated(found).where(F.col("acq_ts") < F.lit(target).cast("timestamp_ntz"))


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pixeltide.sources.tiff import read

    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            values = read(content.as_py()).values
            h, w, bands = values.shape
            flat = pa.array(values.reshape(-1).astype(np.float32))
            for top in range(0, h, max(1, (1 << 16) // w)):
                rows = min(h - top, max(1, (1 << 16) // w))
                n = rows * w
                r, c = np.divmod(np.arange(n, dtype=np.int32), np.int32(w))
                piece = flat.slice(top * w * bands, n * bands)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * bands, bands, dtype=np.int32)), piece)
                yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(r + top), pa.array(c), lists], names=["path", "row", "col", "raw"])


def pixels(found: DataFrame) -> DataFrame:
    """path, row, col, raw: a row per pixel, decoded file by file in bounded pieces."""
    return found.select("path", "content").mapInArrow(_decode, PIXELS)


def _describe(batches):
    from pixeltide.sources.tiff import read

    for pdf in batches:
        out = []
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            try:
                r = read(bytes(content))
                finite = r.values[np.isfinite(r.values)]
                out.append((path, *r.values.shape, list(r.transform), r.crs, float(finite.max()) if finite.size else None, None))
            except Exception as error:
                out.append((path, None, None, None, None, None, None, str(error)[:300]))
        yield pd.DataFrame(out, columns=["path", "height", "width", "n_bands", "transform", "crs", "scene_max", "error"])


def scenes(found: DataFrame) -> DataFrame:
    """One row per file: shape, transform, CRS, largest value; what cannot be read has its error and no more."""
    return dated(found.select("path", "content").mapInPandas(_describe, SCENES))


def observations(found: DataFrame, bands: list[int], names: list[str], *, mode: str = "null", scale: str = "auto", expected: int | None = None, strict: bool = True) -> DataFrame:
    """acq_date, path, row, col and named bands.

    ``mode``: invalid values as "null", "zero" or left as they are ("raw").  ``scale``: "always", or "auto" where the
    scene's largest selected value says that it holds counts.  A scene with fewer bands than asked for is an error.
    """
    if not bands:
        raise ValueError("source_band_indices is required")
    if expected is not None and len(bands) != expected:
        raise ValueError(f"{expected} bands are expected; source_band_indices has {len(bands)}")
    rows = pixels(found).select("path", "row", "col", *[masks.select_bands(F.col("raw"), [b])[0].cast("double").alias(n) for b, n in zip(bands, names, strict=True)])
    if scale == "auto":
        finite = [masks.clean(F.col(n)) for n in names]
        tops = rows.groupBy("path").agg(F.greatest(*[F.max(x) for x in finite]).alias("_top") if len(names) > 1 else F.max(finite[0]).alias("_top"))
        rows = rows.join(tops, "path")
        rows = rows.withColumns({n: masks.auto_scaled(F.col(n), F.col("_top")) for n in names}).drop("_top")
    else:
        rows = rows.withColumns({n: masks.scaled(F.col(n)) for n in names})
    how = {"null": masks.range_mask, "zero": masks.range_mask_zero, "raw": masks.clean}[mode]
    return dated(rows.withColumns({n: how(F.col(n)) for n in names}), strict=strict)


def roi(rows: DataFrame, col_off: int, row_off: int, width: int, height: int) -> DataFrame:
    """A window of the grid with its own origin; the comparisons reach the scan of a table."""
    inside = rows.where(F.col("row").between(row_off, row_off + height - 1) & F.col("col").between(col_off, col_off + width - 1))
    return inside.withColumn("row", F.col("row") - row_off).withColumn("col", F.col("col") - col_off)


def roi_transform(transform: tuple[float, ...], col_off: int, row_off: int) -> tuple[float, ...]:
    a, b, c, d, e, f = transform
    return a, b, a * col_off + b * row_off + c, d, e, d * col_off + e * row_off + f


def load_cube(spark: SparkSession, path: str, bands: list[int], names: list[str], *, start: str | None = None, end: str | None = None, window: tuple[int, int, int, int] | None = None, remove_extremes: bool = False, bin_days: int | None = None, scale: str = "always") -> DataFrame:
    """Daily composites (acq_date, pixel_id, row, col, bands) of a folder of rasters within a range of days.

    Files outside the range are dropped by name, before they are opened.  ``bin_days`` groups days greedily instead.
    """
    found = dated(files(spark, path)).where(F.col("acq_date").isNotNull() & dates.in_days(F.col("acq_date"), start, end))
    rows = observations(found.select("path", "content"), bands, names, scale=scale)
    if window:
        rows = roi(rows, *window)
    if bin_days:
        bins = composite.greedy_bins(rows.select(F.col("acq_date").alias("day")), bin_days)
        rows = rows.join(F.broadcast(bins), F.col("acq_date") == F.col("day")).withColumn("acq_date", F.to_date("bin_date"))
    cube = composite.daily_composite(rows, names, keys=("acq_date", "row", "col"))
    if remove_extremes:
        cube = composite.drop_extremes(cube, names)
    span = cube.agg((F.max("col") + 1).alias("_w"))
    return cube.crossJoin(F.broadcast(span)).withColumn("pixel_id", F.col("row") * F.col("_w") + F.col("col")).drop("_w")


def write_cube(cube: DataFrame, path: str) -> None:
    """Parquet by day, sorted by row, so that days prune and windows skip row groups."""
    cube.repartition("acq_date").sortWithinPartitions("acq_date", "row", "col").write.mode("overwrite").partitionBy("acq_date").parquet(path)
