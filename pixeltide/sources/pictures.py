"""Raster sinks: one GeoTIFF per frame as a binary column, from pixel rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from pixeltide import defaults as D
from pixeltide.sources.tiff import write

# Colours of the overlay from low to high scores.
RAMP = ((0, 0, 4), (87, 16, 110), (188, 55, 84), (249, 142, 9), (252, 255, 164))


def single_band(rows: DataFrame, value: str, height: int, width: int, transform: tuple[float, ...] = (1, 0, 0, 0, -1, 0), epsg: int = 4326, frame: str = "acq_date") -> DataFrame:
    """(frame, tiff): a float32 raster of one column; cells without a row are NaN."""
    kind = dict(rows.dtypes)[frame]

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.full((height, width, 1), np.nan, np.float32)
        grid[pdf["row"], pdf["col"], 0] = pdf[value].astype(float)
        return pd.DataFrame({frame: [key[0]], "tiff": [write(grid, transform, epsg)]})

    return rows.select(frame, "row", "col", value).groupBy(frame).applyInPandas(one, f"{frame} {kind}, tiff binary")


def overlay(rows: DataFrame, rgb: list[str], height: int, width: int, transform: tuple[float, ...] = (1, 0, 0, 0, -1, 0), epsg: int = 4326, frame: str = "acq_date", alpha: float = 0.9) -> DataFrame:
    """(frame, tiff): three stretched bands (2 to 98 percent of positive values) with anomalies coloured by score 1 to 3."""
    kind = dict(rows.dtypes)[frame]
    low, high = D.DISPLAY_RANGE

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        picture = np.zeros((height, width, 3))
        for i, b in enumerate(rgb):
            x = pdf[b].to_numpy(float)
            some = x[x > 0]
            if len(some):
                a, z = np.percentile(some, (2, 98))
                picture[pdf["row"], pdf["col"], i] = np.nan_to_num(np.clip((x - a) / (z - a + 1e-9), 0, 1)) * 255
        hit = pdf[pdf["mask"]]
        share = np.clip((hit["score"].to_numpy(float) - low) / (high - low), 0, 1) * (len(RAMP) - 1)
        colour = np.stack([np.interp(share, range(len(RAMP)), [c[i] for c in RAMP]) for i in range(3)], -1)
        picture[hit["row"], hit["col"]] = (1 - alpha) * picture[hit["row"], hit["col"]] + alpha * colour
        return pd.DataFrame({frame: [key[0]], "tiff": [write(picture.astype(np.uint8), transform, epsg)]})

    return rows.select(frame, "row", "col", "mask", "score", *rgb).groupBy(frame).applyInPandas(one, f"{frame} {kind}, tiff binary")
