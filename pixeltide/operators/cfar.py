"""Multi-scale ring background (CFAR) of a response map.

A ring is the difference of two discs, a disc a stack of horizontal runs, and the sum over a run a difference of two
row prefix sums: 120 look-ups instead of 2112 cells.  Frames are cut into bands of rows with a halo of the largest
radius, so that a task holds ``tile_rows`` rows, not a frame.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixeltide import defaults as D


def radii(scales=D.CFAR_SCALES) -> list[tuple[int, int]]:
    return [(outer // 2, inner // 2) for outer, inner in scales]


def disc_sum(grid: np.ndarray, radius: int, fill: float) -> np.ndarray:
    """Sum over the disc x^2 + y^2 <= radius^2 around every cell; ``fill`` stands outside the grid."""
    h, w = grid.shape
    padded = np.pad(grid, radius, constant_values=fill)
    run = np.concatenate([np.zeros((h + 2 * radius, 1)), np.cumsum(padded, axis=1)], axis=1)
    out = np.zeros((h, w))
    for dy in range(-radius, radius + 1):
        half = int(np.sqrt(radius * radius - dy * dy))
        rows = run[radius + dy : radius + dy + h]
        left = radius - half
        out += rows[:, radius + half + 1 : radius + half + 1 + w] - rows[:, left : left + w]
    return out


def ring_contrast(grid: np.ndarray, fill: float, scales=D.CFAR_SCALES) -> np.ndarray:
    """max(0, max over scales of value - ring mean)."""
    best = np.zeros_like(grid)
    for outer, inner in radii(scales):
        count = disc_sum(np.ones((1, 1)), outer, 1.0)[0, 0] - disc_sum(np.ones((1, 1)), inner, 1.0)[0, 0]
        best = np.maximum(best, grid - (disc_sum(grid, outer, fill) - disc_sum(grid, inner, fill)) / count)
    return best


def cfar(scored: DataFrame, height: int, width: int, scales=D.CFAR_SCALES, frame: str = "frame_id", value: str = "d2", tile_rows: int = 512) -> DataFrame:
    """(frame, row, col, cfar) of every valid pixel; invalid, missing and outside cells count as the frame's median."""
    halo = max(r for r, _ in radii(scales))
    live = scored.where("valid").select(frame, "row", "col", F.col(value).cast("double").alias("v"))
    fills = live.groupBy(frame).agg(F.median("v").alias("fill"))
    first, last = F.floor((F.col("row") - halo) / tile_rows), F.floor((F.col("row") + halo) / tile_rows)
    tiles = live.join(fills, frame).withColumn("tile", F.explode(F.sequence(F.greatest(first, F.lit(0)).cast("int"), F.least(last, F.lit((height - 1) // tile_rows)).cast("int"))))

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        top = int(key[1]) * tile_rows
        low, high = max(0, top - halo), min(height, top + tile_rows + halo)
        fill = float(pdf["fill"].iloc[0])
        grid = np.full((high - low, width), fill)
        grid[pdf["row"] - low, pdf["col"]] = pdf["v"]
        made = ring_contrast(grid, fill, scales)
        own = pdf[(pdf["row"] >= top) & (pdf["row"] < top + tile_rows)]
        return pd.DataFrame({frame: own[frame], "row": own["row"], "col": own["col"], "cfar": made[own["row"] - low, own["col"]]})

    kinds = dict(scored.dtypes)
    return tiles.groupBy(frame, "tile").applyInPandas(one, f"{frame} {kinds[frame]}, row {kinds['row']}, col {kinds['col']}, cfar double")
