"""Small calculations made before a run: temporal capacity of a multi-level grid and table sizes for it."""

from __future__ import annotations

import math
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Largest table exponent by gigabytes of accelerator memory.
LARGEST_TABLE = ((24, 22), (12, 20), (8, 19), (0, 18))
SMALLEST_SPATIAL, SMALLEST_TEMPORAL = 17, 16


def capacity_end(start: str, base: int, levels: int, scale: float, days_per_cell: float = 1.0) -> str:
    """Last day that the finest level of a grid reaches."""
    cells = int(base * scale ** (levels - 1))
    return (date.fromisoformat(start) + timedelta(days=cells * days_per_cell)).isoformat()


def grid_advice(width: int, height: int, frames: int, base: int = 32, levels: int = 16, memory_gb: int = 24, spatial: int | None = None, temporal: int | None = None) -> dict:
    """Scale between levels and log2 table sizes for a raster stack."""
    if spatial is None:
        wanted = max(SMALLEST_SPATIAL, math.ceil(math.log2(width * height)) + 2)
        spatial = min(wanted, next(size for least, size in LARGEST_TABLE if memory_gb >= least))
    if temporal is None:
        temporal = max(SMALLEST_TEMPORAL, math.ceil(math.log2(width * frames)))
    per_level = (1.5 * max(width, height) / base) ** (1 / (levels - 1))
    return {"levels": levels, "base_resolution": base, "per_level_scale": round(per_level, 4), "spatial_log2": spatial, "temporal_log2": temporal, "hidden": 64 if spatial < 20 else 128}


def packed_bit(packed: Column, place: Column) -> Column:
    """Bit ``place`` (0: the highest bit of the first byte) of a base64 text."""
    byte = F.conv(F.hex(F.substring(F.unbase64(packed), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    weight = F.element_at(F.array(*[F.lit(1 << (7 - i)) for i in range(8)]), (place % 8 + 1).cast("int"))
    return byte.bitwiseAND(weight) > 0
