"""Connected regions, cleanup and outlines of anomaly masks.

Only anomalous pixels reach a task, one frame each; labels come from a union of neighbouring runs in numpy.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixeltide import defaults as D

FOUR = ((0, 1), (1, 0))
EIGHT = (*FOUR, (1, 1), (1, -1))


def label(row: np.ndarray, col: np.ndarray, eight: bool) -> np.ndarray:
    """For each pixel the index of the first pixel (in row-major order) of its component; pixels are distinct."""
    n = len(row)
    order = np.lexsort((col, row))
    width = int(col.max()) + 3 if n else 1
    code = (row[order].astype(np.int64) * width) + col[order]
    links = []
    for dr, dc in EIGHT if eight else FOUR:
        at = np.minimum(np.searchsorted(code, code + dr * width + dc), n - 1)
        hit = (code[at] == code + dr * width + dc) & (col[order] + dc >= 0)
        links.append(np.stack([np.flatnonzero(hit), at[hit]]))
    a, b = np.concatenate(links, axis=1) if n else np.zeros((2, 0), np.int64)
    lab = np.arange(n)
    while True:  # hook to the least neighbour, then shorten chains
        before = lab.copy()
        low = np.minimum(lab[a], lab[b])
        np.minimum.at(lab, lab[a], low)
        np.minimum.at(lab, lab[b], low)
        while not np.array_equal(lab, lab[lab]):
            lab = lab[lab]
        if np.array_equal(before, lab):
            break
    out = np.empty(n, np.int64)
    out[order] = lab
    return out


def labelled(mask: DataFrame, eight: bool = False, frame: str = "frame_id") -> DataFrame:
    """(frame, row, col, region): regions numbered from 1 in row-major order of their first pixel."""
    kinds = dict(mask.dtypes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        lab = label(pdf["row"].to_numpy(), pdf["col"].to_numpy(), eight)
        return pdf.assign(region=np.unique(lab, return_inverse=True)[1].astype(np.int64) + 1)

    return mask.where("mask").select(frame, "row", "col").groupBy(frame).applyInPandas(one, f"{frame} {kinds[frame]}, row {kinds['row']}, col {kinds['col']}, region bigint")


def drop_small(mask: DataFrame, smallest: int = D.MIN_REGION, frame: str = "frame_id") -> DataFrame:
    """Anomalous pixels of 8-connected components of at least ``smallest`` pixels."""
    lab = labelled(mask, True, frame)
    big = lab.groupBy(frame, "region").count().where(F.col("count") >= smallest).select(frame, "region")
    return lab.join(big, [frame, "region"]).select(frame, "row", "col", F.lit(True).alias("mask"))


def closed(mask: DataFrame, height: int, width: int, frame: str = "frame_id") -> DataFrame:
    """Closing with a 3x3 cross on the mask padded by its edge, as joins of shifted pixels: rows of the result's pixels.

    Dilation unites the five shifts; a pixel survives erosion if all five neighbours of the padded grid are in.
    """
    live = mask.where("mask").select(frame, "row", "col").distinct()
    ring = F.array(*[F.struct(r.cast("int").alias("row"), c.cast("int").alias("col")) for r, c in (
        (F.col("row"), F.col("col")),
        (F.when(F.col("row") == 0, -1), F.col("col")), (F.when(F.col("row") == height - 1, height), F.col("col")),
        (F.col("row"), F.when(F.col("col") == 0, -1)), (F.col("row"), F.when(F.col("col") == width - 1, width)),
        *[(F.when(F.col("row") == r, rr), F.when(F.col("col") == c, cc)) for r, rr in ((0, -1), (height - 1, height)) for c, cc in ((0, -1), (width - 1, width))],
    )])
    cross = lambda row, col: F.explode(F.array(*[F.struct((row + dr).alias("row"), (col + dc).alias("col")) for dr, dc in ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0))])).alias("p")
    padded = live.select(frame, F.explode(ring).alias("p")).select(frame, "p.row", "p.col").where("row IS NOT NULL AND col IS NOT NULL").distinct()
    grown = padded.select(frame, cross(F.col("row"), F.col("col"))).select(frame, "p.row", "p.col").distinct().where(F.col("row").between(-1, height) & F.col("col").between(-1, width))
    votes = grown.select(frame, cross(F.col("row"), F.col("col"))).select(frame, "p.row", "p.col").where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))
    return votes.groupBy(frame, "row", "col").count().where("count = 5").select(frame, "row", "col", F.lit(True).alias("mask"))


def cleaned(mask: DataFrame, height: int, width: int, smallest: int = D.MIN_REGION, frame: str = "frame_id") -> DataFrame:
    return closed(drop_small(mask, smallest, frame), height, width, frame)


def region_table(mask: DataFrame, transform: tuple[float, ...] = (1, 0, 0, 0, 1, 0), pixel_size_m: float = D.PIXEL_SIZE_M, frame: str = "frame_id") -> DataFrame:
    """4-connected regions: pixels, areas, centroid and bounds in map units of the affine transform (a, b, c, d, e, f)."""
    a, b, c, d, e, f = map(float, transform)
    lab = labelled(mask, False, frame)
    by = lab.groupBy(frame, "region").agg(F.count("*").alias("n_pixels"), F.avg(F.col("col") + 0.5).alias("x"), F.avg(F.col("row") + 0.5).alias("y"), *[g(k).cast("double").alias(f"{n}_{k}") for k in ("row", "col") for n, g in (("min", F.min), ("max", F.max))])
    xs = [F.lit(a) * x + F.lit(b) * y + c for x in (F.col("min_col"), F.col("max_col") + 1) for y in (F.col("min_row"), F.col("max_row") + 1)]
    ys = [F.lit(d) * x + F.lit(e) * y + f for x in (F.col("min_col"), F.col("max_col") + 1) for y in (F.col("min_row"), F.col("max_row") + 1)]
    return by.select(
        frame, F.col("region").alias("region_id"), "n_pixels", (F.col("n_pixels") * pixel_size_m**2).alias("area_m2"), (F.col("n_pixels") * abs(a * e - b * d)).alias("area_crs_units"),
        F.array(F.lit(a) * F.col("x") + F.lit(b) * F.col("y") + c, F.lit(d) * F.col("x") + F.lit(e) * F.col("y") + f).alias("centroid"),
        F.array(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)).alias("bounds"),
    )


def outline(row: np.ndarray, col: np.ndarray) -> list[list[tuple[int, int]]]:
    """Rings of cell corners around a set of pixels, the region on the left of each step; touching corners turn inward."""
    cells = set(zip(row.tolist(), col.tolist(), strict=True))
    edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r, c in cells:
        for beside, p, q in (((r - 1, c), (c + 1, r), (c, r)), ((r + 1, c), (c, r + 1), (c + 1, r + 1)), ((r, c - 1), (c, r), (c, r + 1)), ((r, c + 1), (c + 1, r + 1), (c + 1, r))):
            if beside not in cells:
                edges.setdefault(p, []).append(q)
    rings = []
    while edges:
        first = min(edges)
        ring, at, came = [first], first, None
        while True:
            choices = edges[at]
            turn = lambda q: (q[0] - at[0]) * (came[1]) - (q[1] - at[1]) * came[0] if came else 0  # noqa: B023, E731
            nxt = max(choices, key=turn) if len(choices) > 1 else choices[0]
            choices.remove(nxt)
            if not choices:
                del edges[at]
            came, at = (nxt[0] - at[0], nxt[1] - at[1]), nxt
            ring.append(at)
            if at == first:
                break
        rings.append([p for i, p in enumerate(ring) if i in (0, len(ring) - 1) or (ring[i + 1][0] - p[0]) * (p[1] - ring[i - 1][1]) != (p[0] - ring[i - 1][0]) * (ring[i + 1][1] - p[1])])
    return rings


def region_outlines(mask: DataFrame, transform: tuple[float, ...] = (1, 0, 0, 0, 1, 0), frame: str = "frame_id") -> DataFrame:
    """(frame, region_id, geometry): GeoJSON polygons of the 4-connected regions."""
    a, b, c, d, e, f = map(float, transform)
    kind = dict(mask.dtypes)[frame]

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        rings = sorted(outline(pdf["row"].to_numpy(), pdf["col"].to_numpy()), key=lambda r: -abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(r, r[1:], strict=False))))
        shape = {"type": "Polygon", "coordinates": [[[a * x + b * y + c, d * x + e * y + f] for x, y in r] for r in rings]}
        return pd.DataFrame({frame: [key[0]], "region_id": [key[1]], "geometry": [json.dumps(shape)]})

    return labelled(mask, False, frame).groupBy(frame, "region").applyInPandas(one, f"{frame} {kind}, region_id bigint, geometry string")
