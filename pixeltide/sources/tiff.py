"""A reader of plain GeoTIFF files in numpy: strips or tiles, chunky or planar, uncompressed or deflate with or without
horizontal prediction.  Other encodings are an error that names what is missing."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

# Tag numbers and type sizes of the TIFF and GeoTIFF specifications.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_AT, SAMPLES, ROWS_PER_STRIP, STRIP_SIZE, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_SIZE, SAMPLE_FORMAT = 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, MODEL_TRANSFORM, GEO_KEYS, DESCRIPTION = 33550, 33922, 34264, 34735, 270
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}


@dataclass
class Raster:
    values: np.ndarray  # height x width x bands
    transform: tuple[float, ...]
    crs: str | None
    band_names: list[str] | None


def _tags(data: bytes) -> tuple[str, dict[int, list]]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a classic TIFF file")
    at = struct.unpack(order + "I", data[4:8])[0]
    out = {}
    for k in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        entry = data[at + 2 + 12 * k : at + 14 + 12 * k]
        tag, kind, count = struct.unpack(order + "HHI", entry[:8])
        code = TYPES.get(kind)
        if code is None:
            continue
        size = struct.calcsize("<" + code) * count
        raw = entry[8 : 8 + size] if size <= 4 else data[(o := struct.unpack(order + "I", entry[8:])[0]) : o + size]
        out[tag] = [raw.split(b"\0")[0].decode("utf-8", "replace")] if code == "s" else list(struct.unpack(order + code * count, raw))
    return order, out


def read(data: bytes) -> Raster:
    order, tags = _tags(data)
    one = lambda tag, default: tags.get(tag, [default])[0]
    width, height, bands = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
    bits, form, how, planar, predictor = tags.get(BITS, [8]), one(SAMPLE_FORMAT, 1), one(COMPRESSION, 1), one(PLANAR, 1), one(PREDICTOR, 1)
    if len(set(bits)) > 1 or how not in (1, 8, 32946) or predictor not in (1, 2):
        raise ValueError(f"unsupported TIFF: bits {bits}, compression {how}, predictor {predictor}")
    kind = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[form] }{bits[0] // 8}")
    tiled = TILE_AT in tags
    th, tw = (one(TILE_HEIGHT, 0), one(TILE_WIDTH, 0)) if tiled else (min(one(ROWS_PER_STRIP, height), height), width)
    offsets, sizes = tags[TILE_AT if tiled else STRIP_AT], tags[TILE_SIZE if tiled else STRIP_SIZE]
    across, down = -(-width // tw), -(-height // th)
    out = np.zeros((height, width, bands), kind.newbyteorder("="))
    deep = bands if planar == 1 else 1
    for k, (at, size) in enumerate(zip(offsets, sizes, strict=True)):
        raw = data[at : at + size]
        raw = zlib.decompress(raw) if how != 1 else raw
        plane, place = divmod(k, across * down)
        top, left = place // across * th, place % across * tw
        rows = th if tiled else min(th, height - top)
        block = np.frombuffer(raw, kind, rows * tw * deep).reshape(rows, tw, deep)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=kind)
        h, w = min(rows, height - top), min(tw, width - left)
        band = slice(0, bands) if planar == 1 else slice(plane, plane + 1)
        out[top : top + h, left : left + w, band] = block[:h, :w]
    if MODEL_TRANSFORM in tags:
        m = tags[MODEL_TRANSFORM]
        transform = (m[0], m[1], m[3], m[4], m[5], m[7])
    elif PIXEL_SCALE in tags and TIE_POINT in tags:
        sx, sy = tags[PIXEL_SCALE][:2]
        i, j, _, x, y = tags[TIE_POINT][:5]
        transform = (sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)
    else:
        transform = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
    keys = tags.get(GEO_KEYS, [])
    codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    epsg = codes.get(3072) or codes.get(2048)
    return Raster(out, tuple(map(float, transform)), f"EPSG:{epsg}" if epsg else None, None)


def write(values: np.ndarray, transform: tuple[float, ...] = (1, 0, 0, 0, -1, 0), epsg: int = 4326, deflate: bool = True) -> bytes:
    """A small little-endian GeoTIFF (chunky, one strip), for fixtures and single-band sinks."""
    h, w, bands = values.shape
    kind = values.dtype.newbyteorder("<")
    body = values.astype(kind).tobytes()
    body = zlib.compress(body) if deflate else body
    a, _, c, _, e, f = map(float, transform)
    geo = [1, 1, 0, 1, 2048, 0, 1, epsg]
    entries = [
        (WIDTH, "I", [w]), (HEIGHT, "I", [h]), (BITS, "H", [kind.itemsize * 8] * bands), (COMPRESSION, "H", [8 if deflate else 1]), (262, "H", [1]), (STRIP_AT, "I", [8]), (SAMPLES, "H", [bands]),
        (ROWS_PER_STRIP, "I", [h]), (STRIP_SIZE, "I", [len(body)]), (PLANAR, "H", [1]), (SAMPLE_FORMAT, "H", [{"u": 1, "i": 2, "f": 3}[kind.kind]] * bands),
        (PIXEL_SCALE, "d", [a, -e, 0.0]), (TIE_POINT, "d", [0.0, 0.0, 0.0, c, f, 0.0]), (GEO_KEYS, "H", geo),
    ]
    number = {v: k for k, v in TYPES.items() if k != 5}
    start = 8 + len(body)
    extra_at, extra, table = start + 2 + 12 * len(entries) + 4, b"", b""
    for tag, code, items in entries:
        raw = struct.pack("<" + code * len(items), *items)
        table += struct.pack("<HHI", tag, number[code], len(items))
        if len(raw) <= 4:
            table += raw.ljust(4, b"\0")
        else:
            table += struct.pack("<I", extra_at + len(extra))
            extra += raw
    return b"II*\0" + struct.pack("<I", start) + body + struct.pack("<H", len(entries)) + table + b"\0\0\0\0" + extra
