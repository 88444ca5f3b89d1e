"""Binary model containers: a JSON header, a compressed block of weights, and residual cubes in files of their own.

Layout: u32 header length, header, u32 block length, block (zstd, or zlib where zstd is missing).  Decoders run per file
in Arrow; a residual cube comes out as rows of frames and pixels in bounded pieces.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

try:
    import zstandard
except ImportError:
    zstandard = None

# Names in the header, and number kinds with their largest code or factor.
QUANTIZATION, RESIDUALS, PROFILE, META = "quantization_info", "residual_info", "empirical_null_profile", "dataset_meta"
WEIGHT_KINDS = {"float32": None, "float16": None, "int16": 32767, "int8": 127}
RESIDUAL_KINDS = {"float32": 1.0, "float16": 1.0, "int16": 10000.0, "int8": 100.0}
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"


def compressed(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(raw) if zstandard else zlib.compress(raw, 6)


def decompressed(block: bytes) -> bytes:
    if block[:4] == ZSTD_MAGIC:
        if zstandard is None:
            raise ValueError("the block is zstd, which is not installed")
        return zstandard.ZstdDecompressor().decompressobj().decompress(block)
    return zlib.decompress(block)


def _joined(header: Mapping, block: bytes) -> bytes:
    text = json.dumps(header, default=str).encode()
    return struct.pack("<I", len(text)) + text + struct.pack("<I", len(block)) + block


def split(data: bytes) -> tuple[dict, bytes]:
    """Header and block of a container; a file that ends early is an error."""
    if len(data) < 4:
        raise ValueError("container too short for its header length")
    (n,) = struct.unpack_from("<I", data)
    if len(data) < 8 + n:
        raise ValueError("container too short for its header")
    (m,) = struct.unpack_from("<I", data, 4 + n)
    if len(data) < 8 + n + m:
        raise ValueError("container too short for its block")
    return json.loads(data[4 : 4 + n]), data[8 + n : 8 + n + m]


def weights_file(weights: np.ndarray, meta: Mapping, kind: str = "int16", profile: Mapping | None = None) -> bytes:
    """Weights at the given precision; whole-number kinds spread the largest weight over their range."""
    top, scale = WEIGHT_KINDS[kind], 1.0
    codes = np.asarray(weights, np.float32)
    if top:
        scale = float(top / (np.abs(codes).max(initial=0) + 1e-9))
        codes = np.clip(np.round(codes * scale), -top, top - 1)
    header = {"file_type": "weights_only", QUANTIZATION: {"mode": kind, "scale": scale, "is_int": bool(top)}, META: dict(meta)}
    if profile is not None:
        header[PROFILE] = dict(profile)
    return _joined(header, compressed(codes.astype(kind).tobytes()))


def weights_of(data: bytes, expected: int | None = None) -> np.ndarray:
    header, block = split(data)
    info = header.get(QUANTIZATION, {})
    values = np.frombuffer(decompressed(block), info.get("mode", "int16")).astype(np.float32)
    if expected is not None and len(values) != expected:
        raise ValueError(f"{len(values)} weights, expected {expected}")
    return values / np.float32(info.get("scale", 1.0)) if info.get("is_int", True) else values


def residual_file(residuals: np.ndarray, meta: Mapping, kind: str = "int16") -> bytes:
    """A cube (frame, row, col, band) of observation minus prediction; rounding is half-even."""
    factor, codes = RESIDUAL_KINDS[kind], np.asarray(residuals, np.float64)
    if kind.startswith("int"):
        limits = np.iinfo(kind)
        codes = np.clip(np.round(codes * factor), limits.min, limits.max)
    header = {"file_type": "residual_only", "has_residuals": True, RESIDUALS: {"dtype": kind, "scale": factor}, META: dict(meta) | {"shape": list(residuals.shape)}}
    return _joined(header, compressed(codes.astype(kind).tobytes()))


def with_profile(data: bytes, profile: Mapping) -> bytes:
    """The same container with another profile in its header; the block stays byte for byte."""
    header, block = split(data)
    return _joined(header | {PROFILE: dict(profile)}, block)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _read_weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            data = content.as_py()
            header, _ = split(data)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([json.dumps(header)]), pa.array([weights_of(data)], pa.list_(pa.float32()))], names=["path", "header", "weights"])


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """path, header, weights: one row per container."""
    return _files(spark, path).mapInArrow(_read_weights, "path string, header string, weights array<float>")


def _read_residuals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            header, block = split(content.as_py())
            info = header.get(RESIDUALS, {"dtype": "int16", "scale": 10000.0})
            t, h, w, c = header[META]["shape"]
            cube = np.frombuffer(decompressed(block), info["dtype"]).reshape(t, h * w, c)
            for frame in range(t):
                values = pa.array((cube[frame].astype(np.float32) / np.float32(info["scale"])).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (h * w + 1) * c, c, dtype=np.int32)), values)
                n = h * w
                yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(np.full(n, frame, np.int32)), pa.array(np.arange(n, dtype=np.int32)), lists], names=["path", "frame_id", "pixel_id", "residual"])


def read_residuals(spark: SparkSession, path: str) -> DataFrame:
    """path, frame_id, pixel_id, residual: a row per frame and pixel."""
    return _files(spark, path).mapInArrow(_read_residuals, "path string, frame_id int, pixel_id int, residual array<float>")
