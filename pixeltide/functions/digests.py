"""Content digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def binary_digest(content: Column) -> Column:
    return F.sha2(content, 256)


def text_digest(text: Column) -> Column:
    """SHA-256 with CRLF line ends read as LF."""
    return F.sha2(F.replace(text, F.lit("\r\n"), F.lit("\n")), 256)


def mask_digest(height: Column, width: Column, ordered_bits: Column) -> Column:
    """Digest of shape and row-major mask (an array of 0 and 1)."""
    return F.sha2(F.concat_ws("|", height.cast("string"), width.cast("string"), F.lit("uint8"), F.array_join(F.transform(ordered_bits, lambda b: b.cast("string")), "")), 256)
