"""Acquisition dates from file names and configuration strings, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pixeltide import defaults as D

# Date spellings in file names, by priority.
DASHED_BAR = r"(\d{4}-\d{2}-\d{2})_"
DASHED = r"(\d{4}-\d{2}-\d{2})"
COMPACT_BAR = r"_(\d{4}\d{2}\d{2})(?:\.|_|$)"
COMPACT = r"(?<!\d)((?:19|20)\d{6})(?!\d)"


def _found(name: Column, pattern: str) -> Column:
    text = F.regexp_extract(name, pattern, 1)
    return F.when(text != "", text)


def acquisition_date(name: Column, strict: bool = True) -> Column:
    """Date in a file name.  A dashed spelling that is no date is an error (NULL if not strict), a compact one is NULL."""
    dashed = F.coalesce(_found(name, DASHED_BAR), _found(name, DASHED))
    compact = F.coalesce(_found(name, COMPACT_BAR), _found(name, COMPACT))
    parsed = F.to_date(dashed, "yyyy-MM-dd") if strict else F.try_to_date(dashed, "yyyy-MM-dd")
    return F.when(dashed.isNotNull(), parsed).otherwise(F.try_to_date(compact, "yyyyMMdd"))


def acquisition_time(name: Column, hour: int = D.DEFAULT_HOUR, minute: int = D.DEFAULT_MINUTE, strict: bool = True) -> Column:
    """The same as a timestamp without zone at the default hour."""
    day = acquisition_date(name, strict)
    text = F.concat(day.cast("string"), F.lit(f" {hour:02d}:{minute:02d}:00"))
    return text.cast("timestamp_ntz")


def parsed_iso(text: Column) -> Column:
    """ISO text, with or without a trailing Z, as a timestamp without zone."""
    return F.regexp_replace(text, "Z$", "").cast("timestamp_ntz")


def parsed_config(text: Column) -> Column:
    """A 10-character day or a full timestamp; NULL if neither."""
    return F.try_to_timestamp(F.when(F.length(text) == 10, F.concat(text, F.lit(" 00:00:00"))).otherwise(F.regexp_replace(text, "T", " "))).cast("timestamp_ntz")


def in_days(day: Column, start: str | None = None, end: str | None = None, after: str | None = None) -> Column:
    """Day-level range, both ends inclusive; ``after`` is exclusive."""
    out = F.lit(True)
    if start:
        out = out & (day >= F.lit(start).cast("date"))
    if after:
        out = out & (day > F.lit(after).cast("date"))
    if end:
        out = out & (day <= F.lit(end).cast("date"))
    return out
