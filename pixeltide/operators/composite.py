"""Daily composites, day grouping, greedy temporal bins and value screening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixeltide import defaults as D
from pixeltide.functions import masks


def daily_composite(raw: DataFrame, bands: list[str], keys: tuple[str, ...] = ("pixel_id", "acq_date"), low: float = D.VALID_RANGE[0], high: float = D.VALID_RANGE[1], threshold: float = D.VALID_THRESHOLD) -> DataFrame:
    """Per pixel, day and band the median of the values in range; one shuffle by pixel and day."""
    return raw.groupBy(*keys).agg(*[F.median(masks.range_mask(F.col(b), low, high, threshold)).alias(b) for b in bands])


def with_validity(cube: DataFrame, bands: list[str]) -> DataFrame:
    return cube.withColumn("valid", masks.valid_observation([F.col(b) for b in bands]))


def group_by_day(paths: DataFrame, path: str = "path", acquired: str = "acq_ts") -> DataFrame:
    """One row per day: representative time (of the first path), the paths in order; undated rows drop out."""
    dated = paths.where(F.col(acquired).isNotNull())
    by = dated.groupBy(F.to_date(acquired).alias("acq_date"))
    return by.agg(F.min_by(acquired, path).alias("acq_ts"), F.sort_array(F.collect_list(path)).alias("paths"))


def greedy_bins(days: DataFrame, width_days: int, day: str = "day") -> DataFrame:
    """Bins that open at the first day not covered: (day, bin_start, bin_date).

    A closed bin is dated at its middle (start + width/2, in seconds), the last one at its start.  The fold runs over
    distinct days - calendar size, whatever the table holds - and is joined back by day.
    """
    ordered = days.select(F.col(day).cast("date").alias("d")).distinct().agg(F.sort_array(F.collect_list("d")).alias("ds"))
    start = F.struct(F.lit(None).cast("date").alias("open"), F.array().cast("array<struct<d:date,s:date>>").alias("out"))

    def step(acc: Column, d: Column) -> Column:
        opened = F.when(acc["open"].isNull() | (d >= F.date_add(acc["open"], width_days)), d).otherwise(acc["open"])
        return F.struct(opened.alias("open"), F.concat(acc["out"], F.array(F.struct(d.alias("d"), opened.alias("s")))).alias("out"))

    folded = ordered.select(F.aggregate("ds", start, step).alias("f"))
    exploded = folded.select(F.col("f.open").alias("last"), F.explode("f.out").alias("x"))
    middle = F.timestamp_seconds(F.unix_date("x.s") * 86400 + F.lit(int(width_days * 43200)))
    dated = F.when(F.col("x.s") == F.col("last"), F.timestamp_seconds(F.unix_date("x.s") * 86400)).otherwise(middle)
    return exploded.select(F.col("x.d").alias("day"), F.col("x.s").alias("bin_start"), dated.cast("timestamp_ntz").alias("bin_date"))


def drop_extremes(cube: DataFrame, bands: list[str], q: float = 0.999, frames: list | None = None) -> DataFrame:
    """Values above the pooled quantile (over all frames, or those given) become NULL."""
    pool = cube if frames is None else cube.where(F.col("acq_date").isin(frames))
    values = pool.select(F.explode(F.array(*[F.col(b) for b in bands])).alias("x"))
    limit = values.agg(F.percentile("x", F.lit(q)).alias("extreme_limit"))
    joined = cube.crossJoin(F.broadcast(limit))
    return joined.withColumns({b: F.when(F.col(b) <= F.col("extreme_limit"), F.col(b)) for b in bands}).drop("extreme_limit")


def percentile_stretch(cube: DataFrame, bands: list[str], low: float = 0.02, high: float = 0.98, by: str | None = None, pooled: bool = False) -> DataFrame:
    """Bands stretched to 0..255 between two percentiles of their positive values, per band or pooled over them."""
    keys = [by] if by else []
    positive = {b: F.when(F.col(b) > 0, F.col(b)) for b in bands}
    if pooled:
        flat = cube.select(*keys, F.explode(F.array(*positive.values())).alias("x"))
        limits = flat.groupBy(*keys).agg(F.percentile("x", F.array(F.lit(low), F.lit(high))).alias("limit"))
        names = dict.fromkeys(bands, "limit")
    else:
        limits = cube.groupBy(*keys).agg(*[F.percentile(positive[b], F.array(F.lit(low), F.lit(high))).alias(f"limit_{b}") for b in bands])
        names = {b: f"limit_{b}" for b in bands}
    joined = cube.join(limits, by) if by else cube.crossJoin(F.broadcast(limits))

    def stretched(b: str) -> Column:
        lo, hi = F.element_at(names[b], 1), F.element_at(names[b], 2)
        share = F.when(hi > lo, (F.col(b) - lo) / F.when(hi > lo, hi - lo)).otherwise(F.lit(0.0))
        return F.when(F.col(b).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * 255)

    return joined.withColumns({f"{b}_display": stretched(b) for b in bands}).drop(*set(names.values()))


def aligned_or_fail(scenes: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Scenes of a day must share shape, transform (within tolerance) and CRS; raises otherwise."""
    spread = F.aggregate(F.sequence(F.lit(0), F.lit(5)), F.lit(0.0), lambda acc, i: F.greatest(acc, F.element_at(F.col("spreads"), i + 1)))
    by = scenes.groupBy("acq_date").agg(
        F.count_distinct(F.struct("height", "width", "crs")).alias("shapes"),
        F.array(*[F.max(F.element_at("transform", i)) - F.min(F.element_at("transform", i)) for i in range(1, 7)]).alias("spreads"),
    )
    bad = (F.col("shapes") != 1) | (spread > tolerance)
    checked = by.select("acq_date", F.when(bad, F.raise_error(F.concat(F.lit("same-day scenes are not aligned: "), F.col("acq_date").cast("string"))).cast("boolean")).otherwise(F.lit(True)).alias("aligned"))
    return scenes.join(checked, "acq_date").where("aligned").drop("aligned")


def dataset_stats(paths_by_day: DataFrame) -> DataFrame:
    n = F.size("paths")
    return paths_by_day.agg(F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("source_file_count"), F.count("*").alias("day_count"), F.count_if(n > 1).alias("same_day_composite_count"))


def dense(cube: DataFrame, bands: list[str]) -> DataFrame:
    """Every pixel at every frame, numbered by date; cells without a row have NULL bands.

    The list of dates is one small row (its length is the number of acquisitions), exploded per pixel; the cells come
    from one join on (pixel, date), whose partitioning by pixel the windows that follow reuse if they ask for it.
    """
    dates = cube.select("acq_date").distinct().agg(F.sort_array(F.collect_list("acq_date")).alias("dates"))
    grid = cube.select("pixel_id").distinct().crossJoin(F.broadcast(dates)).select("pixel_id", F.posexplode("dates").alias("frame_id", "acq_date"))
    return grid.join(cube.select("pixel_id", "acq_date", *bands), ["pixel_id", "acq_date"], "left")
