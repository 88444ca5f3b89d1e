"""Scenes as they arrive: a file stream whose micro-batches run the batch plan."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixeltide.plans.shared import folder


def _folder(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def each_arrival(source: DataFrame, detect: Callable[[DataFrame], DataFrame], out_path: str, checkpoint: str, strict: bool = False) -> None:
    """Run ``detect`` on everything that has arrived and append its rows; a batch that fails is recorded and skipped
    unless ``strict``.  Batches are written under their number, so a repeated one replaces itself."""

    def one(batch: DataFrame, number: int) -> None:
        try:
            detect(batch).write.mode("overwrite").parquet(f"{out_path}/results/batch={number}")
        except Exception as error:
            if strict:
                raise
            batch.sparkSession.createDataFrame([(number, str(error)[:500])], "number bigint, error string").write.mode("overwrite").parquet(f"{out_path}/errors/batch={number}")

    stream = source.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()


def daily_totals(spark: SparkSession, sf_dir: str, delay: str = "40 days") -> DataFrame:
    """Event counts and sums per type and day through a watermarked stateful stream over the event files.

    Days older than the newest event by more than ``delay`` leave the state; every change of a day is written with its
    batch's number, and the newest row of a day counts.
    """
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    events = stream.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").withWatermark("ts", delay)
    by = events.groupBy("event_type", F.window("ts", "1 day").alias("span")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    out, checkpoint = _folder(spark, "daily-totals"), _folder(spark, "stream-state")

    def changed(batch: DataFrame, number: int) -> None:
        batch.select("event_type", F.to_date("span.start").alias("day"), "n", "total").write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = by.writeStream.outputMode("update").foreachBatch(changed).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    newest = F.max_by(F.struct("n", "total"), "batch")
    return spark.read.parquet(out).groupBy("event_type", "day").agg(newest.alias("x")).select("event_type", "day", "x.n", "x.total")
