"""The supplier-month cube: line items read as dated four-band observations of supplier pixels.

pixel_id = l_suppkey, row = pixel div 10, col = pixel mod 10, frame = month of shipping; bands are scaled measures,
masked to (0, 1], the median of a month is its composite.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixeltide.operators import composite as C

BANDS = ["b1", "b2", "b3", "b4"]
WIDTH = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan of five columns; the projection is all that reaches the shuffle."""
    items = table(spark, sf_dir, "lineitem")
    return items.select(
        F.col("l_suppkey").alias("pixel_id"), F.trunc(F.col("l_shipdate").cast("date"), "MM").alias("acq_date"),
        (F.col("l_quantity") / 50.0).alias("b1"), (F.col("l_extendedprice") / 105000.0).alias("b2"), (F.col("l_discount") * 9.0).alias("b3"), (F.col("l_tax") * 10.0).alias("b4"),
    )


def with_grid(df: DataFrame) -> DataFrame:
    return df.withColumn("row", F.expr(f"pixel_id div {WIDTH}").cast("int")).withColumn("col", (F.col("pixel_id") % WIDTH).cast("int"))


def cube(spark: SparkSession, sf_dir: str, settle: bool = False) -> DataFrame:
    """``settle``: written once, for plans that read it more than once."""
    from pixeltide.plans.shared import settled

    made = C.with_validity(C.daily_composite(raw(spark, sf_dir), BANDS), BANDS)
    return settled(made, "cube") if settle else made


def dense_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.with_validity(C.dense(cube(spark, sf_dir, settle=True), BANDS), BANDS)


def moments(observed: DataFrame) -> DataFrame:
    """Per pixel the mean and population deviation of every band over valid cells: a flat baseline."""
    own = observed.where("valid").groupBy("pixel_id").agg(*[F.avg(b).alias(f"{b}_mean") for b in BANDS], *[F.stddev_pop(b).alias(f"{b}_std") for b in BANDS])
    return own


def scored(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    from pixeltide.operators.baseline import score

    seen = dense_cube(spark, sf_dir) if dense else cube(spark, sf_dir, settle=True)
    return with_grid(score(seen.drop("valid").join(moments(seen), "pixel_id", "left"), BANDS))


def height(spark: SparkSession, sf_dir: str) -> int:
    """Rows of the grid, from the pixel column alone."""
    return int(table(spark, sf_dir, "lineitem").agg(F.max("l_suppkey")).first()[0]) // WIDTH + 1


def with_cfar(spark: SparkSession, scores: DataFrame, rows: int, scales=None) -> DataFrame:
    from pixeltide.operators.cfar import cfar
    from pixeltide.plans.shared import settled

    scores = settled(scores, "responses")
    made = cfar(scores, rows, WIDTH, **({"scales": scales} if scales else {}), frame="acq_date")
    return scores.join(made, ["acq_date", "row", "col"], "left")
