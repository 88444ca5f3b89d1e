"""Metrics against labels, labels on a grid, coverage joins and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion_metrics(rows: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """tn, fp, fn, tp and the rates, each denominator at least 1."""
    t, p = truth.cast("boolean"), predicted.cast("boolean")
    counts = rows.agg(F.count("*").alias("n"), F.count_if(~t & ~p).alias("tn"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(t & p).alias("tp"))

    def part(a: Column, b: Column) -> Column:
        return a.cast("double") / F.greatest(b, F.lit(1))

    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    step = counts.withColumns({"accuracy": part(tn + tp, F.col("n")), "recall": part(tp, tp + fn), "precision": part(tp, tp + fp), "false_alarm": part(fp, fp + tn), "specificity": part(tn, fp + tn)})
    return step.withColumn("f1", part(2 * tp, 2 * tp + fp + fn))


def pooled_rmse(rows: DataFrame, residuals: list[Column], by: list[str] | None = None) -> DataFrame:
    """Root of the mean squared residual over all present values of all bands."""
    values = rows.select(*(by or []), F.explode(F.array(*residuals)).alias("r")).where("r IS NOT NULL")
    return values.groupBy(*(by or [])).agg(F.sqrt(F.avg(F.col("r") * F.col("r"))).alias("rmse"), F.count("*").alias("n"))


def labels_on_grid(points: DataFrame, transform: tuple[float, ...], height: int, width: int, x: str = "x", y: str = "y") -> DataFrame:
    """Adds row and col of the cell of an unrotated affine grid (a, 0, c, 0, e, f); points outside drop out."""
    a, b, c, d, e, f = map(float, transform)
    if b or d:
        raise ValueError("rotated grids are not supported")
    placed = points.withColumn("row", F.floor((F.col(y) - f) / e).cast("int")).withColumn("col", F.floor((F.col(x) - c) / a).cast("int"))
    return placed.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))


def roc_auc(rows: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve by rank sums over distinct scores, ties counted half."""
    from pyspark.sql import Window as W

    by = rows.where(F.col(score).isNotNull()).groupBy(score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    below = F.coalesce(F.sum("n").over(W.orderBy(score).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return by.withColumn("u", F.col("p") * (below + 0.5 * F.col("n"))).agg((F.sum("u") / (F.sum("p") * F.sum("n"))).alias("roc_auc"))


def covered(rows: DataFrame, support: DataFrame, on: list[str], flag: str = "support") -> DataFrame:
    """Rows with their support; a row without one is an error."""
    joined = rows.join(support, on, "left")
    return joined.where(F.assert_true(F.col(flag).isNotNull(), "row without support").isNull())


def same_keys(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """One row: keys only in a, only in b, in both."""
    left, right = a.select(*on).distinct().withColumn("_a", F.lit(1)), b.select(*on).distinct().withColumn("_b", F.lit(1))
    both = left.join(right, on, "full_outer")
    return both.agg(F.count_if(F.col("_b").isNull()).alias("only_left"), F.count_if(F.col("_a").isNull()).alias("only_right"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("shared"))


def manifest_diff(declared: DataFrame, found: DataFrame, key: str = "path", digest: str = "sha256") -> DataFrame:
    """(key, status): missing (declared only), untracked (found only) or modified (digests differ)."""
    a, b = declared.select(key, F.col(digest).alias("_a"), F.lit(True).alias("_in_a")), found.select(key, F.col(digest).alias("_b"), F.lit(True).alias("_in_b"))
    both = a.join(b, key, "full_outer")
    status = F.when(F.col("_in_b").isNull(), F.lit("missing")).when(F.col("_in_a").isNull(), F.lit("untracked")).when(~F.col("_a").eqNullSafe(F.col("_b")), F.lit("modified"))
    return both.select(key, status.alias("status")).where("status IS NOT NULL")


def first_errors(problems: DataFrame, n: int = 5) -> DataFrame:
    """Per status the number of problems and the first n keys."""
    from pyspark.sql import Window as W

    key = problems.columns[0]
    ranked = problems.withColumn("_place", F.row_number().over(W.partitionBy("status").orderBy(key))).where(F.col("_place") <= n)
    first = ranked.groupBy("status").agg(F.sort_array(F.collect_list(key)).alias("first"))  # n of a status at most
    return problems.groupBy("status").agg(F.count("*").alias("n")).join(first, "status")


def distinct_union(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Keys of either table, once each."""
    return a.select(*on).unionByName(b.select(*on)).distinct()
