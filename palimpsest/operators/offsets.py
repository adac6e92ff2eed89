"""Running sums over a whole ordered table without one task that sees it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows of a bucket aimed at, and buckets at least and at most.
BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 500_000, 64, 2048


def number_buckets(df: DataFrame, column: str, parts: int | None = None) -> Column:
    """An order-preserving bucket of a numeric column, by its sampled quantiles: about as many rows each, wherever the
    values lie. ``parts``: by default one for every ``BUCKET_ROWS`` rows, within bounds."""
    if parts is None:
        parts = min(MOST_BUCKETS, max(LEAST_BUCKETS, df.count() // BUCKET_ROWS))
    marks = df.agg(F.percentile_approx(column, [k / parts for k in range(1, parts)], 10 * parts).alias("marks")).first()["marks"]
    if not marks:
        return F.lit(0)
    held = F.array(*(F.lit(m) for m in sorted(set(marks))))
    return F.size(F.filter(held, lambda mark: mark <= F.col(column)))


def running_before(df: DataFrame, order: list[Column], amount: Column, bucket: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of ``amount`` over all rows before. ``bucket`` must not decrease along ``order``.

    Each bucket is summed on its own; the sums of the buckets, a row each, are summed up and joined. Rows that tie
    in ``order`` follow each other in any order.
    """
    rows = df.withColumn("__bucket", bucket)
    totals = rows.groupBy("__bucket").agg(F.sum(amount).alias("__sum"))
    earlier = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
    totals = totals.select(F.col("__bucket").alias("__b"), F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__base"))
    within = Window.partitionBy("__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("__before", F.coalesce(F.sum(amount).over(within), F.lit(0)))
    joined = placed.join(totals, F.col("__bucket").eqNullSafe(F.col("__b")))
    return joined.withColumn(name, F.col("__base") + F.col("__before")).drop("__bucket", "__b", "__before", "__base")
