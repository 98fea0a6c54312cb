"""Running sums over groups of any size, without gathering a group in one task.

Rows are dealt into buckets of a few thousand rows along the order. Buckets are summed, their sums
accumulated in two levels (within runs of ``RUN`` buckets, then over the runs), and each bucket's rows
are accumulated from its start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of a run.
RUN = 1024


def running_sum(df: DataFrame, group: str, bucket: str, order: list[Column | str], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` up to and with the row, in each group by (bucket, order).

    ``group`` holds no nulls and ``bucket`` (long) rises with the order. Rows are shuffled once, by group
    and bucket; a task of the second level gets a row for every ``RUN`` buckets of a group.
    """
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(group, bucket).agg(F.sum(value).alias("_sum")).withColumn("_run", F.floor(F.col(bucket) / RUN))
    runs = sums.groupBy(group, "_run").agg(F.sum("_sum").alias("_total"))
    runs = runs.withColumn("_base", F.coalesce(F.sum("_total").over(before(group).orderBy("_run")), F.lit(0))).drop("_total")
    sums = sums.withColumn("_within", F.coalesce(F.sum("_sum").over(before(group, "_run").orderBy(bucket)), F.lit(0)))
    sums = sums.join(runs, [group, "_run"]).select(group, bucket, (F.col("_base") + F.col("_within")).alias("_before"))
    inner = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = df.withColumn("_own", F.sum(value).over(inner))
    return own.join(sums, [group, bucket]).withColumn(out, F.col("_before") + F.col("_own")).drop("_own", "_before")
