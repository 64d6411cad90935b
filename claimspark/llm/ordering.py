"""Places of rows in a global order, without sorting any group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import write_shared


def placed(df: DataFrame, order: list[Column], group: str | None = None, what: str = "placed") -> DataFrame:
    """``df`` with ``place`` (long, from 0, in the order of ``order`` within each ``group``) and ``size`` (rows of the group).

    Rows are dealt over tasks by ranges of the order, sorted and written; the
    rows that each task has of a group, one small row for each, then give
    every task the place of its first. So a group of any size is spread over
    tasks, and ties should be broken by ``order`` itself. ``group`` must not
    hold nulls.
    """
    keys = [group] if group else []
    dealt = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    written = write_shared(dealt.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__row")), what)
    counts = written.groupBy("__part", *keys).agg(F.min("__row").alias("__first"), F.count("*").alias("__n"))
    of = Window.partitionBy(*keys)
    bases = counts.select("__part", *keys, (F.coalesce(F.sum("__n").over(of.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
                                            - F.col("__first")).alias("__shift"), F.sum("__n").over(of).alias("size"))
    return written.join(bases, ["__part", *keys]).withColumn("place", F.col("__row") + F.col("__shift")).drop("__part", "__row", "__shift")
