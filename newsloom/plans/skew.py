"""Equi-joins in which no key's rows meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Rows of one key that meet in one task.
HOT_ROWS = 5_000
#: Keys with more rows that may be broadcast; beyond it they are shuffled.
BROADCAST_KEYS = 100_000


def split_join(left: DataFrame, right: DataFrame, key: str, *, left_by: str, right_by: str, rows: int = HOT_ROWS, counted: DataFrame | None = None) -> DataFrame:
    """Inner join on ``key``; a key with more than ``rows`` rows is divided into blocks, and each pair of blocks is a task's work.

    ``left_by`` and ``right_by`` say by which column the rows of a key are
    divided.  ``counted``, by default ``right``, has the rows that decide which
    keys are hot.  All other keys are joined as they are, and so share
    exchanges where both sides are one table.
    """
    counts = (right if counted is None else counted).groupBy(key).count().filter(F.col("count") > rows)
    hot = counts.select(key, F.ceil(F.col("count") / rows).cast("int").alias("_parts"))
    number = hot.count()
    if number == 0:
        return left.join(right, key)
    if number <= BROADCAST_KEYS:
        # few: collected once, so that no plan counts again
        hot = F.broadcast(left.sparkSession.createDataFrame(hot.collect(), hot.schema))
    whole = left.join(hot, key, "left_anti").join(right.join(hot, key, "left_anti"), key)
    block = lambda column: F.pmod(F.xxhash64(column), F.col("_parts")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    one = left.join(hot, key).withColumn("_a", block(left_by)).withColumn("_b", every).drop("_parts")
    two = right.join(hot, key).withColumn("_b", block(right_by)).withColumn("_a", every).drop("_parts")
    return whole.unionByName(one.join(two, [key, "_a", "_b"]).drop("_a", "_b"))
