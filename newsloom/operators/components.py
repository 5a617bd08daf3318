"""Connected components of a link table, without any part of it at the driver.

Large-star and small-star rounds alternate until the links no longer change;
each round is written to the shared folder, so the lineage stays short and a
lost executor costs a re-read.  The number of rounds grows with the logarithm
of the longest chain.  Every star keeps only links to one smallest node, so a
node with very many links sends as many rows as before and no more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newsloom.plans.runtime import drop_path, park_at

_MOST_ROUNDS = 60


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b <> m").select(F.col("m").alias("a"), F.col("b"))
    return moved.unionAll(least.select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()


def component_labels(links: DataFrame) -> DataFrame:
    """``node``, ``label``: the smallest node of its component, for every node of ``links`` (``a``, ``b``).

    Self links and nulls are ignored, repeated links count once, an empty table
    gives an empty one.
    """
    spark = links.sparkSession
    now, path = park_at(links.filter("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    seen = None
    for _ in range(_MOST_ROUNDS):
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark["n"] == 0 or (mark["n"], mark["h"]) == seen:
            break
        seen = (mark["n"], mark["h"])
        before = path
        now, path = park_at(_small_star(_large_star(now)), "links")
        drop_path(spark, before)
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("b").alias("node"), F.col("a").alias("label")).unionAll(now.select(F.col("a").alias("node"), F.col("a").alias("label"))).distinct()
