"""Mixed timestamp formats and time zones, normalised through a persisted dictionary.

A corpus repeats its timestamp texts: epoch texts are nearly unique, but
placeholders, minute-precision readings and redelivered items are not.  So the
texts are reduced to distinct (text, zone, day order) entries with a map-side
combine, each entry is parsed once, the entries that a stored dictionary lacks
are appended to it, and the instants are joined back to the rows.  One text
that fills a third of the rows is one entry; the join back sends the texts that
occur often, of which there can be few, by broadcast and never shuffles their
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from newsloom.functions.instants import read_instant
from newsloom.plans.catalog import query
from newsloom.plans.runtime import fresh_path, path_exists, table

#: A text is hot from one row in so many; so there are at most as many hot texts.
HOT_SHARE = 2000

_ENTRY = T.StructType(
    [
        T.StructField("raw", T.StringType()),
        T.StructField("tz_name", T.StringType()),
        T.StructField("day_first", T.BooleanType()),
        T.StructField("instant_ms", T.LongType()),
    ]
)
_KEY = ["raw", "tz_name", "day_first"]


def _parse_entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        firsts = [None if pd.isna(x) else bool(x) for x in pdf["day_first"]]
        zones = [None if pd.isna(x) else x for x in pdf["tz_name"]]
        found = [read_instant(r, z, f) for r, z, f in zip(pdf["raw"], zones, firsts)]
        yield pd.DataFrame({"raw": pdf["raw"], "tz_name": zones, "day_first": firsts, "instant_ms": pd.array(found, dtype="Int64")})


class InstantDictionary:
    """Parsed timestamp texts, kept as a Parquet table that only grows.

    Each ``extend`` appends one folder; a run that dies leaves no half-written
    folder behind, because Spark commits a folder's files at the end.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or fresh_path(spark, "instants")

    def read(self) -> DataFrame:
        """All entries; an empty table before the first ``extend``."""
        if not path_exists(self.spark, self.path):
            return self.spark.createDataFrame([], _ENTRY)
        return self.spark.read.schema(_ENTRY).parquet(self.path)

    def extend(self, keys: DataFrame) -> None:
        """Parse and append the entries of ``keys`` (raw, tz_name, day_first; raw not null) that are not stored yet."""
        new = keys.select(*_KEY).distinct()
        if path_exists(self.spark, self.path):
            stored = self.read().select(*(F.col(c).alias(f"s_{c}") for c in _KEY))
            same = [F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in _KEY]
            new = new.join(stored, (F.col("raw") == F.col("s_raw")) & same[1] & same[2], "left_anti")
        new.mapInPandas(_parse_entries, _ENTRY).write.mode("append").option("compression", "zstd").parquet(self.path)


def with_locale(items: DataFrame, locale: DataFrame) -> DataFrame:
    """Add ``tz_name`` and ``day_first`` of each row's feed, by ``feed_url``, else by ``source_id``.

    ``locale`` has one row per feed of the roster; its size is checked by the
    optimizer's own broadcast limit, no hint is given.  A row without a known
    feed gets nulls and keeps only texts that state their own zone.
    """
    by_url = locale.groupBy(F.col("feed_url").alias("__feed_url")).agg(F.min("tz_name").alias("__tz_url"), F.min("day_first").alias("__day_url"))
    by_id = locale.groupBy(F.col("source_id").alias("__source_id")).agg(F.min("tz_name").alias("__tz_id"), F.min("day_first").alias("__day_id"))
    return (
        items.drop("tz_name", "day_first")
        .join(by_url, F.col("feed_url") == F.col("__feed_url"), "left")
        .join(by_id, F.col("source_id") == F.col("__source_id"), "left")
        .withColumn("tz_name", F.coalesce("__tz_url", "__tz_id"))
        .withColumn("day_first", F.coalesce("__day_url", "__day_id"))
        .drop("__feed_url", "__source_id", "__tz_url", "__day_url", "__tz_id", "__day_id")
    )


def normalise_instants(items: DataFrame, locale: DataFrame, dictionary: InstantDictionary, text_col: str = "published_at") -> DataFrame:
    """Every row of ``items`` with ``instant_ms``: the one UTC instant of its text in milliseconds, else null.

    Null, empty, relative, dateless, timeless and impossible texts give null, as
    do zoneless readings that the feed's clock skips or repeats.  Rows are kept
    as they are, repeated ones too; the columns ``tz_name``, ``day_first`` and
    ``instant_ms`` replace any of that name.  An empty table gives an empty one.
    """
    rows = with_locale(items.drop("instant_ms"), locale)
    keyed = rows.filter(F.col(text_col).isNotNull())
    counted = keyed.groupBy(F.col(text_col).alias("raw"), "tz_name", "day_first").agg(F.count(F.lit(1)).alias("n"))
    dictionary.extend(counted)
    entries = dictionary.read().select(F.col("raw").alias("__raw"), F.col("tz_name").alias("__tz"), F.col("day_first").alias("__day"), F.col("instant_ms"))
    same = (F.col(text_col) == F.col("__raw")) & F.col("tz_name").eqNullSafe(F.col("__tz")) & F.col("day_first").eqNullSafe(F.col("__day"))
    total = keyed.count()
    hot = counted.filter(F.col("n") * HOT_SHARE > total).select("raw").distinct()  # at most HOT_SHARE texts
    hot_texts = [r[0] for r in hot.collect()]
    is_hot = F.coalesce(F.col(text_col).isin(hot_texts), F.lit(False)) if hot_texts else F.lit(False)
    cold = rows.filter(~is_hot).join(entries, same, "left")
    if not hot_texts:
        return cold.drop("__raw", "__tz", "__day")
    few = F.broadcast(entries.filter(F.col("__raw").isin(hot_texts)))
    return cold.unionByName(rows.filter(is_hot).join(few, same, "left")).drop("__raw", "__tz", "__day")


@query("p5_found")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id``, ``published_ms`` of each feed item whose text denotes exactly one instant."""
    items = table(spark, sf_dir, "feed_items").select("id", "published_at", "feed_url", "source_id")
    found = normalise_instants(items, table(spark, sf_dir, "feed_locale"), InstantDictionary(spark))
    return found.filter(F.col("instant_ms").isNotNull()).select("id", F.col("instant_ms").alias("published_ms")).distinct()
