"""Retention, rate limits, orphans and checks on size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from newsloom.plans.catalog import query, shared_sql
from newsloom.plans.runtime import table

KEEP_DAYS, LIMIT = 30, 2
_NOW = "SELECT max(MS(fetched_at)) AS t FROM articles"

shared_sql("retention_articles", f"WITH now AS ({_NOW}) SELECT DISTINCT id, MS(fetched_at) AS fetched_ms FROM articles CROSS JOIN now WHERE MS(fetched_at) >= t - {KEEP_DAYS * 86400000}")
shared_sql(
    "retention_embeddings",
    f"WITH now AS ({_NOW}), kept AS (SELECT DISTINCT id FROM articles CROSS JOIN now WHERE MS(fetched_at) >= t - {KEEP_DAYS * 86400000}) SELECT DISTINCT e.article_id, e.model FROM article_embeddings e WHERE EXISTS (SELECT 1 FROM kept k WHERE k.id = e.article_id)",
)
shared_sql(
    "retention_story_reps",
    f"WITH now AS ({_NOW}), kept AS (SELECT DISTINCT id FROM articles CROSS JOIN now WHERE MS(fetched_at) >= t - {KEEP_DAYS * 86400000}) SELECT s.id, k.id AS rep_article_id FROM stories s LEFT JOIN kept k ON k.id = s.rep_article_id",
)
shared_sql("orphan_stories", "SELECT s.id FROM stories s WHERE NOT EXISTS (SELECT 1 FROM articles a WHERE a.story_id = s.id)")
shared_sql("orphan_content", "SELECT c.url FROM article_content c WHERE NOT EXISTS (SELECT 1 FROM articles a WHERE a.url = c.url)")
shared_sql(
    "retention_counts",
    f"""WITH now AS ({_NOW})
        SELECT 'articles' AS rule, CAST(count(DISTINCT CASE WHEN MS(a.fetched_at) < t - {KEEP_DAYS * 86400000} THEN a.id END) AS BIGINT) AS deleted FROM articles a CROSS JOIN now
        UNION ALL SELECT 'rejects' AS rule, CAST(count(CASE WHEN MS(f.fetched_at) < t - 1209600000 AND CAST(substr(f.id, 3) AS BIGINT) % 3 = 0 THEN 1 END) AS BIGINT) AS deleted FROM feed_items f CROSS JOIN now
        UNION ALL SELECT 'content' AS rule, CAST(count(CASE WHEN MS(c.fetched_at) < t - {KEEP_DAYS * 86400000} THEN 1 END) AS BIGINT) AS deleted FROM article_content c CROSS JOIN now""",
)


@query(
    "rate_limit",
    f"SELECT event_id, row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 3600000000 ORDER BY ts, event_id) <= {LIMIT} AS allowed, CAST(greatest(1, ceil((3600000000 - epoch_us(ts) % 3600000000) / 1000000.0)) AS BIGINT) AS retry_after FROM events",
)
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests (events of a user) in fixed hours: the first ones are allowed; seconds to the next hour.

    Ranks are only asked for up to the limit, so each task keeps that many of a
    window before anything is shuffled, however many requests a caller makes.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, sf_dir, "events").select("event_id", "user_id", us.alias("us")).withColumn("hour", F.floor(F.col("us") / 3_600_000_000))
    first = Window.partitionBy("user_id", "hour").orderBy("us", "event_id")
    allowed = e.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= LIMIT).select(F.col("event_id").alias("a_id"))
    joined = e.join(allowed, F.col("event_id") == F.col("a_id"), "left")
    return joined.select("event_id", F.col("a_id").isNotNull().alias("allowed"), F.greatest(F.lit(1), F.ceil((3_600_000_000 - F.col("us") % 3_600_000_000) / 1_000_000.0)).cast("bigint").alias("retry_after"))


@query("rate_limit_windows", "SELECT user_id, epoch_ms(date_trunc('hour', ts)) AS window_ms, CAST(count(*) AS BIGINT) AS requests FROM events GROUP BY 1, 2")
def rate_limit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of each user in tumbling windows of one hour."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    g = e.groupBy("user_id", F.window("ts", "1 hour")).agg(F.count(F.lit(1)).alias("requests"))
    return g.select("user_id", F.unix_millis("window.start").alias("window_ms"), "requests")


shared_sql("stats_json", "SELECT event_type, CAST(count(*) AS BIGINT) AS events, round(sum(CAST(value AS DOUBLE)), 4) AS total FROM events GROUP BY event_type")


@query(
    "ops_gate",
    """WITH s AS (SELECT sum(CAST(length(content) AS BIGINT)) / 1000000.0::DOUBLE AS mb FROM article_content) SELECT round(mb, 4) AS mb, CASE WHEN mb > 450 THEN 'fail' WHEN mb > 400 THEN 'warn' ELSE 'ok' END AS state FROM s""",
)
def ops_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the stored pages against the warning and failing limits."""
    mb = table(spark, sf_dir, "article_content").agg((F.sum(F.char_length("content")) / 1_000_000.0).alias("mb"))
    return mb.select(F.round("mb", 4).alias("mb"), F.when(F.col("mb") > 450, "fail").when(F.col("mb") > 400, "warn").otherwise("ok").alias("state"))
