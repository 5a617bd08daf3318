"""Ingest: deduplication, anti-joins, caps, batches, upserts, health of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from newsloom.functions.text import DEFAULT_PHRASES, DEFAULT_WORDS, body_hash as hash_column, clean_title as title_column, keyword_relevant, normalise_summary
from newsloom.operators.feed import articles
from newsloom.operators.timestamps import InstantDictionary, normalise_instants
from newsloom.plans.catalog import QUERIES, query, shared_sql
from newsloom.plans.runtime import park, table

CLASSIFY_CAP, BATCH = 300, 30


def items(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Delivered items; only the columns asked for are read."""
    return table(spark, sf_dir, "feed_items").select(*columns)


#: The stub verdict of the injected classifier: by id, a third each rejected, relevant and deferred.
_REJECTS = "SELECT guid, id, title, source_lang, source_id FROM feed_items WHERE CAST(substr(id, 3) AS BIGINT) % 3 = 0"


@query(
    "ingest_dedup",
    "SELECT guid, id, first_id FROM (SELECT guid, id, min(id) OVER (PARTITION BY guid) AS first_id, row_number() OVER (PARTITION BY guid ORDER BY id DESC) AS k FROM feed_items WHERE guid IS NOT NULL AND guid <> '') d WHERE k = 1",
)
def ingest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per guid: the last value wins, the first place is kept."""
    return items(spark, sf_dir, "guid", "id").filter("guid is not null and guid <> ''").groupBy("guid").agg(F.max("id").alias("id"), F.min("id").alias("first_id"))


shared_sql("existing_guids", f"SELECT guid FROM articles WHERE guid IS NOT NULL UNION SELECT guid FROM ({_REJECTS}) r WHERE guid IS NOT NULL")
shared_sql(
    "new_guids",
    f"SELECT DISTINCT f.guid FROM feed_items f WHERE f.guid <> '' AND NOT EXISTS (SELECT 1 FROM articles a WHERE a.guid = f.guid) AND NOT EXISTS (SELECT 1 FROM ({_REJECTS}) r WHERE r.guid = f.guid)",
)
shared_sql(
    "upsert_articles",
    """WITH n AS (SELECT guid, min(id) AS id FROM feed_items WHERE guid <> '' GROUP BY guid)
       SELECT 'kept' AS state, CAST(count(DISTINCT id) AS BIGINT) AS articles FROM articles
       UNION ALL SELECT 'inserted' AS state, CAST(count(*) AS BIGINT) AS articles FROM n WHERE NOT EXISTS (SELECT 1 FROM articles a WHERE a.guid = n.guid)
       UNION ALL SELECT 'ignored' AS state, CAST(count(*) AS BIGINT) AS articles FROM n WHERE EXISTS (SELECT 1 FROM articles a WHERE a.guid = n.guid)""",
)
shared_sql(
    "record_rejects",
    f"SELECT r.guid, min(r.id) AS id, min(r.title) AS title, min(r.source_lang) AS lang FROM ({_REJECTS}) r WHERE r.guid <> '' AND NOT EXISTS (SELECT 1 FROM articles a WHERE a.guid = r.guid) GROUP BY r.guid",
)


@query("classify_cap", f"SELECT id, row_number() OVER (ORDER BY published_at DESC NULLS LAST, id) <= {CLASSIFY_CAP} AS chosen FROM (SELECT DISTINCT id, published_at FROM articles) a")
def classify_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the articles, taken as new items with known instants, a run classifies: the newest by publication, undated last; the rest is deferred.

    ``classify_queue`` does the same for delivered items, whose instants have to be read first.
    """
    rows = articles(spark, sf_dir, "id", "published_at")
    # at most CLASSIFY_CAP rows
    chosen = rows.orderBy(F.col("published_at").desc_nulls_last(), "id").limit(CLASSIFY_CAP).select("id", F.lit(True).alias("c"))
    return rows.join(F.broadcast(chosen), "id", "left").select("id", F.coalesce("c", F.lit(False)).alias("chosen"))


MAX_FUTURE_MS, MAX_AGE_MS = 600_000, 365 * 86_400_000


@query("classify_queue")
def classify_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``guid``, ``id``, ``first_id``, ``published_ms``, ``chosen`` of every item not yet known, once for each guid.

    The newest ``CLASSIFY_CAP`` by publication instant are chosen, those without
    an accepted instant last and equal ones in order of arrival; the rest is
    deferred.  An instant is accepted as in ``parse_date``, with the last fetch
    of the items as now.
    """
    unique = ingest_dedup(spark, sf_dir).join(QUERIES["existing_guids"](spark, sf_dir), "guid", "left_anti")
    rows = items(spark, sf_dir, "id", "published_at", "feed_url", "source_id", "fetched_at")
    now = rows.agg(F.unix_millis(F.max("fetched_at"))).first()[0]  # one value
    dated = normalise_instants(rows.drop("fetched_at").join(unique, "id").dropDuplicates(["guid"]), table(spark, sf_dir, "feed_locale"), InstantDictionary(spark))
    accepted = F.when(F.col("instant_ms").between(F.lit(now) - MAX_AGE_MS, F.lit(now) + MAX_FUTURE_MS), F.col("instant_ms"))
    fresh = park(dated.select("guid", "id", "first_id", accepted.alias("published_ms")), "classify-queue")
    chosen = fresh.orderBy(F.col("published_ms").desc_nulls_last(), "first_id").limit(CLASSIFY_CAP).select("guid", F.lit(True).alias("chosen"))
    # at most CLASSIFY_CAP rows
    return fresh.join(F.broadcast(chosen), "guid", "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``pos`` from 0 in an order, without sorting all in one task.

    A range partitioning puts the order into partitions, which are written, so
    that their bounds stay as they are; their sizes are added up, and each row's
    place within its partition is added to that.
    """
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parted = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id())
    parted = park(parted.withColumn("_part", F.shiftright("_mid", 33)).withColumn("_at", F.col("_mid").bitwiseAND((1 << 33) - 1)), "numbered")
    sizes = parted.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # one row a partition
    return parted.join(F.broadcast(starts), "_part").withColumn("pos", F.col("_start") + F.col("_at")).drop("_mid", "_part", "_at", "_start")


@query(
    "classify_batches",
    f"""WITH o AS (SELECT id, title, summary, row_number() OVER (ORDER BY id) - 1 AS pos FROM feed_items)
        SELECT CAST(pos // {BATCH} AS BIGINT) AS batch, CAST(count(*) AS BIGINT) AS items, sha256(string_agg(concat(CAST(pos % {BATCH} + 1 AS VARCHAR), '. "', coalesce(title, ''), '" | ', substr(coalesce(summary, ''), 1, 200)), chr(10) ORDER BY pos)) AS prompt_hash FROM o GROUP BY 1""",
)
def classify_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items in batches of thirty, each as the numbered lines of one prompt."""
    o = numbered(items(spark, sf_dir, "id", "title", "summary"), "id")
    line = F.concat((F.col("pos") % BATCH + 1).cast("string"), F.lit('. "'), F.coalesce("title", F.lit("")), F.lit('" | '), F.substring(F.coalesce("summary", F.lit("")), 1, 200))
    b = o.withColumn("batch", F.floor(F.col("pos") / BATCH)).groupBy("batch").agg(F.count(F.lit(1)).alias("items"), F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("lines"))
    return b.select("batch", "items", F.sha2(F.concat_ws("\n", F.transform("lines", lambda x: x["line"])), 256).alias("prompt_hash"))


_WORDS_SQL = ", ".join(f"'{w}'" for w in DEFAULT_WORDS)
_PHRASES_SQL = " OR ".join(f"contains(text, '{p}')" for p in DEFAULT_PHRASES)


@query(
    "keyword_relevance",
    f"""WITH t AS (SELECT DISTINCT id, lower(concat_ws(' ', title, coalesce(summary, ''))) AS text FROM articles) SELECT id, len(list_intersect(string_split_regex(text, '[^0-9A-Za-z_]+'), [{_WORDS_SQL}])) > 0 OR {_PHRASES_SQL} AS relevant FROM t""",
)
def keyword_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether title or summary has a word or a phrase of the lexicon."""
    return articles(spark, sf_dir, "id", "title", "summary").select("id", keyword_relevant(F.col("title"), F.col("summary")).alias("relevant"))


@query("normalize_summary", "SELECT DISTINCT id, trim(regexp_replace(nfc_normalize(lower(summary)), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS text FROM articles WHERE summary IS NOT NULL AND summary NOT LIKE '%İ%'")
def normalize_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries as the fingerprint sees them; the SQL leaves out texts with a letter that engines lower-case differently."""
    rows = articles(spark, sf_dir, "id", "summary").filter("summary is not null")
    return rows.select("id", normalise_summary(F.col("summary")).alias("text"))


_HASHED = "SELECT DISTINCT id, body_hash, CASE WHEN length(n) >= 40 THEN sha256(n) END AS computed FROM (SELECT id, body_hash, trim(regexp_replace(nfc_normalize(lower(summary)), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS n FROM articles WHERE coalesce(summary, '') NOT LIKE '%İ%') x"


@query("body_hash", f"SELECT id, computed FROM ({_HASHED}) h")
def body_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of each summary; null for short and missing ones."""
    rows = articles(spark, sf_dir, "id", "summary")
    return rows.select("id", hash_column(F.col("summary")).alias("computed"))


@query("backfill_body_hash", f"SELECT id, computed FROM ({_HASHED}) h WHERE body_hash IS NULL AND computed IS NOT NULL")
def backfill_body_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints that are missing although the summary is long enough."""
    rows = articles(spark, sf_dir, "id", "summary", "body_hash").filter(F.col("body_hash").isNull())
    return rows.select("id", hash_column(F.col("summary")).alias("computed")).filter("computed is not null")


_CLEAN = "trim(regexp_replace(regexp_replace(nfc_normalize(title), '[\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}\\x{FEFF}]', '', 'g'), '[\\s\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+', ' ', 'g'))"


@query("clean_title", f"SELECT DISTINCT id, {_CLEAN} AS title FROM articles")
def clean_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles composed, without format marks, with single blanks."""
    return articles(spark, sf_dir, "id", "title").select("id", title_column(F.col("title")).alias("title"))


@query("embeddable", f"SELECT DISTINCT id, coalesce(length({_CLEAN}) >= 15 AND {_CLEAN} <> '(no title)', false) AS embeddable FROM articles")
def embeddable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a title is long enough to embed and no placeholder."""
    t = title_column(F.col("title"))
    return articles(spark, sf_dir, "id", "title").select("id", F.coalesce((F.char_length(t) >= 15) & (t != "(no title)"), F.lit(False)).alias("embeddable"))


shared_sql("build_guid", "SELECT id, CASE WHEN trim(coalesce(guid, '')) <> '' THEN guid WHEN trim(coalesce(url, '')) <> '' THEN url ELSE '' END AS guid FROM feed_items")
shared_sql(
    "clamped_dates",
    """WITH now AS (SELECT max(MS(fetched_at)) AS t FROM articles)
       SELECT DISTINCT id, MS(published_at) AS published_ms FROM articles CROSS JOIN now WHERE published_at IS NOT NULL AND NOT (MS(published_at) BETWEEN t - 31536000000 AND t + 600000)""",
)
shared_sql(
    "parse_date",
    """WITH now AS (SELECT max(MS(fetched_at)) AS t FROM articles)
       SELECT DISTINCT id, CASE WHEN MS(published_at) BETWEEN t - 31536000000 AND t + 600000 THEN MS(published_at) END AS accepted_ms FROM articles CROSS JOIN now""",
)
shared_sql(
    "assign_worklist",
    """WITH now AS (SELECT max(MS(fetched_at)) AS t FROM articles)
       SELECT DISTINCT id, MS(published_at) AS published_ms FROM articles CROSS JOIN now WHERE story_id IS NULL AND MS(fetched_at) >= t - 86400000 ORDER BY published_ms ASC NULLS LAST, id LIMIT 300""",
)
shared_sql(
    "ingest_stats",
    f"""SELECT CAST(count(*) AS BIGINT) AS items, CAST(count(DISTINCT guid) AS BIGINT) AS unique_guids, CAST(sum(CASE WHEN known THEN 0 ELSE 1 END) AS BIGINT) AS new_items,
               CAST(sum(CASE WHEN CAST(substr(id, 3) AS BIGINT) % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS rejected
        FROM (SELECT f.id, f.guid, a.guid IS NOT NULL AS known FROM feed_items f LEFT JOIN (SELECT DISTINCT guid FROM articles) a ON a.guid = f.guid) x""",
)
shared_sql(
    "accept_rate",
    f"""WITH v AS (SELECT source_name, 1 AS accepted FROM (SELECT DISTINCT id, source_name FROM articles) a UNION ALL SELECT source_name, 0 AS accepted FROM feed_items WHERE CAST(substr(id, 3) AS BIGINT) % 3 = 0)
        SELECT source_name, CAST(sum(accepted) AS BIGINT) AS accepted, CAST(count(*) AS BIGINT) AS judged, round(CAST(sum(accepted) AS DOUBLE) / count(*), 6) AS rate FROM v GROUP BY source_name""",
)
shared_sql("source_roster", "SELECT id, name, url, region, lang FROM sources WHERE enabled ORDER BY name, id")
shared_sql("roster_backup", "SELECT name, url, region, lang, enabled, affiliation FROM sources ORDER BY name")
shared_sql(
    "source_health",
    """SELECT id, name, region, CASE WHEN NOT enabled THEN 'gray' WHEN consecutive_failures = 0 AND last_ok_at IS NOT NULL THEN 'green' WHEN consecutive_failures > 6 THEN 'red' ELSE 'amber' END AS tier FROM sources""",
)
shared_sql(
    "source_health_by_region",
    "SELECT region, CAST(count(*) AS BIGINT) AS sources, CAST(sum(CASE WHEN enabled AND consecutive_failures = 0 AND last_ok_at IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS healthy FROM sources GROUP BY region",
)
shared_sql(
    "fetch_summary",
    """SELECT CAST(sum(CASE WHEN last_error_kind IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS ok, CAST(sum(CASE WHEN last_via = 'direct' THEN 1 ELSE 0 END) AS BIGINT) AS direct, CAST(sum(CASE WHEN last_via = 'proxy' THEN 1 ELSE 0 END) AS BIGINT) AS proxy,
              CAST(sum(CASE WHEN last_error_kind = 'http' THEN 1 ELSE 0 END) AS BIGINT) AS http, CAST(sum(CASE WHEN last_error_kind = 'timeout' THEN 1 ELSE 0 END) AS BIGINT) AS timeouts, CAST(sum(CASE WHEN last_error_kind = 'parse' THEN 1 ELSE 0 END) AS BIGINT) AS parse,
              CAST(sum(CASE WHEN last_error_kind = 'network' THEN 1 ELSE 0 END) AS BIGINT) AS network, CAST(sum(CASE WHEN last_error_kind = 'blocked' THEN 1 ELSE 0 END) AS BIGINT) AS blocked FROM sources""",
)
shared_sql(
    "source_health_update",
    """WITH last AS (SELECT feed_url, CAST(count(*) AS BIGINT) AS n FROM feed_items GROUP BY feed_url)
       SELECT s.id, CASE WHEN l.n IS NOT NULL THEN 0 ELSE CAST(s.consecutive_failures AS BIGINT) + 1 END AS consecutive_failures, CASE WHEN l.n IS NOT NULL THEN NULL ELSE coalesce(s.last_error_kind, 'network') END AS last_error_kind,
              substr(CASE WHEN l.n IS NULL THEN s.last_error END, 1, 300) AS last_error FROM sources s LEFT JOIN last l ON l.feed_url = s.url""",
)
shared_sql(
    "backfill_source_id",
    "SELECT DISTINCT a.id, s.id AS source_id FROM articles a JOIN sources s ON s.url = a.feed_url WHERE a.source_id IS NULL",
)
shared_sql(
    "backfill_affiliation",
    "SELECT DISTINCT a.id, s.affiliation FROM articles a JOIN sources s ON s.id = a.source_id WHERE a.source_affiliation IS DISTINCT FROM s.affiliation",
)
shared_sql(
    "region_remap",
    "SELECT DISTINCT id, CASE WHEN source_region IN ('Russian', 'Ukrainian') THEN 'Eastern European' WHEN source_region = 'US/Western' THEN 'Western' ELSE source_region END AS region FROM articles",
)
shared_sql("seed_sources", "WITH seed AS (SELECT DISTINCT feed_url AS url, source_name AS name FROM feed_items) SELECT url, min(name) AS name FROM seed WHERE NOT EXISTS (SELECT 1 FROM sources s WHERE s.url = seed.url) GROUP BY url")


@query(
    "verdict_parse",
    """WITH v AS (SELECT id, CASE CAST(substr(id, 3) AS BIGINT) % 4 WHEN 0 THEN '[1,0,1]' WHEN 1 THEN '["1","0","1"]' WHEN 2 THEN 'not json' ELSE '[1,0]' END AS reply FROM feed_items)
        SELECT id, CASE WHEN reply = '[1,0,1]' THEN 'ok' ELSE 'failed' END AS state FROM v""",
)
def verdict_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of a classifier for batches of three: an array of exactly three numbers, each 0 or 1, or a failed batch."""
    n = F.substring("id", 3, 20).cast("bigint") % 4
    reply = F.when(n == 0, "[1,0,1]").when(n == 1, '["1","0","1"]').when(n == 2, "not json").otherwise("[1,0]")
    return items(spark, sf_dir, "id").withColumn("reply", reply).select("id", F.when(valid_verdict(F.col("reply"), 3), "ok").otherwise("failed").alias("state"))


def valid_verdict(reply: F.Column, size: int) -> F.Column:
    """Whether a reply, code fences aside, is an array of ``size`` numbers that are 0 or 1."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(reply), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))
    return F.coalesce(bare.rlike(r"^\[\s*[01]\s*(,\s*[01]\s*)*\]$") & (F.size(F.split(bare, ",")) == size), F.lit(False))
