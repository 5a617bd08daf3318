"""Reading the feed: serving windows, pages, filters, search, separators, export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from newsloom.plans.catalog import query, shared_sql
from newsloom.plans.runtime import table

# Articles served at start, in a page, in the export, and the export's items.
BOOT, PAGE, EXPORT_ARTICLES, EXPORT_ITEMS = 500, 100, 150, 40
# Languages read from right to left.
RTL = ("ar", "fa", "he", "ur")

#: Articles without the rows that are repeated whole, in feed order where ordered.
FEED_COLUMNS = ["id", "title", "url", "summary", "published_at", "fetched_at", "source_name", "source_region", "source_lang", "source_affiliation", "body_hash", "story_id"]


def articles(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The accepted articles, each id once; only the columns asked for are read."""
    wanted = list(columns) or FEED_COLUMNS
    return table(spark, sf_dir, "articles").select(*dict.fromkeys(["id", *wanted])).dropDuplicates(["id"]).select(*wanted)


def feed_order() -> list:
    """Newest publication first, undated last, then newest fetch, then id."""
    return [F.col("published_at").desc_nulls_last(), F.col("fetched_at").desc_nulls_last(), F.col("id")]


_A = "SELECT DISTINCT id, title, url, summary, published_at, fetched_at, source_name, source_region, source_lang, source_affiliation, body_hash, story_id FROM articles"
_ORDER = "published_at DESC NULLS LAST, fetched_at DESC NULLS LAST, id"
_BOOT = f"SELECT * FROM ({_A}) x ORDER BY {_ORDER} LIMIT {BOOT}"


def newest(spark: SparkSession, sf_dir: str, n: int, *columns: str, skip: int = 0) -> DataFrame:
    """The newest ``n`` articles after the first ``skip``, in feed order.

    Ids are deduplicated and ranked on three narrow columns; the wide columns
    are read only for the ``n`` ids, which are broadcast, and never shuffled.
    """
    ids = articles(spark, sf_dir, "id", "published_at", "fetched_at").orderBy(*feed_order())
    ids = (ids.offset(skip) if skip else ids).limit(n).select("id")
    wanted = dict.fromkeys(["id", "published_at", "fetched_at", *(columns or FEED_COLUMNS)])
    return table(spark, sf_dir, "articles").select(*wanted).join(F.broadcast(ids), "id", "left_semi").dropDuplicates(["id"]).orderBy(*feed_order())


def boot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The serving window: the newest articles, a top-k report."""
    return newest(spark, sf_dir, BOOT)


@query("feed_boot", f"SELECT id, title, url, MS(published_at) AS published_ms, source_name, source_region FROM ({_BOOT}) b")
def feed_boot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest articles in feed order."""
    return boot(spark, sf_dir).select("id", "title", "url", F.unix_millis("published_at").alias("published_ms"), "source_name", "source_region")


@query("feed_page", f"SELECT id, title, source_name FROM ({_A}) x ORDER BY {_ORDER} LIMIT {PAGE} OFFSET {BOOT}")
def feed_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page after the serving window."""
    return newest(spark, sf_dir, PAGE, "title", "source_name", skip=BOOT).select("id", "title", "source_name")


@query("feed_keyset_page", f"SELECT id, title FROM ({_A}) x WHERE id > 'a-0000000400' ORDER BY id LIMIT 1000")
def feed_keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a thousand after a known id, in id order."""
    return articles(spark, sf_dir, "id", "title").filter("id > 'a-0000000400'").orderBy("id").limit(1000)


shared_sql(
    "feed_region_filter",
    """SELECT DISTINCT id, source_region, source_name FROM articles
       WHERE source_region IN (SELECT region FROM sources GROUP BY region HAVING count(*) >= 20)""",
)
shared_sql(
    "feed_search",
    "SELECT DISTINCT id, title FROM articles WHERE contains(lower(title), 'bridge') OR contains(lower(coalesce(summary, '')), 'bridge')",
)
shared_sql(
    "feed_counts",
    """SELECT count(DISTINCT coalesce(story_id, id)) AS stories_all,
              count(DISTINCT CASE WHEN source_lang = 'en' THEN coalesce(story_id, id) END) AS stories_filtered,
              count(DISTINCT id) AS articles_all FROM articles""",
)
shared_sql(
    "deep_link",
    """WITH one AS (SELECT min(coalesce(story_id, id)) AS story FROM articles WHERE story_id IS NOT NULL)
       SELECT DISTINCT a.id, a.title, o.story FROM articles a JOIN one o ON coalesce(a.story_id, a.id) = o.story""",
)
shared_sql(
    "known_url_gate",
    "SELECT DISTINCT f.id, f.url FROM feed_items f WHERE EXISTS (SELECT 1 FROM articles a WHERE a.url = f.url)",
)
shared_sql(
    "freshness",
    """WITH last AS (SELECT max(last_ok_at) AS ok FROM sources WHERE consecutive_failures = 0),
            now AS (SELECT max(fetched_at) AS t FROM articles)
       SELECT MS(ok) AS last_ok_ms, CASE WHEN ok IS NULL THEN 'none' WHEN MS(t) - MS(ok) > 86400000 THEN 'red' WHEN MS(t) - MS(ok) > 10800000 THEN 'amber' ELSE 'ok' END AS tier
       FROM last CROSS JOIN now""",
)
shared_sql(
    "region_mix",
    f"""WITH b AS ({_BOOT}), c AS (SELECT source_region, count(*) AS n FROM b GROUP BY source_region), t AS (SELECT sum(n) AS total FROM c)
        SELECT source_region, CAST(n AS BIGINT) AS articles, round(greatest(CAST(2 AS DOUBLE), CAST(100 AS DOUBLE) * n / total), 4) AS share FROM c CROSS JOIN t""",
)
shared_sql(
    "lang_tags",
    """SELECT DISTINCT id, CASE WHEN source_lang IS NULL OR source_lang IN ('en', '') THEN '' ELSE upper(source_lang) END AS tag,
              coalesce(source_lang IN ('ar', 'fa', 'he', 'ur'), false) AS rtl FROM articles""",
)
shared_sql(
    "time_ago",
    """WITH now AS (SELECT max(MS(fetched_at)) AS t FROM articles),
            m AS (SELECT DISTINCT id, CAST(floor((t - MS(published_at)) / 60000.0) AS BIGINT) AS minutes FROM articles CROSS JOIN now)
       SELECT id, CASE WHEN minutes IS NULL THEN 'unknown time' WHEN minutes < 1 THEN 'just now' WHEN minutes < 60 THEN concat(CAST(minutes AS VARCHAR(20)), 'm ago')
                  WHEN minutes < 1440 THEN concat(CAST(minutes IDIV 60 AS VARCHAR(20)), 'h ago') ELSE concat(CAST(minutes IDIV 1440 AS VARCHAR(20)), 'd ago') END AS label FROM m""",
)
shared_sql(
    "offset_label",
    """WITH f AS (SELECT story_id, min(MS(published_at)) AS first FROM articles WHERE story_id IS NOT NULL GROUP BY story_id),
            o AS (SELECT DISTINCT a.id, CAST(floor((MS(a.published_at) - f.first) / 60000.0 + 0.5) AS BIGINT) AS m FROM articles a JOIN f ON a.story_id = f.story_id WHERE a.published_at IS NOT NULL),
            h AS (SELECT id, m, CAST(floor(m / 60.0 + 0.5) AS BIGINT) AS h FROM o)
       SELECT id, CASE WHEN m < 1 THEN '+0m' WHEN m < 60 THEN concat('+', CAST(m AS VARCHAR(20)), 'm') WHEN h < 24 THEN concat('+', CAST(h AS VARCHAR(20)), 'h')
                  ELSE concat('+', CAST(CAST(floor(h / 24.0 + 0.5) AS BIGINT) AS VARCHAR(20)), 'd') END AS label FROM h""",
)


@query(
    "day_separators",
    f"""WITH b AS ({_BOOT}), n AS (SELECT max(fetched_at) AS now FROM articles),
          c AS (SELECT coalesce(story_id, id) AS story, max(published_at) AS rep_at FROM b GROUP BY 1),
          k AS (SELECT story, rep_at, CASE WHEN rep_at IS NULL THEN 'unknown' ELSE strftime(least(rep_at, now) AT TIME ZONE 'UTC', '%Y-%m-%d') END AS day FROM c, n)
        SELECT story, day, coalesce(day <> lag(day) OVER (ORDER BY rep_at DESC NULLS LAST, story), true) AS starts_day FROM k""",
)
def day_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories of the serving window, and whether each begins another day than the one before it."""
    # a single value, not a product of tables
    now = articles(spark, sf_dir, "fetched_at").agg(F.max("fetched_at").alias("now"))
    c = boot(spark, sf_dir).groupBy(F.coalesce("story_id", "id").alias("story")).agg(F.max("published_at").alias("rep_at")).crossJoin(now)
    day = F.when(F.col("rep_at").isNull(), "unknown").otherwise(F.date_format(F.least("rep_at", "now"), "yyyy-MM-dd"))
    # the serving window has a fixed size, so one ordered task is enough
    order = Window.partitionBy(F.lit(1)).orderBy(F.col("rep_at").desc_nulls_last(), "story")
    return c.withColumn("day", day).select("story", "day", F.coalesce(F.col("day") != F.lag("day").over(order), F.lit(True)).alias("starts_day"))


@query(
    "last_visit_divider",
    f"""WITH b AS ({_BOOT}), v AS (SELECT max(fetched_at) - INTERVAL 6 HOUR AS visit FROM articles),
          c AS (SELECT coalesce(story_id, id) AS story, max(published_at) AS rep_at FROM b GROUP BY 1),
          o AS (SELECT row_number() OVER (ORDER BY rep_at DESC NULLS LAST, story) - 1 AS i, rep_at, lag(rep_at) OVER (ORDER BY rep_at DESC NULLS LAST, story) AS prev FROM c)
        SELECT CAST(coalesce(min(CASE WHEN i >= 1 AND prev > visit AND rep_at <= visit THEN i END), -1) AS BIGINT) AS divider FROM o, v""",
)
def last_visit_divider(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of the first story of the serving window that is older than the last visit (six hours ago), else -1."""
    visit = articles(spark, sf_dir, "fetched_at").agg((F.max("fetched_at") - F.expr("INTERVAL 6 HOUR")).alias("visit"))
    c = boot(spark, sf_dir).groupBy(F.coalesce("story_id", "id").alias("story")).agg(F.max("published_at").alias("rep_at")).crossJoin(visit)
    order = Window.partitionBy(F.lit(1)).orderBy(F.col("rep_at").desc_nulls_last(), "story")
    o = c.withColumn("i", F.row_number().over(order) - 1).withColumn("prev", F.lag("rep_at").over(order))
    hit = F.when((F.col("i") >= 1) & (F.col("prev") > F.col("visit")) & (F.col("rep_at") <= F.col("visit")), F.col("i"))
    return o.agg(F.coalesce(F.min(hit), F.lit(-1)).cast("bigint").alias("divider"))


def xml_escape(c: F.Column) -> F.Column:
    """The five reserved characters of XML as entities, ampersand first."""
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


def rfc822(ts: F.Column) -> F.Column:
    """A UTC instant as mail headers write it; empty where there is none."""
    return F.coalesce(F.concat(F.date_format(ts, "E"), F.lit(", "), F.date_format(ts, "dd MMM yyyy HH:mm:ss"), F.lit(" GMT")), F.lit(""))


_ESCAPE = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"


@query(
    "rss_items",
    f"""WITH t AS (SELECT * FROM ({_A}) x ORDER BY {_ORDER} LIMIT {EXPORT_ARTICLES}),
          o AS (SELECT *, row_number() OVER (ORDER BY {_ORDER}) AS pos FROM t),
          f AS (SELECT *, row_number() OVER (PARTITION BY coalesce(story_id, id) ORDER BY pos) AS k FROM o),
          p AS (SELECT * FROM f WHERE k = 1 ORDER BY pos LIMIT {EXPORT_ITEMS})
        SELECT id, CAST(row_number() OVER (ORDER BY pos) AS INTEGER) AS item_no,
          concat('<item><title>', {_ESCAPE.format('coalesce(title, chr(0))').replace("coalesce(title, chr(0))", "title")}, '</title><link>', {_ESCAPE.format('url')}, '</link><description>',
            {_ESCAPE.format("concat(CASE WHEN trim(coalesce(summary, '')) <> '' THEN concat(trim(summary), ' ') ELSE '' END, '— ', source_name, ' (', source_region, ')')")},
            '</description><pubDate>', coalesce(strftime(published_at AT TIME ZONE 'UTC', '%a, %d %b %Y %H:%M:%S GMT'), ''), '</pubDate></item>') AS xml FROM p""",
)
def rss_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One item per story in feed order as an RSS element: the export's fixed-size list."""
    top = newest(spark, sf_dir, EXPORT_ARTICLES)
    order = Window.partitionBy(F.lit(1)).orderBy(*feed_order())
    story = Window.partitionBy(F.coalesce("story_id", "id")).orderBy("pos")
    first = top.withColumn("pos", F.row_number().over(order)).withColumn("k", F.row_number().over(story)).filter("k = 1").orderBy("pos").limit(EXPORT_ITEMS)
    lead = F.when(F.trim(F.coalesce("summary", F.lit(""))) != "", F.concat(F.trim("summary"), F.lit(" "))).otherwise("")
    text = F.concat(lead, F.lit("— "), F.col("source_name"), F.lit(" ("), F.col("source_region"), F.lit(")"))
    xml = F.concat(
        F.lit("<item><title>"), F.coalesce(xml_escape(F.col("title")), F.lit("")), F.lit("</title><link>"), xml_escape(F.col("url")), F.lit("</link><description>"),
        xml_escape(text), F.lit("</description><pubDate>"), rfc822(F.col("published_at")), F.lit("</pubDate></item>"),
    )
    return first.select("id", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("pos")).alias("item_no"), xml.alias("xml"))
