"""Reading single pages: extraction, cache decisions, translation keys, url guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsloom.functions.html_text import clean_html, html_segments, html_text
from newsloom.plans.catalog import query, shared_sql
from newsloom.plans.runtime import table

LEAST_TEXT, MOST_CONTENT, MOST_SEGMENT = 200, 400_000, 8000
# Private and reserved IPv4 networks as (first address, prefix length).
PRIVATE_NETWORKS = (("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15))
# Blocked IPv6 addresses and prefixes, internal host endings.
BLOCKED_IPV6, BLOCKED_IPV6_PREFIXES, INTERNAL_ENDINGS = ("::1", "::"), ("fe80", "fc", "fd"), (".local", ".internal")


def pages(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Stored pages."""
    return table(spark, sf_dir, "article_content").select(*columns)


@query(
    "extract_pages",
    f"""WITH t AS (SELECT url, title, site_name, trim(regexp_replace(regexp_replace(content, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM article_content),
          a AS (SELECT url, min(title) AS feed_title FROM articles GROUP BY url)
        SELECT t.url, coalesce(nullif(trim(t.title), ''), a.feed_title) AS display_title, CAST(length(text) AS INTEGER) AS chars, length(text) >= {LEAST_TEXT} AS usable FROM t LEFT JOIN a ON a.url = t.url""",
)
def extract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of each page without markup, whether there is enough of it, and the title to show."""
    text = F.trim(F.regexp_replace(F.regexp_replace("content", "<[^>]*>", " "), "\\s+", " "))
    t = pages(spark, sf_dir, "url", "title", "content").select("url", "title", F.char_length(text).alias("chars"))
    a = table(spark, sf_dir, "articles").select(F.col("url").alias("a_url"), "title").groupBy("a_url").agg(F.min("title").alias("feed_title"))
    joined = t.join(a, F.col("url") == F.col("a_url"), "left")
    return joined.select("url", F.coalesce(F.nullif(F.trim("title"), F.lit("")), "feed_title").alias("display_title"), "chars", (F.col("chars") >= LEAST_TEXT).alias("usable"))


@query("clean_html")
def clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with safe elements, attributes and absolute urls only."""
    return pages(spark, sf_dir, "url", "content").select("url", clean_html("content", "url").alias("html"))


@query("html_text")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of the outermost blocks of each page."""
    return pages(spark, sf_dir, "url", "content").select("url", html_text("content").alias("text"))


@query("html_segments")
def page_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text nodes of each page in order, as one translation request carries them."""
    return pages(spark, sf_dir, "url", "content").select("url", F.posexplode(html_segments("content")).alias("seg_no", "segment"))


shared_sql(
    "reader_decision",
    f"""WITH now AS (SELECT max(MS(fetched_at)) AS t FROM articles), k AS (SELECT DISTINCT url FROM articles), c AS (SELECT url, max(MS(fetched_at)) AS cached FROM article_content GROUP BY url)
        SELECT f.id, CASE WHEN f.url IS NULL OR trim(f.url) = '' THEN '400' WHEN k.url IS NULL THEN '404' WHEN c.cached IS NULL THEN 'extract' WHEN t - c.cached < 86400000 THEN 'fresh' ELSE 'refresh' END AS decision
        FROM feed_items f CROSS JOIN now LEFT JOIN k ON k.url = f.url LEFT JOIN c ON c.url = f.url""",
)
shared_sql(
    "reader_cache",
    f"""WITH n AS (SELECT url, max(MS(fetched_at)) AS fetched_ms, max(CODE_POINTS(content)) AS chars FROM article_content WHERE content <> '' GROUP BY url)
        SELECT url, fetched_ms, CAST(chars AS BIGINT) AS chars FROM n WHERE chars <= {MOST_CONTENT} AND chars >= {LEAST_TEXT}""",
)
shared_sql(
    "translate_decision",
    """SELECT DISTINCT id, CASE WHEN source_lang IS NULL OR source_lang = '' THEN 'detect' WHEN source_lang NOT IN ('en', 'fr', 'de', 'es', 'pt', 'tr', 'ru', 'uk', 'ar', 'fa', 'he', 'zh', 'ja', 'hi') THEN '400'
                  WHEN source_lang = 'en' THEN 'same' WHEN CODE_POINTS(coalesce(summary, '')) = 0 THEN 'legacy' ELSE 'segments' END AS decision FROM articles""",
)


@query(
    "translation_cache_key",
    "SELECT DISTINCT id, sha256(concat_ws(chr(31), title, coalesce(summary, ''))) AS key_en, sha256(concat_ws(chr(31), 'de', title, coalesce(summary, ''))) AS key_de FROM articles WHERE title IS NOT NULL",
)
def translation_cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of stored translations: the English one leaves the target out."""
    rows = table(spark, sf_dir, "articles").select("id", "title", "summary").filter("title is not null").dropDuplicates(["id"])
    body = F.coalesce("summary", F.lit(""))
    return rows.select("id", F.sha2(F.concat_ws("\x1f", "title", body), 256).alias("key_en"), F.sha2(F.concat_ws("\x1f", F.lit("de"), "title", body), 256).alias("key_de"))


@query(
    "segment_merge",
    f"""WITH s AS (SELECT url, unnest(string_split(content, chr(10))) AS seg FROM article_content),
          c AS (SELECT url, sum(CASE WHEN trim(seg) <> '' AND length(seg) <= {MOST_SEGMENT} THEN 1 ELSE 0 END) AS translatable, sum(CASE WHEN trim(seg) <> '' AND length(seg) <= {MOST_SEGMENT} AND seg LIKE '%e%' THEN 1 ELSE 0 END) AS translated FROM s GROUP BY url)
        SELECT url, CAST(translatable AS BIGINT) AS translatable, CAST(translated AS BIGINT) AS translated, translated >= 0.5::DOUBLE * translatable AS accepted FROM c""",
)
def segment_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as segments of a stub translator that knows those with an e: overlong ones are echoed, and less than half translated is refused."""
    segs = pages(spark, sf_dir, "url", "content").select("url", F.split("content", "\n").alias("segs"))
    can = F.filter("segs", lambda x: (F.trim(x) != "") & (F.char_length(x) <= MOST_SEGMENT))
    counts = segs.select("url", F.size(can).cast("bigint").alias("translatable"), F.size(F.filter(can, lambda x: x.contains("e"))).cast("bigint").alias("translated"))
    return counts.select("*", (F.col("translated") >= 0.5 * F.col("translatable")).alias("accepted"))


def ipv4_number(ip: F.Column) -> F.Column:
    """An IPv4 address as a number; null where it is none."""
    octets = F.split(ip, "\\.")
    fits = ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    number = sum((F.try_element_at(octets, F.lit(i + 1)).try_cast("bigint") * (256 ** (3 - i)) for i in range(4)), F.lit(0).cast("bigint"))
    small = F.forall(octets, lambda o: F.coalesce(o.try_cast("int"), F.lit(999)) < 256)
    return F.when(fits & small, number)


def is_private_ipv4(ip: F.Column) -> F.Column:
    """Whether an address lies in a private or reserved network; false for what is no address."""
    number = ipv4_number(ip)
    inside = F.lit(False)
    for first, bits in PRIVATE_NETWORKS:
        start = sum(int(o) * 256 ** (3 - i) for i, o in enumerate(first.split(".")))
        inside = inside | ((number >= start) & (number < start + 2 ** (32 - bits)))
    return F.coalesce(inside, F.lit(False))


def url_allowed(url: F.Column) -> F.Column:
    """Whether a page may be fetched: http(s), a public host, no literal or internal address."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    blocked = host.isin("", "localhost") | host.rlike(r"(\.local|\.internal|\.localhost|\.home|\.lan)$") | host.startswith("[") | ~host.contains(".") | host.rlike(r"^[0-9.]+$")
    return F.coalesce(scheme.isin("http", "https") & ~blocked, F.lit(False))


def is_blocked_ipv6(ip: F.Column) -> F.Column:
    """Whether an IPv6 address is loopback, unspecified, link-local or private."""
    low = F.lower(ip)
    inside = low.isin(*BLOCKED_IPV6)
    for prefix in BLOCKED_IPV6_PREFIXES:
        inside = inside | low.startswith(prefix)
    return F.coalesce(inside, F.lit(False))


def page_allowed(url: F.Column) -> F.Column:
    """Whether the reader may fetch a page: http(s), no internal host, and of literal addresses the public ones.

    A name is allowed here; what it resolves to is tested by ``is_private_ipv4``
    and ``is_blocked_ipv6``, for every redirect again.
    """
    parts = r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)"
    host = F.lower(F.regexp_extract(url, parts, 2))
    bare = F.regexp_replace(host, r"[\[\]]", "")
    internal = (host == "") | (host == "localhost")
    for ending in INTERNAL_ENDINGS:
        internal = internal | host.endswith(ending)
    literal = F.when(host.startswith("["), ~is_blocked_ipv6(bare)).when(host.rlike(r"^\d+(\.\d+){3}$"), ~is_private_ipv4(host)).otherwise(F.lit(True))
    return F.coalesce(F.lower(F.regexp_extract(url, parts, 1)).isin("http", "https") & ~internal & literal, F.lit(False))


_V6 = "concat(substr('0123456789abcdef', 1 + CAST(event_id // 4096 % 16 AS INT), 1), substr('0123456789abcdef', 1 + CAST(event_id // 256 % 16 AS INT), 1), substr('0123456789abcdef', 1 + CAST(event_id // 16 % 16 AS INT), 1), '0::1')"


@query("ipv6_guard", f"SELECT event_id, starts_with(ip, 'fe80') OR starts_with(ip, 'fc') OR starts_with(ip, 'fd') AS blocked FROM (SELECT event_id, {_V6} AS ip FROM events) e")
def ipv6_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IPv6 addresses of all leading digits against the blocked prefixes, as hosts of urls."""
    url = F.expr(f"concat('https://[', {_V6.replace('//', 'div')}, ']/')")
    return table(spark, sf_dir, "events").select("event_id", (~page_allowed(url)).alias("blocked"))


_NUM = "(event_id * 429497 + 12345) % 4294967296"
_RANGES = " OR ".join(f"n BETWEEN {(s := sum(int(o) * 256 ** (3 - i) for i, o in enumerate(a.split('.'))))} AND {s + 2 ** (32 - b) - 1}" for a, b in PRIVATE_NETWORKS)


@query("url_guard", f"SELECT event_id, CAST(n AS BIGINT) AS number, ({_RANGES}) AS private FROM (SELECT event_id, {_NUM} AS n FROM events) e")
def url_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses spread over all of IPv4, as text, read back and held against the private networks."""
    n = F.expr(_NUM)
    ip = F.concat_ws(".", *((F.shiftright(n.cast("bigint"), 8 * i) % 256).cast("string") for i in (3, 2, 1, 0)))
    return table(spark, sf_dir, "events").select("event_id", ip.alias("ip")).select("event_id", ipv4_number(F.col("ip")).alias("number"), is_private_ipv4(F.col("ip")).alias("private"))


@query("url_allowed", "SELECT id, coalesce(regexp_matches(lower(url), '^https?://[^/?#:@]*\\.[^/?#:@]*(:[0-9]*)?([/?#]|$)'), false) AS allowed FROM feed_items")
def urls_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each item's url may be fetched."""
    return table(spark, sf_dir, "feed_items").select("id", url_allowed(F.col("url")).alias("allowed"))
