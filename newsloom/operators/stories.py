"""Stories: grouping, copies of wire reports, timelines, counters, rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from newsloom.operators.feed import articles, boot, feed_order
from newsloom.plans.catalog import query, shared_sql
from newsloom.plans.runtime import table


def story() -> F.Column:
    """An article's story, or the article itself."""
    return F.coalesce("story_id", "id")


_A = "SELECT DISTINCT id, title, published_at, fetched_at, source_name, source_region, source_lang, body_hash, coalesce(story_id, id) AS story FROM articles"


# Hours and rows of the trending scan, ages in ms of top stories, of what counts as new, and of a breaking story's first report.
TRENDING_HOURS, TRENDING_ROWS, TOP_MS, NEW_MS, BREAKING_MS = 4, 500, 3_600_000, 1_800_000, 5_400_000

#: The moment that the registered queries take as now: the last fetch of an article within an hour of its publication (some are fetched days late).
_NOW = "SELECT max(MS(fetched_at)) AS t FROM articles WHERE MS(fetched_at) - MS(published_at) BETWEEN 0 AND 3600000"


def now_ms(spark: SparkSession, sf_dir: str) -> int | None:
    """The registered queries' now; one value."""
    late = F.unix_millis("fetched_at") - F.unix_millis("published_at")
    return table(spark, sf_dir, "articles").filter(late.between(0, 3_600_000)).agg(F.unix_millis(F.max("fetched_at"))).first()[0]


def _age_rank() -> list:
    """Order in which a copy counts as later: publication, undated last, then the feed's own order."""
    return [F.col("published_at").isNull(), F.unix_micros("published_at"), -F.unix_micros("fetched_at"), F.col("id")]


def wire_copies(rows: DataFrame, key: F.Column | None = None) -> DataFrame:
    """``rows`` with ``is_copy``: all but the earliest of the rows with one key and body hash.

    The earliest is found by an aggregate (map-side combined) and joined back,
    so a group of very many copies is never sorted in one task.
    """
    keyed = rows.withColumn("_key", story() if key is None else key).withColumn("_age", F.struct(*_age_rank()))
    hashed = F.col("body_hash").isNotNull() & (F.col("body_hash") != "")
    first = keyed.filter(hashed).groupBy(F.col("_key").alias("_k"), F.col("body_hash").alias("_h")).agg(F.min("_age").alias("_first"))
    joined = keyed.join(first, (F.col("_key") == F.col("_k")) & (F.col("body_hash") == F.col("_h")), "left")
    return joined.withColumn("is_copy", F.coalesce(F.col("_age") != F.col("_first"), F.lit(False))).drop("_key", "_age", "_k", "_h", "_first")


_COPIES = f"""SELECT *, coalesce(body_hash <> '' AND row_number() OVER (PARTITION BY story, body_hash ORDER BY published_at ASC NULLS LAST, fetched_at DESC, id) > 1, false) AS is_copy FROM ({_A}) a"""


@query("wire_duplicates", f"SELECT id, story, body_hash FROM ({_COPIES}) c WHERE is_copy")
def wire_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles that are later copies of a report within their story."""
    rows = articles(spark, sf_dir, "id", "published_at", "fetched_at", "body_hash", "story_id")
    return wire_copies(rows).filter("is_copy").select("id", story().alias("story"), "body_hash")


@query(
    "story_clusters",
    f"""WITH g AS (SELECT story, count(*) AS members, count(DISTINCT source_name) AS sources, count(DISTINCT source_region) AS regions, max(published_at) AS rep_at FROM ({_A}) a GROUP BY story),
          r AS (SELECT story, id, source_region, row_number() OVER (PARTITION BY story ORDER BY published_at DESC NULLS LAST, fetched_at DESC, id) AS k FROM ({_A}) a)
        SELECT g.story, r.id AS rep_id, r.source_region AS rep_region, CAST(members AS BIGINT) AS members, CAST(sources AS BIGINT) AS sources, CAST(regions AS BIGINT) AS regions, MS(rep_at) AS rep_ms
        FROM g JOIN r ON g.story = r.story AND r.k = 1""",
)
def story_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each story with its newest article (undated last, ties by feed order) and its numbers of members, sources and regions."""
    rows = articles(spark, sf_dir, "id", "published_at", "fetched_at", "source_name", "source_region", "story_id")
    newest = F.min(F.struct(F.col("published_at").isNull(), -F.unix_micros("published_at"), -F.unix_micros("fetched_at"), F.col("id").alias("rep_id"), F.col("source_region").alias("rep_region")))
    g = rows.groupBy(story().alias("story")).agg(newest.alias("rep"), F.count(F.lit(1)).alias("members"), F.countDistinct("source_name").alias("sources"), F.countDistinct("source_region").alias("regions"), F.unix_millis(F.max("published_at")).alias("rep_ms"))
    return g.select("story", "rep.rep_id", "rep.rep_region", "members", "sources", "regions", "rep_ms")


@query(
    "story_timeline",
    f"""WITH c AS ({_COPIES}), f AS (SELECT story, min(MS(published_at)) AS first_ms, max(MS(published_at)) AS last_ms, count(DISTINCT source_name) AS sources, count(DISTINCT source_region) AS regions FROM c GROUP BY story),
          o AS (SELECT story, id, row_number() OVER (PARTITION BY story ORDER BY published_at, fetched_at DESC, id) AS k FROM c WHERE published_at IS NOT NULL AND NOT is_copy)
        SELECT c.id, c.story, MS(c.published_at) - f.first_ms AS offset_ms, coalesce(o.k = 1, false) AS is_first, c.is_copy AS is_wire, f.first_ms, f.last_ms, CAST(f.sources AS BIGINT) AS sources, CAST(f.regions AS BIGINT) AS regions
        FROM c JOIN f ON c.story = f.story LEFT JOIN o ON c.story = o.story AND c.id = o.id AND o.k = 1""",
)
def story_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each article's distance from its story's first report, whether it is the first of its own, and the story's span."""
    rows = articles(spark, sf_dir, "id", "published_at", "fetched_at", "source_name", "source_region", "body_hash", "story_id")
    c = wire_copies(rows).withColumn("story", story())
    own = F.when(F.col("published_at").isNotNull() & ~F.col("is_copy"), F.struct(F.unix_micros("published_at"), -F.unix_micros("fetched_at"), F.col("id").alias("id")))
    f = c.groupBy(F.col("story").alias("s")).agg(
        F.unix_millis(F.min("published_at")).alias("first_ms"), F.unix_millis(F.max("published_at")).alias("last_ms"), F.min(own)["id"].alias("first_id"),
        F.countDistinct("source_name").alias("sources"), F.countDistinct("source_region").alias("regions"),
    )
    joined = c.join(f, F.col("story") == F.col("s"))
    return joined.select("id", "story", (F.unix_millis("published_at") - F.col("first_ms")).alias("offset_ms"), F.coalesce(F.col("id") == F.col("first_id"), F.lit(False)).alias("is_first"), F.col("is_copy").alias("is_wire"), "first_ms", "last_ms", "sources", "regions")


_RECENT = f"SELECT a.* FROM ({_A}) a CROSS JOIN ({_NOW}) n WHERE MS(a.published_at) >= n.t - {TRENDING_HOURS * 3_600_000} ORDER BY a.published_at DESC, a.fetched_at DESC NULLS LAST, a.id LIMIT {TRENDING_ROWS}"
_CANDIDATES = f"""SELECT story, CAST(count(DISTINCT CASE WHEN NOT is_copy THEN source_name END) AS BIGINT) AS independent, CAST(count(DISTINCT source_region) AS BIGINT) AS regions, CAST(count(DISTINCT source_lang) AS BIGINT) AS langs, MS(max(published_at)) AS rep_ms
    FROM (SELECT *, coalesce(body_hash <> '' AND row_number() OVER (PARTITION BY story, body_hash ORDER BY published_at ASC NULLS LAST, fetched_at DESC, id) > 1, false) AS is_copy FROM ({_RECENT}) a) c
    GROUP BY story ORDER BY independent DESC, rep_ms DESC NULLS LAST, story LIMIT 20"""


def recent(rows: DataFrame, now: int | None, *, hours: int = TRENDING_HOURS, most: int = TRENDING_ROWS) -> DataFrame:
    """The newest articles of the last hours, in feed order; undated ones are left out."""
    since = F.lit(now).cast("bigint") - hours * 3_600_000
    return rows.filter(F.unix_millis("published_at") >= since).orderBy(*feed_order()).limit(most)


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = articles(spark, sf_dir, "id", "published_at", "fetched_at", "source_name", "source_region", "source_lang", "body_hash", "story_id")
    c = wire_copies(recent(rows, now_ms(spark, sf_dir))).withColumn("story", story())
    g = c.groupBy("story").agg(
        F.countDistinct(F.when(~F.col("is_copy"), F.col("source_name"))).alias("independent"), F.countDistinct("source_region").alias("regions"),
        F.countDistinct("source_lang").alias("langs"), F.unix_millis(F.max("published_at")).alias("rep_ms"),
    )
    return g.orderBy(F.col("independent").desc(), F.col("rep_ms").desc_nulls_last(), "story").limit(20)


@query("trending_candidates", _CANDIDATES)
def trending_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty stories with most independent sources, ties to the newer one."""
    return _candidates(spark, sf_dir)


@query("trending", f"WITH k AS ({_CANDIDATES}), r AS (SELECT *, row_number() OVER (ORDER BY independent DESC, rep_ms DESC NULLS LAST, story) AS n FROM k) SELECT CAST(n - 1 AS INTEGER) AS rank, story, independent FROM r WHERE n <= 3 AND (SELECT count(*) FROM k) >= 3")
def trending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The picks of the default picker (the first three candidates); none while there are fewer than three."""
    k = _candidates(spark, sf_dir)
    one = Window.partitionBy(F.lit(1))
    n = F.row_number().over(one.orderBy(F.col("independent").desc(), F.col("rep_ms").desc_nulls_last(), "story"))
    return k.withColumn("n", n).withColumn("all", F.count(F.lit(1)).over(one)).filter("n <= 3 and all >= 3").select((F.col("n") - 1).alias("rank"), "story", "independent")


@query(
    "trending_log_row",
    f"""WITH k AS ({_CANDIDATES}), r AS (SELECT *, row_number() OVER (ORDER BY independent DESC, rep_ms DESC NULLS LAST, story) - 1 AS n FROM k)
        SELECT coalesce(string_agg(concat(CAST(n AS VARCHAR), ':', story, ':', CAST(independent AS VARCHAR)), '|' ORDER BY n), '') AS picks, CAST(count(*) AS BIGINT) AS n_picks FROM r WHERE n < 3 AND (SELECT count(*) FROM k) >= 3""",
)
def trending_log_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log row with the picks in order."""
    picks = trending(spark, sf_dir).agg(F.array_sort(F.collect_list(F.struct("rank", "story", "independent"))).alias("p"))
    return picks.select(F.concat_ws("|", F.transform("p", lambda x: F.concat_ws(":", x["rank"], x["story"], x["independent"]))).alias("picks"), F.size("p").cast("bigint").alias("n_picks"))


@query(
    "trending_resolve",
    f"""WITH k AS ({_CANDIDATES}), r AS (SELECT story, row_number() OVER (ORDER BY independent DESC, rep_ms DESC NULLS LAST, story) - 1 AS rank FROM k),
          m AS (SELECT DISTINCT coalesce(story_id, id) AS story, id FROM articles)
        SELECT CAST(r.rank AS INTEGER) AS rank, r.story, CAST(count(m.id) AS BIGINT) AS members FROM r JOIN m ON r.story = m.story WHERE r.rank < 3 AND (SELECT count(*) FROM k) >= 3 GROUP BY r.rank, r.story""",
)
def trending_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picks joined to their stories' members."""
    members = articles(spark, sf_dir, "id", "story_id").select(story().alias("story"), "id")
    # three picks: a fixed size
    return members.join(F.broadcast(trending(spark, sf_dir).select("rank", "story")), "story").groupBy("rank", "story").agg(F.count("id").alias("members"))


shared_sql(
    "trending_prompt",
    """WITH now AS (SELECT max(MS(fetched_at)) AS t FROM articles),
            r AS (SELECT coalesce(story_id, id) AS story, max(MS(published_at)) AS rep_ms, count(DISTINCT source_name) AS n FROM articles GROUP BY coalesce(story_id, id))
       SELECT story, concat(CAST(n AS VARCHAR(20)), CASE WHEN n = 1 THEN ' source, ' ELSE ' sources, ' END, CAST(coalesce(CAST(floor((t - rep_ms) / 60000.0 + 0.5) AS BIGINT), 0) AS VARCHAR(20)), ' min ago') AS line
       FROM r CROSS JOIN now""",
)
shared_sql(
    "top_stories",
    f"""WITH now AS ({_NOW}),
             s AS (SELECT coalesce(story_id, id) AS story, max(MS(published_at)) AS rep_ms, count(DISTINCT source_name) AS sources FROM articles GROUP BY coalesce(story_id, id))
        SELECT story, rep_ms, CAST(sources AS BIGINT) AS sources FROM s CROSS JOIN now WHERE t - rep_ms < {TOP_MS} ORDER BY sources DESC, rep_ms DESC, story LIMIT 3""",
)


@query(
    "breaking",
    f"""WITH now AS ({_NOW}),
             s AS (SELECT story, max(MS(published_at)) AS rep_ms, min(MS(published_at)) AS first_ms, count(DISTINCT CASE WHEN NOT is_copy THEN source_name END) AS sources FROM ({_COPIES}) a GROUP BY story)
        SELECT story, CASE WHEN t - rep_ms < {NEW_MS} AND sources >= 3 AND t - coalesce(first_ms, t) < {BREAKING_MS} THEN 'breaking' WHEN t - rep_ms < {NEW_MS} THEN 'new' ELSE 'none' END AS state FROM s CROSS JOIN now""",
)
def breaking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a story breaks (its newest article is new, three sources report it themselves, its first report is not old), is new, or neither."""
    c = wire_copies(articles(spark, sf_dir, "id", "published_at", "fetched_at", "source_name", "body_hash", "story_id")).withColumn("story", story())
    s = c.groupBy("story").agg(F.unix_millis(F.max("published_at")).alias("rep_ms"), F.unix_millis(F.min("published_at")).alias("first_ms"), F.countDistinct(F.when(~F.col("is_copy"), F.col("source_name"))).alias("sources"))
    now = F.lit(now_ms(spark, sf_dir)).cast("bigint")
    fresh = now - F.col("rep_ms") < NEW_MS
    state = F.when(fresh & (F.col("sources") >= 3) & (now - F.coalesce("first_ms", now) < BREAKING_MS), "breaking").when(fresh, "new").otherwise("none")
    return s.select("story", state.alias("state"))


shared_sql(
    "story_counters",
    """SELECT story_id, CAST(count(DISTINCT id) AS BIGINT) AS article_count, CAST(count(DISTINCT source_name) AS BIGINT) AS source_count, CAST(count(DISTINCT source_region) AS BIGINT) AS region_count,
              max(MS(coalesce(published_at, fetched_at))) AS last_article_ms
       FROM articles WHERE story_id IS NOT NULL GROUP BY story_id""",
)
shared_sql(
    "stale_story_counters",
    """WITH c AS (SELECT story_id, count(DISTINCT id) AS n, count(DISTINCT source_name) AS s, count(DISTINCT source_region) AS r FROM articles WHERE story_id IS NOT NULL GROUP BY story_id)
       SELECT t.id, CAST(t.article_count AS BIGINT) AS stored, CAST(coalesce(c.n, 0) AS BIGINT) AS actual FROM stories t LEFT JOIN c ON t.id = c.story_id
       WHERE t.article_count <> coalesce(c.n, 0) OR t.source_count <> coalesce(c.s, 0) OR t.region_count <> coalesce(c.r, 0)""",
)


@query(
    "story_reps",
    "SELECT story_id, id AS rep_id FROM (SELECT story_id, id, row_number() OVER (PARTITION BY story_id ORDER BY published_at ASC NULLS LAST, fetched_at DESC, id) AS k FROM (SELECT DISTINCT id, story_id, published_at, fetched_at FROM articles) a WHERE story_id IS NOT NULL) r WHERE k = 1",
)
def story_reps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each story's earliest published member."""
    rows = articles(spark, sf_dir, "id", "story_id", "published_at", "fetched_at").filter("story_id is not null")
    first = F.min(F.struct(F.col("published_at").isNull(), F.unix_micros("published_at"), -F.unix_micros("fetched_at"), F.col("id").alias("rep_id")))
    return rows.groupBy("story_id").agg(first.alias("r")).select("story_id", "r.rep_id")


#: A log of picks as the registered query makes it: of each hour's articles, the three stories with most sources.
_LOG = """SELECT h, story, article, k - 1 AS rank FROM (SELECT h, story, article, row_number() OVER (PARTITION BY h ORDER BY sources DESC, story) AS k
    FROM (SELECT MS(published_at) // 3600000 AS h, coalesce(story_id, id) AS story, min(id) AS article, count(DISTINCT source_name) AS sources FROM articles WHERE published_at IS NOT NULL GROUP BY 1, 2) s) r WHERE k <= 3"""


def picks_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``logged_h``, ``picks``: one row a run, each with its picks in order."""
    rows = articles(spark, sf_dir, "id", "published_at", "source_name", "story_id").filter("published_at is not null")
    s = rows.groupBy(F.floor(F.unix_millis("published_at") / 3_600_000).alias("logged_h"), story().alias("story")).agg(F.min("id").alias("article"), F.countDistinct("source_name").alias("sources"))
    # the least three of a run by an aggregate that keeps three, not by a sort of the run
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("sources")).alias("d"), "story", "article"))), 1, 3)
    in_parts = s.groupBy("logged_h", F.pmod(F.xxhash64("story"), F.lit(32)).alias("p")).agg(best.alias("b")).select("logged_h", F.explode("b").alias("b"))
    return in_parts.groupBy("logged_h").agg(F.slice(F.array_sort(F.collect_list("b")), 1, 3).alias("picks"))


def highlights_of(log: DataFrame, order_col: str = "logged_h", *, runs: int = 50, most: int = 20) -> DataFrame:
    """``story``, ``id``: the picks of the newest runs, newest run first, each story once, at most ``most``."""
    picked = log.orderBy(F.col(order_col).desc()).limit(runs).select(F.col(order_col).alias("at"), F.posexplode("picks").alias("rank", "p"))
    first = picked.groupBy(F.col("p.story").alias("story")).agg(F.min(F.struct((-F.col("at")).alias("d"), "rank", F.col("p.article").alias("id"))).alias("f"))
    return first.orderBy("f.d", "f.rank").limit(most).select("story", "f.id")


@query(
    "highlights",
    f"""WITH l AS ({_LOG}), n AS (SELECT * FROM l WHERE h IN (SELECT DISTINCT h FROM l ORDER BY h DESC LIMIT 50)),
             f AS (SELECT story, article, h, rank, row_number() OVER (PARTITION BY story ORDER BY h DESC, rank) AS k FROM n)
        SELECT story, article AS id FROM f WHERE k = 1 ORDER BY h DESC, rank LIMIT 20""",
)
def highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last picks, each story once."""
    return highlights_of(picks_log(spark, sf_dir))


shared_sql(
    "story_sessions",
    """WITH d AS (SELECT DISTINCT id, source_region, MS(published_at) AS t FROM articles WHERE published_at IS NOT NULL),
            g AS (SELECT id, source_region, t, CASE WHEN t - lag(t) OVER (PARTITION BY source_region ORDER BY t, id) <= 28800000 THEN 0 ELSE 1 END AS opens FROM d),
            s AS (SELECT id, source_region, t, sum(opens) OVER (PARTITION BY source_region ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS session FROM g)
       SELECT source_region, CAST(session AS BIGINT) AS session, min(t) AS from_ms, max(t) AS to_ms, CAST(count(*) AS BIGINT) AS articles FROM s GROUP BY source_region, session""",
)


@query(
    "title_overlap_pairs",
    """WITH a AS (SELECT DISTINCT id, story_id, translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS title, epoch_ms(published_at) AS t FROM articles WHERE published_at IS NOT NULL AND story_id IS NOT NULL),
          w AS (SELECT id, story_id, t, list_distinct(list_filter(string_split_regex(title, '[^0-9a-z_]+'), lambda x: length(x) >= 3 AND x NOT IN ('the', 'and', 'for', 'that', 'with', 'from'))) AS words FROM a)
        SELECT x.id AS id_a, y.id AS id_b, round(len(list_intersect(x.words, y.words)) / least(len(x.words), len(y.words)), 6) AS overlap FROM w x JOIN w y ON x.story_id = y.story_id AND x.id < y.id
        WHERE abs(x.t - y.t) <= 28800000 AND len(x.words) > 0 AND len(y.words) > 0 AND 10 * len(list_intersect(x.words, y.words)) >= 4 * least(len(x.words), len(y.words))""",
)
def title_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one story within eight hours whose titles share at least 0.4 of the shorter one's words."""
    rows = articles(spark, sf_dir, "id", "story_id", "title", "published_at").filter("published_at is not null and story_id is not null")
    found = F.split(F.translate("title", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^0-9a-z_]+")
    kept = F.array_distinct(F.filter(found, lambda x: (F.char_length(x) >= 3) & ~x.isin("the", "and", "for", "that", "with", "from")))
    w = rows.select("id", "story_id", F.unix_millis("published_at").alias("t"), F.floor(F.unix_millis("published_at") / 28_800_000).alias("slot"), kept.alias("words"))
    # eight-hour slots make the band an equi-join: each row meets its own slot and the next
    x = w.withColumn("slot", F.explode(F.array(F.col("slot") - 1, F.col("slot"), F.col("slot") + 1))).select(*(F.col(c).alias(f"x_{c}") for c in w.columns))
    same = (F.col("x_story_id") == F.col("story_id")) & (F.col("x_slot") == F.col("slot"))
    shorter = F.least(F.size("x_words"), F.size("words"))
    shared = F.size(F.array_intersect("x_words", "words"))
    pairs = x.join(w, same).filter((F.col("x_id") < F.col("id")) & (F.abs(F.col("x_t") - F.col("t")) <= 28_800_000) & (shorter > 0) & (10 * shared >= 4 * shorter))
    return pairs.select(F.col("x_id").alias("id_a"), F.col("id").alias("id_b"), F.round(shared / shorter, 6).alias("overlap"))
