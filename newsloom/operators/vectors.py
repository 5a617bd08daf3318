"""Vectors of articles: similarity in time bands, centroids, calibration, story assignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from newsloom.functions.vectors import cosine
from newsloom.operators.components import component_labels
from newsloom.operators.feed import articles
from newsloom.plans.catalog import query, shared_sql
from newsloom.plans.runtime import park, table

MODEL = "newsvec-s768@r3"
# Similarity that joins a story, hours to its last article and to its first, band around the threshold that people look at,
# floors of the sweep in thousandths, floors by language, levels at which the shadow verdict is held against the classifier.
THRESHOLD, HOURS, MOST_AGE_HOURS, BAND = 0.83, 8, 72, 0.03
FLOORS, LANGUAGE_FLOORS, SHADOW_LEVELS = range(780, 861, 5), (0.79, 0.795, 0.80, 0.81), (0.84, 0.85, 0.86, 0.87, 0.88)
_HOUR_MS = 3_600_000
#: Rows of one time slot that one task compares.
BLOCK = 8000


def embedded(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Articles with a usable vector of the standard model, and the columns asked for."""
    e = table(spark, sf_dir, "article_embeddings").filter((F.col("model") == MODEL) & F.col("embedding").isNotNull())
    e = e.filter(F.exists("embedding", lambda x: x != 0)).select(F.col("article_id").alias("id"), "embedding").dropDuplicates(["id"])
    return e.join(articles(spark, sf_dir, "id", *columns), "id") if columns else e


def in_band(left: DataFrame, right: DataFrame, hours: float, left_t: str, right_t: str) -> DataFrame:
    """Pairs with times no more than ``hours`` apart: an equi-join on time slots, then the exact band."""
    width = int(hours * _HOUR_MS)
    x = left.withColumn("_slot", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col(left_t) / width) + d)))
    y = right.withColumn("_slot2", F.floor(F.col(right_t) / width))
    return x.join(y, (F.col("_slot") == F.col("_slot2")) & (F.abs(F.col(left_t) - F.col(right_t)) <= width)).drop("_slot", "_slot2")


_E = f"""SELECT e.article_id AS id, any_value(e.embedding)::DOUBLE[] AS v, any_value(epoch_ms(a.published_at)) AS t, any_value(a.story_id) AS story_id, any_value(a.source_lang) AS lang, any_value(epoch_ms(a.fetched_at)) AS f
    FROM article_embeddings e JOIN articles a ON a.id = e.article_id WHERE e.model = '{MODEL}' AND e.embedding IS NOT NULL AND len(list_filter(e.embedding, lambda x: x <> 0)) > 0 GROUP BY e.article_id"""
_REPS = f"""SELECT story_id, id AS rep_id, v AS rv, t AS rt, lang AS rlang FROM (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY t, id) AS k FROM ({_E}) e WHERE story_id IS NOT NULL AND t IS NOT NULL) r WHERE k = 1"""


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embedded(spark, sf_dir, "published_at", "story_id", "source_lang").filter("published_at is not null")
    return rows.select("id", "embedding", F.unix_millis("published_at").alias("t"), "story_id", F.col("source_lang").alias("lang"))


def _reps(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _members(spark, sf_dir).filter("story_id is not null")
    first = m.groupBy("story_id").agg(F.min(F.struct("t", "id")).alias("f")).select(F.col("f.id").alias("id"))
    return m.join(first, "id").select(F.col("story_id").alias("rep_story"), F.col("id").alias("rep_id"), F.col("embedding").alias("rep_v"), F.col("t").alias("rep_t"), F.col("lang").alias("rep_lang"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = in_band(_members(spark, sf_dir), _reps(spark, sf_dir), HOURS, "t", "rep_t").filter("id <> rep_id")
    return p.select("id", "story_id", "lang", "rep_id", "rep_story", "rep_lang", F.round(cosine("embedding", "rep_v"), 6).alias("sim"))


_PAIRS = f"""SELECT m.id, m.story_id, m.lang, r.rep_id, r.story_id AS rep_story, r.rlang AS rep_lang, round(list_cosine_similarity(m.v, r.rv), 6) AS sim FROM ({_E}) m JOIN ({_REPS}) r ON abs(m.t - r.rt) <= {HOURS * _HOUR_MS} AND m.id <> r.rep_id"""


@query("cosine_pairs", f"SELECT x.id AS id_a, y.id AS id_b, round(list_cosine_similarity(x.v, y.v), 6) AS sim FROM ({_E}) x JOIN ({_E}) y ON x.story_id = y.story_id AND x.id < y.id")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine similarity of the articles of one story."""
    x = embedded(spark, sf_dir, "story_id").filter("story_id is not null")
    y = x.select(F.col("id").alias("id_b"), F.col("embedding").alias("v_b"), F.col("story_id").alias("s_b"))
    return x.join(y, (F.col("story_id") == F.col("s_b")) & (F.col("id") < F.col("id_b"))).select(F.col("id").alias("id_a"), "id_b", F.round(cosine("embedding", "v_b"), 6).alias("sim"))


_NEAREST = f"""WITH e AS ({_E}), r AS (SELECT s.id AS story, s.rep_article_id AS rep_id, epoch_ms(s.created_at) AS created, epoch_ms(s.last_article_at) AS last, e.v AS rv FROM stories s JOIN e ON e.id = s.rep_article_id),
    p AS (SELECT e.id, r.story, r.rep_id, r.created, round(list_cosine_similarity(e.v, r.rv), 6) AS sim FROM e JOIN r ON abs(r.last - e.t) <= {HOURS * _HOUR_MS} AND r.created > e.t - {MOST_AGE_HOURS * _HOUR_MS} AND r.rep_id <> e.id)
    SELECT id, story, rep_id, sim FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, created, story) AS k FROM p) q WHERE k = 1"""


@query("nearest_rep", _NEAREST)
def nearest_rep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the stored stories that an article may join, the one whose representative is most similar.

    May join: the last article within eight hours of the article's own time,
    the story created less than 72 hours before it, the representative another
    article.  Ties go to the older story, then to the smaller id.
    """
    reps = table(spark, sf_dir, "stories").select(F.col("id").alias("story"), F.col("rep_article_id").alias("rep_id"), F.unix_millis("created_at").alias("created"), F.unix_millis("last_article_at").alias("last"))
    reps = reps.join(embedded(spark, sf_dir).select(F.col("id").alias("rep_id"), F.col("embedding").alias("rv")), "rep_id")
    near = in_band(_members(spark, sf_dir).select("id", "embedding", "t"), reps, HOURS, "t", "last")
    near = near.filter((F.col("created") > F.col("t") - MOST_AGE_HOURS * _HOUR_MS) & (F.col("rep_id") != F.col("id")))
    best = near.groupBy("id").agg(F.min(F.struct((-F.round(cosine("embedding", "rv"), 6)).alias("d"), "created", "story", "rep_id")).alias("b"))
    return best.select("id", "b.story", "b.rep_id", (-F.col("b.d")).alias("sim"))


@query("calib_pairs", f"SELECT id, rep_id, sim, coalesce(story_id = rep_story, false) AS same_story FROM ({_PAIRS}) p")
def calib_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles against representatives within eight hours, with whether they are of one story."""
    return _pairs(spark, sf_dir).select("id", "rep_id", "sim", F.coalesce(F.col("story_id") == F.col("rep_story"), F.lit(False)).alias("same_story"))


@query(
    "calib_sweep",
    f"""WITH p AS (SELECT sim, coalesce(story_id = rep_story, false) AS pos FROM ({_PAIRS}) p), t AS (SELECT unnest(range(800, 961, 5)) / 1000.0::DOUBLE AS t)
        SELECT t.t AS threshold, round(sum(CASE WHEN pos AND sim >= t.t THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN pos THEN 1 ELSE 0 END), 0), 6) AS recall, round(sum(CASE WHEN NOT pos AND sim >= t.t THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN NOT pos THEN 1 ELSE 0 END), 0), 6) AS false_merge FROM p, t GROUP BY t.t""",
)
def calib_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall and false merges at thresholds from 0.80 to 0.96."""
    # counted once per similarity step, so the sweep multiplies a small histogram and not the pairs
    pos = F.coalesce(F.col("story_id") == F.col("rep_story"), F.lit(False))
    h = _pairs(spark, sf_dir).groupBy("sim", pos.alias("pos")).agg(F.count(F.lit(1)).alias("n"))
    t = h.withColumn("threshold", F.explode(F.sequence(F.lit(800), F.lit(960), F.lit(5)))).withColumn("threshold", F.col("threshold") / 1000.0)
    share = lambda p: F.round(F.sum(F.when(p & (F.col("sim") >= F.col("threshold")), F.col("n")).otherwise(0)) / F.nullif(F.sum(F.when(p, F.col("n")).otherwise(0)), F.lit(0)), 6)
    return t.groupBy("threshold").agg(share(F.col("pos")).alias("recall"), share(~F.col("pos")).alias("false_merge"))


@query(
    "calib_margin",
    f"""SELECT id, round(max(CASE WHEN k = 1 THEN sim END) - max(CASE WHEN k = 2 THEN sim END), 6) AS margin FROM (SELECT id, sim, row_number() OVER (PARTITION BY id ORDER BY sim DESC, rep_id) AS k FROM ({_PAIRS}) p) q WHERE k <= 2 GROUP BY id""",
)
def calib_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the most similar representative of an article lies before the next one."""
    order = Window.partitionBy("id").orderBy(F.col("sim").desc(), "rep_id")
    k = _pairs(spark, sf_dir).select("id", "sim", F.row_number().over(order).alias("k")).filter("k <= 2")
    return k.groupBy("id").agg(F.round(F.max(F.when(F.col("k") == 1, F.col("sim"))) - F.max(F.when(F.col("k") == 2, F.col("sim"))), 6).alias("margin"))


@query(
    "calib_lang_pairs",
    f"""SELECT least(lang, rep_lang) AS lang_a, greatest(lang, rep_lang) AS lang_b, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN story_id = rep_story THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS same_share, round(quantile_cont(sim, 0.5), 6) AS p50
        FROM ({_PAIRS}) p WHERE lang IS NOT NULL AND rep_lang IS NOT NULL GROUP BY 1, 2""",
)
def calib_lang_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by their two languages, order of languages aside."""
    p = _pairs(spark, sf_dir).filter("lang is not null and rep_lang is not null")
    same = F.when(F.col("story_id") == F.col("rep_story"), 1.0).otherwise(0.0)
    return p.groupBy(F.least("lang", "rep_lang").alias("lang_a"), F.greatest("lang", "rep_lang").alias("lang_b")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(same), 6).alias("same_share"), F.round(F.percentile("sim", 0.5), 6).alias("p50"))


@query("calib_band", f"SELECT id, rep_id, sim FROM ({_PAIRS}) p WHERE abs(sim - {THRESHOLD}) <= {BAND} ORDER BY (lang IS DISTINCT FROM rep_lang) DESC, sim DESC, id, rep_id LIMIT 40")
def calib_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forty pairs next to the threshold, across languages first: a list for people to look at."""
    cross_lang = (~F.col("lang").eqNullSafe(F.col("rep_lang"))).desc()
    return _pairs(spark, sf_dir).filter(F.abs(F.col("sim") - F.lit(THRESHOLD)) <= BAND).orderBy(cross_lang, F.col("sim").desc(), "id", "rep_id").limit(40).select("id", "rep_id", "sim")


@query("calib_audit", f"SELECT id, rep_id, sim FROM ({_PAIRS}) p WHERE story_id = rep_story ORDER BY sim, id, rep_id LIMIT 30")
def calib_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirty least similar pairs of one story: a list for people to look at."""
    return _pairs(spark, sf_dir).filter("story_id = rep_story").orderBy("sim", "id", "rep_id").limit(30).select("id", "rep_id", "sim")


@query(
    "calib_sim_assign",
    f"""WITH p AS ({_PAIRS}), own AS (SELECT DISTINCT id FROM p WHERE story_id = rep_story), b AS (SELECT p.*, row_number() OVER (PARTITION BY p.id ORDER BY sim DESC, rep_id) AS k FROM p JOIN own ON own.id = p.id)
        SELECT CAST(count(*) AS BIGINT) AS items, round(avg(CASE WHEN story_id = rep_story THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS agreement FROM b WHERE k = 1""",
)
def calib_sim_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the most similar representative is that of the article's own story, where that one is in the window."""
    p = _pairs(spark, sf_dir)
    best = F.min(F.struct((-F.col("sim")).alias("d"), "rep_id", (F.col("story_id") == F.col("rep_story")).alias("same")))
    b = p.groupBy("id").agg(best.alias("b"), F.max(F.coalesce(F.col("story_id") == F.col("rep_story"), F.lit(False))).alias("own")).filter("own")
    return b.agg(F.count(F.lit(1)).alias("items"), F.round(F.avg(F.when(F.col("b.same"), 1.0).otherwise(0.0)), 6).alias("agreement"))


_CENTROID = f"SELECT i AS place, avg(v[i]) AS mean FROM ({_E}) e, (SELECT unnest(range(1, 769)) AS i) n WHERE f >= (SELECT max(epoch_ms(fetched_at)) FROM articles) - 14 * 86400000 GROUP BY i"


def centroid(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """``place`` (from 1), ``mean``: the mean vector, summed in each task before anything is shuffled."""
    width = "place int, total double, n long"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, int]] = {}
        for batch in batches:
            for v in batch.column(0).to_pylist():
                if v:
                    total, n = sums.get(len(v), (np.zeros(len(v)), 0))
                    sums[len(v)] = (total + np.asarray(v, np.float64), n + 1)
        for total, n in sums.values():
            yield pa.RecordBatch.from_arrays([pa.array(range(1, len(total) + 1), pa.int32()), pa.array(total), pa.array([n] * len(total), pa.int64())], names=["place", "total", "n"])

    return vectors.select(vector_col).mapInArrow(add, width).groupBy("place").agg((F.sum("total") / F.sum("n")).alias("mean"))


def _recent_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a single value, not a product of tables
    since = articles(spark, sf_dir, "fetched_at").agg((F.unix_millis(F.max("fetched_at")) - 14 * 24 * _HOUR_MS).alias("since"))
    recent = embedded(spark, sf_dir, "fetched_at").crossJoin(since).filter(F.unix_millis("fetched_at") >= F.col("since"))
    return centroid(recent)


@query("relevant_centroid", f"SELECT CAST(place AS INTEGER) AS place, round(mean, 6) AS mean FROM ({_CENTROID}) c")
def relevant_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector of the articles fetched in the last fourteen days; not of unit length."""
    return _recent_centroid(spark, sf_dir).select("place", F.round("mean", 6).alias("mean"))


_SHADOW = f"""WITH c AS (SELECT list(mean ORDER BY place) AS cv FROM ({_CENTROID}) x) SELECT id, lang, list_cosine_similarity(v, cv) AS sim, CAST(substr(id, 3) AS BIGINT) % 3 <> 0 AS accepted FROM ({_E}) e, c"""


def _shadow(spark: SparkSession, sf_dir: str) -> DataFrame:
    # one row: the centroid of one model
    c = _recent_centroid(spark, sf_dir).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "mean"))), lambda x: x["mean"]).alias("cv"))
    return embedded(spark, sf_dir, "source_lang").crossJoin(F.broadcast(c)).select("id", F.col("source_lang").alias("lang"), cosine("embedding", "cv").alias("sim"), (F.substring("id", 3, 20).cast("bigint") % 3 != 0).alias("accepted"))


_AGREE = ", ".join(f"round(avg(CASE WHEN (sim >= {t}) = accepted THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 3) AS agreement_{round(100 * t)}" for t in SHADOW_LEVELS)


@query("shadow_stats", f"SELECT accepted, CAST(count(*) AS BIGINT) AS n, round(quantile_cont(sim, 0.1), 4) AS p10, round(quantile_cont(sim, 0.5), 4) AS p50, round(quantile_cont(sim, 0.9), 4) AS p90, {_AGREE} FROM ({_SHADOW}) s GROUP BY accepted")
def shadow_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity to the centroid by verdict of the stub classifier, and agreement of five levels with it."""
    p = lambda q: F.round(F.percentile("sim", q), 4)
    agree = [F.round(F.avg(F.when((F.col("sim") >= t) == F.col("accepted"), 1.0).otherwise(0.0)), 3).alias(f"agreement_{round(100 * t)}") for t in SHADOW_LEVELS]
    return _shadow(spark, sf_dir).groupBy("accepted").agg(F.count(F.lit(1)).alias("n"), p(0.1).alias("p10"), p(0.5).alias("p50"), p(0.9).alias("p90"), *agree)


@query("pct_linear", f"SELECT accepted, round(quantile_cont(sim, 0.25), 6) AS p25, round(quantile_cont(sim, 0.75), 6) AS p75 FROM ({_SHADOW}) s GROUP BY accepted")
def pct_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles by linear interpolation."""
    return _shadow(spark, sf_dir).groupBy("accepted").agg(F.round(F.percentile("sim", 0.25), 6).alias("p25"), F.round(F.percentile("sim", 0.75), 6).alias("p75"))


@query(
    "pct_nearest",
    f"""WITH s AS (SELECT accepted, sim, row_number() OVER (PARTITION BY accepted ORDER BY sim, id) - 1 AS k, count(*) OVER (PARTITION BY accepted) AS n FROM ({_SHADOW}) x)
        SELECT accepted, round(max(CASE WHEN k = least(n - 1, CAST(floor(0.1 * n) AS BIGINT)) THEN sim END), 4) AS p10, round(max(CASE WHEN k = least(n - 1, CAST(floor(0.5 * n) AS BIGINT)) THEN sim END), 4) AS p50 FROM s GROUP BY accepted""",
)
def pct_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The element at floor(p n), no interpolation."""
    s = park(_shadow(spark, sf_dir), "shadow")
    # a value's place is its cumulative count, so no group is sorted in one task
    h = s.groupBy("accepted", "sim").agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy("accepted").orderBy("sim")
    h = h.withColumn("last", F.sum("c").over(upto)).withColumn("n", F.sum("c").over(Window.partitionBy("accepted")))

    def at(p: float) -> F.Column:
        place = F.least(F.col("n") - 1, F.floor(F.lit(p) * F.col("n")).cast("bigint"))
        return F.round(F.max(F.when((place < F.col("last")) & (place >= F.col("last") - F.col("c")), F.col("sim"))), 4)

    return h.groupBy("accepted").agg(at(0.1).alias("p10"), at(0.5).alias("p50"))


_LEVELS = (0.0, 0.005, 0.01, 0.02, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9)


@query("calib_percentiles", f"SELECT l AS level, accepted, round(quantile_cont(sim, {list(_LEVELS)})[i], 6) AS value FROM ({_SHADOW}) s, (SELECT unnest(range(1, 11)) AS i, unnest({list(_LEVELS)})::DOUBLE AS l) n GROUP BY l, i, accepted")
def calib_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten levels of the similarity to the centroid by verdict."""
    p = _shadow(spark, sf_dir).groupBy("accepted").agg(F.percentile("sim", F.array(*(F.lit(x) for x in _LEVELS))).alias("v"))
    return p.select("accepted", F.posexplode("v").alias("i", "value")).select(F.element_at(F.array(*(F.lit(x) for x in _LEVELS)), F.col("i") + 1).alias("level"), "accepted", F.round("value", 6).alias("value"))


@query(
    "calib_floor",
    f"""WITH s AS ({_SHADOW}), f AS (SELECT quantile_cont(sim, 0.005) AS floor FROM s WHERE accepted) SELECT round(any_value(floor), 6) AS floor, CAST(sum(CASE WHEN NOT accepted AND sim < floor THEN 1 ELSE 0 END) AS BIGINT) AS negatives_below FROM s, f""",
)
def calib_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest floor that loses 0.5 % of the accepted, and how many rejected lie below it."""
    s = park(_shadow(spark, sf_dir), "shadow")
    f = s.filter("accepted").agg(F.percentile("sim", 0.005).alias("floor"))
    return s.crossJoin(F.broadcast(f)).agg(F.round(F.max("floor"), 6).alias("floor"), F.sum(F.when(~F.col("accepted") & (F.col("sim") < F.col("floor")), 1).otherwise(0)).alias("negatives_below"))


@query(
    "calib_floor_sweep",
    f"""WITH s AS ({_SHADOW}), t AS (SELECT unnest({[f / 1000 for f in FLOORS]})::DOUBLE AS t),
             c AS (SELECT t.t AS floor, CAST(sum(CASE WHEN accepted AND sim < t.t THEN 1 ELSE 0 END) AS BIGINT) AS lost, CAST(sum(CASE WHEN NOT accepted AND sim < t.t THEN 1 ELSE 0 END) AS BIGINT) AS saved, sum(CASE WHEN accepted THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN accepted THEN 0 ELSE 1 END) AS neg FROM s, t GROUP BY t.t)
        SELECT floor, lost, saved, round(100.0::DOUBLE * lost / nullif(pos, 0), 4) AS lost_pct, round(100.0::DOUBLE * saved / nullif(neg, 0), 4) AS saved_pct, coalesce(100.0::DOUBLE * lost / nullif(pos, 0) > 0.5, false) AS flagged FROM c""",
)
def calib_floor_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted and rejected below each of a series of floors, with shares; floors that lose more than 0.5 % are flagged.

    Rows are counted by the floors they pass, so the sweep multiplies eighteen counts and not the rows.
    """
    floors = F.array(*(F.lit(f / 1000) for f in FLOORS))
    steps = _shadow(spark, sf_dir).groupBy(F.size(F.filter(floors, lambda f: F.col("sim") >= f)).alias("passed")).agg(F.count_if("accepted").alias("pos"), F.count_if(~F.col("accepted")).alias("neg"))
    below = steps.select("passed", "pos", "neg", F.posexplode(floors).alias("i", "floor")).groupBy("floor").agg(
        F.sum(F.when(F.col("passed") <= F.col("i"), F.col("pos")).otherwise(0)).alias("lost"), F.sum(F.when(F.col("passed") <= F.col("i"), F.col("neg")).otherwise(0)).alias("saved"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    lost, saved = (100.0 * F.col(a) / F.nullif(F.col(b), F.lit(0)) for a, b in (("lost", "pos"), ("saved", "neg")))
    return below.select("floor", "lost", "saved", F.round(lost, 4).alias("lost_pct"), F.round(saved, 4).alias("saved_pct"), F.coalesce(lost > 0.5, F.lit(False)).alias("flagged"))


_LANGUAGE_REJECTS = ", ".join(f"round(avg(CASE WHEN sim < {f} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS below_{round(1000 * f)}" for f in LANGUAGE_FLOORS)


@query("calib_lang_floors", f"SELECT lang, accepted, CAST(count(*) AS BIGINT) AS n, round(quantile_cont(sim, 0.01), 6) AS p1, round(quantile_cont(sim, 0.05), 6) AS p5, round(quantile_cont(sim, 0.1), 6) AS p10, round(quantile_cont(sim, 0.5), 6) AS p50, {_LANGUAGE_REJECTS} FROM ({_SHADOW}) s GROUP BY lang, accepted HAVING count(*) >= 20")
def calib_lang_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies below four floors by language and verdict, where there are twenty and more."""
    p = lambda q, name: F.round(F.percentile("sim", q), 6).alias(name)
    below = [F.round(F.avg(F.when(F.col("sim") < f, 1.0).otherwise(0.0)), 6).alias(f"below_{round(1000 * f)}") for f in LANGUAGE_FLOORS]
    return _shadow(spark, sf_dir).groupBy("lang", "accepted").agg(F.count(F.lit(1)).alias("n"), p(0.01, "p1"), p(0.05, "p5"), p(0.1, "p10"), p(0.5, "p50"), *below).filter("n >= 20")


shared_sql("missing_embeddings", "SELECT DISTINCT a.id FROM articles a WHERE NOT EXISTS (SELECT 1 FROM article_embeddings e WHERE e.article_id = a.id AND e.embedding IS NOT NULL)")
shared_sql("reuse_vectors", "SELECT DISTINCT a.id, e.model FROM articles a JOIN article_embeddings e ON e.article_id = a.id WHERE e.embedding IS NOT NULL AND CODE_POINTS(trim(a.title)) >= 15 AND trim(a.title) <> '(no title)'")
shared_sql(
    "upsert_embeddings",
    """WITH old AS (SELECT DISTINCT article_id, model, MS(created_at) AS at_ms FROM article_embeddings),
            new AS (SELECT DISTINCT article_id, 'newer' AS model, MS(created_at) + 1 AS at_ms FROM article_embeddings WHERE model LIKE '%s384%')
       SELECT article_id, model, at_ms FROM old o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.article_id = o.article_id) UNION ALL SELECT article_id, model, at_ms FROM new""",
)


# --- story assignment -------------------------------------------------------


def similar_in_band(items: DataFrame, threshold: float, hours: float, block: int = BLOCK) -> DataFrame:
    """``a`` < ``b``: ids of items (id, t, vector of unit length) at least ``threshold`` similar and at most ``hours`` apart.

    Time is cut into slots of the band's width, so partners lie in one slot or
    the next.  A slot with more than ``block`` items is divided, and each pair
    of parts is one task, so no task holds more than two blocks.
    """
    width = int(hours * _HOUR_MS)
    rows = items.withColumn("slot", F.floor(F.col("t") / width))
    near = rows.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).select("slot", F.greatest(F.lit(1), F.ceil(F.col("n") / block)).cast("int").alias("parts"))
    later = near.select((F.col("slot") - 1).alias("slot"), F.col("parts").alias("later_parts"))
    sized = near.join(later, "slot", "left").na.fill(0)
    own = rows.join(sized, "slot").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    # each part as the first of a pair meets the parts from its own on and those of the next slot; numbers from 10^6 are the next slot's
    first = own.select("id", "t", "vector", "slot", F.col("part").alias("i"), F.explode(F.concat(F.sequence("part", F.col("parts") - 1), F.when(F.col("later_parts") > 0, F.sequence(F.lit(1_000_000), F.lit(999_999) + F.col("later_parts"))).otherwise(F.array().cast("array<int>")))).alias("j"), F.lit(0).alias("side"))
    same = own.select("id", "t", "vector", "slot", F.explode(F.sequence(F.lit(0), F.col("part"))).alias("i"), F.col("part").alias("j"), F.lit(1).alias("side"))
    before = near.select((F.col("slot") + 1).alias("slot"), F.col("parts").alias("before_parts"))
    cross = own.join(before, "slot").select("id", "t", "vector", (F.col("slot") - 1).alias("slot"), F.explode(F.sequence(F.lit(0), F.col("before_parts") - 1)).alias("i"), (F.col("part") + 1_000_000).alias("j"), F.lit(1).alias("side"))

    def compare(t: pa.Table) -> pa.Table:
        side = t.column("side").to_numpy()
        ids, times = np.array(t.column("id").to_pylist(), object), t.column("t").to_numpy()
        v = np.array(t.column("vector").to_pylist(), np.float64)
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        out_a, out_b = [], []
        step = max(1, 4_000_000 // max(1, len(y)))
        for s in range(0, len(x), step):
            rows_ = x[s : s + step]
            sims = v[rows_] @ v[y].T
            hit = (sims >= threshold - 1e-7) & (np.abs(times[rows_][:, None] - times[y][None, :]) <= width)
            p, q = np.nonzero(hit)
            a, b = ids[rows_[p]], ids[y[q]]
            out_a += [min(m, n) for m, n in zip(a, b) if m != n]
            out_b += [max(m, n) for m, n in zip(a, b) if m != n]
        return pa.table({"a": pa.array(out_a, pa.string()), "b": pa.array(out_b, pa.string())})

    return first.unionByName(same).unionByName(cross).groupBy("slot", "i", "j").applyInArrow(compare, "a string, b string").distinct()


def assign_in_order(items: list[tuple[str, float, list[float]]], threshold: float, hours: float, most_age_hours: float) -> list[tuple[str, str, bool]]:
    """(id, story, is new): greedy star linkage of items (id, time in ms, unit vector) in their given order.

    An item joins the story whose first item it resembles most, if at least as
    much as the threshold, if the story's latest item lies within the hours and
    the story began less than the age before; else it begins a story of its own.
    """
    w, age = hours * _HOUR_MS, most_age_hours * _HOUR_MS
    stories: list[dict] = []
    out = []
    for key, t, v in items:
        best = None
        for s in stories:
            if t - w <= s["last"] <= t + w and s["created"] > t - age:
                sim = float(np.dot(v, s["v"]))
                if best is None or (-sim, s["created"], s["id"]) < best[0]:
                    best = ((-sim, s["created"], s["id"]), s)
        if best is not None and np.float32(-best[0][0]) >= np.float32(threshold):
            best[1]["last"] = max(best[1]["last"], t)
            out.append((key, best[1]["id"], False))
        else:
            stories.append({"id": key, "v": np.asarray(v), "created": t, "last": t})
            out.append((key, key, True))
    return out


def assign_stories(items: DataFrame, threshold: float = THRESHOLD, hours: float = HOURS, most_age_hours: float = MOST_AGE_HOURS) -> DataFrame:
    """``id``, ``story``, ``is_new`` of items (id, ``t`` in ms, ``ord_t`` null where undated, ``vector`` of unit length).

    An item can only join a story whose first item is similar enough, so items
    that no chain of similar items within the age and window links never affect
    each other: the components of the similarity graph are assigned
    independently, each in order of time, undated last.  Ties of similarity go
    to the older story, then to the smaller id.
    """
    links = park(similar_in_band(items.select("id", "t", "vector"), threshold, hours + most_age_hours), "similar")
    labels = component_labels(links)
    grouped = items.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("label", "id"))
    alone = grouped.filter("label is null").select("id", F.col("id").alias("story"), F.lit(True).alias("is_new"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ord_t", "id"], na_position="last")
        found = assign_in_order(list(zip(pdf["id"], pdf["t"], pdf["vector"])), threshold, hours, most_age_hours)
        return pd.DataFrame(found, columns=["id", "story", "is_new"])

    linked = grouped.filter("label is not null").select("id", "t", "ord_t", "vector", "component")
    return alone.unionByName(linked.groupBy("component").applyInPandas(one, "id string, story string, is_new boolean"))


def assignable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedded articles as items to assign; undated ones take the latest fetch as their time."""
    from newsloom.functions.vectors import unit

    now = articles(spark, sf_dir, "fetched_at").agg(F.unix_millis(F.max("fetched_at")).alias("now"))
    rows = embedded(spark, sf_dir, "published_at").crossJoin(F.broadcast(now))
    return rows.select("id", F.coalesce(F.unix_millis("published_at"), "now").alias("t"), F.unix_millis("published_at").alias("ord_t"), unit("embedding").alias("vector"))


@query("assign_stories")
def assign_stories_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories of all embedded articles by greedy star linkage."""
    return assign_stories(assignable(spark, sf_dir))
