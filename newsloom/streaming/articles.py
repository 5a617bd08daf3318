"""The incremental operators as Structured Streaming queries.

Sources are folders of Parquet files.  Sinks are Parquet folders; where a
caller names sink and progress folders in shared storage, a stream goes on
after a failure or restart where it stopped.  The queries registered here drain
what is there (``availableNow``) into new folders and return the sink.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from newsloom.operators.vectors import HOURS, MOST_AGE_HOURS, THRESHOLD
from newsloom.plans.catalog import query
from newsloom.plans.runtime import drop_path, fresh_path, list_names, read_text, table, write_text


def article_stream(spark: SparkSession, path: str, *columns: str, files_per_trigger: int = 4) -> DataFrame:
    """New rows of a Parquet folder; only the columns asked for are read."""
    schema = spark.read.parquet(path).select(*columns).schema
    # a single file is read through a pattern that only it matches
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path + "*")


def drain(stream: DataFrame, label: str, *, each: Callable[[DataFrame, int], None] | None = None, out: str | None = None, progress: str | None = None, mode: str = "append") -> DataFrame | None:
    """Run a stream over all that is there; its sink as a table, or None if ``each`` takes the batches.

    With ``out`` and ``progress`` given, the next run takes up where this one ended.
    """
    spark = stream.sparkSession
    progress = progress or fresh_path(spark, f"{label}-progress")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", progress).trigger(availableNow=True)
    if each:
        writer.foreachBatch(each).start().awaitTermination()
        return None
    out = out or fresh_path(spark, label)
    writer.format("parquet").option("path", out).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def deduplicated(stream: DataFrame, keys: list[str], time_col: str, delay: str = "400 days") -> DataFrame:
    """Each key once, as long as its repeats come within the delay."""
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(keys)


class Upserts:
    """Rows by key, the greatest ``order`` wins, kept in hash buckets; a batch rewrites only the buckets it touches.

    Every attempt writes to a folder of its own and then commits a manifest,
    one small file that names the folder of each bucket; a bucket's older
    folder goes only after that.  So an attempt that died leaves the table as
    it was, and a batch that is applied again, after a failure, a restart (with
    ``path`` given) or out of order, leaves equal rows: merging keeps the
    greatest of what is there and what comes.  Buckets double when they hold
    more than ``bucket_rows`` rows on average, which rewrites each row once a
    doubling.  Nulls of the key are left out; equal ``order`` is decided by the
    other columns.
    """

    def __init__(self, spark: SparkSession, key: str, order: str, buckets: int = 8, *, path: str | None = None, bucket_rows: int = 1_000_000):
        self.spark, self.key, self.order, self.bucket_rows = spark, key, order, bucket_rows
        self.path = path or fresh_path(spark, "upserts")
        names = [n for n in list_names(spark, f"{self.path}/manifests") if n.endswith(".json")]
        held = json.loads(read_text(spark, f"{self.path}/manifests/{names[-1]}")) if names else {"buckets": buckets, "folders": {}, "rows": {}}
        self.commit = int(names[-1].split(".")[0]) if names else 0
        self.buckets: int = held["buckets"]
        self.folders: dict[str, str] = held["folders"]
        self.rows: dict[str, int] = held["rows"]

    def apply(self, batch: DataFrame, number: int = 0, *, known_only: bool = False) -> None:
        """Merge one micro-batch; with ``known_only`` rows of keys that are not held are ignored."""
        rows = batch.filter(F.col(self.key).isNotNull())
        grow = sum(self.rows.values()) > self.bucket_rows * self.buckets
        buckets = 2 * self.buckets if grow else self.buckets
        numbered = rows.withColumn("_b", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))
        touched = {str(r[0]) for r in numbered.select("_b").distinct().collect()}  # at most ``buckets``
        if not touched:
            return
        read = sorted(self.folders) if grow else sorted(touched & set(self.folders))
        before = self.spark.read.schema(rows.schema).parquet(*(self.folders[b] for b in read)) if read else rows.limit(0)
        if known_only:
            rows = rows.join(before.select(self.key).distinct(), self.key, "left_semi")
        others = [c for c in rows.columns if c != self.key]
        newest = rows.unionByName(before).groupBy(self.key).agg(F.max(F.struct(F.col(self.order).alias("_order"), *others)).alias("r"))
        target = f"{self.path}/rows/batch={number}-{uuid.uuid4().hex}"
        placed = newest.select(self.key, *(F.col(f"r.{c}").alias(c) for c in others)).withColumn("b", F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int"))
        placed.repartition("b").write.partitionBy("b").parquet(target)
        counts = {str(r["b"]): r["count"] for r in self.spark.read.parquet(target).groupBy("b").count().collect()}  # at most ``buckets``
        old = [self.folders[b] for b in read]
        folders = {} if grow else dict(self.folders)
        held = {} if grow else dict(self.rows)
        folders.update({b: f"{target}/b={b}" for b in counts})
        held.update(counts)
        commit = f"{self.path}/manifests/{self.commit + 1:012d}.json"
        write_text(self.spark, commit, json.dumps({"buckets": buckets, "folders": folders, "rows": held}))
        previous = f"{self.path}/manifests/{self.commit:012d}.json"
        self.commit, self.buckets, self.folders, self.rows = self.commit + 1, buckets, folders, held
        for path in [*old, previous]:
            drop_path(self.spark, path)

    def read(self, columns: list[str]) -> DataFrame:
        """The table as it is now; before the first row all its columns are strings."""
        if not self.folders:
            return self.spark.createDataFrame([], ", ".join(f"{c} string" for c in columns))
        return self.spark.read.parquet(*sorted(self.folders.values())).select(*columns)


@query("stream_articles", "SELECT id, source_name FROM articles")
def stream_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article table as an append stream, rows as they come."""
    return drain(article_stream(spark, f"{sf_dir}/articles.parquet", "id", "source_name"), "stream-articles")


@query("stream_dedup", "SELECT DISTINCT id FROM articles")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article stream with each id once."""
    stream = article_stream(spark, f"{sf_dir}/articles.parquet", "id", "fetched_at")
    return drain(deduplicated(stream, ["id"], "fetched_at"), "stream-dedup").select("id")


@query("stream_updates", "SELECT id, epoch_ms(fetched_at) AS fetched_ms FROM articles WHERE epoch_ms(fetched_at) > (SELECT max(epoch_ms(fetched_at)) - 172800000 FROM articles)")
def stream_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates of the last two days; the limit is fixed when the stream starts."""
    since = table(spark, sf_dir, "articles").agg(F.unix_millis(F.max("fetched_at")) - 172_800_000).first()[0]  # one value
    stream = article_stream(spark, f"{sf_dir}/articles.parquet", "id", "fetched_at").withColumn("fetched_ms", F.unix_millis("fetched_at"))
    return drain(stream.filter(F.col("fetched_ms") > F.lit(since)).select("id", "fetched_ms"), "stream-updates")


@query(
    "stream_apply",
    "SELECT guid, max(id) AS id FROM (SELECT guid, id FROM articles WHERE guid IS NOT NULL UNION ALL SELECT guid, id FROM feed_items WHERE guid IN (SELECT guid FROM articles)) u GROUP BY guid",
)
def stream_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of patches by guid: the last one stays, guids that are not held are ignored."""
    state = Upserts(spark, "guid", "id")
    state.apply(table(spark, sf_dir, "articles").select("guid", "id"))
    drain(article_stream(spark, f"{sf_dir}/feed_items.parquet", "guid", "id"), "stream-apply", each=lambda batch, number: state.apply(batch, number, known_only=True))
    return state.read(["guid", "id"])


@query("stream_upserts", "SELECT guid, max(id) AS id FROM feed_items WHERE guid IS NOT NULL GROUP BY guid")
def stream_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items applied as a stream of upserts by guid: the last one stays, new guids are held."""
    state = Upserts(spark, "guid", "id")
    drain(article_stream(spark, f"{sf_dir}/feed_items.parquet", "guid", "id"), "stream-upserts", each=state.apply)
    return state.read(["guid", "id"])


@query("stream_rate_windows", "SELECT user_id, epoch_ms(date_trunc('hour', ts)) AS window_ms, CAST(count(*) AS BIGINT) AS requests FROM events GROUP BY 1, 2")
def stream_rate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by user and hour as a windowed count; the last state of each window is kept.

    No watermark: files come in any order of time, and a row behind one would be dropped.
    """
    events = article_stream(spark, f"{sf_dir}/events.parquet", "user_id", "ts").withColumn("ts", F.col("ts").cast("timestamp"))
    counted = events.groupBy("user_id", F.window("ts", "1 hour")).agg(F.count(F.lit(1)).alias("requests"))
    flat = counted.select(F.concat_ws(":", "user_id", F.unix_millis("window.start")).alias("id"), "user_id", F.unix_millis("window.start").alias("window_ms"), "requests")
    state = Upserts(spark, "id", "requests")
    drain(flat, "rate", each=state.apply, mode="update")
    return state.read(["user_id", "window_ms", "requests"])


class StarLinkage(StatefulProcessor):
    """Story assignment as a stateful processor: the stories of one group that an item may still join.

    State holds a story's first vector and its times.  A story that no item can
    join any more is forgotten, by a timer on event time where the stream has a
    watermark.  An item that comes late is still compared with every story
    held; joins are emitted, never taken back.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._stories = handle.getMapState("stories", "id string", "created double, last double, vector array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        items = pd.concat(list(rows)).sort_values(["t", "id"])
        held = {k[0]: v for k, v in self._stories.iterator()}
        names = list(held)
        # room for one story more for each item
        size = len(names) + len(items)
        created, last = np.full(size, -np.inf), np.full(size, -np.inf)
        vectors = np.zeros((size, len(items["vector"].iloc[0])))
        for i, (c, l, v) in enumerate(held.values()):
            created[i], last[i], vectors[i] = c, l, v
        out, changed, n = [], set(), len(names)
        for item, t, vector in zip(items["id"], items["t"], items["vector"]):
            fits = np.flatnonzero((np.abs(last[:n] - t) <= HOURS * 3_600_000) & (created[:n] > t - MOST_AGE_HOURS * 3_600_000))
            place = -1
            if len(fits):
                sims = (vectors[fits] @ np.asarray(vector, float)).round(12)
                best = min(fits[sims == sims.max()], key=lambda i: (created[i], names[i]))
                if sims.max() >= THRESHOLD - 1e-7:
                    place = best
            out.append((item, names[place] if place >= 0 else item, place < 0))
            if place < 0:
                names.append(item)
                created[n], last[n], vectors[n] = t, t, vector
                place, n = n, n + 1
            last[place] = max(last[place], t)
            changed.add(place)
        for i in changed:
            self._stories.updateValue((names[i],), (float(created[i]), float(last[i]), vectors[i].tolist()))
        self._expire(names, created[:n], last[:n], timerValues)
        yield pd.DataFrame(out, columns=["id", "story", "is_new"])

    def _expire(self, names, created, last, timerValues) -> None:
        """Forget what no item at or after the watermark can join, and be called again when the next story gets there."""
        over = np.minimum(last + HOURS * 3_600_000, created + MOST_AGE_HOURS * 3_600_000)
        passed = timerValues.getCurrentWatermarkInMs()
        for i in np.flatnonzero(over < passed):
            self._stories.removeKey((names[i],))
        due = over[over >= passed]
        if passed >= 0 and len(due):
            self._handle.registerTimer(int(due.min()) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = {k[0]: v for k, v in self._stories.iterator()}
        if held:
            self._expire(list(held), np.array([v[0] for v in held.values()]), np.array([v[1] for v in held.values()]), timerValues)
        yield pd.DataFrame({"id": pd.Series([], dtype=str), "story": pd.Series([], dtype=str), "is_new": pd.Series([], dtype=bool)})

    def close(self) -> None:
        pass


def stream_assign(items: DataFrame, group_col: str, *, time_col: str | None = None, late: str = "8 hours") -> DataFrame:
    """``id``, ``story``, ``is_new`` of a stream of items (id, ``t`` in ms, ``vector`` of unit length), each group by itself.

    Between micro-batches the order is the stream's, as with items that are
    assigned when they arrive.  With ``time_col``, a timestamp, stories expire
    once the watermark has passed the last item that could join; without, they
    are held.  Use a group that similar items share, such as a component key or
    a coarse hash of the vector.
    """
    timed = items if time_col is None else items.withWatermark(time_col, late)
    return timed.groupBy(group_col).transformWithStateInPandas(StarLinkage(), outputStructType="id string, story string, is_new boolean", outputMode="Append", timeMode="None" if time_col is None else "EventTime")
