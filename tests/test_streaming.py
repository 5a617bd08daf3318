import os
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from newsloom.operators.ingest import numbered, valid_verdict
from newsloom.operators.reader import ipv4_number, is_private_ipv4, page_allowed, url_allowed
from newsloom.plans.runtime import fresh_path, one_machine
from newsloom.streaming import articles
from newsloom.streaming.articles import Upserts, article_stream, deduplicated, drain, stream_assign, stream_rate_windows

HOUR = 3_600_000


def test_dedup_over_files(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(k, pd.Timestamp(2026, 1, 1 + i).to_pydatetime()) for k in ("a", "b", f"c{i}")], "id string, at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = article_stream(spark, str(tmp_path / "in"), "id", "at", files_per_trigger=1)
    assert sorted(r.id for r in drain(deduplicated(stream, ["id"], "at"), "t").collect()) == ["a", "b", "c0", "c1", "c2"]


def test_rate_windows_over_files_out_of_order(spark, tmp_path):
    """Twelve files in three micro-batches, newest first: the third meets the watermark of the first."""
    folder = tmp_path / "events.parquet"
    for i in range(12):
        before = set(folder.glob("*.parquet")) if folder.exists() else set()
        rows = [(user, pd.Timestamp(2026, 1, 28 - 2 * i, 5, minute).to_pydatetime()) for user in (1, 2) for minute in (0, 59)] + [(1, pd.Timestamp(2026, 1, 28, 5, 30).to_pydatetime())]
        spark.createDataFrame(rows, "user_id long, ts timestamp").coalesce(1).write.mode("append").parquet(str(folder))
        for f in set(folder.glob("*.parquet")) - before:
            os.utime(f, (1_700_000_000 + 10 * i,) * 2)
    got = {(r.user_id, r.window_ms): r.requests for r in stream_rate_windows(spark, str(tmp_path)).collect()}
    hours = [int(pd.Timestamp(2026, 1, 28 - 2 * i, 5, tz="UTC").timestamp() * 1000) for i in range(12)]
    assert got == {(user, h): 2 for user in (1, 2) for h in hours} | {(1, hours[0]): 14}


def test_upserts_keep_the_last_write(spark):
    state = Upserts(spark, "k", "v", buckets=3)
    for n, batch in enumerate([[("a", 1), ("b", 1)], [("a", 2), ("c", 1)], [], [("b", 3), ("b", 2)]]):
        state.apply(spark.createDataFrame(batch, "k string, v int"), n)
    state.apply(spark.createDataFrame([("b", 3), ("b", 2)], "k string, v int"), 4)
    assert {r.k: r.v for r in state.read(["k", "v"]).collect()} == {"a": 2, "b": 3, "c": 1}


def test_upserts_survive_replay_restart_and_disorder(spark, tmp_path):
    path = str(tmp_path / "held")
    batches = [[("a", 1), ("b", 1)], [("a", 2), ("c", 1)], [("b", 3), (None, 9)]]
    frames = [spark.createDataFrame(b, "k string, v int") for b in batches]
    want = {"a": 2, "b": 3, "c": 1}
    state = Upserts(spark, "k", "v", buckets=2, path=path)
    for n in (0, 1, 1, 0, 2, 2):
        state.apply(frames[n], n)
    assert {r.k: r.v for r in state.read(["k", "v"]).collect()} == want
    again = Upserts(spark, "k", "v", path=path)
    assert {r.k: r.v for r in again.read(["k", "v"]).collect()} == want
    again.apply(frames[2], 2)
    again.apply(frames[0], 0)
    assert {r.k: r.v for r in Upserts(spark, "k", "v", path=path).read(["k", "v"]).collect()} == want


def test_an_attempt_that_died_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    state = Upserts(spark, "k", "v", path=str(tmp_path / "held"))
    state.apply(spark.createDataFrame([("a", 1)], "k string, v int"), 0)

    def die(*_):
        raise OSError("gone")

    with monkeypatch.context() as broken, pytest.raises(OSError):
        broken.setattr(articles, "write_text", die)
        state.apply(spark.createDataFrame([("a", 2)], "k string, v int"), 1)
    again = Upserts(spark, "k", "v", path=str(tmp_path / "held"))
    assert {r.k: r.v for r in again.read(["k", "v"]).collect()} == {"a": 1}
    again.apply(spark.createDataFrame([("a", 2)], "k string, v int"), 1)
    assert {r.k: r.v for r in again.read(["k", "v"]).collect()} == {"a": 2}


def test_upserts_grow_and_patches_keep_to_known_keys(spark):
    state = Upserts(spark, "k", "v", buckets=1, bucket_rows=10)
    for n in range(4):
        state.apply(spark.createDataFrame([(f"k{i}", n) for i in range(20 * n, 20 * n + 20)], "k string, v int"), n)
    assert state.buckets == 8 and state.read(["k"]).count() == 80
    state.apply(spark.createDataFrame([("k1", 9), ("new", 9)], "k string, v int"), 4, known_only=True)
    got = {r.k: r.v for r in state.read(["k", "v"]).collect()}
    assert len(got) == 80 and got["k1"] == 9 and "new" not in got


def test_a_stream_resumes(spark, tmp_path):
    into, out, progress = (str(tmp_path / x) for x in ("in", "out", "progress"))
    for day in (1, 2):
        spark.createDataFrame([(f"a{day}",)], "id string").coalesce(1).write.mode("append").parquet(into)
        got = drain(article_stream(spark, into, "id"), "t", out=out, progress=progress)
        assert got.count() == day


def test_a_cluster_needs_a_shared_folder():
    assert one_machine("local") and one_machine("local[4]") and not one_machine("local-cluster[2,1,1024]") and not one_machine("spark://h:7077")


@pytest.mark.parametrize("timed", [False, True])
def test_stateful_assignment(spark, tmp_path, timed):
    v, w = [1.0, 0.0], [0.0, 1.0]
    batches = [[("a", 0, v, "g"), ("b", HOUR, v, "g")], [("c", 2 * HOUR, w, "g"), ("d", 9 * HOUR, v, "g")], [("e", 30 * HOUR, v, "g")]]
    for rows in batches:
        rows = [(i, 500_000 * HOUR + t, x, g) for i, t, x, g in rows]
        spark.createDataFrame(rows, "id string, t long, vector array<double>, grp string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken in order of their time
    stream = article_stream(spark, str(tmp_path / "in"), "id", "t", "vector", "grp", files_per_trigger=1)
    if timed:
        stream = stream.withColumn("at", F.timestamp_millis("t"))
    try:
        out = drain(stream_assign(stream, "grp", time_col="at" if timed else None), "assign")
    except Exception as problem:  # noqa: BLE001
        if "RocksDB" in str(problem) or "ModuleNotFound" in str(problem):
            pytest.skip("no state store for this operator here")
        raise
    assert {r.id: r.story for r in out.collect()} == {"a": "a", "b": "a", "c": "c", "d": "a", "e": "e"}


def test_numbering_without_one_task(spark):
    rows = spark.range(1000).withColumn("k", F.xxhash64("id"))
    got = [r.pos for r in numbered(rows, "k").orderBy("k").collect()]
    assert got == list(range(1000))


def test_verdicts(spark):
    cases = [("[1,0,1]", True), ("```json\n[1, 0, 1]\n```", True), ('["1","0","1"]', False), ("[1,0]", False), ("[1,0,2]", False), ("not json", False), (None, False)]
    got = [r.ok for r in spark.createDataFrame(cases, "r string, want boolean").select(valid_verdict(F.col("r"), 3).alias("ok")).collect()]
    assert got == [w for _, w in cases]


def test_addresses(spark):
    cases = [("10.0.0.1", True), ("9.255.255.255", False), ("172.15.255.255", False), ("172.16.0.0", True), ("172.31.255.255", True), ("172.32.0.0", False), ("192.168.1.1", True), ("8.8.8.8", False), ("100.64.0.1", True), ("192.0.0.9", True), ("192.0.1.0", False), ("224.0.0.1", False), ("198.19.0.1", True), ("300.1.1.1", False), ("x", False), (None, False)]
    frame = spark.createDataFrame(cases, "ip string, want boolean")
    assert [r.p for r in frame.select(is_private_ipv4(F.col("ip")).alias("p")).collect()] == [w for _, w in cases]
    assert frame.select(ipv4_number(F.col("ip")).alias("n")).first().n == 167772161
    urls = [("https://a.example/x", True), ("ftp://a.example", False), ("http://localhost/", False), ("http://10.0.0.1/", False), ("https://a.internal/", False), ("http://[::1]/", False), ("http://u@a.example:80/", True), (None, False)]
    assert [r.ok for r in spark.createDataFrame(urls, "u string, w boolean").select(url_allowed(F.col("u")).alias("ok")).collect()] == [w for _, w in urls]


def test_pages_that_may_be_read(spark):
    urls = [("https://a.example/x", True), ("ftp://a.example", False), ("http://localhost/", False), ("http://10.0.0.1/", False), ("http://8.8.8.8/", True), ("https://a.internal/", False), ("https://printer.local", False), ("http://[::1]/", False), ("http://[fe80::2]/", False), ("http://[FD00::1]/", False), ("http://[2001:db8::1]:8080/", True), ("http://192.0.0.1/", False), ("http://169.254.169.254/", False), ("x", False), (None, False)]
    assert [r.ok for r in spark.createDataFrame(urls, "u string, w boolean").select(page_allowed(F.col("u")).alias("ok")).collect()] == [w for _, w in urls]


def test_paths_are_new(spark):
    assert fresh_path(spark, "x") != fresh_path(spark, "x")
