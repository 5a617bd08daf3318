import hashlib
import re
from datetime import datetime, timedelta, timezone
import unicodedata

from newsloom.operators.ingest import CLASSIFY_CAP, backfill_body_hash, body_hash, classify_queue, normalize_summary


def test_turkish_summaries_are_kept(spark, tmp_path):
    """Lower-cased as the reference does: the dotted capital becomes an i and a combining dot, which is no letter."""
    texts = {
        "a": "İstanbul'da ateşkes görüşmeleri, İzmir limanında yeniden başladı.",
        "b": "İzmir",
        "c": "The harbour authority published the new timetable of the ferry.",
        "d": None,
        "e": "DİYARBAKIR VE İSTANBUL arasında yeni sefer tarifesi yayımlandı.",
    }
    spark.createDataFrame([(k, t, "known" if k == "e" else None) for k, t in texts.items()], "id string, summary string, body_hash string").write.parquet(str(tmp_path / "articles.parquet"))

    def plain(t):
        return " ".join(re.findall(r"[^\W_]+", unicodedata.normalize("NFC", t.lower())))

    def digest(t):
        return hashlib.sha256(plain(t).encode()).hexdigest() if t is not None and len(plain(t)) >= 40 else None

    got = {f.__name__: {r[0]: r[1] for r in f(spark, str(tmp_path)).collect()} for f in (normalize_summary, body_hash, backfill_body_hash)}
    assert got["normalize_summary"] == {k: plain(t) for k, t in texts.items() if t is not None} and got["normalize_summary"]["b"] == "i zmir"
    assert got["body_hash"] == {k: digest(t) for k, t in texts.items()} and got["body_hash"]["a"]
    assert got["backfill_body_hash"] == {k: digest(texts[k]) for k in "ac"}


def test_classifier_takes_the_newest_new_items_and_defers_the_rest(spark, tmp_path):
    start = datetime(2026, 1, 1, tzinfo=timezone.utc)

    def item(n, guid, minutes, **kw):
        # the later published, the earlier fetched
        raw = kw.get("raw", (start + timedelta(minutes=minutes)).isoformat())
        return f"b-{n:010d}", guid, raw, "", "s", "t", "en", start + timedelta(days=2, seconds=-n)

    rows = [item(3 * i + 1, f"g{i}", i) for i in range(320)]
    rows += [item(3000, "r", 900), item(3001, "known", 900), item(3002, "", 900), item(3004, None, 900)]  # a reject, an article, no guid
    rows += [item(3005, "undated", 0, raw="yesterday"), item(3007, "future", 60 * 24 * 9), item(3008, "old", -60 * 24 * 400)]
    rows += [item(3010, "g0", 800), item(3011, "g319", 5)]  # delivered again: the last value wins
    spark.createDataFrame(rows, "id string, guid string, published_at string, feed_url string, source_id string, title string, source_lang string, fetched_at timestamp").write.parquet(str(tmp_path / "feed_items.parquet"))
    spark.createDataFrame([("a-1", "known")], "id string, guid string").write.parquet(str(tmp_path / "articles.parquet"))
    spark.createDataFrame([("f", "s", "UTC", False)], "feed_url string, source_id string, tz_name string, day_first boolean").write.parquet(str(tmp_path / "feed_locale.parquet"))
    got = {r.guid: r for r in classify_queue(spark, str(tmp_path)).collect()}
    when = {f"g{i}": i for i in range(320)} | {"g0": 800, "g319": 5}
    order = sorted(when, key=lambda g: (-when[g], int(g[1:])))
    late = ["future", "old", "undated"]
    assert set(got) == {*order, *late}
    assert [g for g in order if got[g].chosen] == order[:CLASSIFY_CAP] and not any(got[g].chosen for g in late)
    assert {g: r.published_ms for g, r in got.items()} == {g: int((start + timedelta(minutes=m)).timestamp() * 1000) for g, m in when.items()} | dict.fromkeys(late)
    assert (got["g0"].id, got["g0"].first_id) == ("b-0000003010", "b-0000000001")
