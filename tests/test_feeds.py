import pytest

from newsloom.functions.html_text import sanitise, segments_of, text_of
from newsloom.sources.feeds import build_guid, fetch, looks_blocked, parse_date, parse_feed, register, strip_leading

NOW = 1_781_222_400_000  # 2026-06-12
RSS = '<rss version="2.0"><channel><title>c</title>{}</channel></rss>'
ITEM = "<item><guid>{}</guid><title>{}</title><link>{}</link><pubDate>{}</pubDate><description>{}</description></item>"


def test_strict_items():
    body = "﻿ \n" + RSS.format(ITEM.format("g1", " A &amp; b ", "https://x.example/1", "Thu, 11 Jun 2026 10:00:00 GMT", "<![CDATA[<p>Text</p>]]>") + "<item><title>no guid</title></item>")
    got = parse_feed(body, NOW)
    assert got.error_kind is None and got.items == [{"guid": "g1", "title": "A & b", "url": "https://x.example/1", "summary": "Text", "published_ms": 1_781_172_000_000}]


def test_lenient_items_and_entities():
    got = parse_feed(RSS.format(ITEM.format("g", "A&nbsp;B & C", "https://x.example/1", "قبل ساعة", "")), NOW)
    assert [(i["guid"], i["title"], i["published_ms"], i["summary"]) for i in got.items] == [("g", "A\xa0B & C", None, None)]
    assert parse_feed("<rss><broken", NOW).error_kind == "parse"


def test_atom_links():
    body = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>i</id><title>t</title><link rel="self" href="https://s"/><link rel="alternate" href="https://a"/><updated>2026-06-11T10:00:00Z</updated></entry></feed>'
    assert [(i["url"], i["published_ms"]) for i in parse_feed(body, NOW).items] == [("https://a", 1_781_172_000_000)]


def test_dates_out_of_range():
    day = 86_400_000
    iso = lambda ms: str(ms)
    assert parse_date(iso(NOW + 600_000), NOW) == (NOW + 600_000, False) and parse_date(iso(NOW + 600_001), NOW) == (None, True)
    assert parse_date(iso(NOW - 365 * day), NOW) == (NOW - 365 * day, False) and parse_date(iso(NOW - 366 * day), NOW) == (None, True)
    assert parse_date(None, NOW) == (None, False) and parse_date("soon", NOW) == (None, False)
    assert parse_feed(RSS.format(ITEM.format("g", "t", "l", iso(NOW + 2 * day), "")), NOW).clamped == 1


def test_guids_and_replies():
    assert build_guid(" g ", "l") == " g " and build_guid("  ", "l") == "l" and build_guid(None, None) == ""
    assert looks_blocked("<html><body>Just a moment</body>") and not looks_blocked("<?xml?><rss>") and strip_leading("﻿  <rss>") == "<rss>"
    assert parse_feed("<html></html>", NOW).error_kind == "blocked" and parse_feed("", NOW, status=503).error_kind == "http"


def test_proxy_first_then_direct():
    good = lambda a: (200, "", RSS.format(ITEM.format("g", "t", "l", "", "")))

    def late(a):
        raise TimeoutError("late")

    def gone(a):
        raise OSError("gone")

    assert fetch("x", NOW, good, gone)[1] == "proxy" and fetch("x", NOW, late, good)[1] == "direct"
    result, _ = fetch("x", NOW, late, gone)
    assert result.error_kind == "timeout" and result.detail == "late; gone"


def test_data_source(spark, tmp_path):
    (tmp_path / "a.xml").write_text(RSS.format(ITEM.format("g1", "t", "l", "", "") + ITEM.format("g2", "t", "l", "", "")))
    (tmp_path / "b.xml").write_text("<html></html>")
    register(spark)
    rows = spark.read.format("newsfeeds").option("path", str(tmp_path)).option("now_ms", str(NOW)).load().collect()
    assert sorted((r.guid or "", r.error_kind or "") for r in rows) == [("", "blocked"), ("g1", ""), ("g2", "")]


@pytest.mark.parametrize(
    "html, want",
    [
        ('<p onclick="x()">a<script>alert(1)</script></p>', "<p>a</p>"),
        ('<a href="javascript:alert(1)">x</a>', '<a target="_blank" rel="noopener noreferrer">x</a>'),
        ('<a href="/b">x</a>', '<a href="https://h.example/b" target="_blank" rel="noopener noreferrer">x</a>'),
        ('<img src="data:image/png;base64,x"><img src="i.png" srcset="j.png 2x">', '<img src="https://h.example/a/i.png" loading="lazy">'),
        ("<div><b>open", "<div><b>open</b></div>"),
        ("<custom>1 &lt; 2</custom>", "1 &lt; 2"),
        (None, None),
        ("", ""),
    ],
)
def test_sanitise(html, want):
    assert sanitise(html, "https://h.example/a/") == want


def test_text_and_segments():
    assert text_of("<div><p>One</p><p>two</p></div><p>Three <b>four</b></p>") == "One\n\ntwo\n\nThree four"
    assert text_of("loose text that is long<p>x</p>") == "loose text that is longx" and text_of(None) is None
    assert segments_of("<p> a </p><code>no</code><p>b<script>no</script></p>") == [" a ", "b"] and segments_of(None) == []
    assert len(segments_of("<p>x</p>" * 150)) == 100
