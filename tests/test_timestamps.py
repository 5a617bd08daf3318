import datetime as dt

import pytest
from hypothesis import given, settings, strategies as st

from newsloom.functions.instants import jalali_to_date, read_instant
from newsloom.operators.timestamps import InstantDictionary, normalise_instants

NY, TEHRAN, KOLKATA, LONDON = "America/New_York", "Asia/Tehran", "Asia/Kolkata", "Europe/London"


def ms(*parts):
    return int(dt.datetime(*parts, tzinfo=dt.timezone.utc).timestamp() * 1000)


@pytest.mark.parametrize(
    "text, zone, day_first, want",
    [
        ("Sun, 19 Oct 2025 20:43:34 GMT", NY, False, ms(2025, 10, 19, 20, 43, 34)),
        ("Mon, 19 Oct 2025 20:43:34 GMT", NY, False, ms(2025, 10, 19, 20, 43, 34)),
        ("19 Oct 25 15:42:44 +0300", NY, False, ms(2025, 10, 19, 12, 42, 44)),
        ("2025-10-19T20:45:32.906Z", NY, False, ms(2025, 10, 19, 20, 45, 32) + 906),
        ("2025-10-19T16:15:25.082933841Z", NY, False, ms(2025, 10, 19, 16, 15, 25) + 82),
        ("2025-10-19T21:21:07+03:00[Europe/Kiev]", NY, False, ms(2025, 10, 19, 18, 21, 7)),
        ("2025-10-20T11:22:22−05:00", NY, False, ms(2025, 10, 20, 16, 22, 22)),
        ("20251019T205124Z", NY, False, ms(2025, 10, 19, 20, 51, 24)),
        ("2025-W42-7T00:24:57+02:00", NY, False, ms(2025, 10, 18, 22, 24, 57)),
        ("1760904656", NY, False, 1760904656000),
        ("1760906465.8659", NY, False, 1760906465865),
        ("1760890572216", NY, False, 1760890572216),
        ("1760740795409640", NY, False, 1760740795409),
        (" 1760904656\n", NY, False, 1760904656000),
        ("Sun Oct 19 2025 12:14:45 GMT-0300", NY, False, ms(2025, 10, 19, 15, 14, 45)),
        ("Sun, 19 Oct 2025 16:03:49 GMT+3", NY, False, ms(2025, 10, 19, 13, 3, 49)),
        ("Wed, 22 Oct 2025 14:29:51 GMT+5:45", NY, False, ms(2025, 10, 22, 8, 44, 51)),
        ("Sun, 19 Oct 2025 18:08:48 IST", KOLKATA, True, ms(2025, 10, 19, 12, 38, 48)),
        ("Sun, 19 Oct 2025 18:08:48 IST", "Asia/Jerusalem", True, ms(2025, 10, 19, 16, 8, 48)),
        ("Sun, 2 Nov 2025 01:37:36 EDT", NY, False, ms(2025, 11, 2, 5, 37, 36)),
        ("Sun, 2 Nov 2025 01:37:36 EST", NY, False, ms(2025, 11, 2, 6, 37, 36)),
        ("October 19, 2025 2:30 PM EDT", NY, False, ms(2025, 10, 19, 18, 30)),
        ("2025-10-19 20:14 utc", NY, False, ms(2025, 10, 19, 20, 14)),
        ("19/10/2025 19:02", LONDON, True, ms(2025, 10, 19, 18, 2)),
        ("3/4/2026 4:32 AM", NY, False, ms(2026, 3, 4, 9, 32)),
        ("3/4/2026 04:32", LONDON, True, ms(2026, 4, 3, 3, 32)),
        ("19.10.2025, 16:27", "Europe/Berlin", True, ms(2025, 10, 19, 14, 27)),
        ("2025.10.21 22:45:24", "Asia/Shanghai", False, ms(2025, 10, 21, 14, 45, 24)),
        ("19 October 2025, 12.28am", LONDON, True, ms(2025, 10, 18, 23, 28)),
        ("19 October 2025, 12.28pm", LONDON, True, ms(2025, 10, 19, 11, 28)),
        ("Saturday October 25, 2025 07:11:00", NY, False, ms(2025, 10, 25, 11, 11)),
        ("18 de octubre de 2025, 19:27", "America/Bogota", True, ms(2025, 10, 19, 0, 27)),
        ("28 de outubro de 2025 às 15h03", "America/Sao_Paulo", True, ms(2025, 10, 28, 18, 3)),
        ("22 octobre 2025 à 22h57", "Europe/Paris", True, ms(2025, 10, 22, 20, 57)),
        ("1. März 2026, 11:03 Uhr", "Europe/Berlin", True, ms(2026, 3, 1, 10, 3)),
        ("15 Şubat 2026 06:25", "Europe/Istanbul", True, ms(2026, 2, 15, 3, 25)),
        ("11 декабря 2025 г., 01:52", "Europe/Moscow", True, ms(2025, 12, 10, 22, 52)),
        ("14 березня 2026 р., 06:58", "Europe/Kiev", True, ms(2026, 3, 14, 4, 58)),
        ("25 באוקטובר 2025, 19:01", "Asia/Jerusalem", True, ms(2025, 10, 25, 16, 1)),
        ("١٠ ديسمبر ٢٠٢٥ - ٠٩:٠٥", "Asia/Baghdad", True, ms(2025, 12, 10, 6, 5)),
        ("2025年10月23日 01:21", "Asia/Shanghai", False, ms(2025, 10, 22, 17, 21)),
        ("2025年10月21日下午3:45", "Asia/Shanghai", False, ms(2025, 10, 21, 7, 45)),
        ("۱۴۰۴/۰۷/۳۰ ۲۰:۳۵", TEHRAN, True, ms(2025, 10, 22, 17, 5)),
        ("۱۵ بهمن ۱۴۰۴ - ۲۰:۵۷", TEHRAN, True, ms(2026, 2, 4, 17, 27)),
    ],
)
def test_spellings(text, zone, day_first, want):
    assert read_instant(text, zone, day_first) == want


@pytest.mark.parametrize(
    "text, zone",
    [
        (None, NY), ("", NY), ("n/a", NY), ("TBA", NY), ("yesterday", NY), ("just now", NY), ("14 hours ago", NY), ("دیروز", TEHRAN), ("Invalid Date", NY), ("2025-10-19", NY), ("14:00", NY),
        ("19 October 2025", NY), ("2025-10-19T25:49:00Z", NY), ("2026-02-30T10:08:00Z", NY), ("0000-00-00 00:00:00", NY), ("Mon, 31 Nov 2025 09:59:19 GMT", NY), ("13/13/2025 10:00", NY),
        ("2026-03-08 02:30:00", NY), ("2025-11-02 01:30:00", NY), ("8 March 2026, 2.15am", "America/Chicago"), ("26 October 2025, 1.08am", LONDON), ("2025-10-19 10:00:00", None), ("13:00 PM 3/4/2026", NY), ("x" * 100_000, NY), ("Sun, 19 Oct 2025 18:08:48 XYZ", NY),
    ],
)
def test_no_instant(text, zone):
    assert read_instant(text, zone, True) is None


def test_solar_calendar():
    assert [str(jalali_to_date(y, 1, 1)) for y in (1399, 1400, 1403, 1404, 1405)] == ["2020-03-20", "2021-03-21", "2024-03-20", "2025-03-21", "2026-03-21"]
    assert jalali_to_date(1403, 12, 30) is not None and jalali_to_date(1404, 12, 30) is None


@settings(max_examples=200, deadline=None)
@given(st.datetimes(dt.datetime(2001, 10, 1), dt.datetime(2037, 1, 1)), st.sampled_from([0, 60, 330, 345, -210, -480]))
def test_round_trips(at, minutes):
    at = at.replace(microsecond=at.microsecond // 1000 * 1000, tzinfo=dt.timezone(dt.timedelta(minutes=minutes)))
    want = (at - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(milliseconds=1)
    assert read_instant(at.isoformat(timespec="milliseconds"), NY, False) == want
    assert read_instant(at.strftime("%a, %d %b %Y %H:%M:%S %z"), NY, False) == want // 1000 * 1000
    assert read_instant(f"{at:%d %B %Y %H:%M:%S} {at:%z}", NY, False) == want // 1000 * 1000
    assert read_instant(str(want), NY, False) == want


ITEMS = "id string, published_at string, feed_url string, source_id string, tz_name string, raw string, instant_ms string, n int"
LOCALE = "source_id string, feed_url string, tz_name string, day_first boolean"
PLACES = [("s1", "u1", NY, False), ("s2", "u2", LONDON, True)]


def run(spark, rows, dictionary=None):
    out = normalise_instants(spark.createDataFrame(rows, ITEMS), spark.createDataFrame(PLACES, LOCALE), dictionary or InstantDictionary(spark))
    return out


def test_rows_keep_and_get_their_feeds_reading(spark):
    text = "3/4/2026 10:00"
    rows = [("a", text, "u1", None, "x", "x", "x", 1), ("b", text, "u2", None, "x", "x", "x", 1), ("c", text, None, "s2", "x", "x", "x", 1), ("d", text, "nowhere", None, "x", "x", "x", 1), ("e", None, "u1", None, "x", "x", "x", 1), ("f", "", None, None, None, None, None, None), ("g", "2026-03-04T10:00Z", None, None, None, None, None, None), ("b", text, "u2", None, "x", "x", "x", 1)]
    got = sorted((r.id, r.instant_ms) for r in run(spark, rows).collect() if r.instant_ms is not None)
    assert got == [("a", ms(2026, 3, 4, 15)), ("b", ms(2026, 4, 3, 9)), ("b", ms(2026, 4, 3, 9)), ("c", ms(2026, 4, 3, 9)), ("g", ms(2026, 3, 4, 10))]
    assert run(spark, rows).count() == len(rows)
    assert run(spark, []).count() == 0


def test_a_hot_text_and_an_incremental_dictionary(spark):
    rows = [(str(i), "yesterday" if i % 3 else "19 Oct 2025 10:00:00 GMT", "u1", None, None, None, None, i) for i in range(300)]
    dictionary = InstantDictionary(spark)
    assert sum(r.instant_ms is not None for r in run(spark, rows, dictionary).collect()) == 100
    before = dictionary.read().count()
    run(spark, rows + [("new", "20 Oct 2025 10:00:00 GMT", "u1", None, None, None, None, 1)], dictionary).count()
    assert before == 2 and dictionary.read().count() == 3
