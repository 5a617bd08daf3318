"""Reading one timestamp text as one instant.

``read_instant`` is a pure function of the text and the feed's locale, so the
dictionary operator can call it once for each distinct value.
"""

from __future__ import annotations

import datetime as dt
import re
import unicodedata
from functools import lru_cache
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
_UTC_NAMES = {"gmt", "ut", "utc", "z", "zulu"}

# Month names by language, in calendar order.
MONTHS = {
    "en": "january february march april may june july august september october november december",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "de": "januar februar märz april mai juni juli august september oktober november dezember",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "pt": "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro",
    "tr": "ocak şubat mart nisan mayıs haziran temmuz ağustos eylül ekim kasım aralık",
    "ru": "января февраля марта апреля мая июня июля августа сентября октября ноября декабря",
    "uk": "січня лютого березня квітня травня червня липня серпня вересня жовтня листопада грудня",
    "ar": "يناير فبراير مارس أبريل مايو يونيو يوليو أغسطس سبتمبر أكتوبر نوفمبر ديسمبر",
    "ar_levant": "كانون_الثاني شباط آذار نيسان أيار حزيران تموز آب أيلول تشرين_الأول تشرين_الثاني كانون_الأول",
    "he": "ינואר פברואר מרץ אפריל מאי יוני יולי אוגוסט ספטמבר אוקטובר נובמבר דצמבר",
    "fa": "ژانویه فوریه مارس آوریل مه ژوئن ژوئیه اوت سپتامبر اکتبر نوامبر دسامبر",
    "short_en": "jan feb mar apr may jun jul aug sep oct nov dec",
    "short_other": "janv févr mär avr mayo juin juil ağu sept ekim kas dez",
    "more": "ocak fev mrz abr mai haz tem ago eyl okt nob dic",
    "ru_plain": "январь февраль март апрель май июнь июль август сентябрь октябрь ноябрь декабрь",
    "uk_plain": "січень лютий березень квітень травень червень липень серпень вересень жовтень листопад грудень",
}
# Months of the solar Hijri calendar, in calendar order.
JALALI_MONTHS = "فروردین اردیبهشت خرداد تیر مرداد شهریور مهر آبان آذر دی بهمن اسفند"
# Places of the leap years in the 33-year cycle of that calendar.
_JALALI_LEAPS = (1, 5, 9, 13, 17, 22, 26, 30)
# Words that may stand in a date text without changing it.
_FILLERS = {"de", "del", "à", "às", "as", "at", "um", "uhr", "г", "р", "года", "року", "в", "о", "le", "el", "der", "den", "the", "of", "on", "saat", "ساعت", "في", "الساعة", "בשעה", "om", "kl", "год", "h"}
# Weekday names by language, Monday first; a wrong weekday is no reason to leave a value out.
WEEKDAYS = {
    "en": "monday tuesday wednesday thursday friday saturday sunday mon tue wed thu fri sat sun tues thur thurs",
    "fr": "lundi mardi mercredi jeudi vendredi samedi dimanche lun mer jeu ven sam dim",
    "de": "montag dienstag mittwoch donnerstag freitag samstag sonntag mo di mi do fr sa so",
    "es": "lunes martes miércoles jueves viernes sábado domingo mié jue vie sáb dom",
    "pt": "segunda-feira terça-feira quarta-feira quinta-feira sexta-feira sábado domingo segunda terça quarta quinta sexta seg ter qua qui sex sáb",
    "tr": "pazartesi salı çarşamba perşembe cuma cumartesi pazar",
    "ru": "понедельник вторник среда четверг пятница суббота воскресенье пн вт ср чт пт сб вс",
    "uk": "понеділок вівторок середа четвер пятниця субота неділя",
    "ar": "الاثنين الإثنين الثلاثاء الأربعاء الخميس الجمعة السبت الأحد",
    "he": "שני שלישי רביעי חמישי שישי שבת ראשון יום",
    "fa": "دوشنبه سه‌شنبه چهارشنبه پنجشنبه جمعه شنبه یکشنبه",
}


def _fold(word: str) -> str:
    """Lower case without marks, so that spelling with or without accents agrees."""
    folded = unicodedata.normalize("NFKD", word.replace("İ", "i").replace("I", "i").lower().replace("ı", "i"))
    return "".join(c for c in folded if not unicodedata.combining(c)).replace("ي", "ی").replace("ك", "ک").replace("‌", "")


def _month_table() -> dict[str, int]:
    found: dict[str, int] = {}
    for names in MONTHS.values():
        for number, name in enumerate(names.split(), 1):
            found.setdefault(_fold(name), number)
    for number, name in enumerate(MONTHS["he"].split(), 1):
        found["ב" + _fold(name)] = number
    return found


_MONTH = _month_table()
_JALALI = {_fold(name): number for number, name in enumerate(JALALI_MONTHS.split(), 1)}
_WEEKDAY = {_fold(w) for names in WEEKDAYS.values() for w in names.split()}
_SKIP = {_fold(w) for w in _FILLERS}

_DROP = re.compile("[​-‏‪-‮⁠-⁩﻿­]")
_BLANK = re.compile(r"\s+")
_EPOCH_TEXT = re.compile(r"^(\d{10})(?:\.(\d+))?$|^(\d{13}|\d{16}|\d{19})$")
_ZONE = r"(?P<zone>z|[+-]\d{1,2}(?::?\d{2})?|(?:gmt|utc|ut)(?:[+-]\d{1,2}(?::?\d{2})?)?|[a-z]{2,5})?"
_CLOCK = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?"
_ISO = re.compile(rf"^(?P<y>\d{{4}})-(?P<mo>\d{{2}})-(?P<d>\d{{2}})(?:t| )\s*{_CLOCK}\s*{_ZONE}\s*(?:\[(?P<name>[a-z0-9_+\-/]+)\])?$")
_BASIC = re.compile(rf"^(?P<y>\d{{4}})(?P<mo>\d{{2}})(?P<d>\d{{2}})t?(?P<h>\d{{2}})(?P<mi>\d{{2}})(?:(?P<s>\d{{2}})(?:[.,](?P<f>\d+))?)?\s*{_ZONE}$")
_WEEK = re.compile(rf"^(?P<y>\d{{4}})-?w(?P<wk>\d{{2}})-?(?P<wd>\d)t{_CLOCK}\s*{_ZONE}$")
_ORDINAL = re.compile(rf"^(?P<y>\d{{4}})-(?P<yd>\d{{3}})t{_CLOCK}\s*{_ZONE}$")
_YEAR_FIRST = re.compile(rf"^(?P<y>\d{{4}})(?P<sep>[./])(?P<mo>\d{{1,2}})(?P=sep)(?P<d>\d{{1,2}})[, -]+{_CLOCK}\s*(?P<half>[ap]\.?m\.?)?\s*{_ZONE}$")
_NUMERIC = re.compile(rf"^(?P<a>\d{{1,2}})(?P<sep>[./-])(?P<b>\d{{1,2}})(?P=sep)(?P<y>\d{{4}}|\d{{2}})[, -]+{_CLOCK}\s*(?P<half>[ap]\.?m\.?)?\s*{_ZONE}$")
_CJK = re.compile(r"^(?P<y>\d{4})年(?P<mo>\d{1,2})月(?P<d>\d{1,2})日\s*(?:星期.|周.)?\s*(?P<half>上午|下午|凌晨|早上|晚上|中午)?\s*(?P<h>\d{1,2})(?:[:：点时])(?P<mi>\d{2})分?(?::?(?P<s>\d{2})秒?)?\s*$")
_TIME_IN_WORDS = re.compile(r"(?<![\d:.])(?P<h>\d{1,2})\s*(?:[:.h])\s*(?P<mi>\d{2})(?::(?P<s>\d{2})(?:\.(?P<f>\d+))?)?(?![\d:])")
_HALF_IN_WORDS = re.compile(r"(?<![^\W\d])(?P<half>[ap]\.?m\.?)(?![^\W\d])")
_OFFSET_IN_WORDS = re.compile(r"(?:\b(?:gmt|utc|ut))?\s*(?<!\d)(?P<zone>[+-]\d{1,2}(?::?\d{2})?)(?!\d)\s*(?:\([^)]*\))?$")


def clean_text(raw: str) -> str:
    """Digits of every script as ASCII, one kind of minus, plain blanks, lower case."""
    text = _DROP.sub("", raw)
    text = "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in text)
    text = text.replace("−", "-").replace("：", ":").replace("٫", ".")
    return _BLANK.sub(" ", text).strip()


@lru_cache(maxsize=4096)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except (ZoneInfoNotFoundError, ValueError, OSError):
        return None


@lru_cache(maxsize=4096)
def _zone_by_text(name: str) -> ZoneInfo | None:
    """A zone from its name in any letter case."""
    parts = ["_".join(w[:1].upper() + w[1:] for w in p.split("_")) for p in name.split("/")]
    return _zone("/".join(parts)) or _zone(name) or _zone(name.upper())


@lru_cache(maxsize=65536)
def _abbreviation(zone_name: str, abbreviation: str, year: int) -> int | None:
    """Seconds east of UTC that an abbreviation means in a zone around a year, if it means one thing."""
    zone = _zone(zone_name)
    if zone is None:
        return None
    for span in ((year, year + 1), (year - 15, year + 5)):
        seen = set()
        at = dt.datetime(max(1, span[0]), 1, 1, tzinfo=dt.timezone.utc)
        while at.year < span[1]:
            local = at.astimezone(zone)
            if (local.tzname() or "").lower() == abbreviation:
                seen.add(int(local.utcoffset().total_seconds()))
            at += dt.timedelta(days=7)
        if seen:
            return seen.pop() if len(seen) == 1 else None
    return None


def _offset(text: str) -> int | None:
    """Seconds east of UTC of ``+hh``, ``+hmm``, ``+hhmm`` or ``+h:mm``; None where it is no offset."""
    sign, digits = (-1 if text[0] == "-" else 1), text[1:]
    if ":" in digits:
        hours, minutes = digits.split(":")
    elif len(digits) > 2:
        hours, minutes = digits[:-2], digits[-2:]
    else:
        hours, minutes = digits, "0"
    if int(hours) > 15 or int(minutes) > 59:
        return None
    return sign * (int(hours) * 3600 + int(minutes) * 60)


def jalali_to_date(year: int, month: int, day: int) -> dt.date | None:
    """Civil date of a solar Hijri date, by the 33-year leap cycle."""
    length = 31 if month <= 6 else 30 if month <= 11 else 29 + (year % 33 in _JALALI_LEAPS)
    if not (1 <= month <= 12 and 1 <= day <= length):
        return None
    leaps = 8 * ((year - 1) // 33) + sum(r <= (year - 1) % 33 for r in _JALALI_LEAPS)
    before = 31 * (month - 1) if month <= 7 else 186 + 30 * (month - 7)
    return dt.date(622, 3, 21) + dt.timedelta(days=365 * (year - 1) + leaps + before + day - 1)


def _civil(year: int, month: int, day: int) -> dt.date | None:
    try:
        if 1300 <= year < 1500:
            return jalali_to_date(year, month, day)
        return dt.date(year, month, day)
    except ValueError:
        return None


def _instant(date: dt.date | None, parts: dict, zone_text: str | None, zone_name: str | None, feed_zone: str | None) -> int | None:
    """Milliseconds since 1970 of a date, a clock reading and whatever says the zone."""
    if date is None:
        return None
    hour, minute, second = int(parts["h"]), int(parts["mi"]), int(parts.get("s") or 0)
    half = parts.get("half")
    if half is not None:
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + 12 * half
    if hour > 23 or minute > 59 or second > 59:
        return None
    millis = int(((parts.get("f") or "") + "000")[:3])
    wall = dt.datetime(date.year, date.month, date.day, hour, minute, second)
    offset = None
    if zone_text:
        for prefix in ("gmt", "utc", "ut"):
            if zone_text.startswith(prefix) and len(zone_text) > len(prefix) and zone_text[len(prefix)] in "+-":
                zone_text = zone_text[len(prefix) :]
                break
        if zone_text in _UTC_NAMES:
            offset = 0
        elif zone_text[0] in "+-":
            offset = _offset(zone_text)
        elif feed_zone:
            offset = _abbreviation(feed_zone, zone_text, date.year)
        if offset is None:
            return None
    if zone_name and offset is None:
        feed_zone = zone_name
    if offset is None:
        zone = _zone(feed_zone) if feed_zone and not zone_name else _zone_by_text(zone_name) if zone_name else None
        if zone is None:
            return None
        early, late = wall.replace(tzinfo=zone).utcoffset(), wall.replace(tzinfo=zone, fold=1).utcoffset()
        if early != late:  # the clock skips this reading or shows it twice
            return None
        offset = int(early.total_seconds())
    return int((wall.replace(tzinfo=dt.timezone.utc) - _EPOCH) / dt.timedelta(seconds=1) - offset) * 1000 + millis


def _half(text: str | None) -> int | None:
    if not text:
        return None
    return {"a": 0, "p": 1, "上": 0, "凌": 0, "早": 0, "下": 1, "晚": 1, "中": 1}.get(text[0])


def _full_year(text: str) -> int:
    return 2000 + int(text) if len(text) == 2 else int(text)


def _in_words(text: str, feed_zone: str | None) -> int | None:
    """Dates that name the month, in any order of their parts."""
    clock = _TIME_IN_WORDS.search(text)
    if clock is None or _TIME_IN_WORDS.search(text, clock.end()):
        # an offset such as +05:30 also looks like a clock reading
        rest = text[clock.end() :] if clock else ""
        if clock is None or not re.search(r"[+-]\d{1,2}:\d{2}", rest):
            return None
    parts = clock.groupdict()
    head, tail = text[: clock.start()], text[clock.end() :]
    zone = None
    if found := _OFFSET_IN_WORDS.search(tail):
        zone, tail = found["zone"], tail[: found.start()]
    if found := _HALF_IN_WORDS.search(tail):
        parts["half"] = _half(found["half"])
        tail = tail[: found.start()] + " " + tail[found.end() :]
    month = jalali = day = year = None
    for place, words in enumerate((head, tail)):
        for word in re.findall(r"[^\W\d]+(?:[-'’‌][^\W\d]+)*|\d+", words.replace("_", " ")):
            if word.isdigit():
                if len(word) == 4 and year is None:
                    year = int(word)
                elif len(word) <= 2 and day is None:
                    day = int(word)
                elif len(word) == 2 and year is None:
                    year = 2000 + int(word)
                else:
                    return None
                continue
            folded = _fold(word)
            if month is None and jalali is None and folded in _MONTH:
                month = _MONTH[folded]
            elif month is None and jalali is None and folded in _JALALI:
                jalali = _JALALI[folded]
            elif folded in _WEEKDAY or folded in _SKIP:
                continue
            elif place == 1 and zone is None and folded.isascii() and 1 <= len(folded) <= 5:
                zone = folded
            else:
                return None
    if day is None or year is None or (month is None and jalali is None):
        return None
    if jalali is not None:
        date = jalali_to_date(year, jalali, day) if 1300 <= year < 1500 else None
    else:
        date = _civil(year, month, day) if year >= 1500 else None
    return _instant(date, parts, zone, None, feed_zone)


def read_instant(raw: str | None, feed_zone: str | None, day_first: bool | None) -> int | None:
    """Milliseconds since 1970-01-01 UTC, or None where the text gives no single instant.

    ``feed_zone`` is the zone of the feed's wall clock; ``day_first`` the order
    of all-numeric dates.  Finer digits are cut off.  No instant: no value, no
    calendar date, no time of day, relative words, impossible dates or times,
    and zoneless readings that the feed's clock skips or shows twice.
    """
    if raw is None:
        return None
    text = clean_text(raw)
    if found := _EPOCH_TEXT.match(text):
        if found[1]:
            return int(found[1]) * 1000 + int(((found[2] or "") + "000")[:3])
        return int(found[3]) // 10 ** (len(found[3]) - 13)
    low = text.lower() if "İ" not in text else text.replace("İ", "i").lower()
    for pattern in (_ISO, _BASIC):
        if found := pattern.match(low):
            g = found.groupdict()
            return _instant(_civil(int(g["y"]), int(g["mo"]), int(g["d"])), {**g, "half": None}, g["zone"], g.get("name"), feed_zone)
    if found := _WEEK.match(low):
        g = found.groupdict()
        try:
            date = dt.date.fromisocalendar(int(g["y"]), int(g["wk"]), int(g["wd"]))
        except ValueError:
            return None
        return _instant(date, {**g, "half": None}, g["zone"], None, feed_zone)
    if found := _ORDINAL.match(low):
        g = found.groupdict()
        date = dt.date(int(g["y"]), 1, 1) + dt.timedelta(days=int(g["yd"]) - 1)
        return _instant(date if int(g["yd"]) and date.year == int(g["y"]) else None, {**g, "half": None}, g["zone"], None, feed_zone)
    if found := _YEAR_FIRST.match(low):
        g = found.groupdict()
        return _instant(_civil(int(g["y"]), int(g["mo"]), int(g["d"])), {**g, "half": _half(g["half"])}, g["zone"], None, feed_zone)
    if found := _NUMERIC.match(low):
        g = found.groupdict()
        if day_first is None and g["a"] != g["b"]:
            return None
        day, month = (g["a"], g["b"]) if day_first else (g["b"], g["a"])
        return _instant(_civil(_full_year(g["y"]), int(month), int(day)), {**g, "half": _half(g["half"])}, g["zone"], None, feed_zone)
    if found := _CJK.match(low):
        g = found.groupdict()
        return _instant(_civil(int(g["y"]), int(g["mo"]), int(g["d"])), {**g, "half": _half(g["half"])}, None, None, feed_zone)
    return _in_words(low, feed_zone)
