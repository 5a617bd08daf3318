"""Main text of web pages, by the distribution of text over blocks of lines.

Markup is stripped line by line, and the text lengths of WINDOW neighbouring
lines are summed.  Where the sums rise to SURGE there is a surge point, where
they fall below it a dive point, and text between the two is kept.  Three kinds
of lines do not count towards the sums: links, lines in elements that are
furniture by their name, and lines whose parts the site (or the collection)
repeats on many pages, which is counted over all pages beforehand.

A block between surge and dive may still be a list of teasers, and a teaser may
stand within the report.  A block is kept if it has to do with the page's own
headline (it names one of the headline's rare words) or is dense running text;
single lines are then judged by the same evidence.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from newsloom.plans.runtime import park, table
from newsloom.plans.skew import split_join

#: Lines whose text lengths are summed.
WINDOW = 3
#: Letters that a Chinese character counts for, so that lengths mean the same amount of text.
HAN_LETTERS = 3
#: Sum of characters at which a block of text begins and below which it ends.
SURGE = 90
#: A part of a line is furniture if so large a share of a site's pages, and so many of them, have it ...
SITE_SHARE, SITE_PAGES = 0.06, 3
#: ... or so large a share of all pages, and so many of them.
ALL_SHARE, ALL_PAGES = 0.002, 4
#: A headline word is rare if no more than so large a share of all headlines (or so many) have it.
WORD_SHARE, WORD_COUNT = 0.0005, 3
#: Characters of a paragraph that is running text whatever it is about.
DENSE = 240
#: Names of furniture that may be broadcast (8 bytes each); beyond it pages are shuffled, hot parts in blocks.
BROADCAST_PARTS = 500_000

_TAG = re.compile(r"<[^<>]*>")
_ANCHOR = re.compile(r"<a\b[^>]*>(.*?)</a>", re.I | re.S)
_OPEN = re.compile(r"<(/?)(nav|footer|aside|header|form|menu|script|style|noscript|select)\b[^>]*>", re.I)
# Words in class and id names that mark furniture.
_CUE = re.compile(r"""(?:class|id|role)\s*=\s*["'][^"']*(?<![a-z])(?:nav|menu|foot|footer|share|sharing|social|tags?|keywords|meta|byline|dateline|teaser|related|recommend\w*|promo|newsletter|nl|cookie|consent|cc|comments?|breadcrumb|banner|sidebar|sh|ad|ads)(?![a-z])""", re.I)
_PARTS = re.compile(r"[.|–—·•/:!?。！？؟：｜]+|\s{2,}|\s-\s")
_NUMBERS = re.compile(r"[(\[（]?\d[\d.,:\-–/ ]*[)\]）]?")
_EDGE = " \t\"'“”„«»()[]（）,;،、，…*_-–"
_LETTER = re.compile(r"[^\W\d_]")
_NO_LETTERS = re.compile(r"[\W\d_]+")
_DATE = re.compile(r"\d{1,4}[./-]\d{1,2}[./-]\d{1,4}|\d{1,2}:\d{2}")
_SENTENCE_END = re.compile(r"[.!?。！？؟…][\"'”“»’)\]]*\s*(?:\([^()]{0,40}\))?$")
_NUMBERED = re.compile(r"^\s*\d{1,2}\s*[.)]\s+\S")
_COLON_END = re.compile(r"[:：]\s*$")
_CJK = re.compile(r"[㐀-䶿一-鿿]+")
_WORD = re.compile(r"[^\W\d_㐀-䶿一-鿿]{3,}")
_HEADLINE_SHAPE = re.compile(r"^[^:：]{2,40}[:：]\s*\S|[–—]\s*\S+(?:\s\S+)?\s*(?:\.\.\.|…)?$|\([^()]{2,30}\)\s*(?:\.\.\.|…)?$")
_HEADING = re.compile(r"\s*<h([1-6])\b", re.I)
_DIGIT = re.compile(r"\d")
_ITEMS = re.compile(r"\s*[,،、，;]\s*")


def line_text(line: str) -> str:
    """Visible text of a line."""
    return html.unescape(_TAG.sub(" ", line)).replace("\xa0", " ").strip() if "<" in line or "&" in line else line.replace("\xa0", " ").strip()


def line_parts(text: str) -> list[tuple[str, int]]:
    """Parts of a line between stops, bars and dashes, with numbers left out, and their number of letters."""
    found = []
    for part in _PARTS.split(_NUMBERS.sub(" ", text)):
        part = " ".join(part.strip(_EDGE).lower().split())
        letters = len(_NO_LETTERS.sub("", part))
        if letters:
            found.append((part, letters))
    return found


def part_hash(part: str) -> int:
    """Name of a part of a line."""
    return xxhash.xxh3_64_intdigest(part) - (1 << 63)


@lru_cache(maxsize=50_000)
def hashed_parts(text: str) -> tuple[tuple[int, int], ...]:
    """Names of the parts of a line and their letters; a site's furniture is read once for many pages."""
    return tuple((part_hash(p), n) for p, n in line_parts(text))


def title_words(title: str | None) -> set[str]:
    """Words of three letters and more; pairs of Chinese characters."""
    title = (title or "").lower()
    pairs = {run[i : i + 2] for run in _CJK.findall(title) for i in range(len(run) - 1)}
    return set(_WORD.findall(title)) | pairs


class _Line:
    __slots__ = ("text", "size", "empty", "furniture", "link", "cue", "numbered", "named", "ended", "meta", "items", "head", "colon", "shape", "heading", "teaser_mark")


def _read_lines(content: str, furniture: set[int]) -> list[_Line]:
    lines, depth = [], 0
    for raw in content.split("\n"):
        line = _Line()
        line.text = text = line_text(raw)
        line.size = len(text) + (0 if text.isascii() else (HAN_LETTERS - 1) * sum(map(len, _CJK.findall(text))))
        line.empty = not _LETTER.search(text)
        opened = depth > 0
        for close, _ in _OPEN.findall(raw) if "<" in raw else ():
            depth = max(0, depth - 1) if close else depth + 1
            opened = opened or not close
        parts = hashed_parts(text)
        letters = sum(n for _, n in parts)
        repeated = sum(n for p, n in parts if p in furniture)
        line.furniture = bool(letters) and repeated >= 0.55 * letters
        linked = sum(len(line_text(a)) for a in _ANCHOR.findall(raw)) if "<a" in raw else 0
        line.link = linked >= 0.6 * max(1, len(text))
        line.cue = opened or bool("=" in raw and _CUE.search(raw))
        heading = _HEADING.match(raw) if "<" in raw else None
        line.heading = heading is not None
        line.head = heading is not None and heading[1] == "1"
        line.numbered = bool(_NUMBERED.match(text))
        line.ended = bool(_SENTENCE_END.search(text))
        line.meta = line.size < 90 and not line.ended and bool(_DATE.search(text))
        items = [] if line.ended or _DIGIT.search(text) else _ITEMS.split(text)
        line.items = len(items) >= 3 and all(0 < len(i) <= 45 and len(i.split()) <= 6 for i in items)
        line.colon = bool(_COLON_END.search(text))
        line.shape = not line.ended and line.size < 160 and bool(_HEADLINE_SHAPE.search(text))
        line.named = False
        line.teaser_mark = "teaser" in raw
        lines.append(line)
    return lines


def _blocks(lines: list[_Line], window: int, surge: int) -> list[tuple[int, int]]:
    """Half-open ranges between surge and dive points of the window sums, trimmed to lines that count."""
    weight = [0 if x.empty or x.furniture or x.link or x.cue or x.meta else x.size for x in lines]
    n = len(weight)
    sums = [sum(weight[max(0, i - window // 2) : i + window // 2 + 1]) for i in range(n)]
    found, i = [], 0
    while i < n:
        if sums[i] < surge:
            i += 1
            continue
        j = i
        while j < n and sums[j] >= surge:
            j += 1
        start, end = i, j
        while start < end and weight[start] == 0:
            start += 1
        while end > start and weight[end - 1] == 0:
            end -= 1
        if start < end:
            found.append((start, end))
        i = j
    return found


def _squash(text: str) -> str:
    return re.sub(r"[\W_]+", "", text.lower())


def body_lines(title: str | None, content: str, furniture: set[int], common: set[str], *, window: int = WINDOW, surge: int = SURGE) -> list[int]:
    """Numbers of the lines that belong to the page's own report."""
    lines = _read_lines(content, furniture)
    blocks = _blocks(lines, window, surge)
    if not blocks:
        return []
    squashed = _squash(title or "")
    headline = next((i for i, x in enumerate(lines) if x.head and not x.furniture), None)
    if headline is None and squashed:
        headline = next((i for i, x in enumerate(lines) if x.size < 400 and _squash(x.text) == squashed), None)
    if headline is None and not squashed:
        first = next((i for i, x in enumerate(lines) if not (x.empty or x.furniture or x.link or x.cue or x.meta)), None)
        if first is not None and lines[first].shape:
            headline = first
    names = title_words(title) | (title_words(lines[headline].text) if headline is not None else set())
    rare = {w for w in names if w not in common}
    for i, x in enumerate(lines):
        low = x.text.lower()
        x.named = i != headline and any(w in low for w in rare)

    def out(x: _Line) -> bool:
        return x.empty or x.furniture or x.link or x.cue or x.meta or x.items

    # a headline of another report also takes the sentences that name its own rare words
    promoted: set[int] = set()
    other: set[str] = set()
    for i, x in enumerate(lines):
        if x.empty or i == headline:
            continue
        if x.named:
            other = set()
        elif not x.furniture and (x.link or x.shape):
            other = {w for w in title_words(x.text) if w not in common}
        elif other and any(w in x.text.lower() for w in other):
            promoted.add(i)
    passages: list[list[int]] = []
    for start, end in blocks:
        # lines of furniture part a block into passages
        passage: list[int] = []
        for i in range(start, end):
            x = lines[i]
            if i == headline or out(x):
                if passage and (x.furniture or x.cue) and not x.empty:
                    passages.append(passage)
                    passage = []
                continue
            before = next((lines[j] for j in range(i - 1, -1, -1) if not lines[j].empty), None)
            if before is not None and before.furniture and before.colon and not x.ended and x.size < 200 and not x.named:
                continue
            if i in promoted or x.numbered and not x.named and not x.ended:
                continue
            passage.append(i)
        if passage:
            passages.append(passage)

    named_at = [i for p in passages for i in p if lines[i].named]
    last_named = named_at[-1] if named_at else -1
    after_headline = None
    if headline is not None:
        after_headline = next((i for i in range(headline + 1, len(lines)) if not (lines[i].empty or lines[i].meta)), None)
    kept: list[int] = []
    for passage in passages:
        sure = {i for i in passage if lines[i].named or lines[i].size >= DENSE and lines[i].ended}
        # what stands between the headline and the last line about it is the report too, and so is what follows the headline at once
        inner = passage[0] < last_named and (headline is None or passage[0] > headline)
        opening = passage[0] == after_headline and not lines[passage[0]].shape
        if not sure and not inner and not opening:
            continue
        last = max(sure) if sure else -1
        for i in passage:
            x = lines[i]
            if i in sure or i < last_named and i > (headline if headline is not None else -1) and not x.shape or i < last and not (x.shape or x.heading) or (opening or sure) and not x.shape and not x.heading:
                kept.append(i)
    return sorted(kept)


def _site(url: F.Column) -> F.Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)), r"^(www|m|amp)\.", "")


def furniture_parts(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parts, repeated): every page's distinct line parts, and the names of those that are furniture."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sites, names = [], [], []
            for key, site, content in zip(*(batch.column(c).to_pylist() for c in ("url", "site", "content"))):
                for name in {p for line in content.split("\n") for p, _ in hashed_parts(line_text(line))}:
                    keys.append(key)
                    sites.append(site)
                    names.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(sites, pa.string()), pa.array(names, pa.int64())], names=["url", "site", "part"])

    found = park(pages.select("url", _site(F.col("url")).alias("site"), "content").mapInArrow(parts, "url string, site string, part long"), "page-parts")
    total = pages.count()
    sizes = pages.groupBy(_site(F.col("url")).alias("site")).agg(F.count(F.lit(1)).alias("pages"))
    by_site = found.groupBy("part", "site").agg(F.count(F.lit(1)).alias("n")).join(sizes, "site")
    shares = by_site.groupBy("part").agg(F.sum("n").alias("n"), F.max(F.when(F.col("n") >= SITE_PAGES, F.col("n") / F.col("pages"))).alias("share"))
    repeated = shares.filter((F.col("share") >= SITE_SHARE) | (F.col("n") >= max(ALL_PAGES, ALL_SHARE * total))).select("part")
    return found, repeated


def main_text(pages: DataFrame, *, url_col: str = "url", title_col: str = "title", content_col: str = "content") -> DataFrame:
    """``url``, ``line_no``, ``line``: the lines of each page's own report, as stored; the first line is 0.

    Null urls and null or empty contents give no lines, pages without a report
    give none either; rows of one url that differ are pages each, equal ones
    give their lines once (in the counts each is a page); an empty table gives an empty result; further columns are
    ignored.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(url_col).alias("url"), F.col(title_col).alias("title"), F.col(content_col).alias("content")).filter("url is not null and content <> ''")
    found, repeated = furniture_parts(rows)
    words = rows.select("title").mapInArrow(_title_words, "word string").groupBy("word").count()
    # at most 1 / WORD_SHARE times the words of a headline
    limit = max(WORD_COUNT, WORD_SHARE * rows.count())
    common = spark.sparkContext.broadcast({r[0] for r in words.filter(F.col("count") > limit).select("word").collect()})
    # a part of furniture is on very many pages
    if repeated.count() <= BROADCAST_PARTS:
        marked = found.join(F.broadcast(repeated), "part")
    else:
        marked = split_join(found, repeated.withColumn("name", F.col("part")), "part", left_by="url", right_by="name", counted=found.select("part"))
    marks = marked.groupBy("url").agg(F.collect_set("part").alias("parts"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls, numbers, texts = [], [], []
            for url, title, content, parts in zip(*(batch.column(c).to_pylist() for c in ("url", "title", "content", "parts"))):
                lines = content.split("\n")
                for i in body_lines(title, content, set(parts or ()), common.value):
                    urls.append(url)
                    numbers.append(i)
                    texts.append(lines[i])
            yield pa.RecordBatch.from_arrays([pa.array(urls, pa.string()), pa.array(numbers, pa.int32()), pa.array(texts, pa.string())], names=["url", "line_no", "line"])

    # one shuffle serves both: rows that lie together by url are told apart and joined where they are
    return rows.repartition("url").distinct().join(marks, "url", "left").select("url", "title", "content", "parts").mapInArrow(extract, "url string, line_no int, line string")


def _title_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([w for t in batch.column("title").to_pylist() for w in sorted(title_words(t))], pa.string())], names=["word"])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``url``, ``line_no``: each line that belongs to the main body of its page."""
    return main_text(table(spark, sf_dir, "article_content").select("url", "title", "content")).select("url", "line_no").distinct()
