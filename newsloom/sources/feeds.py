"""Feeds as a data source: documents from a pluggable transport, parsed strictly, else leniently.

``spark.read.format("newsfeeds").option("path", folder).load()`` reads one row
per item from the feed documents in a folder; the transport is a function from
an address to (status, content type, body), here the file system.
"""

from __future__ import annotations

import html
import os
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from newsloom.functions.instants import read_instant
from newsloom.operators.feed import xml_escape
from newsloom.plans.catalog import query
from newsloom.plans.runtime import table

Transport = Callable[[str], tuple[int, str, str]]

#: Publication dates later than the run by more than this, or earlier, count as wrong.
AHEAD_MS, BEHIND_MS = 600_000, 365 * 86_400_000
_SUMMARY = 500
_FEED_ROOT = re.compile(r"<(rss|feed|rdf:rdf)[\s>]", re.I)
_ENTITY = re.compile(r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[0-9a-fA-F]+);)(\w+;)?")
_ITEM = re.compile(r"<(item|entry)\b[^>]*>(.*?)</\1\s*>", re.S | re.I)


@dataclass
class Parsed:
    """Items of one document, how many dates were out of range, and what went wrong."""

    items: list[dict] = field(default_factory=list)
    clamped: int = 0
    error_kind: str | None = None
    detail: str | None = None


def strip_leading(body: str) -> str:
    """Without marks and blanks before the document."""
    return re.sub("^[﻿￾\\s]+", "", body)


def looks_blocked(body: str, content_type: str = "") -> bool:
    """Whether a reply is no feed: a feed's root among its first thousand characters settles it."""
    return not _FEED_ROOT.search(body[:1000])


def build_guid(guid: str | None, link: str | None) -> str:
    """The guid as it stands unless blank, else the link."""
    return guid if guid and guid.strip() else (link or "")


def parse_date(text: str | None, now_ms: int) -> tuple[int | None, bool]:
    """(instant, was out of range): null for unreadable dates and those outside the accepted range, ends included."""
    instant = read_instant(text, "UTC", False) if text else None
    if instant is None:
        return None, False
    return (instant, False) if now_ms - BEHIND_MS <= instant <= now_ms + AHEAD_MS else (None, True)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2].lower()


def _fields(element: ET.Element) -> dict[str, list]:
    found: dict[str, list] = {}
    for child in element:
        found.setdefault(_local(child.tag), []).append(child)
    return found


def _text(found: dict[str, list], *names: str) -> str | None:
    for name in names:
        for child in found.get(name, ()):
            text = "".join(child.itertext())
            if text:
                return text
    return None


def pick_link(found: dict[str, list]) -> str | None:
    """A plain link, else the alternate one, else the first with an address."""
    links = found.get("link", [])
    for link in links:
        if (link.text or "").strip():
            return link.text
    for link in links:
        if link.get("rel", "alternate") == "alternate" and link.get("href"):
            return link.get("href")
    return next((link.get("href") for link in links if link.get("href")), None)


def _item(found: dict[str, list], now_ms: int, lenient: bool) -> tuple[dict, bool]:
    link = pick_link(found)
    guid = build_guid(_text(found, "guid", "id"), link)
    date, clamped = parse_date(_text(found, "pubdate", "published", "updated", "date"), now_ms)
    title = _text(found, "title")
    summary = _text(found, "description", "summary", "content", "encoded")
    if lenient:
        title, summary = ((title or "(no title)").strip(), (summary or "").strip()[:_SUMMARY] or None)
    else:
        title = title.strip() if title is not None else "(no title)"
        summary = re.sub(r"<[^>]*>", "", summary).strip()[:_SUMMARY] if summary is not None else None
    return {"guid": guid, "title": title, "url": link or guid, "summary": summary, "published_ms": date}, clamped


def _from_root(root: ET.Element, now_ms: int, lenient: bool) -> Parsed:
    out = Parsed()
    for element in root.iter():
        if _local(element.tag) in ("item", "entry"):
            item, clamped = _item(_fields(element), now_ms, lenient)
            out.clamped += clamped
            if item["guid"]:
                out.items.append(item)
    return out


def parse_feed(body: str, now_ms: int, content_type: str = "", status: int = 200) -> Parsed:
    """Blocked replies, then the strict parser, then the lenient one if it finds an item; else a parse error."""
    if status >= 400:
        return Parsed(error_kind="http", detail=str(status))
    body = strip_leading(body)
    if looks_blocked(body, content_type):
        return Parsed(error_kind="blocked", detail="no feed")
    try:
        return _from_root(ET.fromstring(body), now_ms, lenient=False)
    except ET.ParseError as problem:
        detail = str(problem)
    out = Parsed()
    for _, inner in _ITEM.findall(body):
        repaired = _ENTITY.sub(lambda m: html.escape(html.unescape(m[0])) if m[1] else "&amp;" + m[0][1:], inner)
        repaired = re.sub(r"<(/?)(\w+):(\w+)", r"<\1\2_\3", repaired)
        try:
            root = ET.fromstring(f"<item>{repaired}</item>")
        except ET.ParseError:
            continue
        found = _fields(root)
        for name in list(found):
            if "_" in name:
                found.setdefault(name.partition("_")[2], found[name])
        item, clamped = _item(found, now_ms, lenient=True)
        out.clamped += clamped
        if item["guid"]:
            out.items.append(item)
    return out if out.items else Parsed(error_kind="parse", detail=detail)


def file_transport(address: str) -> tuple[int, str, str]:
    """A document from the file system."""
    with open(address, encoding="utf-8", errors="replace") as f:
        return 200, "application/xml", f.read()


def fetch(address: str, now_ms: int, proxy: Transport | None = None, direct: Transport = file_transport) -> tuple[Parsed, str]:
    """(result, way): by the proxy first, else directly; if both fail the proxy's kind of error stays, with both details."""
    first: Parsed | None = None
    for way, transport in (("proxy", proxy), ("direct", direct)):
        if transport is None:
            continue
        try:
            status, kind, body = transport(address)
            result = parse_feed(body, now_ms, kind, status)
        except TimeoutError as problem:
            result = Parsed(error_kind="timeout", detail=str(problem))
        except OSError as problem:
            result = Parsed(error_kind="network", detail=str(problem))
        if result.error_kind is None:
            return result, way
        if first is None:
            first = result
        else:
            first.detail = f"{first.detail}; {result.detail}"
    return first or Parsed(error_kind="network", detail="no transport"), "proxy" if proxy else "direct"


class _Part(InputPartition):
    def __init__(self, addresses: list[str]):
        self.addresses = addresses


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.now_ms, self.tasks = options["path"], int(options.get("now_ms", "4102444800000")), int(options.get("partitions", "8"))

    def partitions(self) -> list[InputPartition]:
        names = sorted(os.path.join(self.path, n) for n in os.listdir(self.path) if n.endswith((".xml", ".rss", ".atom")))
        return [_Part(names[i :: self.tasks]) for i in range(min(self.tasks, len(names)))] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for address in partition.addresses:
            result, way = fetch(address, self.now_ms)
            if result.error_kind:
                yield (address, None, None, None, None, None, way, result.error_kind, result.detail)
            for i in result.items:
                yield (address, i["guid"], i["title"], i["url"], i["summary"], i["published_ms"], way, None, None)


class FeedSource(DataSource):
    """Feed documents in a folder; the number of partitions bounds how many are fetched at once."""

    @classmethod
    def name(cls) -> str:
        return "newsfeeds"

    def schema(self) -> str:
        return "feed string, guid string, title string, url string, summary string, published_ms long, via string, error_kind string, detail string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    """Make ``newsfeeds`` known to a session."""
    spark.dataSource.register(FeedSource)


@query(
    "parse_feed",
    "SELECT id, coalesce(CASE WHEN trim(guid) <> '' THEN replace(replace(guid, chr(13) || chr(10), chr(10)), chr(13), chr(10)) END, '') AS guid, coalesce(replace(replace(url, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '') AS url FROM feed_items WHERE trim(guid) <> '' AND trim(url) <> ''",
)
def parse_feed_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every delivered item written as a feed document and read back by the parser."""
    rows = table(spark, sf_dir, "feed_items").select("id", "guid", "url", "title").filter("trim(guid) <> '' and trim(url) <> ''")
    part = lambda tag, c: F.concat(F.lit(f"<{tag}>"), xml_escape(F.coalesce(c, F.lit(""))), F.lit(f"</{tag}>"))
    docs = rows.select("id", F.concat(F.lit('<rss version="2.0"><channel><item>'), part("guid", "guid"), part("link", "url"), part("title", "title"), F.lit("</item></channel></rss>")).alias("xml"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(key, i["guid"], i["url"]) for key, xml in zip(pdf["id"], pdf["xml"]) for i in parse_feed(xml, 0).items]
            yield pd.DataFrame(found, columns=["id", "guid", "url"])

    return docs.mapInPandas(read, "id string, guid string, url string")


@query("feed_blocked", "SELECT url, NOT regexp_matches(substr(content, 1, 1000), '(?i)<(rss|feed|rdf:rdf)[\\s>]') AS blocked FROM article_content")
def feed_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a reply (here: stored pages) is no feed."""
    return table(spark, sf_dir, "article_content").select("url", (~F.substring("content", 1, 1000).rlike(r"(?i)<(rss|feed|rdf:rdf)[\s>]")).alias("blocked"))
