"""HTML functions on the standard parser: sanitising, text, text segments."""

from __future__ import annotations

from html import escape
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import functions as F, types as T

# Elements kept by the sanitiser, attributes kept by element, elements dropped with their content.
KEEP = set("a abbr article aside b blockquote br caption cite code dd div dl dt em figcaption figure footer h1 h2 h3 h4 h5 h6 header hr i img li main ol p pre q s section small span strong sub sup table tbody td tfoot th thead time tr u ul".split())
ATTRIBUTES = {"a": {"href", "title"}, "img": {"src", "alt", "title", "width", "height"}, "td": {"colspan", "rowspan"}, "th": {"colspan", "rowspan"}, "time": {"datetime"}}
DROP = set("script style noscript iframe object embed form input button textarea select svg math template head title".split())
BLOCKS = set("p h1 h2 h3 li blockquote".split())
VOID = set("br hr img input meta link embed source wbr area base col".split())
NO_TEXT = set("script style code pre".split())


def safe_url(value: str | None, base: str | None, images: bool = False) -> str | None:
    """An absolute http(s) (or mailto) url, or None."""
    joined = urljoin(base or "", "".join(c for c in (value or "") if c > " ").strip())
    try:
        parts = urlsplit(joined)
    except ValueError:
        return None
    if parts.scheme in ("http", "https") and parts.netloc or parts.scheme == "mailto" and not images:
        return joined
    return None


class _Sanitiser(HTMLParser):
    def __init__(self, base: str | None):
        super().__init__(convert_charrefs=True)
        self.base, self.out, self.dropped, self.open = base, [], 0, []

    def handle_starttag(self, tag, attrs):
        if tag in DROP:
            self.dropped += tag not in VOID
            return
        if self.dropped or tag not in KEEP:
            return
        kept = []
        for name, value in attrs:
            if name not in ATTRIBUTES.get(tag, ()):
                continue
            if name in ("href", "src"):
                value = safe_url(value, self.base, images=name == "src")
                if value is None:
                    continue
            kept.append(f' {name}="{escape(value or "", quote=True)}"')
        if tag == "a":
            kept.append(' target="_blank" rel="noopener noreferrer"')
        if tag == "img":
            if not any(k.startswith(" src=") for k in kept):
                return
            kept.append(' loading="lazy"')
        self.out.append(f"<{tag}{''.join(kept)}>")
        if tag not in VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in DROP:
            self.dropped = max(0, self.dropped - (tag not in VOID))
        elif not self.dropped and tag in self.open:
            while self.open:
                last = self.open.pop()
                self.out.append(f"</{last}>")
                if last == tag:
                    break

    def handle_data(self, data):
        if not self.dropped:
            self.out.append(escape(data, quote=False))


def sanitise(html: str | None, base: str | None = None) -> str | None:
    """HTML with known elements and attributes only, urls absolute and safe; null for null."""
    if html is None:
        return None
    parser = _Sanitiser(base)
    parser.feed(html)
    parser.close()
    return "".join(parser.out) + "".join(f"</{t}>" for t in reversed(parser.open))


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.all, self.depth, self.silent, self.now = [], [], 0, 0, []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.silent += 1
        elif tag in BLOCKS:
            if self.depth == 0:
                self.now = []
            self.depth += 1
        elif tag == "br":
            self.handle_data("\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.silent = max(0, self.silent - 1)
        elif tag in BLOCKS and self.depth:
            self.depth -= 1
            if self.depth == 0 and (text := " ".join("".join(self.now).split())):
                self.blocks.append(text)

    def handle_data(self, data):
        if not self.silent:
            self.all.append(data)
            if self.depth:
                self.now.append(data)


def text_of(html: str | None) -> str | None:
    """Text of the outermost blocks, parted by blank lines; all text where the blocks hold less than 60 % of it."""
    if html is None:
        return None
    parser = _Text()
    parser.feed(html)
    parser.close()
    blocks, whole = "\n\n".join(parser.blocks), " ".join("".join(parser.all).split())
    return blocks if len(blocks) >= 0.6 * len(whole) else whole


class _Segments(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.silent = [], 0

    def handle_starttag(self, tag, attrs):
        self.silent += tag in NO_TEXT

    def handle_endtag(self, tag):
        self.silent = max(0, self.silent - (tag in NO_TEXT))

    def handle_data(self, data):
        if not self.silent and data.strip():
            self.found.append(data)


def segments_of(html: str | None, most: int = 100) -> list[str]:
    """Text nodes outside scripts, styles and code, blanks around them kept; the first ``most`` of them, as one request carries."""
    parser = _Segments()
    parser.feed(html or "")
    parser.close()
    return parser.found[:most]


@F.pandas_udf(T.StringType())
def clean_html(html: pd.Series, base: pd.Series) -> pd.Series:
    """``sanitise`` on a column."""
    return pd.Series([sanitise(h, b) for h, b in zip(html, base)], dtype=object)


@F.pandas_udf(T.StringType())
def html_text(html: pd.Series) -> pd.Series:
    """``text_of`` on a column."""
    return html.map(text_of)


@F.pandas_udf(T.ArrayType(T.StringType()))
def html_segments(html: pd.Series) -> pd.Series:
    """``segments_of`` on a column."""
    return html.map(segments_of)
