"""One form for texts that read the same but differ in their characters.

Compatibility forms, ways of composing accents, characters that show nothing
and kinds of blanks are settled character by character.  Look-alike letters of
other scripts are repaired with regard to script: the dominant script of each
token is determined, and letters of another script are replaced by their
look-alikes only in tokens that mix scripts (or that could be written in either
and stand in a text of the other), and only if the repaired token exists in the
vocabulary of the whole collection.

Scale.  Each distinct text is read once.  The vocabulary is a table that the few
suspicious tokens are joined with; it is never broadcast or collected.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from newsloom.plans.runtime import park, table
from newsloom.plans.skew import split_join

# Letters that look like a Latin letter, by script.
CYRILLIC_LOOKALIKES = dict(zip("аеорсухѕіјһԁԛԝӏАВЕНІЈКМОРСТУХЅҺԌԚԜҮѴ", "aeopcyxsijhdqwlABEHIJKMOPCTYXShGQWYV"))
GREEK_LOOKALIKES = dict(zip("ονιαρυκγΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϲϳ", "oviapukyABEZHIKMNOPTYXCcj"))
# Radicals of Chinese characters whose form equals a character, by code point; NFKC covers the others.
RADICALS = {
    0x2E81: 0x5382, 0x2E84: 0x4E59, 0x2E85: 0x4EBB, 0x2E86: 0x5182, 0x2E88: 0x5200, 0x2E89: 0x5202, 0x2E8A: 0x535C, 0x2E8C: 0x5C0F, 0x2E8D: 0x5C0F, 0x2E8E: 0x5140, 0x2E8F: 0x5C23,
    0x2E90: 0x5C22, 0x2E92: 0x5DF3, 0x2E93: 0x5E7A, 0x2E94: 0x5F51, 0x2E96: 0x5FC4, 0x2E98: 0x624C, 0x2E99: 0x6535, 0x2E9B: 0x65E1, 0x2E9C: 0x65E5, 0x2E9D: 0x6708, 0x2E9E: 0x6B7A,
    0x2EA0: 0x6C11, 0x2EA1: 0x6C35, 0x2EA2: 0x6C3A, 0x2EA3: 0x706C, 0x2EA4: 0x722B, 0x2EA5: 0x722B, 0x2EA6: 0x4E2C, 0x2EA7: 0x725B, 0x2EA8: 0x72AD, 0x2EA9: 0x738B, 0x2EAB: 0x7F52,
    0x2EAC: 0x793A, 0x2EAD: 0x793B, 0x2EAE: 0x7AF9, 0x2EAF: 0x7CF9, 0x2EB0: 0x7E9F, 0x2EB1: 0x7F53, 0x2EB2: 0x7F52, 0x2EB6: 0x7F8A, 0x2EB7: 0x7F8A, 0x2EB8: 0x7F8B, 0x2EB9: 0x8002,
    0x2EBA: 0x8080, 0x2EBB: 0x807F, 0x2EBC: 0x8089, 0x2EBD: 0x81FC, 0x2EBE: 0x8279, 0x2EBF: 0x8279, 0x2EC0: 0x8279, 0x2EC1: 0x864E, 0x2EC2: 0x8864, 0x2EC3: 0x8980, 0x2EC4: 0x897F,
    0x2EC5: 0x89C1, 0x2EC6: 0x89D2, 0x2EC8: 0x8BA0, 0x2EC9: 0x8D1D, 0x2ECB: 0x8F66, 0x2ECC: 0x8FB6, 0x2ECD: 0x8FB6, 0x2ECE: 0x8FB6, 0x2ECF: 0x9091, 0x2ED0: 0x9485, 0x2ED1: 0x9577,
    0x2ED2: 0x9578, 0x2ED3: 0x957F, 0x2ED4: 0x95E8, 0x2ED6: 0x961D, 0x2ED7: 0x96E8, 0x2ED8: 0x9752, 0x2ED9: 0x97E6, 0x2EDA: 0x9875, 0x2EDB: 0x98CE, 0x2EDC: 0x98DE, 0x2EDD: 0x98DF,
    0x2EDF: 0x98E0, 0x2EE0: 0x9963, 0x2EE2: 0x9A6C, 0x2EE3: 0x9AA8, 0x2EE4: 0x9B3C, 0x2EE5: 0x9C7C, 0x2EE6: 0x9E1F, 0x2EE7: 0x5364, 0x2EE8: 0x9EA6, 0x2EE9: 0x9EC4, 0x2EEA: 0x9EFE,
    0x2EEB: 0x6589, 0x2EEC: 0x9F50, 0x2EED: 0x6B6F, 0x2EEE: 0x9F7F, 0x2EEF: 0x7ADC, 0x2EF0: 0x9F99, 0x2EF1: 0x9F9C, 0x2EF2: 0x4E80,
}
# Single characters of one script that look like another of it.
SAME_SCRIPT = {"ي": "ی", "ك": "ک", "۰": "٠", "۱": "١", "۲": "٢", "۳": "٣", "۷": "٧", "۸": "٨", "۹": "٩", "‐": "-", "‑": "-", "∶": ":", "׃": ":", "ꓽ": ":"}
# Letters of the Arabic script that do not join to the next letter.
_UNJOINED = set("اأإآٱدذرزژڈڑوؤةءى")

_TO_LATIN = CYRILLIC_LOOKALIKES | GREEK_LOOKALIKES
_SETTLE = {ord(a): b for a, b in SAME_SCRIPT.items()} | {a: chr(b) for a, b in RADICALS.items()}
_TOKEN = re.compile(r"[^\W\d_][̀-ͯ]*(?:[^\W\d_][̀-ͯ]*|['’](?=[^\W\d_]))*")
_ZWNJ = "‌"


def _inverse(table_: dict[str, str]) -> dict[str, str]:
    found: dict[str, str] = {}
    for other, latin in table_.items():
        found.setdefault(latin, other)
    return found


#: Look-alike in one script (second key) of a letter in another (first key).
_BETWEEN = {
    ("cyrillic", "latin"): CYRILLIC_LOOKALIKES,
    ("greek", "latin"): GREEK_LOOKALIKES,
    ("latin", "cyrillic"): _inverse(CYRILLIC_LOOKALIKES),
    ("latin", "greek"): _inverse(GREEK_LOOKALIKES),
}
_BETWEEN["greek", "cyrillic"] = {g: _BETWEEN["latin", "cyrillic"][x] for g, x in GREEK_LOOKALIKES.items() if x in _BETWEEN["latin", "cyrillic"]}
_BETWEEN["cyrillic", "greek"] = {c: _BETWEEN["latin", "greek"][x] for c, x in CYRILLIC_LOOKALIKES.items() if x in _BETWEEN["latin", "greek"]}


def script(letter: str) -> str | None:
    """latin, cyrillic or greek; None for everything else."""
    code = ord(letter)
    if code < 0x250 or 0x1E00 <= code < 0x1F00 or 0x250 <= code < 0x2B0:
        return "latin" if letter.isalpha() else None
    if 0x370 <= code < 0x400 or 0x1F00 <= code < 0x2000:
        return "greek" if letter.isalpha() else None
    if 0x400 <= code < 0x530 or 0x1C80 <= code < 0x1C90 or 0x2DE0 <= code < 0x2E00 or 0xA640 <= code < 0xA6A0:
        return "cyrillic" if letter.isalpha() else None
    return None


def _shows_nothing(c: str) -> bool:
    code = ord(c)
    return unicodedata.category(c) in ("Cf", "Cc") and c not in "\t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85" or code in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF or 0x180B <= code <= 0x180F


def settle(text: str) -> str:
    """Compatibility forms, composition, invisible characters, blanks and look-alikes within one script."""
    if text.isascii() and text.isprintable():
        return text.strip()
    keep = []
    for i, c in enumerate(text):
        if c == _ZWNJ:
            # where it parts two letters that would join, it shows
            before = next((x for x in reversed(text[:i]) if not _shows_nothing(x)), "")
            after = next((x for x in text[i + 1 :] if not _shows_nothing(x)), "")
            if before and after and "؀" <= before <= "ۿ" and before.isalpha() and before not in _UNJOINED and "؀" <= after <= "ۿ" and after.isalpha():
                keep.append(c)
        elif c.isspace():
            keep.append(" ")
        elif not _shows_nothing(c):
            keep.append(c)
    settled = unicodedata.normalize("NFKC", "".join(keep)).translate(_SETTLE)
    return unicodedata.normalize("NFC", "".join(" " if c.isspace() else c for c in settled)).strip()


def _swap(token: str, dominant: str) -> str | None:
    """The token with all letters in the dominant script, or None if one has no look-alike there."""
    out = []
    for c in unicodedata.normalize("NFD", token):
        s = script(c)
        if s is None or s == dominant:
            out.append(c)
        elif (x := _BETWEEN[s, dominant].get(c)) is not None:
            out.append(x)
        else:
            return None
    return unicodedata.normalize("NFC", "".join(out))


def repairs(text: str) -> list[tuple[int, int, str]]:
    """(start, end, repaired token) of the suspicious tokens of a settled text, the likelier repair of a token first."""
    if text.isascii():
        return []
    whole = Counter(s for c in text if (s := script(c)))
    if len(whole) < 2:
        return []
    found = []
    for m in _TOKEN.finditer(text):
        token = unicodedata.normalize("NFD", m[0])
        scripts = Counter(s for c in token if (s := script(c)))
        if not scripts:
            continue
        if len(scripts) == 1:
            (own,) = scripts
            for target, n in whole.most_common():
                if target == own or n <= whole[own]:
                    break
                if fixed := _swap(m[0], target):
                    found.append((m.start(), m.end(), fixed))
                    break
            continue
        # letters without a look-alike elsewhere say most about a token's script
        proper = Counter(s for c in token if (s := script(c)) and not any(c in _BETWEEN[s, o] for o in scripts if o != s))
        for s in sorted(scripts, key=lambda s: (-proper[s], -whole[s], -scripts[s], s)):
            if (fixed := _swap(m[0], s)) is not None:
                found.append((m.start(), m.end(), fixed))
    return found


def _apply(text: str, fixes: list[tuple[int, int, str]], known: set[str]) -> str:
    chosen: dict[tuple[int, int], str] = {}
    for start, end, fixed in fixes:
        if fixed.lower() in known:
            chosen.setdefault((start, end), fixed)
    for (start, end), fixed in sorted(chosen.items(), reverse=True):
        text = text[:start] + fixed + text[end:]
    return unicodedata.normalize("NFC", text)


def one_form(texts: DataFrame, text_col: str = "title") -> DataFrame:
    """``text``, ``form``: every distinct text and its one form.

    Null texts are left out, an empty text keeps an empty form, repeated texts
    come once, an empty table gives an empty result; further columns do not
    matter.  A repaired token must exist in the collection, as a token in one
    script or as the repair of at least two spellings.
    """
    distinct = texts.select(F.col(text_col).alias("text")).filter("text is not null").distinct()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("text").to_pylist()
            settled = [settle(t) for t in raw]
            fixes = [repairs(t) for t in settled]
            tokens = []
            for t, f in zip(settled, fixes):
                suspicious = {(a, b) for a, b, _ in f}
                tokens.append(sorted({m[0].lower() for m in _TOKEN.finditer(t) if (m.start(), m.end()) not in suspicious}))
            pairs = [[{"spelling": t[a:b], "fixed": x.lower()} for a, b, x in f] for t, f in zip(settled, fixes)]
            kind = pa.list_(pa.struct([("spelling", pa.string()), ("fixed", pa.string())]))
            yield pa.RecordBatch.from_arrays([pa.array(raw, pa.string()), pa.array(settled, pa.string()), pa.array(tokens, pa.list_(pa.string())), pa.array(pairs, kind)], names=["text", "settled", "tokens", "fixes"])

    read_once = park(distinct.mapInArrow(read, "text string, settled string, tokens array<string>, fixes array<struct<spelling string, fixed string>>"), "settled-texts")
    vocabulary = read_once.select(F.explode("tokens").alias("fixed")).distinct()
    asked = read_once.select("text", F.explode("fixes").alias("f")).select("text", "f.spelling", "f.fixed")
    spelled = asked.groupBy("fixed").agg(F.countDistinct("spelling").alias("spellings"))
    known = spelled.join(vocabulary.withColumn("there", F.lit(True)), "fixed", "left").filter("there or spellings > 1").select("fixed")
    granted = asked.join(known, "fixed").groupBy("text").agg(F.collect_set("fixed").alias("known"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = [_apply(t, repairs(t), set(k)) if k else t for t, k in zip(batch.column("settled").to_pylist(), batch.column("known").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("text"), pa.array(forms, pa.string())], names=["text", "form"])

    return read_once.select("text", "settled").join(granted, "text", "left").mapInArrow(finish, "text string, form string")


def same_reading(records: DataFrame, *, id_col: str = "id", text_col: str = "title") -> DataFrame:
    """``id``, ``text``, ``form``, ``spellings``: every record with a text, its one form and how many spellings that has.

    Null ids and texts are left out; repeated rows of an id count once.
    """
    forms = park(one_form(records, text_col), "text-forms")
    spellings = forms.groupBy("form").agg(F.count(F.lit(1)).alias("spellings"))
    rows = records.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null").distinct()
    return rows.join(forms.join(spellings, "form"), "text").select("id", "text", "form", "spellings")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id_a`` < ``id_b``: articles whose titles are unequal but read the same.

    The result is stated as pairs, so spellings are expanded here and only here.
    """
    articles = table(spark, sf_dir, "articles").select("id", "title")
    forms = park(one_form(articles).filter("form <> '' and form <> '(no title)'"), "text-forms")
    several = forms.groupBy("form").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("form")
    # spellings meet once, however many records have them; a form has few
    spelled = park(forms.join(several, "form", "left_semi"), "spellings")
    pairs = spelled.select("form", F.col("text").alias("t")).join(spelled.select("form", F.col("text").alias("u")), "form").filter("t < u").select("t", "u")
    rows = articles.filter("id is not null and title is not null").join(spelled.select(F.col("text").alias("title")), "title", "left_semi").select(F.col("id").cast("string").alias("id"), "title").distinct()
    one, two = rows.select(F.col("id").alias("i"), F.col("title").alias("t")), rows.select(F.col("id").alias("j"), F.col("title").alias("u"))
    found = split_join(split_join(pairs, one, "t", left_by="u", right_by="i"), two, "u", left_by="i", right_by="j")
    return found.filter("i <> j").select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b")).distinct()
