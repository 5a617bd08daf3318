"""Languages of documents and of their segments, as a mixture that EM takes apart.

A character n-gram model for each language is trained on a bounded sample of
labelled rows (``SAMPLE_ROWS`` a language); segments that the first model puts
into another language than their label says are left out of the second.  A
document is a mixture: its segments are the title and the sentences of its
summary, and expectation-maximisation estimates the proportions of the
languages from the segments' n-gram likelihoods.  The set of languages is the
one with the best penalised likelihood, so a few odd words don't make a second
language.  Each segment then has its most likely language of that set, and the
posterior as confidence.

Scale.  Apart from the bounded sample, documents never meet: the model (a few
MB, bounded by the sample) is broadcast and each document is read once.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from newsloom.llm.lookalikes import repairs
from newsloom.plans.runtime import table

#: Labelled rows of a language that the model is trained on, at most about so many.
SAMPLE_ROWS = 250
#: Log-likelihood that another language must gain beyond what its segments' share costs.
PENALTY = 14.0
#: Words (or pairs of Chinese characters) that a segment needs to count as text.
LEAST_WORDS = 3
#: Longest grams.
GRAM = 4

# Languages, their codes and names (in English and in themselves).
LANGUAGE_NAMES = {
    "en": "en eng english",
    "fr": "fr fra fre french français francais",
    "de": "de deu ger german deutsch",
    "es": "es spa spanish español espanol castellano castilian",
    "pt": "pt por portuguese português portugues",
    "tr": "tr tur turkish türkçe turkce",
    "ru": "ru rus russian русский",
    "uk": "uk ukr ukrainian українська",
    "ar": "ar ara arabic العربية عربي",
    "fa": "fa fas per persian farsi فارسی",
    "he": "he heb iw hebrew עברית",
    "zh": "zh zho chi chinese mandarin cmn 中文 汉语 简体中文",
}
_BY_NAME = {unicodedata.normalize("NFC", n): code for code, names in LANGUAGE_NAMES.items() for n in names.split()}

_HIDDEN = re.compile("[­͏؜ᅟᅠ᠎​‎‏‪-‮⁠-⁤⁦-⁩﻿︀-️]")
_STRANGE = re.compile("[^\x00-\x7f]")
_LATIN = re.compile("[A-Za-z]")
_GREEK_CYRILLIC = re.compile("[Ͱ-ӿ]")
_TAIL = re.compile(r"\s*(?:\([^()]{1,40}\)|\[[^\[\]]{0,40}\]|[–—|/]\s*[^–—|/.!?。]{1,40}|\+{2,})\s*$")
_HEAD = re.compile(r"^\s*(?:\([^()]{1,40}\)|\[[^\[\]]{1,40}\]|\+{2,})\s*")
_SENTENCE = re.compile(r"[^.!?。！？؟]*(?:[.!?。！？؟]+[\"'”’»)\]]*|$)")
_HAN = "㐀-䶿一-鿿豈-﫿"
_WORD = re.compile(rf"[{_HAN}]+|[^\W\d_{_HAN}]+(?:[’'‌ـ̀-ًͯ-ْ][^\W\d_{_HAN}]+)*")
_IS_HAN = re.compile(f"[{_HAN}]")
_PLACEHOLDER = re.compile(r"^[(\[]?\s*(?:no title|untitled|sin título|ohne titel|sans titre)\s*[)\]]?$", re.I)


def read_label(label: str | None) -> set[str]:
    """Languages that a label names, by code, by name, with or without a region; empty if it names none."""
    found = set()
    for part in re.split(r"[,;/+|&]|\band\b", (label or "").strip().lower()):
        part = unicodedata.normalize("NFC", part.strip())
        if part in _BY_NAME:
            found.add(_BY_NAME[part])
        elif (head := re.split(r"[-_ (]", part)[0]) in _BY_NAME and head != part:
            found.add(_BY_NAME[head])
    return found


def plain(text: str) -> str:
    """Compatibility forms composed, characters that show nothing left out, look-alikes of other scripts repaired."""
    if not _STRANGE.search(text):
        return text
    text = unicodedata.normalize("NFKC", _HIDDEN.sub("", text))
    if _GREEK_CYRILLIC.search(text) and _LATIN.search(text):
        done = len(text) + 1
        for start, end, fixed in reversed(repairs(text)):
            if end <= done:
                text, done = text[:start] + fixed + text[end:], start
    return text


def words(text: str) -> list[str]:
    """Lower-case words; Chinese text as pairs of characters."""
    found = []
    for w in _WORD.findall(text.lower()):
        if _IS_HAN.match(w):
            found += [w[i : i + 2] for i in range(len(w) - 1)] or [w]
        else:
            found.append(w)
    return found


def segments(title: str | None, summary: str | None) -> list[tuple[str, str, bool, list[str]]]:
    """(field, text, is whole, words) of the title and of each sentence of the summary that is text in some language.

    Tags at the ends, placeholders and single words are no text; a sentence
    that was cut off is not whole.
    """
    found = []
    head = plain(title or "").strip()
    if head and not _PLACEHOLDER.match(head) and len(of := words(head)) >= LEAST_WORDS:
        found.append(("title", head, True, of))
    body = (summary or "").strip()
    cut = body.endswith("…")
    body = _HEAD.sub("", plain(body[:-1] if cut else body))
    while (short := _TAIL.sub("", body)) != body:
        body = short
    sentences = [s.strip() for s in _SENTENCE.findall(body) if s.strip()]
    for i, s in enumerate(sentences):
        if len(of := words(s)) >= LEAST_WORDS:
            found.append(("summary", s, not (cut and i == len(sentences) - 1), of))
    return found


def grams(word: str) -> list[str]:
    """Characters and pairs of a Chinese word; of others all grams of two to GRAM characters with the word's ends, and the word."""
    if _IS_HAN.match(word):
        return [*word, word]
    ended = f"<{word}>"
    return [ended[i : i + n] for n in range(2, GRAM + 1) for i in range(len(ended) - n + 1)] + ["=" + word]


class NgramModel:
    """Log-likelihoods of words by language."""

    def __init__(self, languages: list[str], index: dict[str, int], table_: np.ndarray, unseen: np.ndarray):
        self.languages, self.index, self.table, self.unseen = languages, index, table_, unseen
        self._clear()

    def _clear(self) -> None:
        self._row: dict[str, int] = {}
        self._scores = np.zeros((1024, len(self.languages)), np.float32)

    @classmethod
    def train(cls, texts: dict[str, list[list[str]]]) -> NgramModel:
        """From texts, given as words, by language."""
        languages = sorted(texts)
        counts = [Counter(g for t in texts[code] for w in t for g in grams(w)) for code in languages]
        index = {g: i for i, g in enumerate(sorted(set().union(*counts)))} if counts else {}
        table_ = np.full((len(index), len(languages)), 0.2)
        for j, c in enumerate(counts):
            for g, n in c.items():
                table_[index[g], j] += n
        totals = np.array([sum(c.values()) for c in counts]) + 0.2 * max(1, len(index))
        return cls(languages, index, np.log(table_ / totals).astype(np.float32), np.log(0.2 / totals).astype(np.float32))

    def _word_row(self, word: str) -> int:
        """Row of a word's log-likelihoods by language, over the mean number of grams that start at a character."""
        row = self._row.get(word)
        if row is None:
            row = self._row[word] = len(self._row)
            if row == len(self._scores):
                self._scores = np.vstack([self._scores, np.zeros_like(self._scores)])
            known = [self.index.get(g, -1) for g in grams(word)]
            seen = [r for r in known if r >= 0]
            self._scores[row] = ((self.table[seen].sum(0) if seen else 0) + (len(known) - len(seen)) * self.unseen) / (GRAM - 1)
        return row

    def score(self, texts: list[list[str]]) -> np.ndarray:
        """Log-likelihoods of texts, given as words (none empty), by language."""
        if len(self._row) > 200_000:
            self._clear()
        rows = [self._word_row(w) for t in texts for w in t]
        starts = np.cumsum([0] + [len(t) for t in texts[:-1]])
        return np.add.reduceat(self._scores[rows].astype(np.float64), starts, axis=0) if texts else np.zeros((0, len(self.languages)))

    def __getstate__(self):
        return {"languages": self.languages, "index": self.index, "table": self.table, "unseen": self.unseen}

    def __setstate__(self, state):
        self.__init__(state["languages"], state["index"], state["table"], state["unseen"])


def em_proportions(scores: np.ndarray, weights: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, float]:
    """(proportions, posteriors, log-likelihood) of a mixture, from scores by segment and language."""
    pi = np.full(scores.shape[1], 1 / scores.shape[1])
    post, like = None, -math.inf
    for _ in range(rounds):
        joint = scores + np.log(np.maximum(pi, 1e-12))
        top = joint.max(1, keepdims=True)
        p = np.exp(joint - top)
        sums = p.sum(1, keepdims=True)
        post = p / sums
        now = float((top + np.log(sums)).sum())
        pi = (weights[:, None] * post).sum(0) / weights.sum()
        if now - like < 1e-3:
            like = now
            break
        like = now
    return pi, post, like


def infer(scores: np.ndarray, weights: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(languages, proportions, posteriors by segment) of the set with the best penalised likelihood."""
    best_each = np.unique(scores.argmax(1))
    whole = int(scores.sum(0).argmax())
    candidates = sorted({whole, *best_each.tolist()})
    choice = None
    for size in range(1, len(candidates) + 1):
        for chosen in combinations(candidates, size):
            pi, post, like = em_proportions(scores[:, chosen], weights)
            value = like - PENALTY * (size - 1)
            if choice is None or value > choice[0]:
                choice = (value, list(chosen), pi, post)
        if choice is not None and len(choice[1]) < size:
            break
    return choice[1], choice[2], choice[3]


def _sample(rows: DataFrame) -> NgramModel:
    labels = sorted({n for names in LANGUAGE_NAMES.values() for n in names.split()})
    to_code = F.create_map(*(F.lit(x) for n in labels for x in (n, _BY_NAME[n])))
    coded = rows.withColumn("code", to_code[F.regexp_extract(F.lower(F.trim("label")), r"^([^-_ ]+)", 1)]).filter("code is not null and body is not null")
    counts = {r[0]: r[1] for r in coded.groupBy("code").count().collect()}  # one row a language
    share = F.create_map(*(F.lit(x) for c, n in counts.items() for x in (c, min(1.0, SAMPLE_ROWS / n)))) if counts else F.create_map(F.lit(""), F.lit(0.0))
    picked = coded.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / F.lit(1_000_003.0) < share[F.col("code")])
    texts: dict[str, list[list[list[str]]]] = {}
    for r in picked.select("code", "title", "body").orderBy("id").collect():  # about SAMPLE_ROWS rows a language
        texts.setdefault(r["code"], []).append([w for _, _, _, w in segments(r["title"], r["body"])])
    first = NgramModel.train({c: [s for d in ds for s in d] for c, ds in texts.items()})
    kept = {}
    for j, code in enumerate(first.languages):
        every = [s for d in texts[code] for s in d]
        own = [s for s, best in zip(every, first.score(every).argmax(1)) if best == j]
        kept[code] = own or every
    return NgramModel.train(kept)


def _rows(records: DataFrame, id_col: str, title_col: str, summary_col: str, label_col: str) -> DataFrame:
    return records.select(F.col(id_col).cast("string").alias("id"), F.col(title_col).alias("title"), F.col(summary_col).alias("body"), F.col(label_col).alias("label")).filter("id is not null")


def segment_languages(records: DataFrame, *, id_col: str = "id", title_col: str = "title", summary_col: str = "summary", label_col: str = "source_lang") -> DataFrame:
    """``id``, ``label``, ``seg_no``, ``field``, ``text``, ``whole``, ``lang``, ``confidence``, ``share``.

    One row for the title and each sentence that is text in some language;
    ``confidence`` is the segment's posterior, ``share`` its language's
    proportion of the document.  Null titles and summaries count as empty; a
    record without any text gives no row; rows with null ids are left out,
    repeated rows stay repeated; an empty table gives an empty result.
    Languages of which no row is labelled cannot be found.
    """
    rows = _rows(records, id_col, title_col, summary_col, label_col)
    model = records.sparkSession.sparkContext.broadcast(_sample(rows))
    names = ["id", "label", "seg_no", "field", "text", "whole", "lang", "confidence", "share"]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.float64(), pa.float64()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                (key, label, i, field, text, whole, lang, round(sure, 6), round(share, 6))
                for key, label, parts, found in _analysed(batch, model.value)
                for i, ((field, text, whole, _), (lang, sure, share)) in enumerate(zip(parts, found))
            ]
            columns = list(zip(*out)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return rows.mapInArrow(read, "id string, label string, seg_no int, field string, text string, whole boolean, lang string, confidence double, share double")


def _analysed(batch: pa.RecordBatch, model: NgramModel) -> Iterator[tuple[str, str | None, list, list[tuple[str, float, float]]]]:
    """(id, label, segments, (language, confidence, share) of each) of the records of a batch that have text."""
    if not model.languages:
        return
    records = []
    for key, title, body, label in zip(*(batch.column(c).to_pylist() for c in ("id", "title", "body", "label"))):
        parts = segments(title, body)
        if parts:
            records.append((key, label, parts))
    scores = model.score([p[3] for _, _, parts in records for p in parts])
    best = scores.argmax(1)
    spread = np.exp(scores - scores.max(1, keepdims=True))
    sure = 1 / spread.sum(1)
    at = 0
    for key, label, parts in records:
        rows = slice(at, at + len(parts))
        at += len(parts)
        if (best[rows] == best[rows][0]).all():  # one language is the best for all: no mixture can do better
            lang = model.languages[best[rows][0]]
            yield key, label, parts, [(lang, float(c), 1.0) for c in sure[rows]]
            continue
        chosen, pi, post = infer(scores[rows], np.array([len(p[1]) for p in parts], float))
        most = post.argmax(1)
        yield key, label, parts, [(model.languages[chosen[j]], float(post[i, j]), float(pi[j])) for i, j in enumerate(most)]


def document_languages(records: DataFrame, *, id_col: str = "id", title_col: str = "title", summary_col: str = "summary", label_col: str = "source_lang") -> DataFrame:
    """``id``, ``lang``, ``share``, ``confidence``, ``label``, ``label_is_right``: one row for each language of each record.

    A language counts if the title or a whole sentence is written in it.  The
    label is right if it names exactly the one language of the record.  Other
    cases as in ``segment_languages``, but that repeated rows count once.
    """
    rows = _rows(records, id_col, title_col, summary_col, label_col)
    model = records.sparkSession.sparkContext.broadcast(_sample(rows))
    names = ["id", "lang", "share", "confidence", "label", "label_is_right"]
    kinds = [pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string(), pa.bool_()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, label, parts, found in _analysed(batch, model.value):
                langs: dict[str, tuple[float, float]] = {}
                for part, (lang, sure, share) in zip(parts, found):
                    if part[2]:
                        langs[lang] = (share, max(sure, langs.get(lang, (0, 0))[1]))
                right = read_label(label) == set(langs)
                out += [(key, lang, round(share, 6), round(sure, 6), label, right) for lang, (share, sure) in langs.items()]
            columns = list(zip(*out)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return rows.mapInArrow(read, "id string, lang string, share double, confidence double, label string, label_is_right boolean").distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id``, ``lang``: the languages of each article whose label does not name exactly its one language."""
    found = document_languages(table(spark, sf_dir, "articles").select("id", "title", "summary", "source_lang"))
    return found.filter(~F.col("label_is_right")).select("id", "lang").distinct()
