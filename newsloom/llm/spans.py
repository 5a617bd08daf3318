"""Long exact spans that several records share.

Reference blocks of ``BLOCK`` characters lie end to end in every text, and the
key of an indexed place is a run of whole blocks as long as any span of
``min_chars`` must contain.  Every rolling window of that length probes the
index.  A window is represented by its least rolling ``GRAM``-character hash,
which equal windows share and neighbouring windows mostly share too, so a text
sends about one probe for forty characters and still no window is left out.
Texts that meet, and agree for fifty characters more on one side, are compared,
each hit being extended to the maximal exact repeat.

Scale.  A text stands for all its copies from the start (its 64-bit hash is its
name), so a group of copies costs one text.  Probes are three numbers; texts
are read again only for those that met another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from newsloom.plans.runtime import park, table
from newsloom.plans.skew import HOT_ROWS, split_join

#: Characters of a reference block.
BLOCK = 25
#: Characters of the rolling hash that represents a window.
GRAM = 100
#: Characters that are hashed at once.
CHUNK = 1 << 20
#: Names of texts that may be broadcast (8 bytes each); beyond it the texts are shuffled.
BROADCAST_NAMES = 500_000

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of the rolling hash's base and of its inverse, grown on demand."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            factors = np.full(n, _BASE, np.uint64)
            factors[0] = 1
            cls.up = np.cumprod(factors, dtype=np.uint64)
            factors[1:] = _INVERSE
            cls.down = np.cumprod(factors, dtype=np.uint64)
        return cls.up[:n], cls.down[:n]


def code_points(text: str) -> np.ndarray:
    """A text's code points."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _prefix_sums(points: np.ndarray) -> np.ndarray:
    up, _ = _Powers.of(len(points) + 1)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(_mix(points.astype(np.uint64) + np.uint64(1)) * up[: len(points)], out=sums[1:])
    return sums


def _hash_at(sums: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the windows of ``n`` code points that start at ``starts``."""
    return _mix((sums[starts + n] - sums[starts]) * _Powers.of(len(sums))[1][starts])


def rolling(points: np.ndarray, n: int) -> np.ndarray:
    """Hash of every window of ``n`` code points."""
    if len(points) < n:
        return np.empty(0, np.uint64)
    sums = _prefix_sums(points)
    return _mix((sums[n:] - sums[:-n]) * _Powers.of(len(sums))[1][: len(points) - n + 1])


def _sliding(h: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """Least or greatest value of every ``width`` neighbours."""
    have = 1
    while have * 2 <= width:
        h = pick(h[:-have], h[have:])
        have *= 2
    rest = width - have
    return pick(h[:-rest], h[rest:]) if rest else h


def _pieces(names: list[int], texts: list[str], run: int, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(code points, rows of (name, first, start, end, last)) of about CHUNK characters; long texts in overlapping pieces.

    From ``first`` to ``start`` and from ``end`` to ``last`` are up to ``reach``
    characters of the text on both sides of a piece.
    """
    points, spans, at = [], [], 0
    for name, text in zip(names, texts):
        whole = code_points(text)
        step = (CHUNK - run) // BLOCK * BLOCK
        for start in range(0, max(1, len(whole) - run + 1), step):
            lead = min(reach, start)
            size = len(whole[start : start + step + run - 1])
            piece = whole[start - lead : start + size + reach]
            if at + len(piece) > CHUNK and points:
                yield np.concatenate(points), np.array(spans, np.int64).reshape(-1, 5)
                points, spans, at = [], [], 0
            points.append(piece)
            spans.append((name, at, at + lead, at + lead + size, at + len(piece)))
            at += len(piece)
    if points:
        yield np.concatenate(points), np.array(spans, np.int64).reshape(-1, 5)


def _anchors(names: list[int], texts: list[str], run: int, reach: int) -> Iterator[list[np.ndarray]]:
    """[anchor, name, before, after, is of a reference place] for every place that represents a window.

    ``before`` and ``after`` are hashes of the anchor with ``reach`` characters
    more on that side, or chance where the text ends before.
    """
    width = run - GRAM + 1
    for points, spans in _pieces(names, texts, run, reach):
        if len(points) < run:
            continue
        sums = _prefix_sums(points)
        h = _mix((sums[GRAM:] - sums[:-GRAM]) * _Powers.of(len(sums))[1][: len(points) - GRAM + 1])
        least = _sliding(h, width, np.minimum)
        at = np.arange(len(least))
        firsts, starts, ends, lasts = spans[:, 1:].T
        owner = np.searchsorted(firsts, at, side="right") - 1
        inside = (at >= starts[owner]) & (at + run <= ends[owner])
        # a place represents a window if it is least in one of the windows over it
        most = _sliding(np.pad(np.where(inside, least, np.uint64(0)), width - 1), width, np.maximum)
        chosen = np.flatnonzero(most == h)
        block = np.zeros(len(h), bool)
        places = np.flatnonzero(inside & ((at - starts[owner]) % BLOCK == 0))
        left, values = places, least[places]
        for offset in range(width):
            hit = h[left + offset] == values
            block[left[hit] + offset] = True
            left, values = left[~hit], values[~hit]
        owner = np.searchsorted(firsts, chosen, side="right") - 1
        sides = []
        for first, fits in ((chosen - reach, chosen - reach >= firsts[owner]), (chosen, chosen + GRAM + reach <= lasts[owner])):
            chance = _mix(_mix(spans[owner, 0].view(np.uint64)) + chosen.astype(np.uint64) + np.uint64(len(sides)))
            sides.append(np.where(fits, _hash_at(sums, np.where(fits, first, 0), min(GRAM + reach, len(points))), chance))
        yield [h[chosen].view(np.int64), spans[owner, 0], sides[0].view(np.int64), sides[1].view(np.int64), block[chosen]]


def _run_length(min_chars: int) -> int:
    """Longest run of whole blocks that any span of ``min_chars`` must contain."""
    run = (min_chars - BLOCK + 1) // BLOCK * BLOCK
    if run < GRAM:
        raise ValueError(f"spans must have at least {GRAM + 2 * BLOCK} characters")
    return run


def maximal_repeats(a: str, b: str, min_chars: int) -> list[tuple[int, int, int]]:
    """(start in a, start in b, length) of all maximal exact repeats of at least ``min_chars`` code points."""
    run = _run_length(min_chars)
    x, y = code_points(a), code_points(b)
    if min(len(x), len(y)) < min_chars:
        return []
    index = rolling(x, run)[::BLOCK]
    probe = rolling(y, run)
    order = np.argsort(index, kind="stable")
    lo = np.searchsorted(index[order], probe, "left")
    hi = np.searchsorted(index[order], probe, "right")
    found, reach = [], {}
    for q in np.flatnonzero(hi > lo):
        for place in order[lo[q] : hi[q]]:
            p, q = int(place) * BLOCK, int(q)
            if reach.get(p - q, -1) >= p + run:
                continue
            start, end = _extend(x, y, p, q)
            reach[p - q] = end
            if end - start >= max(min_chars, 1):
                found.append((start, start - p + q, end - start))
    return sorted(set(found))


def _extend(x: np.ndarray, y: np.ndarray, p: int, q: int) -> tuple[int, int]:
    """Start and end in x of the exact repeat through x[p], y[q]; empty where the two differ there."""
    end, step = p, 256
    while True:
        n = min(step, len(x) - end, len(y) - (end - p + q))
        if n <= 0:
            break
        same = x[end : end + n] == y[end - p + q : end - p + q + n]
        if not same.all():
            end += int(same.argmin())
            break
        end, step = end + n, step * 2
    start, step = p, 256
    while True:
        n = min(step, start, start - p + q)
        if n <= 0:
            break
        same = (x[start - n : start] == y[start - p + q - n : start - p + q])[::-1]
        if not same.all():
            start -= int(same.argmin())
            break
        start, step = start - n, step * 2
    return start, end


def _named(documents: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    return documents.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).filter(F.col("key").isNotNull() & (F.char_length("text") >= min_chars)).withColumn("name", F.xxhash64("text"))


def candidate_pairs(texts: DataFrame, min_chars: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``a`` < ``b``: names of texts of which a window of one meets a reference place of the other."""
    run = _run_length(min_chars)
    # beside its anchor, a span has this many characters more on one side at least
    reach = -(-(min_chars - GRAM) // 2)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in _anchors(batch.column("name").to_pylist(), batch.column("text").to_pylist(), run, reach):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "name", "before", "after", "block"])

    probes = texts.select("name", "text").mapInArrow(probe, "anchor long, name long, before long, after long, block boolean")
    same = Window.partitionBy("anchor")
    met = probes.withColumn("lo", F.min("name").over(same)).withColumn("hi", F.max("name").over(same)).filter("lo < hi")
    met = park(met.groupBy("anchor", "name", "before", "after").agg(F.max("block").alias("block")), "span-anchors")
    index = met.filter("block").select("anchor", F.col("name").alias("n1"), F.col("before").alias("b1"), F.col("after").alias("a1"))
    hits = split_join(index, met, "anchor", left_by="n1", right_by="name", rows=hot_rows).filter("n1 <> name and (b1 = before or a1 = after)")
    return park(hits.select(F.least("n1", "name").alias("a"), F.greatest("n1", "name").alias("b")).distinct(), "span-candidates")


def shared_spans(documents: DataFrame, min_chars: int = 200, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(spans, members): the maximal exact repeats of at least ``min_chars`` code points between different texts.

    ``spans`` has ``a`` < ``b`` (names of texts), ``start_a``, ``start_b``,
    ``chars``; ``members`` gives the ``key`` values of each ``name``, so that
    copies of one text are not expanded into pairs.  Null keys, null, empty and
    shorter texts have no spans; repeats within one text are not reported;
    repeated rows count once; an empty table gives empty results.
    """
    named = _named(documents, id_col, text_col, min_chars)
    pairs = candidate_pairs(named, min_chars)
    names = pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct()
    if names.count() <= BROADCAST_NAMES:
        names = F.broadcast(names)
    texts = named.select("name", "text").join(names, "name", "left_semi").groupBy("name").agg(F.first("text").alias("text"))
    left = texts.select(F.col("name").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("name").alias("b"), F.col("text").alias("text_b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (a, b, *hit)
                for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")))
                for hit in maximal_repeats(x, y, min_chars)
            ]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "start_a", "start_b", "chars"])

    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    spans = park(both.mapInArrow(compare, "a long, b long, start_a long, start_b long, chars long"), "spans")
    return spans, named.select("key", "name", F.char_length("text").alias("chars")).distinct()


def shared_share(documents: DataFrame, min_chars: int = 200, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key``, ``chars``, ``shared_chars``, ``share``, ``copies``: how much of each record is found in other records.

    One row per key; a character counts once however often it is shared.  A
    record with a copy is shared as a whole.  Records without a span of
    ``min_chars`` have zero; null texts have null ``chars`` and zero shares.
    """
    spans, members = shared_spans(documents, min_chars, id_col=id_col, text_col=text_col)
    sides = spans.select(F.col("a").alias("name"), F.col("start_a").alias("s"), (F.col("start_a") + F.col("chars")).alias("e"))
    sides = sides.union(spans.select("b", "start_b", F.col("start_b") + F.col("chars")))
    # intervals are cut at what lies before them, so their lengths add up to the union
    order = Window.partitionBy("name").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    cut = sides.distinct().withColumn("reach", F.max("e").over(order))
    covered = cut.groupBy("name").agg(F.sum(F.greatest(F.lit(0), F.col("e") - F.greatest("s", F.coalesce("reach", "s")))).alias("covered"))
    copies = members.groupBy("name").agg((F.count(F.lit(1)) - 1).alias("copies"))
    shared = members.join(copies, "name").join(covered, "name", "left").withColumn("shared_chars", F.when(F.col("copies") > 0, F.col("chars")).otherwise(F.coalesce("covered", F.lit(0))))
    shared = shared.groupBy("key").agg(F.max("shared_chars").cast("long").alias("shared_chars"), F.max("copies").alias("copies"))
    rows = documents.groupBy(F.col(id_col).alias("key")).agg(F.max(F.char_length(text_col)).cast("long").alias("chars")).filter(F.col("key").isNotNull())
    out = rows.join(shared, "key", "left").withColumn("shared_chars", F.coalesce("shared_chars", F.lit(0).cast("long"))).withColumn("copies", F.coalesce("copies", F.lit(0).cast("long")))
    return out.select("key", "chars", "shared_chars", F.when(F.col("chars") > 0, F.round(F.col("shared_chars") / F.col("chars"), 6)).otherwise(0.0).alias("share"), "copies")


#: The same pairs from every window of every text.
P10_SQL = """
WITH w AS (SELECT DISTINCT doc_id, hash(substr(text, i, 200)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200) x)
SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM w a JOIN w b ON a.h = b.h AND a.doc_id < b.doc_id
"""


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_a`` < ``doc_b``: pairs of documents with a common span of 200 characters.

    The result is stated as pairs, so copies are expanded here and only here.
    """
    spans, members = shared_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    one = members.select(F.col("name").alias("a"), F.col("key").alias("k1"))
    two = members.select(F.col("name").alias("b"), F.col("key").alias("k2"))
    other = spans.select("a", "b").distinct().join(one, "a").join(two, "b").select("k1", "k2")
    copies = one.join(two.withColumnRenamed("b", "a"), "a").filter("k1 < k2").select("k1", "k2")
    return other.union(copies).select(F.least("k1", "k2").alias("doc_a"), F.greatest("k1", "k2").alias("doc_b")).distinct()
