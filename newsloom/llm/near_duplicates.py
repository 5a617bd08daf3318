"""Near-duplicate records: a byte-position inverted index with count filtering.

Every run of three words, with its count so far in the record, is written as
one byte value at one byte position: 24 bits of its hash are the position, 8
the value.  Two records that share s runs share at least s positional bytes, so
near-duplicates must reach a guaranteed number of matches, and none is lost.

Count filtering.  With T the matches that a partner of a record of n runs must
reach, the n - T + MATCHES rarest positional bytes of both records must have at
least MATCHES in common (pigeonhole under one global order).  Only those are
indexed.  Each posting also has the parities of the record's positional bytes
in a few machine words: two records differ in at least as many bytes as these
words differ in bits, which bounds their matches where they meet, before
anything moves.  The matches of the pairs that are left are tallied, pairs
below MATCHES are dropped and the rest is verified on all runs.

Scale.  The global order comes from counts over all records in a table of fixed
size; how well it separates rare from frequent only changes how many pairs are
verified.  Records with the same word sequence are one class from the first
step, so a group of copies costs one record and is never expanded to pairs
here.  A positional byte that very many records index is divided into blocks,
whose pairs are met by different tasks.

Error.  Classes are named by 64-bit hashes of their words, and runs are
compared by the 32 bits of their positional bytes: of n classes, two with
different words share a name with a chance of n*n / 2**65 (one in 370 for 10**8
classes), and two unlike runs of a pair of records of n runs agree with a chance of
n*n / 2**32 (one in a million for 64 runs).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from newsloom.operators.components import component_labels
from newsloom.plans.runtime import drop_path, park, park_at, table
from newsloom.plans.skew import HOT_ROWS, split_join

#: Neighbouring words in a run.
RUN = 3
#: Shared positional bytes that a pair must reach among its rarest ones.
MATCHES = 2
#: Machine words of parities that go with each posting.
PARITY_WORDS = 3
#: Cells of the count table: 4 bytes each, broadcast.
CELLS = 1 << 20
#: Positional bytes of all records for each task that pairs postings.
MARKS_PER_TASK = 500_000
_CHUNK = 1 << 12
#: Names of classes that may be broadcast (8 bytes each); beyond it the records are shuffled.
BROADCAST_NAMES = 500_000

_WORD = re.compile(r"[㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff]|[^\W_㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff]+")
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def words(title: str | None, body: str | None) -> list[str]:
    """Words of title, a blank and body in lower case: runs of letters and digits, Chinese characters each alone."""
    return _WORD.findall(f"{title or ''} {body or ''}".lower())


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def positional_bytes(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct positional bytes (uint32) of a record's word hashes; a repeated run gets another byte each time."""
    if len(hashes) < RUN:
        return np.empty(0, np.uint32)
    runs = np.sort(_mix(hashes[:-2] * _A + hashes[1:-1] * _B + hashes[2:] * _C))
    first = np.ones(len(runs), bool)
    first[1:] = runs[1:] != runs[:-1]
    if not first.all():
        starts = np.flatnonzero(first)
        times = np.arange(len(runs)) - np.repeat(starts, np.diff(np.append(starts, len(runs))))
        runs = np.where(times > 0, _mix(runs + times.astype(np.uint64) * _A), runs)
    return np.unique((runs >> np.uint64(32)).astype(np.uint32))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, int] = {}
    for batch in batches:
        if len(known) > 500_000:
            known.clear()
        keys, kinds, sizes, data = [], [], [], []
        for key, title, body in zip(*(batch.column(c).to_pylist() for c in ("key", "title", "body"))):
            found = words(title, body)
            for w in found:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            hashes = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
            keys.append(key)
            kinds.append(xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63))
            marks = positional_bytes(hashes)
            sizes.append(max(0, len(found) - RUN + 1))
            data.append(marks.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(kinds, pa.int64()), pa.array(sizes, pa.int32()), pa.array(data, pa.binary())], names=["key", "kind", "n", "marks"])


def _marks(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All positional bytes of a batch and the number in each row."""
    data = batch.column("marks").to_pylist()
    return np.frombuffer(b"".join(data), np.uint32), np.array([len(d) // 4 for d in data], np.int64)


def _cell(marks: np.ndarray) -> np.ndarray:
    return (marks * np.uint32(2654435761)) >> np.uint32(32 - CELLS.bit_length() + 1)


def parities(row: np.ndarray, marks: np.ndarray, rows: int) -> np.ndarray:
    """PARITY_WORDS int64 words for each row: how often, modulo two, its positional bytes fall into each bit."""
    bits = 64 * PARITY_WORDS
    odd = np.bincount(row * bits + (marks % np.uint32(bits)).astype(np.int64), minlength=rows * bits).reshape(rows, bits) & 1
    return np.packbits(odd.astype(np.uint8), axis=1, bitorder="little").view(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CELLS, np.int64)
    for batch in batches:
        total += np.bincount(_cell(_marks(batch)[0]), minlength=CELLS)
    part = np.minimum(total, np.iinfo(np.int32).max).astype(np.int32).reshape(-1, _CHUNK)
    yield pa.RecordBatch.from_arrays([pa.array(range(len(part)), pa.int32()), pa.array([p.tobytes() for p in part], pa.binary())], names=["chunk", "counts"])


def _add(t: pa.Table) -> pa.Table:
    total = np.zeros(_CHUNK, np.int64)
    for data in t.column("counts").to_pylist():
        total += np.frombuffer(data, np.int32)
    return pa.table({"chunk": t.column("chunk")[:1], "counts": pa.array([np.minimum(total, np.iinfo(np.int32).max).astype(np.int32).tobytes()], pa.binary())})


def mark_counts(described: DataFrame) -> np.ndarray:
    """How often positional bytes fall into each cell of a fixed table, over all records."""
    chunks = described.select("marks").mapInArrow(_count, "chunk int, counts binary").groupBy("chunk").applyInArrow(_add, "chunk int, counts binary").collect()
    counts = np.zeros((CELLS // _CHUNK, _CHUNK), np.int32)
    for row in chunks:
        counts[row["chunk"]] = np.frombuffer(row["counts"], np.int32)
    return counts.ravel()


def near_duplicate_classes(records: DataFrame, similarity: float = 0.7, *, id_col: str = "id", title_col: str = "title", body_col: str = "summary", hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): near-duplicate classes of records and who belongs to them.

    ``pairs``: ``a`` < ``b``, ``similarity``: share of the longer sequence's
    three-word runs, repeats counted, that the other has.  ``members``: ``key``,
    ``kind``, ``n``.  Records with the same words are one class and near-duplicates
    of each other if they have a run.  Null keys and null or empty bodies are left
    out; a null title counts as empty; records of fewer than three words have no
    near-duplicate; repeated rows count once; an empty table gives empty results.
    """
    if not 0.5 <= similarity <= 1:
        raise ValueError("similarity must lie between 0.5 and 1")
    spark = records.sparkSession
    texts = records.select(F.col(id_col).cast("string").alias("key"), F.col(title_col).alias("title"), F.col(body_col).alias("body")).filter("key is not null and body <> ''")
    described, path = park_at(texts.mapInArrow(_describe, "key string, kind long, n int, marks binary"), "positional-bytes")
    members = park(described.filter("n > 0").select("key", "kind", "n").distinct(), "near-duplicate-members")
    # one row for each sequence of words, before anything is indexed
    described = park(described.filter("n > 0").groupBy("kind").agg(F.first(F.struct("n", "marks")).alias("r")).select("kind", "r.n", "r.marks"), "word-classes")
    drop_path(spark, path)
    table_of = mark_counts(described)
    counts = spark.sparkContext.broadcast(table_of)
    # as many tasks as there are positional bytes, so that a task's share does not grow with the collection
    tasks = int(table_of.sum(dtype=np.int64)) // MARKS_PER_TASK + 1

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, n = batch.column("kind").to_numpy(), batch.column("n").to_numpy().astype(np.int64)
            marks, sizes = _marks(batch)
            row = np.repeat(np.arange(len(kinds)), sizes)
            words_of = parities(row, marks, len(kinds))
            order = np.lexsort((marks, counts.value[_cell(marks)], row))
            marks, row = marks[order], row[order]
            rank = np.arange(len(marks)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            need = np.ceil(similarity * n - 1e-9).astype(np.int64)
            # a position short of the sequence's length would hide matches, so distinct bytes that coincide widen the prefix
            keep = rank < (sizes - need + MATCHES + (n - sizes))[row]
            columns = [marks[keep].view(np.int32), kinds[row[keep]], n[row[keep]].astype(np.int32), *words_of[row[keep]].T]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=names_of)

    parity = [f"p{i}" for i in range(PARITY_WORDS)]
    names_of = ["mark", "kind", "n", *parity]
    postings = described.select("kind", "n", "marks").mapInArrow(index, "mark int, kind long, n int, " + ", ".join(f"{c} long" for c in parity)).repartition(tasks, "mark")
    one = postings.select("mark", F.col("kind").alias("a"), F.col("n").alias("na"), *(F.col(c).alias(f"a{c}") for c in parity))
    two = postings.select("mark", F.col("kind").alias("b"), F.col("n").alias("nb"), *(F.col(c).alias(f"b{c}") for c in parity))
    need = F.ceil(F.lit(similarity) * F.greatest("na", "nb") - F.lit(1e-9))
    apart = sum((F.bit_count(F.col(f"a{c}").bitwiseXOR(F.col(f"b{c}"))) for c in parity), F.lit(0))
    close = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= need) & (F.col("na") + F.col("nb") - apart >= 2 * need)
    tallied = split_join(one, two, "mark", left_by="a", right_by="b", rows=hot_rows, counted=postings.select("mark")).filter(close).groupBy("a", "b").agg(F.count(F.lit(1)).alias("tally"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    least = F.least(F.lit(MATCHES), need)
    candidates = park(tallied.filter(F.col("tally") >= least).select("a", "b"), "near-duplicate-candidates")

    names = candidates.select(F.explode(F.array("a", "b")).alias("kind")).distinct()
    if names.count() <= BROADCAST_NAMES:
        names = F.broadcast(names)
    known = described.join(names, "kind", "left_semi")
    left = known.select(F.col("kind").alias("a"), F.col("n").alias("na"), F.col("marks").alias("marks_a"))
    right = known.select(F.col("kind").alias("b"), F.col("n").alias("nb"), F.col("marks").alias("marks_b"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, marks = [], []
            for side in ("marks_a", "marks_b"):
                m, sizes = _marks(batch.select([side]).rename_columns(["marks"]))
                owner.append(np.repeat(np.arange(batch.num_rows, dtype=np.uint64), sizes))
                marks.append(m)
            both = np.sort((np.concatenate(owner) << np.uint64(32)) | np.concatenate(marks).astype(np.uint64))
            shared = np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(32)).astype(np.int64), minlength=batch.num_rows)
            longer = np.maximum(batch.column("na").to_numpy(), batch.column("nb").to_numpy())
            alike = shared / longer
            keep = pa.array(alike >= similarity - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(alike)], names=["a", "b", "similarity"]).filter(keep)

    joined = candidates.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "marks_a", "marks_b")
    pairs = park(joined.mapInArrow(verify, "a long, b long, similarity double"), "near-duplicate-pairs")
    return pairs, members


def near_duplicate_groups(records: DataFrame, similarity: float = 0.7, *, id_col: str = "id", title_col: str = "title", body_col: str = "summary") -> DataFrame:
    """``key``, ``group_key``, ``links``, ``copies``: one row per record with a body.

    ``group_key`` is the smallest key that the record reaches through
    near-duplicates, ``links`` the number of other word sequences it resembles,
    ``copies`` the number of other records with its very words.
    """
    pairs, members = near_duplicate_classes(records, similarity, id_col=id_col, title_col=title_col, body_col=body_col)
    kinds = members.groupBy("kind").agg(F.min("key").alias("rep"), (F.countDistinct("key") - 1).alias("copies"))
    both = pairs.select(F.col("a").alias("kind")).unionAll(pairs.select(F.col("b").alias("kind")))
    links = both.groupBy("kind").agg(F.count(F.lit(1)).alias("links"))
    reps = kinds.select("kind", "rep")
    edges = pairs.join(reps.toDF("a", "ra"), "a").join(reps.toDF("b", "rb"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    labels = component_labels(edges)
    grouped = kinds.join(links, "kind", "left").join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left")
    grouped = grouped.select("kind", "copies", F.coalesce("links", F.lit(0).cast("long")).alias("links"), F.coalesce("label", "rep").alias("group_key"))
    return members.select("key", "kind").distinct().join(grouped, "kind").select("key", "group_key", "links", "copies")


#: The same pairs by counting the shared runs of every pair that has one.
P4_SQL = """
WITH t AS (SELECT id, regexp_extract_all(regexp_replace(lower(concat(coalesce(title, ''), ' ', summary)), '(\\p{Han})', ' \\1 ', 'g'), '[\\p{L}\\p{N}]+') AS w
           FROM (SELECT DISTINCT id, title, summary FROM articles WHERE summary <> '') x),
     g AS (SELECT id, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS run, count(*) AS c FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM t) x GROUP BY 1, 2),
     n AS (SELECT id, sum(c) AS n FROM g GROUP BY id),
     s AS (SELECT a.id AS id_a, b.id AS id_b, sum(least(a.c, b.c)) AS shared FROM g a JOIN g b ON a.run = b.run AND a.id < b.id GROUP BY 1, 2)
SELECT id_a, id_b FROM s JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE 10 * shared >= 7 * greatest(x.n, y.n)
"""


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id_a`` < ``id_b``: pairs of near-duplicate articles.

    The result is stated as pairs, so classes are expanded here and only here.
    """
    pairs, members = near_duplicate_classes(table(spark, sf_dir, "articles").select("id", "title", "summary"))
    one = members.select(F.col("kind").alias("a"), F.col("key").alias("k1"))
    two = members.select(F.col("kind").alias("b"), F.col("key").alias("k2"))
    other = pairs.select("a", "b").join(one, "a").join(two, "b").select("k1", "k2")
    copies = one.join(two.withColumnRenamed("b", "a"), "a").filter("k1 < k2").select("k1", "k2")
    return other.unionAll(copies).select(F.least("k1", "k2").alias("id_a"), F.greatest("k1", "k2").alias("id_b")).distinct()
