"""Filling containers of fixed capacity with texts, by swap-based local search.

Texts are sized in tokens; only a text larger than a container is cut, at the
ends of words, into pieces that fit.  Pieces are dealt to shards of bounded
size by hash.  In a shard, a best-fit-decreasing start is improved by exchanges
between underfull bins: a piece moves, or is exchanged for a smaller one, or
two pieces for one smaller than both, always so that the fuller bin gets
fuller, which increases the sum of squared fills, until bins become empty or
the shard has as few bins as its tokens allow.  The pieces of bins that are
still not full are packed once more, together with those of other shards.

Scale.  A shard has at most about ``SHARD`` pieces whatever the collection's
size or its sources; what a shard leaves over is a few bins, and the second
round divides it by the number of shards it takes together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from newsloom.llm.tokens import TOKENIZER, tokenizer
from newsloom.plans.runtime import park, table

#: Pieces of a shard, about.
SHARD = 40_000
#: Fill from which a bin of the first round is left as it is.
FULL = 0.99
#: Bins in a row that can't be improved before a shard's search ends.
PATIENCE = 12


class _Bins:
    """Bins of one shard: piece sizes, where each piece is, and room by bin."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.where = np.zeros(len(sizes), np.int64)
        self.room: list[int] = []
        self.held: list[set[int]] = []
        self._by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self._mask = 0
        for i in np.argsort(-sizes, kind="stable"):
            self._place(int(i), self._fitting(int(sizes[i])))

    def _fitting(self, size: int, never: int = -1) -> int | None:
        """The bin with the least room for a size."""
        rest = self._mask >> size
        while rest:
            low = (rest & -rest).bit_length() - 1 + size
            stack = self._by_room[low]
            while stack and (self.room[stack[-1]] != low or not self.held[stack[-1]]):
                stack.pop()
            found = next((b for b in reversed(stack) if b != never and self.room[b] == low and self.held[b]), None)
            if found is not None:
                return found
            if not stack:
                self._mask &= ~(1 << low)
            rest &= rest - 1
        return None

    def _note(self, b: int) -> None:
        self._by_room[self.room[b]].append(b)
        self._mask |= 1 << self.room[b]

    def _place(self, i: int, b: int | None) -> None:
        if b is None:
            b = len(self.room)
            self.room.append(self.capacity)
            self.held.append(set())
        self.held[b].add(i)
        self.where[i] = b
        self.room[b] -= int(self.sizes[i])
        self._note(b)

    def _take(self, i: int) -> int:
        b = int(self.where[i])
        self.held[b].discard(i)
        self.room[b] += int(self.sizes[i])
        if self.held[b]:
            self._note(b)
        return b

    def used(self) -> list[int]:
        return [b for b, held in enumerate(self.held) if held]

    def improve(self, patience: int) -> None:
        """Exchanges between underfull bins until none helps or no bin can be saved."""
        least = -(-int(self.sizes.sum()) // self.capacity)
        stuck: set[int] = set()
        n_used = len(self.used())
        while n_used > least and len(stuck) < patience:
            open_bins = [b for b in self.used() if b not in stuck]
            if not open_bins:
                break
            b = max(open_bins, key=lambda x: (self.room[x], -x))
            changed = self._drain(b)
            if not self.held[b]:
                n_used -= 1
                stuck.clear()
            elif changed:
                stuck.clear()
            else:
                stuck.add(b)

    def _drain(self, b: int) -> bool:
        """Move pieces out of a bin, or exchange them for smaller ones; whether anything changed."""
        changed = False
        for i in sorted(self.held[b], key=lambda x: -self.sizes[x]):
            target = self._fitting(int(self.sizes[i]), never=b)
            # the sum of squares grows where the target ends up fuller than the source was
            if target is not None and self.capacity - self.room[target] + self.sizes[i] > self.capacity - self.room[b]:
                self._take(i)
                self._place(i, target)
                changed = True
        if not self.held[b]:
            return True
        room = np.array(self.room, np.int64)[self.where]
        fill = self.capacity - room
        other = (self.where != b) & (room > 0)
        mine = sorted(self.held[b])
        singles = [(i,) for i in mine]
        pairs = [(i, j) for k, i in enumerate(mine) for j in mine[k + 1 :] if self.sizes[i] + self.sizes[j] <= self.capacity]
        for out in singles + pairs:
            total = int(self.sizes[list(out)].sum())
            gain = total - self.sizes
            fits = other & (gain > 0) & (gain <= room) & (fill + gain > self.capacity - self.room[b])
            if not fits.any():
                continue
            back = int(np.where(fits, gain, -1).argmax())
            target = int(self.where[back])
            self._take(back)
            for i in out:
                self._take(i)
                self._place(i, target)
            self._place(back, b)
            return True
        return changed


def pack(sizes: np.ndarray, capacity: int, patience: int = PATIENCE) -> np.ndarray:
    """Bin numbers from 0 of pieces, none larger than the capacity."""
    if not len(sizes):
        return np.empty(0, np.int64)
    bins = _Bins(sizes, capacity)
    bins.improve(patience)
    number = {b: n for n, b in enumerate(bins.used())}
    return np.array([number[int(b)] for b in bins.where], np.int64)


def sized_pieces(documents: DataFrame, capacities: list[tuple[int, int]], *, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str = TOKENIZER) -> DataFrame:
    """``capacity_id``, ``capacity``, ``key``, ``piece``, ``start``, ``end``, ``tokens``: what has to be packed for each capacity."""
    names = ["capacity_id", "capacity", "key", "piece", "start", "end", "tokens"]
    key_type = documents.schema[id_col].dataType.simpleString()
    least = min(c for _, c in capacities)

    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = tokenizer(tokenizer_path)
        for batch in batches:
            out: dict[str, list] = {n: [] for n in names}
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                units = None
                if reader.additive and len(text) > 4 * least:  # it will be cut, so its parts are needed anyway
                    units = reader.units(text, least)
                n = int(units[1].sum()) if units is not None else reader.count(text)
                if n == 0:
                    continue
                for number, capacity in capacities:
                    if n <= capacity:
                        parts = [(0, len(text), n)]
                    else:
                        units = reader.units(text, least) if units is None else units
                        parts = reader.pieces(text, units, capacity)
                    for k, (start, end, tokens) in enumerate(parts):
                        for name, v in zip(names, (number, capacity, key, k, start, end, tokens)):
                            out[name].append(v)
            kinds = [pa.int32(), pa.int32(), batch.schema.field("key").type, pa.int32(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(out[n], k) for n, k in zip(names, kinds)], names=names)

    rows = documents.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).filter("key is not null and text <> ''")
    return rows.mapInArrow(size, f"capacity_id int, capacity int, key {key_type}, piece int, start int, end int, tokens int").distinct()


def _packed(pieces: DataFrame, shard_size: int) -> DataFrame:
    """``pieces`` with ``shard``, ``bin`` and ``fill`` (tokens in the bin)."""
    counts = {r["capacity_id"]: r["n"] for r in pieces.groupBy("capacity_id").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a capacity
    shards = F.create_map(*(F.lit(x) for c, n in counts.items() for x in (c, -(-n // shard_size)))) if counts else F.create_map(F.lit(0), F.lit(1))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("key", "piece"), shards[F.col("capacity_id")].cast("long")).cast("int"))

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by([("key", "ascending"), ("piece", "ascending"), ("start", "ascending"), ("end", "ascending")])
        sizes, capacity = t.column("tokens").to_numpy().astype(np.int64), t.column("capacity")[0].as_py()
        bins = pack(sizes, capacity)
        fill = np.bincount(bins, weights=sizes)[bins].astype(np.int64)
        return t.append_column("bin", pa.array(bins, pa.int64())).append_column("fill", pa.array(fill, pa.int64()))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema) + ", bin long, fill long"
    return dealt.groupBy("capacity_id", "shard").applyInArrow(one, schema)


def fill_containers(documents: DataFrame, capacities: list[tuple[int, int]], *, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str = TOKENIZER, shard_size: int = SHARD) -> DataFrame:
    """``capacity_id``, ``container``, ``key``, ``piece``, ``start``, ``end``, ``tokens``, ``filled``, ``fill``: where each text goes.

    Containers of a capacity are numbered from 0; ``start`` and ``end`` are the
    characters of the text that the piece has, ``filled`` the container's tokens
    and ``fill`` their share of the capacity.  Null keys and null or empty texts
    are left out, repeated rows count once, an empty table gives an empty result.
    A capacity must be at least 16 tokens, so that any character fits.
    """
    if any(c < 16 for _, c in capacities) or len({n for n, _ in capacities}) < len(capacities):
        raise ValueError("capacities need distinct ids and at least 16 tokens each")
    pieces = park(sized_pieces(documents, capacities, id_col=id_col, text_col=text_col, tokenizer_path=tokenizer_path), "pieces")
    first = park(_packed(pieces, shard_size), "packed")
    full = F.col("fill") >= F.col("capacity") * FULL
    again = _packed(first.filter(~full).drop("shard", "bin", "fill"), shard_size)
    packed = park(first.filter(full).withColumn("round", F.lit(1)).unionByName(again.withColumn("round", F.lit(2))), "packed")
    # numbers without gaps: places within a shard, then shards one after the other
    used = packed.select("capacity_id", "round", "shard", "bin").distinct()
    shards = used.groupBy("capacity_id", "round", "shard").agg(F.count(F.lit(1)).alias("bins"))
    before = Window.partitionBy("capacity_id").orderBy("round", "shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shards.withColumn("offset", F.coalesce(F.sum("bins").over(before), F.lit(0))).drop("bins")
    place = Window.partitionBy("capacity_id", "round", "shard").orderBy("bin")
    numbers = used.withColumn("place", F.row_number().over(place) - 1).join(offsets, ["capacity_id", "round", "shard"])
    out = packed.join(numbers, ["capacity_id", "round", "shard", "bin"])
    return out.select("capacity_id", (F.col("offset") + F.col("place")).alias("container"), "key", "piece", "start", "end", "tokens", F.col("fill").alias("filled"), F.round(F.col("fill") / F.col("capacity"), 6).alias("fill"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in a container of each capacity of ``pack_capacities`` (a fixed table of three rows)."""
    capacities = [(r["capacity_id"], r["capacity_tokens"]) for r in table(spark, sf_dir, "pack_capacities").collect()]
    return fill_containers(table(spark, sf_dir, "documents").select("doc_id", "text"), capacities).withColumnRenamed("key", "doc_id")
