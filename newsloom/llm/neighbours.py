"""Most similar vectors of every vector, by cross-polytope hashing.

What all vectors of a model vary in by chance is filtered out first: a bounded
sample gives the spectrum, and every direction is damped by the share of its
variance that stands above the edge of pure noise (the only thing that is
fitted).  The filtered vector, in its full width, is pseudo-rotated by three
rounds of random signs and a fast Hadamard transform, a rotation of its own for
each table, and hashed to its nearest signed axes.  A vector enters the buckets
of its TABLES[t] nearest axes of table t, so two vectors meet if any of them
agree, which is multiprobing from both sides.  Each meeting place is scored
exactly on the unfiltered vectors, and the best of all places are merged.

Scale.  The number of axes grows with the rows of a model up to the full width,
and a vector travels, losslessly packed, once for each probe.  Equal vectors are
one class and travel once per input batch.  The rows of a bucket of more than
``block`` rows are divided among tasks as queries, and those of the other tasks
are streamed by class through each of them in Arrow batches, so no task holds
more than one block; every pair of a bucket is scored whatever its size and
``block`` are.  A row of a bucket of n blocks so travels n times.  Only where a
caller asks for it (``divide``) are such buckets divided by a second rotation
instead, which scores fewer pairs and misses more.  Only the fitted filters
(under one MB a model) are broadcast, and only sizes of buckets reach the driver.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from newsloom.plans.runtime import park, table

#: Rows of a model that the subspace is fitted on, at most about so many.
SAMPLE_ROWS = 4096
#: Rows of a space for each axis; a space of fewer than two axes is one bucket.
ROWS_PER_AXIS = 256
#: Nearest signed axes whose buckets a vector enters, for each table.
TABLES = (2, 1)
#: Numbers of axes that the rotation which divides large buckets may have.
INNER_AXES = (1, 2, 4, 8, 16, 32)
#: Query rows of one bucket that one task takes.
BLOCK = 12_000
#: Times the pairs wanted from which on similarities are computed for whole blocks at once.
DENSE = 16
#: Models and widths whose sizes may be broadcast; beyond it the rows are shuffled by them.
BROADCAST_SPACES = 10_000
_DIGITS = 9
_SEED = 20250301


def _hadamard_matrix(width: int, kind: np.dtype) -> np.ndarray:
    h = np.ones((1, 1), kind)
    while len(h) < width:
        h = np.block([[h, h], [h, -h]])
    return h / np.sqrt(kind.type(width))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal fast Hadamard transform of each row; the width is a power of two.

    A row is read as a square, whose two sides are transformed by one product each.
    """
    rows, width = x.shape
    one = 1 << ((width.bit_length() - 1) // 2)
    two = width // one
    y = (x.reshape(rows * one, two) @ _hadamard_matrix(two, x.dtype)).reshape(rows, one, two)
    y = y.transpose(0, 2, 1).reshape(rows * two, one) @ _hadamard_matrix(one, x.dtype)
    return y.reshape(rows, two, one).transpose(0, 2, 1).reshape(rows, width)


def pseudo_rotate(x: np.ndarray, seed: int = _SEED, rounds: int = 3) -> np.ndarray:
    """Random signs and a Hadamard transform, three times over."""
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        x = hadamard(x * rng.choice(np.array([-1, 1], x.dtype), x.shape[1]))
    return x


def nearest_axes(x: np.ndarray, probes: int) -> np.ndarray:
    """Codes of the nearest signed axes of each row: twice the axis, plus one for the positive side."""
    order = np.argsort(-np.abs(x), axis=1, kind="stable")[:, :probes]
    return 2 * order + (np.take_along_axis(x, order, 1) > 0)


def fit_filter(sample: np.ndarray) -> np.ndarray:
    """Directions of unit vectors that vary more than noise, as columns, by the root of the share of variance above it.

    Noise is the median variance of a direction; its edge in a sample of so many
    rows is that of a random matrix.  Nothing above it gives no columns.
    """
    rows, width = sample.shape
    variance, directions = np.linalg.eigh(sample.T @ sample / rows)
    noise = np.median(variance[-min(rows, width) :])
    edge = noise * (1 + np.sqrt(width / rows)) ** 2
    share = np.clip(1 - edge / np.maximum(variance, 1e-30), 0, 1)
    return (directions * np.sqrt(share))[:, share > 0]


def _filtered(unit: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Filtered unit vectors, padded with zeros to a power of two."""
    x = unit.astype(np.float32)
    if columns.shape[1]:
        x = x @ columns.astype(np.float32) @ columns.T.astype(np.float32)
    width = 1 << (x.shape[1] - 1).bit_length()
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))


def _unit(flat: np.ndarray) -> np.ndarray:
    x = flat.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[str, list, np.ndarray]]:
    """(model, keys, float32 matrix) of the usable rows of a batch, by model and width."""
    ids, models = batch.column("key").to_pylist(), batch.column("model").to_pylist()
    column = batch.column("vector")
    lengths = np.asarray(pc.list_value_length(column).fill_null(0))
    flat = column.flatten()
    bad = np.zeros(len(flat), bool) if not flat.null_count else np.asarray(flat.is_null())
    values = np.asarray(flat.fill_null(0.0) if flat.null_count else flat, dtype=np.float32)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    groups: dict[tuple[str, int], list[int]] = {}
    for i, (key, model, n) in enumerate(zip(ids, models, lengths)):
        if key is not None and model is not None and n:
            groups.setdefault((model, int(n)), []).append(i)
    for (model, n), rows in groups.items():
        at = starts[rows][:, None] + np.arange(n)
        x = values[at]
        fine = np.isfinite(x).all(1) & (x != 0).any(1) & ~bad[at].any(1)
        if fine.any():
            yield f"{model}|{n}", [ids[r] for r, ok in zip(rows, fine) if ok], x[fine]


def _planes(raw: np.ndarray, width: int) -> bytes:
    return zlib.compress(raw.view(np.uint8).reshape(-1, width).T.tobytes(), 1)


def _pack(x: np.ndarray) -> bytes:
    """A float32 row without loss: as half precision where that holds it exactly; bytes grouped by significance, deflated."""
    with np.errstate(over="ignore"):
        half = x.astype(np.float16)
    if (half.astype(np.float32) == x).all():
        return b"h" + _planes(half, 2)
    return b"f" + _planes(x, 4)


def _unpack(data: bytes) -> np.ndarray:
    width = 2 if data[:1] == b"h" else 4
    raw = np.frombuffer(zlib.decompress(data[1:]), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(raw.T).view(np.float16 if width == 2 else np.float32).ravel().astype(np.float32)


def _class_of(unit: np.ndarray) -> list[bytes]:
    """One key per direction: equal vectors of any length share it.  Single precision would merge what differs in the ninth digit."""
    return [hashlib.blake2b(row.tobytes(), digest_size=16).digest() for row in unit.round(12) + 0.0]


def _usable(vectors: DataFrame, id_col: str, vector_col: str, model_col: str) -> DataFrame:
    return vectors.select(F.col(id_col).cast("string").alias("key"), F.col(model_col).cast("string").alias("model"), F.col(vector_col).cast("array<float>").alias("vector")).filter(F.col("vector").isNotNull())


def _fit(rows: DataFrame, sample_rows: int, rows_per_axis: int) -> dict[str, tuple[int, np.ndarray]]:
    """Axes and filter of each space that is more than one bucket."""
    sized = rows.groupBy("model", F.size("vector").alias("width")).agg(F.count(F.lit(1)).alias("n"))
    # spaces of one bucket need no filter; the others are one row for each model and width
    sized = sized.filter(F.col("n") >= 2 * rows_per_axis)
    sized = F.broadcast(sized) if sized.count() <= BROADCAST_SPACES else sized
    hashed = rows.withColumn("width", F.size("vector")).withColumn("pick", F.pmod(F.xxhash64("key"), F.lit(1_000_003)) / F.lit(1_000_003.0))
    sample = hashed.join(sized, ["model", "width"]).filter(F.col("pick") * F.col("n") < sample_rows)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = dict(zip(zip(batch.column("model").to_pylist(), batch.column("width").to_pylist()), batch.column("n").to_pylist()))
            for space, keys, x in _vectors(batch):
                model, _, width = space.rpartition("|")
                n = sizes[model, int(width)]
                yield pa.RecordBatch.from_pydict({"space": pa.array([space] * len(keys), pa.string()), "n": pa.array([n] * len(keys), pa.int64()), "data": pa.array([_pack(v) for v in x], pa.binary())})

    def one(t: pa.Table) -> pa.Table:
        width = int(t.column("space")[0].as_py().rpartition("|")[2])
        axes = min(1 << max(0, (width - 1).bit_length()), 1 << max(0, int(t.column("n")[0].as_py() // rows_per_axis).bit_length() - 1))
        if axes < 2:
            return t.select(["space"]).slice(0, 0).append_column("axes", pa.array([], pa.int32())).append_column("columns", pa.array([], pa.binary()))
        columns = fit_filter(_unit(np.vstack([_unpack(d) for d in t.column("data").to_pylist()])))
        return pa.table({"space": t.column("space")[:1], "axes": pa.array([axes], pa.int32()), "columns": pa.array([columns.tobytes()], pa.binary())})

    drawn = sample.select("model", "width", "n", "key", "vector").mapInArrow(packed, "space string, n long, data binary")
    fitted = drawn.groupBy("space").applyInArrow(one, "space string, axes int, columns binary").collect()  # one row a space
    return {r["space"]: (r["axes"], np.frombuffer(r["columns"], np.float64).reshape(int(r["space"].rpartition("|")[2]), -1)) for r in fitted}


#: Bits of a bucket's number that say which part of a divided bucket it is.
_INNER_BITS = (2 * INNER_AXES[-1]).bit_length()


def bucket_codes(unit: np.ndarray, axes: int, columns: np.ndarray, tables: tuple[int, ...], divided: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Buckets of each row, by table and signed axis; with ``divided`` also the signed axis of the inner rotation, for each of INNER_AXES, in that table."""
    x = _filtered(unit, columns)
    outer, inner = [], []
    for t, probes in enumerate(tables):
        near = nearest_axes(pseudo_rotate(x, _SEED + 2 * t)[:, :axes], min(probes, axes))
        outer.append(t * 2 * axes + near)
        if divided:
            turned = pseudo_rotate(x, _SEED + 2 * t + 1)
            inner += [np.hstack([nearest_axes(turned[:, :n], 1) for n in INNER_AXES])] * near.shape[1]
    return np.hstack(outer), np.stack(inner, 1) if divided else None


def inner_level(rows: int, block: int) -> int:
    """Place in INNER_AXES of the axes that divide a bucket of so many rows; -1 leaves it whole."""
    if rows <= block:
        return -1
    return next((i for i, n in enumerate(INNER_AXES) if 2 * n * block >= rows), len(INNER_AXES) - 1)


def _coded(batch: pa.RecordBatch, spaces: dict[str, tuple[int, np.ndarray]], tables: tuple[int, ...], levels: dict[tuple[str, int], int]):
    """(space, keys, vectors, classes, buckets of each row) of a batch; ``levels`` has the buckets that are divided."""
    for space, keys, x in _vectors(batch):
        unit = _unit(x)
        # a small space is one bucket
        codes = np.zeros((len(x), 1), np.int64)
        if space in spaces:
            outer, inner = bucket_codes(unit, *spaces[space], tables, any(s == space for s, _ in levels))
            codes = outer << _INNER_BITS
            if inner is not None:
                level = np.vectorize(lambda b: levels.get((space, b), -1), otypes=[np.int64])(outer)
                part = np.take_along_axis(inner, np.maximum(level, 0)[:, :, None], 2)[:, :, 0]
                codes = codes | np.where(level >= 0, part + 1, 0)
        yield space, keys, x, _class_of(unit), codes


def _best(q64: np.ndarray, q32: np.ndarray, unit: np.ndarray, m32: np.ndarray, least: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, member, rounded exact similarity) of all pairs that may be among the ``keep`` best of a row.

    Single precision only rules out what lies below a row's last place by more
    than its error bound, so whatever ties with that place stays.
    """
    s = q32 @ m32.T
    width = min(keep, s.shape[1])
    last = least
    if (least < -2).any():
        # a row has places free
        last = np.maximum(np.partition(s, s.shape[1] - width, axis=1)[:, s.shape[1] - width], least)
    margin = 2 * (unit.shape[1] + 8) * 2.0**-24
    row, member = np.nonzero(s >= (last - margin).astype(np.float32)[:, None])
    if len(row) > DENSE * width * len(s):
        return row, member, (q64 @ unit.T)[row, member].round(_DIGITS)
    exact = np.empty(len(row))
    step = max(1, 4_000_000 // unit.shape[1])
    for at in range(0, len(row), step):
        pairs = slice(at, at + step)
        exact[pairs] = np.einsum("ij,ij->i", q64[row[pairs]], unit[member[pairs]])
    return row, member, exact.round(_DIGITS)


def _score(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Stream (space, bucket, part)-sorted rows, queries before members and members by class, and give each class its best candidates.

    Queries are each other's candidates; members are those of other parts.
    A candidate is a class with its k + 1 smallest ids.  Equal similarity is
    decided for the class with the smallest id, so k + 1 classes hold the
    k + 1 first ids however many tie.
    """
    keep = k + 1
    state: dict = {"group": None}
    pending: list[tuple] = []

    def open_group(group: tuple) -> None:
        state.update(group=group, q=[], qids={}, ready=None)

    def prepare() -> None:
        kinds = list(state["qids"])
        unit = _unit(np.vstack([state["q"][i] for i in range(len(kinds))]))
        state["ready"] = (kinds, unit, unit.astype(np.float32), np.full((len(kinds), keep), -9.0), np.full((len(kinds), keep), -1, np.int64))
        state["lists"], state["q"] = [], []
        absorb(unit, list(state["qids"].values()))

    def absorb(unit: np.ndarray, lists: list) -> None:
        kinds, q64, q32, sims, refs = state["ready"]
        base = len(state["lists"])
        m32 = unit.astype(np.float32)
        touched = np.zeros(len(lists), bool)
        state["lists"] += lists
        # places of the smallest ids, for ties
        live = [*np.unique(refs[refs >= 0]).tolist(), *range(base, base + len(lists))]
        place = np.zeros(base + len(lists), np.int64)
        place[sorted(live, key=lambda r: state["lists"][r][0])] = np.arange(len(live))
        step = max(1, 6_000_000 // max(1, len(unit)))
        for start in range(0, len(q32), step):
            rows = slice(start, start + step)
            row, member, exact = _best(q64[rows], q32[rows], unit, m32, sims[rows, -1], keep)
            held = np.nonzero(refs[rows] >= 0)
            row = np.concatenate([held[0], row])
            sim = np.concatenate([sims[rows][held], exact])
            ref = np.concatenate([refs[rows][held], member + base])
            order = np.lexsort((place[ref], -sim, row))
            row, sim, ref = row[order], sim[order], ref[order]
            at = np.arange(len(row)) - np.searchsorted(row, row)
            first = at < keep
            sims[start + row[first], at[first]], refs[start + row[first], at[first]] = sim[first], ref[first]
            chosen = refs[rows]
            touched[(chosen[chosen >= base] - base)] = True
        state["lists"][base:] = [ids if used else None for ids, used in zip(lists, touched)]

    def close_group() -> Iterator[pa.RecordBatch]:
        if state["group"] is None or not state["qids"]:
            return
        if state["ready"] is None:
            prepare()
        kinds, unit, _, sims, refs = state["ready"]
        out_kind, out_sim, out_id = [], [], []
        for i, kind in enumerate(kinds):
            found: dict[str, float] = {}
            for s, r in zip(sims[i], refs[i]):
                if r >= 0:
                    for key in state["lists"][r]:
                        found[key] = max(found.get(key, -9.0), float(s))
            for key, s in sorted(found.items(), key=lambda x: (-x[1], x[0]))[: k + 1]:
                out_kind.append(kind), out_sim.append(s), out_id.append(key)
        space = state["group"][0]
        yield pa.RecordBatch.from_pydict({"space": pa.array([space] * len(out_kind), pa.string()), "kind": pa.array(out_kind, pa.binary()), "sim": pa.array(out_sim, pa.float64()), "key": pa.array(out_id, pa.string())})

    def flush(n: int) -> None:
        """Absorb the first ``n`` pending members; those of a class that may go on are left for later."""
        if n > 0 and state["qids"]:
            if state["ready"] is None:
                prepare()
            absorb(_unit(np.vstack([_unpack(d) for _, _, d in pending[:n]])), [ids for _, ids, _ in pending[:n]])
        del pending[: max(0, n)]

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("space", "bucket", "part", "member", "kind", "keys", "data")]
        for space, bucket, part, member, kind, keys, data in zip(*columns):
            group = (space, bucket, part)
            if group != state["group"]:
                flush(len(pending))
                yield from close_group()
                open_group(group)
            if member:
                if pending and pending[-1][0] == kind:
                    pending[-1] = (kind, sorted(set(pending[-1][1]) | set(keys))[: k + 1], pending[-1][2])
                else:
                    pending.append((kind, keys, data))
            elif kind in state["qids"]:
                state["qids"][kind] = sorted(set(state["qids"][kind]) | set(keys))[: k + 1]
            else:
                state["qids"][kind] = keys
                state["q"].append(_unpack(data))
        flush(len(pending) - 1)
    flush(len(pending))
    yield from close_group()


def nearest(vectors: DataFrame, k: int = 5, *, id_col: str = "article_id", vector_col: str = "embedding", model_col: str = "model", rows_per_axis: int = ROWS_PER_AXIS, tables: tuple[int, ...] = TABLES, block: int = BLOCK, sample_rows: int = SAMPLE_ROWS, divide: bool = False) -> DataFrame:
    """``id``, ``model``, ``rank``, ``neighbour``, ``similarity``: the k most similar vectors of each vector of the same model and width.

    Cosine similarity, rounded to nine digits; ties go to the smaller id.  Null,
    empty, all-zero and non-finite vectors and null ids or models are left out,
    repeated rows of an id count once, an empty table gives an empty result,
    further columns are ignored.  A miss is a pair that shares none of its
    nearest axes; the README has the recall measured against brute force.
    ``block`` is the size of a task and changes no result, except with
    ``divide``, where larger buckets are divided by nearest axes again.
    """
    spark = vectors.sparkSession
    rows = _usable(vectors, id_col, vector_col, model_col)
    spaces = spark.sparkContext.broadcast(_fit(rows, sample_rows, rows_per_axis))

    def describe(levels: dict[tuple[str, int], int]):
        def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for space, keys, _, kinds, codes in _coded(batch, spaces.value, tables, levels):
                    yield pa.RecordBatch.from_pydict({"space": pa.array([space] * len(keys), pa.string()), "key": pa.array(keys, pa.string()), "kind": pa.array(kinds, pa.binary()), "codes": pa.array(list(codes.astype(np.int32)), pa.list_(pa.int32()))})

        return rows.mapInArrow(rows_of, "space string, key string, kind binary, codes array<int>")

    def counted(described: DataFrame) -> dict[tuple[str, int], int]:
        # at most a bucket for each signed axis of each table, and of each divided one those of the inner rotation
        return {(r["space"], r["code"]): r["count"] for r in described.select("space", F.explode("codes").alias("code")).groupBy("space", "code").count().collect()}

    members = park(describe({}), "vector-classes")
    sizes = counted(members)
    levels = {(space, code >> _INNER_BITS): inner_level(n, block) for (space, code), n in sizes.items() if divide and n > block and space in spaces.value}
    if levels:
        sizes = counted(describe(levels))
    parts = {key: -(-n // block) for key, n in sizes.items()}
    shared_parts = spark.sparkContext.broadcast((parts, levels))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, levels = shared_parts.value
            for space, keys, x, kinds, codes in _coded(batch, spaces.value, tables, levels):
                first: dict[bytes, int] = {}
                ids: dict[bytes, set] = {}
                for i, (key, kind) in enumerate(zip(keys, kinds)):
                    first.setdefault(kind, i)
                    ids.setdefault(kind, set()).add(key)
                out: dict[str, list] = {c: [] for c in ("space", "bucket", "part", "member", "kind", "keys", "data")}
                for kind, i in first.items():
                    data, short = _pack(x[i]), sorted(ids[kind])[: k + 1]
                    for code in codes[i].tolist():
                        n = parts.get((space, code), 1)
                        own = int.from_bytes(kind[:4], "big") % n
                        places = [(p, p != own) for p in range(n)]
                        for part, member in places:
                            for c, v in zip(out, (space, code, part, member, kind, short, data)):
                                out[c].append(v)
                yield pa.RecordBatch.from_pydict(
                    {
                        "space": pa.array(out["space"], pa.string()),
                        "bucket": pa.array(out["bucket"], pa.int32()),
                        "part": pa.array(out["part"], pa.int32()),
                        "member": pa.array(out["member"], pa.bool_()),
                        "kind": pa.array(out["kind"], pa.binary()),
                        "keys": pa.array(out["keys"], pa.list_(pa.string())),
                        "data": pa.array(out["data"], pa.binary()),
                    }
                )

    # a task takes several small buckets, one after the other, a quarter of a block on average
    tasks = max(1, -(-4 * sum(n * parts[key] for key, n in sizes.items()) // block), max(parts.values(), default=1))
    placed = rows.mapInArrow(place, "space string, bucket int, part int, member boolean, kind binary, keys array<string>, data binary")
    lined = placed.repartition(tasks, "space", "bucket", "part").sortWithinPartitions("space", "bucket", "part", "member", "kind")
    scored = lined.mapInArrow(lambda it: _score(it, k), "space string, kind binary, sim double, key string")
    # each class meets its candidates in at most so many places, each of which gives k + 1
    best = scored.groupBy("space", "kind").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("sim")).alias("d"), F.col("key").alias("neighbour")))), 1, 2 * (k + 1) * sum(tables)).alias("best"))
    per_row = members.select("space", "key", "kind").distinct().join(best, ["space", "kind"])
    ranked = per_row.select(
        F.col("key").alias("id"),
        F.regexp_replace("space", r"\|\d+$", "").alias("model"),
        F.posexplode(F.slice(F.filter("best", lambda b: b["neighbour"] != F.col("key")), 1, k)).alias("rank", "b"),
    )
    return ranked.select("id", "model", (F.col("rank") + 1).alias("rank"), F.col("b.neighbour").alias("neighbour"), (-F.col("b.d")).alias("similarity"))


def brute_force(vectors: list[tuple[str, str, list[float] | None]], k: int) -> dict[tuple[str, str], list[str]]:
    """The same by looking at every pair; for tests and for measuring recall."""
    spaces: dict[tuple[str, int], dict[str, np.ndarray]] = {}
    for key, model, v in vectors:
        if key is not None and model is not None and v is not None and len(v) and all(c is not None for c in v):
            x = np.asarray(v, np.float32)
            if np.isfinite(x).all() and x.any():
                spaces.setdefault((model, len(v)), {})[key] = x
    found = {}
    for (model, _), rows in spaces.items():
        keys = sorted(rows)
        unit = _unit(np.vstack([rows[key] for key in keys]))
        for i, key in enumerate(keys):
            s = (unit @ unit[i]).round(_DIGITS)
            order = [j for j in np.lexsort((np.arange(len(keys)), -s)) if j != i][:k]
            found[(model, key)] = [keys[j] for j in order]
    return found


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id_a``, ``id_b``: pairs of which at least one is among the five most similar of the other."""
    near = nearest(table(spark, sf_dir, "article_embeddings").select("article_id", "embedding", "model"))
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
