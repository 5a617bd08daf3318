import numpy as np
import pytest

from newsloom.llm.neighbours import _pack, _unpack, brute_force, bucket_codes, fit_filter, hadamard, inner_level, nearest, nearest_axes, pseudo_rotate

SCHEMA = "article_id string, embedding array<float>, model string, key string, space string"


def rows_of(n, width, model, seed, topics=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(topics, width))
    x = centres[rng.integers(0, topics, n)] + 1.2 * rng.normal(size=(n, width))
    return [(f"{model}-{i:04d}", [float(v) for v in row.astype(np.float32)], model, "x", "y") for i, row in enumerate(x)]


def found(spark, rows, **kw):
    out = {}
    for r in sorted(nearest(spark.createDataFrame(rows, SCHEMA), 5, **kw).collect(), key=lambda r: r["rank"]):
        out.setdefault((r.model, r.id), []).append(r.neighbour)
    return out


def test_rotation_keeps_lengths_and_axes_are_nearest():
    x = np.random.default_rng(0).normal(size=(5, 32))
    y = pseudo_rotate(x)
    assert np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)) and np.allclose(hadamard(hadamard(x)), x)
    codes = nearest_axes(y, 3)
    for row, code in zip(y, codes):
        signed = np.ravel(np.column_stack([-row, row]))
        assert list(np.argsort(-signed)[:1]) == [code[0]]


def test_packing_is_lossless():
    for x in (np.random.default_rng(1).normal(size=50).astype(np.float32), np.array([0.5, -2.0, 1e30, 65504.0], np.float32), np.array([0.5, 0.25, -8.0], np.float32)):
        assert (_unpack(_pack(x)) == x).all()


def test_exact_on_small_spaces_and_models_apart(spark):
    rows = rows_of(60, 16, "m1", 1) + rows_of(40, 24, "m2", 2)
    assert found(spark, rows) == brute_force([(key, model, v) for key, v, model, *_ in rows], 5)


def test_the_filter_keeps_what_stands_above_noise():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(2000, 64))
    x[:, :3] *= 6
    columns = fit_filter(x / np.linalg.norm(x, axis=1, keepdims=True))
    assert columns.shape == (64, 3) and (np.abs(columns[3:]) < 0.1).all()
    assert fit_filter(rng.normal(size=(4000, 16))).shape[1] <= 1


def test_buckets_grow_with_the_rows_and_fewer_pairs_meet():
    share = []
    for axes in (4, 16, 64):
        x = np.random.default_rng(1).normal(size=(2000, 64))
        codes, _ = bucket_codes(x / np.linalg.norm(x, axis=1, keepdims=True), axes, np.empty((64, 0)), (2, 1))
        met = (codes[:300, None, :, None] == codes[None, :, None, :]).any((2, 3))
        share.append(met.mean())
    assert share[0] > 2.5 * share[1] > 6 * share[2]


def test_recall_and_split_buckets(spark):
    rows = rows_of(3000, 32, "m", 3, topics=12)
    want = brute_force([(key, model, v) for key, v, model, *_ in rows], 5)
    # whole buckets, divided ones (whose vectors differ by chance within a topic here), one bucket in blocks
    for kw, least in (({}, 0.9), ({"block": 400}, 0.85), ({"block": 150, "rows_per_axis": 4000}, 1.0)):
        got = found(spark, rows, **kw)
        hits = sum(len(set(v) & set(got.get(k, []))) for k, v in want.items())
        assert hits / sum(map(len, want.values())) >= least
        assert set(got) == set(want)


def test_results_do_not_depend_on_the_size_of_a_task(spark):
    rows = rows_of(2500, 32, "m", 8, topics=5)
    whole = found(spark, rows)
    assert found(spark, rows, block=150) == whole
    # only where it is asked for
    assert found(spark, rows, block=150, divide=True) != whole


def test_a_bucket_is_divided_into_as_many_parts_as_it_needs():
    assert [inner_level(n, 100) for n in (100, 101, 201, 900, 10**9)] == [-1, 0, 1, 3, 5]


def test_ties_copies_and_unusable(spark):
    same = [1.0, 2.0, 3.0, 4.0]
    rows = [(f"s{i:02d}", [v * f for v in same], "m", "", "") for i, f in enumerate([1, 1, 2, 0.25, 1, 1, 1, 4])]
    rows += [("z", [0.0] * 4, "m", "", ""), ("n", None, "m", "", ""), ("e", [], "m", "", ""), (None, same, "m", "", ""), ("x", same, None, "", ""), ("q", [1.0, None, 2.0, 3.0], "m", "", ""), ("other", [4.0, -3.0, 2.0, -1.0], "m", "", "")]
    rows += rows[:2]
    got = found(spark, rows)
    assert got == brute_force([(key, model, v) for key, v, model, *_ in rows], 5)
    assert got["m", "s00"] == ["s01", "s02", "s03", "s04", "s05"] and ("m", "z") not in got


@pytest.mark.parametrize("block", [12_000, 10])
def test_many_tied_copies_over_small_batches(spark, block):
    """A class over more input batches, and more tied classes, than there are places for candidates."""
    x = rows_of(30, 16, "m", 5)
    one, other = (np.asarray(v, np.float32) for _, v, *_ in rows_of(2, 16, "t", 6))
    copies = [(f"c{i:02d}", [float(c) for c in one * np.float32([1, 1, 3, 0.7][i % 4])], "m", "", "") for i in range(40)]
    scaled = [(f"d{i:02d}", [float(c) for c in other * np.float32(0.7 + 0.13 * i)], "m", "", "") for i in range(40)]
    # the smallest ids come last
    rows = x + copies[::-1] + scaled[::-1]
    most = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = found(spark, rows, block=block)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
    assert got == brute_force([(key, model, v) for key, v, model, *_ in rows], 5)
    assert got["m", "c39"] == [f"c{i:02d}" for i in range(5)] and got["m", "d00"] == [f"d{i:02d}" for i in range(1, 6)]


def test_empty(spark):
    assert nearest(spark.createDataFrame([], SCHEMA)).count() == 0
