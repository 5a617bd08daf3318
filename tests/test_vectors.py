import random

import numpy as np
import pytest

from newsloom.operators.components import component_labels
from newsloom.operators.vectors import assign_in_order, assign_stories, similar_in_band

HOUR = 3_600_000
ITEMS = "id string, t long, ord_t long, vector array<double>"


def unit(v):
    v = np.asarray(v, float)
    return (v / np.linalg.norm(v)).tolist()


def made(seed, n=150, width=8, hours=400):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width))
    rows = []
    for i in range(n):
        v = unit(centres[rng.integers(12)] + 0.35 * rng.normal(size=width))
        t = int(rng.integers(0, hours)) * HOUR
        undated = rng.random() < 0.1
        rows.append((f"i{i:03d}", hours * HOUR if undated else t, None if undated else t, v))
    return rows


@pytest.mark.parametrize("seed, hours", [(1, 40), (2, 400), (3, 2000)])
def test_assignment_equals_one_pass_over_all(spark, seed, hours):
    rows = made(seed, hours=hours)
    order = sorted(rows, key=lambda r: (r[2] is None, r[2] if r[2] is not None else 0, r[0]))
    want = set(assign_in_order([(r[0], r[1], r[3]) for r in order], 0.83, 8, 72))
    got = {(r.id, r.story, r.is_new) for r in assign_stories(spark.createDataFrame(rows, ITEMS)).collect()}
    assert got == want


def test_window_edges():
    v = unit([1, 0])
    run = lambda times: [s for _, s, _ in assign_in_order([(str(i), t, v) for i, t in enumerate(times)], 0.83, 8, 72)]
    assert run([0, 8 * HOUR]) == ["0", "0"]  # both ends of the window count
    assert run([0, 8 * HOUR + 1]) == ["0", "1"]
    assert run([i * 8 * HOUR for i in range(10)])[8:] == ["0", "9"]  # a story takes no item at 72 hours of age
    assert assign_in_order([("a", 0, v), ("b", 0, unit([0, 1])), ("c", 0, unit([1, 1]))], 0.5, 8, 72)[2] == ("c", "a", False)  # a tie goes to the smaller id
    assert assign_in_order([], 0.8, 8, 72) == []


@pytest.mark.parametrize("block", [8000, 7])
def test_similar_pairs_in_a_band(spark, block):
    rows = [(i, t, v) for i, t, _, v in made(5, 80)]
    want = {(min(a[0], b[0]), max(a[0], b[0])) for k, a in enumerate(rows) for b in rows[k + 1 :] if abs(a[1] - b[1]) <= 80 * HOUR and float(np.dot(a[2], b[2])) >= 0.83}
    got = {(r.a, r.b) for r in similar_in_band(spark.createDataFrame(rows, "id string, t long, vector array<double>"), 0.83, 80, block).collect()}
    assert got == want and got


def test_no_items(spark):
    assert assign_stories(spark.createDataFrame([], ITEMS)).count() == 0


def test_components_of_a_long_chain(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(80)]
    rng.shuffle(links)
    assert {r.label for r in component_labels(spark.createDataFrame(links, "a long, b long")).collect()} == {0}
