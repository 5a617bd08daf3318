import random

import numpy as np
import pytest

from newsloom.llm import spans
from newsloom.llm.spans import maximal_repeats, rolling, code_points, shared_share, shared_spans

SCHEMA = "doc_id long, text string, name long, a long, key long"
ALPHABET = "abcdefgh äЖ迪🙂"


def text(rng, n):
    return "".join(rng.choice(ALPHABET) for _ in range(n))


def brute_pairs(rows, n):
    windows = {}
    for key, t, *_ in rows:
        if key is not None and t is not None:
            windows.setdefault(key, set()).update(t[i : i + n] for i in range(len(t) - n + 1))
    keys = sorted(windows)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if windows[a] & windows[b]}


def expand(spans, members):
    by = {}
    for r in members.collect():
        by.setdefault(r.name, set()).add(r.key)
    out = {tuple(sorted((x, y))) for r in spans.collect() for x in by[r.a] for y in by[r.b]}
    return out | {(x, y) for keys in by.values() for x in keys for y in keys if x < y}


def made(seed, n=60):
    rng = random.Random(seed)
    pool = [text(rng, 700) for _ in range(5)]
    rows = []
    for i in range(n):
        t = text(rng, rng.randrange(0, 500))
        if rng.random() < 0.6:
            p = rng.choice(pool)
            start, size = rng.randrange(400), rng.randrange(150, 300)
            cut = p[start : start + size]
            t = rng.choice([t + cut, cut + t, t[:100] + cut + t[100:], cut + "|" + cut])
        rows.append((i, t, 0, 0, 0))
    return rows + [(n, rows[3][1], 0, 0, 0)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pairs_agree_with_brute_force(spark, seed):
    rows = made(seed)
    assert expand(*shared_spans(spark.createDataFrame(rows, SCHEMA), 200)) == brute_pairs(rows, 200)


@pytest.mark.parametrize("size, hit", [(199, False), (200, True), (201, True)])
@pytest.mark.parametrize("shift", range(0, 60, 7))
def test_limit_at_every_alignment(size, hit, shift):
    rng = random.Random(shift)
    shared = text(rng, size)
    a, b = "x" * shift + shared + "y" * 80, "z" * (3 * shift) + shared + "w" * 33
    found = maximal_repeats(a, b, 200)
    assert bool(found) == hit and (not hit or found == [(shift, 3 * shift, size)])


def test_repeats_are_maximal_and_complete():
    rng = random.Random(8)
    p, q = text(rng, 260), text(rng, 400)
    a, b = f"1{p}2{q}3{p}", f"4{q}5{p}6"
    found = maximal_repeats(a, b, 200)
    assert {(a[s : s + n], b[t : t + n]) for s, t, n in found} == {(p, p), (q, q)} and len(found) == 3


def test_rolling_tells_windows_apart():
    h = rolling(code_points("abcabcabd"), 3)
    assert h[0] == h[3] and len(set(h.tolist())) == 4 and len(rolling(code_points("ab"), 3)) == 0


def test_shares(spark):
    rng = random.Random(4)
    p = text(rng, 300)
    rows = [(1, p + text(rng, 100), 0, 0, 0), (2, text(rng, 50) + p[:250], 0, 0, 0), (3, text(rng, 400), 0, 0, 0), (4, "short", 0, 0, 0), (5, None, 0, 0, 0), (6, text(rng, 220), 0, 0, 0)]
    rows.append((7, rows[5][1], 0, 0, 0))
    got = {r.key: (r.chars, r.shared_chars, r.copies) for r in shared_share(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (400, 250, 0), 2: (300, 250, 0), 3: (400, 0, 0), 4: (5, 0, 0), 5: (None, 0, 0), 6: (220, 220, 1), 7: (220, 220, 1)}


def test_edges(spark):
    found, members = shared_spans(spark.createDataFrame([], SCHEMA))
    assert found.count() == 0 and members.count() == 0
    rng = random.Random(6)
    long = text(rng, 1000) * 1300  # longer than a chunk, with repeats within
    other = text(rng, 5000) + long[777_000:777_500]
    rows = [(1, long, 0, 0, 0), (1, long, 0, 0, 0), (2, other, 0, 0, 0), (None, long, 0, 0, 0), (3, "", 0, 0, 0), (4, "a" * 5000, 0, 0, 0), (5, "b" + "a" * 300, 0, 0, 0)]
    assert expand(*shared_spans(spark.createDataFrame(rows, SCHEMA))) == {(1, 2), (4, 5)}
    with pytest.raises(ValueError):
        shared_spans(spark.createDataFrame(rows, SCHEMA), 120)


def test_spans_over_the_edges_of_pieces(monkeypatch):
    """Spans of just 200 characters about the edge between two pieces of a long text."""
    monkeypatch.setattr(spans, "CHUNK", 2000)
    run, reach, d = spans._run_length(200), 50, 10
    edge = (2000 - run) // spans.BLOCK * spans.BLOCK
    rng = random.Random(11)

    def hashes(t):
        return rolling(code_points(t), spans.GRAM).tolist()

    def lead(shared, n):
        """Characters before the span of which the block before the edge has its own least hash."""
        while True:
            t = text(rng, n)
            h = hashes(t[-15:] + shared[: d + 150])
            if min(h[:15]) < min(h[15:]):
                return t

    cases = [(start, text(rng, start), text(rng, 200), text(rng, 40)) for start in range(edge - 220, edge + 220, 5)]
    while len(cases) < 100:
        # the window at the edge is represented by a place less than reach behind the edge, the one before it by another
        shared = text(rng, 200)
        h = hashes(shared)[: d + 76]
        place = min(range(d, d + 76), key=h.__getitem__)
        if min(h) == h[d - 1] and reach < place < d + reach:
            cases.append((edge - d, lead(shared, edge - d), shared, lead(shared, 40)))
    missed = []
    for start, before, shared, ahead in cases:
        sides = []
        for name, t in ((1, before + shared + text(rng, 3000)), (2, ahead + shared + text(rng, 41))):
            columns = [np.concatenate(c) for c in zip(*spans._anchors([name], [t], run, reach))]
            sides.append(list(zip(*(c.tolist() for c in columns))))
        if not any(a[0] == b[0] and (a[2] == b[2] or a[3] == b[3]) and (a[4] or b[4]) for a in sides[0] for b in sides[1]):
            missed.append(start - edge)
    assert missed == []


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(spans, "BROADCAST_NAMES", 0)
    rows = made(9)
    assert expand(*shared_spans(spark.createDataFrame(rows, SCHEMA), 200)) == brute_pairs(rows, 200)
