import collections
import random

import numpy as np
import pytest

from newsloom.llm import near_duplicates
from newsloom.llm.near_duplicates import mark_counts, near_duplicate_classes, near_duplicate_groups, parities, positional_bytes, words

SCHEMA = "id string, title string, summary string, kind long, a long"


def runs(title, body):
    w = words(title, body)
    return collections.Counter(zip(w, w[1:], w[2:]))


def brute(rows, t):
    texts = {key: runs(title, body) for key, title, body, *_ in rows if key is not None and body}
    keys = sorted(texts)
    out = set()
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            n = max(sum(texts[a].values()), sum(texts[b].values()))
            if n and sum((texts[a] & texts[b]).values()) >= t * n - 1e-9:
                out.add((a, b))
    return out


def expand(pairs, members):
    by = collections.defaultdict(set)
    for r in members.collect():
        by[r.kind].add(r.key)
    out = {tuple(sorted((x, y))) for r in pairs.collect() for x in by[r.a] for y in by[r.b]}
    return out | {(x, y) for keys in by.values() for x in keys for y in keys if x < y}


def made(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randrange(4, 40))] for _ in range(n // 6)]
    rows = []
    for i in range(n):
        text = list(rng.choice(bases))
        for _ in range(rng.randrange(0, 4)):
            p = rng.randrange(len(text))
            rng.choice([lambda: text.insert(p, "new"), lambda: text.__setitem__(p, rng.choice(vocabulary)), lambda: text.pop(p) if len(text) > 1 else None, lambda: text.extend(text[:3])])()
        rows.append((f"r{i:03d}", text[0], " ".join(text[1:]), 0, 0))
    return rows


@pytest.mark.parametrize("seed, t", [(1, 0.7), (2, 0.7), (3, 0.5), (4, 0.9)])
def test_agrees_with_brute_force(spark, seed, t):
    rows = made(seed)
    assert expand(*near_duplicate_classes(spark.createDataFrame(rows, SCHEMA), t)) == brute(rows, t)


def test_words_and_bytes():
    assert words("Ab-c", "1d 迪帕x") == ["ab", "c", "1d", "迪", "帕", "x"]
    h = np.arange(1, 10, dtype=np.uint64)
    twice = np.concatenate([h, h])
    assert len(np.intersect1d(positional_bytes(h), positional_bytes(twice))) == 7  # first occurrences keep their bytes
    assert len(positional_bytes(twice)) == 16 and len(positional_bytes(h[:2])) == 0


def test_parities_bound_differences():
    rng = np.random.default_rng(1)
    a, b = (np.unique(rng.integers(0, 1 << 32, 50, dtype=np.uint32)) for _ in range(2))
    p = parities(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]), 2).view(np.uint64)
    assert sum(int(x ^ y).bit_count() for x, y in zip(*p)) <= len(np.setxor1d(a, b))


def test_groups(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [("a", "t", long, 0, 0), ("b", "t", long, 0, 0), ("c", "t", long + " more", 0, 0), ("d", "q", "something else altogether here", 0, 0), ("e", None, None, 0, 0), ("f", "x", "", 0, 0)]
    got = {r.key: (r.group_key, r.links, r.copies) for r in near_duplicate_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"a": ("a", 1, 1), "b": ("a", 1, 1), "c": ("a", 1, 0), "d": ("d", 0, 0)}


def test_edges(spark):
    pairs, members = near_duplicate_classes(spark.createDataFrame([], SCHEMA))
    assert pairs.count() == 0 and members.count() == 0
    huge = "word " * 60_000
    rows = [("a", None, huge, 0, 0), ("b", None, huge + "x", 0, 0), ("a", None, huge, 0, 0), (None, "t", "one two three four", 0, 0), ("s", "t", "one", 0, 0), ("t", "t", "one", 0, 0)]
    assert expand(*near_duplicate_classes(spark.createDataFrame(rows, SCHEMA))) == {("a", "b")}
    with pytest.raises(ValueError):
        near_duplicate_classes(spark.createDataFrame(rows, SCHEMA), 0.2)


def test_counts_cover_all_records(spark):
    rows = [(np.array([i, i + 1], np.uint32).tobytes(),) for i in range(10)]
    assert mark_counts(spark.createDataFrame([(bytearray(r[0]),) for r in rows], "marks binary").repartition(3)).sum() == 20


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BROADCAST_NAMES", 0)
    rows = made(7)
    assert expand(*near_duplicate_classes(spark.createDataFrame(rows, SCHEMA))) == brute(rows, 0.7)
