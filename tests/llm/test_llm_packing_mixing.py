import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm.mixing import mix_sources, quality
from newsloom.llm.packing import fill_containers, pack, sized_pieces
from newsloom.llm.tokens import TOKENIZER, tokenizer

SCHEMA = "doc_id long, text string, source string, bin long, shard long"
WORDS = "the council of the northern harbour approved a plan for repairs, according to 23 residents.\n\nLater on".split(" ")


def docs(n, seed=0, source="a"):
    rng = np.random.default_rng(seed)
    return [(i, " ".join(WORDS[rng.integers(len(WORDS))] for _ in range(int(rng.integers(1, 60)))), source, 0, 0) for i in range(n)]


@pytest.mark.parametrize("path", [TOKENIZER, "/opt/tokenizers/word_bpe_49k.json", "/opt/tokenizers/piece_bpe_32k.model"])
def test_pieces_add_up_and_fit(path):
    t = tokenizer(path)
    for text in ("a b  c\n\n d" * 50, "x" * 3000, "Ж迪帕🙂" * 300, " \n\n " * 100):
        for capacity in (16, 50):
            found = t.pieces(text, t.units(text, capacity), capacity)
            assert "".join(text[s:e] for s, e, _ in found) == text
            assert all(t.count(text[s:e]) == n <= capacity for s, e, n in found)


def test_counts_are_the_tokenizers():
    t = tokenizer()
    text = "The council approved it’s plan.\n\n  Совет 迪帕 12"
    assert int(t.units(text, 512)[1].sum()) == t.count(text)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("largest", [30, 60, 100])
def test_pack_is_tight(seed, largest):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, largest, 400)
    bins = pack(sizes, 100)
    fill = np.bincount(bins, weights=sizes)
    # no packing does with fewer bins than the sizes fill, nor than there are pieces of more than half a bin
    least = max(-(-int(sizes.sum()) // 100), int((sizes > 50).sum()))
    assert fill.max() <= 100 and fill.min() > 0 and len(fill) <= least * 1.04 + 1
    assert sorted(set(bins)) == list(range(len(fill)))


def test_pack_small_cases():
    assert len(pack(np.array([], np.int64), 10)) == 0 and pack(np.array([60, 60, 40, 40]), 100).max() == 1


def test_search_empties_a_bin_that_the_start_needs():
    sizes = np.array([6, 5, 4, 4, 3, 3, 3, 2])  # best fit decreasing fills four bins of ten
    assert pack(sizes, 10).max() + 1 == 3


def test_containers(spark):
    rows = docs(300) + [(300, "word " * 400, "a", 0, 0)]
    out = fill_containers(spark.createDataFrame(rows, SCHEMA), [(1, 64), (2, 512)], shard_size=100).toPandas()
    t = tokenizer()
    for number, capacity in ((1, 64), (2, 512)):
        o = out[out.capacity_id == number]
        fill = o.groupby("container").tokens.sum()
        assert fill.max() <= capacity and set(fill.index) == set(range(len(fill))) and (o.groupby("container").filled.first() == fill).all()
        for key, text, *_ in rows:
            p = o[o.key == key].sort_values("piece")
            assert "".join(text[s:e] for s, e in zip(p.start, p.end)) == text
            assert len(p) == 1 or t.count(text) > capacity


def test_container_edges(spark):
    rows = [(1, None, "", 0, 0), (2, "", "", 0, 0), (None, "text", "", 0, 0), (3, "one", "", 0, 0), (3, "one", "", 0, 0)]
    out = fill_containers(spark.createDataFrame(rows, SCHEMA), [(1, 16)]).collect()
    assert [(r.key, r.container, r.tokens) for r in out] == [(3, 0, out[0].tokens)]
    assert fill_containers(spark.createDataFrame([], SCHEMA), [(1, 16)]).count() == 0
    assert sized_pieces(spark.createDataFrame(rows, SCHEMA), [(1, 16)]).count() == 1
    with pytest.raises(ValueError):
        fill_containers(spark.createDataFrame(rows, SCHEMA), [(1, 3)])


TARGETS = "source string, target_share double, max_repeats int, tokens long"


def test_mixture(spark):
    rows = [(i, t, s, 0, 0) for k, s in enumerate(["Big", "big ", "Small", "tiny", None, "else"]) for i, t, *_ in [(1000 * k + i, t) for i, t, *_ in docs([200, 100, 60, 5, 20, 20][k], k)]]
    targets = [("Big", 0.4, 1, 0), ("SMALL", 0.35, 4, 0), ("tiny", 0.2, 2, 0), ("none", 0.05, 3, 0)]
    chosen, shares = mix_sources(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(targets, TARGETS), seed=3)
    c, s = chosen.toPandas(), shares.toPandas().set_index("source")
    t = tokenizer()
    sizes = {key: t.count(text) for key, text, *_ in rows}
    total = sum(sizes[key] for key, _, source, *_ in rows if source and source.strip().lower() in ("big", "small", "tiny"))
    assert set(c.source) == {"Big", "SMALL", "tiny"} and (c.tokens == c.key.map(sizes)).all()
    for source, share, most, _ in targets:
        own = c[c.source == source]
        got, budget = int((own.tokens * own.repeats).sum()), int(share * total + 1e-6)
        assert got == s.loc[source].chosen_tokens and (own.repeats <= most).all() and got <= budget
        if s.loc[source].capped:
            assert got == s.loc[source].available_tokens * most
        else:
            assert budget - got <= max(sizes.values()) * 2
            assert own.repeats.max() - own.repeats.min() <= 1
    assert abs(s.actual_share.sum() - 1) < 1e-5 and bool(s.loc["tiny"].capped) and s.loc["none"].chosen_tokens == 0


def test_mixture_is_the_order_of_keys(spark):
    rows = docs(150, 9, "a")
    chosen, _ = mix_sources(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("a", 1.0, 1, 0)], TARGETS), total_tokens=800)
    u = {r.doc_id: r.u for r in spark.createDataFrame(rows, SCHEMA).select("doc_id", ((F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(1 << 52)).cast("double") + 0.5) / F.lit(float(1 << 52))).alias("u")).collect()}
    order = sorted(rows, key=lambda r: (-np.log(u[r[0]]) / quality(r[1]), r[0]))
    want, total = set(), 0
    for key, text, *_ in order:
        total += tokenizer().count(text)
        if total > 800:
            break
        want.add(key)
    assert {r.key for r in chosen.collect()} == want


def test_mixture_edges(spark):
    empty, targets = spark.createDataFrame([], SCHEMA), spark.createDataFrame([("a", 1.0, 2, 0)], TARGETS)
    chosen, shares = mix_sources(empty, targets)
    assert chosen.count() == 0 and [r.chosen_tokens for r in shares.collect()] == [0]
    rows = [(1, None, "a", 0, 0), (2, "", "a", 0, 0), (None, "x", "a", 0, 0), (3, "same text", "a", 0, 0), (3, "same text", "a", 0, 0)]
    chosen, shares = mix_sources(spark.createDataFrame(rows, SCHEMA), targets)
    assert [(r.key, r.repeats) for r in chosen.collect()] == [(3, 1)]
    assert 0.05 <= quality("") <= quality("Several different words here") <= 1
