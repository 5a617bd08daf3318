import pytest

from newsloom.llm.lookalikes import one_form, repairs, same_reading, settle

SCHEMA = "id string, title string, text string, form string"


@pytest.mark.parametrize(
    "a, b",
    [
        ("ｏｕｔｌｉｎｅｄ the plan", "outlined the plan"),
        ("régional", "régional"),
        ("  the port plan　", "the port plan"),
        ("cea­se​fire﻿͏᠎⁠", "ceasefire"),
        ("ceaseﬁre", "ceasefire"),
        ("⼈⻥", "人鱼"),
        ("ﻻ", "لا"),
        ("تعويق ك", "تعویق ک"),
        ("ف‌ا"[0] + "ا‌ب", "فاب"),
    ],
)
def test_settled_alike(a, b):
    assert settle(a) == settle(b)


@pytest.mark.parametrize("a, b", [("résumé", "resume"), ("Port", "port"), ("2٢", "22"), ("it’s", "it's"), ("a – b", "a - b"), ("می‌شود", "میشود")])
def test_settled_apart(a, b):
    assert settle(a) != settle(b)


def test_repairs_by_dominant_script():
    fixed = {}
    for text in (settle("Тhе pοrt authority"), settle("Министерство aгентство")):
        for s, e, f in repairs(text):
            fixed.setdefault(text[s:e], f)  # the likelier repair comes first
    assert fixed["Тhе"] == "The" and fixed["pοrt"] == "port" and fixed["aгентство"] == "агентство"
    assert repairs("plain ascii") == [] and repairs("Порт закрыт") == []


def forms(spark, titles):
    return {r.text: r.form for r in one_form(spark.createDataFrame([(str(i), t, "x", "y") for i, t in enumerate(titles)], SCHEMA)).collect()}


def test_only_repairs_that_the_collection_knows(spark):
    got = forms(spark, ["the port", "the pοrt", "zοrk", "zоrk", "qοne"])
    assert got["the pοrt"] == "the port"
    assert got["zοrk"] == got["zоrk"] == "zork"  # two spellings of one repair
    assert got["qοne"] == "qοne"  # nothing in the collection says so


def test_edges(spark):
    got = forms(spark, [None, "", " ", "​", "x" * 100_000, "x" * 100_000, "(no title)"])
    assert got[""] == "" and got[" "] == "" and got["​"] == "" and len(got["x" * 100_000]) == 100_000 and None not in got
    assert one_form(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [("1", "a b", None, None), ("1", "a b", None, None), ("2", "a b", None, None), (None, "a b", None, None), ("3", None, None, None)]
    read = sorted((r.id, r.spellings) for r in same_reading(spark.createDataFrame(rows, SCHEMA)).collect())
    assert read == [("1", 2), ("2", 2)]
