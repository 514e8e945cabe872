import re

import numpy as np
import pytest

from ledgerloom.llm import decontaminate as D
from ledgerloom.llm.queries import op2_decontaminate

ITEM = "A train leaves Boston with Maria at 40 km per hour and after 3 hours it has gone how many km in all before Maria gets off?"
OTHER = "A train leaves Boston with Carlos at 55 km per hour and after 7 hours it has gone how many km in all before Carlos gets off?"
MIXED = "A train leaves Boston with Carlos at 55 km per hour and after 7 hours it has gone how many km in all before Nadia gets off?"
FILLER = "some words that have nothing to do with any of this at all. "


@pytest.fixture
def items(spark):
    return spark.createDataFrame([(1, ITEM), (2, "short item of six words here"), (3, "too short"), (4, None), (5, "")], "item_id long, text string")


def found(docs, items, rows):
    return sorted((r["doc_id"], r["item_id"], r["kind"]) for r in D.find(docs(rows), items).collect())


def test_literal_and_other_parameters(docs, items):
    rows = [
        (1, FILLER + ITEM + FILLER), (2, FILLER + ITEM.upper()), (3, FILLER * 50 + OTHER), (4, FILLER), (5, None), (6, ""), (7, "x short, item of SIX words here"), (8, "too short"), (8, "too short"), (9, ITEM.replace(" ", "\n")), (9, ITEM),
        (10, "word " * 40_000 + ITEM), (2**62 + 1, ITEM), (None, FILLER),
    ]
    assert found(docs, items, rows) == [(1, 1, "literal"), (2, 1, "literal"), (3, 1, "template"), (7, 2, "literal"), (8, 3, "literal"), (9, 1, "literal"), (10, 1, "literal"), (2**62 + 1, 1, "literal")]


def test_slots_must_be_consistent(docs, items):
    assert [i for i, _, k in found(docs, items, [(1, OTHER), (2, MIXED)]) if k == "template"] == [1]


def test_each_occurrence_is_settled_alone(docs, items):
    third = OTHER.replace("Carlos", "Nadia").replace("55", "60")
    stray = "after 9 hours it has gone how many km in all"
    rows = [(1, OTHER + "\n" + FILLER * 5 + third), (2, OTHER + "\n" + third), (3, FILLER + stray + ". " + FILLER * 3 + OTHER), (4, MIXED + "\n" + FILLER * 9 + stray), (5, OTHER.replace("it has", "it then has"))]
    assert found(docs, items, rows) == [(1, 1, "template"), (2, 1, "template"), (3, 1, "template"), (5, 1, "template")]


def test_items_of_many_slots_and_few_tokens(spark, docs):
    texts = ["What is 12 + 30 * 4 - 7", "Name four moons", "From 3 to 9 add 4 and 5 then 6 or 7 by 8 in 2 steps of 1", "Add 12, 13, 14, 15, 16, 17, 18 and 19 now"]
    items = spark.createDataFrame(list(enumerate(texts, 1)), "item_id long, text string")
    rows = [
        (1, FILLER + "\nWhat is 9 + 31 * 5 - 8\n" + FILLER), (2, "so what is 9 + 31 * 5 - 8 today"), (3, FILLER + "Name four moons. More."), (4, "please name four moons of it"),
        (5, FILLER + "from 4 to 8 add 5 and 6 then 7 or 9 by 1 in 3 steps of 2 " + FILLER), (6, "x. Add 22, 23, 24, 25, 26, 27, 28 and 29 now."), (7, "1 2 3 4 5 6 7 8 9 10"), (8, "From 3 to 9 add 3 and 9 then 3 or 9 by 3 in 9 steps of 3"),
    ]
    assert [r[:2] for r in found(docs, items, rows)] == [(1, 1), (3, 2), (5, 3), (6, 4)]


def test_shortest_items_are_whole_lines(spark, docs):
    items = spark.createDataFrame([(1, "Photosynthesis"), (2, "ice cream"), (3, "Compute 4 * 5 - 3."), (4, "12"), (5, "Add 2")], "item_id long, text string")
    rows = [
        (1, "a\n photosynthesis. \nb"), (2, "photosynthesis is it"), (3, "Photosynthesis"), (4, "we eat\nIce Cream\n"), (5, "we eat ice cream"), (6, "ice\ncream"), (7, "x y\ncompute 7 * 2 - 9\nz"),
        (8, "Now. Compute 7 * 2 - 9."), (9, "compute 7 * 2 - 9 please"), (10, "12"), (11, "13"), (12, "Add 3"), (13, "\n\n"), (14, "ice\n\ncream\nice. cream"),
    ]
    assert [r[:2] for r in found(docs, items, rows)] == [(1, 1), (3, 1), (4, 2), (7, 3), (10, 4), (14, 2)]


def test_hashes_of_many_lengths():
    ids = np.random.default_rng(0).integers(0, 1 << 63, 500).astype(np.uint64)
    for n in (1, 8, 30):
        at = np.arange(len(ids) - n + 1)
        assert (D._spans(ids, at, at + n) == D._rolling(ids, n)).all()


def test_part_of_an_item(docs, items):
    words = ITEM.split()
    assert found(docs, items, [(1, " ".join(words[:15])), (2, " ".join(words[:9]))]) == [(1, 1, "literal")]


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_documents_go(docs, items, broadcast_rows):
    rows = docs([(1, ITEM), (2, "clean"), (2, "clean"), (None, "clean"), (3, None)])
    out = D.decontaminate(rows, items, broadcast_rows)
    assert out.columns == rows.columns
    assert sorted((str(r["doc_id"]) for r in out.collect())) == ["2", "2", "3", "None"]
    assert D.decontaminate(docs([]), items).isEmpty()
    assert D.decontaminate(rows, items.limit(0)).count() == 5


def test_a_row_goes_for_its_own_text_only(spark, docs, items):
    rows = docs([(None, ITEM), (None, "clean"), (None, None), (7, OTHER), (7, "clean too")])
    out = sorted((str(r["doc_id"]), str(r["text"])) for r in D.decontaminate(rows, items).collect())
    assert out == [("7", "clean too"), ("None", "None"), ("None", "clean")]
    assert {r["doc_id"] for r in D.find(rows, items).collect()} == {None, 7}
    named = spark.createDataFrame([("a", ITEM), ("b", "clean")], "doc_id string, text string")
    assert [(r["doc_id"], r["item_id"]) for r in D.find(named, items).collect()] == [("a", 1)]
    assert [r["doc_id"] for r in D.decontaminate(named, items).collect()] == ["b"]


def test_recall_of_other_parameters(spark, docs):
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("aeioulnrst"), rng.integers(3, 8)))
    frames = [[word() for _ in range(rng.integers(12, 30))] for _ in range(60)]
    kinds = [rng.choice(["w", "n", "N"], len(f), p=[0.75, 0.15, 0.1]) for f in frames]

    def filled(i):
        person = {}
        said = []
        for j, (w, k) in enumerate(zip(frames[i], kinds[i])):
            said.append(w if k == "w" or not j else str(rng.integers(2, 10_000)) if k == "n" else person.setdefault(j % 2, word().title()))
        return " ".join(said) + "."

    items = spark.createDataFrame([(i, filled(i)) for i in range(60)], "item_id long, text string")
    rows = [(i, FILLER * 3 + filled(i) + " " + FILLER * 2 + (filled(i) if i % 2 else "")) for i in range(60)]
    got = {(r["doc_id"], r["item_id"]) for r in D.find(docs(rows), items).collect()}
    assert len(got & {(i, i) for i in range(60)}) >= 54
    assert all(a == b for a, b in got)


def test_query_against_brute_force(spark, tiny):
    plain = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    items = {r["item_id"]: plain(r["text"]) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()}
    grams = {}
    for i, w in items.items():
        for j in range(len(w) - 7):
            grams.setdefault(tuple(w[j : j + 8]), set()).add((i, j))
    want = set()
    for r in spark.read.parquet(f"{tiny}/documents.parquet").collect():
        w, seen = plain(r["text"]), {}
        for j in range(len(w) - 7):
            for i, at in grams.get(tuple(w[j : j + 8]), ()):
                seen.setdefault(i, set()).update(range(at, at + 8))
        want |= {(r["doc_id"], i) for i, s in seen.items() if len(s) >= 13 or 2 * len(s) >= len(items[i])}
    assert {(r["doc_id"], r["item_id"]) for r in op2_decontaminate(spark, tiny).collect()} == want and want
