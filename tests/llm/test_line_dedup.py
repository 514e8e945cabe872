import pytest

import corpus_pipeline as P
from ledgerloom.llm import line_dedup as D
from ledgerloom.llm.queries import OP7_SQL, op7_line_dedup
from tests.test_oracle import same


def test_query_against_sql(spark, tiny):
    same(spark, tiny, op7_line_dedup, OP7_SQL)


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_odd_pages(docs, broadcast_rows):
    pages = [(i, f"menu\n\nown {i}\nmenu\n", None, "a") for i in range(4)] + [(4, None, None, "a"), (5, "", None, "a"), (6, "menu\nx", None, "b"), (None, "menu", None, "a"), (7, "menu", None, None), (8, "tail\n" * 50_000, None, "c")]
    pages += [(9, "same", None, "d")] * 3
    df = docs(pages)
    out = D.drop_boilerplate(df, ratio=0.5, min_pages=3, broadcast_rows=broadcast_rows)
    assert out.columns == df.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.select("doc_id", "text").collect()), key=str)
    want = [(i, f"\nown {i}\n") for i in range(4)] + [(4, None), (5, ""), (6, "menu\nx"), (None, ""), (7, "menu"), (8, "tail\n" * 50_000)] + [(9, "")] * 3
    assert got == sorted(want, key=str)


def test_thresholds_and_empty_table(docs):
    two = docs([(1, "m", None, "a"), (2, "m", None, "a"), (3, "z", None, "a")])
    assert D.boilerplate(two, "source", "text", 0.1, 3).isEmpty()
    assert D.boilerplate(two, "source", "text", 0.7, 2).isEmpty()
    assert D.boilerplate(two, "source", "text", 0.5, 2).count() == 1
    assert D.drop_boilerplate(docs([])).isEmpty()


def test_no_python_in_the_plan(spark, tiny):
    assert "Python" not in op7_line_dedup(spark, tiny)._jdf.queryExecution().executedPlan().toString()


def test_copies_do_not_empty_each_other(spark, tiny, docs):
    copy, other = "a page\nof three\nlines", "another page\nof two"
    rows = [(i, copy, None, "a") for i in range(300)] + [(300 + i, other, None, "a") for i in range(200)] + [(1000 + i, f"menu\nown {i}", None, "a") for i in range(9)]
    given = docs(rows)
    out = P.dedup_lines(spark, given, tiny)
    assert {r["text"] for r in out.collect()} == {copy, other, *(f"own {i}" for i in range(9))}
    left = P.drop_near_duplicates(spark, out, tiny).collect()
    assert sorted((r["doc_id"], r["text"]) for r in left if r["doc_id"] < 1000) == [(0, copy), (300, other)]


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_long_passages_stay_once_on_a_large_host(spark, tiny, docs, broadcast_rows):
    passage = " ".join(f"w{i}" for i in range(50))
    rows = [(i, f"own {i}", None, "a") for i in range(400)]
    rows += [(500, f"x\n{passage}", None, "a"), (500, f"x\n{passage}", None, "a"), (501, f"{passage}\ny", None, "a"), (None, f"n\n{passage}", None, "a"), (502, passage, None, "b")]
    out = D.drop_repeats(docs(rows), broadcast_rows=broadcast_rows)
    want = [(500, f"x\n{passage}"), (500, f"x\n{passage}"), (501, "y"), (None, "n"), (502, passage)]
    got = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect() if not (r["text"] or "").startswith("own")), key=str)
    assert out.columns == docs(rows).columns and got(out) == sorted(want, key=str)
    assert got(P.dedup_lines(spark, docs(rows), tiny)) == sorted(want, key=str)
