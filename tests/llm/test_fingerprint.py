import hashlib

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import fingerprint as P
from ledgerloom.llm.queries import op6_fingerprint


def edited(texts):
    """texts by doc_id -> edited text by doc_id."""
    ids = sorted(texts, reverse=True)
    out = {}
    for i, d in enumerate(ids):
        text, after = texts[d], texts[ids[(i + 1) % len(ids)]]
        cut = len(text) // 3
        out[d] = text[: len(text) - cut] + after[:cut]
    return out


def jaccard(a, b):
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_query_against_brute_force(spark, tiny):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    want, ids = edited(texts), sorted(texts, reverse=True)
    after = {d: ids[(i + 1) % len(ids)] for i, d in enumerate(ids)}
    rows = op6_fingerprint(spark, tiny).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    fp = {r["doc_id"]: r["fingerprint"] for r in rows}
    errors = []
    for r in rows:
        d = r["doc_id"]
        assert r["n_chars"] == len(texts[d]) and r["edited_sha256"] == hashlib.sha256(want[d].encode()).hexdigest()
        errors += [abs(r["near_edited"] - jaccard(texts[d], want[d])), abs(r["near_next"] - jaccard(texts[d], texts[after[d]]))]
    by_text = {}
    for d, t in texts.items():
        assert by_text.setdefault(t, fp[d]) == fp[d]
    assert sum(errors) / len(errors) < 0.03 and sorted(errors)[int(0.99 * len(errors))] < 0.15


@pytest.mark.parametrize("buckets", [1, 3, 50])
def test_next_document(docs, buckets):
    rows = docs([(5, "e"), (3, "c"), (9, "i"), (3, "c"), (3, "b"), (None, "n"), (1, None), (-4, "m")])
    out = P.with_next(rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), ["text"], buckets)
    got = sorted(((r["doc_id"], r["text"], r["next_text"]) for r in out.collect()), key=str)
    assert got == sorted([(9, "i", "e"), (5, "e", "b"), (3, "b", "c"), (3, "c", "c"), (3, "c", ""), (1, "", "m"), (-4, "m", "i"), (None, "n", None)], key=str)


def test_odd_texts(docs):
    texts = [None, "", "one", "a b c d e", "word " * 40_000, "a b c d e"]
    rows = {r["doc_id"]: r for r in P.compare_edited(docs(list(enumerate(texts)))).collect()}
    assert rows[0]["fingerprint"] == rows[1]["fingerprint"] == "" and rows[3]["fingerprint"] == rows[5]["fingerprint"] and len(rows[2]["fingerprint"]) == 512
    assert rows[1]["near_next"] == 1.0 and rows[2]["near_next"] == 0.0
    assert all(0 <= r[c] <= 1 for r in rows.values() for c in ("near_edited", "near_next"))
    alone = P.compare_edited(docs([(1, "abcdef")])).first()
    assert alone["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and alone["near_next"] == 1.0
    assert P.compare_edited(docs([])).collect() == []
    assert P.compare_edited(docs([(None, "abc")])).first()["near_next"] == 0.0


def test_likeness_is_unbiased(docs):
    words = [f"w{i}" for i in range(900)]
    a, b = " ".join(words), " ".join(words[:600] + [f"x{i}" for i in range(300)])
    rows = P.with_bins(docs([(1, a), (2, b)]).select("doc_id", "text"), "text", "bins").select("doc_id", "bins")
    x, y = rows.where("doc_id = 1").select(F.col("bins").alias("x")), rows.where("doc_id = 2").select(F.col("bins").alias("y"))
    got = x.crossJoin(y).select(P.likeness(F.col("x"), F.col("y"))).first()[0]
    assert abs(got - jaccard(a, b)) < 0.1


def test_no_python_in_the_plan(spark, tiny):
    assert "Python" not in op6_fingerprint(spark, tiny)._jdf.queryExecution().executedPlan().toString()
