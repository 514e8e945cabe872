"""The manifest against a plain one of the same rules."""

from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import merkle, ranks
from tests.llm.conftest import DOCS

FIELDS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def digest(text):
    return sha256(text.encode()).hexdigest()


def leaf_of(row, lower=False):
    out = ""
    for c in merkle.COLUMNS:
        value = row[c]
        if c == "text" and lower and value is not None:
            value = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in value)
        out += "-" if value is None else f"{len(str(value).encode())}:{value}"
    return digest(out)


def levels(nodes):
    """All levels of a tree, the lowest first."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def path(tree, place):
    """(hashes before, hashes after) of a node's family on each level."""
    out = []
    for level in tree[:-1]:
        first = place - place % 16
        out.append(("".join(level[first:place]), "".join(level[place + 1 : first + 16])))
        place //= 16
    return out


def plain(rows):
    rows = [dict(r.asDict(), leaf=leaf_of(r.asDict())) for r in rows]
    names = sorted({r["source"] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    of = {s: sorted((r for r in rows if r["source"] == s), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["leaf"])) for s in names}
    trees = {s: levels([r["leaf"] for r in of[s]]) for s in names}
    top = levels([trees[s][-1][0] for s in names]) if names else []
    out = []
    for k, s in enumerate(names):
        for place, r in enumerate(of[s]):
            steps = path(trees[s], place) + path(top, k)
            now = leaf_of(r, lower=True) if r["doc_id"] is not None and crc32(str(r["doc_id"]).encode()) % 5 == 0 else r["leaf"]
            for before, after in steps:
                now = digest(before + now + after)
            root = top[-1][0]
            out.append((r["doc_id"], r["leaf"], trees[s][-1][0], root, digest("".join(a + b for a, b in steps)), now, now == root))
    return out


def check(docs):
    bad = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    got = [tuple(r[c] for c in FIELDS) for r in merkle.manifest(docs, bad).collect()]
    want = plain(docs.select(*merkle.COLUMNS).collect())
    assert sorted(got, key=str) == sorted(want, key=str)
    return got


def test_whole_table(spark, tiny):
    got = check(spark.read.parquet(f"{tiny}/documents.parquet"))
    assert 0 < sum(not r[-1] for r in got) < len(got)


def test_sizes_of_a_source(spark, docs):
    check(docs([(1000 * n + i, f"Text {i}", "en", f"s{n}") for n in (1, 2, 15, 16, 17, 255, 256, 257, 273) for i in range(n)]))


def test_one_source(spark, docs):
    check(docs([(i, f"Text {i}", "en", None) for i in range(20)]))


def test_nulls_ties_and_repeated_rows(spark, docs):
    rows = [(1, "A", None, None), (1, "A", None, None), (1, "B", None, None), (None, "Ab", "en", None), (5, None, "en", "x"), (7, "", "", ""), (8, "ÀÉ ẞ İ K", "de", "x"), (8, "a" * 200_000, "de", "é")]
    check(docs(rows))


def test_many_sources_and_a_hot_one(spark, docs):
    rows = [(i, f"T{i}", "en", f"s{i}") for i in range(300)] + [(1000 + i, "SAME", "en", "hot") for i in range(150)] + [(5, "SAME", "en", "hot")] * 150
    check(docs(rows))


def test_ranges_cut_sources(spark, docs, monkeypatch):
    """Leaf partitions that begin and end inside families, on several levels."""
    monkeypatch.setattr(ranks, "ranges_of", lambda df, rows=None: 23)
    check(docs([(i, f"T{i}", "en", "ab"[i % 2] if i % 50 else None) for i in range(700)]))


def test_large_tables_are_joined_by_shuffles(spark, docs, monkeypatch):
    monkeypatch.setattr(merkle, "small", lambda df: df)
    check(docs([(i, f"T{i}", "en", "ab"[i % 2]) for i in range(100)]))


def test_empty_table(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).collect() == []


@pytest.mark.parametrize("lo,hi,total", [(0, 1, 1), (0, 5, 5), (3, 40, 300), (255, 257, 5000), (0, 5000, 5000), (4999, 5000, 5000), (16, 32, 4096)])
def test_only_what_the_leaves_lack_is_asked_for(lo, hi, total):
    need, known, n, level, places = set(), set(range(lo, hi)), total, 0, set(range(lo, hi))
    while n > 1:
        families = {p // 16 for p in places}
        need |= {(level, i) for f in families for i in range(16 * f, min(16 * f + 16, n)) if i not in places}
        places, n, level = families, -(-n // 16), level + 1
    assert set(merkle.missing(lo, hi, total)) == need
    assert known
