import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import components as K
from ledgerloom.llm import simhash as S
from ledgerloom.llm.queries import op10_simhash


def plain_simhash(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    runs = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r, seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps, ids):
    up = list(range(len(fps)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                up[top(i)] = top(j)
    least = {}
    for i in range(len(fps)):
        least[top(i)] = min(least.get(top(i), ids[i]), ids[i])
    return [least[top(i)] for i in range(len(fps))]


def test_query_against_brute_force(spark, tiny):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    rows = op10_simhash(spark, tiny).collect()
    assert len(rows) == len(texts)
    fps = [plain_simhash(texts[r["doc_id"]]) for r in rows]
    assert [r["fingerprint"] for r in rows] == [f"{x:016x}" for x in fps]
    assert [r["component_id"] for r in rows] == groups(fps, [r["doc_id"] for r in rows])


@pytest.mark.parametrize("chunk", [3, 20, 4096])
def test_links_connect_as_all_pairs_do(spark, chunk):
    rng = random.Random(5)
    fps = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(25):
            fps.add(x)
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
    fps = sorted(fps)
    nodes = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(fps)], "node long, fp long")
    got = {r["node"]: r["component"] for r in K.components(S.links(nodes, chunk)).collect()}
    assert [got.get(i, i) for i in range(len(fps))] == groups(fps, list(range(len(fps))))


def test_odd_rows(docs):
    long = " ".join(f"w{i % 977}" for i in range(80_000))
    rows = [(3, None), (1, ""), (2, " \t\n"), (5, "one"), (6, "ONE"), (8, long), (7, long), (7, long), (None, "solo words here now"), (None, None), (9, "É x y"), (10, "é x y")]
    got = sorted(((r["doc_id"], r["component_id"]) for r in S.near_duplicates(docs(rows)).select("doc_id", "component_id").collect()), key=str)
    assert got == sorted([(3, 1), (1, 1), (2, 1), (5, 5), (6, 5), (8, 7), (7, 7), (7, 7), (None, None), (None, 1), (9, 9), (10, 10)], key=str)
    assert S.near_duplicates(docs([])).isEmpty()


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_one_of_each(docs, broadcast_rows):
    rows = docs([(4, "a b c"), (2, "a b c"), (2, "A b c"), (7, "d e f"), (7, "d e f"), (None, "d e f"), (None, "g h i"), (None, "g h i"), (9, None)])
    out = S.one_of_each(rows, broadcast_rows=broadcast_rows)
    assert out.columns == rows.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.select("doc_id", "text").collect()), key=str)
    assert [g for g in got if g[0] != 2] == sorted([(7, "d e f"), (None, "g h i"), (9, None)], key=str)
    assert len([g for g in got if g[0] == 2]) == 1
    assert S.one_of_each(docs([])).isEmpty()


def test_long_chain(spark):
    chain = spark.range(60).select((F.col("id") * 7 % 61).alias("a"), ((F.col("id") + 1) * 7 % 61).alias("b"))
    got = K.components(chain.union(chain).union(spark.createDataFrame([(100, 100), (None, 3)], "a long, b long"))).collect()
    assert {r["component"] for r in got} == {0} and len(got) == 61
    assert K.components(chain.limit(0)).isEmpty()


def test_pivots_never_lose_a_link():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**64, 200, dtype=np.uint64)
    y = x ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64))
    table = lambda v: np.bitwise_count(v[:, None] ^ S.PIVOTS).astype(int)
    assert np.abs(table(x) - table(y)).max() <= S.RADIUS


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def near_groups(texts):
    """Smallest index of each text's group by all pairs, and the number of pairs of different texts that are alike."""
    sets, up, n = [shingles(t) for t in texts], list(range(len(texts))), 0

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                n += texts[i] != texts[j]
                up[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(texts))], n


@pytest.mark.parametrize("chunk", [8, 4096])
def test_near_copies_as_all_pairs_have_them(docs, chunk):
    rng = random.Random(3)
    texts = []
    for i in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([6, 40, 150, 700]))]
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 5)):
            for _ in range(rng.randint(0, max(1, len(words) // 60))):
                words[rng.randrange(len(words))] = f"v{rng.randrange(3000)}"
            texts.append(" ".join(words))
    texts += ["", None, " \n", "Solo", "solo"]
    want, n = near_groups(texts)
    kept = {r["doc_id"] for r in S.one_of_each(docs(list(enumerate(texts))), chunk).collect()}
    lost, extra = set(want) - kept, kept - set(want)
    assert n > 100 and not lost and len(extra) <= 0.05 * (len(texts) - len(set(want)))


def test_documents_near_copies(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id")
    rows = docs.select("doc_id", "text").collect()
    want, _ = near_groups([r["text"] for r in rows])
    kept = {r["doc_id"] for r in S.one_of_each(docs).select("doc_id").collect()}
    assert kept == {rows[i]["doc_id"] for i in set(want)}


@pytest.mark.parametrize("chunk", [16, 4096])
def test_groups_that_resemble_each_other(docs, chunk):
    """Pairs of near copies that are all variants of one text, and alike across pairs by less than 0.8."""
    rng = random.Random(3)
    start = [f"w{rng.randrange(3000)}" for _ in range(300)]
    texts = []
    for _ in range(150):
        words = list(start)
        for place in rng.sample(range(300), 8):
            words[place] = f"v{rng.randrange(3000)}"
        texts.append(" ".join(words))
        words[rng.randrange(300)] = "another"
        texts.append(" ".join(words))
    want, n = near_groups(texts)
    kept = {r["doc_id"] for r in S.one_of_each(docs(list(enumerate(texts))), chunk).collect()}
    assert n >= 150 and 100 <= len(set(want)) and not set(want) - kept
    assert len(kept) <= 1.05 * len(set(want))
