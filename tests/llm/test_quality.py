import zlib

import numpy as np

from ledgerloom.llm import quality as Q
from ledgerloom.llm.queries import op4_quality

GOOD = "The quick story of a town by the sea, told in plain words and short lines. "
BAD = "BUY!! NOW!! CHEAP!! DEALS!! CLICK!! HERE!! "


def test_held_out_accuracy(spark, tiny):
    rows = op4_quality(spark, tiny).join(spark.read.parquet(f"{tiny}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 50 and sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.9
    good, bad = [r["score"] for r in held if r["quality"] == 1], [r["score"] for r in held if r["quality"] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.9


def test_every_row_is_scored(spark, tiny):
    rows = op4_quality(spark, tiny).collect()
    assert len(rows) == spark.read.parquet(f"{tiny}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_encoding_takes_the_whole_text():
    long = GOOD * 500 + BAD * 50
    assert len(Q.encode(long)) == round(len(long) / Q.PASSAGE)
    for text in (None, "", " ", "\n\n", "x", "é" * 1000, "a" * 100_000, "\0\t"):
        got = Q.encode(text)
        assert got.shape[1] == Q.N_FEATURES and len(got) >= 1 and np.isfinite(got).all()
    assert np.array_equal(Q.encode(GOOD * 20), Q.encode(GOOD * 20))


def test_attention_finds_the_telling_passage():
    rng = np.random.default_rng(0)
    words = [f"{a}{b}" for a in "brim lorn tas vel quo".split() for b in "el on ar is ut".split()]
    text = lambda n: " ".join(rng.choice(words, n)) + ". "
    bags, labels = [], []
    for i in range(120):
        bad = i % 2
        bags.append(Q.encode(text(600) + (BAD * 8 if bad else text(60)) + text(300)))
        labels.append(1 - bad)
    model = Q.fit(bags[:80], np.array(labels[:80], float))
    scores = np.array([model.score(b) for b in bags[80:]])
    assert ((scores >= 0.5) == np.array(labels[80:])).mean() > 0.9


def test_few_labels(spark, docs):
    rows = docs([(1, "a"), (2, None), (2, None), (None, "x"), (3, "")])
    labels = lambda given: spark.createDataFrame(given, "doc_id long, quality int, toxic int")
    for given in ([], [(1, 1, 0)], [(1, None, 0), (None, 1, 0)], [(1, 1, 0), (1, 0, 0), (9, 1, 0)], [(1, 1, 0), (2, 0, 0), (2, 0, 0)]):
        out = Q.scored(rows, Q.learn(rows, labels(given)), out="quality_score")
        assert out.columns == [*rows.columns, "quality_score"]
        scores = [r["quality_score"] for r in out.collect()]
        assert len(scores) == 5 and all(0 <= s <= 1 for s in scores)
    assert Q.scored(docs([]), Q.learn(docs([]), labels([]))).isEmpty()


def plain_features(text):
    """Encodes one passage at a time, byte by byte."""
    raw = text.encode()
    n = max(1, round(len(raw) / Q.PASSAGE))
    cuts = [i * len(raw) // n for i in range(n + 1)]
    kinds = [int(Q.CLASS[b]) for b in raw]
    words, at = [], 0
    while at < len(raw):
        end = at
        while end < len(raw) and kinds[end] not in (3, 4):
            end += 1
        if end > at:
            words.append((at, raw[at:end]))
        at = max(end, at + 1)
    out = []
    for lo, hi in zip(cuts, cuts[1:]):
        size = max(hi - lo, 1)
        pair, single = np.zeros((Q.KINDS, Q.KINDS)), np.zeros(Q.KINDS)
        for i in range(lo, hi):
            single[kinds[i]] += 1
            if i:
                pair[kinds[i - 1], kinds[i]] += 1
        own = [(j, w) for j, (a, w) in enumerate(words) if lo <= a < hi]
        per, seen = max(len(own), 1), {}
        for j, (_, w) in enumerate(words):
            seen.setdefault(w, j)
        told = [
            len({w for _, w in own}) / per,
            sum(j > 0 and words[j - 1][1] == w for j, w in own) / per,
            sum(seen[w] != j for j, w in own) / per,
            sum(min(len(w), 40) for _, w in own) / per / 10,
            sum(len(w) > 20 for _, w in own) / per,
            sum(len(w) == 1 for _, w in own) / per,
            np.log1p(len(own)) / 5,
            np.log1p(len(raw)) / 10,
        ]
        out.append(np.r_[np.sqrt(pair.ravel() / size), single / size, told])
    return np.array(out)


def plain_score(model, text):
    """Attends over one passage after the other."""
    w, top, total = model.weights, 0.0, np.zeros(Q.HIDDEN)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for f in plain_features(text):
        h = np.tanh((f - model.mean) / model.scale @ w["P"] + w["p"])
        weight = np.exp(sum(w["w"][j] * np.tanh(h @ w["V"][:, j]) * sigmoid(h @ w["U"][:, j]) for j in range(Q.HIDDEN)))
        top, total = top + weight, total + weight * h
    return sigmoid(total / top @ w["c"] + w["b"][0])


def test_query_against_plain_scores(spark, tiny):
    docs, labels = spark.read.parquet(f"{tiny}/documents.parquet"), spark.read.parquet(f"{tiny}/labels.parquet")
    given = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    model = Q.learn(docs.where("crc32(cast(doc_id as string)) % 4 <> 2"), labels)
    rows = op4_quality(spark, tiny).collect()
    assert len(rows) == len(given)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        if r["doc_id"] % 7 == 0:
            assert abs(r["score"] - plain_score(model, given[r["doc_id"]])) < 1e-3


def test_encoding_is_the_plain_one():
    for text in (GOOD * 9, BAD * 20 + GOOD * 30, " lead  and\n\ntail ", "a a a b a", "é漢 x\ty" * 200, "solid" * 300):
        assert np.allclose(Q.encode(text), plain_features(text), atol=1e-5)


def test_training_goes_down_the_gradient(monkeypatch):
    """The first Adam step moves every weight against the sign of a numerical gradient."""
    rng = np.random.default_rng(3)
    bags = [rng.normal(size=(k, Q.N_FEATURES)).astype(np.float32) for k in (1, 3, 2, 4)]
    labels = np.array([1.0, 0.0, 1.0, 0.0])
    monkeypatch.setattr(Q, "N_FEATURES", bags[0].shape[1])
    start = Q.fit(bags, labels, epochs=0)
    stepped = Q.fit(bags, labels, epochs=1)

    def loss(weights):
        model = Q.Model(start.mean.astype(float), start.scale.astype(float), weights)
        p = np.array([model.score(b) for b in bags])
        decay = sum(0.5e-4 * (x**2).sum() for x in weights.values())
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p)) + decay

    base = {k: x.astype(float) for k, x in start.weights.items()}
    checked = 0
    for name, x in base.items():
        for at in list(np.ndindex(x.shape))[:: max(1, x.size // 12)]:
            up, down = ({k: y.copy() for k, y in base.items()} for _ in range(2))
            up[name][at] += 1e-5
            down[name][at] -= 1e-5
            slope = (loss(up) - loss(down)) / 2e-5
            if abs(slope) > 1e-5:
                moved = float(stepped.weights[name][at]) - x[at]
                assert np.sign(moved) == -np.sign(slope), (name, at, slope, moved)
                checked += 1
    assert checked > 40
