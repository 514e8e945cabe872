import zlib

import numpy as np

from ledgerloom.llm import language as L
from ledgerloom.llm.queries import op8_language


def test_held_out_accuracy(spark, tiny):
    rows = op8_language(spark, tiny).join(spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 1000 and 250 < len(held) < 420
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_unknown(docs):
    rows = docs([(i, "der die das und ein", "de") for i in range(30)] + [(100 + i, "the and of with was", "en") for i in range(30)])
    model = L.learn(rows)
    odd = docs([(1, None), (2, ""), (3, "123 !?"), (4, "the"), (5, "漢字"), (5, "漢字"), (6, "und der " * 30_000), (None, "was of")])
    out = L.predicted(odd.drop("score"), model)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in out.collect()}
    assert got[1] == got[2] == got[3] == (L.UNKNOWN, 0.0)
    assert got[4][0] == "en" and got[6][0] == "de" and got[None][0] == "en" and got[5][0] in ("de", "en")
    assert out.count() == 8


def test_nothing_to_learn_from(docs):
    none = docs([(1, "text", None), (2, None, "en")])
    assert {r["lang_pred"] for r in L.predicted(docs([(1, "abc")]).drop("score"), L.learn(none)).collect()} == {L.UNKNOWN}
    one = docs([(1, "text", "xx"), (1, "text", "xx")])
    assert {r["lang_pred"] for r in L.predicted(docs([(1, "abc")]).drop("score"), L.learn(one)).collect()} == {"xx"}
    assert L.predicted(docs([]).drop("score"), L.learn(docs([]))).isEmpty()


def test_document_frequencies_cover_all_rows(docs):
    texts = ["abc abc", "abc", "xyz", ""]
    got, n = L.document_frequencies(docs(list(enumerate(texts))))
    assert n == 4 and np.array_equal(got, sum((L.counts(t) > 0).astype(int) for t in texts))


def test_penalties_make_weights_sparse():
    rng = np.random.default_rng(0)
    idf = np.ones(L.FEATURES, np.float32)
    texts = [("the and of " if y == 0 else "der die und ") + "".join(rng.choice(list("abcdefgh "), 60)) for y in rng.integers(0, 2, 300)]
    labels = np.array([0 if t.startswith("the") else 1 for t in texts])
    model = L.fit([L.features(t, idf) for t in texts], labels, ["en", "de"], idf)
    assert (model.weights == 0).mean() > 0.5 and np.isfinite(model.weights).all() and model.temperature > 0
    assert np.mean([model.probabilities(t).argmax() == y for t, y in zip(texts, labels)]) > 0.97


def plain_grams(text):
    """Counts of hashed n-grams, one character at a time."""
    full, out = 1 << 32, {}
    chars = []
    for c in text.lower():
        c = " " if ord(c) <= 64 or 91 <= ord(c) <= 96 or 123 <= ord(c) <= 126 else c
        if not (c == " " and chars and chars[-1] == " "):
            chars.append(c)
    chars = [ord(c) for c in [" ", *chars, " "]]
    for i in range(len(chars)):
        one = chars[i] * 0x9E3779B1 % full
        hashes = [one] if 0 < i < len(chars) - 1 else []
        if i + 1 < len(chars):
            two = ((one ^ 0x85EBCA6B) * 0xC2B2AE35 + chars[i + 1] * 0x27D4EB2F) % full
            hashes.append(two)
            if i + 2 < len(chars):
                hashes.append(((two ^ 0x165667B1) * 0x9E3779B1 + chars[i + 2] * 0x85EBCA77) % full)
        for h in hashes:
            at = ((h ^ (h >> 15)) * 0x2C1B3C6D % full) >> 17
            out[at] = out.get(at, 0) + 1
    return out


def test_counts_are_the_plain_ones():
    for text in ("", "a", "Hello,  World 12", "naïve ÉTÉ 漢字 ßẞ", "  --  x", "ab " * 500):
        got = L.counts(text)
        assert {int(i): int(got[i]) for i in np.flatnonzero(got)} == plain_grams(text)


def test_training_is_the_plain_loop():
    """FTRL-proximal coordinate by coordinate, and the temperature by trying all."""
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abcd "), 12)) + ("xy", "yz", "zx")[i % 3] for i in range(40)]
    labels, names, idf = np.arange(40) % 3, ["u", "v", "w"], np.linspace(1, 2, L.FEATURES).astype(np.float32)
    rows = [L.features(t, idf) for t in texts]
    model = L.fit(rows, labels, names, idf, epochs=2, seed=5)
    z, n = {}, {}

    def weight(key):
        zz, nn = z.get(key, 0.0), n.get(key, 0.0)
        return 0.0 if abs(zz) <= L.L1 else -(zz - np.sign(zz) * L.L1) / ((L.BETA + nn**0.5) / L.ALPHA + L.L2)

    def plain_row(t):
        x = {at: np.log(1 + c) * float(idf[at]) for at, c in plain_grams(t).items()}
        norm = sum(v * v for v in x.values()) ** 0.5
        return {**{at: v / norm for at, v in x.items()}, "bias": 0.1}

    def softmax(x):
        e = [np.exp(v - max(x)) for v in x]
        return [v / sum(e) for v in e]

    given = [plain_row(t) for t in texts]
    train = np.array([i for i in range(40) if i % 10 != 9])
    heavy = [min(10.0, len(train) / 3 / sum(labels[i] == k for i in train)) for k in range(3)]
    order = np.random.default_rng(5)
    for _ in range(2):
        for i in order.permutation(train):
            w = {(at, k): weight((at, k)) for at in given[i] for k in range(3)}
            p = softmax([sum(v * w[at, k] for at, v in given[i].items()) for k in range(3)])
            for (at, k), old in w.items():
                g = given[i][at] * (p[k] - (k == labels[i])) * heavy[labels[i]]
                before = n.get((at, k), 0.0)
                n[at, k] = before + g * g
                z[at, k] = z.get((at, k), 0.0) + g - ((before + g * g) ** 0.5 - before**0.5) / L.ALPHA * old
    for at in {at for x in given for at in x if at != "bias"}:
        assert np.allclose(model.weights[at], [weight((at, k)) for k in range(3)], atol=1e-5)
    assert np.allclose(model.bias, [0.1 * weight(("bias", k)) for k in range(3)], atol=1e-6)
    logits = {i: [sum(v * weight((at, k)) for at, v in given[i].items()) for k in range(3)] for i in range(40)}
    loss = lambda t: -sum(np.log(softmax([x / t for x in logits[i]])[labels[i]] + 1e-12) for i in range(9, 40, 10))
    assert np.isclose(model.temperature, min(np.geomspace(0.05, 20, 60), key=loss))
    for i in range(40):
        assert np.allclose(model.probabilities(texts[i]), softmax([x / model.temperature for x in logits[i]]), atol=1e-4)


def test_query_against_plain_probabilities(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    model = L.learn(docs.where("crc32(cast(doc_id as string)) % 3 <> 1").select("doc_id", "text", "lang"))
    given = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in op8_language(spark, tiny).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        if r["doc_id"] % 9:
            continue
        x = {at: np.log(1 + c) * float(model.idf[at]) for at, c in plain_grams(given[r["doc_id"]]).items()}
        norm = sum(v * v for v in x.values()) ** 0.5
        logits = sum(v / norm * model.weights[at].astype(float) for at, v in x.items()) + model.bias
        e = np.exp((logits - logits.max()) / model.temperature)
        assert model.languages[int(e.argmax())] == r["lang_pred"] and abs(e.max() / e.sum() - r["score"]) < 1e-4
