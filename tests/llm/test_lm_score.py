import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ledgerloom.llm import attention_lm as A
from ledgerloom.llm import lm_score as S
from ledgerloom.llm.queries import op5_lm_score


def base_scores(texts, held):
    tokens = {d: ["".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split(), None] for d, t in texts.items()}
    tokens = {d: [*w, None] for d, (w, _) in tokens.items()}
    counts = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(counts.values()), len(counts)
    return {d: (len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for d, ws in tokens.items()}


def check(rows, texts, held):
    want = base_scores(texts, held)
    for r in rows:
        n, known, total, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, total, held[r["doc_id"]])
        assert math.isclose(r["base_score"], base, rel_tol=1e-9, abs_tol=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0


def test_query_against_brute_force(spark, tiny):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    rows = op5_lm_score(spark, tiny).collect()
    assert len(rows) == len(texts)
    check(rows, texts, {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in texts})


def test_head_and_tail_agree(docs):
    texts = {i: f"w{i % 7} the the x{i} É é" for i in range(40)} | {100: "the w1 unseen", 101: None, 102: "", 103: "the " * 30_000}
    held = {d: d >= 100 for d in texts}
    rows = docs(list(texts.items()))
    for head in (0, 3, 1000):
        out = S.score_corpus(rows, F.col("doc_id") >= 100, head_words=head).collect()
        assert len(out) == len(texts)
        check(out, texts, held)


def test_gathered_counts(docs):
    texts = ["short text", "", None, "w " * 64, *(f"a{i} " * (37 * i) for i in range(1, 30)), "short text"]
    got = S.gather(docs(list(enumerate(texts))), S.default_ranks()).collect()
    encode, end, _ = S._tokenizer(S.default_ranks())
    counted = {kind: Counter() for kind in (S.WORD, S.SUBWORD, S.TEXT, S.SPAN)}
    for r in got:
        counted[r["kind"]][r["id"]] += r["n"]
    words = [w for t in texts for w in S.words_of(t)]
    assert sum(counted[S.TEXT].values()) == len(texts)
    assert sorted(counted[S.WORD].values()) == sorted(Counter(words).values())
    assert counted[S.SUBWORD] == Counter(i for w in words for i in encode(b" " + w))
    # equal texts have equal spans, and nulls are empty texts
    assert sum(n for n in counted[S.SPAN].values() if n > 1) >= 4


def test_tokens_are_the_plain_words(monkeypatch):
    rng = np.random.default_rng(10)
    signs = [*" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0\0aBÉ\u212aß", " "]
    texts = ["".join(rng.choice(signs, n)) for n in rng.integers(0, 30, 500)] + [None, "", " ", "  a", "a  ", "w" * 5000]
    monkeypatch.setattr(S, "BYTES_AT_ONCE", 1000)
    lexicon = S.Lexicon(S.default_ranks())
    got = []
    for which, at, n in lexicon.read(pa.array(texts)):
        ids, pieces = lexicon.subwords(at)
        want = [x for t in texts[which] for x in [*(lexicon.encode(b" " + w) for w in S.words_of(t)), [lexicon.end]]]
        assert np.split(ids, np.cumsum(pieces)[:-1])[0].tolist() == want[0]
        assert (ids.tolist(), pieces.tolist()) == ([i for x in want for i in x], list(map(len, want)))
        assert n.tolist() == [len(S.words_of(t)) + 1 for t in texts[which]]
        got += range(which.start, which.stop)
    assert got == list(range(len(texts)))
    assert len(np.unique(lexicon.hash)) == len({w for t in texts for w in S.words_of(t)}) + 1


def whole_words(docs, ranks):
    """Gathered counts of docs: of subwords, of units, and the words that are units."""
    got = S.gather(docs, ranks).groupBy("kind", "id").agg(F.sum("n").alias("n"), F.max("spelled").alias("spelled")).toPandas()
    of_kind = lambda kind: got[got["kind"] == kind]
    _, end, spelled = S._tokenizer(ranks)
    subwords = np.zeros(end + 1)
    subwords[of_kind(S.SUBWORD)["id"]] = of_kind(S.SUBWORD)["n"]
    subwords[end] = of_kind(S.TEXT)["n"].sum()
    return subwords, *S.with_whole_words(subwords, spelled, of_kind(S.WORD))


def test_frequent_words_are_single_units(docs, spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").limit(300).collect()] + [None, "x" * 99 + " once", ("y" * 99 + " ") * 5]
    ranks = S.default_ranks()
    subwords, units, spelled, whole = whole_words(docs(list(enumerate(texts))), ranks)
    lexicon = S.Lexicon(ranks, whole)
    counted = np.zeros(len(units))
    for _, at, n_tokens in lexicon.read(pa.array(texts)):
        ids, _ = lexicon.subwords(at)
        counted += np.bincount(ids, minlength=len(units))
    assert np.array_equal(counted, units)
    words = Counter(w for t in texts for w in S.words_of(t))
    for n, word in zip(units[lexicon.end + 1 :], spelled[lexicon.end + 1 :]):
        assert words[word[1:]] == n >= S.WHOLE
    assert units.sum() < 0.85 * subwords.sum()


def test_units_are_all_trained_on(docs, monkeypatch):
    texts = ["short text", "", None, "w " * 64, *(f"a{i} " * (37 * i) for i in range(1, 30))]
    rows, ranks = docs(list(enumerate(texts))), S.default_ranks()
    subwords, units, spelled, whole = whole_words(rows, ranks)
    seen = []
    written = S.written
    monkeypatch.setattr(S, "written", lambda df, name: seen.append(written(df, name)) or seen[-1])
    monkeypatch.setattr(S, "REPLICA", 1000)
    vocabulary = A.Vocabulary.of(units, spelled, np.array([s.startswith(b" ") for s in spelled]))
    S.train(rows, ranks, vocabulary, int(units.sum()), whole)
    assert sum(df.where("at = 0").toPandas()["n"].sum() for df in seen) == units.sum()
    assert sum(len(S.words_of(t)) + 1 for t in texts) <= units.sum() < subwords.sum()


def test_every_subword_is_trained_on(docs, monkeypatch):
    texts = ["short text", "", None, "w " * 64, *(f"a{i} " * (37 * i) for i in range(1, 30))]
    encode, end, spelled = S._tokenizer(S.default_ranks())
    n = [sum(len(encode(b" " + w)) for w in S.words_of(t)) + 1 for t in texts]
    seen = []
    written = S.written
    monkeypatch.setattr(S, "written", lambda df, name: seen.append(written(df, name)) or seen[-1])
    monkeypatch.setattr(S, "REPLICA", 2000)
    monkeypatch.setattr(S, "SEGMENT", 900)
    vocabulary, _ = model(np.arange(1, end + 2))
    S.train(docs(list(enumerate(texts))), S.default_ranks(), vocabulary, sum(n))
    trained = [df.where("at = 0").select("n").toPandas()["n"] for df in seen]
    assert len(trained) == len(S.rounds(sum(n))) > 2
    assert sum(x.sum() for x in trained) == sum(n)
    assert len(trained[-1]) > 1


def test_rounds():
    for total in (0, 1, 2_000_000, 9_000_000, 330_000_000, 10**12):
        plan = S.rounds(total)
        assert sum(n for n, _ in plan) == total
        assert all(n <= replicas * S.REPLICA * S.GROWN for n, replicas in plan)
        assert not plan or plan[0][1] == 1
    assert len(S.rounds(10**12)) < 12


def test_text_that_stands_elsewhere_is_remembered(docs):
    rng = np.random.default_rng(8)
    prose = [" ".join(f"w{x}" for x in rng.integers(0, 200, 120)) for _ in range(60)]
    rows = docs([*enumerate(prose), (100, prose[0]), (101, prose[1] + " " + prose[2]), (200, prose[3])])
    out = {r["doc_id"]: r["score"] / r["n_tokens"] for r in S.score_corpus(rows, F.col("doc_id") == 200).collect()}
    once = [out[i] for i in range(4, 60)]
    for i in (0, 100, 200):
        assert out[i] > max(once) + 0.5
    assert out[101] > max(once) + 0.3
    # a text is nothing that it can remember itself
    assert min(once) > out[0] - 5 and np.std(once) < 0.3


def test_spans_are_cut_by_content():
    rng = np.random.default_rng(9)
    passage = rng.integers(1, 1 << 62, 400)
    texts = [np.r_[rng.integers(1, 1 << 62, n), passage, rng.integers(1, 1 << 62, 50), 0] for n in (0, 1, 77)]
    of, hashes = S.spans(np.concatenate(texts), np.array([len(t) for t in texts]))
    assert len(hashes) == of[-1] + 1 and (np.diff(of) >= 0).all() and (np.diff(of) <= 1).all()
    each = [set(hashes[np.unique(x)].tolist()) for x in np.split(of, np.cumsum([len(t) for t in texts])[:-1])]
    assert len(each[0] & each[1] & each[2]) >= 4
    # order counts
    assert S.spans(np.array([5, 6, 0]), np.array([3]))[1] != S.spans(np.array([6, 5, 0]), np.array([3]))[1]


def test_nothing_to_learn_from(docs):
    out = S.score_corpus(docs([(1, "a b"), (1, "a b"), (None, None)]), F.lit(True)).collect()
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in out) == [(1, 0, 0, 0.0), (3, 0, 0, 0.0), (3, 0, 0, 0.0)]
    assert S.score_corpus(docs([]), F.lit(False)).isEmpty()


def test_replicas_are_averaged(spark, monkeypatch):
    rng = np.random.default_rng(4)
    w = [rng.normal(size=10_000).astype(np.float32) for _ in range(7)]
    n = [int(x) for x in rng.integers(1, 9, 7)]
    rows = [(i, bytearray(x[i * S.PIECE : (i + 1) * S.PIECE].tobytes()), k) for x, k in zip(w, n) for i in range(3)]
    trained = spark.createDataFrame(rows, "at int, w binary, n long")
    for fan in (2, 64):
        monkeypatch.setattr(S, "FAN", fan)
        assert np.allclose(S._mean(trained), np.average(w, axis=0, weights=n), atol=1e-5)
    assert len(S._mean(trained.limit(0))) == 0


def model(counts, seed=0):
    counts = np.array(counts, float)
    vocabulary = A.Vocabulary.of(counts, None, np.arange(len(counts)) % 3 > 0)
    return vocabulary, A.initial(vocabulary.prior, seed)


def log_probabilities(*args):
    return A.log_probabilities(*args)[0]


def plain_hidden(w, before, now):
    """The attention of one block, step by step."""
    split = np.cumsum([A.KEY, A.KEY, A.DIM])
    keys = np.r_[before, now]
    q, _, _, skip = np.split(w["E"][now] @ w["W"], split, axis=1)
    _, k, v, _ = np.split(w["E"][keys] @ w["W"], split, axis=1)
    out = np.zeros((A.BLOCK, A.DIM))
    for i in range(A.BLOCK):
        seen = [j for j in range(A.BLOCK + i + 1) if keys[j]]
        e = np.array([np.exp(q[i] @ k[j] + w["R"][A.BLOCK + i - j]) for j in seen])
        out[i] = skip[i] + w["s"] + (e[:, None] * v[seen]).sum(axis=0) / max(e.sum(), 1e-9) if seen else skip[i] + w["s"]
    return np.maximum(out, 0)


def test_probabilities_sum_to_one():
    vocabulary, w = model(np.random.default_rng(0).integers(0, 50, 700))
    prefix = [5, 9, 600, 5]
    ids = np.array([prefix + [last] for last in range(700)]).ravel()
    logs, begins = (x.reshape(700, 5) for x in A.log_probabilities(w, vocabulary, ids, np.full(700, 5)))
    assert np.allclose(logs[:, :4], logs[0, :4], atol=1e-5)
    assert abs(np.exp(logs[:, 4].astype(float)).sum() - 1) < 1e-3
    begin = np.arange(700) % 3 > 0
    assert abs(np.exp(logs[begin, 4].astype(float)).sum() - np.exp(begins[0, 4])) < 1e-3


def test_each_id_sees_only_what_precedes():
    vocabulary, w = model(np.arange(1, 401))
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 400, 100)
    whole = log_probabilities(w, vocabulary, ids, np.array([100]))
    for cut in (1, 15, 16, 17, 63):
        assert np.allclose(log_probabilities(w, vocabulary, ids[:cut], np.array([cut])), whole[:cut], atol=1e-5)
    other = rng.integers(0, 400, 37)
    both = log_probabilities(w, vocabulary, np.r_[other, ids], np.array([37, 100]))
    assert np.allclose(both[37:], whole, atol=1e-5)


def test_hidden_vectors_step_by_step():
    vocabulary, w = model(np.arange(1, 401))
    w["R"] = np.random.default_rng(5).normal(size=2 * A.BLOCK).astype(np.float32)
    ids = np.random.default_rng(2).integers(0, 400, 90)
    flat, _ = A.blocks(vocabulary.row[ids], np.array([50, 40]))
    slow = np.vstack([plain_hidden(w, flat[i - 1], flat[i]) for i in range(1, len(flat))])
    seen = (flat[1:] != 0).ravel()
    assert np.allclose(slow[seen], A._hidden(A.prepared(w), flat, 1, len(flat))[seen], atol=1e-5)


def test_gradients():
    vocabulary, w = model(np.arange(1, 301))
    ids, lengths = np.random.default_rng(3).integers(0, 300, 400), np.array([250, 150])
    loss = lambda w: -np.mean(log_probabilities(w, vocabulary, ids, lengths).astype(float))
    # with such large sums of squares a step is a small multiple of the gradient
    flat = {k: np.full_like(x, 1e6) for k, x in w.items()}
    after, square = A.train(w, flat, vocabulary, ids, lengths, rate=1.0, batch=1000)
    assert loss(after) < loss(w)
    rng = np.random.default_rng(6)
    for k in w:
        grad = (w[k] - after[k]).astype(float) * 1e3
        for at in {np.unravel_index(i, grad.shape) for i in [np.abs(grad).argmax(), *rng.choice(np.flatnonzero(np.abs(grad) > np.abs(grad).max() / 3), 3)]}:
            up, down = ({n: x.copy() for n, x in w.items()} for _ in range(2))
            up[k][at] += 0.005
            down[k][at] -= 0.005
            assert np.isclose((loss(up) - loss(down)) / 0.01, grad[at], rtol=0.1, atol=1e-4), (k, at)


def test_training_learns_an_order():
    vocabulary, w = model(np.ones(300))
    ids = np.tile(np.arange(60), 200)
    lengths = np.full(100, 120)
    before = log_probabilities(w, vocabulary, ids, lengths).mean()
    square = A.squares(w)
    for _ in range(3):
        w, square = A.train(w, square, vocabulary, ids, lengths, batch=4)
    assert log_probabilities(w, vocabulary, ids, lengths).mean() > before + 1.5
