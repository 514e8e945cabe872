import hashlib
import math

import numpy as np
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import pieces as P
from ledgerloom.llm.queries import op9_pieces


def scores(v):
    out = {}

    def walk(node, piece):
        for c, x in node.items():
            if c == "":
                out[piece] = x
            else:
                walk(x, piece + c)

    walk(v.trie, "")
    return out


def brute(v, known, word):
    marked = word.replace(P.MARK, "\0").replace(" ", P.MARK)
    best = [(0.0, [])]
    for e in range(1, len(marked) + 1):
        ways = [(best[i][0] + known[marked[i:e]][0], i, best[i][1] + [known[marked[i:e]][1]]) for i in range(max(0, e - 40), e) if marked[i:e] in known]
        if ways:
            top = max(ways, key=lambda x: (x[0], -x[1]))
            best.append((top[0], top[2]))
        else:
            best.append((best[-1][0] + v.byte_cost, best[-1][1] + [v.byte_id[b] for b in word[e - 1].encode()]))
    return best[-1][1]


def encode(texts):
    values, lengths = P.encode_all(texts, P.load(P.default_model()))
    return [x.tolist() for x in np.split(values, np.cumsum(lengths)[:-1])]


def test_every_word_is_segmented_best(spark, tiny):
    """A vocabulary with probabilities, here made of the ranks, against trying all ways."""
    v = P.Pieces(P.default_model())
    v.ranked = False
    v.fill({p: (-math.log(2.0 - v.rank[p]) - 2.0, i) for i, p in v.piece.items()})
    known = scores(v)
    texts = [r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").limit(60).collect()]
    words = sorted({w for t in [*texts, "a▁b", "漢字x", "\n\n", "\0", "a   b  "] for w in v.words(" " + t)})
    v.learn(words)
    for i, w in enumerate(words):
        assert list(v.ids[v.begin[i] : v.begin[i + 1]]) == brute(v, known, w)


def test_ids_are_the_librarys(spark, tiny):
    sp = sentencepiece.SentencePieceProcessor(model_file=P.default_model())
    texts = [r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").collect() if r["text"] is not None]
    texts += ["a  b", "   lead", " trail   ", "x\n\ny \n \n  z\n", "aaaaaaaa bbbbbbbbbbbbbbb", " " * 100 + "a", "漢字 naïve ½①", "....!!!!====----____", "\0"]
    assert encode(texts) == [sp.encode(t) for t in texts]


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n.-=_'aeinst01é漢"), st.characters(exclude_categories=["Cs"], exclude_characters="▁")), max_size=40))
def test_any_ids_are_the_librarys(text):
    sp = sentencepiece.SentencePieceProcessor(model_file=P.default_model())
    assert encode([text]) == [sp.encode(text)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t▁\0aé漢🙂"), st.characters(exclude_categories=["Cs"])), max_size=30))
def test_round_trip(text):
    v = P.load(P.default_model())
    ids = encode([text])[0]
    assert (v.decode(ids) if ids else "") == text


def test_the_library_decodes_the_same():
    sp = sentencepiece.SentencePieceProcessor(model_file=P.default_model())
    for text in ["Hello world", "naïve café 漢字", "a  b", "x\ny"]:
        assert sp.decode(encode([text])[0]) == text


def test_batches_do_not_matter(monkeypatch):
    texts = ["a b c", None, "", "c d", "the end of the text", "a b c"] * 3
    want = encode(texts)
    monkeypatch.setattr(P, "BATCH", 1)
    monkeypatch.setattr(P, "KEPT", 2)
    assert encode(texts) == want


def test_columns(docs):
    rows = docs([(1, "hi there"), (1, "hi there"), (2, None), (3, ""), (4, "z" * 100_000), (None, "x"), (2**62 + 1, "y")])
    out = P.decode(P.encode(rows))
    got = {r["doc_id"]: r for r in out.collect()}
    assert sorted(out.columns) == sorted([*rows.columns, "decoded"]) and out.count() == 7 and got[2**62 + 1]["decoded"] == "y" and got[None]["decoded"] == "x"
    assert got[2]["ids"] is None and got[2]["decoded"] is None and got[3]["ids"] == [] and got[3]["decoded"] == "" and got[4]["decoded"] == "z" * 100_000
    assert P.encode(docs([])).isEmpty() and P.encode(rows, keep=["doc_id"]).columns == ["doc_id", "ids"]


def test_query_is_lossless(spark, tiny):
    rows = op9_pieces(spark, tiny).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert r["lossless"] and r["n_pieces"] == len(r["ids"]) and r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
