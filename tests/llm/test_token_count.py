"""Token counts against the tokenizer libraries."""

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import token_count as T
from tests.llm.conftest import DOCS

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def library(path, texts):
    if path.endswith(".model"):
        return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts, num_threads=1)]
    return [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def check(docs, path=BYTES, **how):
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    want = [(r["doc_id"], len(r["text"].encode()), n, n > T.LIMIT) for r, n in zip(rows, library(path, [r["text"] for r in rows]))]
    got = [tuple(r) for r in T.token_counts(docs, path, **how).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_whole_table(spark, tiny):
    check(spark.read.parquet(f"{tiny}/documents.parquet"))


ODD = [
    None, "", " ", "  \n\n ", "a <|endoftext|> b<|endoftext|>", "<|endoftext|>", "<|endoftext", "it's we'll 'S can''t", "a b\u0085c​d e\x1cf\x1fg", "x" * 5000, "ab1½²٣ǅ!?…",
    "日本語のテキスト 中文 한국어", "👩‍👩‍👧 é é", "՘a ֋", "꟎ word", "\U000323b0" * 3 + " and words", "\U0010ffff", "\x00\x01 a\tb\r\n c", "word " * 3000,
]


def test_odd_texts(spark, docs):
    check(docs([(i, t) for i, t in enumerate(ODD)] + [(None, "x y"), (1, "a"), (1, "a")]))


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_files_go_through_their_library(spark, docs, file):
    check(docs([(i, t) for i, t in enumerate(ODD)]), public_tokenizers.path(file))


def test_all_code_points_split_as_in_the_library():
    """Every code point beside letters, numbers, signs and spaces, in texts of 64 of them each."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}b1{c}2{c}{c}'s!{c}" for c in points[i : i + 64]) for i in range(0, 0x33500, 64)]
    assert T.Counts(BYTES, {})(texts) == library(BYTES, texts)


def test_tiers(spark, docs, monkeypatch):
    texts = [f"the word w{i} the the end" for i in range(300)]
    table = docs(list(enumerate(texts)))
    lengths = T.frequent_lengths(table, BYTES)
    assert lengths[" the"] == 1 and " w7" not in lengths
    assert T.unpacked(T.packed(lengths)) == lengths
    for frequent in ({}, lengths):  # what is looked up where makes no difference
        check(table, frequent=frequent)
    counts = T.Counts(BYTES, lengths, held=5)
    assert counts(texts) == library(BYTES, texts)
    assert len(counts.known) <= len(lengths) + 20


def test_limit(spark, docs):
    found = {r["doc_id"]: r["over_limit"] for r in T.token_counts(docs([(1, "a a a"), (2, "a a a a")]), BYTES, limit=3).collect()}
    assert found == {1: False, 2: True}


def test_empty_table_and_plan(spark, docs):
    empty = spark.createDataFrame([], DOCS)
    assert T.token_counts(empty, BYTES).collect() == []
    plan = T.token_counts(docs([(1, "a")]), BYTES)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
