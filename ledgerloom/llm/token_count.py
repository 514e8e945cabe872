"""Token counts by a map-side lookup in two tiers.

A byte-level BPE never merges across the bounds of pre-tokens (words with the space
before them, numbers, runs of signs), so a text has as many tokens as its pre-tokens
have. Each text is split, its distinct pre-tokens are counted, and their lengths are
looked up:

* tier 1: the lengths of frequent pre-tokens, a table of at most ``FREQUENT`` entries of
  at most ``LONGEST`` signs each, packed and broadcast once. It comes from a sample of
  about ``SAMPLE_ROWS`` documents with at most ``SAMPLE_WORDS`` pre-tokens of each, which
  bounds what the driver gets. The sample only decides what is looked up faster.
* tier 2: each Python worker encodes what it doesn't know, a batch at a time, and keeps
  at most ``HELD`` lengths.

Pre-tokens never leave the task that found them; there is no shuffle.

A text in which a special string stands is split there first, as the library does, and
each such string is one token. The pattern's letters and numbers are those of this
Python's Unicode tables; a text with a code point that these don't assign is counted by
the library as a whole. So is every text where the file isn't a plain byte-level BPE
(another pre-tokenizer, a normalizer, specials that swallow spaces), and by
SentencePiece for a ``.model``.

Defined cases: a null or empty text has no bytes and no tokens; repeated rows each get
their row; null doc_ids stay null; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT = 1024
FREQUENT, LONGEST = 16_384, 64
SAMPLE_ROWS, SAMPLE_WORDS = 2_000, 128
#: Lengths that a worker keeps besides the frequent ones; pre-tokens encoded at once.
HELD, AT_ONCE = 400_000, 50_000

# Fixed value: the pattern by which byte-level BPE vocabularies split text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Splitter:
    """A tokenizer file: how it splits texts, and how many tokens the library makes of pieces or whole texts."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.words = regex.compile(PATTERN).findall
        self.plain, self.specials = False, None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.lengths = lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
            return
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.no_truncation()
        model.no_padding()
        self.lengths = lambda texts: [len(e) for e in model.encode_batch_fast(texts, add_special_tokens=False)]
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        split, added = rules.get("pre_tokenizer") or {}, rules.get("added_tokens") or []
        self.plain = (
            split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not rules.get("normalizer")
            and not any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in added)
        )
        if added:
            self.specials = regex.compile("|".join(regex.escape(a["content"]) for a in sorted(added, key=lambda a: -len(a["content"]))))

    def counted(self, text: str) -> tuple[Counter, int]:
        """Pre-tokens of a text, and how many special strings stand in it."""
        if self.specials is None or not self.specials.search(text):
            return Counter(self.words(text)), 0
        parts, found = self.specials.split(text), Counter()
        for part in parts:
            found.update(self.words(part))
        return found, len(parts) - 1


def _unassigned(word: str) -> bool:
    return not word.isascii() and any(unicodedata.category(c) == "Cn" for c in word)


def packed(lengths: dict[str, int]) -> bytes:
    """A table of lengths as bytes: tokens, size in bytes, then the word, for each entry."""
    out = bytearray()
    for word, n in lengths.items():
        raw = word.encode("utf-8")
        out += bytes((n, len(raw))) + raw
    return bytes(out)


def unpacked(table: bytes) -> dict[str, int]:
    out, at = {}, 0
    while at < len(table):
        end = at + 2 + table[at + 1]
        out[table[at + 2 : end].decode("utf-8")] = table[at]
        at = end
    return out


class Counts:
    """Token counts of batches of texts; knows the frequent lengths and keeps those it had to find."""

    def __init__(self, path: str, frequent: dict[str, int], held: int = HELD) -> None:
        self.split, self.frequent, self.held = Splitter(path), frequent, held
        self.known = dict(frequent)

    def __call__(self, texts: list[str]) -> list[int]:
        if not self.split.plain:
            return self.split.lengths(texts)
        if len(self.known) > len(self.frequent) + self.held:
            self.known = dict(self.frequent)
        out = [0] * len(texts)
        for i, text in enumerate(texts):
            words, out[i] = self.split.counted(text)
            known, other = self.known, {}
            new = [w for w in words if w not in known]
            if new:
                if any(map(_unassigned, new)):
                    out[i] = self.split.lengths([text])[0]
                    continue
                for lo in range(0, len(new), AT_ONCE):
                    part = new[lo : lo + AT_ONCE]
                    found = dict(zip(part, self.split.lengths(part)))
                    known.update({w: n for w, n in found.items() if len(w) <= LONGEST})
                    other.update({w: n for w, n in found.items() if len(w) > LONGEST})
            out[i] += sum([n * (known[w] if w in known else other[w]) for w, n in words.items()])
            if len(known) > len(self.frequent) + 2 * self.held:
                self.known = dict(self.frequent)
        return out


_counts: dict[tuple, Counts] = {}


def _some_words(path: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split = Splitter(path)
        for b in batches:
            words: list[str] = []
            for text in b["text"]:
                all_words = split.words(text)
                words += all_words[:: max(1, -(-len(all_words) // SAMPLE_WORDS))]
            yield pd.DataFrame({"word": [w for w in words if len(w.encode("utf-8")) <= LONGEST]})

    return some


def frequent_lengths(docs: DataFrame, path: str) -> dict[str, int]:
    """Tokens of the pre-tokens that a bounded sample of docs has more than once, most frequent first."""
    split = Splitter(path)
    n = docs.count()
    if not n or not split.plain:
        return {}
    sample = docs.where(F.col("text").isNotNull()).select("text").sample(fraction=min(1.0, SAMPLE_ROWS / n), seed=13)
    words = Counter(r["word"] for r in sample.mapInPandas(_some_words(path), "word string").toLocalIterator())
    chosen = [w for w, k in sorted(words.items(), key=lambda x: (-x[1], x[0]))[:FREQUENT] if k > 1 and not _unassigned(w)]
    return {w: k for w, k in zip(chosen, split.lengths(chosen)) if k < 256} if chosen else {}


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, frequent: dict[str, int] | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of docs; ``path`` is a tokenizer file that all executors have."""
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    table = docs.sparkSession.sparkContext.broadcast(packed(frequent_lengths(docs, path) if frequent is None else frequent))
    key = (path, table.id if hasattr(table, "id") else id(table))

    @F.pandas_udf(T.LongType())
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if key not in _counts:
            _counts.clear()
            _counts[key] = Counts(path, unpacked(table.value))
        for texts in batches:
            yield pd.Series(_counts[key](texts.tolist()), dtype="int64")

    out = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), counted("text").alias("n_tokens"))
    return out.select("*", (F.col("n_tokens") > limit).alias("over_limit"))
