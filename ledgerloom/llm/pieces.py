"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text, with one space put before it, is cut into marked words: each begins with its
run of spaces, written as markers U+2581. A line break that no piece holds is a word
of its own, as nothing joins it to its neighbours. Of each batch of texts the distinct words
are sorted, which lays them out as a trie in depth-first order; the Viterbi forward
scores of a prefix shared with the word before are kept, and only the new tail is
scored, by walking the vocabulary's own trie from each open start.

In a unigram model a piece scores its log probability, and equal scores prefer the
longer last piece. A model with merge ranks has no probabilities: there all pieces
score alike, and a piece after another that merging by rank would not leave next to
it scores minus infinity. Merging a text leaves two neighbours alone exactly if it
does so in the two by themselves, so one path to each prefix has a finite score, and
its ids are those of merging in rank order, the SentencePiece library's own.

Characters without a piece become byte pieces, and so does a literal U+2581 (which
the library would turn into a space), so decoding returns every text exactly.

Defined cases: null text has null ids; an empty text has none. Repeated rows get
rows of their own. Extra columns pass through; a given column ``ids`` is replaced.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
#: Distinct words that texts are gathered up to before they are encoded together.
BATCH = 60_000
#: Words whose ids a worker keeps for later batches before it forgets them all.
KEPT = 200_000
#: Pairs of pieces that a worker remembers the merging of before it forgets them all.
PAIRS = 400_000
#: Texts that are encoded and passed on at once.
TEXTS_AT_ONCE = 1000
LOST = -1e18


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The vocabulary: pieces with scores and ids, and the byte pieces."""

    def __init__(self, model: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        size = sp.get_piece_size()
        self.text: list[bytes] = [b""] * size
        scores = {}
        self.ranked = all(sp.get_score(i) <= 0 and float(sp.get_score(i)).is_integer() for i in range(size))
        self.byte_id = [0] * 256
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.text[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                scores[piece] = (sp.get_score(i), i)
                self.text[i] = piece.replace(MARK, " ").encode()
        self.fill(scores)

    def fill(self, scores: dict[str, tuple[float, int]]) -> None:
        """Takes pieces with their (score, id)."""
        self.trie: dict = {}
        self.rank = {piece: s for piece, (s, _) in scores.items()}
        self.piece = {i: piece for piece, (_, i) in scores.items()}
        self.words = re.compile(" +[^ ]*" if any("\n" in piece for piece in scores) else " +[^ \n]*|\n|[^ \n]+").findall
        for piece, (s, i) in scores.items():
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = (0.0 if self.ranked else s, i)
        self.pairs: dict[int, bool] = {}
        #: A character spelled in bytes costs more than any two pieces.
        self.byte_cost = 0.0 if self.ranked else 3 * min(self.rank.values(), default=-20.0)
        self.forget()

    def apart(self, before: int, ident: int) -> bool:
        """Whether merging by rank leaves the two pieces next to each other (before -1: the second alone)."""
        if not self.ranked:
            return True
        rank = self.rank.get
        left = self.piece.get(before, "")
        parts, left = list(left + self.piece[ident]), len(left)
        ranks = [rank(a + b, LOST) for a, b in zip(parts, parts[1:])]
        # merges the best pair, the first of equal ones, until none is left or one spans the two pieces
        while ranks and (best := max(ranks)) != LOST:
            at = ranks.index(best)
            if at == left - 1:
                return False
            left -= at < left
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            ranks[at : at + 1] = []
            if at:
                ranks[at - 1] = rank(parts[at - 1] + parts[at], LOST)
            if at < len(ranks):
                ranks[at] = rank(parts[at] + parts[at + 1], LOST)
        return len(parts) == 1 + (before >= 0)

    def forget(self) -> None:
        """Drops the words encoded so far: rows, and per row where its ids begin."""
        self.rows: dict[str, int] = {}
        self.ids, self.begin = array("i"), array("q", [0])

    def learn(self, words: Iterable[str]) -> None:
        """Encodes sorted distinct words, each with its spaces before it, that have no row yet."""
        ids, begin, rows = self.ids, self.begin, self.rows
        root, byte_id, byte_cost = self.trie, self.byte_id, self.byte_cost
        pairs, apart = self.pairs, self.apart
        score, start, piece, opened = [0.0], [0], [-1], [[]]
        last = ""
        for word in words:
            # a literal marker becomes NUL: neither has a piece, so it is spelled in bytes
            marked = word.replace(MARK, "\0").replace(" ", MARK)
            if len(pairs) > PAIRS:
                pairs.clear()
            n = min(len(last), len(marked))
            same = 0
            while same < n and last[same] == marked[same]:
                same += 1
            del score[same + 1 :], start[same + 1 :], piece[same + 1 :], opened[same + 1 :]
            for at in range(same, len(marked)):
                c = marked[at]
                best, first, ident, still = LOST, at, -1, []
                for i, node in (*opened[at], (at, root)):
                    node = node.get(c)
                    if node is not None:
                        found = node.get("")
                        if found is None or len(node) > 1:
                            still.append((i, node))
                        if found is not None and score[i] + found[0] > best:
                            pair = piece[i] << 32 | found[1]
                            fits = pairs.get(pair)
                            if fits is None:
                                fits = pairs[pair] = apart(piece[i], found[1])
                            if fits:
                                best, first, ident = score[i] + found[0], i, found[1]
                if ident < 0:
                    best = score[at] + byte_cost
                score.append(best)
                start.append(first)
                piece.append(ident)
                opened.append(still)
            own: list[int] = []
            end = len(marked)
            while end:
                if piece[end] >= 0:
                    own.append(piece[end])
                else:
                    own += [byte_id[b] for b in reversed(word[end - 1].encode("utf-8", "surrogatepass"))]
                end = start[end]
            ids.extend(reversed(own))
            begin.append(len(ids))
            rows[word] = len(rows)
            last = marked

    def decode(self, ids: Iterable[int]) -> str:
        text = self.text
        return b"".join([text[i] for i in ids]).decode("utf-8", "surrogatepass")[1:]


@lru_cache(maxsize=2)
def load(model: str) -> Pieces:
    return Pieces(model)


def encode_all(texts: list[str | None], pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """All ids laid end to end, and the number of each text's (0 for null)."""
    out, lengths = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64)
    lo = 0
    while lo < len(texts):
        seen: set[str] = set()
        cuts, hi = [], lo
        while hi < len(texts) and (hi == lo or len(seen) < BATCH):
            cuts.append(pieces.words(" " + texts[hi]) if texts[hi] else [])
            seen.update(cuts[-1])
            hi += 1
        if len(pieces.rows) > KEPT:
            pieces.forget()
        pieces.learn(sorted(seen.difference(pieces.rows)))
        row, ids, begin = pieces.rows, np.array(pieces.ids, np.int32), np.array(pieces.begin, np.int64)
        for i, cut in enumerate(cuts, lo):
            at = np.fromiter(map(row.__getitem__, cut), np.int64, len(cut))
            n = begin[at + 1] - begin[at]
            lengths[i] = n.sum()
            out.append(ids[np.repeat(begin[at] - (np.cumsum(n) - n), n) + np.arange(lengths[i])])
        lo = hi
    return np.concatenate(out), lengths


def _lists(values: np.ndarray, lengths: np.ndarray, null: np.ndarray) -> pa.Array:
    offsets = np.r_[0, np.cumsum(lengths)].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, mask=np.r_[null, False]), pa.array(values))


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", model: str | None = None, keep: list[str] | None = None, check: bool = False) -> DataFrame:
    """The columns ``keep`` (all, if not given) and ``ids``. Texts never leave their partition.

    ``check`` decodes the ids at once and adds decoded_sha256 and lossless.
    """
    path = model or default_model()
    columns = [c for c in (docs.columns if keep is None else keep) if c != ids]
    fields = [docs.schema[c] for c in columns] + [T.StructField(ids, T.ArrayType(T.IntegerType()))]
    if check:
        fields += [T.StructField("decoded_sha256", T.StringType()), T.StructField("lossless", T.BooleanType())]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path)
        for whole in batches:
            for lo in range(0, whole.num_rows, TEXTS_AT_ONCE):
                batch = whole.slice(lo, TEXTS_AT_ONCE)
                texts = batch.column(text).to_pylist()
                values, lengths = encode_all(texts, pieces)
                null = np.array([t is None for t in texts], bool)
                out = [batch.column(c) for c in columns] + [_lists(values, lengths, null)]
                if check:
                    back = [None if t is None else pieces.decode(v.tolist()) for t, v in zip(texts, np.split(values, np.cumsum(lengths)[:-1]))]
                    out += [pa.array([None if t is None else sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in back], pa.string()), pa.array([a == b for a, b in zip(texts, back)])]
                yield pa.RecordBatch.from_arrays(out, [f.name for f in fields])

    return docs.select(*{*columns, text}).mapInArrow(encoded, T.StructType(fields))


def decode(docs: DataFrame, ids: str = "ids", text: str = "decoded", model: str | None = None) -> DataFrame:
    """Adds the column ``text`` from ids."""
    path = model or default_model()

    @F.pandas_udf(T.StringType())
    def decoded(rows: pd.Series) -> pd.Series:
        pieces = load(path)
        return pd.Series([None if r is None else pieces.decode(r.tolist()) for r in rows], dtype=object)

    return docs.withColumn(text, decoded(F.col(ids)))
