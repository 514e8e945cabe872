"""Language-model scoring of whole texts.

Three passes over the corpus, none of which keeps more than one batch of texts:

1. ``gather``: over every document that may be learned from, counts of all words,
   subwords and spans. A span ends where the hash of two neighbouring words says so,
   about every 32 words, so equal passages are cut alike wherever they stand.
2. ``train``: the attention model is trained once on every unit of these
   documents, in rounds. A frequent word is one unit, a rare word is its subwords. Each round deals a hash range of documents to replicas that
   go on from the mean of the round before; a first small round gives all replicas
   a common start, and later rounds have more and larger replicas.
3. ``score``: overlapping windows score each unit once, and so each word.

A frequent word spelled in subwords would be another sequence of units, which no text
has; what little probability the model gives it is lost, so no word gets too much.

A word's probability mixes the model's with the corpus share of the word, and a
span's mixes the product of its words' with the span's share of all spans. For the
latter a document's own spans are left out, so only text that stands elsewhere too is
remembered. The counts of the most frequent words, at most ``HEAD`` of them whatever
the corpus, are broadcast; a text's other words, and its spans, are joined by hash.

Tokens are runs of non-space bytes after lower-casing A-Z, then one end.

Defined cases: null text counts as empty (one token, the end). Repeated rows get
rows of their own, and each is text that stands elsewhere to the other. With nothing
to learn from, counts are zero and every base score is 0. Words are told apart by
64-bit hash. Extra columns are ignored. Which replica a document goes to depends on
its id and text (on its place only where the id is null).
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import attention_lm as lm
from .shared import written

HEAD = 200_000
#: Units that a replica of the first round trains on, about; how many times as large later ones get; replicas of a round to one before.
REPLICA, GROWN, WIDER = 2_000_000, 4, 4
#: Pieces of each step of training by round; the last also of later ones.
STEPS = (16, 32, 48)
#: Units that a task holds to train on.
SEGMENT = 2_000_000
#: Weights are averaged in pieces of so many numbers, and of so many replicas at once.
PIECE, FAN = 4096, 16
#: Distinct words held by one worker before they are flushed and forgotten.
HELD = 1_500_000
BYTES_AT_ONCE = 3_000_000
#: Times that a word of the head must occur to be a unit of its own; rarer ones teach how words are spelled.
WHOLE = 4
SMOOTH = 0.1
#: Parts of the corpus share of words, and of spans, in the mixtures.
COUNTED, REMEMBERED = 0.3, 0.02

WORD, SUBWORD, TEXT, SPAN = range(4)


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def _tokenizer(ranks: str):
    """A function from bytes to ids, the id of the end, and each id's bytes."""
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    end = max(table.values()) + 1
    spelled = {i: b for b, i in table.items()}
    return tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=table, special_tokens={})._core_bpe.encode_single_piece, end, [spelled.get(i, b" ") for i in range(end + 1)]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


#: A number for each byte and, by place in the word, a factor; both fixed.
_BYTES = np.random.default_rng(1).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of strings that are not empty: sums over their bytes by place, then mixed."""
    if not len(words):
        return np.zeros(0, np.int64)
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    first, n = ends[:-1] - ends[0], np.diff(ends)
    with np.errstate(over="ignore"):
        factors = np.cumprod(np.full(int(n.max()), _FACTOR))
        h = np.add.reduceat(_BYTES[data] * factors[np.arange(len(data)) - np.repeat(first, n)], first)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
        return (h ^ (h >> np.uint64(31))).view(np.int64)


class Lexicon:
    """Rows of words with each row's hash and unit ids; row 0 is the end. Only a cache.

    Units are subwords, then the end, then the words whose hashes ``whole`` lists.
    """

    def __init__(self, ranks: str, whole: bytes = b"") -> None:
        self.encode, self.end, _ = _tokenizer(ranks)
        hashes = np.frombuffer(whole, np.int64)
        order = np.argsort(hashes)
        self.whole, self.unit = hashes[order], order + self.end + 1
        self.forget()

    def forget(self) -> None:
        self.hash, self.begin, self.ids = np.zeros(1, np.int64), np.array([0, 1]), np.array([self.end], np.int32)
        self.known, self.row = np.zeros(0, np.int64), np.zeros(0, np.int64)  # hashes in order, and their rows

    def __len__(self) -> int:
        return len(self.hash)

    def rows(self, words: pa.Array) -> np.ndarray:
        """Rows of distinct words; new ones get a row."""
        hashes = word_hashes(words)
        order = np.argsort(hashes)
        hashes = hashes[order]
        place, found = _places(self.known, hashes)
        new = np.flatnonzero(~found)
        if len(new):
            unit, one = _places(self.whole, hashes[new])
            ids = [self.encode(b" " + w) for w in words.take(pa.array(order[new[~one]])).cast(pa.binary()).to_pylist()]
            n = np.ones(len(new), np.int64)
            n[~one] = np.fromiter(map(len, ids), np.int64, len(ids))
            more = np.empty(int(n.sum()), np.int32)
            single = np.repeat(one, n)
            more[single], more[~single] = self.unit[unit[one]], np.fromiter(chain.from_iterable(ids), np.int32)
            row = np.r_[self.row, len(self) + np.arange(len(new))]
            self.hash, self.begin, self.ids = np.r_[self.hash, hashes[new]], np.r_[self.begin, self.begin[-1] + np.cumsum(n)], np.r_[self.ids, more]
            known = np.r_[self.known, hashes[new]]
            merged = np.argsort(known, kind="stable")  # two ordered runs
            self.known, self.row = known[merged], row[merged]
            place = np.searchsorted(self.known, hashes)
        out = np.empty(len(order), np.int64)
        out[order] = self.row[place]
        return out

    def read(self, texts: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """(which texts, their tokens' rows laid end to end, tokens of each), not too many bytes at once."""
        texts = texts.cast(pa.string()).fill_null("")
        size, lo = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)), 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + BYTES_AT_ONCE, "right")))
            lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(lo, hi - lo)))
            words, of = lists.flatten(), np.repeat(np.arange(hi - lo), pc.list_value_length(lists).to_numpy())
            some = pc.binary_length(words).to_numpy() > 0  # space at either end of a text leaves an empty word
            words, of = words.filter(pa.array(some)).dictionary_encode(), of[some]
            at = np.zeros(len(of) + hi - lo, np.int64)
            at[np.arange(len(of)) + of] = self.rows(words.dictionary)[words.indices.to_numpy()]
            yield slice(lo, hi), at, np.bincount(of, minlength=hi - lo) + 1
            lo = hi

    def subwords(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit ids of tokens laid end to end, and how many of each."""
        first = self.begin[at]
        n = self.begin[at + 1] - first
        return self.ids[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], n

    def spelled(self, rows: np.ndarray) -> np.ndarray:
        """The subwords of each row in one number, 0 where they are too many for that."""
        bits = (self.end + 1).bit_length()
        first, n = self.begin[rows], self.begin[rows + 1] - self.begin[rows]
        out = np.zeros(len(rows), np.uint64)
        for i in range(64 // bits):
            more = n > i
            out[more] |= (self.ids[first[more] + i] + 1).astype(np.uint64) << np.uint64(bits * i)
        out[n > 64 // bits] = 0
        return out.view(np.int64)


def _places(ordered: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of wanted stands in ordered, and whether it does."""
    if not len(ordered):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    place = np.minimum(np.searchsorted(ordered, wanted), len(ordered) - 1)
    return place, ordered[place] == wanted


@lru_cache(maxsize=1)
def _lexicon(ranks: str, whole: bytes = b"") -> Lexicon:
    """One cache for each Python worker, which serves many tasks."""
    return Lexicon(ranks, whole)


def spans(hashes: np.ndarray, n_tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of tokens laid end to end: each one's span, and the spans' hashes. A text's end closes a span."""
    h = hashes.view(np.uint64)
    with np.errstate(over="ignore"):
        before = np.r_[np.uint64(0), h[:-1]] * np.uint64(0x9E3779B97F4A7C15)
        cut = ((before ^ h) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(59) == 0
        cut[np.cumsum(n_tokens) - 1] = True
        of = np.cumsum(cut) - cut
        starts = np.r_[0, np.flatnonzero(cut)[:-1] + 1]
        x = h + (np.arange(len(h)) - starts[of]).astype(np.uint64) * np.uint64(0x165667B19E3779F9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        return of, np.add.reduceat(x, starts).view(np.int64)


def gather(docs: DataFrame, ranks: str) -> DataFrame:
    """(kind, id, n, spelled): word hashes, subword ids, span hashes and texts with their counts, summed over parts of each task.

    ``spelled`` has a word's subwords, if they fit.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _lexicon(ranks)
        held, seen = np.zeros(0, np.int64), []

        def counted() -> Iterator[pa.RecordBatch]:
            some = np.flatnonzero(held[1:]) + 1
            ids, n = lexicon.subwords(some)
            sub = np.bincount(ids, weights=np.repeat(held[some], n), minlength=lexicon.end + 1).astype(np.int64)
            used = np.flatnonzero(sub)
            passages, times = np.unique(np.concatenate(seen), return_counts=True)
            for kind, ids, n in ((WORD, lexicon.hash[some], held[some]), (SUBWORD, used, sub[used]), (SPAN, passages, times), (TEXT, np.zeros(1, np.int64), held[:1])):
                spelled = lexicon.spelled(some) if kind == WORD else np.zeros(len(ids), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), kind, np.int32)), pa.array(ids), pa.array(n), pa.array(spelled)], ["kind", "id", "n", "spelled"])

        for batch in batches:
            if len(lexicon) > HELD:
                if seen:
                    yield from counted()
                held, seen = np.zeros(0, np.int64), []
                lexicon.forget()
            for _, at, n_tokens in lexicon.read(batch.column(0)):
                more = np.bincount(at, minlength=len(lexicon))
                more[: len(held)] += held
                held = more
                seen.append(spans(lexicon.hash[at], n_tokens)[1])
        if seen:
            yield from counted()

    return docs.select("text").mapInArrow(cut, "kind int, id long, n long, spelled long")


def rounds(total: int) -> list[tuple[int, int]]:
    """(units, replicas) of each round: the first has one replica, the last what is left."""
    out, left = [], total
    while left > 0:
        size = REPLICA * min(2 ** len(out), GROWN)
        now = min(left, size * WIDER ** len(out))
        out.append((now, -(-now // size)))
        left -= now
    return out


def _flat(w: lm.Weights) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def _shaped(flat: np.ndarray, like: lm.Weights) -> lm.Weights:
    out, lo = {}, 0
    for k in sorted(like):
        out[k] = flat[lo : lo + like[k].size].reshape(like[k].shape).astype(np.float32)
        lo += like[k].size
    return out


def _mean(trained: DataFrame) -> np.ndarray:
    """Rows (at, w, n) of replicas averaged by n, piece by piece."""

    def mean(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n", "w"])
        w = np.array([np.frombuffer(x, np.float32) for x in rows["w"]], np.float64)
        return pd.DataFrame({"at": [key[0]], "w": [np.average(w, axis=0, weights=rows["n"]).astype(np.float32).tobytes()], "n": rows["n"].sum()})

    replicas = trained.where(F.col("at") == 0).count()
    while replicas > 1:  # a tree, so that no group grows with the number of replicas
        replicas = -(-replicas // FAN)
        branch = F.pmod(F.xxhash64("w"), F.lit(replicas))
        trained = trained.groupBy("at", branch.alias("branch")).applyInPandas(mean, "at int, w binary, n long")
    pieces = trained.toPandas().sort_values("at")
    return np.concatenate([np.zeros(0, np.float32), *(np.frombuffer(x, np.float32) for x in pieces["w"])])


def train(docs: DataFrame, ranks: str, vocabulary: lm.Vocabulary, total: int, whole: bytes = b"") -> lm.Weights:
    """Weights trained once on every text of docs (doc_id, text), which have ``total`` units in all."""
    weights = lm.initial(vocabulary.prior)
    squares = lm.squares(weights)
    slots = 1 << 30
    row = F.coalesce(F.col("doc_id").cast("long"), F.monotonically_increasing_id())
    dealt = docs.select("text", F.xxhash64(row, "text").alias("deal"))
    done = 0
    for r, (n, replicas) in enumerate(rounds(total)):
        lo, hi = (min(slots, round(slots * x / total)) for x in (done, done + n))
        done += n
        given = docs.sparkSession.sparkContext.broadcast((vocabulary, weights, squares))

        def fit(batches: Iterator[pa.RecordBatch], r: int = r, given=given) -> Iterator[pa.RecordBatch]:
            vocabulary, weights, squares = given.value
            lexicon = _lexicon(ranks, whole)
            ids, lengths, trained = [], [], 0

            def step() -> None:
                nonlocal weights, squares, trained
                each = np.concatenate(lengths)
                weights, squares = lm.train(weights, squares, vocabulary, np.concatenate(ids), each, batch=STEPS[min(r, len(STEPS) - 1)], seed=r)
                trained += int(each.sum())
                ids.clear()
                lengths.clear()

            for batch in batches:
                if len(lexicon) > HELD:
                    lexicon.forget()
                for _, at, n_tokens in lexicon.read(batch.column(0)):
                    flat, pieces = lexicon.subwords(at)
                    ids.append(flat)
                    lengths.append(np.add.reduceat(pieces, np.cumsum(n_tokens) - n_tokens))
                    if sum(map(len, ids)) >= SEGMENT:
                        step()
            if ids:
                step()
            if trained:
                flat = np.concatenate([_flat(weights), _flat(squares)])
                at = range(0, len(flat), PIECE)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([flat[i : i + PIECE].tobytes() for i in at], pa.binary()), pa.array(np.full(len(at), trained))], ["at", "w", "n"])

        place = F.pmod(F.col("deal"), F.lit(slots))
        replica = F.shiftrightunsigned("deal", 32)
        mine = dealt.where((place >= lo) & (place < hi)).repartition(replicas, replica).sortWithinPartitions("deal")
        flat = _mean(written(mine.mapInArrow(fit, "at int, w binary, n long"), "replicas"))
        if len(flat):
            weights, squares = (_shaped(x, weights) for x in np.split(flat, 2))
    return weights


SCORED = (
    "key long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, "
    "spans array<struct<hash: long, own: int, log: double>>, tail array<struct<span: int, hash: long, log: double>>"
)


def score(docs: DataFrame, ranks: str, vocabulary: lm.Vocabulary, weights: lm.Weights, head: pd.DataFrame, n_texts: int, scale: float, whole: bytes = b"") -> DataFrame:
    """SCORED rows. Head words and the end are summed in base, n_known and their span's log; the others are in tail, by the model alone."""
    head = head.sort_values("id")
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, weights, head["id"].to_numpy(np.int64), head["n"].to_numpy(np.int64)))

    def lists(n: np.ndarray, **columns: np.ndarray) -> pa.Array:
        offsets = np.r_[0, np.cumsum(n)].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(list(map(pa.array, columns.values())), list(columns)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, weights, head_id, head_n = shared.value
        lexicon, ready = _lexicon(ranks, whole), lm.prepared(weights)
        end_log = math.log((n_texts + SMOOTH) / scale)
        head_log = np.log((head_n + SMOOTH) / scale)
        logs = np.zeros(0)

        def share_of(hashes: np.ndarray) -> np.ndarray:
            """Log of the corpus share of each row of the lexicon, NaN for words outside the head."""
            nonlocal logs
            new = hashes[len(logs) :]
            if len(new):
                place, there = _places(head_id, new)
                found = np.full(len(new), np.nan)
                found[there] = head_log[place[there]]
                if not len(logs):
                    found[0] = end_log
                logs = np.concatenate([logs, found])
            return logs

        def done(rows: pa.RecordBatch, at: np.ndarray, n_tokens: np.ndarray) -> pa.RecordBatch:
            n = len(n_tokens)
            doc = np.repeat(np.arange(n), n_tokens)
            hashes = lexicon.hash
            share = share_of(hashes)[at]
            flat, pieces = lexicon.subwords(at)
            first = np.cumsum(pieces) - pieces
            each, begins = lm.log_probabilities(weights, vocabulary, flat, np.add.reduceat(pieces, np.cumsum(n_tokens) - n_tokens), ready)
            # of a word: that its subwords follow and then one that begins a word, given that one begins here
            begins = begins[first].astype(np.float64)
            log = np.add.reduceat(each.astype(np.float64), first) - begins
            log += np.where(at > 0, np.r_[begins[1:], 0.0], 0.0)
            known = ~np.isnan(share)
            # an end that no text was learned from has no share
            counted = known if n_texts else known & (at > 0)
            mixed = log + math.log(1 - COUNTED)
            # a share is never so small that it vanishes, so the sum has a log
            mixed[counted] = np.log(np.exp(mixed[counted]) + np.exp(share[counted]) * COUNTED)
            of, passages = spans(hashes[at], n_tokens)
            span_doc = doc[np.r_[0, np.flatnonzero(np.diff(of)) + 1]]
            n_spans = np.bincount(span_doc, minlength=n)
            own = np.zeros(len(passages), np.int32)
            order = np.lexsort((passages, span_doc))
            new = np.r_[True, (np.diff(passages[order]) != 0) | (np.diff(span_doc[order]) != 0)]
            group = np.cumsum(new) - 1
            own[order] = np.bincount(group)[group]
            own[np.array(rows.column("held_out").to_pylist(), bool)[span_doc]] = 0
            tail = ~known
            return pa.RecordBatch.from_arrays([
                rows.column("key"), rows.column("doc_id"), rows.column("held_out"), pa.array(n_tokens),
                pa.array(np.bincount(doc[counted], minlength=n)), pa.array(np.bincount(doc[known], weights=share[known], minlength=n) / math.log(10)),
                lists(n_spans, hash=passages, own=own, log=np.bincount(of[known], weights=mixed[known], minlength=len(passages))),
                lists(np.bincount(doc[tail], minlength=n), span=(of - (np.cumsum(n_spans) - n_spans)[doc])[tail].astype(np.int32), hash=hashes[at[tail]], log=log[tail]),
            ], ["key", "doc_id", "held_out", "n_tokens", "n_known", "base", "spans", "tail"])

        for batch in batches:
            if len(lexicon) > HELD:
                lexicon.forget()
                logs = np.zeros(0)
            for which, at, n_tokens in lexicon.read(batch.column("text")):
                yield done(batch.slice(which.start, which.stop - which.start), at, n_tokens)

    return docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text").mapInArrow(cut, SCORED)


def _either(a: Column, b: Column) -> Column:
    """Log of the sum of two numbers given by their logs."""
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def frequent(counts: DataFrame, most: int) -> pd.DataFrame:
    """The words above a count that leaves at most ``most`` of them."""
    level = F.floor(F.log2("n") * 16).cast("int")
    held, least = 0, None
    for row in counts.groupBy(level.alias("level")).agg(F.count("*").alias("ids")).orderBy(F.desc("level")).collect():  # under 16 for each doubling
        held += row["ids"]
        if held > most:
            break
        least = row["level"]
    return counts.where(F.lit(False) if least is None else level >= least).toPandas()


def with_whole_words(subwords: np.ndarray, spelled: list[bytes], head: pd.DataFrame) -> tuple[np.ndarray, list[bytes], bytes]:
    """Counts and bytes of all units, and the hashes of those that are whole words: the ones of ``head`` seen WHOLE times, whose subwords are taken off their counts."""
    head = head[(head["n"] >= WHOLE) & (head["spelled"] != 0)].sort_values(["n", "id"], ascending=False)
    n, packed = head["n"].to_numpy(np.float64), head["spelled"].to_numpy(np.int64).view(np.uint64)
    bits = len(subwords).bit_length()
    parts = np.array([packed >> np.uint64(bits * i) & np.uint64((1 << bits) - 1) for i in range(64 // bits)], np.int64)
    less = np.bincount(parts.ravel(), weights=np.tile(n, len(parts)), minlength=len(subwords) + 1)[1:]
    words = [b"".join(spelled[i - 1] for i in row if i) for row in parts.T.tolist()]
    return np.r_[subwords - less, n], spelled + words, head["id"].to_numpy(np.int64).tobytes()


def score_corpus(docs: DataFrame, held_out: Column, ranks: str | None = None, head_words: int = HEAD) -> DataFrame:
    """One row per row of docs; learns from the rows that are not held out."""
    ranks = ranks or default_ranks()
    docs = docs.select("doc_id", "text", held_out.alias("held_out"))
    learned = docs.where(~F.col("held_out"))
    got = written(gather(learned, ranks).groupBy("kind", "id").agg(F.sum("n").alias("n"), F.max("spelled").alias("spelled")), "lm-counts")
    of_kind = lambda kind, *more: got.where(F.col("kind") == kind).select("id", "n", *more)
    counts, passages = of_kind(WORD), of_kind(SPAN)
    sums = {r["kind"]: (r["n"], r["ids"]) for r in got.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("ids")).collect()}
    (n_words, distinct), (n_texts, _), (n_spans, _) = (sums.get(kind, (0, 0)) for kind in (WORD, TEXT, SPAN))
    total, kinds = n_words + n_texts, distinct + (n_texts > 0)
    scale = total + SMOOTH * (kinds + 1)
    _, end, spelled = _tokenizer(ranks)
    subwords = np.zeros(end + 1)
    for row in of_kind(SUBWORD).collect():  # as many as the vocabulary has
        subwords[row["id"]] = row["n"]
    subwords[end] = n_texts
    head = frequent(of_kind(WORD, "spelled"), head_words)
    units, spelled, whole = with_whole_words(subwords, spelled, head)
    vocabulary = lm.Vocabulary.of(units, spelled, np.array([s.startswith(b" ") for s in spelled]))
    weights = train(learned, ranks, vocabulary, int(units.sum()), whole)
    scored = written(score(docs, ranks, vocabulary, weights, head, n_texts, scale, whole), "lm-scored")

    n = F.coalesce("n", F.lit(0))
    share, model = F.log((n + SMOOTH) / scale), F.col("log") + math.log(1 - COUNTED)
    none = F.lit(None).cast("long")
    words = (
        scored.select("key", F.explode("tail").alias("t"))
        .select("key", "t.*")
        .join(counts, F.col("hash") == F.col("id"), "left")
        .select("key", "span", F.when(n > 0, _either(model, share + math.log(COUNTED))).otherwise(model).alias("log"), (share / math.log(10)).alias("base"), (n > 0).cast("long").alias("known"), none.alias("seen"))
    )
    parts = (
        scored.select("key", F.posexplode("spans").alias("span", "s"))
        .select("key", "span", "s.*")
        .join(passages, F.col("hash") == F.col("id"), "left")
        .select("key", "span", "log", F.lit(0.0).alias("base"), F.lit(0).cast("long").alias("known"), (n - F.col("own")).alias("seen"))
    )
    made = F.col("log") + math.log(1 - REMEMBERED)
    by_span = words.unionByName(parts).repartition("key").groupBy("key", "span").agg(F.sum("log").alias("log"), F.sum("base").alias("base"), F.sum("known").alias("known"), F.max("seen").alias("seen"))
    remembered = F.log(F.col("seen") * (REMEMBERED / max(n_spans, 1)))
    sums = by_span.groupBy("key").agg(F.sum(F.when(F.col("seen") > 0, _either(made, remembered)).otherwise(made)).alias("log"), F.sum("base").alias("tail_base"), F.sum("known").alias("tail_known"))
    return scored.select("key", "doc_id", "held_out", "n_tokens", "n_known", "base").join(sums, "key").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.col("tail_known")).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("tail_base")).alias("base_score"),
        (F.col("log") / math.log(10)).alias("score"),
    )
