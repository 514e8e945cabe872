"""Benchmark decontamination by template canonicalisation.

Texts become tokens (numbers and runs of letters, lower-cased). In the template
form numbers, names (capitalised inside a sentence) and units (after a number)
are typed placeholders; the literal form keeps every token. Windows of 8 tokens
of both forms are hashed and hash-joined to the benchmark's windows. Where only
the template form agrees, the slots must be consistent: one value of the item
always meets one value of the text, and the other way round. So a question with
other numbers or names is caught, and one that merely has the same shape is not.

An item is found in a text if windows of one occurrence cover at least half of its
tokens or 13 of them. An occurrence is the windows that stand at one offset from
the item, or at neighbouring offsets; coverage and slots are settled in each. Items of 5 to 7 tokens are one window of their own length; items of 3 or 4
tokens are found where they are a whole sentence or line, those of 1 or 2 where they are
a whole line, which may be a lone word of any text. A template window has at least 5 literal tokens: where slots are dense
it goes on beyond 8 tokens until it has them. An item with fewer literals in all
has one window, which must be a whole sentence or line; with a single literal, a line.

Defined cases: null and empty texts hold nothing; ids may be of any type and keep it,
null among them; a repeated row changes nothing. Every text is looked through by
itself: ``find`` gives the best of the texts with one id, ``decontaminate`` takes away
only rows whose own text holds an item. An empty benchmark finds nothing. Extra
columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, written

WINDOW = 8
SHORTEST = 5
#: Tokens of an item that is found only as a whole sentence or line, and literals of such a template.
SHORTEST_ALONE = 3
#: Tokens of an item that is found only as a whole line.
SHORTEST_LINE = 1
LITERALS = 5
FEWEST = 2
SHARE = 0.5
RUN = 13
#: Bits of the filter that text windows pass before they are joined; it is this large for any benchmark.
FILTER_BITS = 1 << 22
#: Distinct tokens that a worker remembers.
HELD = 250_000
#: Texts whose tokens one task holds at once.
TEXTS_AT_ONCE = 500

TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[.!?\n]")
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg lb lbs pound pounds oz ounce ounces ton tons "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks "
    "month months year years cent cents dollar dollars euro euros percent mph kmh kph degrees volt volts watt watts joule joules".split()
)
WORD, NUMBER, UNIT, NAME, STOP, LINE = range(6)
HOLDER = np.array([0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0, 0], np.uint64)
BASE = 0xD6E8FEB86659FD93


class Lexicon(dict):
    """token -> row of ``hashes`` and ``kinds``; only a cache, emptied when large."""

    def __init__(self) -> None:
        self.hashes, self.kinds = array("Q"), array("b")

    def __missing__(self, token: str) -> int:
        low = token.lower()
        kind = LINE if token == "\n" else STOP if token in ".!?" else NUMBER if token[0].isdigit() else UNIT if low in UNITS else NAME if token.istitle() and len(token) > 1 else WORD
        self.hashes.append(xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass")))
        self.kinds.append(kind)
        self[token] = len(self.kinds) - 1
        return self[token]

    def __call__(self, texts: Iterable[str | None]) -> Iterator[tuple[int, list[str], np.ndarray, np.ndarray]]:
        """(place, tokens, hashes, kinds) of each text that holds anything."""
        if len(self) > HELD:
            self.clear()
            self.hashes, self.kinds = array("Q"), array("b")
        held = []
        for i, text in enumerate(texts):
            if text:
                raw = TOKEN.findall(text)
                held.append((i, raw, np.fromiter(map(self.__getitem__, raw), np.int64, len(raw))))
        hashes, kinds = np.array(self.hashes, np.uint64), np.array(self.kinds, np.int8)
        for i, raw, at in held:
            yield i, raw, hashes[at], kinds[at]


def _rolling(ids: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.zeros(max(0, len(ids) - n + 1), np.uint64)
        for j in range(n):
            h = h * np.uint64(BASE) + ids[j : j + len(h)]
        h ^= h >> np.uint64(29)
        h *= np.uint64(BASE)
        return h ^ (h >> np.uint64(32))


#: Powers of BASE and of its inverse modulo 2**64, as many as the longest text so far needed.
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _spans(ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash that ``_rolling`` gives for windows of many lengths, from prefix sums."""
    with np.errstate(over="ignore"):
        for i, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            if len(_powers[i]) <= len(ids):
                _powers[i] = np.cumprod(np.r_[np.uint64(1), np.full(2 * len(ids), base, np.uint64)], dtype=np.uint64)
        sums = np.r_[np.uint64(0), np.cumsum(ids * _powers[1][: len(ids)], dtype=np.uint64)]
        h = (sums[end] - sums[start]) * _powers[0][end - 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(BASE)
        return h ^ (h >> np.uint64(32))


def _windows(raw: list[str], hashes: np.ndarray, kinds: np.ndarray, lengths: Callable[[int], list[int]], keep: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple]:
    """(number of tokens, is template, start, width, hash, slot values) of a text's windows whose hashes are kept.

    ``lengths`` gives the lengths of whole items to look for in a text of so many tokens.
    """
    stop = kinds >= STOP
    kept = np.flatnonzero(~stop)
    size = len(kept)
    first = np.r_[True, stop[:-1]][: len(kinds)][kept]  # of a sentence
    last = np.r_[stop[1:], True][-len(kinds) :][kept]
    line = np.cumsum(kinds == LINE)[kept]
    kinds, hashes = kinds[kept], hashes[kept]
    after_number = np.r_[False, kinds[:-1] == NUMBER][: len(kinds)]
    slot = (kinds == NUMBER) | (kinds == UNIT) & after_number | (kinds == NAME) & ~first
    typed = np.where(slot, HOLDER[kinds], hashes) if slot.any() else None
    values = lambda s, n: [raw[kept[j]].lower() for j in range(s, s + n) if slot[j]]
    total = np.r_[0, np.cumsum(slot)]
    for n in sorted({WINDOW, *lengths(size)}):
        if n > size or n < SHORTEST_LINE:
            continue
        turn = line[1:] != line[:-1]
        new_line, line_end = np.r_[True, turn], np.r_[turn, True]
        on_line = new_line[: size - n + 1] & line_end[n - 1 :] & (line[: size - n + 1] == line[n - 1 :])
        alone = first[: size - n + 1] & last[n - 1 :] if n >= SHORTEST_ALONE else on_line
        if n <= WINDOW and (n >= SHORTEST or alone.any()):
            h = _rolling(hashes, n)
            for s in np.flatnonzero(keep(h) & (alone | (n >= SHORTEST))).tolist():
                yield size, False, s, n, int(h[s].astype(np.int64)), []
        if typed is None:
            continue
        slots = total[n:] - total[:-n]
        enough = slots <= n - LITERALS
        some = (slots > 0) & (enough & (n <= WINDOW) | ~enough & (slots <= n - FEWEST) & alone | (slots == n - 1) & on_line & (n >= SHORTEST_ALONE))
        if some.any():
            at = np.flatnonzero(some)
            h = _spans(typed, at, at + n)
            for s, x in zip(at[k := keep(h)].tolist(), h[k].astype(np.int64).tolist()):
                yield size, True, s, n, x, values(s, n)
    if typed is None or size <= WINDOW:
        return
    # windows with too few literals go on until they have enough
    literals = np.flatnonzero(~slot)
    at = np.flatnonzero(total[WINDOW:] - total[:-WINDOW] > WINDOW - LITERALS)
    nth = at - total[at] + LITERALS - 1
    at, nth = at[nth < len(literals)], nth[nth < len(literals)]
    if len(at):
        end = literals[nth] + 1
        h = _spans(typed, at, end)
        for s, e, x in zip(at[k := keep(h)].tolist(), end[k].tolist(), h[k].astype(np.int64).tolist()):
            yield size, True, s, e - s, x, values(s, e - s)


#: Ids travel as text: a null among them would turn numbers into floats. ``mark`` tells texts apart.
SCHEMA = "id string, mark long, n_tokens int, template boolean, at int, width int, hash long, slots array<string>"


#: One cache for each Python worker, which serves many tasks.
_lexicon = Lexicon()


def _cut(batches: Iterator[pd.DataFrame], lengths: Callable[[int], list[int]], keep: Callable[[np.ndarray], np.ndarray]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        ids = list(zip(batch["id"].tolist(), batch["mark"].tolist()))
        for lo in range(0, len(batch), TEXTS_AT_ONCE):
            texts = batch["text"].iloc[lo : lo + TEXTS_AT_ONCE]
            rows = [(*ids[lo + i], *w) for i, *text in _lexicon(texts) for w in _windows(*text, lengths, keep)]
            yield pd.DataFrame(rows, columns=["id", "mark", "n_tokens", "template", "at", "width", "hash", "slots"])


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """Every window of every item, in both forms."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _cut(batches, lambda n: [n], lambda h: np.ones(len(h), bool))

    return benchmark.select(F.col("item_id").cast("string").alias("id"), F.lit(0).cast("long").alias("mark"), "text").mapInPandas(cut, SCHEMA)


def _mark() -> Column:
    return F.xxhash64("text")


def _found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(id, mark, item, share, covered, plain) of every item found in a text."""
    spark = docs.sparkSession
    items = written(benchmark_windows(benchmark), "benchmark-windows")
    place = lambda shift: F.pmod(F.shiftrightunsigned("hash", shift), F.lit(FILTER_BITS))
    # at most FILTER_BITS positions, however large the benchmark
    marks = items.select(F.explode(F.array(place(0), place(24))).alias("p")).distinct().toPandas()["p"].to_numpy(np.int64)
    bits = np.zeros(FILTER_BITS, bool)
    bits[marks] = True
    few = (F.col("n_tokens") < WINDOW) | (F.col("width") - F.size("slots") < LITERALS)
    whole = sorted(r[0] for r in items.where((F.col("width") == F.col("n_tokens")) & few).select("n_tokens").distinct().collect())
    shared = spark.sparkContext.broadcast(np.packbits(bits))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = np.unpackbits(shared.value).astype(bool)
        low, keep_24 = np.uint64(FILTER_BITS - 1), np.uint64(24)

        def keep(h: np.ndarray) -> np.ndarray:
            out = known[(h & low).astype(np.int64)]
            some = np.flatnonzero(out)
            out[some] = known[((h[some] >> keep_24) & low).astype(np.int64)]
            return out

        return _cut(batches, lambda n: whole, keep)

    seen = docs.select(F.col("doc_id").cast("string").alias("id"), _mark().alias("mark"), "text").mapInPandas(cut, SCHEMA)
    a, b = seen.alias("d"), items.alias("i")
    # placeholders are hashed into template windows, so forms never mix
    met = a.join(b, (F.col("d.hash") == F.col("i.hash")) & (F.col("d.template") == F.col("i.template"))).select(
        F.col("d.id").alias("id"),
        F.col("d.mark").alias("mark"),
        F.col("i.id").alias("item"),
        F.col("i.n_tokens").alias("n_tokens"),
        "d.template",
        (F.col("d.at") - F.col("i.at")).alias("offset"),
        F.sequence(F.col("i.at"), F.col("i.at") + F.col("i.width") - 1).alias("covers"),
        F.arrays_zip(F.col("i.slots").alias("item"), F.col("d.slots").alias("text")).alias("pairs"),
    )
    distinct = lambda c: F.array_distinct(F.flatten(F.collect_set(c)))
    literal = F.when(~F.col("template"), F.col("covers"))
    # one occurrence is one offset: its slots are settled apart from those of other occurrences
    # of an occurrence: (covered tokens, of them in literal windows)
    found = F.struct(F.when(F.col("consistent"), F.size("all")).otherwise(F.size("plain")).alias("covered"), F.size("plain").alias("plain"))
    settle = lambda df: df.withColumn("values", F.size(F.array_distinct(F.transform("pairs", lambda p: p["item"])))).withColumn(
        "consistent", (F.col("values") == F.size("pairs")) & (F.size(F.array_distinct(F.transform("pairs", lambda p: p["text"]))) == F.size("pairs"))
    ).withColumn("found", found)
    keys = ["id", "mark", "item", "n_tokens"]
    at_offset = settle(met.groupBy(*keys, "offset").agg(distinct(F.col("covers")).alias("all"), distinct(literal).alias("plain"), distinct(F.col("pairs")).alias("pairs")))
    # words put in or left out shift the rest of an occurrence: near offsets also count together
    in_order = W.partitionBy(*keys).orderBy("offset")
    apart = F.coalesce(F.col("offset") - F.lag("offset").over(in_order) > WINDOW, F.lit(False)).cast("int")
    merged = settle(
        at_offset.withColumn("apart", apart)
        .withColumn("run", F.sum("apart").over(in_order))
        .groupBy(*keys, "run")
        .agg(distinct(F.col("all")).alias("all"), distinct(F.col("plain")).alias("plain"), distinct(F.col("pairs")).alias("pairs"), F.max("found").alias("single"))
    )
    by_item = (
        merged.groupBy(*keys)
        .agg(F.max(F.greatest("single", "found")).alias("best"))
        .select(*keys, F.col("best.covered").alias("covered"), F.col("best.plain").alias("plain"))
        .withColumn("share", F.col("covered") / F.col("n_tokens"))
    )
    return by_item.where((F.col("share") >= SHARE) | (F.col("covered") >= RUN))


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, covered, share, kind) of every item found in a text."""
    best = _found(docs, benchmark).groupBy("id", "item").agg(F.max(F.struct("share", "covered", "plain")).alias("best"))
    return best.select(
        F.col("id").cast(docs.schema["doc_id"].dataType).alias("doc_id"),
        F.col("item").cast(benchmark.schema["item_id"].dataType).alias("item_id"),
        F.col("best.covered").cast("long").alias("covered"),
        F.round("best.share", 6).alias("share"),
        F.when(F.col("best.plain") >= F.col("best.covered"), "literal").otherwise("template").alias("kind"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs without those in which an item was found; all columns pass through."""
    leaks = written(_found(docs, benchmark).select(F.col("id").alias("__leak"), F.col("mark").alias("__mark")).distinct(), "leaks")
    if leaks.count() <= broadcast_rows:
        leaks = F.broadcast(leaks)
    return docs.join(leaks, F.col("doc_id").cast("string").eqNullSafe(F.col("__leak")) & (_mark() == F.col("__mark")), "left_anti")
