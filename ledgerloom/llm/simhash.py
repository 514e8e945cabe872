"""SimHash near-duplicates, searched with pivot distance tables.

A text's fingerprint has the bits that are set in over half of the hashes of its
3-word shingles. Two fingerprints link if at most 3 of 64 bits differ.

Search: equal fingerprints are one node. Two fingerprints within 3 bits agree on
at least three of six bit blocks, so nodes meet under 20 keys of three blocks
each. Where nodes meet, a table of their Hamming distances to 16 fixed reference
fingerprints (pivots) discards every pair with a coordinate that differs by more
than 3 (triangle inequality); survivors are verified bit by bit. Meeting places
emit a spanning forest of their links, never all pairs, and places of many nodes
are cut into pairs of chunks so that no task holds one whole.

``one_of_each`` looks for texts whose five-word shingles are alike by 0.8 or more
(Jaccard). That is far apart for a fingerprint: such texts differ in about 39 of 256
bits, which no choice of bit blocks can place. There, fingerprints have 256 bits, texts
meet where four minima of their shingle hashes agree (16 such bands), pivots and
fingerprints discard pairs that differ in more than 50 bits, and the links of the
spanning forests are verified by the shingles themselves. Where a forest's link is
refused, it may have stood for another: there, all links between texts not yet connected
are verified. Two texts alike by 0.8 share a band with a probability of 0.9998.

Defined cases: null and wordless texts have fingerprint zero and link like any
other; repeated rows each get their row; a row with a null doc_id gets the component of
rows with its fingerprint, but is never a component's id, and a fingerprint that only
such rows have links to no other (its component_id is null). Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import BROADCAST_ROWS, ascii_lower, rolling_hashes, written

SHINGLE = 3
RADIUS = 3
SEED = 42
PIVOTS = np.random.default_rng(20).integers(0, 2**64, 16, dtype=np.uint64)
#: Of the wide fingerprints: shingle, words of 64 bits, bands of minima and minima of each, radius, and the similarity that counts.
WIDE_SHINGLE, WIDE, BANDS, DEEP, WIDE_RADIUS, ALIKE = 5, 4, 16, 4, 50, 0.8
WIDE_PIVOTS = np.random.default_rng(21).integers(0, 2**64, (16, WIDE), dtype=np.uint64)
#: Odd numbers that make a hash another one.
_ODD = np.random.default_rng(22).integers(0, 2**63, WIDE + BANDS * DEEP, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Distinct words whose hashes a worker keeps; shingles worked on at once.
HELD, AT_ONCE = 400_000, 1 << 15
#: Bit widths of the six blocks.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Nodes under one key before they are cut into chunks of this many.
CHUNK = 4096

_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def simhash(text: str | None) -> int:
    """The fingerprint as a signed 64-bit integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII space only
    if not words:
        return 0
    runs = [b" ".join(run) for run in zip(*(words[i:] for i in range(SHINGLE)))] or [b" ".join(words)]
    hashes = np.fromiter(map(_hash, runs), np.uint64, len(runs))
    counts = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[part : part + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


@F.pandas_udf(T.LongType())
def _simhashes(texts: pd.Series) -> pd.Series:
    return pd.Series([simhash(t) for t in texts], dtype=np.int64)


class _Hashes(dict):
    """word -> hash; only a cache."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = _hash(word)
        return h


_words = _Hashes()


def shingle_hashes(text: str | None) -> np.ndarray:
    """Distinct hashes of the five-word shingles of a text; of all its words, if fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(_words) > HELD:
        _words.clear()
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(WIDE_SHINGLE, len(h))
    if not n:
        return h
    with np.errstate(over="ignore"):
        out = np.zeros(len(h) - n + 1, np.uint64)
        for i in range(n):
            out = (out ^ h[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return np.unique(out)


def wide(hashes: np.ndarray) -> tuple[bytes, list[int]]:
    """The 256-bit fingerprint of shingle hashes, and their bands; zeros and no band without any."""
    if not len(hashes):
        return bytes(8 * WIDE), []
    counts, least = np.zeros(64 * WIDE, np.int64), np.full(BANDS * DEEP, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for lo in range(0, len(hashes), AT_ONCE):
            part = hashes[lo : lo + AT_ONCE]
            for i, odd in enumerate(_ODD):
                x = part * odd
                x ^= x >> np.uint64(32)
                if i >= WIDE:
                    least[i - WIDE] = min(least[i - WIDE], (x * odd).min())
                    continue
                x *= odd
                x ^= x >> np.uint64(29)
                counts[64 * i : 64 * i + 64] += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        bands = np.zeros(BANDS, np.uint64)
        for i, row in enumerate(least.reshape(BANDS, DEEP).T):
            bands = (bands ^ row) * _ODD[i]
            bands ^= bands >> np.uint64(31)
        bands += np.arange(BANDS, dtype=np.uint64)
    return np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), bands.view(np.int64).tolist()


def _wide_marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        marks = [wide(shingle_hashes(t)) for t in b["text"]]
        yield pd.DataFrame({"doc_id": b["doc_id"], "text_hash": b["text_hash"], "minus": b["minus"], "fp": [fp for fp, _ in marks], "bands": [bands for _, bands in marks]})


def fingerprints(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", _simhashes(F.col("text")).alias("fp"))


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _masks() -> list[int]:
    edges = np.cumsum((0, *BLOCKS))
    blocks = [sum(1 << int(b) for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(blocks, len(BLOCKS) - RADIUS)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _cross_pairs(rows: np.ndarray, nodes: np.ndarray, fps: np.ndarray, labels: np.ndarray, table: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """All links among rows of one place whose ends have different labels."""
    out = []
    rows = rows[np.argsort(table[rows, 0], kind="stable")]
    first = table[rows, 0]
    for i, u in enumerate(rows):
        near = rows[i + 1 : np.searchsorted(first, first.dtype.type(first[i] + radius), "right")]
        near = near[labels[near] != labels[u]]
        for p in range(1, table.shape[1]):
            if not len(near):
                break
            near = near[np.abs(table[near, p] - table[u, p]) <= radius]
        near = near[np.bitwise_count(fps[near] ^ fps[u]).sum(axis=-1, dtype=np.int64) <= radius]
        out += [(int(nodes[u]), x) for x in nodes[near].tolist()]
    return out


def _links(keys: np.ndarray, nodes: np.ndarray, fps: np.ndarray, radius: int = RADIUS, pivots: np.ndarray = PIVOTS[:, None], labels: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among the nodes of each key, or all links between nodes of different labels; rows come sorted by key, fps has a row of 64-bit words for each."""
    apart = lambda x, y: np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)
    table = np.stack([apart(fps, p) for p in pivots], axis=1).astype(np.int16)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    if labels is not None:
        return [x for lo, n in zip(starts.tolist(), sizes.tolist()) if (labels[lo : lo + n] != labels[lo]).any() for x in _cross_pairs(np.arange(lo, lo + n), nodes, fps, labels, table, radius)]
    two = starts[sizes == 2]
    two = two[np.abs(table[two] - table[two + 1]).max(axis=1, initial=0) <= radius]
    two = two[apart(fps[two], fps[two + 1]) <= radius]
    out = list(zip(nodes[two].tolist(), nodes[two + 1].tolist()))
    for lo, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        rows = np.arange(lo, lo + n)
        rest = rows[np.argsort(table[rows, 0], kind="stable")]
        while len(rest) > 1:
            tree, rest = [rest[0]], rest[1:]
            while tree and len(rest):
                u = tree.pop()
                first = table[rest, 0]  # sorted: a range of it holds all that can link
                a, b = np.searchsorted(first, first.dtype.type(table[u, 0] - radius)), np.searchsorted(first, first.dtype.type(table[u, 0] + radius), "right")
                near = np.arange(a, b)
                for p in range(1, len(pivots)):
                    if not len(near):
                        break
                    near = near[np.abs(table[rest[near], p] - table[u, p]) <= radius]
                near = near[apart(fps[rest[near]], fps[u]) <= radius]
                out += [(int(nodes[u]), x) for x in nodes[rest[near]].tolist()]
                tree += rest[near].tolist()
                rest = np.delete(rest, near)
    return out


def _link_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (place, node, fp) sorted by place; a place may go on in the next batch."""
    held: list[pd.DataFrame] = []

    def out(rows: pd.DataFrame) -> pd.DataFrame:
        if rows["fp"].dtype == object:
            fps, how = np.frombuffer(b"".join(rows["fp"]), np.uint64).reshape(len(rows), -1), (WIDE_RADIUS, WIDE_PIVOTS, *([rows["label"].to_numpy()] if "label" in rows else []))
        else:
            fps, how = rows["fp"].to_numpy().view(np.uint64)[:, None], ()
        return pd.DataFrame(_links(rows["place"].to_numpy(), rows["node"].to_numpy(), fps, *how), columns=["a", "b"], dtype=np.int64)

    for batch in batches:
        if not len(batch):
            continue
        last = batch["place"].iloc[-1]
        cut = int(np.searchsorted(batch["place"].to_numpy(), last))
        if cut or held and held[-1]["place"].iloc[-1] != last:
            yield out(pd.concat([*held, batch.iloc[:cut]]))
            held = []
        held.append(batch.iloc[cut:])
    if held:
        yield out(pd.concat(held))


def links(nodes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links that connect the nodes (node, fp) as all links within the radius do. Nodes with ``bands`` have wide fingerprints; of nodes with ``label``, all links between different labels."""
    own_columns = ["node", "fp", *[c for c in ("label",) if c in nodes.columns]]
    keys = F.col("bands") if "bands" in nodes.columns else F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(_masks())])
    met = nodes.select(*own_columns, F.explode(keys).alias("key"))
    hot = written(met.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > chunk), "hot-keys")
    if hot.isEmpty():
        placed = met.select(F.col("key").alias("place"), *own_columns)
    else:
        pieces = F.coalesce(F.ceil(F.col("n") / chunk), F.lit(1)).cast("int")
        own = F.pmod(F.xxhash64("fp", F.lit("chunk")), F.col("pieces")).cast("int")
        placed = (
            met.join(hot, "key", "left")
            .select(*own_columns, "key", pieces.alias("pieces"))
            .select(*own_columns, "key", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("other"))
            .select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("place"), *own_columns)
        )
    return placed.repartition("place").sortWithinPartitions("place").mapInPandas(_link_batches, "a long, b long").distinct()


def _grouped(own: DataFrame, chunk: int) -> DataFrame:
    """own (fp, doc_id, ...) with component_id."""
    nodes = written(own.groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-nodes")
    # nodes are numbered by their smallest doc_id, so a component's smallest node is its id
    reached = components(links(nodes.where(F.col("node").isNotNull()), chunk))
    of_fp = nodes.join(reached, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return own.join(of_fp, "fp")


def near_duplicates(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs."""
    return _grouped(written(fingerprints(docs), "simhash"), chunk).select("doc_id", "fp", "component_id")


def _shingle_sets(texts: DataFrame) -> DataFrame:
    """(node, set) of texts (node, text): the distinct shingle hashes, worked out in Spark.

    Word hashes are a column of their own, so that they aren't worked out again for every shingle.
    """
    words = F.array_remove(F.split(ascii_lower(F.coalesce("text", F.lit(""))), r"[\x20\x09-\x0D]+"), "")
    hashed = texts.select("node", F.transform(words, lambda w: F.xxhash64(w)).alias("hashes"))
    shingles = F.when(F.size("hashes") >= WIDE_SHINGLE, rolling_hashes(F.col("hashes"), WIDE_SHINGLE)).otherwise(F.array(F.xxhash64("hashes")))
    return hashed.select("node", F.array_distinct(shingles).alias("set"))


def _alike(near: DataFrame, sets: DataFrame) -> DataFrame:
    """The links whose shingle sets are alike."""
    common = F.size(F.array_intersect("set_a", "set_b"))
    pairs = near.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
    return pairs.where(common >= ALIKE * (F.size("set_a") + F.size("set_b") - common)).select("a", "b")


def _still_apart(near: DataFrame, alike: DataFrame, texts: DataFrame, reached: DataFrame) -> DataFrame:
    """texts of forests with a link that is none between two components; label is a text's component so far."""
    label = lambda df, x: df.join(reached.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}")), x, "left").withColumn(f"of_{x}", F.coalesce(f"of_{x}", x))
    refused = written(label(label(near.join(alike, ["a", "b"], "left_anti"), "a"), "b").where("of_a <> of_b").select("a"), "simhash-refused")
    if refused.isEmpty():
        return texts.withColumn("label", F.col("node")).limit(0)
    forest = written(components(near), "simhash-forest")
    open_ = forest.join(refused.select(F.col("a").alias("node")).distinct(), "node", "left_semi").select("component").distinct()
    nodes = forest.join(open_, "component", "left_semi").select("node")
    return label(texts.join(nodes, "node", "left_semi"), "node").withColumnRenamed("of_node", "label")


def one_of_each(docs: DataFrame, chunk: int = CHUNK, broadcast_rows: int = BROADCAST_ROWS, longest: bool = False) -> DataFrame:
    """docs with one row of each group of near copies: the smallest doc_id (of the longest texts, if so asked), then the smallest text hash.

    Equal texts are one node, told apart by a 64-bit hash; texts without words are
    alike. A row without doc_id stays only if no row of its group has one, and one of
    rows that repeat the kept one stays. Only what is known of texts in groups of
    several rows is joined to the documents: up to ``broadcast_rows`` such texts are
    broadcast, so texts are not shuffled.
    """
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    minus = -F.length(F.coalesce("text", F.lit(""))) if longest else F.lit(0)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash.alias("text_hash"), minus.alias("minus"), "text").mapInPandas(_wide_marks, "doc_id long, text_hash long, minus int, fp binary, bands array<long>")
    own = written(own, "simhash")
    none = F.col("doc_id").isNull()
    texts = (
        own.groupBy("text_hash", "doc_id", "minus")
        .agg(F.count("*").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
        .groupBy("text_hash")
        .agg(F.min(F.struct(none.alias("none"), "minus", "doc_id", "n")).alias("least"), F.sum("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    )
    # all texts without words meet in one place
    bands = F.when(F.size("bands") > 0, F.col("bands")).otherwise(F.array(F.lit(0).cast("long")))
    texts = written(texts.select(F.col("text_hash").alias("node"), "least", "n", "fp", bands.alias("bands")), "simhash-texts")
    near = written(links(texts, chunk), "simhash-near")
    small = lambda df: F.broadcast(df) if df.count() <= broadcast_rows else df
    # the links are verified by the shingles; only texts that have one are read for it
    ends = written(texts.join(near.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi").select("node", F.col("least.doc_id").alias("first")), "simhash-ends")
    sets = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash.alias("node"), "text").join(small(ends), "node").where(F.col("doc_id").eqNullSafe(F.col("first")))
    sets = written(_shingle_sets(sets.dropDuplicates(["node"])), "simhash-sets")
    alike = written(_alike(near, sets), "simhash-alike")
    # links of a forest that turn out to be none may stand in the place of others that are: where they were
    # looked for, all links between what is still apart are verified too
    reached = components(alike)
    apart = written(_still_apart(near, alike, texts.select("node", "fp", "bands"), reached), "simhash-apart")
    if not apart.isEmpty():
        more = written(_alike(written(links(apart, chunk), "simhash-near"), sets), "simhash-alike")
        reached = components(alike.unionByName(more))
    linked = written(reached.join(texts.select("node", "least"), "node"), "simhash-linked")
    row = F.struct("least.none", "least.minus", "least.doc_id", F.col("node").alias("hash"))
    kept = written(linked.groupBy("component").agg(F.min(row).alias("kept")), "simhash-kept")
    of_group = linked.join(small(kept), "component").select("node", "kept")
    # a text of one row that is nobody's near copy needs no look
    groups = texts.select("node", "least", "n").join(of_group, "node", "left").where((F.col("n") > 1) | F.col("kept").isNotNull())
    kept = F.coalesce("kept", row)
    odd = groups.select(F.col("node").alias("__hash"), (kept["hash"] == F.col("node")).alias("__keeps"), kept["doc_id"].alias("__kept"), (F.col("least.n") > 1).alias("__again"))
    odd = written(odd, "simhash-odd")
    joined = docs.join(small(odd), text_hash == F.col("__hash"), "left")
    stays = F.col("__hash").isNull() | F.col("__keeps") & F.col("doc_id").cast("long").eqNullSafe(F.col("__kept"))
    again = F.coalesce("__again", F.lit(False))
    out = joined.where(stays & ~again).select(*docs.columns)
    if odd.where("__keeps and __again").isEmpty():
        return out
    return out.unionByName(joined.where(stays & again).select(*docs.columns).dropDuplicates(["doc_id", "text"]))
