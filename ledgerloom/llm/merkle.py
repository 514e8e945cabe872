"""Merkle manifest of a table of documents, with proofs expanded from octopus multiproofs.

Each row is a leaf: the hash of its columns, each with its size before it. The leaves of
a source, by doc_id, are the lowest level of a tree in which up to 16 neighbours have one
parent; the roots of the sources' trees, by source, are the lowest level of one tree
above. H is SHA-256 as lower-case hex, over hex texts put together.

* Leaves are hashed in compiled stages, dealt by range of (source, doc_id) and numbered
  without a task that sees a whole source (``ranks``); levels are groupings by
  (tree, place / 16), each written once.
* A leaf partition is a range: runs of neighbouring leaves of one or more sources. It
  works out which nodes its leaves' proofs need and its own leaves can't give (a few at
  either end of a run on each level), so the union for the whole partition grows with
  the height of the tree, not with its leaves. These coordinates are fetched by one join;
  parents that several proofs share are derived once; each proof is then put together
  and checked in place.

Defined cases: nulls are ``-`` in a leaf, an empty text is ``0:``; rows with equal doc_ids
are ordered by their leaves, a null doc_id comes first and is never tampered with; equal
rows are leaves of their own; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranks import laid_out, positions, small, spans
from .shared import written

FANOUT = 16
#: Number of the tree over the sources' roots; theirs count from 0.
TOP = -1
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_hash(columns: list[Column]) -> Column:
    sized = lambda x: F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-"))
    return F.sha2(F.concat(*[sized(c.cast("string")) for c in columns]).cast("binary"), 256)


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(source, doc_id, leaf, bad); bad is the leaf with the text's A-Z in lower case, where ``tampered`` holds."""
    own = [F.col(c) for c in COLUMNS]
    changed = leaf_hash([*own[:-1], F.translate("text", UPPER, LOWER)])
    bad = F.when(tampered, changed) if tampered is not None else F.lit(None).cast("string")
    return docs.select("source", "doc_id", leaf_hash(own).alias("leaf"), bad.alias("bad"))


def _levels(nodes: DataFrame, name: str) -> list[DataFrame]:
    """Tables (tree, level, idx, hash, total) of all levels above nodes (level 0), where total counts a tree's nodes of that level."""
    out, level, now = [], 0, nodes
    widest = nodes.agg(F.max("total")).first()[0] or 0
    while widest > 1:
        level += 1
        up = now.where("total > 1").groupBy("tree", F.expr(f"idx div {FANOUT}").alias("idx")).agg(F.sort_array(F.collect_list(F.struct("idx", "hash"))).alias("kids"), F.max("total").alias("total"))
        text = F.array_join(F.transform("kids", lambda k: k["hash"]), "")
        now = written(up.select("tree", F.lit(level).alias("level"), "idx", F.sha2(text.cast("binary"), 256).alias("hash"), F.expr(f"(total + {FANOUT - 1}) div {FANOUT}").alias("total")), name)
        out.append(now)
        widest = -(-widest // FANOUT)
    return out


def missing(lo: int, hi: int, total: int) -> Iterator[tuple[int, int]]:
    """(level, place) of the nodes that proofs of the leaves lo to hi - 1 need and these leaves don't give."""
    level = 0
    while total > 1:
        start, end = lo - lo % FANOUT, min(hi + -hi % FANOUT, total)
        yield from ((level, i) for i in range(start, lo))
        yield from ((level, i) for i in range(hi, end))
        lo, hi, total, level = start // FANOUT, -(-end // FANOUT), -(-total // FANOUT), level + 1


def _asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (part, tree, lo, hi, total) to the coordinates that each needs."""
    for b in batches:
        rows = [(part, tree, level, i) for part, tree, lo, hi, total in b.itertuples(index=False) for level, i in missing(lo, hi, total)]
        yield pd.DataFrame(rows, columns=["part", "tree", "level", "idx"])


def _hash(text: str) -> str:
    return sha256(text.encode("ascii")).hexdigest()


class Run:
    """Nodes above a run of neighbouring leaves; what the leaves can't give is taken from ``fetched``."""

    def __init__(self, hashes: list[str], lo: int, total: int, fetched: Callable[[int, int], str]) -> None:
        #: of each level, the place of the first family and the families' hashes in one text each
        self.levels: list[tuple[int, list[str]]] = []
        hi, level = lo + len(hashes), 0
        while total > 1:
            start, end = lo - lo % FANOUT, min(hi + -hi % FANOUT, total)
            hashes = [*(fetched(level, i) for i in range(start, lo)), *hashes, *(fetched(level, i) for i in range(hi, end))]
            families = ["".join(hashes[i : i + FANOUT]) for i in range(0, len(hashes), FANOUT)]
            self.levels.append((start // FANOUT, families))
            hashes = [_hash(f) for f in families]
            lo, hi, total, level = start // FANOUT, start // FANOUT + len(families), -(-total // FANOUT), level + 1
        self.root = hashes[0] if hashes else ""

    def path(self, place: int, levels: int | None = None) -> list[tuple[str, str]]:
        """What stands before and after the node in its family, level by level."""
        out = []
        for first, families in self.levels[:levels]:
            family, at = families[place // FANOUT - first], place % FANOUT * 64
            out.append((family[:at], family[at + 64 :]))
            place //= FANOUT
        return out


def folded(digest: str, path: list[tuple[str, str]]) -> str:
    for before, after in path:
        digest = _hash(before + digest + after)
    return digest


def _proved(given: pa.Table, found: pa.Table) -> pa.Table:
    """Rows of one leaf partition with root and proof of each, from the nodes fetched for it."""
    nodes = dict(zip(zip(*(found[c].to_pylist() for c in ("tree", "level", "idx"))), found["hash"].to_pylist()))
    given = given.sort_by([("tree", "ascending"), ("pos", "ascending")])
    places, leaf, bad = (given[c].to_pylist() for c in ("pos", "leaf", "bad"))
    trees, totals = given["tree"].to_numpy(), given["total"].to_numpy()
    starts = [*np.flatnonzero(np.r_[True, trees[1:] != trees[:-1]]).tolist(), len(trees)] if len(trees) else [0]
    runs = [Run(leaf[lo:hi], places[lo], int(totals[lo]), lambda level, i, t=int(trees[lo]): nodes[t, level, i]) for lo, hi in zip(starts, starts[1:])]
    first = int(trees[0]) if len(trees) else 0
    top = Run([r.root for r in runs], first, int(given["trees"][0].as_py()) if len(trees) else 0, lambda level, i: nodes[TOP, level, i])
    subroots, proofs, ends = [], [], []
    for k, (run, lo, hi) in enumerate(zip(runs, starts, starts[1:])):
        over, shared = top.path(first + k), {}
        for i in range(lo, hi):
            path, family = run.path(places[i], 1), places[i] // FANOUT
            if family not in shared:  # all leaves of a family go the same way from their parent on
                rest = run.path(places[i])[1:] + over
                shared[family] = rest, "".join(a + b for a, b in rest)
            rest, text = shared[family]
            proofs.append(_hash("".join(a + b for a, b in path) + text))
            ends.append(folded(leaf[i] if bad[i] is None else bad[i], [*path, *rest]))
            subroots.append(run.root)
    text = lambda x: pa.array(x, pa.string())
    columns = {"doc_id": given["doc_id"], "leaf": given["leaf"], "subroot": text(subroots), "root": text([top.root] * len(proofs)), "proof_sha256": text(proofs), "folded_root": text(ends), "verified": pa.array([e == top.root for e in ends], pa.bool_())}
    return pa.table(columns)


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of docs.

    ``folded_root`` is worked out anew from each proof and the leaf, or the changed leaf
    where ``tampered`` holds.
    """
    own = written(leaves(docs, tampered), "merkle-leaves")
    laid = laid_out(own, ["source"], ["doc_id", "leaf"], "merkle-laid")
    found = spans(laid, ["source"], "merkle-spans")
    # the sources' trees are numbered in the order of their names
    sources = written(found.groupBy("source").agg(F.max("total").alias("total")).withColumn("every", F.lit(0)), "merkle-sources")
    placed = laid_out(sources, ["every"], ["source"], "merkle-sources-laid")
    numbered = positions(placed, spans(placed, ["every"], "merkle-sources-spans").drop("total"), ["every"])
    trees = written(numbered.select(F.col("source").alias("__source"), F.col("pos").alias("tree")), "merkle-trees")
    n_trees = F.lit(trees.count()).cast("long")
    found = written(found.join(small(trees), found["source"].eqNullSafe(trees["__source"])).drop("__source"), "merkle-runs")
    ranked = written(positions(laid, found, ["source"]).select("part", "tree", "pos", "total", "doc_id", "leaf", "bad"), "merkle-ranked")

    nodes = ranked.select("tree", F.lit(0).alias("level"), F.col("pos").alias("idx"), F.col("leaf").alias("hash"), "total")
    for up in _levels(nodes, "merkle-level"):
        nodes = nodes.unionByName(up)
    roots = nodes.where("total = 1").select(F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("idx"), "hash", n_trees.alias("total"))
    roots = written(roots, "merkle-roots")
    for up in (roots, *_levels(roots, "merkle-top")):
        nodes = nodes.unionByName(up)

    runs = found.select("part", "tree", F.col("first").alias("lo"), (F.col("first") + F.col("n")).alias("hi"), "total")
    above = found.groupBy("part").agg(F.min("tree").alias("lo"), (F.max("tree") + 1).alias("hi"))
    runs = runs.unionByName(above.select("part", F.lit(TOP).cast("long").alias("tree"), "lo", "hi", n_trees.alias("total")))
    asked = written(runs.mapInPandas(_asked, "part int, tree long, level int, idx long"), "merkle-asked")
    fetched = written(nodes.join(small(asked), ["tree", "level", "idx"]).select("part", "tree", "level", "idx", "hash"), "merkle-fetched")
    given = ranked.select("part", "tree", "pos", "total", n_trees.alias("trees"), "doc_id", "leaf", "bad")
    schema = T.StructType([docs.select("doc_id").schema[0], *[T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], T.StructField("verified", T.BooleanType())])
    return given.groupBy("part").cogroup(fetched.groupBy("part")).applyInArrow(_proved, schema)
