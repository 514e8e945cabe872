"""Prefix trie of conversations, found by digests of fixed-length blocks of turns.

A node is a distinct sequence of first turns; the conversations that begin with it are
its members. A prefix is told by its depth and 128 bits: sums, over its turns, of hashes
of place, role and the text's digest. Sums can be put together from parts, so a long
conversation is worked on by many tasks.

1. Equal conversations are one class with a weight, which stands for all of them from
   here on; each class goes on under its smallest conv_id.
2. Turns are put into blocks of ``BLOCK``. Classes are grouped by the digest before a
   block and the one after it; each such group is a child of the block before.
3. Where all that enter a block go the same way, its turns are nodes with the members of
   the group, and no turn is looked at. Only where siblings diverge (or one ends) are the
   siblings' turns grouped by prefix. Siblings are groups, not conversations.
4. A node belongs to its smallest member. What a conversation owns is the end of its
   path, so figures of whole subtrees are sums over a node's members of what each owns:
   no walk over the tree is needed.

Defined cases: turns are ordered by turn (null first), role and the SHA-256 of the text;
equal rows are turns of their own; a null role or text is empty; rows without conv_id
belong to no conversation; an empty table gives no nodes. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranks import laid_out, positions, small, spans
from .shared import written

#: Turns of a block.
BLOCK = 4
#: Conversations whose numbers have the same quotient by this take the first turns of one of them.
FAMILY = 20
LOW = (1 << 32) - 1
NOTHING = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
LANES = ("l0", "l1", "l2", "l3")
KEY = ("k1", "k2")


def _turns(conversations: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.sha2(text.cast("binary"), 256).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )


def lent(conv_id: Column) -> Column:
    """How many first turns a conversation takes from its family's first one."""
    return F.crc32(conv_id.cast("string").cast("binary")) % 4


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations, each with its first turns replaced by those of its family's first: (conv_id) of all, turnless ones too, and their turns (conv_id, i from 1, role, digest, words)."""
    turns = written(_turns(conversations), "trie-turns")
    laid = laid_out(turns, ["conv_id"], ["turn", "role", "digest"], "trie-laid")
    found = spans(laid, ["conv_id"], "trie-spans")
    own = written(positions(laid, found, ["conv_id"]).select("conv_id", "pos", "role", "digest", "words"), "trie-ranked")
    sizes = found.groupBy("conv_id").agg(F.max("total").alias("n"))
    c = F.col("conv_id")
    givers = sizes.where(c % FAMILY == 0).select(F.col("conv_id").alias("giver"), F.col("n").alias("giver_n"))
    taken = F.least(lent(c), F.coalesce("giver_n", F.lit(0))).alias("taken")
    all_of = written(sizes.withColumn("giver", c - c % FAMILY).join(givers, "giver", "left").select("conv_id", "giver", taken), "trie-conversations")
    rest = own.where(F.col("pos") >= lent(c)).join(all_of.select("conv_id", "taken"), "conv_id")
    rest = rest.select("conv_id", (F.col("pos") - lent(c) + F.col("taken") + 1).alias("i"), "role", "digest", "words")
    first = own.where((F.col("pos") < 3) & (c % FAMILY == 0)).withColumnRenamed("conv_id", "giver").join(all_of.where("taken > 0"), "giver").where(F.col("pos") < F.col("taken"))
    return all_of.select("conv_id"), rest.unionByName(first.select("conv_id", (F.col("pos") + 1).alias("i"), "role", "digest", "words"))


def _blocks(turns: DataFrame) -> DataFrame:
    """(conv_id, block, turns, lanes, words, size) of all blocks; each turn has what the block's turns so far add up to."""
    seeds = [F.xxhash64(F.lit(seed), "i", "role", "digest") for seed in (1, 2)]
    lanes = [x for h in seeds for x in (F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(LOW)))]
    turn = F.struct("i", "words", *[x.alias(n) for x, n in zip(lanes, LANES)])
    met = turns.groupBy("conv_id", F.expr(f"(i - 1) div {BLOCK}").alias("block")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    zero = F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("words"), *[F.lit(0).cast("long").alias(n) for n in LANES])
    add = lambda a, b: F.struct(b["i"].alias("i"), (a["words"] + b["words"]).alias("words"), *[(a[n] + b[n]).alias(n) for n in LANES])
    so_far = F.transform("turns", lambda t, k: F.aggregate(F.slice("turns", 1, k + 1), zero, add))
    return met.select("conv_id", "block", so_far.alias("turns")).select("*", F.element_at("turns", -1).alias("end"))


def _packed(lanes: list[Column]) -> list[Column]:
    """Two 64-bit numbers of four sums, each modulo 2^32."""
    a, b, c, d = (x.bitwiseAND(F.lit(LOW)) for x in lanes)
    return [F.shiftleft(a, 32).bitwiseOR(b), F.shiftleft(c, 32).bitwiseOR(d)]


def digested(turns: DataFrame) -> DataFrame:
    """(conv_id, block, p1, p2, k1, k2, size, before, turns): digests before and after each block and after each of its turns.

    Running sums over a conversation's blocks: inside ranges of blocks, then shifted by
    what earlier ranges add up to.
    """
    sums = ["words", *LANES]
    blocks = _blocks(turns).select("conv_id", "block", "turns", *[F.col(f"end.{c}").alias(c) for c in sums])
    laid = laid_out(written(blocks, "trie-blocks"), ["conv_id"], ["block"], "trie-blocks-laid")
    each = laid.groupBy("conv_id", "part").agg(*[F.sum(c).alias(c) for c in sums])
    earlier = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    shifts = written(each.select("conv_id", "part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"s_{c}") for c in sums]), "trie-shifts")
    here = W.partitionBy("conv_id", "part").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    run = laid.select("*", *[F.coalesce(F.sum(c).over(here), F.lit(0)).alias(f"r_{c}") for c in sums]).join(small(shifts), ["conv_id", "part"])
    run = run.select("conv_id", "block", "turns", *[(F.col(f"r_{c}") + F.col(f"s_{c}")).alias(f"b_{c}") for c in sums])
    key = lambda lanes: [x.alias(k) for x, k in zip(_packed(lanes), KEY)]
    before = [F.col(f"b_{c}") for c in LANES]
    keyed = F.transform("turns", lambda t: F.struct(t["i"].alias("i"), *key([b + t[c] for b, c in zip(before, LANES)]), (F.col("b_words") + t["words"]).alias("upto")))
    out = run.select("conv_id", "block", *[x.alias(p) for x, p in zip(_packed(before), ("p1", "p2"))], F.col("b_words").alias("before"), keyed.alias("turns"))
    last = F.element_at("turns", -1)
    return written(out.select("*", F.size("turns").alias("size"), last["k1"].alias("k1"), last["k2"].alias("k2")), "trie-digests")


def ends(members: DataFrame) -> DataFrame:
    """(depth, k1, k2, n, rep, ends_sha256) of classes: the SHA-256 of their conv_ids in order.

    Ids are dealt by range of (class, id); each range joins its ids of a class to one text,
    and the few texts of a class are put together.
    """
    of_class = ["depth", *KEY]
    classes = written(members.groupBy(*of_class).agg(F.count("*").alias("n"), F.min("conv_id").alias("rep")), "trie-classes")
    alone = classes.where("n = 1").select(*of_class, F.sha2(F.col("rep").cast("string").cast("binary"), 256).alias("ends_sha256"))
    several = written(members.join(classes.where("n > 1").select(*of_class), of_class, "left_semi"), "trie-copies")
    laid = laid_out(several, of_class, ["conv_id"], "trie-copies-laid")
    texts = laid.groupBy(*of_class, "part").agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("text"))
    joined = texts.groupBy(*of_class).agg(F.sort_array(F.collect_list(F.struct("part", "text"))).alias("texts"))
    together = joined.select(*of_class, F.sha2(F.array_join(F.transform("texts", lambda t: t["text"]), ",").cast("binary"), 256).alias("ends_sha256"))
    return written(classes.join(alone.unionByName(together), of_class), "trie-ends")


def _grown(blocks: DataFrame, sums: dict[str, Column], of_first: dict[str, Column]) -> DataFrame:
    """Nodes (depth, k1, k2, u1, u2, above, upto and sums) of the blocks of classes; u is the parent's key, above the words before the last turn."""
    child = ["block", "p1", "p2", *KEY, "size"]
    groups = blocks.groupBy(*child).agg(*[x.alias(c) for c, x in sums.items()], F.first("before").alias("before"), F.first("turns").alias("turns"))
    groups = written(groups, "trie-groups")
    parent = ["block", "p1", "p2"]
    forks = groups.groupBy(*parent).agg(F.count("*").alias("ways")).where("ways > 1").select(*parent)
    entry = F.struct(F.lit(0).cast("long").alias("i"), F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.col("before").alias("upto"))
    pairs = F.transform("turns", lambda t, k: F.struct(t.alias("to"), F.when(k == 0, entry).otherwise(F.element_at("turns", F.greatest(k, F.lit(1)))).alias("of")))

    def turned(df: DataFrame) -> DataFrame:
        t = df.select(*sums, F.explode(pairs).alias("t"))
        return t.select(F.col("t.to.i").alias("depth"), F.col("t.to.k1").alias("k1"), F.col("t.to.k2").alias("k2"), F.col("t.of.k1").alias("u1"), F.col("t.of.k2").alias("u2"), F.col("t.of.upto").alias("above"), F.col("t.to.upto").alias("upto"), *sums)

    straight = turned(groups.join(forks, parent, "left_anti"))
    # prefixes that are equal have equal parents and words
    fixed = ["u1", "u2", "above", "upto"]
    forked = turned(groups.join(forks, parent, "left_semi")).groupBy("depth", *KEY).agg(*[F.first(c).alias(c) for c in fixed], *[x.alias(c) for c, x in of_first.items()])
    return straight.unionByName(forked.select(*straight.columns))


def trie(given: tuple[DataFrame, DataFrame]) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    every, turns = given
    blocks = digested(turns)
    last = F.max_by(F.struct("k1", "k2", F.element_at("turns", -1)["i"].alias("depth"), F.element_at("turns", -1)["upto"].alias("mass")), "block")
    whole = blocks.groupBy("conv_id").agg(last.alias("e"))
    none = F.lit(0).cast("long")
    members = every.join(whole, "conv_id", "left").select("conv_id", *[F.coalesce(F.col(f"e.{c}"), none).alias(c) for c in ("depth", *KEY, "mass")])
    members = written(members, "trie-members")
    classes = ends(members.select("conv_id", "depth", *KEY))
    mass = members.join(classes.select(F.col("rep").alias("conv_id"), "n"), "conv_id").select(F.col("conv_id").alias("rep"), "n", (F.col("n") * F.col("mass")).alias("mass"))
    mass = written(mass, "trie-mass")
    mine = blocks.withColumnRenamed("conv_id", "rep").join(mass, "rep")
    mine = written(mine, "trie-own")

    # who owns which nodes
    first = _grown(mine, {"rep": F.min("rep")}, {"rep": F.min("rep")})
    first = written(first, "trie-nodes")
    kids = first.groupBy((F.col("depth") - 1).alias("depth"), F.col("u1").alias("k1"), F.col("u2").alias("k2")).agg(F.count("*").alias("n_children"))
    kids = written(kids, "trie-children")
    of_node = ["depth", *KEY]
    shown = written(first.join(kids, of_node, "left").withColumn("n_children", F.coalesce("n_children", none)), "trie-shown")
    # an owner has the end of its path; what lies before it has ``start`` words
    owned = shown.groupBy("rep").agg(F.min(F.struct("depth", "above"))["above"].alias("start"), F.max("upto").alias("upto"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    owned = written(owned, "trie-owned")
    weighed = mine.join(owned.select("rep", "start", (F.col("upto") - F.col("start")).alias("own"), "leaf"), "rep", "left")
    weighed = weighed.withColumn("own", F.coalesce("own", none)).withColumn("leaf", F.coalesce("leaf", none))
    sums = {c: F.sum(c) for c in ("n", "mass", "own", "leaf")}
    figures = _grown(weighed, sums, sums).select(*of_node, *sums)
    named = shown.join(figures, of_node).join(owned.select("rep", "start"), "rep")
    up = shown.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("rep").alias("parent"))
    # members' words from here on, less those of each node once
    saved = F.col("mass") - F.col("n") * F.col("above") - F.col("own") - F.col("start") + F.col("above")
    total = every.agg(F.min("conv_id").alias("least"), F.count("*").alias("all"))
    inner = named.join(up, ["depth", "u1", "u2"], "left").crossJoin(F.broadcast(total))
    inner = inner.select(
        *of_node, F.col("rep").alias("conv_id"), F.when(F.col("depth") == 1, F.col("least")).otherwise(F.col("parent")).alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", F.col("leaf").alias("n_leaves"), saved.alias("saved_tokens")
    )
    of_all = mass.agg(F.coalesce(F.sum("mass"), none).alias("mass"))
    of_owners = owned.agg(F.coalesce(F.sum(F.col("upto") - F.col("start")), none).alias("own"), F.coalesce(F.sum("leaf"), none).alias("leaf"))
    tops = kids.where("depth = 0").agg(F.coalesce(F.sum("n_children"), none).alias("tops"))
    root = total.where("all > 0").crossJoin(F.broadcast(of_all)).crossJoin(F.broadcast(of_owners)).crossJoin(F.broadcast(tops))
    root = root.select(
        *[none.alias(c) for c in of_node], F.col("least").alias("conv_id"), none.cast("long").alias("z"), F.col("all").alias("n_convs"), F.col("tops").alias("n_children"), F.greatest("leaf", F.lit(1)).alias("n_leaves"), (F.col("mass") - F.col("own")).alias("saved_tokens")
    ).withColumn("z", F.lit(None).cast("long")).withColumnRenamed("z", "parent_conv_id")
    out = inner.unionByName(root).join(classes.select(*of_node, "ends_sha256"), of_node, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))
