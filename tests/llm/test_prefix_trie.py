"""The trie against one built turn by turn."""

import random
from collections import defaultdict
from hashlib import sha256
from zlib import crc32

import pytest

from ledgerloom.llm import prefix_trie, ranks

SCHEMA = "conv_id long, turn long, role string, text string, k1 string, depth string"
FIELDS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SPACES = "\x20\t\n\x0b\x0c\r"


def n_words(text):
    return len("".join(" " if c in SPACES else c for c in text).split(" ")) - "".join(" " if c in SPACES else c for c in text).split(" ").count("")


def plain(rows):
    given = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            given[conv].append((turn is not None, turn or 0, role or "", sha256((text or "").encode()).hexdigest(), text or ""))
    turns = {c: [(r, t) for _, _, r, _, t in sorted(x)] for c, x in given.items()}
    members, over = defaultdict(list), defaultdict(set)
    for c in turns:
        h, giver = crc32(str(c).encode()) % 4, c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        seq = tuple(turns.get(giver, [])[:h] + turns[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append((c, len(seq) == d))
            if d:
                over[seq[: d - 1]].add(seq[:d])
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * n_words(node[-1][1]) if node else 0
        leaves[node] = sum(leaves[x] for x in over[node]) if over[node] else 1
        saved[node] = own + sum(saved[x] for x in over[node])
    least = {node: min(c for c, _ in m) for node, m in members.items()}
    ends = {node: sha256(",".join(str(c) for c in sorted(c for c, end in m if end)).encode()).hexdigest() for node, m in members.items()}
    return [(least[n], len(n), least[n[:-1]] if n else None, len(m), len(over[n]), leaves[n], saved[n], ends[n]) for n, m in members.items()]


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x", "x") for r in rows], SCHEMA)
    got = [tuple(r[c] for c in FIELDS) for r in prefix_trie.trie(prefix_trie.rebuilt(df)).collect()]
    assert sorted(got, key=str) == sorted(plain(rows), key=str)
    return got


def test_whole_table(spark, tiny):
    rows = spark.read.parquet(f"{tiny}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    check(spark, [tuple(r) for r in rows])


def made(n, seed=1, words=("a b", "c", "", "d  e\tf")):
    """Conversations that share many first turns, some of them copies, some long."""
    r = random.Random(seed)
    out = []
    for c in range(n):
        length = r.choice([1, 2, 3, 4, 5, 8, 9, 13, 40])
        kind = r.random()
        for i in range(length):
            text = "same words here" if kind < 0.3 or i < 5 and kind < 0.7 else r.choice(words)
            out.append((c, i, "user" if i % 2 == 0 else "assistant", text))
    return out


@pytest.mark.parametrize("ranges", [None, 29])
def test_shared_prefixes_and_copies(spark, monkeypatch, ranges):
    if ranges:  # conversations and classes that go over several ranges
        monkeypatch.setattr(ranks, "ranges_of", lambda df, rows=None: ranges)
        monkeypatch.setattr(prefix_trie, "small", lambda df: df)
    check(spark, made(150))


def test_odd_rows(spark):
    rows = made(25, seed=3)
    rows += [(40, None, None, None), (40, None, "user", "x y"), (40, 3, "user", "x"), (40, 3, "user", "x"), (40, 3, "a", "z"), (None, 0, "user", "no id"), (None, 1, None, None)]
    rows += [(-7, 0, "user", "below zero"), (-40, 1, "user", "m"), (-41, 0, "user", "n"), (1000, 0, "u", "w " * 50_000), (1003, 0, "u", "w " * 50_000), (2061, 0, "u", "alone")]
    rows += [(10**12 + i, 0, "user", "only") for i in range(40)]  # most lose their only turn
    got = check(spark, rows)
    assert any(r[1] == 0 and r[7] != prefix_trie.NOTHING for r in got)


def test_only_turnless_conversations(spark):
    ids = [c for c in range(21, 200) if crc32(str(c).encode()) % 4 and c % 20]
    assert check(spark, [(c, 0, "user", "t") for c in ids])[0][1:6] == (0, None, len(ids), 0, 1)


def test_empty_table(spark):
    assert check(spark, []) == []
