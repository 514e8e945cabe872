"""A small causal self-attention language model over ids of subwords and words, in numpy.

Streams are cut into blocks of 8 ids. A block's ids are predicted from queries at
the ids before them, over keys of that block and the one before (16 ids, masked to
what precedes), so windows overlap and each id is scored once. The output is a
softmax over 32 groups, then one over the group's 16 classes. The first 24 groups
are of ids that begin a word, so the groups also give the probability that a
word ends here. On either side the most frequent ids are classes of their own
and the others share classes of equal mass that are neighbours in spelling, inside
which smoothed corpus counts decide. So the probabilities of all ids sum to one, and
an id costs 48 outputs instead of the whole vocabulary.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BLOCK = 8
GROUPS, MEMBERS = 32, 16
#: Groups of units that begin a word, and their classes.
BEGINNING = 24
SIDE, CLASSES = BEGINNING * MEMBERS, GROUPS * MEMBERS
#: Classes of each side that hold one frequent id; the rest of the classes are shared.
OWN = 96
#: Ids with an embedding of their own; the others of a class share one.
EMBEDDED = 2048
DIM, KEY = 16, 8
WIDTH = 2 * KEY + 2 * DIM
#: Blocks scored at once; blocks of one training piece.
BATCH, PIECE = 4096, 32

_QUERY, _KEY_AT = np.arange(BLOCK)[:, None] + BLOCK, np.arange(2 * BLOCK)[None, :]
DISTANCE = np.clip(_QUERY - _KEY_AT, 0, 2 * BLOCK - 1)
#: Added to the scores of what must not be seen.
HIDDEN = np.float32(-1e4)
CAUSAL = np.where(_KEY_AT <= _QUERY, np.float32(0), HIDDEN)


@dataclass
class Vocabulary:
    """What corpus counts fix: embedding row, class and in-class log probability of every id.

    Ids are the tokenizer's, then one for the end, then whole words. Embedding rows 0 and 1 are for
    padding and the start; padding is hidden.
    """

    row: np.ndarray
    kind: np.ndarray
    inside: np.ndarray
    prior: np.ndarray

    @staticmethod
    def of(counts: np.ndarray, spelled: list[bytes] | None = None, begins: np.ndarray | None = None, smooth: float = 0.1) -> Vocabulary:
        """``spelled`` gives the ids' bytes, ``begins`` which of them begin a word (all, if not given)."""
        n = len(counts)
        begins = np.ones(n, bool) if begins is None else begins
        order = np.argsort(-counts, kind="stable")
        mass = counts + smooth
        kind = np.zeros(n, np.int64)
        for first, end, ids in ((0, SIDE, order[begins[order]]), (SIDE, CLASSES, order[~begins[order]])):
            kind[ids[:OWN]] = first + np.arange(min(OWN, len(ids)))
            rest = np.array(sorted(ids[OWN:].tolist(), key=lambda i: (spelled[i] if spelled else b"", i)), np.int64)
            if len(rest):
                share, shared = np.cumsum(mass[rest]) / mass[rest].sum(), end - first - OWN
                kind[rest] = first + OWN + np.minimum((share * shared).astype(np.int64), shared - 1)
        total = np.bincount(kind, weights=mass, minlength=CLASSES)
        row = EMBEDDED + 2 + kind
        row[order[:EMBEDDED]] = np.arange(min(EMBEDDED, n)) + 2
        used = np.maximum(total, 1e-9)
        return Vocabulary(row.astype(np.uint16), kind.astype(np.int16), np.log(mass / used[kind]).astype(np.float32), np.where(total > 0, np.log(used / used.sum()), -30).astype(np.float32))


Weights = dict[str, np.ndarray]


def initial(prior: np.ndarray, seed: int = 0) -> Weights:
    """E: embeddings. W: their query, key, value and skip parts, s: bias of the last. R: bias by distance. G, g: groups. O, o: classes of each group."""
    rng = np.random.default_rng(seed)
    group = np.log(np.exp(prior).reshape(GROUPS, MEMBERS).sum(axis=1)).astype(np.float32)
    normal = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape).astype(np.float32)
    return {
        "E": rng.normal(0, 0.5, (EMBEDDED + 2 + CLASSES, DIM)).astype(np.float32), "W": np.hstack([normal(DIM, KEY) * np.float32(KEY**-0.5), normal(DIM, KEY), normal(DIM, DIM), normal(DIM, DIM)]),
        "s": np.zeros(DIM, np.float32), "R": np.zeros(2 * BLOCK, np.float32), "G": 0.3 * normal(DIM, GROUPS), "g": group,
        "O": 0.3 * rng.normal(0, DIM**-0.5, (GROUPS, DIM, MEMBERS)).astype(np.float32), "o": prior.reshape(GROUPS, MEMBERS) - group[:, None],
    }


def blocks(rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Padded embedding rows in blocks, and where each id's prediction stands.

    Per text: a block of padding, then the start and its ids but the last. The id at
    place p of the flat blocks is what the next id is predicted from.
    """
    n_blocks = -(-lengths // BLOCK) + 1
    first = (np.cumsum(n_blocks) - n_blocks + 1) * BLOCK
    out = np.zeros(int(n_blocks.sum()) * BLOCK, np.uint16)
    begin = np.cumsum(lengths) - lengths
    place = np.repeat(first - begin, lengths) + np.arange(len(rows))
    # every id but a text's last stands one place after its own prediction
    inner = np.ones(len(rows), bool)
    inner[(begin + lengths - 1)[lengths > 0]] = False
    out[place[inner] + 1] = rows[inner]
    out[first[lengths > 0]] = 1
    return out.reshape(-1, BLOCK), place


def _pairs(x: np.ndarray) -> np.ndarray:
    """(pieces, blocks, BLOCK, width) seen as each block with the one before it; a view."""
    n, m, _, width = x.shape
    return np.lib.stride_tricks.as_strided(x, (n, m - 1, 2 * BLOCK, width), x.strides)


def _exp(z: np.ndarray, most: float = 40) -> np.ndarray:
    np.minimum(z, most, out=z)
    return np.exp(z, out=z)


def _by_group(target: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by group, and each group with its slice of it."""
    group = (target // MEMBERS).astype(np.int8)
    order = np.argsort(group, kind="stable")
    ends = np.searchsorted(group[order], np.arange(GROUPS + 1, dtype=np.int8)).tolist()
    return order, [(g, ends[g], ends[g + 1]) for g in range(GROUPS) if ends[g] < ends[g + 1]]


def prepared(w: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables laid out for scoring: query and skip; key and value; position bias.

    A last key number hides padding and a last value number sums the attention, so
    neither needs a pass of its own.
    """
    y = w["E"] @ w["W"]
    q, k, v, s = y[:, :KEY], y[:, KEY : 2 * KEY], y[:, 2 * KEY : 2 * KEY + DIM], y[:, 2 * KEY + DIM :] + w["s"]
    one = np.ones((len(y), 1), np.float32)
    hide = np.zeros_like(one)
    hide[0] = HIDDEN
    return np.hstack([q, one, s]), np.hstack([k, hide, v, one]), (CAUSAL + w["R"][DISTANCE]).astype(np.float32)


def _hidden(ready: tuple, flat: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Hidden vectors of blocks lo to hi, each row gathered once."""
    query, keyed, bias = ready
    qs, kv = query.take(flat[lo:hi], axis=0), keyed.take(flat[None, lo - 1 : hi], axis=0)
    pairs = _pairs(kv)[0]
    a = qs[:, :, : KEY + 1] @ pairs[:, :, : KEY + 1].transpose(0, 2, 1)
    a += bias
    h = _exp(a, 20) @ pairs[:, :, KEY + 1 :]
    out = h[:, :, :DIM] * (1 / (h[:, :, DIM:] + np.float32(1e-9)))
    out += qs[:, :, KEY + 1 :]
    np.maximum(out, 0, out=out)
    return out.reshape(-1, DIM)


_ONES = np.ones(max(GROUPS, MEMBERS, DIM), np.float32)


def log_probabilities(w: Weights, vocabulary: Vocabulary, ids: np.ndarray, lengths: np.ndarray, ready: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of every id of texts laid end to end: the natural log of its probability, and of that of any id that begins a word."""
    ready = ready or prepared(w)
    flat, place = blocks(vocabulary.row[ids], lengths)
    target = np.zeros(flat.size, np.int16)
    target[place] = vocabulary.kind[ids]
    target = target.reshape(-1, BLOCK)
    out, begin = np.empty(flat.size, np.float32), np.empty(flat.size, np.float32)
    for lo in range(1, len(flat), BATCH):
        hi = min(lo + BATCH, len(flat))
        wanted = target[lo:hi].ravel()
        order, groups = _by_group(wanted)
        # sorted by group once, so that each group is a slice
        h, wanted = _hidden(ready, flat, lo, hi).take(order, axis=0), wanted.take(order)
        z = h @ w["G"]
        z += w["g"]
        all_groups = _exp(z) @ _ONES[:GROUPS]
        p = z.ravel().take(np.arange(0, z.size, GROUPS) + wanted // MEMBERS) / all_groups
        begins = z[:, :BEGINNING] @ _ONES[:BEGINNING] / all_groups
        for g, at, end in groups:
            z = h[at:end] @ w["O"][g]
            z += w["o"][g]
            _exp(z)
            p[at:end] *= z.ravel().take(np.arange(0, z.size, MEMBERS) + wanted[at:end] % MEMBERS) / (z @ _ONES[:MEMBERS])
        order += lo * BLOCK
        out[order], begin[order] = np.log(p), np.log(begins)
    return out[place] + vocabulary.inside[ids], begin[place]


def squares(w: Weights) -> Weights:
    """Adagrad's sums of squared gradients before the first step."""
    return {k: np.full_like(x, 1e-3) for k, x in w.items()}


def _shares_less_one(h: np.ndarray, w: np.ndarray, b: np.ndarray, wanted: np.ndarray, part: np.float32) -> np.ndarray:
    """Gradient of the log loss, times part: softmax(h @ w + b), less 1 at each row's wanted column."""
    z = h @ w
    z += b
    _exp(z)
    z *= (part / (z @ _ONES[: z.shape[1]]))[:, None]
    z.ravel()[np.arange(0, z.size, z.shape[1]) + wanted] -= part
    return z


def train(w: Weights, square: Weights, vocabulary: Vocabulary, ids: np.ndarray, lengths: np.ndarray, rate: float = 0.3, batch: int = 16, seed: int = 0) -> tuple[Weights, Weights]:
    """One pass of Adagrad over texts laid end to end, ``batch`` pieces a step in random order; goes on from w and square."""
    w, square = {k: x.copy() for k, x in w.items()}, {k: x.copy() for k, x in square.items()}
    flat, place = blocks(vocabulary.row[ids], lengths)
    target = np.full(flat.size, -1, np.int16)
    target[place] = vocabulary.kind[ids]
    starts = np.arange(1, len(flat), PIECE)
    spare = (starts[-1] + PIECE - len(flat)) * BLOCK
    flat = np.r_[flat.ravel(), np.zeros(spare, np.uint16)].reshape(-1, BLOCK)
    target = np.r_[target, np.full(spare, -1, np.int16)].reshape(-1, BLOCK)
    order = np.random.default_rng(seed).permutation(starts)
    s_at = 2 * KEY + DIM
    for part in np.array_split(order, -(-len(order) // batch)):
        at = part[:, None] + np.arange(-1, PIECE)
        rows, t, shape = flat[at].astype(np.intp), target[at[:, 1:]].ravel(), (len(part), PIECE + 1, BLOCK)
        real = np.flatnonzero(t >= 0)
        if not len(real):
            continue
        query, keyed, bias = prepared(w)
        qs, pairs = query.take(rows[:, 1:], axis=0), _pairs(keyed.take(rows, axis=0))
        q, k, v = qs[..., :KEY], pairs[..., :KEY], pairs[..., KEY + 1 : KEY + 1 + DIM]
        a = qs[..., : KEY + 1] @ pairs[..., : KEY + 1].transpose(0, 1, 3, 2)
        a += bias
        attended = _exp(a, 20) @ pairs[..., KEY + 1 :]
        share = 1 / (attended[..., DIM:] + np.float32(1e-9))
        a *= share
        attended = attended[..., :DIM] * share
        h = attended + qs[..., KEY + 1 :]
        h = np.maximum(h, 0, out=h).reshape(-1, DIM)
        # the output, sorted by group
        by, groups = _by_group(t.take(real))
        real = real.take(by)
        h, t_of = h.take(real, axis=0), t.take(real)
        each, one = np.float32(1 / len(real)), np.ones(len(real), np.float32)
        d = _shares_less_one(h, w["G"], w["g"], t_of // MEMBERS, each)
        dh = d @ w["G"].T
        grad = {"G": h.T @ d, "g": one @ d, "O": np.zeros_like(w["O"]), "o": np.zeros_like(w["o"])}
        t_of %= MEMBERS
        for g, lo, hi in groups:
            d = _shares_less_one(h[lo:hi], w["O"][g], w["o"][g], t_of[lo:hi], each)
            dh[lo:hi] += d @ w["O"][g].T
            np.matmul(h[lo:hi].T, d, out=grad["O"][g])
            np.matmul(one[lo:hi], d, out=grad["o"][g])
        dh *= h > 0
        grad["s"] = one @ dh
        dh_all = np.zeros((len(t), DIM), np.float32)
        dh_all[real] = dh
        dh = dh_all.reshape(shape[0], PIECE, BLOCK, DIM)
        # back through the attention
        da = dh @ v.transpose(0, 1, 3, 2)
        attended *= dh
        da -= (attended @ _ONES[:DIM])[..., None]
        da *= a
        dkv = np.empty((shape[0], PIECE, 2 * BLOCK, KEY + DIM), np.float32)
        np.matmul(da.transpose(0, 1, 3, 2), q, out=dkv[..., :KEY])
        np.matmul(a.transpose(0, 1, 3, 2), dh, out=dkv[..., KEY:])
        dy = np.empty((*shape, WIDTH), np.float32)
        dy[:, 0] = 0
        np.matmul(da, k, out=dy[:, 1:, :, :KEY])
        dy[:, 1:, :, KEY:s_at] = dkv[:, :, BLOCK:]
        dy[:, :-1, :, KEY:s_at] += dkv[:, :, :BLOCK]
        dy[:, 1:, :, s_at:] = dh
        dy, rows = dy.reshape(-1, WIDTH), rows.ravel()
        by_pair = np.ones(len(part) * PIECE, np.float32) @ da.reshape(-1, 2 * BLOCK * BLOCK)
        grad |= {"W": w["E"].take(rows, axis=0).T @ dy, "R": np.bincount(DISTANCE.ravel(), weights=by_pair, minlength=2 * BLOCK).astype(np.float32)}
        grad["E"] = np.stack([np.bincount(rows, weights=x, minlength=len(w["E"])) for x in w["W"] @ dy.T], axis=1).astype(np.float32)
        for key, g in grad.items():
            square[key] += g * g
            w[key] -= rate * g / np.sqrt(square[key])
    return w, square
