"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of about 400 bytes. Every passage is encoded as
a fixed vector (character-class bigrams and word statistics). The model learns,
from document labels only, gated attention weights over the passages and a score
of the attention-weighted passage vector. It is trained in numpy on a bounded,
documented sample of labelled documents; every passage of every document is
encoded and weighed when scoring.

Defined cases: null text counts as empty; an empty text is one empty passage, so
it gets a score; a very long text has as many passages as its length asks for. Equal
texts have equal scores, and a score of exactly the threshold is not rejected. Repeated
rows get rows of their own. Without any label, or with one class only, every score is
that class's smoothed share. Extra columns of the given table pass through ``scored``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PASSAGE = 400
#: Labelled documents of each class to learn from, about.
SAMPLE = 2000
THRESHOLD = 0.7
HIDDEN = 24
EPOCHS = 30

# Byte classes: lower, upper, digit, space, line break, comma and full stop, other
# signs in four groups, bytes above ASCII.
CLASS = np.full(256, 10, np.uint8)
CLASS[ord("a") : ord("z") + 1] = 0
CLASS[ord("A") : ord("Z") + 1] = 1
CLASS[ord("0") : ord("9") + 1] = 2
CLASS[[32, 9, 13]] = 3
CLASS[10] = 4
CLASS[[ord(","), ord(".")]] = 5
CLASS[[ord(c) for c in "!?"]] = 6
CLASS[[ord(c) for c in "*$%&#@"]] = 7
CLASS[[ord(c) for c in "|/\\<>{}[]_~^=+"]] = 8
CLASS[[ord(c) for c in "'\"-:;()`"]] = 9
CLASS[:9] = CLASS[11:13] = CLASS[14:32] = CLASS[127] = 9
CLASS[128:] = 10
KINDS = 11
N_FEATURES = KINDS * KINDS + KINDS + 8


def encode(text: str | None) -> np.ndarray:
    """(passages, features) of a whole text."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, round(len(raw) / PASSAGE))
    bounds = np.arange(n + 1) * len(raw) // n
    passage = np.repeat(np.arange(n), np.diff(bounds))
    kind = CLASS[raw].astype(np.int64)
    length = np.maximum(np.diff(bounds), 1)[:, None]
    single = np.bincount(passage * KINDS + kind, minlength=n * KINDS).reshape(n, -1)
    pair = np.bincount(passage[1:] * KINDS**2 + kind[:-1] * KINDS + kind[1:], minlength=n * KINDS**2).reshape(n, -1) if len(raw) > 1 else np.zeros((n, KINDS**2))
    # words: runs of non-space; repeats show by the hash of a word and of its neighbours
    solid = (kind != 3) & (kind != 4)
    edge = np.diff(np.r_[False, solid, False].astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    words = np.zeros((n, 8))
    if len(starts):
        with np.errstate(over="ignore"):
            weight = raw.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            weight ^= weight >> np.uint64(31)
            place = (np.arange(len(raw)) - np.repeat(starts, np.diff(np.r_[starts, len(raw)]))) if starts[0] == 0 else np.arange(len(raw))
            if starts[0] != 0:
                place[starts[0] :] -= np.repeat(starts, np.diff(np.r_[starts, len(raw)]))
            weight *= np.uint64(2) * place.astype(np.uint64) + np.uint64(1)
            word = np.add.reduceat(np.where(solid, weight, np.uint64(0)), starts)
        at = passage[starts]
        long = ends - starts
        count = np.bincount(at, minlength=n)
        per = np.maximum(count, 1)
        order = np.lexsort((word, at))
        fresh = np.r_[True, (word[order][1:] != word[order][:-1]) | (at[order][1:] != at[order][:-1])]
        repeats = np.r_[False, word[1:] == word[:-1]]
        earlier = np.unique(word, return_index=True, return_inverse=True)
        seen = np.arange(len(word)) != earlier[1][earlier[2]]
        words[:, 0] = np.bincount(at[order], weights=fresh, minlength=n) / per
        words[:, 1] = np.bincount(at, weights=repeats, minlength=n) / per
        words[:, 2] = np.bincount(at, weights=seen, minlength=n) / per
        words[:, 3] = np.bincount(at, weights=np.minimum(long, 40), minlength=n) / per / 10
        words[:, 4] = np.bincount(at, weights=long > 20, minlength=n) / per
        words[:, 5] = np.bincount(at, weights=long == 1, minlength=n) / per
        words[:, 6] = np.log1p(count) / 5
    words[:, 7] = np.log1p(len(raw)) / 10
    return np.hstack([np.sqrt(pair / length), single / length, words]).astype(np.float32)


@dataclass
class Model:
    """Gated attention: a_k ~ exp(w . (tanh(V h_k) * sigmoid(U h_k))), score = sigmoid(c . h + b) with h the weighted passage."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    prior: float = 0.5

    def score(self, passages: np.ndarray) -> float:
        if not self.weights:
            return self.prior
        w = self.weights
        x = (passages - self.mean) / self.scale
        h = np.tanh(x @ w["P"] + w["p"])
        e = (np.tanh(h @ w["V"]) * _sigmoid(h @ w["U"])) @ w["w"]
        a = np.exp(e - e.max())
        return float(_sigmoid((a @ h) / a.sum() @ w["c"] + w["b"][0]))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 0) -> Model:
    """Adam on the bags' cross-entropy, classes weighted to the given shares."""
    if not len(bags) or labels.min() == labels.max():
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), {}, float((labels.sum() + 1) / (len(labels) + 2)))
    rng = np.random.default_rng(seed)
    rows = np.vstack(bags)
    mean, scale = rows.mean(axis=0), rows.std(axis=0) + 0.05
    bags = [((b - mean) / scale).astype(np.float32) for b in bags]
    f, h = rows.shape[1], HIDDEN
    w = {"P": rng.normal(0, f**-0.5, (f, h)), "p": np.zeros(h), "V": rng.normal(0, h**-0.5, (h, h)), "U": rng.normal(0, h**-0.5, (h, h)), "w": rng.normal(0, h**-0.5, h), "c": rng.normal(0, h**-0.5, h), "b": np.zeros(1)}
    m, v, step = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0
    balance = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-6), 0.5 / max(1 - labels.mean(), 1e-6))
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for part in np.array_split(order, max(1, len(order) // 64)):
            x = np.vstack([bags[i] for i in part])
            sizes = np.array([len(bags[i]) for i in part])
            first, of = np.r_[0, np.cumsum(sizes)[:-1]], np.repeat(np.arange(len(part)), sizes)
            hid = np.tanh(x @ w["P"] + w["p"])
            tv, su = np.tanh(hid @ w["V"]), _sigmoid(hid @ w["U"])
            e = (tv * su) @ w["w"]
            a = np.exp(e - np.maximum.reduceat(e, first)[of])
            a /= np.add.reduceat(a, first)[of]
            z = np.add.reduceat(a[:, None] * hid, first, axis=0)
            d = (_sigmoid(z @ w["c"] + w["b"]) - labels[part]) * balance[part] / len(part)
            dz = d[:, None] * w["c"]
            da = (dz[of] * hid).sum(axis=1)
            de = a * (da - np.add.reduceat(a * da, first)[of])
            dg = de[:, None] * w["w"]
            dtv, dsu = dg * su * (1 - tv**2), dg * tv * su * (1 - su)
            dh = a[:, None] * dz[of] + dtv @ w["V"].T + dsu @ w["U"].T
            dx = dh * (1 - hid**2)
            grad = {"P": x.T @ dx, "p": dx.sum(axis=0), "V": hid.T @ dtv, "U": hid.T @ dsu, "w": (tv * su).T @ de, "c": z.T @ d, "b": np.array([d.sum()])}
            step += 1
            rate = 0.004 * min(1, 1.5 - epoch / epochs)
            for k, g in grad.items():
                g = g + 1e-4 * w[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean.astype(np.float32), scale.astype(np.float32), {k: x.astype(np.float32) for k, x in w.items()})


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from about ``sample`` labelled documents of each class, chosen by a hash of doc_id.

    docs are those that may be learned from; a document labelled twice counts by its larger label.
    """
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    # which documents to learn from is settled on ids alone; the few picked are broadcast to the texts
    marked = docs.select("doc_id").join(marks, "doc_id")
    counts = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    slots = 1 << 20
    share = F.lit(0)
    for label, n in counts.items():
        share = F.when(F.col("label") == label, int(slots * min(1.0, sample / n)) + 1).otherwise(share)
    picks = marked.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(slots)) < share).distinct()
    picked = docs.select("doc_id", "text").join(F.broadcast(picks), "doc_id")

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "label": b["label"], "bag": [encode(t).tobytes() for t in b["text"]]})

    rows = picked.mapInPandas(encoded, "doc_id long, label int, bag binary").toPandas().sort_values(["doc_id", "bag"])
    return fit([np.frombuffer(x, np.float32).reshape(-1, N_FEATURES) for x in rows["bag"]], rows["label"].to_numpy(np.float64))


def scored(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the column ``out``: higher where label 1 is likelier."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(encode(t)) for t in texts], dtype=float)

    return docs.withColumn(out, score(F.col(text)))
