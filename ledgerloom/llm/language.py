"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Character 1- to 3-grams of the lower-cased text are hashed to 2^15 features.
Document frequencies come from every document that may be learned from. The
weights are trained by follow-the-regularised-leader (FTRL-proximal) with an
elastic-net penalty on a bounded, documented sample of each language; the
temperature of the softmax is then fitted on a part of the sample kept aside.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
without any training language every text is ``und``. Of equal probabilities the
language that sorts first counts; very long texts are counted whole, into the same
number of features; an empty table gives no rows. Repeated rows get rows of
their own. Extra columns pass through ``predicted``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = 1 << 15
#: Documents of each language to learn from, about.
SAMPLE = 1500
UNKNOWN = "und"
ALPHA, BETA, L1, L2 = 0.5, 1.0, 2e-4, 1e-6
EPOCHS = 3


def counts(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of a whole text."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    space = (c <= 32) | (c >= 33) & (c <= 64) | (c >= 91) & (c <= 96) | (c >= 123) & (c <= 126)
    c = np.where(space, np.uint32(32), c)
    c = np.r_[np.uint32(32), c[~(space & np.r_[False, space[:-1]])], np.uint32(32)].astype(np.uint32)
    with np.errstate(over="ignore"):
        one = c * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ np.uint32(0x85EBCA6B)) * np.uint32(0xC2B2AE35) + c[1:] * np.uint32(0x27D4EB2F)
        three = (two[:-1] ^ np.uint32(0x165667B1)) * np.uint32(0x9E3779B1) + c[2:] * np.uint32(0x85EBCA77)
        h = np.concatenate([one[1:-1], two, three])
    return np.bincount((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(17), minlength=FEATURES)


def features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices and L2-normed TF-IDF values."""
    n = counts(text)
    at = np.flatnonzero(n)
    x = np.log1p(n[at]) * idf[at]
    return at, x / max(np.sqrt((x * x).sum()), 1e-9)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each feature occurs, and the number of texts; over all of docs."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(FEATURES, np.int64), 0
        for b in batches:
            for t in b["text"]:
                total += counts(t) > 0
                n += 1
        if n:
            yield pd.DataFrame({"at": np.r_[np.arange(FEATURES), -1], "n": np.r_[total, n]})

    rows = docs.select("text").mapInPandas(partial, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    found = np.zeros(FEATURES + 1)
    found[rows["at"]] = rows["n"].fillna(0)
    return found[:FEATURES], int(found[-1])


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def probabilities(self, text: str) -> np.ndarray:
        at, x = features(text, self.idf)
        return _softmax((x @ self.weights[at] + self.bias) / self.temperature)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, languages: list[str], idf: np.ndarray, epochs: int = EPOCHS, seed: int = 0) -> Model:
    """FTRL-proximal, one document at a time; every tenth document only calibrates."""
    k = len(languages)
    z, n = np.zeros((FEATURES + 1, k)), np.zeros((FEATURES + 1, k))

    def solved(at: np.ndarray | slice) -> np.ndarray:
        return np.where(np.abs(z[at]) <= L1, 0.0, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    rng = np.random.default_rng(seed)
    aside = np.arange(len(rows)) % 10 == 9
    train = np.flatnonzero(~aside)
    # languages weigh equally, however many documents of each there are
    weight = (len(train) / k) / np.maximum(np.bincount(labels[train], minlength=k), 1)
    for _ in range(epochs):
        for i in rng.permutation(train):
            at, x = np.r_[rows[i][0], FEATURES], np.r_[rows[i][1], 0.1]
            w = solved(at)
            p = _softmax(x @ w)
            p[labels[i]] -= 1
            g = x[:, None] * p * min(weight[labels[i]], 10.0)
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = solved(slice(None))
    model = Model(languages, idf, w[:-1].astype(np.float32), (0.1 * w[-1]).astype(np.float32))
    logits = [(rows[i][1] @ w[rows[i][0]] + 0.1 * w[-1], labels[i]) for i in np.flatnonzero(aside)]
    if logits:
        loss = lambda t: -sum(np.log(_softmax(x / t)[y] + 1e-12) for x, y in logits)
        model.temperature = float(min(np.geomspace(0.05, 20, 60), key=loss))
    return model


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from docs (doc_id, text, lang), which are those that may be learned from."""
    docs = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    df, total = document_frequencies(docs)
    idf = (np.log((total + 1) / (df + 1)) + 1).astype(np.float32)
    per = docs.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()
    languages = [r["lang"] for r in per]
    slots = 1 << 20
    share = F.lit(0)
    for r in per:
        share = F.when(F.col("lang") == r["lang"], int(slots * min(1.0, sample / r["n"])) + 1).otherwise(share)
    picked = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(slots)) < share)

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [features(t, idf) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "lang": b["lang"], "at": [a.astype(np.uint16).tobytes() for a, _ in got], "x": [x.astype(np.float32).tobytes() for _, x in got]})

    rows = picked.mapInPandas(encoded, "doc_id long, lang string, at binary, x binary").toPandas().sort_values(["doc_id", "lang", "at"])
    if not languages:
        return Model([], idf, np.zeros((FEATURES, 0), np.float32), np.zeros(0, np.float32))
    ids = {name: i for i, name in enumerate(languages)}
    return fit(
        [(np.frombuffer(a, np.uint16).astype(np.int64), np.frombuffer(x, np.float32).astype(np.float64)) for a, x in zip(rows["at"], rows["x"])],
        rows["lang"].map(ids).to_numpy(np.int64), languages, idf,
    )


def predicted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred and score (the calibrated probability of that language)."""

    @F.pandas_udf("lang string, score double")
    def guess(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            if t is None or not model.languages:
                out.append((UNKNOWN, 0.0))
                continue
            p = model.probabilities(t)
            out.append((model.languages[int(p.argmax())], float(p.max())))
        return pd.DataFrame(out, columns=["lang", "score"])

    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    told = docs.withColumn("__told", guess(F.col(text)))
    return told.withColumn("lang_pred", F.when(lettered, F.col("__told.lang")).otherwise(UNKNOWN)).withColumn("score", F.when(lettered, F.col("__told.score")).otherwise(0.0)).drop("__told")
