"""Toxicity: a counterfactual-regularised linear classifier.

Features are hashed words (presence in the text).  A logistic regression is
fitted by proximal gradient steps with an L1 penalty, so that words which say
nothing weigh nothing and long texts do not drift.  For every labelled text
that names an identity, copies with the terms swapped for each other one of
their group are made, and the squared change of the score, averaged over a text's
copies, is penalised: the model learns not to move when only the group that is
mentioned changes.

It is fitted on at most ``MAX_TRAIN`` labelled documents, those with the smallest
hashes of doc_id, and of these on as many as hold ``MAX_BYTES`` of distinct words
together (documented parameters); every document is scored, whole.  Where rows of
one labelled doc_id differ, the one with the smallest words counts.
Null and empty texts get the score of the intercept.  With no label at all the
score is 0.  Labels repeated for a doc_id count once, toxic if any says so;
null labels are left out.  Repeated documents each get a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, slices, texts
from .langid import held_out

MAX_TRAIN, MAX_BYTES, LOG2, MIN_DOCS, L1, COUNTERFACTUAL, STEPS, LIMIT = 10_000, 64_000_000, 18, 4, 1e-4, 1.0, 200, 0.3
# Groups of identity terms that are swapped for each other.
IDENTITIES = (("women", "men"), ("woman", "man"), ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"), ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"), ("black", "white", "asian", "latino", "arab"), ("gay", "straight", "lesbian", "bisexual", "transgender"), ("immigrants", "refugees", "citizens"), ("disabled", "deaf", "blind"))
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def features(text: bytes) -> set[bytes]:
    return set(text.translate(_TABLE).split())


def bucket(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 5) >> (64 - LOG2)


def swaps(words: set[bytes], groups=IDENTITIES) -> list[set[bytes]]:
    """The words with their identity terms moved on by one, two, ... places in their groups: each other term comes once."""
    named = [(a, g, i) for g in groups for i, a in enumerate(g) if a.encode() in words]
    if not named:
        return []
    rest = words - {a.encode() for a, _, _ in named}
    turns = range(1, max((len(g) for _, g, _ in named), default=1))
    out = [rest | {g[(i + k) % len(g)].encode() for _, g, i in named} for k in turns]
    return [x for x in out if x != words]


class _Rows:
    """A binary sparse matrix by rows."""

    def __init__(self, rows: list[np.ndarray]):
        self.n, size = len(rows), np.array([len(r) for r in rows], np.int64)
        self.row, self.col = np.repeat(np.arange(self.n), size), np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n)

    def back(self, x: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.col, x[self.row], width)


def fit(words: list[set[bytes]], labels: list[int], groups=IDENTITIES, counterfactual: float = COUNTERFACTUAL, l1: float = L1, steps: int = STEPS, min_docs: int = MIN_DOCS) -> np.ndarray:
    """Weights of the buckets; the last is the intercept."""
    out = np.zeros((1 << LOG2) + 1)
    if not words:
        out[-1] = -np.inf
        return out
    y = np.array(labels, float)
    rows = [np.unique([bucket(w) for w in sorted(x)]).astype(np.int64) for x in words]
    copies = [(x, swaps(x, groups)) for x in words]
    pairs = [(x, z) for x, own in copies for z in own]
    part = np.array([1 / len(own) for _, own in copies for _ in own])  # a text's copies count as one
    df = np.bincount(np.concatenate([*rows, np.zeros(0, np.int64)]), minlength=1 << LOG2)
    for before, after in pairs:
        for w in after - before:  # a term that only a swap brings has a weight too
            df[bucket(w)] += min_docs
    used = np.flatnonzero(df >= min_docs)
    at = np.full(1 << LOG2, -1)
    at[used] = np.arange(len(used))
    local = lambda r: (k := at[r])[k >= 0]
    x = _Rows([local(r) for r in rows])
    gone = _Rows([local(np.unique([bucket(w) for w in sorted(a - b)]).astype(np.int64)) for a, b in pairs])
    come = _Rows([local(np.unique([bucket(w) for w in sorted(b - a)]).astype(np.int64)) for a, b in pairs])
    width, n, m = len(used), len(y), max(sum(bool(own) for _, own in copies), 1)
    p = min(max(y.mean(), 1e-4), 1 - 1e-4)
    w, bias = np.zeros(width), np.log(p / (1 - p))
    v, vb, t, step = w.copy(), bias, 1.0, 1.0

    def loss(w, bias):
        z = x.times(w) + bias
        change = come.times(w) - gone.times(w)
        return (np.logaddexp(0, z) - y * z).mean() + counterfactual * (part * change**2).sum() / m, z, change

    for _ in range(steps):
        f, z, change = loss(v, vb)
        r = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y) / n
        g = x.back(r, width) + 2 * counterfactual / m * (come.back(part * change, width) - gone.back(part * change, width))
        while True:
            new = v - step * g
            new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
            new_bias = vb - step * r.sum()
            d, db = new - v, new_bias - vb
            if loss(new, new_bias)[0] <= f + g @ d + r.sum() * db + (d @ d + db * db) / (2 * step) + 1e-12:
                break
            step /= 2
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t2 * (new - w), new_bias + (t - 1) / t2 * (new_bias - bias)
        w, bias, t, step = new, new_bias, t2, step * 1.3
    out[used], out[-1] = w, bias
    return out


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN, most_bytes: int = MAX_BYTES) -> np.ndarray:
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # at most ``most`` rows: small enough to broadcast

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), pa.array([b" ".join(sorted(features(x))) for x in texts(part)], pa.binary())], ["doc_id", "toxic", "words"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(sample), "doc_id").select("doc_id", "text", F.col("toxic").cast("int")).mapInArrow(run, "doc_id long, toxic int, words binary")
    one = Scratch(docs.sparkSession, "toxicity").write(rows.groupBy("doc_id", "toxic").agg(F.min("words").alias("words")))  # at most ``most`` rows
    upto = F.sum(F.octet_length("words")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    got = one.withColumn("upto", upto).where(F.col("upto") <= most_bytes).select("doc_id", "toxic", "words").toArrow()
    order = np.argsort(got.column("doc_id").to_numpy())
    words, toxic = got.column("words").to_pylist(), got.column("toxic").to_pylist()
    del got
    known: dict[bytes, bytes] = {}  # a word is kept once, however many texts have it
    sets = [{known.setdefault(w, w) for w in words[i].split()} for i in order]
    del words
    return fit(sets, [toxic[i] for i in order])


def score_words(words: set[bytes], weights: np.ndarray) -> float:
    z = weights[-1] + sum(sorted(weights[list({bucket(w) for w in words})].tolist()))
    return float(1 / (1 + np.exp(-max(z, -700.0)))) if z > -np.inf else 0.0


def score(docs: DataFrame, weights: np.ndarray, limit: float = LIMIT) -> DataFrame:
    """doc_id, score, predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                out = [score_words(features(x), shared.value) for x in texts(part)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.float64()), pa.array([int(s >= limit) for s in out], pa.int32())], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, predicted int")
