"""Language identification: multinomial naive Bayes over hashed character n-grams.

Character bigrams and trigrams of the lower-cased text are hashed into
``BUCKETS`` classes.  Training sums counts per (language, bucket) over all
labelled rows into a table.  The log-probability matrix is broadcast and batches
are scored in numpy, ``CELLS`` characters at a time, however long a text is.

There may be any number of languages: the matrix has at most ``BLOCK`` of them.
More are scored block after block, each text carrying its best language so far;
the driver holds one block, a size that does not depend on the input.

Null texts and texts without a letter give ``und`` with score 0, as does
everything if there is nothing to learn from.  Ties go to the language that
sorts first.  Rows without a doc_id are not held out; repeated rows each get
a row; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices

BUCKETS_LOG2, BLOCK, CELLS, SMOOTHING = 15, 64, 1 << 20, 0.5
BUCKETS = 1 << BUCKETS_LOG2
_K = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]
_END = np.uint32(0x27D4EB2F)


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def pieces(body: str):
    """The lower-cased text, a blank at both ends, in pieces of CELLS characters; each but the first starts two characters early."""
    low = f" {body.lower()} "
    for a in range(0, len(low), CELLS):
        yield low[max(a - 2, 0) : a + CELLS], a > 0


def ngrams_of(piece: tuple[str, bool]):
    """Buckets of the bigram, then of the trigram, that end at each new character of the piece."""
    low, more = piece
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    acc = codes * _K[0]
    for n in (1, 2):
        if len(codes) <= n:
            return
        acc = (acc[:-1] ^ (acc[:-1] >> np.uint32(15))) + codes[n:] * _K[n]
        buckets = ((acc * _END) >> np.uint32(32 - BUCKETS_LOG2)).astype(np.int32)
        yield buckets[2 - n :] if more else buckets


class Model:
    """Counts (lang, bucket, n) of all languages; bucket BUCKETS counts rows. ``blocks`` gives the matrix in pieces."""

    def __init__(self, counts: DataFrame, smoothing: float = SMOOTHING, block: int = BLOCK):
        self.counts, self.smoothing, self.block = counts, smoothing, block

    def blocks(self):
        """(languages in order, log probabilities; the last column holds the priors), block by block."""
        priors = self.counts.where(F.col("bucket") == BUCKETS)
        rows, last = priors.agg(F.sum("n")).first()[0] or 0, None
        while True:
            rest = priors if last is None else priors.where(F.col("lang") > last)
            langs = [r["lang"] for r in rest.select("lang").orderBy("lang").limit(self.block).collect()]
            if not langs:
                return
            number = self.counts.sparkSession.createDataFrame(list(enumerate(langs)), "k int, lang string")  # at most ``block`` rows
            t = self.counts.join(F.broadcast(number), "lang").select("k", "bucket", "n").toArrow()
            counts = np.zeros((len(langs), BUCKETS + 1))
            counts[t.column("k").to_numpy(), t.column("bucket").to_numpy()] = t.column("n").to_numpy()
            grams = counts[:, :BUCKETS] + self.smoothing
            logs = np.empty_like(counts)
            logs[:, :BUCKETS] = np.log(grams) - np.log(grams.sum(axis=1, keepdims=True))
            logs[:, BUCKETS] = np.log(counts[:, BUCKETS]) - np.log(rows)
            yield langs, logs
            if len(langs) < self.block:
                return
            last = langs[-1]


def train(docs: DataFrame, smoothing: float = SMOOTHING) -> Model:
    """Counts over all rows with a text and a language."""

    def run(batches):
        def out():
            for lang, own in sums.items():
                (some,) = np.nonzero(own)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some.astype(np.int32)), pa.array(own[some])], ["lang", "bucket", "n"])
            sums.clear()

        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                for body, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist(), strict=True):
                    if lang not in sums and len(sums) >= 4 * BLOCK:
                        yield from out()
                    own = sums.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                    own[BUCKETS] += 1
                    for piece in pieces(body):
                        for g in ngrams_of(piece):
                            if len(g) > 2048:
                                own[:BUCKETS] += np.bincount(g, minlength=BUCKETS)
                            else:
                                np.add.at(own, g, 1)
        yield from out()

    rows = docs.where("text is not null and lang is not null").select(F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(run, "lang string, bucket int, n long")
    return Model(Scratch(docs.sparkSession, "langid").write(rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))), smoothing)


def likelihoods(body: str, logs: np.ndarray) -> np.ndarray:
    """The log likelihood of a text in each language of the block."""
    total = logs[:, BUCKETS].copy()
    for piece in pieces(body):
        for g in ngrams_of(piece):
            some, n = np.unique(g, return_counts=True)
            for a in range(0, len(some), 4096):
                total += logs[:, some[a : a + 4096]] @ n[a : a + 4096]
    return total


def score_texts(bodies: list[str | None], langs: list[str], logs: np.ndarray, before=None):
    """(language, its log likelihood, the sum of all exp(likelihood - its)) so far; ties stay with the earlier language."""
    out = []
    for i, x in enumerate(bodies):
        best, top, rest = before[i] if before else (None, -np.inf, 0.0)
        if x is not None and any(map(str.isalpha, x)):
            own = likelihoods(x, logs)
            k = int(own.argmax())
            more = max(top, own[k])
            with np.errstate(under="ignore"):
                rest = rest * (np.exp(top - more) if top > -np.inf else 0.0) + float(np.exp(own - more).sum())
            best, top = (langs[k], float(own[k])) if own[k] > top else (best, top)
        out.append((best, top, rest))
    return out


def _scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of docs, __lang and __score."""
    spark, state = docs.sparkSession, ("__best", "__top", "__rest")
    names = docs.columns
    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.lit(None).cast("string").alias(state[0]), F.lit(float("-inf")).alias(state[1]), F.lit(0.0).alias(state[2]))
    scratch = Scratch(spark, "langid")
    turn = None
    for langs, logs in model.blocks():
        if turn is not None:  # one block in memory at a time
            written = scratch.write(rows)
            scratch.keep_only(written)
            rows = written
            turn.unpersist()
        turn = spark.sparkContext.broadcast((langs, logs))
        rows = rows.mapInArrow(_turn(turn, text, state), rows.schema)
    pred, score = F.coalesce(state[0], F.lit("und")), F.when(F.col(state[0]).isNotNull(), 1 / F.col(state[2])).otherwise(0.0)
    return rows.select(*[F.col(f"`{c}`") for c in names], pred.alias("__lang"), score.alias("__score"))


def _turn(shared, text: str, state: tuple):
    def run(batches):
        langs, logs = shared.value
        for batch in batches:
            for part in slices(batch, text):
                before = list(zip(*[part.column(c).to_pylist() for c in state], strict=True))
                out = score_texts(part.column(text).to_pylist(), langs, logs, before)
                new = {c: pa.array([x[i] for x in out], part.schema.field(c).type) for i, c in enumerate(state)}
                yield pa.RecordBatch.from_arrays([new.get(c, part.column(i)) for i, c in enumerate(part.schema.names)], schema=part.schema)

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    return _scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model).select("doc_id", F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))


def keep_identified(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of docs, all columns, whose text is in a known language with that score at least."""
    return _scored(docs, model).where((F.col("__lang") != "und") & (F.col("__score") >= least)).select(*[F.col(f"`{c}`") for c in docs.columns])
