"""Exact top-k inner products over an impact-ordered, score-at-a-time index.

Vectors are quantised to integers and dealt evenly into blocks.  Each block is
indexed once and written: every dimension is a posting list sorted by value and
cut into ``LEVELS`` segments; an impact is the distance from the end of the range
that the query's sign disfavours, so all impacts are nonnegative.  For a query,
segments of all dimensions are processed by descending impact bound.  What is
unprocessed can add at most the sum of the next segments' bounds: as soon as
only a small share of the block can still reach the k-th score - a proof, not a
guess - those members are scored exactly from the whole vectors.  If that never
happens all segments are processed.  Nothing is approximate.

Queries come in waves of at most ``WAVE_BYTES``, which are broadcast, so vectors
are never shuffled again: a wave reads the index.  The scores reached so far are
a floor for what follows: within a task from block to block, and from a
sixteenth of the blocks, which a wave visits first, to all others.  A block that
can't reach the floor is left at once.

Vectors that are null, empty, or hold null or non-finite components take no
part, nor do rows without an id, nor vectors of another length than the query.  A
query's own rows are those with its id.  Repeated candidate ids are separate rows.
Repeated rows of a query are one query; if the vectors of one query id differ,
each has a ranking of its own.  Ties go to the smaller id.  Components may be of
any size; scores beyond 64 bits count as the nearest long.  No query or candidate:
an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

SCALE, K, LEVELS, ROUNDS, BLOCK, LEAST_BLOCKS, FIRST, WAVE_BYTES = 1024, 10, 8, 8, 16384, 4, 16, 16_000_000
_LONG = (-(2**63), 2**63 - 1)


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v (floor(scale * x), whole numbers as doubles), dims."""
    x = F.col("embedding")
    sound = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null").where(sound)
    # from 2^53 on a double is a whole number
    return rows.select("vec_id", F.transform("embedding", lambda c: F.when(F.abs(c * scale) < 2.0**53, F.floor(c * scale).cast("double")).otherwise(F.least(F.greatest(c * scale, F.lit(-1.7e308)), F.lit(1.7e308)))).alias("v"), F.size("embedding").alias("dims"))


def limit(dims: int) -> int:
    """Components below that can't overflow a sum of products, nor of differences."""
    return int((2**60 / dims) ** 0.5)


class Block:
    """Posting segments of a block of vectors of one length; vectors with a component beyond the limit are scored one by one."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, order: np.ndarray | None = None):
        huge = (np.abs(v) >= limit(v.shape[1])).any(axis=1)
        self.far_ids, self.far = ids[huge], [[int(x) for x in row] for row in v[huge]]
        self.ids, self.v = ids[~huge], v[~huge].astype(np.int64)
        n = len(self.ids)
        # ascending values of each dimension
        self.order = order if order is not None else np.argsort(self.v, axis=0, kind="stable").T.astype(np.int32)
        self.values = np.ascontiguousarray(np.take_along_axis(self.v.T, self.order, axis=1))
        self.cut = np.unique(np.linspace(0, n, min(LEVELS, n) + 1).astype(np.int64))

    def top(self, query: np.ndarray, own: int, k: int, floor: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the k best (of those that reach the floor), ties to smaller ids."""
        if (np.abs(query) >= limit(len(query))).any():
            far, far_ids = [*self.far, *self.v.tolist()], np.r_[self.far_ids, self.ids]
            near = np.zeros(0, np.int64), np.zeros(0, np.int64)
        else:
            far, far_ids = self.far, self.far_ids
            near = self._near(query.astype(np.int64), own, k, floor)
        if not far:
            return near
        q = [int(x) for x in query]
        score = np.array([min(max(sum(a * b for a, b in zip(q, row)), _LONG[0]), _LONG[1]) for row in far], np.int64)
        use = far_ids != own
        return best_of(np.r_[near[0], far_ids[use]], np.r_[near[1], score[use]], k)

    def _near(self, query: np.ndarray, own: int, k: int, floor: int | None) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.ids)
        acc, segments, offset = np.zeros(n, np.int64), [], 0
        for d in np.flatnonzero(query) if n else ():
            q, x = int(query[d]), self.values[d]
            base, spans = (int(x[0]), range(len(self.cut) - 2, -1, -1)) if q > 0 else (int(x[-1]), range(len(self.cut) - 1))
            offset += q * base
            for s in spans:
                a, z = self.cut[s], self.cut[s + 1]
                segments.append((q * (int(x[z - 1] if q > 0 else x[a]) - base), int(d), a, z, q, base))
        segments.sort(key=lambda s: -s[0])
        ahead: dict[int, list[int]] = {}
        for s in segments:
            ahead.setdefault(s[1], []).append(s[0])
        at = dict.fromkeys(ahead, 0)
        least_acc = -1 if floor is None else floor - offset
        few, possible, mine = max(4 * k, n // 16), np.arange(n), self.ids == own
        rest = sum(x[0] for x in ahead.values())
        if rest < least_acc:  # nothing here reaches the floor
            return self.ids[:0], acc[:0]
        for part in np.array_split(np.arange(len(segments)), min(ROUNDS, max(len(segments), 1))):
            for j in part:
                _, d, a, z, q, base = segments[j]
                acc[self.order[d, a:z]] += q * (self.values[d, a:z] - base)
                at[d] += 1
            rest = sum(ahead[d][i] for d, i in at.items() if i < len(ahead[d]))
            least = acc.copy()
            least[mine] = -1
            kth = max(int(np.partition(least, n - k)[n - k]) if n > k else -1, least_acc)
            possible = np.flatnonzero(least + rest >= kth)
            if len(possible) <= few:
                break
        possible = possible[~mine[possible]]
        return best_of(self.ids[possible], self.v[possible] @ query, k)


def best_of(ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    best = np.lexsort((ids, -score.astype(object) if (score == _LONG[0]).any() else -score))[:k]
    return ids[best], score[best]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def build_index(vectors: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """One written row for each block: dims, b, ids, v, order."""
    rows = quantised(vectors)
    size = rows.count()
    # small tables are cut finer, so that several tasks share them; rows are dealt by number, so an id that repeats is no hot block
    n = max(-(-size // block), min(LEAST_BLOCKS, -(-size // 512)), 1)

    def index(t: pa.Table) -> pa.Table:
        ids, v = t.column("vec_id").to_numpy(), _matrix(t.column("v"))
        made = Block(ids, v)
        return pa.table({"dims": pa.array([v.shape[1]], pa.int32()), "b": pa.array([t.column("b")[0].as_py()], pa.int32()), "ids": pa.array([ids.astype(np.int64).tobytes()], pa.binary()), "v": pa.array([v.tobytes()], pa.binary()), "postings": pa.array([made.order.tobytes()], pa.binary())})

    dealt = rows.withColumn("b", F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int"))
    return scratch.write(dealt.groupBy("dims", "b").applyInArrow(index, "dims int, b int, ids binary, v binary, postings binary"))


def _visit(shared, k: int):
    """Runs a wave of queries over the blocks of a task; scores of one block are the floor of the next."""
    def run(batches):
        number, own, vectors, floors = shared.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in number]
        for batch in batches:
            for r in range(batch.num_rows):
                dims = batch.column("dims")[r].as_py()
                ids = np.frombuffer(batch.column("ids")[r].as_buffer(), np.int64)
                v = np.frombuffer(batch.column("v")[r].as_buffer(), np.float64).reshape(len(ids), dims)
                block = Block(ids, v, np.frombuffer(batch.column("postings")[r].as_buffer(), np.int32).reshape(dims, -1))
                for i, q in enumerate(vectors):
                    if len(q) != dims:
                        continue
                    found = best[i]
                    floor = max((x for x in (floors[i], int(found[1][-1]) if len(found[1]) == k else None) if x is not None), default=None)
                    new = block.top(q, own[i], k, floor)
                    best[i] = best_of(np.r_[found[0], new[0]], np.r_[found[1], new[1]], k)
        size = [len(x) for x, _ in best]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(number, size)), pa.array(np.repeat(own, size)), pa.array(np.concatenate([x for x, _ in best])), pa.array(np.concatenate([x for _, x in best]))], ["number", "query_id", "vec_id", "score"])

    return run


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of ``vectors`` for each row of ``queries`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    index = build_index(vectors, scratch, block)
    asked = scratch.write(quantised(queries).dropDuplicates(["vec_id", "v"]).withColumn("number", F.monotonically_increasing_id()))
    size = asked.agg(F.coalesce(F.sum(F.col("dims").cast("long") * 8), F.lit(0))).first()[0]
    waves, out = max(-(-size // wave_bytes), 1), []
    rank = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), "vec_id"))
    for w in range(waves):
        t = asked.where(F.pmod(F.xxhash64("number"), F.lit(waves)) == w).select("number", "vec_id", "v").toArrow()
        if not t.num_rows:
            continue
        number, own = t.column("number").to_numpy(), t.column("vec_id").to_numpy()
        wave = [np.array(x, float) for x in t.column("v").to_pylist()]

        def visit(blocks: DataFrame, floors: list) -> DataFrame:
            shared = spark.sparkContext.broadcast((number, own, wave, floors))
            found = blocks.mapInArrow(_visit(shared, k), "number long, query_id long, vec_id long, score long")
            return scratch.write(found.withColumn("rank", rank).where(F.col("rank") <= k))

        first = visit(index.where(F.col("b") % FIRST == 0), [None] * len(wave))
        known = {r["number"]: r["score"] for r in first.where(F.col("rank") == k).select("number", "score").collect()}  # one row for each query of the wave
        rest = visit(index.where(F.col("b") % FIRST != 0), [known.get(x) for x in number.tolist()])
        out += [first.drop("rank"), rest.drop("rank")]
    if not out:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    scratch.keep_only(*[x for x in scratch.tables if "rank" in x.columns])
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
