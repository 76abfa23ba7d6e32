"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most 2r bits exactly if some 64-bit value lies
within r bits of both.  With a radius of 4 every fingerprint therefore emits
the 1 + 64 + 2016 values within 2 bits of itself; equal values meet in one
bucket.  By the triangle inequality *all* members of a bucket are within the
radius of each other, so linking each to the smallest one loses no link
between groups and makes no pairs; and a bucket holds at most 2081 distinct
fingerprints, whatever the data, so no bucket is hot.

Equal fingerprints are collapsed first.  A fingerprint without any partner
need not emit its ball: of two fingerprints within 4 bits, one 32-bit half is
within 2, so that the halves share a value within one bit (66 values).  Only
fingerprints that share such a value with another go on to the full ball.
That pre-pass is exact: it never loses a pair.

Null or wordless texts have fingerprint zero and are linked like any other;
texts of fewer than four words are one shingle.  Rows that share a doc_id
each get a row; an empty table gives an empty result.  Other columns of the
input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Scratch, connected_components, parts_for, slices, texts

RADIUS, WIDTH, SEED = 4, 4, 42
_MIX = np.uint64(0x9E3779B97F4A7C15)


def simhash(text: bytes, width: int = WIDTH, seed: int = SEED) -> int:
    """Majority of the XXH64 bits of all word shingles, repeats included."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < width:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts, ends = np.r_[0, ends[:-1]].tolist(), (ends - 1).tolist()
    counts, n = np.zeros(64, np.int64), len(words) - width + 1
    for at in range(0, n, 65536):  # bounded, however long the text
        to = min(at + 65536, n)
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at:to], ends[at + width - 1 : to + width - 1], strict=True)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the unsigned fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                fp = np.array([simhash(x) for x in texts(part)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _masks(bits: int, radius: int) -> np.ndarray:
    """All values of that many bits with at most ``radius`` of them set."""
    out = {0}
    for _ in range(radius):
        out |= {m | 1 << b for m in out for b in range(bits)}
    return np.array(sorted(out), np.uint64)


def _deal(keys: np.ndarray, members: np.ndarray, n: int):
    """Rows (bucket, blob) of (key, member) pairs dealt by a hash of the key."""
    bucket = ((keys * _MIX) >> np.uint64(33)).astype(np.int64) % n
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(n + 1))
    for b in np.flatnonzero(np.diff(cut)):
        at = order[cut[b] : cut[b + 1]]
        yield int(b), keys[at].tobytes() + members[at].tobytes()


def _pairs(blobs) -> tuple[np.ndarray, np.ndarray]:
    both = [np.frombuffer(x, np.uint64).reshape(2, -1) for x in blobs]
    return np.concatenate([x[0] for x in both]), np.concatenate([x[1] for x in both])


def _balls(fps: DataFrame, keys_of, step: int, n: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fp), step):
                rows = list(_deal(*keys_of(fp[at : at + step]), n))
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["bucket", "blob"])

    return fps.select("fp").mapInArrow(run, "bucket int, blob binary")


def _grouped(keys: np.ndarray, members: np.ndarray):
    """Sorts by key and member; gives members, group numbers and the group starts."""
    order = np.lexsort((members, keys))
    keys, members = keys[order], members[order]
    first = np.r_[True, keys[1:] != keys[:-1]]
    return members, np.cumsum(first) - 1, np.flatnonzero(first)


def _half_keys(fp: np.ndarray):
    masks = _masks(32, RADIUS // 4)
    low, high = fp & np.uint64(0xFFFFFFFF), (fp >> np.uint64(32))
    keys = np.concatenate([(low[:, None] ^ masks).ravel(), (high[:, None] ^ masks).ravel() | np.uint64(1 << 40)])
    return keys, np.tile(np.repeat(fp, len(masks)), 2)


def _ball_keys(fp: np.ndarray):
    masks = _masks(64, RADIUS // 2)
    return (fp[:, None] ^ masks).ravel(), np.repeat(fp, len(masks))


def _as_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def links(distinct_fps: DataFrame, scratch: Scratch) -> DataFrame:
    """(src, dst): star links that join all fingerprints within the radius, directly or over each other."""

    def partnered(t: pa.Table) -> pa.Table:
        members, group, start = _grouped(*_pairs(t.column("blob").to_pylist()))
        size = np.diff(np.r_[start, len(members)])
        return pa.table({"fp": _as_long(np.unique(members[size[group] > 1]))})

    def stars(t: pa.Table) -> pa.Table:
        members, group, start = _grouped(*_pairs(t.column("blob").to_pylist()))
        hub = members[start][group]
        near = np.bitwise_count(members ^ hub)
        pairs = np.unique(np.stack([members, hub], axis=1)[(near > 0) & (near <= RADIUS)], axis=0)
        return pa.table({"src": _as_long(pairs[:, 0]), "dst": _as_long(pairs[:, 1])})

    fps = distinct_fps.count()
    # a fingerprint grows to many rows: dealt out evenly first
    halves = _balls(distinct_fps.repartition(parts_for(fps, 50_000, 8)), _half_keys, 4096, parts_for(66 * fps, 2_000_000))
    active = scratch.write(halves.groupBy("bucket").applyInArrow(partnered, "fp long").distinct())
    some = active.count()
    balls = _balls(active.repartition(parts_for(some, 2_500, 8)), _ball_keys, 512, parts_for(2081 * some, 2_000_000))
    return balls.groupBy("bucket").applyInArrow(stars, "src long, dst long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    fps = scratch.write(fingerprints(docs))
    distinct = scratch.write(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    labels = connected_components(spark, links(distinct, scratch), scratch)
    labelled = scratch.write(distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label")))
    least = scratch.write(labelled.groupBy("label").agg(F.min("first").alias("component_id")))
    component = scratch.write(labelled.join(least, "label").select("fp", "component_id"))
    scratch.keep_only(fps, component)
    return fps.join(component, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
