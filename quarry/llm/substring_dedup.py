"""Substring deduplication over a log-structured fingerprint index.

A window is ``WINDOW`` consecutive words.  Its fingerprint is the smallest
hash among its runs of ``GRAM`` words, so that equal windows have equal
fingerprints while neighbouring windows mostly share one: the index holds a
fifth as many entries as there are windows.

* Documents are packed, about 1 MB of text each, into units that are written
  once; later steps read only those.
* Each batch becomes one sorted immutable run: a bucketed table with, per bucket
  of the fingerprint space, sorted fingerprints and units they occur in.  Only
  the batch's own entries are shuffled; its run is merge-joined with the runs
  before it bucket by bucket, where they lie.  What occurs in more than one
  document goes back to its units as hits.  Two runs of one level are compacted
  into one of the next level, which later batches read.
* Hits are verified: windows under a hit exchange a 128-bit digest of their
  whole word sequence with the smallest document that has it.  A window is a
  repeat if its sequence starts in a document with a smaller doc_id.

Rows without a doc_id are no documents and are left out.  Null texts have no
words.  Repeated rows of one doc_id never cover each other
(no smaller doc_id) and each get a row.  Texts of any length are processed
whole; an empty table gives an empty result.  Other columns are ignored.
A frequent fingerprint has one entry per unit, not per document; units beyond
``UNITS_AT_ONCE`` are merged in groups first, and a run keeps one unit of it.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, parts_for, remove, slices, texts

WINDOW, GRAM, BATCHES, UNIT_BYTES, UNITS_AT_ONCE = 13, 5, 3, 1_000_000, 1 << 16
UNITS = "unit long, ids binary, sizes binary, body binary, bytes long"
_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_WORDS_AT_ONCE = 250_000


def _weights(n: int, seed: int) -> np.ndarray:
    """A random odd-ish 64-bit weight for each position in a word."""
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * _B1 + np.uint64(seed)) | np.uint64(1)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word: weighted sums of its bytes, mixed.  No step is per word in Python."""
    out = np.empty((2, len(starts)), np.uint64)
    if not len(starts):
        return out[0], out[1]
    tables = [_weights(int((ends - starts).max()), seed) for seed in (1, 2)]
    for a in range(0, len(starts), _WORDS_AT_ONCE):
        first, last = starts[a : a + _WORDS_AT_ONCE], ends[a : a + _WORDS_AT_ONCE]
        size = last - first
        at = np.cumsum(size) - size  # of each word among the words' bytes
        inside = np.arange(int(size.sum())) - np.repeat(at, size)
        value = buf[np.repeat(first, size) + inside].astype(np.uint64) + np.uint64(1)
        for k, table in enumerate(tables):
            out[k, a : a + _WORDS_AT_ONCE] = _mix(np.add.reduceat(table[inside] * value, at))
    return out[0], out[1]


def _poly(h: np.ndarray, k: int, base: np.uint64) -> np.ndarray:
    """A hash of each run of k words (none if there are fewer words)."""
    n = max(len(h) - k + 1, 0)
    out = h[:n].copy()
    for j in range(1, k):
        out *= base
        out += h[j : j + n]
    return out


def _smallest(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[: len(x) - step], x[step:])
        done += step
    return x


class Unit:
    """The words of a unit's documents as arrays; each document ends with a space."""

    def __init__(self, ids: bytes, sizes: bytes, body: bytes):
        self.ids, self.whole = np.frombuffer(ids, np.int64), zstandard.ZstdDecompressor().decompress(body)
        self.buf = np.frombuffer(self.whole, np.uint8)
        space = _SPACE[self.buf]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(space) and not space[0]:
            edge = np.r_[0, edge]
        self.starts, self.ends = edge[::2], edge[1::2]
        self.bytes_end = np.cumsum(np.frombuffer(sizes, np.int64))
        self.row = np.searchsorted(self.bytes_end, self.starts, side="right")  # of each word
        self.end = np.cumsum(np.bincount(self.row, minlength=len(self.ids)))
        self.h1, self.h2 = word_hashes(self.buf, self.starts, self.ends)
        at = np.arange(max(len(self.starts) - WINDOW + 1, 0))
        self.start = at[at + WINDOW <= self.end[self.row[: len(at)]]]  # windows within one document
        self.doc = self.ids[self.row[self.start]]

    def kept(self, gone: np.ndarray) -> list[bytes]:
        """Of each document the words that are not gone, joined by one space."""
        words = np.flatnonzero(~gone)
        mark = np.zeros(len(self.buf) + 1, np.int8)
        mark[self.starts[words]] += 1
        mark[self.ends[words] + 1] -= 1  # with the space behind
        use = np.cumsum(mark[:-1], dtype=np.int8).astype(bool)
        text = self.buf.copy()
        text[self.ends[words]] = 32
        out = text[use].tobytes()
        cut = np.cumsum(use)[self.bytes_end - 1].tolist() if len(use) else []
        return [out[a:z][:-1] for a, z in zip([0, *cut[:-1]], cut, strict=True)]

    def fingerprints(self) -> np.ndarray:
        """Of each window; the lowest bit is left free."""
        low = _smallest(_mix(_poly(self.h1, GRAM, _B1)), WINDOW - GRAM + 1)
        return _mix(low[self.start]) & ~np.uint64(1)

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of the word sequence of each window."""
        return _mix(_poly(self.h1, WINDOW, _B1)[self.start]), _mix(_poly(self.h2, WINDOW, _B2)[self.start])


def _planes(x: np.ndarray) -> bytes:
    """Byte planes of sorted or small numbers: the high ones are nearly constant and compress away."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _unplanes(x: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(dtype.itemsize, -1).T).view(dtype).ravel()


def _sorted_bytes(x: np.ndarray) -> bytes:
    return _planes(np.diff(x, prepend=np.uint64(0)))


def _sorted_from(x: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(x, np.uint64), dtype=np.uint64)


def _bucket(x: np.ndarray, n: int) -> np.ndarray:
    return (((x >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Group numbers of rows sorted by keys."""
    new = np.zeros(len(keys[0]), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


def pack(docs: DataFrame) -> DataFrame:
    """(unit, ids, sizes, body, bytes): documents in units of about 1 MB of text, compressed."""

    def run(batches):
        part, n, squeeze = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(1)
        for batch in batches:
            for cut in slices(batch, "text", UNIT_BYTES):
                body, ids = texts(cut), cut.column("doc_id").to_numpy(zero_copy_only=False)
                sizes = np.array([len(x) + 1 for x in body], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([part << 32 | n], pa.int64()), pa.array([ids.astype(np.int64).tobytes()], pa.binary()), pa.array([sizes.tobytes()], pa.binary()), pa.array([squeeze.compress(b"".join(x + b" " for x in body))], pa.binary()), pa.array([int(sizes.sum())], pa.int64())], ["unit", "ids", "sizes", "body", "bytes"])
                n += 1

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null").mapInArrow(run, UNITS)


def _batch_entries(units: DataFrame, n: int) -> DataFrame:
    """(bucket, unit, keys): the unit's distinct fingerprints, sorted; the lowest bit says that two of its documents have it."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                u = Unit(row["ids"], row["sizes"], row["body"])
                fp = u.fingerprints()
                order = np.argsort(fp)
                fp, doc = fp[order], u.doc[order]
                first = np.flatnonzero(np.r_[True, fp[1:] != fp[:-1]]) if len(fp) else np.zeros(0, np.int64)
                several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first) if len(fp) else np.zeros(0, bool)
                keys = fp[first] | several.astype(np.uint64)
                cut = np.searchsorted(_bucket(keys, n), np.arange(n + 1))
                full = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([row["unit"]] * len(full), pa.int64()), pa.array([_sorted_bytes(keys[cut[b] : cut[b + 1]]) for b in full], pa.binary())], ["bucket", "unit", "keys"])

    return units.select("unit", "ids", "sizes", "body").mapInArrow(run, "bucket int, unit long, keys binary")


RUN = "hit boolean, bucket int, unit long, keys binary, owners binary, units binary"
_SHAPE = pa.schema([("hit", pa.bool_()), ("bucket", pa.int32()), ("unit", pa.int64()), ("keys", pa.binary()), ("owners", pa.binary()), ("units", pa.binary())])


def _read(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and owners of entries and run rows, sorted by key."""
    keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for r in rows:
        k = _sorted_from(r["keys"])
        keys.append(k)
        owners.append(np.full(len(k), r["unit"], np.int64) if r["owners"] is None else np.frombuffer(r["units"], np.int64)[_unplanes(r["owners"], np.uint32)])
    keys, owners = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(keys, kind="stable")
    return keys[order], owners[order]


def _rows(bucket: int, keys: np.ndarray, owners: np.ndarray, hit_keys: np.ndarray, hit_owners: np.ndarray) -> pa.Table:
    """A run row (none if there is no key) and one row of hits for each unit."""
    out = []
    if len(keys):
        units, at = np.unique(owners, return_inverse=True)
        out.append({"hit": False, "bucket": bucket, "unit": None, "keys": _sorted_bytes(keys), "owners": _planes(at.astype(np.uint32)), "units": units.tobytes()})
    order = np.argsort(hit_owners, kind="stable")
    unit, found = hit_owners[order], hit_keys[order] & ~np.uint64(1)
    cut = np.r_[0, np.flatnonzero(np.diff(unit)) + 1, len(unit)] if len(unit) else [0]
    out += [{"hit": True, "bucket": bucket, "unit": int(unit[a]), "keys": _sorted_bytes(np.unique(found[a:b])), "owners": None, "units": None} for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return pa.Table.from_pylist(out, _SHAPE)


def _merge(thin: bool):
    """Merges entries or run rows of a bucket; what occurs in more than one document goes to its units as hits.

    The lowest bit of a key says that its fingerprint is shared. A thin run keeps one unit of a shared fingerprint:
    all others have their hits already, and whoever meets it later learns of it by the bit.
    """
    def run(t: pa.Table) -> pa.Table:
        keys, owners = _read(t.to_pylist())
        if not len(keys):
            return _SHAPE.empty_table()
        fp, several = keys & ~np.uint64(1), (keys & np.uint64(1)).astype(bool)
        group = _groups(fp)
        shared = ((np.bincount(group) > 1) | (np.bincount(group, several) > 0))[group]
        first = np.r_[True, group[1:] != group[:-1]]
        keep = first if thin else np.ones(len(keys), bool)
        return _rows(t.column("bucket")[0].as_py(), fp[keep] | shared[keep].astype(np.uint64), owners[keep], keys[shared], owners[shared])

    return run


def _meet(thin: bool):
    """Merge-joins the same bucket of two runs: fingerprints in both are hits of their units."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        (a, a_owners), (b, b_owners) = _read(left.to_pylist()), _read(right.to_pylist())
        if not len(a) or not len(b):
            return _SHAPE.empty_table()
        fa, fb = a & ~np.uint64(1), b & ~np.uint64(1)
        in_a, in_b = fb[np.minimum(np.searchsorted(fb, fa), len(fb) - 1)] == fa, fa[np.minimum(np.searchsorted(fa, fb), len(fa) - 1)] == fb
        if thin:  # the others were told when their fingerprint became shared
            in_a, in_b = in_a & (a & np.uint64(1) == 0), in_b & (b & np.uint64(1) == 0)
        return _rows(left.column("bucket")[0].as_py(), a[:0], a_owners[:0], np.r_[a[in_a], b[in_b]], np.r_[a_owners[in_a], b_owners[in_b]])

    return run


class Run:
    """An immutable sorted run: a table bucketed and sorted by bucket, so that runs meet bucket by bucket without a shuffle."""

    def __init__(self, spark, path: str, buckets: int, level: int = 0, rows: DataFrame | None = None):
        self.spark, self.path, self.level, self.name = spark, path, level, f"run_{uuid.uuid4().hex}"
        if rows is not None:
            rows.write.bucketBy(buckets, "bucket").sortBy("bucket").option("path", path).saveAsTable(self.name)
        else:
            spark.sql(f"CREATE TABLE {self.name} ({RUN}) USING parquet CLUSTERED BY (bucket) SORTED BY (bucket) INTO {buckets} BUCKETS LOCATION '{path}'")
        self.table = spark.table(self.name)

    def rows(self) -> DataFrame:
        return self.table.where("not hit")

    def hits(self) -> DataFrame:
        return self.table.where("hit").select("unit", "keys")

    def forget(self) -> None:
        """The name goes; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


class FingerprintIndex:
    """Runs of growing levels: two of one level are compacted into one of the next, which later batches read.

    A batch shuffles its own entries once. History is read in place: bucketed runs are merge-joined without a shuffle.
    ``units`` bounds the units of a batch: beyond UNITS_AT_ONCE, units are dealt into several groups of a bucket,
    merged first among themselves, so that a fingerprint of all units is no large group anywhere.
    """

    def __init__(self, spark, folder: str, buckets: int, thin: bool = True, runs: list[Run] | None = None):
        self.spark, self.folder, self.buckets, self.thin, self.runs = spark, folder, buckets, thin, runs or []

    def add(self, entries: DataFrame, units: int, name: str) -> list[DataFrame]:
        """Makes the batch a run, merge-joins it with every run before and compacts; returns hits (unit, keys)."""
        salts, path = -(-units // UNITS_AT_ONCE), f"{self.folder}/{name}"
        rows, hits = entries.selectExpr("bucket", "unit", "keys", "cast(null as binary) owners", "cast(null as binary) units"), []
        if salts > 1:
            dealt = self._keep(rows.groupBy("bucket", F.pmod(F.xxhash64("unit"), F.lit(salts))).applyInArrow(_merge(self.thin), RUN), f"{path}-parts")
            hits.append(dealt.where("hit").select("unit", "keys"))
            rows = dealt.where("not hit").drop("hit")
        new = Run(self.spark, path, self.buckets, 0, rows.groupBy("bucket").applyInArrow(_merge(self.thin), RUN))
        hits.append(new.hits())
        for old in self.runs:
            met = new.rows().groupBy("bucket").cogroup(old.rows().groupBy("bucket")).applyInArrow(_meet(self.thin), RUN)
            hits.append(self._keep(met, f"{path}-with-{len(hits)}").select("unit", "keys"))
        self.runs.append(new)
        while len(self.runs) > 1 and self.runs[-1].level == self.runs[-2].level:
            self.compact(f"{name}-level{self.runs[-1].level + 1}")
        return hits

    def _keep(self, rows: DataFrame, path: str) -> DataFrame:
        rows.write.parquet(path)
        return self.spark.read.schema(RUN).parquet(path)

    def compact(self, name: str) -> None:
        """Merges the last two runs into one, bucket by bucket, where they lie."""
        a, b = self.runs[-2:]
        merge = _merge(self.thin)

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            both = merge(pa.concat_tables([left.cast(_SHAPE), right.cast(_SHAPE)]))
            return both.filter(pc.invert(both.column("hit")))  # hits were told when the runs met

        whole = a.rows().groupBy("bucket").cogroup(b.rows().groupBy("bucket")).applyInArrow(run, RUN)
        self.runs[-2:] = [Run(self.spark, f"{self.folder}/{name}", self.buckets, a.level + 1, whole)]
        a.forget()
        b.forget()


def _claims(units: DataFrame, hits: DataFrame, n: int) -> DataFrame:
    """(bucket, unit, w1, w2, at, docs): digests of the windows under a hit with the unit's smallest document that has each."""
    shape = pa.schema([("bucket", pa.int32()), ("unit", pa.int64()), ("w1", pa.binary()), ("w2", pa.binary()), ("at", pa.binary()), ("docs", pa.binary())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return shape.empty_table()
        row = left.to_pylist()[0]
        u = Unit(row["ids"], row["sizes"], row["body"])
        keys = np.sort(np.concatenate([_sorted_from(x) for x in right.column("keys").to_pylist()]))
        fp = u.fingerprints()
        use = keys[np.minimum(np.searchsorted(keys, fp), len(keys) - 1)] == fp
        (w1, w2), doc = u.digests(), u.doc[use]
        w1, w2 = w1[use], w2[use]
        order = np.lexsort((doc, w2, w1))
        w1, w2, doc = w1[order], w2[order], doc[order]
        first = np.r_[True, np.diff(_groups(w1, w2)) > 0][: len(w1)]
        w1, w2, doc = w1[first], w2[first], doc[first]
        cut, out = np.searchsorted(_bucket(w1, n), np.arange(n + 1)), []
        for b in np.flatnonzero(np.diff(cut)):
            a, z = cut[b], cut[b + 1]
            docs, at = np.unique(doc[a:z], return_inverse=True)
            out.append({"bucket": int(b), "unit": row["unit"], "w1": _sorted_bytes(w1[a:z]), "w2": _planes(w2[a:z]), "at": _planes(at.astype(np.uint32)), "docs": docs.tobytes()})
        return pa.Table.from_pylist(out, shape)

    return units.groupBy("unit").cogroup(hits.groupBy("unit")).applyInArrow(run, "bucket int, unit long, w1 binary, w2 binary, at binary, docs binary")


def _repeats(claims: DataFrame) -> DataFrame:
    """(unit, w1, w2): digests of which a smaller document than the unit's smallest has the sequence."""
    shape = pa.schema([("unit", pa.int64()), ("w1", pa.binary()), ("w2", pa.binary())])

    def run(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        w1 = [_sorted_from(r["w1"]) for r in rows]
        unit = np.repeat(np.arange(len(rows)), [len(x) for x in w1])
        w1, w2 = np.concatenate(w1), np.concatenate([_unplanes(r["w2"], np.uint64) for r in rows])
        doc = np.concatenate([np.frombuffer(r["docs"], np.int64)[_unplanes(r["at"], np.uint32)] for r in rows])
        order = np.lexsort((w2, w1))
        group = _groups(w1[order], w2[order])
        least = np.minimum.reduceat(doc[order], np.flatnonzero(np.r_[True, np.diff(group) > 0]))
        late = np.empty(len(doc), bool)
        late[order] = doc[order] > least[group]
        w1, w2, unit = w1[late], w2[late], unit[late]  # still by unit, sorted within
        cut = np.r_[0, np.flatnonzero(np.diff(unit)) + 1, len(unit)] if len(unit) else [0]
        return pa.Table.from_pylist([{"unit": rows[unit[a]]["unit"], "w1": _sorted_bytes(w1[a:b]), "w2": _planes(w2[a:b])} for a, b in zip(cut[:-1], cut[1:], strict=True)], shape)

    return claims.groupBy("bucket").applyInArrow(run, "unit long, w1 binary, w2 binary")


def _removed(u: Unit, w1: np.ndarray, w2: np.ndarray) -> np.ndarray:
    """Which words of the unit are covered by a repeat."""
    d1, d2 = u.digests()
    repeat = np.zeros(len(d1), bool)
    order = np.argsort(d1)
    same = d1[order][1:] == d1[order][:-1]
    some = order[np.r_[same, False] | np.r_[False, same]] if len(order) else order  # windows that may occur twice in the unit
    if len(some):
        some = some[np.lexsort((u.doc[some], d2[some], d1[some]))]
        group = _groups(d1[some], d2[some])
        least = u.doc[some][np.flatnonzero(np.r_[True, np.diff(group) > 0])]
        repeat[some] = u.doc[some] > least[group]
    if len(w1):
        pair = np.dtype([("a", np.uint64), ("b", np.uint64)])
        at = np.searchsorted(w1, d1)
        same = np.flatnonzero(w1[np.minimum(at, len(w1) - 1)] == d1)
        mine, known = np.empty(len(same), pair), np.empty(len(w1), pair)
        mine["a"], mine["b"], known["a"], known["b"] = d1[same], d2[same], w1, w2
        repeat[same] |= np.isin(mine, known)
    n, start = len(u.starts), u.start[repeat]  # starts are distinct
    edge = np.zeros(n + WINDOW + 1, np.int64)
    edge[start] += 1
    edge[start + WINDOW] -= 1
    return np.cumsum(edge)[:n] > 0


def _kept(units: DataFrame, repeats: DataFrame) -> DataFrame:
    shape = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return shape.empty_table()
        row = left.to_pylist()[0]
        u = Unit(row["ids"], row["sizes"], row["body"])
        w1 = [_sorted_from(x) for x in right.column("w1").to_pylist()]
        w2 = [_unplanes(x, np.uint64) for x in right.column("w2").to_pylist()]
        w1, w2 = (np.concatenate(w1), np.concatenate(w2)) if w1 else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        order = np.argsort(w1, kind="stable")
        gone = _removed(u, w1[order], w2[order])
        start = np.r_[0, u.end[:-1]]
        lost = np.r_[0, np.cumsum(gone)]
        lost = lost[u.end] - lost[start]
        return pa.Table.from_arrays([pa.array(u.ids), pa.array(u.end - start), pa.array(lost), pa.array(u.kept(gone), pa.binary()).cast(pa.string())], schema=shape)

    return units.groupBy("unit").cogroup(repeats.groupBy("unit")).applyInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def dedup_substrings(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) of every document."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    units = scratch.write(pack(docs))
    many, size = units.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    if not many:
        return _kept(units, spark.createDataFrame([], "unit long, w1 binary, w2 binary"))
    n = parts_for(size // 5, 4_000_000)
    # a batch is a set of units; which one a unit is in has no effect on the result
    index, hits = FingerprintIndex(spark, f"{scratch.path}/runs", n), []
    for b in range(batches):
        hits += index.add(_batch_entries(units.where(F.pmod(F.xxhash64("unit"), F.lit(batches)) == b), n), many, f"batch{b}")
    found = hits[0]
    for more in hits[1:]:
        found = found.unionByName(more)
    found = scratch.write(found)
    for run in index.runs:
        run.forget()
    remove(spark, f"{scratch.path}/runs")  # this index was for one call; SubstringStore keeps its own
    repeats = scratch.write(_repeats(_claims(units, found, n)))
    scratch.keep_only(units, repeats)
    return _kept(units, repeats)


class SubstringStore:
    """An index that outlives a job: units, runs and the number of buckets in a folder of the shared store.

    ``add`` takes one more batch, cleans it against everything before it and itself, and appends its units and its run.
    A window goes if it starts in a document with a smaller doc_id, so doc_ids of a batch must be larger than those
    before: others raise ValueError.  A batch counts once its entry in ``batches`` is written, which is the last step; a
    job that was lost before leaves files that no later batch reads and that its repetition replaces.
    """

    META = "batch int, buckets int, units long, largest long, runs array<string>, levels array<int>"

    def __init__(self, spark, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _batches(self) -> list:
        """One small row a batch: number, buckets, units so far, largest doc_id, live runs and their levels."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/batches")
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return []
        return sorted(self.spark.read.schema(self.META).parquet(f"{self.path}/batches").collect(), key=lambda r: r["batch"])

    def _units(self, batch: int) -> DataFrame:
        return self.spark.read.schema(UNITS).parquet(f"{self.path}/units/{batch}")

    def add(self, docs: DataFrame) -> DataFrame:
        """As dedup_substrings, for the documents of this batch."""
        before = self._batches()
        last = before[-1] if before else None
        k, n, first, largest = (last["batch"] + 1, last["buckets"], last["units"], last["largest"]) if last else (0, self.buckets, 0, None)
        low, high = docs.agg(F.min(F.col("doc_id").cast("long")), F.max(F.col("doc_id").cast("long"))).first()
        if low is not None and largest is not None and low <= largest:
            raise ValueError(f"doc_id {low} is not larger than {largest} of an earlier batch")
        scratch = Scratch(self.spark, "substring")
        raw = scratch.write(pack(docs))
        # units are numbered on from the last batch: within a task's units, and tasks by their counts
        part, at = F.shiftrightunsigned("unit", 32), F.col("unit").bitwiseAND(F.lit((1 << 32) - 1))
        counts = raw.groupBy(part.alias("part")).agg(F.count("*").alias("n_part"))  # one row for each task
        offsets = counts.select("part", (F.sum("n_part").over(Window.orderBy("part")) - F.col("n_part")).alias("offset"))
        numbered = raw.join(F.broadcast(offsets), part == F.col("part")).withColumn("unit", F.col("offset") + at + F.lit(first)).select(*raw.columns)
        numbered.write.mode("overwrite").parquet(f"{self.path}/units/{k}")
        scratch.drop(raw)
        units = self._units(k)
        many = units.count()
        attempt = f"{self.path}/runs/{k}-{uuid.uuid4().hex}"
        runs = [Run(self.spark, path, n, level) for path, level in zip(last["runs"], last["levels"], strict=True)] if last else []
        index = FingerprintIndex(self.spark, attempt, n, False, runs)
        found = None
        for hits in index.add(_batch_entries(units, n), many, "run") if many else []:
            found = hits if found is None else found.unionByName(hits)
        found = scratch.write(found if found is not None else self.spark.createDataFrame([], "unit long, keys binary"))
        met, named = units, found.select("unit").distinct()
        for b in before:  # of earlier units only those that a hit names are read again
            met = met.unionByName(self._units(b["batch"]).join(named, "unit", "left_semi").select(*units.columns))
        repeats = scratch.write(_repeats(_claims(met, found, n)))
        scratch.keep_only(repeats)
        live, levels = [r.path for r in index.runs], [r.level for r in index.runs]
        for run in index.runs:
            run.forget()
        self.spark.createDataFrame([(k, n, first + many, high if high is not None else largest, live, levels)], self.META).coalesce(1).write.mode("append").parquet(f"{self.path}/batches")
        return _kept(units, repeats)
