"""Benchmark decontamination with SimHash, in DataFrame functions only.

1. Texts are lower-cased and cut into words of letters and digits; shingles
   are five words, a shingle weighs its number of characters.  For every
   benchmark item of n words, a document's windows of n words, at every start,
   are its candidates.  Windows whose shared shingles weigh too little to reach
   the similarity are told by running sums and not laid out.
2. Distinct windows get a 64-bit SimHash of their weighted shingles, as items
   do.  Fingerprints are cut into five blocks: if two differ in at most
   RADIUS = 19 bits, some block differs in at most three.  Items emit, for each
   block, all values within three bits; windows emit their blocks; equal values
   meet, and the Hamming distance is tested.  No fingerprint within the radius
   is lost.
3. Candidates are verified exactly: weighted Jaccard similarity of the shingle
   multisets, 0.8 or more.

Null texts match nothing; items of fewer than five words have no shingle and
match nothing; documents shorter than an item are one window.  Items with the
same words are one search.  Rows are searched one by one, also where doc_ids
repeat or are null (a row is known by doc_id and 128 bits of its text; rows
equal in both are one); the result has one row for each doc_id (null is one)
and item, and equal windows at equal starts of one doc_id count once.  The
benchmark may have any size: its shingles are broadcast only after a count,
with the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

WIDTH, SIMILARITY, RADIUS, BROADCAST_ROWS, SLOTS = 5, 0.8, 19, 500_000, 1 << 18
#: Bounds are compared with room for rounding.
SLACK = 1e-6
#: (first bit, bits): RADIUS // 5 = 3 bits at most differ in one of them.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))


def plain(text: Column) -> Column:
    """The words, with a blank between."""
    return F.trim(F.regexp_replace(F.lower(text.cast("string")), r"[^\p{L}\p{N}]+", " "))


def cut(text: Column) -> Column:
    return F.when(text != "", F.split(text, " ")).otherwise(F.array().cast("array<string>"))


def words(text: Column) -> Column:
    return cut(plain(text))


def _each(w: Column, f) -> Column:
    """f of the start of each shingle; none if there are too few words."""
    return F.when(F.size(w) >= WIDTH, F.transform(F.sequence(F.lit(0), F.size(w) - WIDTH), f))


def hashes(w: Column) -> Column:
    return _each(w, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WIDTH)]))


def shingles(w: Column) -> Column:
    return _each(w, lambda i: F.array_join(F.slice(w, i + 1, WIDTH), " "))


def characters(w: Column) -> Column:
    """Of each shingle: what it weighs."""
    return _each(w, lambda i: sum((F.length(F.get(w, i + j)) for j in range(WIDTH)), F.lit(WIDTH - 1)).cast("long"))


def fingerprints(rows: DataFrame, key: str, w: str) -> DataFrame:
    """(key, fp): 64 bits, each the majority over the shingles, which vote by their characters as similarity weighs them.

    Two bits share a sum, each in 32 of its bits: 32 sums that are added up before the shuffle.
    """
    votes = rows.select(key, F.explode(F.arrays_zip(hashes(F.col(w)).alias("h"), characters(F.col(w)).alias("c"))).alias("x")).select(key, "x.h", "x.c")
    two = F.lit(1 << 32 | 1).cast("long")
    sums = votes.groupBy(key).agg(F.sum("c").alias("all"), *[F.sum(F.shiftright("h", b).bitwiseAND(two) * F.col("c")).alias(f"v{b}") for b in range(32)])
    fp = F.lit(0).cast("long")
    for b in range(32):
        for bit, ones in ((b, F.col(f"v{b}").bitwiseAND(F.lit((1 << 32) - 1))), (b + 32, F.shiftrightunsigned(f"v{b}", 32))):
            fp = fp.bitwiseOR(F.when(ones * 2 > F.col("all"), F.lit((1 << bit) - (1 << 64 if bit == 63 else 0)).cast("long")).otherwise(F.lit(0).cast("long")))
    return sums.select(key, fp.alias("fp"))


def _block(fp: Column, first: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def _near(value: Column, bits: int) -> Column:
    """All values of a block within three bits."""
    one = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    seq = lambda a: F.sequence(a, F.lit(bits - 1))
    flips = F.flatten(F.transform(seq(F.lit(0)), lambda i: F.flatten(F.transform(seq(i), lambda j: F.transform(seq(j), lambda k: one(i).bitwiseOR(one(j)).bitwiseOR(one(k)))))))
    return F.array_append(F.transform(F.array_distinct(flips), lambda m: value.bitwiseXOR(m)), value)


def total(chars: Column) -> Column:
    return F.aggregate(chars, F.lit(0).cast("long"), lambda acc, x: acc + x)


def multiset(w: Column) -> Column:
    """Shingles made distinct by the number of equal ones before: what two such sets share, the multisets share."""
    return F.get(F.transform(F.array(F.sort_array(shingles(w))), lambda x: F.transform(x, lambda s, i: F.concat(s, F.lit(" "), (i + 1 - F.array_position(x, s)).cast("string")))), 0)


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two multisets."""
    weight = lambda m: total(F.transform(m, lambda x: F.length(F.substring_index(x, " ", WIDTH)).cast("long")))
    sums = F.struct(weight(F.array_intersect(a, b)).alias("common"), weight(a).alias("a"), weight(b).alias("b"))
    return F.get(F.transform(F.array(sums), lambda x: x["common"] / (x["a"] + x["b"] - x["common"])), 0)


def keys(doc_id: Column, text: Column) -> list[Column]:
    """What tells rows apart: doc_id and 128 bits of the text. Rows equal in both are one search."""
    return [doc_id.cast("long").alias("doc_id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("more"), text).alias("k2")]


KEY = ["doc_id", "k1", "k2"]


def _benchmark_items(benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """item_ids, w, n, item_fp of each word sequence."""
    items = benchmark.select(F.col("item_id").cast("long"), words(F.col("text")).alias("w")).where(F.size("w") >= WIDTH)
    items = scratch.write(items.groupBy("w").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids")).withColumn("item", F.monotonically_increasing_id()))
    return scratch.write(items.join(fingerprints(items, "item", "w"), "item").select("item", "item_ids", "w", F.size("w").alias("n"), F.col("fp").alias("item_fp")))


def _starts(docs: DataFrame, items: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """KEY, n, need, start, shared of every window that shares enough characters with items of its size.

    A shared shingle at pos lies in the windows that start in pos - n + WIDTH .. pos; the characters that windows
    share are running sums of what enters and leaves. Starts are summed in stretches of n, so no document is one group.
    """
    # need: the characters of the lightest item of that size, of which a window must share the part ``least``
    need = items.groupBy("n").agg(F.min(total(characters(F.col("w")))).alias("need"))
    known = items.select("n", F.explode(F.arrays_zip(hashes(F.col("w")).alias("h"), characters(F.col("w")).alias("c"))).alias("x"))
    known = scratch.write(known.groupBy("n", F.col("x.h").alias("h")).agg(F.max("x.c").alias("chars")).join(F.broadcast(need), "n"))  # one row for each size
    cuts = docs.select(*keys(F.col("doc_id"), F.col("text")), words(F.col("text")).alias("w"))
    shared = cuts.select(*KEY, F.size("w").alias("size"), F.posexplode(hashes(F.col("w"))).alias("pos", "h"))  # hashes travel without texts
    hits = shared.join(F.broadcast(known) if known.count() <= BROADCAST_ROWS else known, "h")
    n, pos = F.col("n"), F.col("pos")
    stretch = F.floor(pos / n)
    hits = hits.select(*KEY, "n", "need", "size", "pos", "chars", F.explode(F.array(stretch, stretch - 1)).alias("part")).where("part >= 0")
    group = [*KEY, "n", "part"]
    hits = hits.repartition(*group).dropDuplicates([*group, "pos"])  # equal rows count once
    begin = F.col("part") * n
    end = F.least(begin + n - 1, F.greatest(F.col("size") - n, F.lit(0)))
    hits = hits.withColumn("most", F.sum("chars").over(Window.partitionBy(*group))).where((F.col("most") >= least * F.col("need") - SLACK) & (begin <= end))
    enters, leaves = F.struct(F.greatest(pos - n + WIDTH, begin).cast("long").alias("at"), F.col("chars").alias("by")), F.struct((pos + 1).cast("long").alias("at"), (-F.col("chars")).alias("by"))
    events = hits.select(*group, "need", begin.cast("long").alias("begin"), end.cast("long").alias("end"), F.explode(F.array(enters, leaves)).alias("x")).where("x.at <= end")
    sums = events.groupBy(*group, "need", "end", F.col("x.at").alias("at")).agg(F.sum("x.by").alias("by"))
    order = Window.partitionBy(*group).orderBy("at")
    spans = sums.select(*group, "need", "at", F.sum("by").over(order).alias("shared"), F.coalesce(F.lead("at").over(order) - 1, F.col("end")).alias("last"))
    spans = spans.where(F.col("shared") >= least * F.col("need") - SLACK)
    return scratch.write(spans.select(*KEY, "n", "need", "shared", F.explode(F.sequence("at", "last")).alias("start")).withColumn("start", F.col("start").cast("int")))


def slots_of(found: DataFrame) -> DataFrame:
    """The slots of some rows' keys: at most SLOTS rows, whatever the input, so they may be broadcast."""
    return F.broadcast(found.select(slot(F.col("k1")).alias("slot")).distinct())


def slot(k1: Column) -> Column:
    return F.pmod(k1, F.lit(SLOTS)).cast("int")


def flagged(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """KEY, item_id, similarity, start of every window of a document that holds an item."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    items = _benchmark_items(benchmark, scratch)
    starts = _starts(docs, items, least, scratch)
    some = scratch.write(starts.groupBy(*KEY).agg(F.collect_list(F.struct("n", "need", "start", "shared")).alias("starts")))
    # texts are read again; those in no slot of a suspect stay where they are, the others meet their starts
    source = docs.select(*keys(F.col("doc_id"), F.col("text")), "text").join(slots_of(some), slot(F.col("k1")) == F.col("slot"), "left_semi")
    mine = some.withColumnsRenamed({k: f"_{k}" for k in KEY}).hint("merge")
    found = source.join(mine, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")))
    found = found.select(*KEY, words(F.col("text")).alias("w"), "starts").select(*KEY, "w", F.explode("starts").alias("x"))
    found = found.select(*KEY, "x.n", "x.need", "x.start", "x.shared", F.slice("w", F.col("x.start") + 1, F.col("x.n")).alias("window"))
    same = [F.xxhash64("window").alias("w1"), F.xxhash64(F.lit("more"), "window").alias("w2")]  # windows are known by 128 bits
    windows = scratch.write(found.select("*", *same))
    within = F.col("shared") * (1 + least) >= least * (total(characters(F.col("window"))) + F.col("need")) - SLACK
    texts = scratch.write(windows.where(within).groupBy("n", "w1", "w2").agg(F.any_value("window").alias("window")).withColumn("id", F.monotonically_increasing_id()))
    texts = scratch.write(texts.join(fingerprints(texts, "id", "window").hint("merge"), "id"))
    of_item = F.array(*[F.struct(F.lit(b).alias("block"), _near(_block(F.col("item_fp"), *x), x[1]).alias("near")) for b, x in enumerate(BLOCKS)])
    ball = items.select("n", "item_fp").distinct().select("n", "item_fp", F.explode(of_item).alias("x")).select("n", "item_fp", "x.block", F.explode("x.near").alias("value"))
    of_window = F.array(*[F.struct(F.lit(b).alias("block"), _block(F.col("fp"), *x).alias("value")) for b, x in enumerate(BLOCKS)])
    probes = texts.select("n", "fp").distinct().select("n", "fp", F.explode(of_window).alias("x")).select("n", "fp", "x.block", "x.value")
    # only sizes and fingerprints travel; the same pair can meet in several blocks. A ball is large: never broadcast it
    near = probes.join(ball.hint("merge"), ["n", "block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS).select("n", "fp", "item_fp").distinct()
    met = texts.withColumn("m", multiset(F.col("window"))).join(scratch.write(near).hint("merge"), ["n", "fp"]).join(items.select("n", "item_fp", "item_ids", multiset(F.col("w")).alias("item")), ["n", "item_fp"])
    sure = scratch.write(met.withColumn("similarity", similarity(F.col("m"), F.col("item"))).where(F.col("similarity") >= least).select("n", "w1", "w2", F.explode("item_ids").alias("item_id"), "similarity"))
    scratch.keep_only(windows, sure)
    return windows.select(*KEY, "n", "start", "w1", "w2").join(sure.hint("merge"), ["n", "w1", "w2"]).select(*KEY, "item_id", "similarity", "start", "n")


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, similarity, start (word of the best window), n_windows of every document that holds an item."""
    best = F.max(F.struct("similarity", (-F.col("start")).alias("s")))
    # equal windows at equal starts of one doc_id count once, in whatever row they are
    once = flagged(docs, benchmark, least).groupBy("doc_id", "item_id", "start", "n", "similarity").agg(F.lit(1).alias("one"))
    return once.groupBy("doc_id", "item_id").agg(best.alias("best"), F.count("*").alias("n_windows")).select("doc_id", "item_id", F.round("best.similarity", 6).alias("similarity"), (-F.col("best.s")).alias("start"), "n_windows")


def clean(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of docs, all columns, whose own text holds no item."""
    found = Scratch(docs.sparkSession, "flagged").write(flagged(docs, benchmark, least).select(*KEY).distinct())
    own = docs.select(*[F.col(f"`{c}`") for c in docs.columns], *[k.alias(f"__own_{n}") for n, k in zip(KEY, keys(F.col("doc_id"), F.col("text")), strict=True)])
    near, is_near = slots_of(found), slot(F.col("__own_k1")) == F.col("slot")
    same = F.col("__own_doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("__own_k1") == F.col("__k1")) & (F.col("__own_k2") == F.col("__k2"))
    # most rows are told clean where they are; those in a slot of a flagged one are compared
    suspects = own.join(near, is_near, "left_semi").join(found.withColumnsRenamed({k: f"__{k}" for k in KEY}).hint("merge"), same, "left_anti")
    return own.join(near, is_near, "left_anti").unionByName(suspects).select(*[F.col(f"`{c}`") for c in docs.columns])
