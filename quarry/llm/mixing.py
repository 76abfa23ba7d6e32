"""Mixing sources to target weights by hash-threshold histograms.

Sizes are summed by (source, top bits of a hash of doc_id).  In the running
sum over buckets each source's budget ends in one boundary bucket; only that
bucket's rows are summed again by the next bits, until the bits are used up.
A document is taken if its hash lies below its source's threshold: a filter,
no sort.  The document at the threshold is taken in part, so that each
source's taken words equal its target rounded down.

Sizes are counts of words; null text has none.  Null source is a source of its
own, last.  Rows with one doc_id share a hash; if they meet at the threshold
they share what is left in proportion.  There may be any number of sources: their
order, targets and thresholds are tables, and the driver sees sums only.  One may
hold any share of the rows, as only sums per bucket are shuffled.  An empty table
gives an empty result.  Columns of the input other than doc_id, text and source are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch

WEIGHTS, SHARE, REPEATS, HEAVY = (5, 2, 1), 1.5, 2, 10_000
LEVELS, BITS = 6, 8


def targets(sizes: dict, weights: dict, share: float = SHARE, repeats: int = REPEATS) -> dict:
    """Water filling: share by weight, stop at ``repeats`` times the size, reshare the rest."""
    left, weight, out = share * sum(sizes.values()), sum(weights.values()), {}
    for s in sorted(sizes, key=lambda s: repeats * sizes[s] / weights[s]):
        cap = repeats * sizes[s]
        out[s] = round(min(float(cap), weights[s] * left / weight), 6)
        if cap <= weights[s] * left / weight:
            left, weight = left - cap, weight - weights[s]
        else:
            return out | {r: round(weights[r] * left / weight, 6) for r in sizes if r not in out}
    return out


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, key (of the source, not null), size, u (48 bits of the MD5 of doc_id)."""
    u = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, LEVELS * BITS // 4), 16, 10).cast("long")
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string").alias("source"), F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("key"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), u.alias("u"))


def weighted(sums: DataFrame, weights: tuple, scratch: Scratch) -> DataFrame:
    """sums with w, its source's weight: weights repeat over the sources in order of code points, null last.

    Sources are numbered within ranges, and ranges by their counts: no task sees all of them.
    """
    ranged = sums.repartitionByRange(F.col("key") == "n", "key").sortWithinPartitions(F.col("key") == "n", "key")
    rows = scratch.write(ranged.withColumn("i", F.monotonically_increasing_id()))
    part, at = F.shiftrightunsigned("i", 33), F.col("i").bitwiseAND(F.lit((1 << 33) - 1))
    counts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n_part"))  # one row for each range
    before = counts.withColumn("before", F.sum("n_part").over(Window.orderBy("part")) - F.col("n_part"))
    number = F.pmod(F.col("before") + at, F.lit(len(weights)))
    return rows.join(F.broadcast(before), part == F.col("part")).select("key", "n", "docs", F.get(F.array(*map(F.lit, weights)), number.cast("int")).cast("long").alias("w"))


def levelled(sources: DataFrame, share: float, repeats: int) -> DataFrame:
    """sources with goal: water filling. Each round caps what would go over and shares what is left; only sums are collected."""
    cap = (F.col("n") * repeats).cast("double")
    first = sources.agg(F.sum("n"), F.sum("w")).first()
    whole, weight = share * (first[0] or 0), first[1] or 1
    left, capped = whole, -1
    while True:
        over = cap <= F.col("w") * left / weight
        x = sources.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, F.col("n"))), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("w"))), F.lit(0))).first()
        if x[0] == capped or not x[2]:
            return sources.withColumn("goal", F.round(F.when(over, cap).otherwise(F.col("w") * left / weight), 6))
        capped, left, weight = x[0], whole - repeats * x[1], x[2]


def _meet(rows: DataFrame, state: DataFrame, heavy: bool) -> DataFrame:
    """rows joined with their source's row of ``state`` (key, ...).

    Sources of which each holds more than one row in HEAVY are fewer than HEAVY: they are broadcast. The others are
    small; where there are any beyond that number, they meet by a shuffle in which no source is hot.
    """
    if not heavy:
        return rows.join(F.broadcast(state), "key")
    many = F.broadcast(state.where("heavy"))
    rest = rows.join(F.broadcast(state.where("heavy").select("key")), "key", "left_anti")
    return rows.join(many, "key").unionByName(rest.join(state.where("not heavy").hint("merge"), "key"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.write(sized(docs))
    sums = scratch.write(rows.groupBy("key").agg(F.sum("size").alias("n"), F.count("*").alias("docs")))
    sources, n_rows = sums.agg(F.count("*"), F.sum("docs")).first()
    more = sources > HEAVY
    goals = levelled(scratch.write(weighted(sums, weights, scratch)), share, repeats)
    # whole copies of every document, then a budget for one copy more of some
    whole = F.when(F.col("n") > 0, F.least(F.floor(F.col("goal") / F.col("n")), F.lit(repeats))).otherwise(0)
    budget = F.floor(F.col("goal")) - F.col("whole") * F.col("n")
    state = goals.withColumn("whole", whole.cast("long")).select("key", F.col("n").alias("source_size"), F.col("goal").alias("target"), "whole", (F.col("docs") > (n_rows or 0) / HEAVY).alias("heavy"), budget.cast("long").alias("budget"), F.lit(0).cast("long").alias("edge"), F.lit(0).cast("long").alias("edge_size"))
    state = scratch.write(state)
    for level in range(LEVELS):
        shift = (LEVELS - 1 - level) * BITS
        at, prefix = F.shiftright("u", shift), F.shiftright("edge", shift + BITS)
        wanted = state.where("budget > 0").select("key", "heavy", "budget", prefix.alias("prefix"))
        inside = _meet(rows.select("key", "size", "u"), wanted, more).where(F.shiftright("u", shift + BITS) == F.col("prefix"))
        running = inside.groupBy("key", "budget", at.alias("bucket")).agg(F.sum("size").alias("n")).withColumn("upto", F.sum("n").over(Window.partitionBy("key").orderBy("bucket")))  # 2^BITS rows of a source at most
        edges = running.where("upto > budget").groupBy("key").agg(F.min(F.struct("bucket", "upto", "n")).alias("x"))
        new = {"budget": F.col("budget") - (F.col("x.upto") - F.col("x.n")), "edge": F.shiftleft("x.bucket", shift)} | ({} if shift else {"edge_size": F.col("x.n")})
        after = state.join(edges, "key", "left").select(*[F.coalesce(new[c], c).alias(c) if c in new else F.col(c) for c in state.columns])
        after = scratch.write(after)
        scratch.drop(state)
        state = after
    scratch.keep_only(rows, state)
    part = F.when(F.col("u") < F.col("edge"), F.col("size")).when((F.col("u") == F.col("edge")) & (F.col("edge_size") > 0), F.expr("cast(budget * cast(size as decimal(20,0)) div edge_size as bigint)")).otherwise(F.lit(0))
    return _meet(rows, state, more).select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + part).cast("long").alias("taken"), "source")
