"""Secret scans in DataFrame functions only.

Three kinds are found by pattern (assign, access, hex).  A fourth, entropy, is
added for strings of token characters: over each, a window slides whose
Shannon entropy is kept up by the counts of the character that enters and the
one that leaves; a string is reported if its largest window entropy reaches
the limit of its character class and no allow-list pattern fits it.  The
allow-list suppresses entropy spans only.

A candidate of any length is measured whole and in linear time: it is cut into
short stretches which overlap by a window less one, and measuring ends where the
limit is reached.  Positions and covered spans are running sums and maxima, not
arrays that grow match by match.

Positions are code points; ends are exclusive.  Spark has no function for
match positions: between two matches lies what ``split`` returns for the same
pattern, so positions are running sums of lengths.  Null text counts as empty
and has no spans; repeated rows each get a row; other columns pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the three kinds. {8,} and the like would start matches inside dropped ones for
# assign, so its length is tested afterwards; for the other two a dropped match can hide no longer one.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "entropy")
WINDOW, STRETCH = 20, 128
#: (class, pattern of the whole string, bits): the first that fits counts. Words without a digit stay below the limit of letters.
CLASSES = (("hex", r"^(?=.*[0-9])(?=.*[a-fA-F])[0-9a-fA-F]+$", 3.0), ("alnum", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9]+$", 3.6), ("base64", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_=-]+$", 3.8),
           ("lower_digit", r"^(?=.*[0-9])(?=.*[a-z])[a-z0-9]+$", 3.6), ("upper_digit", r"^(?=.*[0-9])(?=.*[A-Z])[A-Z0-9]+$", 3.6), ("letters", r"^[A-Za-z]+$", 3.9), ("other", r"^.+$", 4.0))
#: UUIDs, documented example keys, repeated placeholders.
ALLOW = (r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", r"EXAMPLE", r"^(.)\1+$", r"^[xX0]+$")


def let(value: Column, f) -> Column:
    """f of a value that is used several times, computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _chunk(x: Column, width: Column, i: Column) -> Column:
    return F.slice(x, i + 1, width)


def running(values: Column, combine) -> Column:
    """Running results of ``combine`` over an array of longs >= 0, from 0 on.

    An accumulated array is copied at every step, so the array is cut into
    pieces as long as there are pieces: 10^6 values take 10^9 copies less than
    10^12, and neither a match nor a character is left out.
    """
    nothing = F.array().cast("array<bigint>")
    steps = lambda x, first: F.aggregate(x, F.array(first), lambda acc, v: F.array_append(acc, combine(F.element_at(acc, -1), v)))

    def pieces(x):
        width = F.ceil(F.sqrt(F.size(x).cast("double"))).cast("int")
        return let(F.transform(F.sequence(F.lit(0), F.size(x) - 1, width), lambda i: _chunk(x, width, i)), joined)

    def joined(cut):
        starts = steps(F.transform(cut, lambda p: F.aggregate(p, F.lit(0).cast("long"), combine)), F.lit(0).cast("long"))
        return F.flatten(F.zip_with(cut, F.slice(starts, 1, F.size(cut)), lambda p, first: F.slice(steps(p, first), 2, F.size(p))))

    return let(values, lambda x: F.when(F.size(x) > 0, pieces(x)).otherwise(nothing))


def _between(text: Column, pattern: str) -> Column:
    """array<struct<at, s>> of the pattern's matches: 0-based start and matched string."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct((F.length(g) + F.length(m)).cast("long").alias("step"), m.alias("s")))
    placed = lambda x: F.zip_with(x, running(F.transform(x, lambda m: m["step"]), lambda a, v: a + v), lambda m, end: F.struct((end - F.length(m["s"])).cast("int").alias("at"), m["s"].alias("s")))
    return let(both, placed)


def _matches(text: Column, pattern: str) -> Column:
    return F.when(text.rlike(pattern), _between(text, pattern)).otherwise(F.array().cast("array<struct<at:int,s:string>>"))


def _span(kind: str, x: Column) -> Column:
    return F.struct(x["at"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (x["at"] + F.length(x["s"])).alias("end"))


def stretches(s: Column, width: int = WINDOW) -> Column:
    """The string in pieces of STRETCH characters, each with the first width - 1 of the next: together they hold each window once."""
    def joined(cut):
        after = F.transform(F.sequence(F.lit(1), F.size(cut)), lambda k: F.substr(F.coalesce(F.get(cut, k), F.lit("")), F.lit(1), F.lit(width - 1)))
        return F.filter(F.zip_with(cut, after, lambda a, b: F.concat(a, b)), lambda x: F.length(x) >= width)

    return let(F.regexp_extract_all(s, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0)), joined)


def _stretch_entropy(s: Column, width: int) -> Column:
    """The largest Shannon entropy, in bits, of any window of a short string.

    ``total`` is the sum of c * log2 c over the window's character counts. The
    count of the entering character rises by one (to one more than its
    occurrences just before), that of the leaving one falls by one (from one
    more than its occurrences just behind): only these two change the total.
    """
    cost = [0.0] + [c * math.log2(c) - (c - 1) * math.log2(max(c - 1, 1)) for c in range(1, width + 1)]
    change = lambda c: F.get(F.array(*map(F.lit, cost)), c)
    count = lambda w, c: F.length(w) - F.length(F.replace(w, c, F.lit(""))) + 1
    char = lambda i: F.substr(s, i, F.lit(1))
    rise = lambda i: change(count(F.substr(s, F.greatest(i - width + 1, F.lit(1)), F.least(i - 1, F.lit(width - 1))), char(i)))
    fall = lambda i: change(count(F.substr(s, i + 1, F.lit(width - 1)), char(i)))
    changes = F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.struct((rise(i) - F.when(i > width, fall(i - width)).otherwise(0.0)).alias("by"), (i >= width).alias("full")))

    def step(acc, x):
        total = acc["total"] + x["by"]
        return F.struct(total.alias("total"), F.when(x["full"], F.least(acc["least"], total)).otherwise(acc["least"]).alias("least"))

    return F.aggregate(changes, F.struct(F.lit(0.0).alias("total"), F.lit(float("inf")).alias("least")), step, lambda acc: F.round(math.log2(width) - acc["least"] / width, 9))


def window_entropy(s: Column, width: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits, of any window; strings are at least that long. Linear in the length."""
    return F.array_max(F.transform(stretches(s, width), lambda x: _stretch_entropy(x, width)))


def reaches(s: Column, bits: Column, width: int = WINDOW) -> Column:
    """Whether any window has that many bits: ends with the first stretch that has one."""
    return F.exists(stretches(s, width), lambda x: _stretch_entropy(x, width) >= bits)


def scan(docs: DataFrame, text: str = "text", out: str = "spans", width: int = WINDOW, classes=CLASSES, allow=ALLOW) -> DataFrame:
    """Adds ``out``: array<struct<start, kind, end>> sorted, kind a number of KINDS. All columns of docs stay."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    long_enough = F.regexp_extract_all(body, F.lit(ASSIGN), F.lit(2))
    assign = F.when(body.rlike(ASSIGN), F.filter(F.zip_with(_between(body, ASSIGN), long_enough, lambda m, v: F.when(F.length(v) >= 8, _span("assign", m))), lambda x: x.isNotNull())).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    base = F.concat(assign, F.transform(_matches(body, ACCESS), lambda m: _span("access", m)), F.transform(_matches(body, HEX), lambda m: _span("hex", m)))

    def unusual(m):
        limit = F.lit(None).cast("double")
        for _, pattern, bits in reversed(classes):
            limit = F.when(m["s"].rlike(pattern), F.lit(float(bits))).otherwise(limit)
        allowed = F.lit(False)
        for pattern in allow:
            allowed = allowed | m["s"].rlike(pattern)
        # the class is told once, not again for each stretch
        return F.when(limit.isNotNull() & ~allowed, let(limit, lambda bits: reaches(m["s"], bits, width))).otherwise(F.lit(False))

    names = [c for c in docs.columns if c.lower() != out.lower()]
    kept = docs.select(*[F.col(f"`{c}`") for c in names], base.alias("__base"), F.filter(_matches(body, CANDIDATE), unusual).alias("__more"))
    every = F.sort_array(F.concat("__base", F.transform("__more", lambda m: _span("entropy", m))))
    return kept.select(*[F.col(f"`{c}`") for c in names], let(every, _uncovered).alias(out))


def _uncovered(spans: Column) -> Column:
    """Sorted spans without the entropy spans that lie within a span of another kind: such a one starts before or with it and ends no earlier."""
    entropy = KINDS.index("entropy")
    reach = running(F.transform(spans, lambda x: F.when(x["kind"] == entropy, 0).otherwise(x["end"]).cast("long")), lambda a, b: F.greatest(a, b))
    kept = F.zip_with(spans, reach, lambda x, r: F.struct(x.alias("x"), ((x["kind"] != entropy) | (r < x["end"])).alias("keep")))
    return F.transform(F.filter(kept, lambda k: k["keep"]), lambda k: k["x"])


def text_of(spans: Column, kinds=KINDS) -> Column:
    """kind:start:end of those kinds, joined by commas."""
    at = [KINDS.index(k) for k in kinds]
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.filter(spans, lambda x: x["kind"].isin(at)), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == KINDS.index(kind))).cast("long")
