"""Chat formatting of reply trees.

Messages are nodes (tree, node, parent).  Iterative self-joins double the
reach of a pointer to an ancestor and the score summed on the way, so after
log2(depth) joins each leaf has its path's score and length.  The best
``branches`` leaves of each tree are chosen; the same pointers, taken in
descending reach, enumerate the nodes on each chosen path.  Only ids travel in
the joins; texts join the chosen paths at the end.

Template: ``<|turn|>ROLE\\nTEXT<|end|>\\n`` for each turn.  In roles and texts
``\\`` becomes ``\\\\`` and ``<|`` becomes ``<\\|``, so no control string can
arise from them and both read back exactly; a line break in a role becomes
``\\n``.  The loss mask covers assistant texts, as (start, end) code points of
the formatted string.

Null roles and texts are empty.  A parent that does not exist makes a root;
nodes on a cycle have no root and take part in no path.  A null tree is a tree
like any other; rows without a node are no messages.  Of repeated rows of a node
the smallest counts.  Ties between leaves go to the smaller node.  An empty table
gives an empty result.  A long conversation comes in parts of PART turns.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

TURN, END, BRANCHES, PART = "<|turn|>", "<|end|>\n", 1, 1024


def escape(s: str) -> str:
    return s.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], s, flags=re.DOTALL)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans under the loss mask."""
    out, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}".replace("\n", "\\n") + "\n", escape(text)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), mask


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """Reads a formatted conversation back."""
    out = []
    for part in formatted.split(TURN)[1:]:
        role, _, text = part.partition("\n")
        out.append((unescape(role), unescape(text[: text.rindex(END)])))
    return out


#: A tree without an id is a tree as well: joins are on both.
TREE = ["none", "tree"]


def messages_of(rows: DataFrame) -> DataFrame:
    """TREE, node, parent, score, role, text: one row for each message; repeated rows of a node count as their smallest."""
    c = lambda name, type_, default: F.coalesce(F.col(name).cast(type_), F.lit(default)).alias(name)
    own = [c("role", "string", ""), c("text", "string", "")] if "text" in rows.columns else []
    plain = rows.where("node is not null").select(F.col("tree").isNull().alias("none"), F.coalesce("tree", F.lit(0)).cast("long").alias("tree"), F.col("node").cast("long").alias("node"), F.struct(F.col("parent").cast("long").alias("parent"), c("score", "double", 0.0), *own).alias("x"))
    return plain.groupBy(*TREE, "node").agg(F.min("x").alias("x")).select(*TREE, "node", "x.*")


def paths(nodes: DataFrame, branches: int = BRANCHES) -> DataFrame:
    """(tree, leaf, branch, depth, node) of the nodes on each tree's best paths; nodes: tree, node, parent, score.

    A path's rank is its mean score, then its length, then the smaller leaf.
    """
    found = _paths(messages_of(nodes), branches, Scratch(nodes.sparkSession, "chat"))
    return found.select(F.when(~F.col("none"), F.col("tree")).alias("tree"), "leaf", "branch", "depth", "node")


def _paths(rows: DataFrame, branches: int, scratch: Scratch) -> DataFrame:
    real = rows.select(*TREE, F.col("node").alias("parent"), F.lit(True).alias("there"))
    base = rows.join(real, [*TREE, "parent"], "left").select(*TREE, "node", F.when(F.col("there"), F.col("parent")).alias("up"), "score", F.lit(1).cast("long").alias("n"))
    level = scratch.write(base)
    longest = _deepest(level)
    reached = [level.where("up is null")]  # nodes whose pointer has passed their root: they are joined no more
    jumps = [scratch.write(level.where("up is not null"))]
    while not jumps[-1].isEmpty() and 2 ** (len(jumps) - 1) <= longest:  # beyond that, what has an ancestor ahead is on a cycle
        last = known = jumps[-1]
        for done in reached:
            known = known.unionByName(done)
        over = known.select(*TREE, F.col("node").alias("up"), F.col("up").alias("up2"), F.col("score").alias("score2"), F.col("n").alias("n2"))
        step = scratch.write(last.join(over, [*TREE, "up"]).select(*TREE, "node", F.col("up2").alias("up"), (F.col("score") + F.col("score2")).alias("score"), (F.col("n") + F.col("n2")).alias("n")))
        reached.append(step.where("up is null"))
        jumps.append(scratch.write(step.where("up is not null")))
    total = reached[0]
    for done in reached[1:]:
        total = total.unionByName(done)
    inner = jumps[0].select(*TREE, F.col("up").alias("node")).distinct()
    rank = F.row_number().over(Window.partitionBy(*TREE).orderBy(F.desc(F.col("score") / F.col("n")), F.desc("n"), "node"))
    chosen = scratch.write(total.join(inner, [*TREE, "node"], "left_anti").withColumn("branch", rank).where(F.col("branch") <= branches).select(*TREE, F.col("node").alias("leaf"), "branch", F.col("n").alias("depth"), "node"))
    for k in range(len(jumps) - 1, -1, -1):  # reach 2^k: every node of the set adds the one that far above it
        far = jumps[k].select(*TREE, "node", "up")
        above = chosen.join(far, [*TREE, "node"]).select(*TREE, "leaf", "branch", (F.col("depth") - F.lit(2**k)).alias("depth"), F.col("up").alias("node"))
        chosen = scratch.write(chosen.unionByName(above))
    scratch.keep_only(chosen)
    return chosen


def _deepest(base: DataFrame) -> int:
    """No path is longer than the largest tree."""
    return base.groupBy(*TREE).count().agg(F.max("count")).first()[0] or 0


def _cuts(sizes: list[int], most: int = 4_000_000):
    """(from, to) of stretches of rows that hold about ``most`` bytes (one row at least)."""
    a = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield a, i
            a, held = i, 0
        held += n
    if sizes:
        yield a, len(sizes)


def format_trees(messages: DataFrame, branches: int = BRANCHES) -> DataFrame:
    """tree, branch, part, n_turns, formatted, mask (array<struct<start, end>>, within the part); messages: tree, node, parent, score, role, text.

    A conversation is one part up to PART turns; a longer one is several, so that no task holds it whole.
    """
    scratch = Scratch(messages.sparkSession, "messages")
    rows = scratch.write(messages_of(messages))
    on_path = _paths(rows.select(*TREE, "node", "parent", "score"), branches, Scratch(messages.sparkSession, "chat"))
    full = on_path.join(rows.select(*TREE, "node", "role", "text"), [*TREE, "node"])
    part = F.expr(f"cast((depth - 1) div {PART} as int)").alias("part")
    turns = full.groupBy(*TREE, "branch", part).agg(F.array_sort(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"), F.sum(F.octet_length("role") + F.octet_length("text")).alias("bytes"))
    turns = turns.select(F.when(~F.col("none"), F.col("tree")).alias("tree"), "branch", "part", "turns", "bytes")
    schema = pa.schema([("tree", pa.int64()), ("branch", pa.int32()), ("part", pa.int32()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("mask", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def run(batches):
        for batch in batches:
            for a, z in _cuts(batch.column("bytes").to_pylist()):
                out = []
                for r in batch.slice(a, z - a).to_pylist():
                    formatted, mask = format_turns([(t["role"], t["text"]) for t in r["turns"]])
                    out.append({"tree": r["tree"], "branch": r["branch"], "part": r["part"], "n_turns": len(r["turns"]), "formatted": formatted, "mask": [{"start": a, "end": z} for a, z in mask]})
                yield pa.RecordBatch.from_pylist(out, schema)

    return turns.mapInArrow(run, "tree long, branch int, part int, n_turns long, formatted string, mask array<struct<start:long,end:long>>")


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from the formatted conversations and their masks: parts in order, one at a time."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches):
        key, out = None, []

        def done():
            return {"conv_id": key[0], "n_turns": n, "turns_sha256": whole.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": length}

        for batch in batches:
            for a, z in _cuts(batch.column("bytes").to_pylist()):
                for r in batch.slice(a, z - a).to_pylist():
                    if key != (r["tree"], r["branch"]):
                        if key:
                            out.append(done())
                        key, n, chars, length, whole, loss = (r["tree"], r["branch"]), 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                    for role, text in parse_turns(r["formatted"]):
                        whole.update(f"{role}\n{text}\n".encode())
                        n += 1
                    for m in r["mask"]:
                        text = unescape(r["formatted"][m["start"] : m["end"]])
                        loss.update(text.encode())
                        chars += len(text)
                    length += len(r["formatted"])
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
        if key:
            out.append(done())
        yield pa.RecordBatch.from_pylist(out, schema)

    parts = formatted.withColumn("bytes", F.octet_length("formatted")).repartition("tree", "branch").sortWithinPartitions("tree", "branch", "part")
    return parts.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def as_chains(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as trees with one branch: each row replies to the one before. Null conv_ids are one conversation."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")
