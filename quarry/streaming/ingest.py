"""Resumable ingestion and incremental roll-ups on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.functions import urls as ux


def distinct_urls(items: DataFrame, column: str = "url", watermark: tuple[str, str] | None = None) -> DataFrame:
    """Items whose canonical url was not seen before, across restarts; with a watermark the state is bounded."""
    rows = items.withColumn("url_key", ux.canonical_key(F.col(column)))
    if watermark:
        return rows.withWatermark(*watermark).dropDuplicatesWithinWatermark(["url_key"])
    return rows.dropDuplicates(["url_key"])


def within_budget(items: DataFrame, budgets: dict[str, int], initial: dict[str, int] | None = None, order: str = "seq") -> DataFrame:
    """The first B items of each section, counted in state; ``initial`` is what was written before the first start.

    Inside a micro-batch items count in ``order``.  A section without a budget passes.  No more is
    held of a section than what its budget leaves and one Arrow batch.
    """
    names, done = items.columns, initial or {}

    def accept(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count = state.get[0] if state.exists else done.get(key[0], 0)
        if key[0] not in budgets:
            yield from (rows[names] for rows in frames)
            return
        left, kept = max(budgets[key[0]] - count, 0), None
        for rows in frames:
            kept = (rows if kept is None else pd.concat([kept, rows])).sort_values(order).head(left)
        state.update((count + len(kept),))
        yield kept[names]

    keyed = items.withColumn("section", F.coalesce(F.nullif(F.col("section"), F.lit("")), F.lit("unknown"))).select(*names)
    return keyed.groupBy("section").applyInPandasWithState(accept, items.schema, "n long", "append", GroupStateTimeout.NoTimeout)


def suggestion_weights(rows: DataFrame) -> DataFrame:
    """Running weights by term, in update mode."""
    return rows.groupBy("term").agg(F.sum("weight").alias("weight"))


def windowed_counts(log: DataFrame, ts: str = "ts", key: str = "event_type", size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """An extension: log roll-ups by event time with late data bounded by a watermark."""
    rows = log.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return rows.groupBy(F.window(ts, size), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def append_to(items: DataFrame, path: str, checkpoint: str, kind: str = "json", once: bool = True) -> StreamingQuery:
    """A file sink: exactly once by the checkpoint's log."""
    writer = items.writeStream.format(kind).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def roll_up(items: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps a table of running aggregates: each micro-batch replaces it by the state's whole result."""
    step = lambda batch, _: batch.write.mode("overwrite").parquet(path)
    return items.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start()


def until(items: DataFrame, limit: int, sink: Callable[[DataFrame, int], None], checkpoint: str, count: Callable[[], int]) -> StreamingQuery:
    """Stops when ``count()`` rows (of the sink) have reached the limit; the batch that reaches it is cut."""
    holder: list[StreamingQuery] = []

    def step(batch: DataFrame, epoch: int) -> None:
        left = limit - count()
        if left > 0:
            sink(batch.limit(left), epoch)
        if left <= 0 or count() >= limit:
            for q in holder:
                q.stop()

    query = items.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    holder.append(query)
    return query
