"""Structured Streaming twins of ingestion, trace metrics and memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stage_latency(events: DataFrame, width: str = "10 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(window_start, stage, n, total_ms) per window; rows later than the watermark are dropped when streaming.

    events: ts, stage, elapsed_ms. The same plan runs over a table.
    """
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = events.withWatermark("ts", late).groupBy(window.alias("w"), "stage").agg(F.count("*").alias("n"), F.sum("elapsed_ms").alias("total_ms"))
    return out.select(F.col("w.start").alias("window_start"), "stage", "n", "total_ms")


def session_windows(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, session_start, n) of runs of events of one user."""
    out = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), "n")


def first_seen(files: DataFrame, late: str = "1 day") -> DataFrame:
    """Files (file_hash, ts, ...) whose hash was not seen within the watermark."""
    return files.withWatermark("ts", late).dropDuplicatesWithinWatermark(["file_hash"])


def incremental_ingest(files: DataFrame, ingest: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Each batch of new files to ingest(batch, batch_id), which must give the same tables if a batch comes again."""

    def once(batch: DataFrame, batch_id: int) -> None:
        ingest(batch.dropDuplicates(["file_hash"]), batch_id)

    return files.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def last_messages(messages: DataFrame, n: int = 10) -> DataFrame:
    """(session, turn, role, text): after each batch, the last n messages of the sessions it touched.

    State holds n messages per session, whatever the session's length.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        for frame in frames:
            kept += frame[["turn", "role", "text"]].itertuples(index=False, name=None)
        kept = sorted((tuple(k) for k in kept), key=lambda m: m[0])[-n:]
        state.update((kept,))
        yield pd.DataFrame([(key[0], *k) for k in kept], columns=["session", "turn", "role", "text"])

    kind = dict(messages.dtypes)["session"]
    return messages.groupBy("session").applyInPandasWithState(
        update, f"session {kind}, turn long, role string, text string", "kept array<struct<turn: long, role: string, text: string>>", "update", GroupStateTimeout.NoTimeout
    )
