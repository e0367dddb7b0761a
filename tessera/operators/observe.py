"""Traces and conversation memory.

A trace: trace_id, trace_type, started_at, elapsed_ms, stages array<struct<stage, elapsed_ms, count, ok>>.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def list_traces(traces: DataFrame, kind: str | None = None, most: int = 100) -> DataFrame:
    """The newest traces first."""
    found = traces.where(F.col("trace_type") == kind) if kind else traces
    return found.orderBy(F.desc("started_at"), "trace_id").limit(most)


def get_trace(traces: DataFrame, trace_id) -> DataFrame:
    return traces.where(F.col("trace_id") == F.lit(trace_id))


def stage_timings(traces: DataFrame) -> DataFrame:
    """(trace_id, position, stage, elapsed_ms), 0 where it is missing."""
    rows = traces.select("trace_id", F.posexplode("stages").alias("position", "s"))
    return rows.select("trace_id", F.col("position").cast("long").alias("position"), "s.stage", F.coalesce("s.elapsed_ms", F.lit(0.0)).alias("elapsed_ms"))


def latest_stage(traces: DataFrame, stage: str) -> DataFrame:
    """(trace_id, elapsed_ms, count) of the last entry of a stage."""
    last = F.element_at(F.filter("stages", lambda s: s["stage"] == stage), -1)
    return traces.where(F.exists("stages", lambda s: s["stage"] == stage)).select("trace_id", last["elapsed_ms"].alias("elapsed_ms"), last["count"].alias("count"))


def search_traces(traces: DataFrame, word: str) -> DataFrame:
    return traces.where(F.contains(F.lower(F.to_json(F.struct("stages"))), F.lit(word.lower())))


def query_funnel(traces: DataFrame, stages: tuple[str, ...] = ("dense", "sparse", "fusion", "rerank")) -> DataFrame:
    """One row per trace: the count of each stage (null: not run) and total_ms."""
    rows = traces.select("trace_id", F.explode("stages").alias("s"))
    count = [F.max(F.when(F.col("s.stage") == s, F.col("s.count"))).alias(f"n_{s}") for s in stages]
    return rows.groupBy("trace_id").agg(*count, F.round(F.sum(F.coalesce("s.elapsed_ms", F.lit(0.0))), 6).alias("total_ms"))


def diagnose(funnel: DataFrame) -> DataFrame:
    """trace_id and findings, an array of what went wrong."""
    none = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    return funnel.select("trace_id", F.array_compact(F.array(
        F.when(F.col("n_dense").isNull(), "dense failed"), F.when(F.col("n_sparse").isNull(), "sparse failed"),
        F.when(F.col("n_dense") == 0, "no dense hits"), F.when(F.col("n_sparse") == 0, "no sparse hits"),
        F.when(F.col("n_fusion").isNull(), "fusion skipped"), F.when(F.col("n_rerank").isNull(), "rerank skipped"),
        F.when(none("n_dense") & none("n_sparse"), "nothing found"),
    )).alias("findings"))


def latency(timings: DataFrame, by: str = "stage") -> DataFrame:
    """Exact median, 95th and 99th percentile of elapsed_ms."""
    p = lambda q: F.round(F.percentile("elapsed_ms", q), 6)
    return timings.groupBy(by).agg(F.count("*").alias("n"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"))


def latency_sketches(timings: DataFrame, by: str = "stage", k: int = 400) -> DataFrame:
    """(by, n, sketch): sketches of elapsed_ms that can be stored, and merged over days or machines; nulls are left out.

    A quantile of a sketch of k = 400 lies within 0.75 % of all rows of the true rank, whatever their number (99 % of
    the time), and a sketch takes some kilobytes.
    """
    return timings.where("elapsed_ms is not null").groupBy(by).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col("elapsed_ms").cast("double"), k).alias("sketch"))


def latency_of_sketches(sketches: DataFrame, by: str = "stage", k: int = 400) -> DataFrame:
    """(by, n, p50, p95, p99) of any number of sketches of each kind."""
    p = lambda q: F.round(F.kll_sketch_get_quantile_double("s", F.lit(q)), 6)
    merged = sketches.groupBy(by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", k).alias("s"))
    return merged.select(by, "n", p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"))


def trace_rows(results: DataFrame, stage: str) -> DataFrame:
    """(qid, stage, n_hits, hits) of a search run, hits in order of rank with scores of four digits."""
    hit = F.struct("rank", "id", F.round("score", 4).alias("score"))
    return results.groupBy("qid").agg(F.count("*").alias("n_hits"), F.array_sort(F.collect_list(hit)).alias("hits")).select("qid", F.lit(stage).alias("stage"), "n_hits", "hits")


def append_messages(history: DataFrame, new: DataFrame) -> DataFrame:
    """History (session, turn, role, text) and new messages (session, seq, role, text), numbered on in order of seq."""
    last = history.groupBy("session").agg(F.max("turn").alias("_last"))
    place = F.row_number().over(Window.partitionBy("session").orderBy("seq"))
    numbered = new.withColumn("_place", place).join(last, "session", "left").withColumn("turn", (F.coalesce("_last", F.lit(-1)) + F.col("_place")).cast("long"))
    return history.select("session", "turn", "role", "text").unionByName(numbered.select("session", "turn", "role", "text"))


def recent_messages(messages: DataFrame, n: int = 10, session: str = "session", order: tuple[str, ...] = ("turn",)) -> DataFrame:
    """The last n messages of each session, oldest first in each."""
    newest = Window.partitionBy(session).orderBy(*(F.desc(c) for c in order))
    return messages.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= n).drop("_n")


def transcripts(messages: DataFrame, n: int = 10) -> DataFrame:
    """(session, transcript) of the last n messages (session, turn, role, text)."""
    line = F.concat("role", F.lit(": "), "text")
    recent = recent_messages(messages, n)
    return recent.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("l")).select("session", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("transcript"))


def clear_sessions(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    return messages.join(sessions, "session", "left_anti")


def merge_preferences(events: DataFrame) -> DataFrame:
    """The latest value per user and key of events (user_id, key, value, at, seq); an empty value stands for a deleted one."""
    return events.groupBy("user_id", "key").agg(F.max_by("value", F.struct("at", "seq")).alias("value"))


def preferences(merged: DataFrame) -> DataFrame:
    """(user_id, preferences map) of values that are not empty."""
    kept = merged.where("value <> ''")
    return kept.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("preferences"))


def session_gaps(events: DataFrame, user: str, ts: str, minutes: int = 30) -> DataFrame:
    """(user, session_start, session_end, n): runs of events of one user with gaps below the limit."""
    return events.groupBy(user, F.session_window(ts, f"{minutes} minutes").alias("w")).agg(F.count("*").alias("n"), F.max(ts).alias("last")).select(user, F.col("w.start").alias("session_start"), F.col("last").alias("session_end"), "n")

