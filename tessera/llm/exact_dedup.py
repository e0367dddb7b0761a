"""Exact duplicates by progressive refinement: group by length, then by the hash of a prefix, then by the full hash.

A first scan notes only length and prefix hash of each text, 16 bytes a row. Lengths that occur once are settled, and so
are prefixes that occur once within their length. A second scan reads the whole content, and hashes it, only where both
are shared. No text is ever shuffled: groups are formed of 32-byte hashes, counted within each task first, and a row
meets its group in a join that Spark may split, so one text may be that of a third of all rows.

What is shared is sent to the scan as slots, hashed keys, of which there are SLOTS at most whatever the input. Two keys
in one slot only let a row through to the full hash, which then tells it apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Slots of keys that are sent to all tasks, some 40 MB as a hash table.
SLOTS = 1 << 20
#: Characters of a text that its prefix hash reads.
PREFIX = 256


def normalised(text: str | Column = "text") -> Column:
    """The text with each run of ASCII white space as one space; null is empty."""
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(t, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _slot(*cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(SLOTS)).alias("_slot")


def _shared(rows: DataFrame, *cols: str) -> DataFrame:
    """The slots of the values of cols that occur twice or more, small enough to broadcast."""
    return F.broadcast(rows.groupBy(*cols).count().where("count > 1").select(_slot(*cols)).distinct())


def _sized(docs: DataFrame, *more: Column) -> DataFrame:
    whole = docs.select(*more, normalised().alias("_whole"))
    return whole.withColumn("_size", F.length("_whole"))


def decide(docs: DataFrame, carry: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, and the columns of carry) for every row of docs.

    Rows are equal when their texts are after normalised(); null counts as the empty text, empty texts are equal, a text
    of any length is compared whole. Of equal rows exactly one is kept: that with the smallest doc_id, of repeated rows
    under this id any one, and a row without an id only where none has one. keep_id is the id of the kept row. carry names
    expressions over the columns of docs. No row, no result; other columns of docs stay out.
    """
    start = F.xxhash64(F.substring("_whole", 1, PREFIX)).alias("_start")
    marks = cut(_sized(docs).select("_size", start))
    by_size = _shared(marks, "_size")
    by_start = _shared(marks.withColumn("_slot", _slot("_size")).join(by_size, "_slot", "left_semi").drop("_slot"), "_size", "_start")

    carried = F.struct(*(e.alias(n) for n, e in (carry or {"_none": F.lit(None)}).items())).alias("_carried")
    whole = _sized(docs, F.col("doc_id"), carried).select("*", start).withColumn("_slot", _slot("_size", "_start"))
    live = whole.join(by_start.withColumn("_live", F.lit(True)), "_slot", "left")
    full = F.when(F.col("_live"), F.unhex(F.sha2("_whole", 256))).alias("_full")
    rows = cut(live.select("doc_id", "_carried", full, F.monotonically_increasing_id().alias("_row")))

    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("_first")
    groups = cut(rows.where("_full is not null").groupBy("_full").agg(F.count("*").alias("_n"), first).where("_n > 1"))
    lone = rows.where("_full is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "_carried")
    met = rows.where("_full is not null").join(groups, "_full", "left")
    of_group = met.select(
        "doc_id", F.when(F.col("_n").isNull(), F.col("doc_id")).otherwise(F.col("_first.doc_id")).alias("keep_id"), F.coalesce("_n", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("_row") == F.col("_first._row"), F.lit(True)).alias("kept"), "_carried",
    )
    found = lone.unionByName(of_group)
    return found.select("doc_id", "keep_id", "group_size", "kept", *(F.col(f"_carried.{n}").alias(n) for n in carry or {}))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs that decide() keeps, with all their columns; a row's columns travel with it once."""
    return decide(docs, {"_own": F.struct(*docs.columns)}).where("kept").select("_own.*")
