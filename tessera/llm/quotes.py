"""Quotation linking, in DataFrame functions only.

Each line's quote level is the number of ">" before it. Lines of one level that follow each other are a passage.
Passages are normalised (lower case, letters and digits only) and hashed, whole, by line and by sentence, and each
quoted hash is joined to the latest earlier message of its conversation whose own text has it. The message answers the
one that its outermost quotes come from. A thread is a first message with all direct and indirect answers to it;
conversations come back thread by thread, answers after what they answer, without quotes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: A line that introduces the quote below it.
INTRODUCES = r"(?i)^\s*\S.*\b(wrote|writes|said|schrieb|écrit|escribió)\s*:\s*$"
_MARKS = r"^((?:\s*>)+)"


def messages(conversations: DataFrame) -> DataFrame:
    """One row for each distinct message, with a key of its own; without a conv_id there is no message, a null turn is -1."""
    rows = conversations.select("conv_id", F.coalesce("turn", F.lit(-1)).cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.where("conv_id is not null").withColumn("key", F.xxhash64("conv_id", "turn", F.coalesce("role", F.lit("\0")), "text"))
    return rows.dropDuplicates(["key"])


def lines(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, key, at, level, body) of every line."""
    split = rows.select("conv_id", "turn", "key", F.posexplode(F.split("text", "\r?\n")).alias("at", "line"))
    marks = F.regexp_extract("line", _MARKS, 1)
    return split.select("conv_id", "turn", "key", "at", F.length(F.regexp_replace(marks, r"[^>]", "")).alias("level"), F.expr("trim(substring(line, length(regexp_extract(line, r'^((?:\\s*>)+)', 1)) + 1))").alias("body"))


def normal(text: str):
    return F.expr(f"trim(regexp_replace(lower({text}), '[^\\\\p{{L}}\\\\p{{N}}]+', ' '))")


def passage_hashes(all_lines: DataFrame) -> DataFrame:
    """(conv_id, turn, key, level, hash, weight) of each passage, of each of its lines and of its sentences."""
    order = Window.partitionBy("key").orderBy("at")
    marked = all_lines.withColumn("opens", (F.col("level") != F.coalesce(F.lag("level").over(order), F.lit(-1))).cast("int"))
    blocks = marked.withColumn("block", F.sum("opens").over(order))
    whole = blocks.groupBy("conv_id", "turn", "key", "level", "block").agg(F.array_sort(F.collect_list(F.struct("at", "body"))).alias("parts"))
    whole = whole.withColumn("joined", F.expr("array_join(transform(parts, p -> p.body), ' ')"))
    units = F.expr("concat(array(joined), transform(parts, p -> p.body), split(joined, '(?<=[.!?])\\\\s+'))")
    each = whole.select("conv_id", "turn", "key", "level", F.explode(units).alias("unit")).withColumn("unit", normal("unit")).where("unit <> ''")
    return each.select("conv_id", "turn", "key", "level", F.xxhash64("unit").alias("hash"), F.length("unit").alias("weight")).distinct()


def parents(rows: DataFrame) -> DataFrame:
    """(key, parent_turn, n_linked): the turn each quoting message answers, and how many of its hashed units led there.

    The quotes of the lowest level that were found count; among their sources the one with most quoted text wins,
    then the latest. A quote is linked to an earlier turn of its own conversation only.
    """
    units = passage_hashes(lines(rows))
    said = units.where("level = 0").select("conv_id", "hash", "turn", F.lit(None).cast("long").alias("key"), F.lit(0).alias("level"), F.lit(0).alias("weight"), F.lit(1).alias("own")).distinct()
    quoted = units.where("level > 0").select("conv_id", "hash", "turn", "key", "level", "weight", F.lit(0).alias("own"))
    needed = said.join(quoted.select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi")
    # the latest earlier turn with that hash, by one pass over both sides in order of turns
    before = Window.partitionBy("conv_id", "hash").orderBy("turn", "own").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    source = F.last(F.when(F.col("own") == 1, F.col("turn")), ignorenulls=True).over(before)
    linked = needed.unionByName(quoted).withColumn("source", source).where("own = 0 and source is not null")
    sums = linked.groupBy("key", "level", "source").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))
    best = sums.groupBy("key").agg(F.min(F.struct("level", (-F.col("weight")).alias("w"), (-F.col("source")).alias("s"), "n")).alias("b"))
    return best.select("key", (-F.col("b.s")).alias("parent_turn"), F.col("b.n").alias("n_linked"))


def roots(answers: DataFrame) -> DataFrame:
    """(conv_id, turn, thread_turn) of each turn that answers another: where its chain of answers starts.

    answers: conv_id, turn, parent_turn with parent_turn < turn. Pointers double, so the rounds grow with the logarithm
    of the longest chain.
    """
    up = C.cut(answers.select("conv_id", "turn", F.col("parent_turn").alias("thread_turn")))
    while True:
        higher = up.select("conv_id", F.col("turn").alias("thread_turn"), F.col("thread_turn").alias("_next"))
        stepped = C.cut(up.join(higher, ["conv_id", "thread_turn"], "left").select("conv_id", "turn", F.coalesce("_next", "thread_turn").alias("thread_turn"), F.col("_next").isNotNull().alias("moved")))
        up = stepped.drop("moved")
        if stepped.where("moved").isEmpty():
            return up


def own_text(text: str):
    """The text without quoted lines and without lines that only introduce a quote; blank lines at both ends go."""
    kept = (
        f"filter(transform(split({text}, '\\r?\\n'), (l, i) -> struct(l, get(split({text}, '\\r?\\n'), i + 1) as below)), "
        f"x -> not x.l rlike '^\\\\s*>' and not (coalesce(x.below, '') rlike '^\\\\s*>' and x.l rlike '{INTRODUCES.replace(chr(92), chr(92) * 2)}'))"
    )
    return F.expr(f"regexp_replace(array_join(transform({kept}, x -> x.l), '\\n'), '^\\\\s*\\n|\\\\s+$', '')")


def threads(conversations: DataFrame) -> DataFrame:
    """One row for each message, ordered by conversation, thread and turn.

    parent_turn is the turn it answers by its quotes (null: none found), thread_turn the first turn of its thread,
    n_quoted its quoted lines, n_linked the quoted units found in the parent, text its own words.
    Identical rows are one message. Rows without a conv_id are left out; null turns come first, as -1; null text is
    empty; other columns are ignored. Where several messages share a turn, the one with the least key stands for it.
    """
    rows = C.cut(messages(conversations))
    found = C.cut(parents(rows))
    placed = rows.join(found, "key", "left")
    answers = found.join(rows.select("key", "conv_id", "turn"), "key").groupBy("conv_id", "turn").agg(F.min_by("parent_turn", "key").alias("parent_turn"))
    up = roots(answers)
    placed = placed.join(up.withColumnRenamed("turn", "parent_turn").withColumnRenamed("thread_turn", "_higher"), ["conv_id", "parent_turn"], "left")
    quoted = F.expr("cast(size(filter(split(text, '\\r?\\n'), l -> l rlike '^\\\\s*>')) as bigint)")
    out = placed.select(
        "conv_id", F.coalesce("_higher", "parent_turn", "turn").alias("thread_turn"), "turn", "parent_turn", "role",
        quoted.alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), own_text("text").alias("text"), "key",
    )
    return out.orderBy("conv_id", "thread_turn", "turn", "key").drop("key")
