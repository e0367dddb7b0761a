"""Ranked lexical search without an index: an automaton of all items' terms reads each text and counts what it holds.

The terms of a block of items become one Aho-Corasick automaton, each term guarded by a blank on both sides. A text, its
separators made blanks, is read straight through it: every output is one whole term of the text. A first scan sums what
weights need: number and size of texts and in how many each term stands. A second scan counts again, and the outputs'
term numbers lead to the items that ask for them; a task keeps the best texts of each item and nothing else. So neither
postings nor texts are shuffled: a task sends one number a term, then at most k rows an item.

Items are taken in blocks of BLOCK distinct (item, term) pairs at most; a single item with more is a block of its own.
Blocks bound what the driver and the tasks hold; each reads the documents twice.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices

#: Distinct (item, term) pairs whose automaton goes to all tasks at once, a few ten MB.
BLOCK = 1 << 17
#: Scores of texts by items that are worked on at once.
CELLS = 1 << 21
#: Bytes of a text that the automaton reads at once; it is cut between two terms.
PIECE = 1 << 20
BLANK = 32
_IS_TERM = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
_READ = bytes((c + 32 if 65 <= c <= 90 else c) if _IS_TERM[c] else BLANK for c in range(256))
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_STATS = pa.schema([("term", pa.int64()), ("n", pa.int64())])
#: Numbers beside the terms' own: texts with a term, and terms with repeats.
TEXTS, TERMS = -1, -2


@dataclass
class Block:
    """Items and the terms that they ask for: items[at[t] : at[t + 1]] want term t."""

    ids: list
    terms: list[bytes]
    at: np.ndarray
    items: np.ndarray

    def automaton(self) -> ahocorasick.Automaton | None:
        """Each guarded term gives its number; bytes stand as letters of the same value."""
        if not self.terms:
            return None
        found = ahocorasick.Automaton()
        for n, t in enumerate(self.terms):
            found.add_word(f" {t.decode('latin-1')} ", n)
        found.make_automaton()
        return found


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term as bytes), each pair once; a row without an id or text has none, texts under one id are one item."""
    found = items.where("item_id is not null").select("item_id", F.explode(F.array_remove(F.split("text", _BETWEEN), "")).alias("term"))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return found.select("item_id", F.translate("term", upper, lower).cast("binary").alias("term")).distinct()


def _blocks(items: DataFrame) -> Iterator[Block]:
    """Blocks of whole items; their number doubles until each holds no more than BLOCK pairs or a single item."""
    pairs = item_terms(items).persist()
    try:
        n = max(1, -(-pairs.count() // BLOCK))
        while True:
            block = F.pmod(F.xxhash64(F.col("item_id").cast("string")), F.lit(n))
            largest = pairs.groupBy(block.alias("b")).agg(F.count("*").alias("pairs"), F.count_distinct("item_id").alias("ids")).where("ids > 1").agg(F.max("pairs")).first()[0]
            if (largest or 0) <= BLOCK:
                break
            n *= 2
        for b in range(n):
            rows = pairs.where(block == b).collect()  # BLOCK pairs at most
            ids, terms = sorted({r["item_id"] for r in rows}), sorted({bytes(r["term"]) for r in rows})
            number, place = {t: i for i, t in enumerate(terms)}, {x: i for i, x in enumerate(ids)}
            wanted = np.array(sorted((number[bytes(r["term"])], place[r["item_id"]]) for r in rows), np.int64).reshape(-1, 2)
            yield Block(ids, terms, np.searchsorted(wanted[:, 0], np.arange(len(terms) + 1)), wanted[:, 1])
    finally:
        pairs.unpersist()


def _pieces(text: bytes) -> Iterator[str]:
    """The text with a blank at both ends, cut at blanks if it is long; pieces share the blank between them."""
    text, lo = b" " + text + b" ", 0
    while len(text) - lo > PIECE:
        hi = text.find(b" ", lo + PIECE)
        if hi < 0 or hi == len(text) - 1:
            break
        yield text[lo : hi + 1].decode("latin-1")
        lo = hi
    yield text[lo:].decode("latin-1")


def read(texts: list[bytes | None], automaton: ahocorasick.Automaton | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms in each text, and (text, term, times) of the automaton's outputs."""
    plain = [(t or b"").translate(_READ) for t in texts]
    sizes = np.zeros(len(plain), np.int64)
    for lo, hi in slices(plain):
        inner = np.frombuffer(b" " + b" ".join(plain[lo:hi]) + b" ", np.uint8) != BLANK
        begin = np.flatnonzero(inner[1:] & ~inner[:-1])
        ends = np.cumsum([len(t) + 1 for t in plain[lo:hi]])
        sizes[lo:hi] = np.diff(np.searchsorted(begin, ends, "left"), prepend=0)
    text, term, times = [], [], []
    if automaton is not None:
        for i, t in enumerate(plain):
            found: Counter = Counter()
            for piece in _pieces(t):
                found.update(n for _, n in automaton.iter(piece))
            text.append(np.full(len(found), i))
            term.append(np.fromiter(found.keys(), np.int64, len(found)))
            times.append(np.fromiter(found.values(), np.int64, len(found)))
    joined = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (text, term, times)]
    return sizes, *joined


def statistics(docs: DataFrame, block: Block) -> dict[int, int]:
    """In how many texts each term of the block stands; under TEXTS and TERMS the sums over all texts."""

    def run(batches):
        automaton, df, texts, terms = block.automaton(), np.zeros(len(block.terms), np.int64), 0, 0
        for batch in batches:
            sizes, _, term, _ = read(batch.column("text").to_pylist(), automaton)
            df += np.bincount(term, minlength=len(df))
            texts, terms = texts + int((sizes > 0).sum()), terms + int(sizes.sum())
        seen = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.append(seen, [TEXTS, TERMS])), pa.array(np.append(df[seen], [texts, terms]))], schema=_STATS)

    partial = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "term long, n long")
    return {r["term"]: r["n"] for r in partial.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row for each term of the block


def weights(df: np.ndarray, texts: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * texts + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)


class Best:
    """The k best texts of each item so far: most score first, then the lowest id."""

    def __init__(self, items: int, k: int):
        self.k, self.floor = k, np.ones(items, np.int64)
        self.item = self.doc = self.score = np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """scores: a row for each of ids, a column for each item."""
        at, item = np.nonzero(scores >= self.floor)
        item, doc, score = np.append(self.item, item), np.append(self.doc, ids[at]), np.append(self.score, scores[at, item])
        order = np.lexsort((doc, -score, item))
        item, doc, score = item[order], doc[order], score[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        self.item, self.doc, self.score, rank = (x[rank < self.k] for x in (item, doc, score, rank))
        full = rank == self.k - 1
        self.floor[self.item[full]] = self.score[full]


def _search_block(docs: DataFrame, block: Block, counts: dict[int, int], texts: int, terms: int, k: int) -> DataFrame:
    weight = weights(np.array([counts.get(t, 0) for t in range(len(block.terms))], np.int64), texts)
    wanted = np.diff(block.at)

    def run(batches):
        automaton, best = block.automaton(), Best(len(block.ids), k)
        rows = max(1, CELLS // max(1, len(block.ids)))
        for batch in batches:
            ids, body = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("text").to_pylist()
            for lo in range(0, len(body), rows):
                sizes, text, term, times = read(body[lo : lo + rows], automaton)
                m = 100 - 90 + (90 * sizes * texts) // max(1, terms)
                part = weight[term] * ((1_000_000_000 * times) // (1000 * times + 8 * m[text]))
                # each output goes to all items that want its term
                n = wanted[term]
                at = np.repeat(block.at[term] - np.cumsum(n) + n, n) + np.arange(n.sum())
                scores = np.zeros((len(sizes), len(block.ids)), np.int64)
                np.add.at(scores.reshape(-1), np.repeat(text, n) * len(block.ids) + block.items[at], np.repeat(part, n))
                best.add(ids[lo : lo + rows], scores)
        yield pa.record_batch([pa.array(best.item), pa.array(best.doc), pa.array(best.score)], names=["item", "doc_id", "score"])

    given = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    found = given.mapInArrow(run, "item long, doc_id long, score long").withColumn("_task", F.spark_partition_id())
    # the best of some tasks each, then of all: what one task gathers for an item stays small
    order = F.desc("score"), F.asc("doc_id")
    some = found.withColumn("_r", F.row_number().over(Window.partitionBy("item", F.pmod("_task", F.lit(64))).orderBy(*order))).where(F.col("_r") <= k)
    top = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    kind = {int: "long", str: "string"}[type(block.ids[0])]
    names = docs.sparkSession.createDataFrame([(i, x) for i, x in enumerate(block.ids)], f"item long, item_id {kind}")
    return top.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score) of the k best documents of each item whose score is above 0, all if they are fewer.

    docs: doc_id, text; items: item_id (a number or a string), text. Equal scores go by ascending doc_id. A null or empty
    text has no terms; texts of any length are read whole, in pieces. Rows without a doc_id count in the statistics and
    are never returned; repeated rows are documents of their own; items without terms, or terms that no text holds, have
    no rows. Other columns play no part.
    """
    totals, out = None, None
    for block in _blocks(items):
        if not block.ids:
            continue
        counts = statistics(docs, block)
        totals = totals or (counts.get(TEXTS, 0), counts.get(TERMS, 0))
        found = _search_block(docs, block, counts, *totals, k)
        out = found if out is None else out.unionByName(found)
    if out is None:
        kind = dict(items.dtypes)["item_id"]
        return docs.sparkSession.createDataFrame([], f"item_id {'long' if kind in ('int', 'bigint') else kind}, rank int, doc_id long, score long")
    return out
