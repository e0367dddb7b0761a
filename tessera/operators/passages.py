"""Which texts hold which passages letter by letter, by the hashes of their windows.

A passage of n bytes is known by two windows of w bytes, the largest power of two up to n: the one at its start and the
one at its end, which together cover it. Windows of all powers of two are hashed by doubling, so a text is gone through
once a size, whatever the number of passages; what both windows agree on is compared then. Passages go to the tasks in
blocks of bounded size, and texts stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of passages that go to all tasks at once; more are taken in blocks, a longer passage alone.
BLOCK = 1 << 22
#: Bytes of texts that are worked on at once; numpy's temporaries take some thirty times this.
PIECE = 1 << 20
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _doubled(h: np.ndarray, w: int) -> np.ndarray:
    """Hashes of windows of 2 w bytes from those of w bytes."""
    out = (h[: len(h) - w] * _MIX) ^ (h[w:] + (h[w:] << np.uint64(7)))
    return out ^ (out >> np.uint64(29))


def _windows(buf: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(w, hashes of all windows of w bytes) for w = 1, 2, 4 ... up to most."""
    h, w = (buf.astype(np.uint64) + np.uint64(1)) * _MIX, 1
    while True:
        yield w, h
        if 2 * w > most or 2 * w > len(buf):
            return
        h, w = _doubled(h, w), 2 * w


class Finder:
    """Passages by the size of their windows."""

    def __init__(self, passages: list[bytes]):
        self.passages, self.empty = passages, [n for n, p in enumerate(passages) if not p]
        self.most = max(map(len, passages), default=0)
        self.by_size: dict[int, list[tuple[int, int, int, int]]] = {}
        for n, p in enumerate(passages):
            if p:
                *_, (w, h) = _windows(np.frombuffer(p, np.uint8), len(p))
                self.by_size.setdefault(w, []).append((int(h[0]), int(h[len(p) - w]), len(p) - w, n))
        self.keys = {w: np.array(sorted({a for a, *_ in known}), np.uint64) for w, known in self.by_size.items()}
        self.of = {}
        for w, known in self.by_size.items():
            for start, end, gap, n in known:
                self.of.setdefault((w, start), []).append((end, gap, n))

    def find(self, texts: list[bytes | None]) -> set[tuple[int, int]]:
        """(text, passage) for each passage that a text holds; the empty one is in every text but null."""
        found = {(i, n) for i, t in enumerate(texts) if t is not None for n in self.empty}
        step = max(PIECE, 2 * self.most)
        run: list[tuple[int, bytes]] = []
        size = 0
        for i, t in enumerate(texts):
            for lo in range(0, len(t or b""), step):  # pieces of a long text overlap by a passage
                piece = t[lo : lo + step + self.most - 1]
                if size + len(piece) > step and run:
                    self._find_in(run, found)
                    run, size = [], 0
                run.append((i, piece))
                size += len(piece)
        if run:
            self._find_in(run, found)
        return found

    def _find_in(self, run: list[tuple[int, bytes]], found: set[tuple[int, int]]) -> None:
        joined = b"".join(p for _, p in run)
        ends = np.cumsum([len(p) for _, p in run])
        for w, h in _windows(np.frombuffer(joined, np.uint8), self.most):
            if w not in self.keys:
                continue
            keys = self.keys[w]
            place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            at = np.flatnonzero(keys[place] == h)
            order = np.argsort(place[at], kind="stable")
            at, key = at[order], place[at][order]
            for lo, hi in zip(*(x.tolist() for x in _runs(key)), strict=True):
                for end, gap, n in self.of[w, int(keys[key[lo]])]:
                    starts = at[lo:hi]
                    starts = starts[starts + gap < len(h)]
                    starts = starts[h[starts + gap] == np.uint64(end)]
                    piece = np.searchsorted(ends, starts, "right")
                    inside = starts + gap + w <= ends[piece]  # not across the border of two texts
                    for s, p in zip(starts[inside].tolist(), piece[inside].tolist(), strict=True):
                        pair = (run[p][0], n)
                        if pair not in found and joined[s : s + gap + w] == self.passages[n]:
                            found.add(pair)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values starts and ends."""
    starts = np.flatnonzero(np.diff(values, prepend=values[:1] - 1)) if len(values) else np.zeros(0, np.int64)
    return starts, np.append(starts[1:], len(values)) if len(starts) else starts


def holders(chunks: DataFrame, passages: DataFrame) -> DataFrame:
    """(qid, id): chunks (id, text) that hold the passage of (qid, passage) letter by letter.

    Passages, a stated set, meet all texts block by block. Null texts hold nothing, null passages are held by nothing,
    the empty passage by every text. A chunk's row gives a pair once, repeated rows give it again.
    """
    known = passages.where("passage is not null").select("qid", F.col("passage").cast("binary").alias("passage"))
    total = known.agg(F.sum(F.octet_length("passage"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK))
    schema = f"qid {dict(passages.dtypes)['qid']}, id {dict(chunks.dtypes)['id']}"
    texts, out = chunks.select("id", F.col("text").cast("binary").alias("text")), None
    for b in range(blocks):
        some = known if blocks == 1 else known.where(F.pmod(F.xxhash64("qid", "passage"), F.lit(blocks)) == b)
        rows = some.collect()  # BLOCK bytes, about
        names = pa.array([r["qid"] for r in rows], _ARROW[dict(passages.dtypes)["qid"]])
        part = texts.mapInArrow(_held(names, [bytes(r["passage"]) for r in rows]), schema)
        out = part if out is None else out.unionByName(part)
    return out


def _held(names: pa.Array, passages: list[bytes]):
    def run(batches):
        finder = Finder(passages)
        for batch in batches:
            pairs = sorted(finder.find(batch.column("text").to_pylist()))
            at, which = (pa.array([p[x] for p in pairs], pa.int64()) for x in (0, 1))
            yield pa.record_batch([names.take(which), batch.column("id").take(at)], names=["qid", "id"])

    return run
