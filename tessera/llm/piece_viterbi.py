"""SentencePiece encoding and decoding by a Viterbi search that shares prefixes.

A text's spaces become marks, and each run of marks opens a word. The distinct words of a batch are sorted, so that
they lie in the order in which a depth-first walk of their trie meets them; the forward table up to each position
depends on the prefix alone and is reused from one word to the next as far as both agree.

The file's scores are merge ranks. Added up they would prefer a few early pieces to the right ones, so a path is scored
by its steps: two neighbouring pieces score zero if merging by rank leaves the border between them alone, minus
infinity if not. Exactly one path through a word has no bad step, and it is the one that the merges give: what happens
on either side of a border that is not crossed depends on the two pieces next to it alone. The ids are those of the
library with the same file.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from math import inf
from os.path import commonprefix

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import common as C

MARK = "▁"
#: Words whose pieces a worker keeps, and pairs whose borders it knows; beyond that it starts anew.
CACHE_WORDS, CACHE_PAIRS = 600_000, 2_000_000
#: Characters encoded at once.
SLICE = 1 << 21
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class Pieces:
    """The vocabulary: normal pieces with their merge ranks, and an id for each byte."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.text = [model.id_to_piece(i) for i in ids]
        self.byte_of = {i: int(self.text[i][3:5], 16) for i in ids if model.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        self.special = {i for i in ids if model.is_control(i) or model.is_unknown(i)}
        self.id = {self.text[i]: i for i in ids if i not in self.byte_of and i not in self.special}
        self.rank = {p: -model.get_score(i) for p, i in self.id.items()}
        #: The merges that make up a piece, in order: rank, and the piece's first and last part after it.
        self.made = {p: steps for p in self.id if (steps := self.merges(p)) is not None}
        #: Every ending of a piece that merges make; whether it is itself one.
        self.endings = {p[i:]: p[i:] in self.made for p in self.made for i in range(len(p))}
        self.borders: dict[tuple[str, str], bool] = {}
        self.kept: dict[str, bytes] = {}

    def merges(self, piece: str) -> list[tuple[float, str, str]] | None:
        """How merging by rank, leftmost first among equals, puts the piece together; None if it doesn't come to one part."""
        parts, out = list(piece), []
        while len(parts) > 1:
            rank, at = min((self.rank.get(x + y, inf), k) for k, (x, y) in enumerate(zip(parts, parts[1:])))
            if rank == inf:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            out.append((rank, parts[0], parts[-1]))
        return out

    def apart(self, left: str, right: str) -> bool:
        """Whether merging the two pieces' characters gives the two pieces: no merge ever crosses the border."""
        x, y = left[-1], right[0]
        todo, then = iter(self.made.get(left, ())), iter(self.made.get(right, ()))
        end = (inf, "", "")
        step, other = next(todo, end), next(then, end)
        while True:
            across = self.rank.get(x + y, inf)
            if across < step[0] and across <= other[0]:
                return False
            if step[0] == other[0] == inf:
                return True
            if step[0] <= other[0]:
                x, step = step[2], next(todo, end)
            else:
                y, other = other[1], next(then, end)

    def segment(self, words: list[str]) -> dict[str, list[int]]:
        """The pieces of each word; words are walked in sorted order and share what they have in common."""
        endings, borders, made = self.endings, self.borders, self.made
        found: dict[str, list[int]] = {}
        ends: list[str] = [""]  # the last piece of the best path to each position
        last = ""
        for word in sorted(words):
            at = len(commonprefix((last, word)))
            del ends[at + 1 :]
            for end in range(at + 1, len(word) + 1):
                fitting, start = [], end - 1
                while start >= 0 and (whole := endings.get(word[start:end])) is not None:
                    if whole:
                        fitting.append(word[start:end])
                    start -= 1
                best = word[end - 1]  # a character outside the vocabulary stands for itself
                for piece in reversed(fitting):
                    before = ends[end - len(piece)]
                    if not before:
                        best = piece
                        break
                    if (free := borders.get((before, piece))) is None:
                        free = borders[before, piece] = self.apart(before, piece)
                    if free:
                        best = piece
                        break
                ends.append(best)
            ids, end = [], len(word)
            while end:
                piece = ends[end]
                ids += [self.id[piece]] if piece in made else [self.byte_id[b] for b in reversed(piece.encode("utf-8", "replace"))]
                end -= len(piece)
            found[word] = ids[::-1]
            last = word
        if len(borders) > CACHE_PAIRS:
            borders.clear()
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as 32-bit numbers in the machine's order; an empty text has none."""
        if len(self.kept) > CACHE_WORDS:
            self.kept.clear()
        split = [_WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        words = set(chain.from_iterable(split))
        for w, ids in self.segment([w for w in words if w not in self.kept]).items():
            self.kept[w] = array("i", ids).tobytes()
        get = {w: self.kept[w] for w in words}.__getitem__
        return [b"".join(map(get, s)) for s in split]

    def decode(self, ids) -> str:
        """The text of the ids: marks become spaces, the first one goes, runs of byte ids are read as UTF-8."""
        out, pending = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                pending.append(self.byte_of[i])
                continue
            if pending:
                out.append(pending.decode("utf-8", "replace"))
                pending.clear()
            if i not in self.special:
                out.append(self.text[i])
        out.append(pending.decode("utf-8", "replace"))
        text = "".join(out).replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    """The vocabulary of a file; a worker reads it once and keeps what it has learnt of words and borders."""
    return Pieces(path)


def _slices(texts: list[str]):
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > SLICE:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id and ids (array of int) of each row's whole text.

    Null and empty texts have no ids. A mark in a text counts as a space. Repeated rows are kept, rows without a
    doc_id left out, other columns ignored. Nothing is shuffled.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = load(model_path)
        for batch in batches:
            texts, ids = [t or "" for t in batch["text"]], batch["doc_id"].to_numpy()
            for lo, hi in _slices(texts):
                yield pd.DataFrame({"doc_id": ids[lo:hi], "ids": [np.frombuffer(b, np.int32) for b in pieces.encode(texts[lo:hi])]})

    return C.identified(docs).mapInPandas(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of each row's ids; null ids give null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = load(model_path)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": [None if x is None else pieces.decode(x.tolist()) for x in batch["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of little-endian 32-bit ids), n_bytes (ids of single bytes) and round_trip of each row.

    round_trip says that the decoded ids give the text again, marks being spaces.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = load(model_path)
        is_byte = np.zeros(len(pieces.text), bool)
        is_byte[list(pieces.byte_of)] = True
        for batch in batches:
            texts, ids = [t or "" for t in batch["text"]], batch["doc_id"].to_numpy()
            for lo, hi in _slices(texts):
                rows = []
                for i, t, b in zip(ids[lo:hi], texts[lo:hi], pieces.encode(texts[lo:hi]), strict=True):
                    x = np.frombuffer(b, np.int32)
                    rows.append((i, len(x), zlib.crc32(x.astype("<i4").tobytes()), int(is_byte[x].sum()), pieces.decode(x.tolist()) == t.replace(MARK, " ")))
                yield pd.DataFrame(rows, columns=["doc_id", "n_pieces", "ids_crc32", "n_bytes", "round_trip"])

    return C.identified(docs).mapInPandas(run, "doc_id long, n_pieces long, ids_crc32 long, n_bytes long, round_trip boolean")
