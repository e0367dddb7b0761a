"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

A document is its token ids and then an end id. Runs of a whole window leave as windows of their own; what
remains of each document is cut into pieces and dealt to groups of bounded size. Within a group the pieces are
split over just enough windows by differencing: partial partitions are merged so that the fullest window of one
meets the emptiest of the other. If the fullest window still exceeds the capacity, the number of windows rises.
Only the pieces' sizes are shuffled, never their tokens.
"""

from __future__ import annotations

import heapq
import os
import sys
import zlib
from array import array
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

CAPACITY = 1024
#: The longest piece of a document's remainder; short pieces let windows come out equal.
PIECE = 512
#: Pieces of a group on average. A group is one task's work; its windows are dealt among its own pieces only.
GROUP_PIECES = 512
END_ID = 0
#: Words whose ids a worker keeps, some 200 bytes each; beyond that it starts anew.
CACHE_WORDS = 1_000_000
#: Characters tokenized at once.
SLICE = 1 << 22
#: Signs that follow a word as one part, whatever their number.
SIGNS = ".,;:!?#%*$&|)"
#: White space besides the space and the line feed.
OTHER_SPACE = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"]


def _byte_letters() -> dict[int, str]:
    """The letter for each byte in a byte-level vocabulary: printable ones stand for themselves, others follow from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in shown else next(others)) for b in range(256)}


BYTE_LETTERS = _byte_letters()


def _bytes(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes() if sys.byteorder == "big" else array("I", ids).tobytes()


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = f"{PIECES}, sequence_id long, offset long"


class WordTokenizer:
    """Token ids of whole texts, with the ids of space-separated words kept.

    A single space between two other characters always begins a new part of the vocabulary's pre-tokenizer, so words
    can be encoded apart, each part once. Other texts are encoded as they are.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.parts_of = regex.compile(public_tokenizers.PATTERN).findall
        self.parts: dict[str, bytes] = {}
        self.kept = _Words(self)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        for kept in (self.kept, self.parts):
            if len(kept) > CACHE_WORDS:
                kept.clear()
        split = [t.split(" ") if self._apart(t) else None for t in texts]
        # first words stand without a space before them, all others with one
        heads = self.tokenizer.encode_batch_fast([t if w is None else w[0] for t, w in zip(texts, split, strict=True)], add_special_tokens=False)
        get = self.kept.__getitem__
        return [_bytes(h.ids) if w is None else _bytes(h.ids) + b"".join(map(get, w[1:])) for h, w in zip(heads, split, strict=True)]

    def word(self, word: str) -> bytes:
        """The ids of a space and a word."""
        letters = word.rstrip(SIGNS)
        if letters.isalpha():  # letters, then signs: the commonest two parts
            signs = word[len(letters) :]
            return self._part(f" {letters}") + self._part(signs) if signs else self._part(f" {letters}")
        return b"".join(map(self._part, self.parts_of(f" {word}")))

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            # ASCII letters stand for their own bytes
            letters = f"{BYTE_LETTERS[32]}{part[1:]}" if part[0] == " " and part.isascii() and part[1:].isalpha() else part.encode().decode("latin-1").translate(BYTE_LETTERS)
            self.parts[part] = found = _bytes([t.id for t in self.tokenizer.model.tokenize(letters)])
        return found

    def _apart(self, text: str) -> bool:
        """Whether each space stands between two characters that are no white space."""
        if text[:1].isspace() or text[-1:].isspace() or any(p in text for p in ("  ", " \n", "\n ", *self.special)):
            return False
        return not any(c in text and (f" {c}" in text or f"{c} " in text) for c in OTHER_SPACE)


class _Words(dict):
    """Words already encoded; others are encoded when asked for."""

    def __init__(self, tokenizer: WordTokenizer):
        self.tokenizer = tokenizer

    def __missing__(self, word: str) -> bytes:
        self[word] = found = self.tokenizer.word(word)
        return found


def tokenize(batches: Iterator[pd.DataFrame], path: str, capacity: int, piece: int) -> Iterator[pd.DataFrame]:
    """Pieces of each document: whole windows first, then the remainder in short pieces."""
    tokenizer = WordTokenizer(path)
    for batch in batches:
        ids, texts = batch["doc_id"].to_numpy(), ["" if t is None else t for t in batch["text"]]
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) < SLICE):
                size += len(texts[hi])
                hi += 1
            rows: list[tuple] = []
            for d, b in zip(ids[lo:hi], tokenizer.encode(texts[lo:hi]), strict=True):
                b += END_ID.to_bytes(4, "little")
                n = len(b) // 4
                whole = n // capacity * capacity
                starts = [*range(0, whole, capacity), *range(whole, n, piece)]
                for s, e in zip(starts, [*starts[1:], n], strict=True):
                    rows.append((d, s, e - s, zlib.crc32(b[4 * s : 4 * e]), n))
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            lo = hi


def differencing(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each item, by multiway differencing; sums come out near equal.

    Ties fall by the items' order, so the result depends on the sizes alone.
    """
    # A partial partition: its windows' sums in falling order, and the items of each. Sums are kept less their least.
    heap: list[tuple] = []
    for i in np.argsort(-sizes, kind="stable"):
        heap.append((-int(sizes[i]), int(i), [(int(sizes[i]), [int(i)])]))
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        # both list their non-empty windows, fullest first; a's empty windows, then its emptiest, meet b's fullest
        room = windows - len(a)
        if len(b) == 1:
            (s, items), (t, own) = b[0], a.pop() if not room else (0, [])
            insort(a, (s + t, own + items), key=lambda x: -x[0])
            least = a[-1][0] if len(a) == windows else 0
            heapq.heappush(heap, (-(a[0][0] - least), serial, a))
            serial += 1
            continue
        merged = a[::-1]
        for k, (s, items) in enumerate(b[room:]):
            t, own = merged[k]
            merged[k] = (s + t, own + items)
        merged += b[:room]
        merged.sort(key=lambda x: -x[0])
        least = merged[-1][0] if len(merged) == windows else 0
        heapq.heappush(heap, (-(merged[0][0] - least), serial, merged))
        serial += 1
    out = np.zeros(len(sizes), np.int64)
    for w, (_, items) in enumerate(heap[0][2] if heap else []):
        out[items] = w
    return out


def pack_group(group: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Windows for one group's pieces: whole windows as they are, the rest by differencing."""
    group = group.sort_values(["doc_id", "start", "length", "ids_crc32"], kind="stable").reset_index(drop=True)
    length = group["length"].to_numpy()
    window, offset = np.full(len(group), -1, np.int64), np.zeros(len(group), np.int64)
    whole = length == capacity
    window[whole] = np.arange(whole.sum())
    rest = np.flatnonzero(~whole)
    if len(rest):
        sizes = length[rest]
        count = -(-int(sizes.sum()) // capacity)
        while True:
            of = differencing(sizes, count)
            if np.bincount(of, sizes).max() <= capacity:
                break
            count += 1
        order = np.argsort(of, kind="stable")
        ends = np.cumsum(sizes[order])
        begin = ends - sizes[order]
        first = np.searchsorted(of[order], of[order], "left")
        offset[rest[order]] = begin - begin[first]
        window[rest] = whole.sum() + of
    return group.assign(window=window, offset=offset)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, piece: int = PIECE, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per piece of each document, with its window (sequence_id) and place there.

    Null text counts as empty: such a document is its end id alone. Repeated rows are packed as often as they
    occur; rows without a doc_id are left out. Other columns are ignored. An empty table gives no rows. Pieces that
    fill a window have it to themselves and go nowhere; all others are dealt to groups by a hash of doc_id and start, as
    many groups as these pieces need, so a document of any length is spread over many groups.
    """
    capacity, piece = int(capacity), int(min(piece, capacity))
    rows = C.cut(C.identified(docs).mapInPandas(lambda it: tokenize(it, tokenizer_path, capacity, piece), PIECES))
    part = rows.where(F.col("length") < capacity)
    groups = max(1, part.count() // group_pieces)
    dealt = part.withColumn("group", F.pmod(F.xxhash64("doc_id", F.floor(F.col("start") / (64 * capacity))), F.lit(groups)))
    packed = dealt.groupBy("group").applyInPandas(lambda pdf: pack_group(pdf, capacity), f"{PIECES}, group long, window long, offset long")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    shared = packed.select(*columns, (F.col("group") * F.lit(1 << 31) + F.col("window")).alias("sequence_id"), "offset")
    # numbers of their own, beyond those of the groups
    whole = rows.where(F.col("length") == capacity).select(*columns, (F.lit(1 << 62) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return shared.unionByName(whole)
