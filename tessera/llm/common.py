"""Helpers shared by the text operators: reading tables, cutting work, hashing words in numpy."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: the bytes \x09-\x0D and \x20. Every other byte belongs to a word.
SPACE_BYTES = (9, 10, 11, 12, 13, 32)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE_BYTES)] = True
#: Texts worked on at once, in bytes; numpy's temporaries take some thirty times this.
SLICE_BYTES = 1 << 20
_MULTIPLIERS = 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def identified(docs: DataFrame) -> DataFrame:
    """doc_id and text of the rows that have a doc_id."""
    return docs.select("doc_id", "text").where("doc_id is not null")


def where_rows(docs: DataFrame, keep) -> DataFrame:
    """The rows of docs for which keep(list of texts as bytes) gives True; every column stays as it is."""

    def run(batches):
        for batch in batches:
            texts = encoded(batch.column("text").to_pylist())
            mask = np.concatenate([np.asarray(keep(texts[lo:hi]), bool) for lo, hi in slices(texts)]) if texts else np.zeros(0, bool)
            yield batch.filter(pa.array(mask))

    return docs.mapInArrow(run, docs.schema)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Send at most so many rows to Python at once: texts are long, and both copies of a batch are held in memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def fold(column: str | Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n."""
    return F.pmod(F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")), F.lit(n))


def shared_checkpoints(spark: SparkSession) -> None:
    """Use the folder in spark.checkpoint.dir for checkpoint(). Where none is named, a local session takes one of its own; a cluster has to name one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """The rows as a checkpoint in the shared folder; later jobs read it instead of recomputing."""
    shared_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, *by: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, in a folder for each value of the columns `by`: a read of one value leaves the others alone."""
    spark = df.sparkSession
    shared_checkpoints(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stored-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def encoded(texts) -> list[bytes]:
    """UTF-8 of each text; null is empty, lone surrogates become '?'."""
    return [b"" if t is None or t != t else t.encode("utf-8", "replace") for t in texts]


def slices(texts: list[bytes], limit: int = SLICE_BYTES):
    """(from, to) of runs of texts of about `limit` bytes; a longer text is a run of its own."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64); unsigned arithmetic wraps."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWER = mix((np.arange(1, _MULTIPLIERS + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def lower_ascii(text: bytes) -> bytes:
    return text.translate(_LOWER)


class Words:
    """The words of several texts, side by side.

    buf: the texts' bytes with a line feed between them; base: each text's start in buf;
    start, end: each word's place; doc: each word's text; count: words per text.
    """

    def __init__(self, texts: list[bytes]):
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.base = np.cumsum(sizes + 1) - sizes - 1
        self.space = _IS_SPACE.take(self.buf)
        edge = np.flatnonzero(np.diff(np.concatenate(([True], self.space))))
        self.start, self.end = edge[::2], edge[1::2]
        self.doc = np.searchsorted(self.base, self.start, "right") - 1
        self.count = np.bincount(self.doc, minlength=len(texts))
        self.first = np.cumsum(self.count) - self.count

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        size = self.end - self.start
        if not len(size):
            return np.zeros(0, np.uint64)
        at = np.cumsum(size) - size
        place = np.arange(size.sum(), dtype=np.int64) - np.repeat(at, size)
        factor = _POWER[place & (_MULTIPLIERS - 1)]
        if size.max() > _MULTIPLIERS:
            factor = factor + (place >> 16).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD92)
        h = np.add.reduceat((self.buf[~self.space].astype(np.uint64) + np.uint64(1)) * factor, at)
        return mix(h + size.astype(np.uint64))

    def text_keys(self, ids: np.ndarray) -> np.ndarray:
        """A 64-bit key of each row: its id and whole text."""
        place = np.arange(len(self.buf), dtype=np.int64) - np.repeat(self.base, np.diff(np.append(self.base, len(self.buf))))
        factor = _POWER[place & (_MULTIPLIERS - 1)] + (place >> 16).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD92)
        h = np.add.reduceat((self.buf.astype(np.uint64) + np.uint64(1)) * factor, self.base)
        return mix(mix(h) ^ ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)

    def per_text(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text the mask over buf marks."""
        return np.add.reduceat(mask, self.base, dtype=np.int64) if len(self.base) else np.zeros(0, np.int64)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k word hashes, in text order; empty if there are fewer."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j]
        out ^= out >> np.uint64(32)
    return mix(out)
