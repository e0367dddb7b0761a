"""Quality rules: a base rule, then gradient-boosted trees over document statistics.

The statistics are counted in numpy, many texts at once. Trees are grown on a bounded sample of labelled rows, with
monotonic constraints on chosen statistics, and flattened to node arrays: every tree is a complete binary tree whose
nodes stand in breadth-first order, so scoring walks all texts down one level at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
#: Labelled rows that the trees are grown on, at most.
SAMPLE = 20_000
#: A text goes if its chance of being good is lower.
THRESHOLD = 0.3

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The trees' inputs; +1: never worse when larger, -1: never better, 0: free.
MONOTONE = {
    "log_words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1, "digit_share": 0,
    "bang_share": -1, "bar_share": -1, "comma_share": 0, "stop_share": 0, "line_length": 0, "other_share": 0, "stutter_share": -1,
}
_CLASSES = {"upper": range(65, 91), "digit": range(48, 58), "bang": b"!", "bar": b"|", "comma": b",", "stop": b".", "line": b"\n", "symbol": SYMBOLS}


def _mask(codes) -> np.ndarray:
    m = np.zeros(256, bool)
    m[list(codes)] = True
    return m


_MASKS = {k: _mask(v) for k, v in _CLASSES.items()}
_STARTS = ~_mask(range(0x80, 0xC0))
_OTHER = _mask(range(0x80, 0x100))


def repeated_words(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Words per text that lie in a three-word window found at least twice in that text."""
    if len(h) < 3:
        return np.zeros(n, np.int64)
    key = C.shingles(h, 3)
    inside = doc[2:] == doc[:-2]
    at = np.flatnonzero(inside)
    _, back, times = np.unique(key[at] ^ C.mix(doc[at].astype(np.uint64) + np.uint64(7)), return_inverse=True, return_counts=True)
    twice = at[times[back] > 1]
    hit = np.zeros(len(h), bool)
    for j in range(3):
        hit[twice + j] = True
    return np.bincount(doc[hit], minlength=n)


def statistics(texts: list[bytes]) -> pd.DataFrame:
    """The base counts and the trees' inputs of each text."""
    w, n = C.Words(texts), len(texts)
    count = {k: w.per_text(m[w.buf]) for k, m in _MASKS.items()}
    count["line"] -= 1  # the feed that stands behind each text
    inside = ~w.space
    chars = w.per_text(inside & _STARTS[w.buf])
    dup = np.zeros(n, np.int64)
    for i, t in enumerate(texts):
        if b"\n" in t:
            lines = [x for x in t.split(b"\n") if x.strip()]
            dup[i] = len(lines) - len(set(lines))
    h = w.hashes()
    out = pd.DataFrame({"n_words": w.count, "word_chars": chars, "n_symbols": count["symbol"], "n_dup_lines": dup, "n_repeat_words": repeated_words(h, w.doc, n)})
    words, some = np.maximum(w.count, 1), np.maximum(chars, 1)
    out["log_words"] = np.log1p(w.count)
    out["word_length"] = chars / words
    out["symbol_share"] = count["symbol"] / words
    out["dup_line_share"] = dup / (count["line"] + 1)
    out["repeat_share"] = out["n_repeat_words"] / words
    for k in ("upper", "digit"):
        out[f"{k}_share"] = count[k] / some
    for k in ("bang", "bar", "comma", "stop"):
        out[f"{k}_share"] = count[k] / words
    out["line_length"] = np.log1p(w.count / (count["line"] + 1))
    out["other_share"] = w.per_text(_OTHER[w.buf]) / some
    out["stutter_share"] = np.bincount(w.doc[1:][(h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])], minlength=n) / words
    return out


def base_failed(n_words, n_repeat_words):
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > 50 * n_words)


@dataclass
class Trees:
    """Complete trees of one depth. feature, cut: (trees, inner nodes); leaf: (trees, leaves); start: the first log-odds."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The chance of label 1 of each row."""
        total = np.full(len(x), self.start)
        row, inner = np.arange(len(x)), self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while node.size and node[0] < inner:  # all rows are on one level
                node = 2 * node + 1 + (x[row, feature[node]] > cut[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def grow(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 80, depth: int = 3, rate: float = 0.2, bins: int = 64, penalty: float = 1.0, least: float = 5.0) -> Trees | None:
    """Boosted trees for log loss; None without rows of both labels.

    A split on a constrained input is taken only if its leaves rank as asked, and the middle of the two bounds all
    leaves below it, so no later split can undo the order.
    """
    if len(np.unique(y)) < 2:
        return None
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    code = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
    start = float(np.log(y.mean() / (1 - y.mean())))
    total, inner = np.full(len(y), start), 2**depth - 1
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(len(y), np.int64)
        low, high = np.full(2 * inner + 1, -np.inf), np.full(2 * inner + 1, np.inf)
        value = np.zeros(2 * inner + 1)
        for k in range(inner):
            mine = np.flatnonzero(node == k)
            low[2 * k + 1 : 2 * k + 3], high[2 * k + 1 : 2 * k + 3] = low[k], high[k]
            value[2 * k + 1 : 2 * k + 3] = value[k]
            best = None
            if len(mine):
                gs, hs = g[mine].sum(), h[mine].sum()
                if k == 0:
                    value[:] = np.clip(-gs / (hs + penalty), low[0], high[0])
                    value[1:3] = value[0]
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    c = code[mine, f]
                    gl, hl = (np.cumsum(np.bincount(c, v, len(e) + 1))[:-1] for v in (g[mine], h[mine]))
                    gr, hr = gs - gl, hs - hl
                    vl, vr = (np.clip(-a / (b + penalty), low[k], high[k]) for a, b in ((gl, hl), (gr, hr)))
                    gain = -(gl * vl + (hl + penalty) * vl**2 / 2) - (gr * vr + (hr + penalty) * vr**2 / 2)
                    gain[(np.minimum(hl, hr) < least / 20) | (monotone[f] * (vr - vl) < 0)] = -np.inf
                    b = int(np.argmax(gain))
                    if np.isfinite(gain[b]) and (best is None or gain[b] > best[0]):
                        best = (gain[b], f, b, vl[b], vr[b])
                v = value[k]
                if best and best[0] <= -(gs * v + (hs + penalty) * v**2 / 2) + 1e-6:
                    best = None
            if best:
                _, f, b, vl, vr = best
                feature[t, k], cut[t, k] = f, edges[f][b]
                value[2 * k + 1], value[2 * k + 2] = vl, vr
                if monotone[f]:
                    middle, up = (vl + vr) / 2, 2 * k + (2 if monotone[f] > 0 else 1)
                    low[up] = max(low[up], middle)
                    down = 4 * k + 3 - up
                    high[down] = min(high[down], middle)
                node[mine] = 2 * k + 1 + (x[mine, f] > cut[t, k])
            else:
                node[mine] = 2 * k + 1
        leaf[t] = rate * value[inner:]
        total += leaf[t][node - inner]
    return Trees(feature, cut, leaf, start)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each row's whole text; null text has no words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = C.encoded(batch["text"])
            for lo, hi in C.slices(texts):
                out = statistics(texts[lo:hi])
                out.insert(0, "doc_id", batch["doc_id"].to_numpy()[lo:hi])
                yield out

    schema = ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS), *(f"{c} double" for c in MONOTONE)])
    return C.identified(docs).mapInPandas(run, schema)


def labelled(labels: DataFrame, rows: int, test_fold: int = 5, quality: int | None = None) -> DataFrame:
    """doc_id and quality of at most `rows` labelled documents outside the test fold, the first by a hash of doc_id.

    Labels that contradict each other for one doc_id are left out, as are null ones. quality: only of this label.
    """
    known = (
        labels.where(F.col("quality").isin(0, 1) & (C.fold("doc_id", test_fold) != 0))
        .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_high")).where("quality = _high")
    )
    known = known if quality is None else known.where(F.col("quality") == quality)
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id", "quality")


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Trees | None:
    """Trees grown on at most `rows` labelled documents outside the test fold; None without labels of both kinds.

    Null texts count as empty; a doc_id that is repeated counts once; rows without a doc_id or a label are not used.
    """
    sample = docs.select("doc_id", "text").join(F.broadcast(labelled(labels, rows)), "doc_id")  # bounded by rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = C.encoded(batch["text"])
            for lo, hi in C.slices(texts):
                yield statistics(texts[lo:hi])[list(MONOTONE)].assign(doc_id=batch["doc_id"].to_numpy()[lo:hi], quality=batch["quality"].to_numpy()[lo:hi])

    found = sample.mapInPandas(run, ", ".join([*(f"{c} double" for c in MONOTONE), "doc_id long", "quality int"])).toPandas()
    found = found.sort_values(["doc_id", *MONOTONE], kind="stable").drop_duplicates("doc_id")
    if found.empty:
        return None
    return grow(found[list(MONOTONE)].to_numpy(), found["quality"].to_numpy().astype(float), list(MONOTONE.values()))


def judge(docs: DataFrame, trees: Trees | None, threshold: float = THRESHOLD) -> DataFrame:
    """The counts, base_failed, score and kept of each row of docs.

    A text that fails the base rule is never kept, null and empty texts among them. Without trees (no labels of both
    kinds) the base rule alone decides. Repeated rows are judged alike, one by one; rows without a doc_id are left out
    and other columns ignored. An empty table gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = C.encoded(batch["text"])
            for lo, hi in C.slices(texts):
                s = statistics(texts[lo:hi])
                failed = base_failed(s["n_words"], s["n_repeat_words"])
                score = trees.score(s[list(MONOTONE)].to_numpy()) if trees else np.where(failed, 0.0, 1.0)
                yield s[list(COUNTS)].assign(doc_id=batch["doc_id"].to_numpy()[lo:hi], base_failed=failed, kept=~failed & (score >= threshold), score=score)

    return C.identified(docs).mapInPandas(run, f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, kept boolean, score double")


def keep_good(docs: DataFrame, trees: Trees | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns as they were.

    Null and empty texts go; repeated rows are judged alike, one by one, and rows without a doc_id like all others.
    """

    def keep(texts: list[bytes]) -> np.ndarray:
        s = statistics(texts)
        good = ~base_failed(s["n_words"], s["n_repeat_words"]).to_numpy()
        return good & (trees.score(s[list(MONOTONE)].to_numpy()) >= threshold) if trees else good

    return C.where_rows(docs, keep)
