"""A quality classifier from trusted positives and unlabelled text.

The class prior is estimated first, then a small network is trained by minimising the non-negative unbiased risk:
prior * loss(positives, +) + max(0, loss(unlabelled, -) - prior * loss(positives, -)). Negatives' labels are never used.

The trusted positives are a bounded sample of the labelled rows. Unlabelled text is all that lies outside the test
fold: the prior counts every row, and after a start on a few rows every shard of all rows goes on learning, and the
shards' weights are averaged by their rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .quality_rules import MONOTONE, labelled, statistics

INPUTS = list(MONOTONE)
#: Labelled positives that are trusted, at most; unlabelled rows that the learning starts with, about; rows in a shard, about.
POSITIVES, START, SHARD = 10_000, 15_000, 50_000
#: Shares of the positives above which the prior is looked for.
CUTS = 91
THRESHOLD = 0.3
HELD_OUT = 5


@dataclass
class Network:
    """One hidden layer over standardised statistics."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) / self.scale, -6, 6) @ self.w1 + self.b1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.hidden(x) @ self.w2 + self.b2, -40, 40)))


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def fit(pos: np.ndarray, unl: np.ndarray, prior: float | None, units: int = 24, epochs: int = 60, batch: int = 512, rate: float = 0.01, decay: float = 1e-4, seed: int = 7, start: Network | None = None) -> Network:
    """Train on positives and unlabelled rows. With a prior: the non-negative unbiased risk; without: positives against unlabelled.

    Where the negatives' part of a batch falls below zero, the step goes the other way along that part. start: a
    network to go on from.
    """
    rng = np.random.default_rng(seed)
    if start is None:
        both = np.concatenate([pos, unl])
        start = Network(both.mean(0), both.std(0) + 1e-6, rng.normal(0, 1 / np.sqrt(pos.shape[1]), (pos.shape[1], units)), np.zeros(units), rng.normal(0, 1 / np.sqrt(units), units), 0.0)
    flat = [start.w1.copy(), start.b1.copy(), start.w2.copy(), np.array([start.b2])]
    net = Network(start.mean, start.scale, *flat[:3], start.b2)
    moment, square, step = [np.zeros_like(a) for a in flat], [np.zeros_like(a) for a in flat], 0
    for epoch in range(epochs):
        p_order, u_order = rng.permutation(len(pos)), rng.permutation(len(unl))
        rounds = max(1, len(unl) // batch)
        for p_at, u_at in zip(np.array_split(p_order, rounds) if len(pos) >= rounds else [p_order] * rounds, np.array_split(u_order, rounds), strict=True):
            x = np.concatenate([pos[p_at], unl[u_at]])
            z = np.clip((x - net.mean) / net.scale, -6, 6)
            h = np.tanh(z @ flat[0] + flat[1])
            out = h @ flat[2] + flat[3][0]
            is_pos, p, u = np.arange(len(x)) < len(p_at), len(p_at), len(u_at)
            s = 1 / (1 + np.exp(-np.clip(out, -40, 40)))
            if prior is None:
                grad = np.where(is_pos, (s - 1) / p, s / u)
            else:
                negative = _softplus(out[p:]).mean() - prior * _softplus(out[:p]).mean()
                plus, minus = np.where(is_pos, prior * (s - 1) / p, 0), np.where(is_pos, -prior * s / p, s / u)
                grad = plus + minus if negative >= 0 else -minus
            back = np.outer(grad, flat[2]) * (1 - h * h)
            step += 1
            for k, g in enumerate((z.T @ back + decay * flat[0], back.sum(0), h.T @ grad + decay * flat[2], np.array([grad.sum()]))):
                moment[k] += 0.1 * (g - moment[k])
                square[k] += 0.001 * (g * g - square[k])
                flat[k] -= rate * (1 - epoch / epochs) * (moment[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
        net.b2 = float(flat[3][0])
    return net


def rankers(pos: np.ndarray, unl: np.ndarray, half: np.ndarray) -> list[Network]:
    """For each half, a classifier of positives against unlabelled that was fitted on the other half."""
    return [fit(pos[1 - h :: 2], unl[half != h], None, epochs=15) for h in (0, 1)]


def prior_above(pos: np.ndarray, nets: list[Network], above, n: int) -> float:
    """The share of positives among n unlabelled rows, from above; above(cuts): how many of them score so high, by the net of their half.

    Above any cut the unlabelled hold at least prior times the positives' share, so the least ratio over the cuts
    bounds the prior.
    """
    p = np.sort(np.concatenate([nets[h].score(pos[h::2]) for h in (0, 1)]))
    cuts = np.quantile(p, np.linspace(0, 0.9, CUTS))
    above_p, above_u = 1 - np.searchsorted(p, cuts, "left") / len(p), above(cuts) / n
    slack = np.sqrt(np.log(20) / 2) * (1 / np.sqrt(len(p)) + 1 / np.sqrt(n))
    best = int(np.argmin((above_u + slack) / np.maximum(above_p, 1e-9)))
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


def _reached(nets: list[Network], x: np.ndarray, half: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    s = np.sort(np.where(half == 0, nets[0].score(x), nets[1].score(x)))
    return len(s) - np.searchsorted(s, cuts, "left")


def class_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """The share of positives among the unlabelled rows, from above."""
    half = np.arange(len(unl)) % 2
    nets = rankers(pos, unl, half)
    return prior_above(pos, nets, lambda cuts: _reached(nets, unl, half, cuts), len(unl))


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the network's inputs for each row's whole text, as a table that has been cut.

    Null text counts as empty; rows without a doc_id are left out, other columns ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = C.encoded(batch["text"])
            for lo, hi in C.slices(texts):
                yield statistics(texts[lo:hi])[INPUTS].assign(doc_id=batch["doc_id"].to_numpy()[lo:hi])

    return C.cut(C.identified(docs).mapInPandas(run, ", ".join([*(f"{c} double" for c in INPUTS), "doc_id long"])))


def train(stats: DataFrame, labels: DataFrame, positives: int = POSITIVES) -> Network | None:
    """A network from the features of rows outside the test fold; None if there are too few positives or texts.

    At most `positives` labelled rows are trusted, the first by a hash of doc_id; a doc_id with contradicting labels is
    not. Every row outside the fold counts as unlabelled, repeated ones as often as they occur.
    """
    rows = stats.where(C.fold("doc_id", HELD_OUT) != 0).withColumn("draw", F.xxhash64("doc_id", F.lit(1)))
    n = rows.count()
    some = rows.where(F.pmod("draw", F.lit(1 << 30)) < int(min(1.0, START / max(n, 1)) * (1 << 30)))
    good = rows.join(F.broadcast(labelled(labels, positives, HELD_OUT, 1)), "doc_id")  # bounded by positives
    good, some = (x.select(*INPUTS, "doc_id", "draw").toPandas().sort_values(["draw", "doc_id", *INPUTS], kind="stable") for x in (good, some))
    pos, first = good.drop_duplicates("doc_id")[INPUTS].to_numpy(), some[INPUTS].to_numpy()
    if len(pos) < 4 or len(first) < 4:
        return None
    nets = rankers(pos, first, some["draw"].to_numpy() & 1)

    def reached(cuts: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"at": np.arange(CUTS), "n": _reached(nets, batch[INPUTS].to_numpy(), batch["draw"].to_numpy() & 1, cuts)})

        out = np.zeros(CUTS)
        for r in rows.select(*INPUTS, "draw").mapInPandas(run, "at int, n long").groupBy("at").sum("n").collect():
            out[r[0]] = r[1]
        return out

    prior = prior_above(pos, nets, reached, n)
    net = fit(pos, first, prior)
    spread = stats.sparkSession.sparkContext.broadcast((net, pos))  # of bounded size

    def tuned(part: pd.DataFrame) -> pd.DataFrame:
        net, pos = spread.value
        part = part.sort_values(["draw", "doc_id", *INPUTS], kind="stable")  # rows come in any order
        got = fit(pos, part[INPUTS].to_numpy(), prior, epochs=2, rate=0.002, start=net)
        flat = np.concatenate([got.w1.ravel(), got.b1, got.w2, [got.b2]])
        return pd.DataFrame({"place": np.arange(len(flat)), "value": flat * len(part), "n": len(part)})

    shard = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(-(-n // SHARD)))
    runs = rows.withColumn("shard", shard).groupBy("shard").applyInPandas(tuned, "place int, value double, n long")
    means = runs.groupBy("place").agg((F.sum("value") / F.sum("n")).alias("mean")).orderBy("place").toPandas()["mean"].to_numpy()  # the network's size
    spread.unpersist()
    w1, b1, w2, b2 = np.split(means, np.cumsum([net.w1.size, net.b1.size, net.w2.size]))
    return Network(net.mean, net.scale, w1.reshape(net.w1.shape), b1, w2, float(b2[0]))


def score(stats: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of the features.

    Equal texts get equal scores. Without a network (no positives) every score is 1. Repeated rows are scored one by
    one; an empty table gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # rounded, as a product's last digits depend on the rows beside it
            s = np.round(net.score(batch[INPUTS].to_numpy()), 9) if net else np.ones(len(batch))
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(), "score": s})

    scored = stats.mapInPandas(run, "doc_id long, score double")
    return scored.select("doc_id", (C.fold("doc_id", HELD_OUT) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, net: Network | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least the threshold, with all their columns as they were.

    Null text counts as empty. Repeated rows are judged alike, rows without a doc_id like all others. Without a
    network every row stays.
    """
    return C.where_rows(docs, lambda texts: np.round(net.score(statistics(texts)[INPUTS].to_numpy()), 9) >= threshold) if net else docs
