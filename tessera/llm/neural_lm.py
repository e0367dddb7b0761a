"""Scoring by a log-bilinear language model trained with noise-contrastive estimation.

Tokens are words, ASCII letters in lower case, and an end after each text. Counts of all training tokens are exact.
The network predicts the class of a token from the classes of the two before it: frequent words and the end are
classes of their own, all others share a class by their last bytes. Within a shared class a word's chance follows from
the counts. Words never seen are one more outcome, with the chance that the base model leaves to such a word; what is
left over is shared out among the known words, so the chances of all outcomes add up to one after every context, and
the score differs from the base score by the network's doing alone.

With two context words the log-bilinear score is (first + second) . word + bias, so the normalisers of all pairs of
contexts come out of one matrix product, which each worker makes once from the weights.

Counts of frequent words go to the tasks as a bounded table. All rarer words are looked up exactly in a join, by the
hash of the word; nothing else is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

HELD_OUT = 10
#: Classes: the end, then frequent words, then shared ones.
WORDS, SHARED = 3071, 1024
CLASSES = 1 + WORDS + SHARED
UNITS = 64
#: Words whose counts are sent to all tasks, at most.
TABLE = 1 << 17
#: Tokens that the weights begin with, about; all training tokens follow in shards of about SHARD, in rounds.
TOKENS, SHARD = 600_000, 2_000_000
#: Tokens that the first learning passes over in all; a small sample is gone over more often.
PASSED = 2_400_000
#: Tokens of one text that go to a shard together, and those that a task holds before it sends them on.
PIECE, HELD = 1 << 16, 3_000_000
#: Parts that the weights are summed in, and shards summed at once.
SLOTS, SUMMED = 64, 64
#: The first step's size for the weights that the learning begins with, and for the shards that go on from them.
RATE, SHARD_RATE = 0.5, 0.3
#: Noise classes drawn for a batch; all its tokens share them.
NOISE = 96
#: Leading bits of a hash by which the table of words is entered.
LEADING = 20
END = 0x1234567
_LN10 = np.log(10)


def word_table(texts: list[bytes]) -> tuple[C.Words, np.ndarray, np.ndarray]:
    """The words of the texts, the hash of each (a signed long, never END) and its shared class."""
    w = C.Words([C.lower_ascii(t) for t in texts])
    h = w.hashes().view(np.int64)
    h[h == END] += 1
    tail = np.maximum(w.end - 3, w.start)
    code = w.buf[w.end - 1].astype(np.uint64) << np.uint64(16) | w.buf[np.maximum(w.end - 2, w.start)].astype(np.uint64) << np.uint64(8) | w.buf[tail]
    shared = 1 + WORDS + (C.mix(code + np.uint64(11)) % np.uint64(SHARED)).astype(np.int64) if len(h) else np.zeros(0, np.int64)
    return w, h, shared


@dataclass
class Counts:
    """Frequent words by falling count (hash and count, sorted by hash), and the totals."""

    hash: np.ndarray
    count: np.ndarray
    own: np.ndarray  # class of its own, or 0
    total: int
    distinct: int
    class_total: np.ndarray  # per shared class: tokens of rarer words

    @property
    def unseen(self) -> float:
        """The chance that the base model gives a word never seen."""
        return 0.1 / (self.total + 0.1 * (self.distinct + 1))

    @cached_property
    def begin(self) -> np.ndarray:
        """Where the hashes of each run of equal leading bits begin: runs are so short that a look at the first mostly settles it."""
        runs = np.arange(-(1 << LEADING - 1), 1 << LEADING - 1) << 64 - LEADING
        return np.append(np.searchsorted(self.hash, runs), len(self.hash)).astype(np.int32)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each hash's place in the table, and whether it is there."""
        if not len(self.hash):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        run = (h >> 64 - LEADING) + (1 << LEADING - 1)
        at, stop = np.minimum(self.begin[run], len(self.hash) - 1), self.begin[1:][run]
        there = self.hash[at] == h
        left = np.flatnonzero(~there & (at + 1 < stop))
        while len(left):
            at[left] += 1
            there[left] = self.hash[at[left]] == h[left]
            left = left[~there[left] & (at[left] + 1 < stop[left])]
        return at, there


@dataclass
class Network:
    """Vectors of words and of both contexts, and biases; norm: the log of each context's normaliser, made when first asked for."""

    word: np.ndarray
    first: np.ndarray
    second: np.ndarray
    bias: np.ndarray

    @cached_property
    def norm(self) -> np.ndarray:
        a, b = (c @ self.word.T for c in (self.first, self.second))
        ma, mb = a.max(1, keepdims=True), b.max(1, keepdims=True)
        a -= ma
        b -= mb
        z = (np.exp(a, out=a) * np.exp(self.bias)) @ np.exp(b, out=b).T
        return np.log(np.maximum(z, 1e-37), out=z) + ma + mb.T

    def log_chance(self, second: np.ndarray, first: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The log of each class's chance after the two classes before it, the nearer one being `first`."""
        out = self.bias.take(c) - self.norm.reshape(-1).take(first * self.norm.shape[1] + second)
        for lo in range(0, len(out), 2048):  # blocks that stay in the processor's cache
            at = slice(lo, lo + 2048)
            context = self.first.take(first[at], 0)
            context += self.second.take(second[at], 0)
            out[at] += np.einsum("ij,ij->i", context, self.word.take(c[at], 0))
        return out


@dataclass
class Weights:
    """Vectors of words and of both contexts, biases, and AdaGrad's sums of squares: four arrays each."""

    values: list[np.ndarray]
    squares: list[np.ndarray]

    def network(self) -> Network:
        return Network(*(v.astype(np.float32) for v in self.values))


def noise(floor: np.ndarray) -> np.ndarray:
    """The chances that noise is drawn by, from the classes' overall counts; a class without a token is never drawn."""
    return floor / max(floor.sum(), 1)


def begun(floor: np.ndarray, seed: int = 3) -> Weights:
    """Weights before any learning; the bias starts at the overall counts."""
    rng, n = np.random.default_rng(seed), len(floor)
    values = [rng.normal(0, 0.1, (n, UNITS)).astype(np.float32) for _ in range(3)] + [np.log(np.maximum(noise(floor), 1e-13)).astype(np.float32)]
    return Weights(values, [np.full(v.shape, 1e-4, np.float32) for v in values])


def ngrams(classes: np.ndarray, lead: tuple[int, int] | np.ndarray = (0, 0)) -> np.ndarray:
    """The code of each token with the two before it, in a run of classes in which class 0 ends each text; nothing before an end counts.

    lead: the two classes before the run.
    """
    c = np.concatenate((lead, classes)).astype(np.int64)
    c1 = c[1:-1]
    return np.where(c1 == 0, 0, c[:-2]) * CLASSES**2 + c1 * CLASSES + c[2:]


def summed_by(rows: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, numbers of classes, and the sum of the gradients of each.

    Sums are of double width. Two columns are added at once, as the parts of a complex number.
    """
    at = np.flatnonzero(np.bincount(rows))
    wide = grad.shape[1]
    if wide % 2:
        grad = np.concatenate((grad, np.zeros((len(grad), 1), grad.dtype)), 1)
    pairs = np.ascontiguousarray(grad, np.float64).view(np.complex128)
    place = np.empty(at[-1] + 1, np.int64)
    place[at] = np.arange(0, len(at) * pairs.shape[1], pairs.shape[1])
    sums = np.zeros((len(at), pairs.shape[1]), np.complex128)
    np.add.at(sums.reshape(-1), (place[rows][:, None] + np.arange(pairs.shape[1])).reshape(-1), pairs.reshape(-1))
    return at, sums.view(np.float64)[:, :wide].astype(np.float32)


def _sigmoid_of_negative(x: np.ndarray) -> np.ndarray:
    """In place; what overflows has a chance of zero."""
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


@np.errstate(over="ignore")
def learn(weights: Weights, codes: np.ndarray, p: np.ndarray, epochs: int, rate: float, batch: int = 1024, seed: int = 3) -> Weights:
    """Go on from weights by noise-contrastive steps over n-grams, each occurrence a row, with noise drawn by p."""
    rng = np.random.default_rng(seed)
    ladder, n = np.cumsum(p), len(p)
    log_kp = np.log(np.maximum(p, 1e-13)).astype(np.float32) + np.float32(np.log(NOISE))
    word, first, second, bias = values = [v.copy() for v in weights.values]
    squares = [q.copy() for q in weights.squares]
    scores, ones = np.empty((batch, NOISE), np.float32), np.ones(batch, np.float32)

    def move(k: int, rows: np.ndarray, grad: np.ndarray, step: float) -> None:
        square = grad * grad
        square += squares[k].take(rows, 0)
        squares[k][rows] = square
        change = np.float32(step) * grad
        change /= np.sqrt(square, out=square)
        values[k][rows] = np.subtract(values[k].take(rows, 0), change, out=change)

    places = [c.astype(np.int16) for c in (codes // CLASSES**2, codes // CLASSES % CLASSES, codes % CLASSES)]
    for epoch in range(epochs):
        order = rng.permutation(len(codes))
        step = rate * (1 - epoch / epochs)
        # noise classes of each batch, shared by its tokens
        noises = np.minimum(np.searchsorted(ladder, rng.random((-(-len(codes) // batch), NOISE)) * ladder[-1], "right"), n - 1)
        for lo in range(0, len(codes), batch):
            c2, c1, w = (c.take(order[lo : lo + batch]).astype(np.int64) for c in places)
            drawn = noises[lo // batch]
            q, v, far = first.take(c1, 0), word.take(w, 0), word.take(drawn, 0)
            q += second.take(c2, 0)
            share = np.float32(1 / len(w))
            g_w = _sigmoid_of_negative(log_kp[w] - bias[w] - np.einsum("ij,ij->i", q, v)) - 1
            # signs and shares are worked into the small factors, not into the scores
            g_n = np.matmul(q, np.negative(far).T, out=scores[: len(w)])
            g_n += log_kp[drawn] - bias[drawn]
            _sigmoid_of_negative(g_n)
            q *= share
            far *= share
            v *= (g_w * share)[:, None]
            v += g_n @ far
            grad = np.empty((len(w) + NOISE, UNITS), np.float32)
            np.multiply(g_w[:, None], q, out=grad[: len(w)])
            np.matmul(g_n.T, q, out=grad[len(w) :])
            to = np.concatenate((w, drawn))
            rows, grad = summed_by(to, grad)
            move(0, rows, grad, step)
            on_bias = np.bincount(to, np.concatenate((g_w, ones[: len(w)] @ g_n)) * share, rows[-1] + 1)
            move(3, rows, on_bias[rows].astype(np.float32), step)
            of_context = v.astype(np.float64)
            move(1, *summed_by(c1, of_context), step)
            move(2, *summed_by(c2, of_context), step)
    return Weights(values, squares)


def fit(classes: np.ndarray, floor: np.ndarray, epochs: int = 4, batch: int = 1024, rate: float = RATE, seed: int = 3) -> Network:
    """Train on one run of classes, in which class 0 ends each text; nothing before an end counts as context.

    floor: the classes' overall counts, which noise is drawn from and which the bias starts at.
    """
    return learn(begun(floor, seed), ngrams(classes), noise(floor), epochs, rate, batch, seed).network()


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes in order, a place of each, any of them, and how often it occurs."""
    order = np.argsort(h)
    h = h[order]
    start = np.flatnonzero(np.concatenate((np.ones(min(len(h), 1), bool), h[1:] != h[:-1])))
    return h[start], order[start], np.diff(np.append(start, len(h)))


def _counted(docs: DataFrame) -> DataFrame:
    """(hash, count, shared): each training word's exact count and its shared class; END for the ends."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []

        def flush() -> pd.DataFrame:
            h, c, s = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(h, kind="stable")
            h, c, s = h[order], c[order], s[order]
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            return pd.DataFrame({"hash": h[first], "count": np.add.reduceat(c, first), "shared": s[first]})

        for batch in batches:
            texts = C.encoded(batch["text"])
            for lo, hi in C.slices(texts):
                _, h, s = word_table(texts[lo:hi])
                u, first, c = distinct(h)
                held.append((np.append(u, END), np.append(c, hi - lo), np.append(s[first], 0).astype(np.int32)))
            if sum(len(x[0]) for x in held) > 1_500_000:
                yield flush()
                held.clear()
        if held:
            yield flush()

    rows = docs.where(C.fold("doc_id", HELD_OUT) != 0).mapInPandas(run, "hash long, count long, shared int")
    return rows.groupBy("hash").agg(F.sum("count").alias("count"), F.min("shared").alias("shared"))


def frequent(counts: DataFrame) -> Counts:
    """The table of frequent words: all words of at least the least count with which they fit in TABLE."""
    sizes = {int(r["e"]): r for r in counts.groupBy(F.floor(F.log2("count") * 4).cast("int").alias("e")).agg(F.count("*").alias("n"), F.sum("count").alias("t")).collect()}
    total, distinct = sum(r["t"] for r in sizes.values()), sum(r["n"] for r in sizes.values())
    words, level = 0, max(sizes, default=0) + 1
    while level - 1 >= min(sizes, default=1) and words + (sizes[level - 1]["n"] if level - 1 in sizes else 0) <= TABLE:
        level -= 1
        words += sizes[level]["n"] if level in sizes else 0
    often = F.floor(F.log2("count") * 4) >= level
    top = counts.where(often).toPandas().sort_values(["count", "hash"], ascending=[False, True], kind="stable")  # at most TABLE rows
    own = np.where(top["hash"] == END, 0, np.cumsum(top["hash"] != END))
    own[own > WORDS] = 0
    rest = counts.where(~often).groupBy("shared").agg(F.sum("count").alias("t")).collect()
    class_total = np.zeros(CLASSES)
    for r in rest:
        class_total[r["shared"]] += r["t"]
    in_class = (own == 0) & (top["hash"] != END).to_numpy()
    np.add.at(class_total, top["shared"].to_numpy()[in_class], top["count"].to_numpy()[in_class])
    order = np.argsort(top["hash"].to_numpy())
    return Counts(top["hash"].to_numpy()[order], top["count"].to_numpy()[order], own[order], int(total), int(distinct), class_total)


def classes_of(counts: Counts, h: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each token's class, its place in the table, and whether it is there."""
    at, there = counts.find(h)
    own = np.where(there, counts.own[at], 0) if len(counts.hash) else np.zeros(len(h), np.int64)
    return np.where(own > 0, own, shared), at, there


def _runs_of(texts: list[bytes], counts: Counts) -> tuple[np.ndarray, np.ndarray]:
    """The classes of whole texts one after another, each with its end, and where each text stops."""
    w, h, s = word_table(texts)
    row = np.zeros(len(h) + len(texts), np.int64)
    row[np.arange(len(h)) + w.doc] = classes_of(counts, h, s)[0]
    return row, np.cumsum(w.count + 1)


def _warm(docs: DataFrame, counts: Counts) -> np.ndarray:
    """About TOKENS n-grams dealt by hash: texts first, then places within them, so that no id or place comes before another."""
    wanted = TOKENS / max(counts.total, 1)
    texts = min(1.0, 8 * wanted)
    within = min(1.0, wanted / texts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            encoded, ids = C.encoded(batch["text"]), batch["doc_id"].to_numpy(np.int64)
            for lo, hi in C.slices(encoded):
                codes = ngrams(_runs_of(encoded[lo:hi], counts)[0])
                # a text's place in the slice would depend on the partitions; its id and the place in the text don't
                end = np.flatnonzero(codes % CLASSES == 0)
                first = np.concatenate(([0], end[:-1] + 1))
                size = end - first + 1
                place = np.arange(len(codes)) - np.repeat(first, size)
                order = C.mix(C.mix(np.repeat(ids[lo:hi], size).view(np.uint64)) + place.astype(np.uint64)) >> np.uint64(2)
                take = order < np.uint64(int(within * (1 << 62)))
                yield pd.DataFrame({"codes": [codes[take].astype("<i8").tobytes()], "places": [order[take].astype("<i8").tobytes()]})

    share = int(texts * (1 << 30))
    found = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < share).mapInPandas(run, "codes binary, places binary").toPandas()
    codes, order = np.frombuffer(b"".join(found["codes"]), "<i8"), np.frombuffer(b"".join(found["places"]), "<i8")
    return codes[np.lexsort((codes, order))][: 2 * TOKENS]


def _by_shard(docs: DataFrame, counts: Counts, shards: int) -> DataFrame:
    """(shard, classes): runs of classes of the texts, dealt to shards by hash; the first two classes of a run are what stands before it.

    Whole texts are dealt; one of more than PIECE tokens is dealt in pieces. Repeated rows are dealt apart.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[np.ndarray]] = {}
        size = 0
        none = np.zeros(2, np.int64)

        def flush() -> pd.DataFrame:
            return pd.DataFrame({"shard": list(held), "classes": [np.concatenate((none, *x)).astype("<i2").tobytes() for x in held.values()]})

        for batch in batches:
            texts, ids = C.encoded(batch["text"]), batch["doc_id"].to_numpy(np.int64)
            again = batch.groupby("doc_id").cumcount().to_numpy(np.uint64)
            key = C.mix(C.mix(ids.view(np.uint64)) + again)
            for lo, hi in C.slices(texts):
                row, stop = _runs_of(texts[lo:hi], counts)
                for k, (a, b) in enumerate(zip(np.append(0, stop[:-1]), stop, strict=True)):
                    pieces = np.arange(a, b, PIECE)
                    shard = (C.mix(key[lo + k] + np.arange(len(pieces), dtype=np.uint64)) % np.uint64(shards)).astype(np.int64)
                    if len(pieces) == 1:
                        held.setdefault(int(shard[0]), []).append(row[a:b])
                        continue
                    text = np.concatenate((none, row[a:b])).astype("<i2")  # a piece that stops short of the end stands alone
                    yield pd.DataFrame({"shard": shard, "classes": [text[x - a : x - a + PIECE + 2].tobytes() for x in pieces]})
                size += len(row)
                if size > HELD:
                    yield flush()
                    held.clear()
                    size = 0
        if held:
            yield flush()

    return docs.mapInPandas(run, "shard long, classes binary")


def _touched(codes: np.ndarray, p: np.ndarray) -> np.ndarray:
    """How often each class was moved as a word (as often by noise as chance has it), as a nearer and as a farther context."""
    places = (codes % CLASSES, codes // CLASSES % CLASSES, codes // CLASSES**2)
    out = np.stack([np.bincount(c, minlength=CLASSES) for c in places], 1).astype(np.float64)
    out[:, 0] += len(codes) * p
    return out


#: Which of the three counts of _touched each column of the values goes by: a word's vector, both contexts, the bias.
_BY = np.repeat([0, 1, 2, 0], [UNITS, UNITS, UNITS, 1])


def _flat(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([v.reshape(CLASSES, -1) for v in parts], 1).astype(np.float64)


def _split(flat: np.ndarray) -> list[np.ndarray]:
    flat = flat.astype(np.float32)
    return [flat[:, :UNITS], flat[:, UNITS : 2 * UNITS], flat[:, 2 * UNITS : 3 * UNITS], flat[:, 3 * UNITS]]


def _averaged(shards: DataFrame, weights: Weights, p: np.ndarray) -> Weights:
    """Weights after one round: each shard goes on from weights over all its tokens, and what it changes in a class counts as often as it met the class.

    So a shard that never met a class doesn't thin out what others learned of it.
    """
    spread = shards.sparkSession.sparkContext.broadcast(weights)

    def tuned(part: pd.DataFrame) -> pd.DataFrame:
        runs = [np.frombuffer(x, "<i2") for x in part["classes"]]
        codes = np.sort(np.concatenate([ngrams(r[2:], r[:2]) for r in runs]))  # the same order however the rows came
        old, number = spread.value, int(part["shard"].iloc[0])
        got, n = learn(old, codes, p, 1, SHARD_RATE, seed=number), _touched(codes, p)
        change = [(_flat(new) - _flat(was)) * n[:, _BY] for new, was in ((got.values, old.values), (got.squares, old.squares))]
        sums = np.concatenate((*change, n), 1).astype(np.float32)
        return pd.DataFrame({"slot": np.arange(SLOTS), "part": number // SUMMED, "shard": number, "sums": [x.astype(np.float64).tobytes() for x in np.split(sums, SLOTS)]})

    def summed(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("shard")
        return part.iloc[:1].assign(sums=[sum(np.frombuffer(x) for x in part["sums"]).tobytes()])

    schema = "slot long, part long, shard long, sums binary"
    sums = shards.groupBy("shard").applyInPandas(tuned, schema).groupBy("slot", "part").applyInPandas(summed, schema)
    found = sums.groupBy("slot").applyInPandas(summed, schema).toPandas().sort_values("slot")  # SLOTS rows of fixed size
    spread.unpersist()
    if not len(found):
        return weights
    flat = np.concatenate([np.frombuffer(x).reshape(CLASSES // SLOTS, -1) for x in found["sums"]])
    wide = len(_BY)
    n = np.maximum(flat[:, 2 * wide :], 1e-9)[:, _BY]
    return Weights(_split(_flat(weights.values) + flat[:, :wide] / n), _split(_flat(weights.squares) + flat[:, wide : 2 * wide] / n))


def train(docs: DataFrame, counts: Counts) -> Network:
    """A network from all training tokens, the same in each run.

    The weights begin with a bounded sample of tokens. Then every occurrence of every token is learned from once, in
    shards of about SHARD tokens of whole texts. The shards take turns in rounds, about as many rounds as shards in
    each, so that both grow with the corpus; a round's shards start from the average that the round before left.
    Only sums of fixed size come back.
    """
    docs = docs.where(C.fold("doc_id", HELD_OUT) != 0)
    floor = counts.class_total.copy()
    own = counts.own > 0
    np.add.at(floor, counts.own[own], counts.count[own])
    floor[0] = max(counts.total and (counts.count[counts.hash == END].sum()), 1)
    p = noise(floor)
    sample = _warm(docs, counts)
    weights = learn(begun(floor), sample, p, int(np.clip(PASSED // max(len(sample), 1), 4, 40)), RATE)
    shards = int(-(-counts.total // SHARD)) or 1
    rounds = int(np.ceil(np.sqrt(shards)))
    dealt = C.stored(_by_shard(docs, counts, shards).repartition("shard").withColumn("round", F.col("shard") % rounds), "round")
    for k in range(rounds):
        weights = _averaged(dealt.where(F.col("round") == k), weights, p)
    return weights.network()


def summed_words(key: np.ndarray, h: np.ndarray, shared: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, ...]:
    """The text, hash and shared class of each word of each text, how often it occurs and the sum of its values. A text is known by its key."""
    _, first, row = np.unique(C.mix(key.view(np.uint64)) + h.view(np.uint64), return_index=True, return_inverse=True)
    return key[first], h[first], shared[first].astype(np.int32), np.bincount(row).astype(np.int32), np.bincount(row, value)


def score(docs: DataFrame) -> DataFrame:
    """The counts and both scores of each row's whole text; held-out rows are never learned from.

    Null and empty texts are an end alone. Repeated rows are scored alike, each on its own; rows without a doc_id are
    left out, other columns ignored. Without training rows the counts are zero. An empty table gives no rows.
    """
    docs = C.identified(docs)
    exact = C.cut(_counted(docs))
    counts = frequent(exact)
    net = train(docs, counts)
    spread = docs.sparkSession.sparkContext.broadcast((counts, net))  # of fixed size: TABLE words, CLASSES vectors
    base_log = np.log10(counts.total + 0.1 * (counts.distinct + 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, net = spread.value
        end = counts.find(np.array([END]))
        end_count = float(counts.count[end[0][0]]) if end[1][0] else 0.0
        within, in_table, in_base = np.log10(np.maximum(counts.class_total, 1e-9)), np.log10(counts.count), np.log10(counts.count + 0.1)
        for batch in batches:
            texts, ids = C.encoded(batch["text"]), batch["doc_id"].to_numpy()
            for lo, hi in C.slices(texts):
                k = hi - lo
                w, h, s = word_table(texts[lo:hi])
                c, at, there = classes_of(counts, h, s)
                # the run of classes with an end behind each text; contexts restart after it
                stop = np.cumsum(w.count + 1) - 1
                row = np.zeros(len(h) + k, np.int64)
                word_at = np.arange(len(h)) + w.doc
                row[word_at] = c
                before = np.concatenate(([0], row[:-1]))
                second = np.concatenate(([0, 0], row[:-2]))[: len(row)]
                begin = stop - w.count
                second[begin] = 0
                log_class = net.log_chance(second, before, row) / _LN10
                # what the words of the table and the ends are worth; a rarer word's own part is kept for the join
                ours = np.full(len(row), end_count > 0)
                ours[word_at] = there
                doc = np.repeat(np.arange(k), w.count + 1)
                value = np.bincount(doc[ours], log_class[ours], k)
                place = there & (c > WORDS)
                value += np.bincount(w.doc[place], in_table[at[place]] - within[c[place]], k) if place.any() else 0
                base = np.bincount(w.doc[there], in_base[at[there]], k) if there.any() else np.zeros(k)
                known = np.bincount(w.doc[there], minlength=k) + (end_count > 0)
                base = base + np.log10(end_count + 0.1)
                key = w.text_keys(ids[lo:hi])
                # rarer words are left to the join
                far = ~there
                rare = summed_words(key[w.doc[far]], h[far], s[far], log_class[word_at[far]])
                none = np.zeros(len(rare[0]), np.int64)
                head = (key, C.mix(key.view(np.uint64)).view(np.int64), np.zeros(k, np.int32), np.zeros(k, np.int32), value, ids[lo:hi], np.ones(k, np.int32), w.count + 1, known, base)
                rows = (*rare, none, none.astype(np.int32), none, none, none.astype(float))
                yield pd.DataFrame({name: np.concatenate(x) for name, x in zip(names, zip(head, rows, strict=True), strict=True)})

    schema = "key long, hash long, shared int, times int, value double, doc_id long, rows int, n_tokens long, known long, base double"
    names = [c.split()[0] for c in schema.split(", ")]
    parts = docs.mapInPandas(run, schema)
    known_log = F.element_at(F.array(*(F.lit(float(np.log10(max(t, 1e-9)))) for t in counts.class_total[WORDS + 1 :])), F.col("shared") - WORDS)
    found = parts.join(exact.select("hash", "count"), "hash", "left")
    times, seen = F.col("times"), F.col("count").isNotNull()
    found = found.select(
        "key", "doc_id", "rows", "n_tokens",
        (F.col("known") + F.when(seen, times).otherwise(0)).alias("known"),
        (F.col("base") + F.when(times > 0, times * F.log10(F.coalesce("count", F.lit(0)) + 0.1)).otherwise(0.0)).alias("base"),
        F.when(times == 0, F.col("value")).when(seen, F.col("value") + times * (F.log10("count") - known_log)).otherwise(0.0).alias("value"),
    )
    sums = found.groupBy("key").agg(F.max("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in ("rows", "n_tokens", "known", "base", "value")), F.min("doc_id").alias("low"))
    # equal rows fell together under one key: they share the sums
    out = sums.withColumn("_row", F.explode(F.expr("sequence(1L, rows)")))
    each = lambda c: F.expr(f"{c} div rows")
    seen_log, unseen_log = (float(np.log10(max(x, 1e-300))) for x in (1 - counts.unseen, counts.unseen))
    return out.select(
        F.when(F.col("doc_id") > 0, F.col("doc_id")).otherwise(F.col("low")).alias("doc_id"),
        each("n_tokens").alias("n_tokens"), each("known").alias("n_known"), F.lit(counts.total).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("rows") - (F.expr("n_tokens div rows")) * F.lit(float(base_log))).alias("base_score"),
        ((F.col("value") + F.col("known") * seen_log + (F.col("n_tokens") - F.col("known")) * unseen_log) / F.col("rows")).alias("score"),
    ).withColumn("held_out", C.fold("doc_id", HELD_OUT) == 0)
