"""Similarity join on word n-grams by parity sketches.

A document's n-grams are XOR-hashed into a bit sketch: each toggles one bit, so two sketches differ in at most as
many bits as their sets do in members. A very long sketch, kept as its non-zero segments, carries the pigeonhole
join: with a Jaccard likeness of t, no more than (1 - t) of a document's segments can be damaged, so of any prefix
longer than that, taken in one order for all documents, one segment is the same in both. A short sketch whose width
follows the size band gives the Hamming bound that pairs must meet before their sets are compared.

Before the join, two passes count in how many documents the n-grams occur. A document whose n-grams are mostly its
own cannot have a partner; nearly all documents end there, whatever passages they share with others.
Very frequent n-grams, known from a bounded sample, stand last in the order and count as shared unseen. The sample
only changes the order, and so the work, never the links found.

Groups of documents that meet in a segment are not paired off. Each group's least edited member is compared with the
others; what then remains in different components is compared only if the bounds allow a link.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .components import components

N = 5
#: The likeness of a link in hundredths; the bounds below are worked out for it.
PERCENT = 75
#: Classes whose n-grams are sampled for frequent ones, and how many of those are kept at most.
SAMPLE, FREQUENT, FREQUENT_AT = 8192, 100_000, 3
#: Bits of the filter of documents still in play, and classes whose further copies are skipped, at most.
FILTER_BITS, COPIED, COPIED_AT = 1 << 23, 10_000, 32
#: Bits of the hash by which classes are told apart while n-grams are counted.
TAG_BITS = 48
_BAND = math.log(4 / 3)


def gram_sets(texts: list[bytes], n: int = N) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes (63 bits) of each text; with fewer words, one hash of all words; without, none."""
    w = C.Words([C.lower_ascii(t) for t in texts])
    h = w.hashes()
    grams = C.shingles(h, n) >> np.uint64(1)
    out = []
    for first, count in zip(w.first, w.count, strict=True):
        if count >= n:
            out.append(np.unique(grams[first : first + count - n + 1]))
        elif count:
            x = np.uint64(count)
            for v in h[first : first + count]:
                x = C.mix(np.array([x ^ v]))[0]
            out.append(np.array([x >> np.uint64(1)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_hash(grams: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set, which equal sets share."""
    with np.errstate(over="ignore"):
        a, b = C.mix(grams).sum(dtype=np.uint64), C.mix(grams ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def segments(grams: np.ndarray) -> np.ndarray:
    """The non-zero 64-bit segments of the long parity sketch, each as one hash of its place and word, in order of place."""
    if not len(grams):
        return np.zeros(0, np.uint64)
    place = grams >> np.uint64(6)
    at = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    word = np.bitwise_xor.reduceat(np.uint64(1) << (grams & np.uint64(63)), at)
    return C.mix(C.mix(place[at]) ^ word) >> np.uint64(1)


def band(n: int) -> int:
    """Sizes whose ratio allows a link lie in one band or in two neighbouring ones."""
    return int(math.log(n) / _BAND + 1e-9)


def parity(grams: np.ndarray, of_band: int) -> np.ndarray:
    """The short parity sketch for a band: about two bits for each of its n-grams, as 64-bit words."""
    width = 1 << max(8, math.ceil(math.log2(2 * (4 / 3) ** (of_band + 1))))
    odd = np.bincount((C.mix(grams) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _over_sets(docs: DataFrame, rows, schema: dict[str, str], n: int, passing: bytes | None = None) -> DataFrame:
    """rows(doc_ids, sets) of the documents that pass the filter, slice by slice; it gives the columns of the schema."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if passing is not None:
                batch = batch[_passes(batch["doc_id"], passing)]
            ids, texts = batch["doc_id"].to_numpy(), C.encoded(batch["text"])
            for lo, hi in C.slices(texts):
                columns = rows(ids[lo:hi], gram_sets(texts[lo:hi], n))
                yield pd.DataFrame(dict(zip(schema, columns, strict=True)))

    return docs.mapInPandas(run, ", ".join(f"{k} {v}" for k, v in schema.items()))


def _passes(ids: pd.Series, passing: bytes) -> np.ndarray:
    bits = np.frombuffer(passing, np.uint8)
    at = np.fromiter((zlib.crc32(str(i).encode()) % FILTER_BITS for i in ids), np.int64, len(ids))
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _filter_of(ids: DataFrame) -> bytes:
    """A bitmap of hashed ids, of FILTER_BITS bits however many ids there are."""
    at = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FILTER_BITS))
    words = ids.select(at.alias("at")).groupBy(F.shiftright("at", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(at, 32) as int))")).alias("bits"))
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    for r in words.toLocalIterator():
        out[r["word"]] = r["bits"]
    return out.tobytes()


def _shared(docs: DataFrame, frequent: np.ndarray, skip: dict[int, int], part: int, n: int, key_bits: int, passing: bytes | None = None) -> DataFrame:
    """(tag, shared): of the first n_shingles // part + 1 n-grams of each class, how many another class has among its own.

    Counts add up over the documents of a class that were looked at. Frequent n-grams count as shared. N-grams are cut
    to key_bits and classes to TAG_BITS of their hash to keep the shuffle small: n-grams or classes that fall together
    only raise the counts, and with them the work.
    """

    def rows(ids: np.ndarray, sets: list[np.ndarray]) -> tuple:
        keys, tags, hots = [np.zeros(0, np.int64)], [], []
        sizes = []
        for doc_id, grams in zip(ids, sets, strict=True):
            fp = set_hash(grams)[0]
            if not len(grams) or skip.get(fp, doc_id) != doc_id:
                continue
            at = np.searchsorted(frequent, grams)
            often = (frequent[np.minimum(at, len(frequent) - 1)] == grams) if len(frequent) else np.zeros(len(grams), bool)
            most = min(len(grams), len(grams) // part + 1)
            mine = (grams[~often][:most] >> np.uint64(63 - key_bits)).view(np.int64)
            hot, tag = most - len(mine), fp & ((1 << TAG_BITS) - 1)
            keys.append(mine)
            tags.append(tag)
            hots.append(hot)
            sizes.append(len(mine))
        # behind the keys, a row of its own for each class with frequent n-grams
        tag, hot = np.array(tags, np.int64), np.array(hots, np.int32)
        some = hot > 0
        return np.concatenate([*keys, -1 - tag[some]]), np.concatenate([np.repeat(tag, sizes), tag[some]]), np.concatenate([np.zeros(sum(sizes), np.int32), hot[some]])

    rows = _over_sets(docs, rows, {"key": "long", "tag": "long", "hot": "int"}, n, passing)
    same = Window.partitionBy("key")
    counted = rows.select("tag", "hot", (F.min("tag").over(same) != F.max("tag").over(same)).alias("met"))
    points = F.when(F.col("hot") > 0, F.col("hot")).otherwise(F.col("met").cast("int"))
    return counted.select("tag", points.alias("p")).where("p > 0").groupBy("tag").agg(F.sum("p").alias("shared"))


#: In how many bits two sketches of one width differ.
_HAMMING = "aggregate(zip_with({}, {}, (p, q) -> bit_count(p ^ q)), 0, (s, v) -> s + v)"


def _verified(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches may and whose sets do agree enough."""
    left, right = (held.select(F.col("doc_id").alias(x), F.col("grams").alias(f"g{x}"), F.col("bands").alias(f"s{x}")) for x in "ab")
    # the sketch of the larger one's band, which both have if their sizes fit
    of = "get(filter({}, s -> s.band = greatest(sa[0].band, sb[0].band)), 0).sketch"
    fits = f"100 * least(size(ga), size(gb)) >= {PERCENT} * greatest(size(ga), size(gb)) and 7 * {_HAMMING.format(of.format('sa'), of.format('sb'))} <= size(ga) + size(gb)"
    near = pairs.join(left, "a").join(right, "b").where(F.expr(fits))
    both = F.size(F.array_intersect("ga", "gb"))
    return near.where(100 * both >= PERCENT * (F.size("ga") + F.size("gb") - both)).select("a", "b")


def link(docs: DataFrame, n: int = N) -> DataFrame:
    """doc_id, n_shingles, component_id and class_id of each row of docs.

    Two documents link when the Jaccard likeness of their sets of n-grams is at least 0.75. component_id is the
    smallest doc_id reachable by links, class_id the smallest doc_id with the same set. N-grams are held as 63-bit
    hashes. Null, empty and blank texts have no n-grams and stand alone; texts of fewer than n words are one n-gram.
    Repeated rows come back as often as they occur; rows without a doc_id are left out. A doc_id is taken to name one
    text. Other columns are ignored. An empty table gives no rows.
    """
    docs = C.identified(docs)
    sized = C.cut(_over_sets(docs, lambda ids, sets: (ids, [len(s) for s in sets], *zip(*map(set_hash, sets), strict=True)), {"doc_id": "long", "n": "long", "fp": "long", "fp2": "long"}, n))
    classes = C.cut(sized.where("n > 0").groupBy("fp", "fp2").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.count("*").alias("copies")))
    found = _joined(docs, classes, n)
    named = classes.select("fp", "fp2", F.col("doc_id").alias("class_id")).join(found, "class_id", "left")
    out = sized.join(named, ["fp", "fp2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "class_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"))


def keep_first(docs: DataFrame, n: int = N) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component, once each, with all their columns.

    Rows without a doc_id stay. Texts are shuffled only where a doc_id may have to go or to be told from its repeats.
    """
    found = link(docs, n).groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("times"))
    moved = C.cut(found.where("times > 1 or doc_id <> component_id"))
    passing = _filter_of(moved)

    @F.pandas_udf("boolean")
    def may_go(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        out = np.zeros(len(ids), bool)
        out[known] = _passes(ids[known].astype("int64"), passing)
        return pd.Series(out)

    rest = docs.where(may_go("doc_id")).join(moved.where("doc_id <> component_id"), "doc_id", "left_anti").dropDuplicates(["doc_id"])
    return docs.where(~may_go("doc_id")).unionByName(rest.select(docs.columns))


def _joined(docs: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """(class_id, component_id) of classes with links; every pair not compared is in one component or too unlike."""
    skip = {r["fp"]: r["doc_id"] for r in classes.where(F.col("copies") >= COPIED_AT).orderBy(F.desc("copies"), "doc_id").limit(COPIED).select("fp", "doc_id").collect()}
    frequent = _frequent(docs, classes, n)
    listed = docs.sparkSession.createDataFrame([(k,) for k in skip], "fp long").withColumn("listed", F.lit(True))
    weighed = classes.join(F.broadcast(listed), "fp", "left")  # at most COPIED rows
    weighed = weighed.withColumn("looked_at", F.when(F.col("listed"), 1).otherwise(F.col("copies"))).drop("listed")

    tag = F.col("fp").bitwiseAND((1 << TAG_BITS) - 1)
    weighed = weighed.withColumn("tag", tag)
    key_bits = min(63, int(weighed.agg(F.coalesce(F.sum("n"), F.lit(1))).first()[0]).bit_length() + 8)
    # first among a third of each document's n-grams: a link needs a twelfth of all n-grams shared there
    some = _shared(docs, frequent, skip, 3, n, key_bits)
    near = C.cut(weighed.join(some, "tag").where("shared >= greatest(1, n div 12) * looked_at").select("doc_id", "n", "tag"))
    # then among all of them, of the documents that are left: a link needs three quarters shared
    every = _shared(docs, frequent, skip, 1, n, key_bits, _filter_of(near))
    held_ids = C.cut(near.join(every, "tag").where("4 * shared >= 3 * n").select("doc_id", F.least("n", F.col("shared")).alias("shared")).distinct())

    def sketched(ids: np.ndarray, sets: list[np.ndarray]) -> tuple:
        some = [(i, g, band(len(g))) for i, g in zip(ids, sets, strict=True) if len(g)]
        return (
            np.array([i for i, _, _ in some], np.int64), [len(g) for _, g, _ in some], [g.view(np.int64) for _, g, _ in some],
            [segments(g)[: len(g) // 4 + 1].view(np.int64) for _, g, _ in some], [[{"band": x, "sketch": parity(g, x)} for x in (b, b + 1)] for _, g, b in some],
        )

    schema = {"doc_id": "long", "n": "long", "grams": "array<long>", "keys": "array<long>", "bands": "array<struct<band: int, sketch: array<long>>>"}
    held = C.cut(_over_sets(docs, sketched, schema, n, _filter_of(held_ids)))
    keyed = held.select("doc_id", "n", "keys").join(held_ids, "doc_id").withColumn("own", ((F.col("n") - F.col("shared")) * 1000 / F.col("n")).cast("int"))

    # in each segment the member with the fewest n-grams of its own stands for all, so whoever shares one meets one hub
    met = keyed.select("doc_id", "n", "own", F.explode("keys").alias("key"))
    star = met.groupBy("key").agg(F.min(F.struct("own", "doc_id")).alias("hub"), F.count("*").alias("members")).where("members > 1")
    meetings = C.cut(met.join(star.select("key", F.col("hub.doc_id").alias("hub")), "key").groupBy("doc_id", "hub").agg(F.count("*").alias("c")))
    # each document is compared with the hub it met most often
    apart = meetings.where("doc_id <> hub").groupBy(F.col("doc_id").alias("a"))
    first = C.cut(_verified(apart.agg(F.max_by("hub", F.struct("c", (-F.col("hub")).alias("least"))).alias("b")), held))

    # round hubs whose documents are still in several components, those outside the hub's own meet the others
    of = C.cut(components(first).select(F.col("node").alias("doc_id"), "component"))
    facts = keyed.select("doc_id", "n", "shared").join(of, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")).join(held.select("doc_id", "bands"), "doc_id")
    placed = meetings.select("doc_id", "hub").join(facts, "doc_id")
    still = placed.groupBy("hub").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max(F.when(F.col("doc_id") == F.col("hub"), F.col("component"))).alias("main"))
    rows = placed.join(still.where("low <> high").select("hub", "main"), "hub")
    x, y = rows.where("component <> main").alias("x"), rows.alias("y")
    of_band = "get(filter({}.bands, s -> s.band = greatest(x.bands[0].band, y.bands[0].band)), 0).sketch"
    fits = F.expr(
        "x.component <> y.component and (y.component = y.main or x.doc_id < y.doc_id)"
        " and 100 * least(x.n, y.n) >= 75 * greatest(x.n, y.n) and 3 * (x.n + y.n) <= 7 * least(x.shared, y.shared)"
        f" and 7 * {_HAMMING.format(of_band.format('x'), of_band.format('y'))} <= x.n + y.n"
    )
    rest = x.join(y, (F.col("x.hub") == F.col("y.hub")) & fits).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct()
    second = _verified(rest, held)
    # what they add links components with components
    a, b = (of.select(F.col("doc_id").alias(c), F.col("component").alias(f"c{c}")) for c in "ab")
    more = second.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    upper = components(more).select(F.col("node").alias("component"), F.col("component").alias("_low"))
    named = of.join(upper, "component", "left").select(F.col("doc_id").alias("class_id"), F.coalesce("_low", "component").alias("component_id"))
    alone = upper.withColumnRenamed("component", "class_id").join(of.select(F.col("doc_id").alias("class_id")), "class_id", "left_anti").select("class_id", F.col("_low").alias("component_id"))
    return named.unionByName(alone)


def _frequent(docs: DataFrame, classes: DataFrame, n: int) -> np.ndarray:
    """Sorted n-grams found in several of a bounded sample of classes."""
    size = classes.count()
    share = min(1.0, SAMPLE / max(size, 1))
    picked = classes.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < int(share * (1 << 20))).select("doc_id").limit(2 * SAMPLE)
    texts = docs.join(F.broadcast(picked), "doc_id")  # at most 2 * SAMPLE ids
    grams = _over_sets(texts, lambda ids, sets: (ids, [s.view(np.int64) for s in sets]), {"doc_id": "long", "grams": "array<long>"}, n).dropDuplicates(["doc_id"])
    top = grams.select(F.explode("grams").alias("g")).groupBy("g").count().where(F.col("count") >= FREQUENT_AT).orderBy(F.desc("count"), "g").limit(FREQUENT)
    return np.sort(np.array([r["g"] for r in top.select("g").collect()], np.int64).view(np.uint64))
