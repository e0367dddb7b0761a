"""How the sources of a language differ in their words, with term texts brought in late.

Each task counts the terms of its texts and stores them as 64-bit digests with their counts, the term's text beside.
Only digests and counts are shuffled: once to find the terms that may stay, those in enough documents, and once, these
alone, to bring a term's counts of all sources into one row. Then the texts of these terms are read from the store: the
least and the greatest text of each digest, which differ where two terms share it. Such a digest is split: its terms are
summed again by their texts, and each goes on as a key of its own. In the result texts are joined back for the ranked
terms only. Counts, shares and differences are whole numbers throughout.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, encoded, mix, shared_checkpoints, slices, small_batches

LEAST_DOCS = 10
TOP = 10
#: Slots of digests that are sent to all tasks, some 40 MB as a hash table; a digest in another's slot is told apart after.
SLOTS = 1 << 20
#: Pairs of sources whose sums a task holds; with more it hands them on after each batch.
PAIRS = 1 << 22
#: Bytes of texts whose terms are counted together; a longer text alone.
RUN = 1 << 23
#: Rows of counted terms that a task holds; with half as many left after equal ones are merged it hands them on.
HELD = 1 << 20
#: Letters and all bytes of other scripts belong to terms; capitals are lowered, what stands between becomes blank.
_READ = bytes((c + 32 if c < 96 else c) if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_COUNTS = "lang string, source string, key long, n long, df long, term string"
Digest = Callable[[np.ndarray], np.ndarray]


def _plain(h: np.ndarray) -> np.ndarray:
    return h


def _terms(texts: list[bytes], group: np.ndarray) -> tuple[np.ndarray, ...]:
    """Group, hash, occurrences, documents and text of each distinct term of each group; texts in one go.

    Terms are told apart by their whole hash and a second one, so that two of one digest are two rows here.
    """
    runs, at, owner, hashes, sizes = [], [], [], [], []
    base = 0
    for lo, hi in slices(texts):
        w = Words([t.translate(_READ) for t in texts[lo:hi]])
        runs.append(w.buf)
        at.append(w.start + base)
        owner.append(w.doc + lo)
        hashes.append(w.hashes())
        sizes.append(w.end - w.start)
        base += len(w.buf)
    buf, at, owner, h, size = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (runs, at, owner, hashes, sizes))
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.string())
    of = group[owner]
    whole = mix(h.astype(np.uint64) ^ mix(of.astype(np.uint64)))
    order = np.argsort(whole, kind="stable")  # documents stay in order within a term
    whole, owner, of, size, at, h = whole[order], owner[order], of[order], size[order], at[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (whole[1:] != whole[:-1]) | (of[1:] != of[:-1]) | (size[1:] != size[:-1])
    first = np.flatnonzero(new)
    fresh = new.copy()
    fresh[1:] |= owner[1:] != owner[:-1]
    n, df = np.diff(np.append(first, len(h))), np.add.reduceat(fresh, first, dtype=np.int64)
    start, length = at[first], size[first]
    ends = np.cumsum(length)
    letters = buf[np.repeat(start - ends + length, length) + np.arange(ends[-1])]
    texts_of = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(np.append([0], ends).astype(np.int64)), pa.py_buffer(letters.tobytes()))
    return of[first], h[first], n, df, texts_of.cast(pa.string())


def _merged(parts: list[tuple]) -> tuple:
    """The rows of several _terms(), those of one group and term summed; their documents differ."""
    of, h, n, df = (np.concatenate([p[k] for p in parts]) for k in range(4))
    if not len(of):
        return parts[0]
    terms = pa.concat_arrays([p[4] for p in parts])
    size = pc.binary_length(terms).to_numpy(zero_copy_only=False)
    whole = mix(h ^ mix(of.astype(np.uint64)))
    order = np.argsort(whole, kind="stable")
    new = np.ones(len(of), bool)
    new[1:] = (np.diff(whole[order]) != 0) | (np.diff(of[order]) != 0) | (np.diff(size[order]) != 0)
    first = np.flatnonzero(new)
    return of[order[first]], h[order[first]], np.add.reduceat(n[order], first), np.add.reduceat(df[order], first), terms.take(pa.array(order[first]))


def _stored(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, of which Spark knows the size."""
    spark = rows.sparkSession
    shared_checkpoints(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def _counted(docs: DataFrame, digest: Digest) -> DataFrame:
    """(lang, source, key, n, df, term) of a task's texts, stored in the shared folder: the strings' only copy.

    A term has a row for each group and HELD rows of a task, whatever its number of occurrences.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[tuple[str, str], int] = {}
        held: list[tuple] = []

        def handed_on() -> pa.RecordBatch:
            of, h, n, df, terms = held.pop()
            names = [pa.array([g[x] for g in number], pa.string()).take(pa.array(of)) for x in (0, 1)]
            number.clear()
            return pa.record_batch([*names, pa.array(digest(h).view(np.int64)), pa.array(n), pa.array(df), terms], names=["lang", "source", "key", "n", "df", "term"])

        for batch in batches:
            texts = encoded(batch.column("text").to_pylist())
            langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            groups = list(zip(langs, sources, strict=True))
            for lo, hi in slices(texts, RUN):
                held.append(_terms(texts[lo:hi], np.array([number.setdefault(g, len(number)) for g in groups[lo:hi]], np.int64)))
                if sum(len(p[0]) for p in held) > HELD:
                    held[:] = [_merged(held)]
                    if len(held[0][0]) > HELD // 2:
                        yield handed_on()
        if held:
            held[:] = [_merged(held)]
            yield handed_on()

    small_batches(docs.sparkSession)
    plain = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return _stored(plain.mapInArrow(run, _COUNTS), "terms")


def _among(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows whose digest may be among kept(lang, key); the tasks get slots of digests, SLOTS at most."""
    slot = F.pmod(F.xxhash64("lang", "key"), F.lit(SLOTS)).alias("_slot")
    return rows.withColumn("_slot", slot).join(F.broadcast(kept.select(slot).distinct()), "_slot", "left_semi").drop("_slot")


def _kept(counts: DataFrame, keys: list[str], least: int) -> DataFrame:
    """(lang, keys, total, used) of the keys in at least so many documents of a language; used: (source, n) of each source.

    Of the other keys nearly all stay behind before the counts by source are shuffled, once, by language and key.
    """
    sums = counts.groupBy("lang", *keys).agg(F.sum("df").alias("df"))
    rows = _among(counts, sums.where(F.col("df") >= least)).select("lang", "source", *keys, "n", "df").repartition("lang", *keys)
    by_source = rows.groupBy("lang", *keys, "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    used = F.collect_list(F.struct("source", "n")).alias("used")
    terms = by_source.groupBy("lang", *keys).agg(F.sum("df").alias("df"), F.sum("n").alias("total"), used).where(F.col("df") >= least)
    return _stored(terms.drop("df"), "kept")


def kept_terms(docs: DataFrame, least: int = LEAST_DOCS, digest: Digest = _plain) -> tuple[DataFrame, DataFrame]:
    """(lang, key, part, total, used) of the terms that stay, and (lang, key, part, term): their texts.

    key is a term's digest; part is empty, or the term itself where its digest is another's too; used: array of (source, n).
    """
    counts = _counted(docs, digest)
    rows = _kept(counts, ["key"], least)
    kinds = rows.select("lang", "key")
    # each text once per digest first: least and greatest texts are kept by sorting, a task's texts by hashing; the
    # number of rows keeps this step in the plan, which would leave it out as needless for least and greatest
    seen = _among(counts.select("lang", "key", "term"), kinds).groupBy("lang", "key", "term").agg(F.count("*").alias("times"))
    names = seen.groupBy("lang", "key").agg(F.min("term").alias("term"), F.max("term").alias("last"), F.sum("times").alias("times"))
    names = _stored(names.join(kinds, ["lang", "key"], "left_semi"), "names")
    alone, shared = names.where("term = last"), names.where("term <> last").select("lang", "key")
    texts = alone.select("lang", "key", F.lit("").alias("part"), "term")
    if shared.isEmpty():
        return rows.withColumn("part", F.lit("")), texts
    of_shared = _among(counts, shared).join(shared, ["lang", "key"], "left_semi")
    split = _kept(of_shared.withColumnRenamed("term", "part"), ["key", "part"], least)
    whole = rows.join(shared, ["lang", "key"], "left_anti").withColumn("part", F.lit(""))
    return whole.unionByName(split), texts.unionByName(split.select("lang", "key", "part", F.col("part").alias("term")))


def _share_text(n: str, all_terms: str, kinds: str) -> str:
    """1 + floor(10^9 (n + 2) / (all_terms + 2 kinds)), exact for any 64-bit counts; null where there are no kinds."""
    return f"if({kinds} = 0, null, 1 + (cast(1000000000 as decimal(10, 0)) * cast({n} + 2 as decimal(20, 0))) div cast({all_terms} + 2 * {kinds} as decimal(20, 0)))"


def _share(n: str, all_terms: str, kinds: str) -> Column:
    return F.expr(_share_text(n, all_terms, kinds))


def _difference(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _pair_sums(rows: DataFrame) -> DataFrame:
    """(lang, i, j, value), i < j: the differences of two sources summed over all terms.

    rows: lang, at: array of (no, p) of the sources that have the term, zs: every source's share of a term that it lacks.
    Tasks add up whole blocks of terms and hand on one number a pair.
    """

    def run(batches):
        sums: dict[str, np.ndarray] = {}

        def handed_on():
            for lang, s in sums.items():
                i, j = np.nonzero(s)
                yield pa.record_batch([pa.array([lang] * len(i), pa.string()), pa.array(i), pa.array(j), pa.array(s[i, j])], names=["lang", "i", "j", "value"])
            sums.clear()

        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            of = langs.indices.to_numpy()
            for number, lang in enumerate(langs.dictionary.to_pylist()):
                some = batch.filter(pa.array(of == number))
                zs = np.array(some.column("zs")[0].as_py(), np.int64)
                at = some.column("at")
                row = np.repeat(np.arange(len(some)), at.value_lengths().to_numpy())
                flat = at.flatten()
                share = np.tile(zs, (len(some), 1))
                share[row, flat.field("no").to_numpy()] = flat.field("p").to_numpy()
                s = sums.setdefault(lang, np.zeros((len(zs), len(zs)), np.int64))
                for i in range(len(zs) - 1):
                    p, q = share[:, i : i + 1], share[:, i + 1 :]
                    s[i, i + 1 :] += ((p - q) ** 2 // (p + q)).sum(axis=0)
            if sum(s.size for s in sums.values()) > PAIRS:
                yield from handed_on()
        yield from handed_on()

    sums = rows.mapInArrow(run, "lang string, i long, j long, value long")
    return sums.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP, digest: Digest = _plain) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from the others of its language, and its own terms.

    Null text, lang and source count as ''. Every occurring (lang, source) is a group, also one without terms; each row of
    docs is a document, repeated ones too; texts are read whole. Part 'pair' lists every other source of the language, part
    'term' the terms that the group uses more than its language does. Ties go by item; no row gives no result. Other
    columns of docs play no part. digest maps 64-bit hashes of terms to their
    digests; results are the same whatever it is.
    """
    rows, texts = kept_terms(docs, least, digest)
    groups = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    vocabulary = rows.groupBy("lang").agg(F.count("*").alias("kinds"), F.sum("total").alias("lang_terms"))
    sums = rows.select("lang", F.inline("used")).groupBy("lang", "source").agg(F.sum("n").alias("terms"))
    groups = groups.join(sums, ["lang", "source"], "left").join(vocabulary, "lang", "left").na.fill(0, ["terms", "kinds", "lang_terms"])
    numbered = groups.withColumn("no", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).withColumn("z", _share("0", "terms", "kinds"))
    # a row a language, stored: Spark sends it to all tasks while it is small enough for that
    langs = numbered.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("no", "z", "source", "terms"))).alias("all"), F.first("kinds").alias("kinds"), F.first("lang_terms").alias("lang_terms"))
    langs = _stored(langs, "langs")

    of = F.map_from_arrays("all.source", F.transform("all", lambda x: F.struct(x["no"].alias("no"), x["terms"].alias("terms")))).alias("of")
    used = rows.join(langs.select("lang", of, F.col("all.z").alias("zs"), "kinds", "lang_terms"), "lang")
    grouped = "transform(used, x -> struct(x.source, x.n, of[x.source] as g))"
    p = F.expr(f"transform({grouped}, x -> struct(x.g.no as no, {_share_text('x.n', 'x.g.terms', 'kinds')} as p, x.source as source))")
    used = used.select("lang", "key", "part", "zs", p.alias("at"), _share("total", "lang_terms", "kinds").alias("q"))
    sums = _pair_sums(used.select("lang", F.transform("at", lambda x: F.struct(x["no"].alias("no"), x["p"].alias("p"))).alias("at"), "zs"))
    both = langs.select("lang", "all", F.explode("all").alias("a")).select("lang", "a", F.explode("all").alias("b")).where("a.no <> b.no")
    both = both.select("lang", F.col("a.source").alias("source"), F.col("b.source").alias("item"), F.least("a.no", "b.no").cast("long").alias("i"), F.greatest("a.no", "b.no").cast("long").alias("j"))
    pairs = both.join(sums, ["lang", "i", "j"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))

    above = used.select("lang", "key", "part", "q", F.inline("at")).where("p > q").select("lang", "source", "key", "part", _difference("p", "q").alias("value"))
    # all that may be among the first, ties with the last one too; only these get their texts
    first = above.withColumn("_r", F.rank().over(Window.partitionBy("lang", "source").orderBy(F.desc("value")))).where(F.col("_r") <= top)
    named = first.join(texts, ["lang", "key", "part"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    columns = ["lang", "source", "part", "item", "value"]
    return pairs.select(*columns, place).unionByName(named.select(*columns, place).where(F.col("rank") <= top))
