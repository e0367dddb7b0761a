"""Document fingerprints by Order MinHash, in DataFrame functions only.

Words are cut into k-mers and each k-mer is numbered by its occurrence in the text. The hash of (k-mer, number) sends
it to one of the bins and ranks it there; each bin selects its two least. The selected k-mers are put back into text
order and hashed as a tuple, so a signature survives only where both the k-mers and their order do: it is sensitive
to edit distance, not merely to the set of k-mers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of a k-mer. Longer words than WORD code points are cut, so that text without spaces has k-mers too.
K, WORD = 2, 16
#: log2 of the number of bins.
BIN_BITS = 6
#: Bits of a hash by which k-mers are told apart and ranked.
HASH_BITS = 39
#: doc_ids of a bucket, as a power of two: the next document is mostly found within the bucket.
BUCKET = 10

_PREFIX = "_omh_"


def fingerprints(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with `out`: an array of one long for each bin in use, (bin << 32 | tuple hash), in order of bins.

    Null and blank texts have an empty array. A step that a later one's loop looks into is a column of its own and
    is looked at there more than once, so Catalyst leaves it to be evaluated once a row.
    """
    w, h, g, s, r, v, q = (f"{_PREFIX}{c}" for c in "whgsrvq")
    kmer = ", ".join(f"get({h}, i + {j})" for j in range(K))
    spare, shift = 64 - HASH_BITS, HASH_BITS - BIN_BITS
    df = df.withColumn(w, F.expr(f"filter(split(regexp_replace(coalesce({text}, ''), '(\\\\S{{{WORD}}})(?=\\\\S)', '$1 '), '\\\\s+'), x -> x <> '')"))
    df = df.withColumn(h, F.expr(f"transform({w}, x -> xxhash64(x))"))
    df = df.withColumn(g, F.expr(f"if(size({h}) = 0, cast(array() as array<bigint>), transform(sequence(0, greatest(size({h}) - {K}, 0)), i -> xxhash64({kmer})))"))
    # equal k-mers stand together, in text order
    df = df.withColumn(s, F.expr(f"sort_array(transform({g}, (x, i) -> struct(shiftrightunsigned(x, {spare}) as hash, i as place)))"))
    # where each run of equal k-mers starts: a running maximum by doubling, as many rounds as the repeats need
    df = df.withColumn(r, F.expr(f"transform({s}, (x, i) -> if(i > 0 and get({s}, i - 1).hash = x.hash, -1, i))"))
    repeats = f"size(filter({r}, x -> x < 0))"
    rounds = f"cast(ceil(log2({repeats} + 1)) as int)"
    double = f"transform(a, (x, i) -> greatest(x, coalesce(get(a, i - shiftleft(1, t - 1)), -1)))"
    df = df.withColumn(r, F.expr(f"if({repeats} = 0, {r}, aggregate(sequence(1, greatest({rounds}, 1)), {r}, (a, t) -> {double}))"))
    rank = f"struct(shiftrightunsigned(xxhash64(x.hash, n), {spare}) as hash, x.place as place)"
    df = df.withColumn(v, F.expr(f"zip_with({s}, transform({r}, (x, i) -> i - x), (x, n) -> {rank})"))
    df = df.withColumn(q, F.expr(f"sort_array({v})"))
    same = f"shiftright(get({q}, i {{}} 1).hash, {shift}) = shiftright(x.hash, {shift})"
    pair = f"if({same.format('+')}, get({q}, i + 1).place, -1)"
    chosen = f"filter(transform({q}, (x, i) -> if(coalesce({same.format('-')}, false), null, struct(x.hash as hash, x.place as a, {pair} as b))), p -> p is not null)"
    first, second = (f"get({g}, {f}(p.a, p.b))" for f in ("least", "greatest"))
    code = f"if(p.b < 0, xxhash64(get({g}, p.a)), xxhash64({first}, {second}))"
    signature = f"transform({chosen}, p -> shiftleft(shiftright(p.hash, {shift}), 32) | ({code} & 4294967295L))"
    return df.withColumn(out, F.expr(signature)).drop(w, h, g, s, r, v, q)


def written(fingerprint: str) -> Column:
    """The fingerprint as hexadecimal digits, ten for each bin in use."""
    return F.expr(f"array_join(transform({fingerprint}, x -> lpad(lower(hex(x)), 10, '0')), '')")


def likeness(a: str, b: str) -> Column:
    """Equal signatures over bins in use in either; 1 if both are empty."""
    bins = f"size(array_union(transform({a}, x -> shiftright(x, 32)), transform({b}, x -> shiftright(x, 32))))"
    return F.expr(f"if({bins} = 0, 1D, cast(size(array_intersect({a}, {b})) as double) / {bins})")


def successors(values: DataFrame, name: str, levels: int = 2) -> DataFrame:
    """(name, following): each distinct value and the next larger one; the largest has null.

    Values are compared within groups of 2**16, and the groups among themselves in the same way, so that no task
    sorts more than those and, at the top, the few groups that are left (2**22 for 64-bit values over 2**10).
    """
    values = values.select(name).distinct()
    if not levels:
        return values.withColumn("following", F.lead(name).over(Window.orderBy(name)))
    group = f"_group{levels}"  # a name of its own on each level
    grouped = values.withColumn(group, F.shiftright(name, 16))
    first = grouped.groupBy(group).agg(F.min(name).alias("_first"))
    after = successors(first, group, levels - 1)
    low = after.join(first.withColumnRenamed(group, "following"), "following").select(group, F.col("_first").alias("_low"))
    inner = grouped.withColumn("_inner", F.lead(name).over(Window.partitionBy(group).orderBy(name)))
    return inner.join(low, group, "left").select(name, F.coalesce("_inner", "_low").alias("following"))


def edited_pairs(docs: DataFrame) -> DataFrame:
    """doc_id, text, fingerprint, next_text and next_fingerprint of each row; the last document is followed by the first.

    Documents stand in order of doc_id, then text. Null text counts as empty. Rows without a doc_id are left out and
    other columns ignored. Texts are shuffled once, by bucket of ids; only each bucket's last row needs the next bucket.
    """
    docs = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.shiftright("doc_id", BUCKET).alias("bucket"))
    dealt = docs.repartition("bucket")
    order = Window.partitionBy("bucket").orderBy("doc_id", "text")
    firsts = dealt.withColumn("place", F.row_number().over(order)).where("place = 1").select(F.col("bucket").alias("following"), F.col("text").alias("first_text"))
    ids = docs.select("bucket")
    lowest = ids.agg(F.min("bucket")).first()[0] or 0
    after = successors(ids, "bucket").select("bucket", F.coalesce("following", F.lit(lowest)).alias("following"))
    over = fingerprints(after.join(firsts, "following").select("bucket", "first_text"), "first_text", "first_fingerprint")
    rows = fingerprints(dealt, "text", "fingerprint")
    rows = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("next_fingerprint", F.lead("fingerprint").over(order))
    rows = rows.join(over, "bucket")
    return rows.select("doc_id", "text", "fingerprint", F.coalesce("next_text", "first_text").alias("next_text"), F.coalesce("next_fingerprint", "first_fingerprint").alias("next_fingerprint"))


def compare(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, its edited text's, and how near the edited text and the next document are."""
    rows = edited_pairs(docs).withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 2 as int)), substring(next_text, 1, cast(n_chars div 2 as int)))"))
    rows = fingerprints(rows.drop("text", "next_text"), "edited", "edited_print")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"),
        written("fingerprint").alias("fingerprint"),
        written("edited_print").alias("edited_fingerprint"),
        likeness("fingerprint", "edited_print").alias("near_edited"),
        likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )
