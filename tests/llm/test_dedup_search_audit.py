"""Exact duplicates, ranked lexical search and the audit of sources, against brute force and DuckDB."""

import math
import os
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, lexical_scan, queries, source_audit

SF = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}


def shown(value):
    return repr(round(value, 9) + 0.0) if isinstance(value, float) else str(value)


def equal_to_sql(spark, name, **tables):
    """The registered query's rows are those of its SQL on the smallest tables."""
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, other = queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name])
    assert {c: TYPES[t] for c, t in df.dtypes} == {c: str(t) for c, t in zip(other.columns, other.types, strict=True)}
    cols = sorted(df.columns)
    at = [other.columns.index(c) for c in cols]
    got = sorted(tuple(shown(r[c]) for c in cols) for r in df.collect())
    assert got and got == sorted(tuple(shown(x[i]) for i in at) for x in other.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_exact_dedup_equals_its_sql(spark):
    equal_to_sql(spark, "op12_exact_dedup")


def brute_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0d]+", " ", t or "")].append(i)
    out = []
    for ids in groups.values():
        ids.sort(key=lambda i: (i is None, i))
        out += [(i, ids[0], len(ids), n == 0) for n, i in enumerate(ids)]
    return sorted(out, key=str)


@pytest.mark.parametrize("slots,prefix", [(1 << 20, 256), (2, 1)])
def test_exact_dedup_equals_brute_force(spark, docs, monkeypatch, slots, prefix):
    """Also with two slots and prefixes of one letter, where all rows go through to the full hash."""
    monkeypatch.setattr(exact_dedup, "SLOTS", slots)
    monkeypatch.setattr(exact_dedup, "PREFIX", prefix)
    long = "word " * 300
    more = [(30, " a  b\t\nc"), (31, " a b c"), (32, "a b c"), (33, " a b c "), (34, long + "x"), (35, long + "y"), (36, long.replace(" ", "\r\n") + "x"), (37, "a b c"), (None, "a b c"), (None, "odd"), (None, "odd")]
    more += [(40, "same")] * 3 + [(41, ""), (42, None), (39, "same"), (39, "other")]
    given = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = exact_dedup.decide(given)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_groups([(r["doc_id"], r["text"]) for r in given.collect()])


def test_one_row_of_equal_texts_stays(docs, no_docs):
    kept = exact_dedup.keep_first(docs)
    assert kept.dtypes == docs.dtypes
    rows = kept.collect()
    assert len({re.sub(r"\s+", " ", r["text"] or "") for r in rows}) == len(rows) and {r["key"] for r in rows} == {"kept", None}
    assert exact_dedup.keep_first(no_docs).count() == exact_dedup.decide(no_docs).count() == 0
    clash = docs.withColumn("_slot", F.lit(1)).withColumn("keep_id", F.lit(2)).withColumn("_whole", F.lit("x"))
    assert exact_dedup.keep_first(clash).columns == clash.columns and exact_dedup.decide(clash).count() == docs.count()


def brute_search(docs, items, k):
    term = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = lambda t: term.findall((t or "").translate(lower))
    words = [(i, Counter(cut(t)), len(cut(t))) for i, t in docs]
    texts, terms = sum(n > 0 for _, _, n in words), sum(n for _, _, n in words)
    df = Counter(t for _, c, _ in words for t in c)
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(cut(t))
    out = []
    for item, asked in wanted.items():
        scores = []
        for i, c, n in words:
            m = 10 + 90 * n * texts // max(1, terms)
            s = sum(math.floor(1000 * math.log((2 * texts + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in asked if t in c)
            if s > 0 and i is not None:
                scores.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k]) if item is not None]
    return sorted(out)


@pytest.fixture(scope="module")
def asked(spark, texts):
    rows = [(n, " ".join(texts[i].split(" ")[:30])) for n, i in enumerate((1, 10, 18, 19, 20, 13, 15, 12))]
    return rows + [(50, None), (51, ""), (52, "nowhere at-all"), (53, "HELLO hello same"), (53, "line; WORD"), (None, "hello")]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_lexical_search_equals_its_sql(spark):
    equal_to_sql(spark, "op11_lexical_scan")


@pytest.mark.parametrize("block,cells,piece", [(1 << 17, 1 << 21, 1 << 20), (20, 30, 40)])
def test_lexical_search_equals_brute_force(spark, docs, asked, monkeypatch, block, cells, piece):
    """Also with small blocks of items, few scores at once and texts cut into pieces."""
    monkeypatch.setattr(lexical_scan, "BLOCK", block)
    monkeypatch.setattr(lexical_scan, "CELLS", cells)
    monkeypatch.setattr(lexical_scan, "PIECE", piece)
    items = spark.createDataFrame(asked, "item_id long, text string").withColumn("term", F.lit(1)).withColumn("doc_id", F.lit(2))
    given = docs.withColumn("item_id", F.lit(1)).withColumn("score", F.lit("x"))
    got = lexical_scan.search(given, items, 5)
    assert [t for _, t in got.dtypes] == ["bigint", "int", "bigint", "bigint"]
    want = brute_search([(r["doc_id"], r["text"]) for r in given.collect()], asked, 5)
    assert want and sorted(map(tuple, got.collect())) == want


def test_lexical_search_without_texts_or_items(spark, docs, no_docs, asked):
    items = spark.createDataFrame(asked, "item_id long, text string")
    assert lexical_scan.search(no_docs, items).count() == lexical_scan.search(docs, items.where("item_id > 99")).count() == 0
    assert lexical_scan.search(docs, items.where("item_id = 50")).columns == ["item_id", "rank", "doc_id", "score"]
    named = lexical_scan.search(docs, items.select(F.concat(F.lit("q"), "item_id").alias("item_id"), "text"), 1)
    assert dict(named.dtypes)["item_id"] == "string" and named.count() > 5


def test_terms_are_counted_as_whole_words():
    automaton = lexical_scan.Block([1], [b"a", "\u00e9a".encode(), b"b2"], None, None).automaton()
    sizes, text, term, times = lexical_scan.read([b"A a-a ab B2,b2 \xc3\xa9a", None, b"", b"  ;", b"a"], automaton)
    assert sizes.tolist() == [7, 0, 0, 0, 1]
    assert sorted(zip(text.tolist(), term.tolist(), times.tolist(), strict=True)) == [(0, 0, 3), (0, 1, 1), (0, 2, 2), (4, 0, 1)]


def brute_audit(rows, least=10, top=10):
    term = re.compile(r"[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(g or "", s or "", term.findall((t or "").translate(lower))) for t, g, s in rows]
    out = []
    for lang in {g for g, _, _ in docs}:
        df = Counter(w for g, _, ws in docs if g == lang for w in set(ws))
        kept = [w for w, n in df.items() if n >= least]
        count = defaultdict(Counter)
        for g, s, ws in docs:
            if g == lang:
                count[s].update(w for w in ws if df[w] >= least)
        whole = sum(count.values(), Counter())
        share = lambda c, w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept))  # noqa: B023, E731
        far = lambda p, q: (p - q) ** 2 // (p + q)
        for s in count:
            pairs = [(-sum(far(share(count[s], w), share(count[o], w)) for w in kept), o.encode()) for o in count if o != s]
            terms = [(-far(share(count[s], w), share(whole, w)), w.encode()) for w in kept if count[s][w] > 0 and share(count[s], w) > share(whole, w)]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -value, r + 1) for r, (value, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_source_audit_equals_its_sql(spark):
    equal_to_sql(spark, "op13_source_audit")


@pytest.mark.parametrize("values,slots,pairs", [(None, 1 << 20, 1 << 22), (7, 2, 0)])
def test_source_audit_equals_brute_force(spark, docs, texts, monkeypatch, values, slots, pairs):
    """Also with seven digests for all terms, which are split then, and with slots and sums that hold next to nothing."""
    monkeypatch.setattr(source_audit, "SLOTS", slots)
    monkeypatch.setattr(source_audit, "PAIRS", pairs)
    rows = [(texts[n % 20 + 1][: 400 + n] if texts[n % 20 + 1] else None, ("en", "fr", None)[n % 3], f"s{n % 4}" if n % 5 else None) for n in range(120)]
    rows += [("Zwei zwei \u00c9 \u00e9 ZWEI", "de", "a")] * 12 + [("eins", "de", "b")] * 9 + [("", "de", "c"), (None, "xx", "only"), (None, "xx", "other")]
    given = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"term": F.lit(1), "key": F.lit("k"), "part": F.lit(0)}).repartition(5)
    monkeypatch.setattr(source_audit, "RUN", 1 << 23 if values is None else 900)
    got = source_audit.audit(given, **({} if values is None else {"digest": lambda h: h % np.uint64(7)}))
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    want = brute_audit(rows)
    assert len({r[2] for r in want}) == 2 and sorted(map(tuple, got.collect())) == want


def test_source_audit_of_nothing(no_docs, docs):
    assert source_audit.audit(no_docs).count() == 0
    assert source_audit.audit(docs, least=1).where("part = 'term'").count() <= 20


def test_shares_are_exact_for_large_counts(spark):
    rows = [(0, 0, 0), (5, 7, 3), (10**12, 3 * 10**14, 10**9), (2**61, 2**62, 5)]
    got = spark.createDataFrame(rows, "n long, terms long, kinds long").select(source_audit._share("n", "terms", "kinds").alias("p")).collect()
    assert [r["p"] for r in got] == [None] + [1 + 10**9 * (n + 2) // (t + 2 * k) for n, t, k in rows[1:]]
