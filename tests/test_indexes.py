"""Stored indexes and the search for passages: against plain Python and against the searches that store nothing."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import bm25, passages, search, stored_index, vector_index
from tessera.plans import search_plans
from tessera.sources import readers

SF = "/root/testdata/{}"
WORDS = [f"w{n}" for n in range(60)]


def texts(n, seed=1):
    """n texts, common and rare words, some of them empty; every third has a word that all of them share."""
    draw = random.Random(seed)
    return [(f"d{i}", " ".join(draw.choices(WORDS, [60 / (j + 1) for j in range(60)], k=draw.choice([0, 3, 12, 40]))) + (" common" * (i % 4) if i % 3 else "")) for i in range(n)]


def counted(spark, rows):
    return bm25.counted(spark.createDataFrame(rows, "id string, text string"), "id", "text")


def asked(spark):
    return spark.createDataFrame([(q, t) for q in range(8) for t in (f"w{q}", f"w{q * 7}", f"w{50 + q}", "common", "common", "nowhere")], "qid long, term string")


def found(df):
    return sorted((r["qid"], r["rank"], r["id"], round(r["score"], 5)) for r in df.collect())


def plain(spark, rows, k):
    posted = counted(spark, rows).persist()
    return found(bm25.top_k(bm25.build(bm25.postings_of(posted), bm25.lengths_of(posted)), asked(spark), k))


@pytest.fixture(scope="module")
def small():
    before = stored_index.SHARD, stored_index.FILE_POSTINGS
    stored_index.SHARD, stored_index.FILE_POSTINGS = 10, 100
    yield
    stored_index.SHARD, stored_index.FILE_POSTINGS = before


def test_a_stored_index_answers_as_one_in_memory(spark, tmp_path, small):
    rows = texts(200)
    index = stored_index.build_index(counted(spark, rows), str(tmp_path))
    again = stored_index.open_index(spark, str(tmp_path))
    for k in (1, 5, 500):
        want = plain(spark, rows, k)
        assert found(bm25.top_k(index, asked(spark), k)) == found(again.search(asked(spark), k, pruned=False)) == want
    assert again.num_docs == 200 and {r["term"]: r["df"] for r in again.terms.collect()}["common"] == sum("common" in t for _, t in rows)
    assert sorted(map(tuple, again.lengths.collect())) == sorted((i, len(t.split()), len(set(t.split()))) for i, t in rows)
    some = spark.createDataFrame([(f"d{n}",) for n in range(0, 200, 7)], "id string")
    want = [r for r in plain(spark, rows, 500) if int(r[2][1:]) % 7 == 0]
    got = found(search.within(again, some.withColumn("vector", F.array(F.lit(1.0))), some)[0].search(asked(spark), 500))
    assert [(q, i, s) for q, _, i, s in got] == [(q, i, s) for q, _, i, s in want]


def test_shards_that_cannot_reach_the_top_are_left_out(spark, tmp_path, small):
    """One shard's worth of long texts of a rare word among short texts without it."""
    rows = [(f"d{i}", "rare " * 5 if i < 12 else "rare " + "filler " * 60 if i % 5 == 0 else "filler other") for i in range(400)]
    index = stored_index.build_index(counted(spark, rows), str(tmp_path))
    terms = spark.createDataFrame([(1, "rare")], "qid long, term string")
    blocks = index.asked_blocks(terms)
    live = index.live_shards(blocks, 3).groupBy("live").count().collect()
    counts = {r["live"]: r["count"] for r in live}
    assert counts[False] > 0.5 * sum(counts.values())
    assert found(index.search(terms, 3)) == found(index.search(terms, 3, pruned=False))


def test_a_search_opens_the_buckets_of_its_terms_only(spark, tmp_path):
    index = stored_index.build_index(counted(spark, texts(100)), str(tmp_path))
    terms = spark.createDataFrame([(1, "w1")], "qid long, term string")
    plan = index.asked_blocks(terms)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket" in plan.split("PartitionFilters: [", 1)[1].split("]")[0]


def test_generations_add_hide_and_merge(spark, tmp_path, small):
    rows = texts(150)
    base, own = str(tmp_path / "base"), str(tmp_path / "own")
    index = stored_index.build_index(counted(spark, rows), base)
    gone = spark.createDataFrame([("d1",), ("d2",), ("d2",), ("none",)], "id string")
    less = stored_index.remove_documents(stored_index.branch(index, own), gone)
    left = [r for r in rows if r[0] not in ("d1", "d2")]
    assert found(less.search(asked(spark), 10)) == plain(spark, left, 10)
    fresh = [("d2", "w1 w1 common new"), ("d3", "new new"), ("n1", "w0 w50 w51"), ("n2", "")]
    more = stored_index.add_documents(less, counted(spark, fresh))
    now = [r for r in left if r[0] != "d3"] + fresh
    for some in (more, stored_index.open_index(spark, own), stored_index.merge(more, str(tmp_path / "merged"))):
        assert found(some.search(asked(spark), 10)) == plain(spark, now, 10)
        assert some.num_docs == len(now) and some.terms.where("term = 'new'").first()["df"] == 2
    # the first index is as it was, and a second removal of what is gone changes nothing
    assert found(stored_index.open_index(spark, base).search(asked(spark), 10)) == plain(spark, rows, 10)
    twice = stored_index.remove_documents(less, gone)
    assert twice.num_docs == len(now) - 1 and twice.lengths.where("id = 'd2'").count() == 0 and less.num_docs == 148


def test_a_generation_counts_once_the_manifest_lists_it(spark, tmp_path):
    index = stored_index.build_index(counted(spark, texts(20)), str(tmp_path))
    stored_index._write_generation(counted(spark, texts(50, 2)), str(tmp_path), 1, index.buckets)  # a job that fails before it enters it
    assert stored_index.open_index(spark, str(tmp_path)).num_docs == 20
    assert stored_index.open_index(spark, str(tmp_path / "none")) is None
    with pytest.raises(ValueError):
        stored_index.build_index(counted(spark, texts(1)), str(tmp_path / "bad"), k1=0)


def test_an_index_of_nothing(spark, tmp_path):
    index = stored_index.build_index(counted(spark, []), str(tmp_path / "a"))
    assert index.num_docs == 0 and index.search(asked(spark), 5).count() == index.terms.count() == 0
    index = stored_index.add_documents(index, counted(spark, texts(30)))
    assert found(index.search(asked(spark), 5)) == plain(spark, texts(30), 5)


def test_a_key_changes_with_the_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    first = readers.content_key(spark, path)
    assert readers.content_key(spark, path) == first
    spark.range(5).write.mode("append").parquet(path)
    assert readers.content_key(spark, path) != first


@pytest.mark.parametrize("piece,block", [(1 << 20, 1 << 22), (16, 40)])
def test_passages_are_found_letter_by_letter(spark, monkeypatch, piece, block):
    monkeypatch.setattr(passages, "PIECE", piece)
    monkeypatch.setattr(passages, "BLOCK", block)
    draw = random.Random(3)
    held = ["".join(draw.choices("ab é", k=draw.choice([0, 1, 5, 30, 200, 900]))) for _ in range(60)] + ["a" * 300, "ab" * 100, None, ""]
    cut = lambda t: t[(at := draw.randrange(len(t) or 1)) : at + draw.choice([1, 2, 3, 8, 17, 64, 130])]
    wanted = [cut(draw.choice(held[:-2])) for _ in range(50)] + ["", None, "a" * 120, "a" * 119 + "b", "ba" * 64, "b", "c", "é", "zz" * 40]
    chunks = spark.createDataFrame(list(enumerate(held)), "id long, text string").repartition(3)
    asked = spark.createDataFrame(list(enumerate(wanted)), "qid long, passage string")
    got = passages.holders(chunks, asked)
    want = sorted((q, i) for q, p in enumerate(wanted) for i, t in enumerate(held) if p is not None and t is not None and p in t)
    assert sorted(map(tuple, got.collect())) == want
    assert passages.holders(chunks, asked.where("qid < 0")).count() == passages.holders(chunks.where("id < 0"), asked).count() == 0
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def exact(vectors, queries, k):
    return {(r["qid"], r["id"]) for r in search.dense_top_k(vectors, queries, k).collect()}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_cells_keep_nine_tenths_of_the_neighbours(spark, tmp_path, sf):
    """Under a fifth of all pairs are scored exactly: 80 of 500, or of 2,000, vectors a query."""
    if not os.path.isdir(SF.format(sf)):
        pytest.skip("no test tables")
    vectors, queries = search_plans.every_fiftieth(spark, SF.format(sf))
    index = vector_index.build_vector_index(vectors, str(tmp_path))
    want, got = exact(vectors, queries, 20), {(r["qid"], r["id"]) for r in vector_index.approximate_top_k(index, queries, 20).collect()}
    recall = len(want & got) / len(want)
    print("recall", sf, recall)
    assert index.rows().count() == vectors.count() and 4 * 20 < 0.2 * vectors.count() and recall >= 0.9


def test_few_cells_are_opened_where_vectors_cluster(spark, tmp_path):
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(20, 16)) * 4
    points = np.concatenate([centres[draw.integers(0, 20, 1500)] + draw.normal(size=(1500, 16)) * 0.3, np.tile(centres[:1], (500, 1))])
    vectors = spark.createDataFrame([(f"v{i}", p.tolist()) for i, p in enumerate(points)] + [("zero", [0.0] * 16), ("none", None), (None, [1.0] * 16)], "id string, vector array<double>")
    index = vector_index.build_vector_index(vectors, str(tmp_path))
    queries = vectors.where("id is not null and pmod(hash(id), 40) = 0").select(F.col("id").alias("qid"), F.col("vector").alias("qvec"))
    assert index.rows().count() == 2001 and index.probes < 0.3 * len(index.codebooks.centres)
    want, got = exact(vectors.where("id is not null"), queries, 5), {(r["qid"], r["id"]) for r in vector_index.approximate_top_k(index, queries, 5, rescored=8).collect()}
    assert len(want & got) >= 0.9 * len(want)
    scores = {(r["qid"], r["id"]): r["score"] for r in search.dense_top_k(vectors, queries, 5).collect()}
    assert all(abs(scores[r["qid"], r["id"]] - r["score"]) < 2e-6 for r in vector_index.approximate_top_k(index, queries, 5).collect() if (r["qid"], r["id"]) in scores)
    assert vector_index.approximate_top_k(index, queries.where("qid = ''"), 5).count() == 0


def test_the_best_of_all_batches_stay_with_ties_by_id():
    draw = np.random.default_rng(2)
    for margin in (0.0, 2e-6):
        best, rows = search.Nearest(4, 3, margin), []
        for _ in range(10):
            ids, scores = draw.integers(0, 1000, 40), draw.integers(0, 6, (40, 4)) / 5
            best.add(np.arange(4), ids, scores)
            rows += [(q, -s[q], i) for i, s in zip(ids.tolist(), scores.tolist(), strict=True) for q in range(4)]
        q, ids, score, _ = best.rows()
        got = sorted(zip(q.tolist(), (-score).tolist(), ids.tolist(), strict=True))
        want = [r for n in range(4) for r in sorted(x for x in rows if x[0] == n)[:3]]
        assert got == sorted(want)


def test_corpus_statistics_are_counted_in_one_pass(spark):
    """As from postings and lengths, texts without terms and no text at all among them; no table is kept in memory for it."""
    for rows in (texts(60), [("a", ""), ("b", None)], []):
        own = counted(spark, rows)
        got, want = (df.select("num_docs", "avg_doc_length", "total_terms").first() for df in (bm25.corpus_stats_of(own), bm25.corpus_stats(bm25.postings_of(own), bm25.lengths_of(own))))
        assert got == want
    if os.path.isdir(SF.format("sf0.001")):
        plan = search_plans.d3_corpus_stats(spark, SF.format("sf0.001"))._jdf.queryExecution().executedPlan().toString()
        assert "InMemoryTableScan" not in plan and plan.count("FileScan") == 1


def test_blocks_are_formed_where_their_chunks_are_read(spark, tmp_path, small):
    """Blocks hold every posting once, and a search sends terms, shards and a filter's ids to the blocks, which stay where they are."""
    rows = texts(120, 3)
    index = stored_index.build_index(counted(spark, rows), str(tmp_path))
    posts = sorted((p["id"], b["term"], p["tf"], p["doc_length"]) for b in index.blocks().collect() for p in b["postings"])
    assert posts == sorted((r["id"], r["term"], r["tf"], r["doc_length"]) for r in bm25.postings_of(counted(spark, rows)).collect())
    for b in index.blocks().collect():
        assert (b["max_tf"], b["min_length"], b["n"]) == (max(p["tf"] for p in b["postings"]), min(p["doc_length"] for p in b["postings"]), len(b["postings"]))
        assert b["n"] <= stored_index.SHARD
    ids = spark.createDataFrame([(f"d{n}",) for n in range(0, 120, 3)], "id string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for some in (index, index.within(ids)):
            plan = some.search(asked(spark), 5)._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin [term" in plan and "BroadcastHashJoin [qid" in plan and ("BroadcastHashJoin [id" in plan) == (some is not index)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
