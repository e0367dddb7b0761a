"""Filter objects, formula references, the configuration grid, the gate on empty results and latency sketches, against plain Python."""

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tessera.operators import bm25, evaluate, grid, observe, search
from tessera.operators.predicates import where_object

SF = "/root/testdata/sf0.001"
ROWS = [(1, "en", 5), (2, "de", None), (3, None, 7), (4, "en", 9)]


@pytest.mark.parametrize(
    "condition, ids",
    [
        ({}, [1, 2, 3, 4]), ({"lang": "en"}, [1, 4]), ({"lang": None}, [3]), ({"lang": {"$ne": "en"}}, [2, 3]), ({"lang": {"$nin": ["en"]}}, [2, 3]),
        ({"lang": {"$nin": ["en", None]}}, [2]), ({"lang": {"$in": []}}, []), ({"lang": {"$nin": []}}, [1, 2, 3, 4]), ({"lang": {"$in": ["de", None]}}, [2, 3]),
        ({"n": {"$gt": 5, "$lte": 9}}, [3, 4]), ({"n": {"$gte": 5, "$lt": 9}, "lang": "en"}, [1]),
        ({"$or": [{"n": 7}, {"$and": [{"lang": "en"}, {"id": {"$gt": 1}}]}]}, [3, 4]),
    ],
)
def test_filter_objects(spark, condition, ids):
    rows = spark.createDataFrame(ROWS, "id long, lang string, n long")
    assert sorted(r["id"] for r in search.filter_results(rows, where=condition).collect()) == ids
    assert rows.where(where_object(condition).isNull()).count() == 0


@pytest.mark.parametrize("wrong", [{"n": {"$near": 1}}, {"$not": []}, {"$or": []}, {"$and": {}}, {"n": {}}, {"n": [1]}, {"n": {"$in": 3}}, {"n": {"$gt": None}}, "n", {"$or": ["n"]}])
def test_filters_of_another_shape_are_errors(wrong):
    with pytest.raises(ValueError):
        where_object(wrong)


def test_filters_reach_the_files(spark, request):
    before = spark.conf.get("spark.sql.maxMetadataStringLength")
    request.addfinalizer(lambda: spark.conf.set("spark.sql.maxMetadataStringLength", before))
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    rows = spark.read.parquet(f"{SF}/documents.parquet").where(where_object({"$or": [{"lang": {"$in": ["en", "de"]}}, {"n_chars": {"$gte": 4000}}], "source": {"$ne": "src1"}}))
    pushed = next(x for x in rows._jdf.queryExecution().executedPlan().toString().split("\n") if "PushedFilters" in x)
    assert "Or(" in pushed and "GreaterThanOrEqual(n_chars,4000)" in pushed and "Not(EqualTo(source,src1))" in pushed


def references(index, asked, k):
    """(id, other, shared, rank) by counting over all pairs."""
    of = {}
    for f, i in set(index):
        of.setdefault(f, set()).add(i)
    shared = Counter(p for ids in of.values() for a, b in combinations(sorted(ids), 2) for p in ((a, b), (b, a)))
    out = []
    for a in asked:
        found = sorted(((-n, b) for (x, b), n in shared.items() if x == a))[:k]
        out += [(a, b, -n, r) for r, (n, b) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("heavy", [0, 3, 12, 1000])
def test_cross_references_with_formulas_in_all_chunks(spark, heavy):
    draw = random.Random(4)
    index = [("all", i) for i in range(60)] + [(f"f{draw.randint(0, 12)}", draw.randint(0, 59)) for _ in range(150)] + [("all", 3), ("alone", 99)]
    frame = spark.createDataFrame([*index, (None, 5)], "formula_id string, id long")
    results = spark.createDataFrame([(i,) for i in (*range(0, 60, 2), 0, 99, 500)], "id long")
    got = search.cross_references(results, frame, 4, heavy).select("id", "other", "shared", "rank").collect()
    assert sorted(map(tuple, got)) == references(index, sorted({*range(0, 60, 2), 99}), 4)
    assert search.cross_references(results, frame.limit(0), 4, heavy).count() == 0


def test_grid_equals_one_search_for_each_configuration(spark):
    draw = random.Random(2)
    docs = [(i, " ".join(draw.choices("alpha beta gamma delta eps zeta".split(), k=draw.randint(0, 30)))) for i in range(80)]
    rows = bm25.counted(spark.createDataFrame(docs, "id long, text string"), "id", "text")
    posts, sizes = bm25.postings_of(rows).persist(), bm25.lengths_of(rows).persist()
    asked = spark.createDataFrame([(1, "alpha"), (1, "zeta"), (2, "beta"), (3, "none")], "qid long, term string")
    dense = spark.createDataFrame([(1, 1, 7), (1, 2, 8), (2, 1, 9), (4, 1, 5)], "qid long, rank long, id long")
    configs = [grid.Config("a"), grid.Config("b", k1=0.6, b=0.2, rrf_k=5, dense=0.2), grid.Config("c", sparse=0.0)]
    index = bm25.build(posts, sizes)
    hits = posts.join(asked.join(index.terms, "term"), "term").select("qid", "id", F.col("idf").alias("weight"), "tf", "doc_length")
    got = grid.search_grid(hits, dense, configs, index.avg_doc_length, 6)
    for c in configs:
        alone = search.rrf([dense, bm25.build(posts, sizes, c.k1, c.b).search(asked, 20)], c.rrf_k, 6, [c.dense, c.sparse])
        mine = got.where(F.col("config_id") == c.name).select("qid", "rank", "id", "score")
        assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, alone.select("qid", "rank", "id", "score").collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("InMemoryRelation") <= 3  # postings under hits and under the terms' counts, whatever the number of configurations
    for wrong in ([], [grid.Config("a"), grid.Config("a")], [grid.Config("a", k1=0)], [grid.Config("a", dense=-1)]):
        with pytest.raises(ValueError):
            grid.search_grid(hits, dense, wrong, 1.0)


def test_bootstrap_tells_a_difference_from_chance(spark):
    draw = random.Random(7)
    base = [draw.random() for _ in range(300)]
    rows = [("base", q, x) for q, x in enumerate(base)] + [(c, q, x + more + draw.gauss(0, 0.1)) for c, more in (("better", 0.05), ("noise", 0.0)) for q, x in enumerate(base)]
    frame = spark.createDataFrame([*rows, ("better", 999, 1.0)], "config_id string, qid long, value double")
    got = {r["config_id"]: r for r in grid.paired_bootstrap(frame, "base").collect()}
    assert got["base"]["low"] == got["base"]["high"] == got["base"]["change"] == 0
    assert got["better"]["low"] > 0.03 and got["better"]["high"] < 0.07 and got["noise"]["low"] < 0 < got["noise"]["high"]
    assert {r["n_queries"] for r in got.values()} == {300}
    assert sorted(map(tuple, grid.paired_bootstrap(frame.repartition(7), "base").collect())) == sorted(map(tuple, got.values()))


def test_gate_fails_on_a_query_without_results(spark):
    summary = spark.createDataFrame([(0.9, 0.8)], "avg_hit_at_k double, avg_mrr_at_k double")
    queries, found = spark.createDataFrame([(1,), (2,)], "qid long"), spark.createDataFrame([(1, 1, 5)], "qid long, rank long, id long")
    row = evaluate.gate(summary, {"avg_hit_at_k": 0.5}, queries, found).first()
    assert (row["n_empty"], row["passed"], row["avg_mrr_at_k"]) == (1, False, 0.8)
    assert evaluate.gate(summary, {"avg_hit_at_k": 0.5}, queries.limit(1), found).first()["passed"] is True
    assert evaluate.gate(summary, {"avg_hit_at_k": 0.95}, queries.limit(1), found).first()["passed"] is False


def test_latency_sketches_merge_within_their_bound(spark):
    n = 60_000
    times = spark.range(n, numPartitions=6).select((F.col("id") % 7).alias("day"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("stage"), ((F.col("id") * 7919) % n).cast("double").alias("elapsed_ms"))
    times = times.unionByName(spark.createDataFrame([(0, "a", None), (0, "none", None)], "day long, stage string, elapsed_ms double"))
    days = [observe.latency_sketches(times.where(F.col("day") == d)) for d in range(7)]
    stored = days[0]
    for d in days[1:]:
        stored = stored.unionByName(d)
    got = {r["stage"]: r for r in observe.latency_of_sketches(stored).collect()}
    exact = {r["stage"]: r for r in observe.latency(times.where("elapsed_ms is not null")).collect()}
    assert set(got) == {"a", "b"} and all(got[s]["n"] == n // 2 for s in got)
    for s in got:
        assert all(abs(got[s][p] - exact[s][p]) <= 0.015 * n for p in ("p50", "p95", "p99"))
    assert observe.latency_of_sketches(stored.limit(0)).count() == 0
