"""Approximate dense search against the exact one."""

import os
import random

import pytest

from tessera.operators import bm25, search
from tessera.plans import search_plans

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_buckets_keep_nine_tenths_of_the_neighbours(spark):
    vectors, queries = search_plans.dense_queries(spark, SF)
    exact = {(r["qid"], r["id"]) for r in search.dense_top_k(vectors, queries, 20).collect()}
    found = {(r["qid"], r["id"]) for r in search.dense_top_k_lsh(vectors, queries, 20).collect()}
    recall = len(exact & found) / len(exact)
    print("recall", recall)
    assert recall >= 0.9


def test_buckets_give_the_pairs_of_the_join_without_joining(spark):
    """The candidates of Spark's own similarity join, ranked; the plan pairs no rows by a join or a shuffle of vectors."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.sql import functions as F

    draw = random.Random(5)
    rows = [(i, [draw.gauss(0, 1) for _ in range(8)]) for i in range(300)] + [(300, [0.0] * 8), (301, None)]
    vectors = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    queries = spark.createDataFrame([(i, v) for i, v in rows if i % 30 == 0 or v is None], "qid long, qvec array<double>")
    got = search.dense_top_k_lsh(vectors, queries, 5, width=0.3, tables=2, within=1.2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "hashpartitioning(qid" in plan
    known = [r for r in rows if r[1] is not None]  # Spark's join fails on null vectors
    mine = spark.createDataFrame(known, "id long, vector array<double>").select("id", array_to_vector(search.unit("vector")).alias("f"))
    asked = spark.createDataFrame([r for r in known if r[0] % 30 == 0], "qid long, qvec array<double>").select("qid", array_to_vector(search.unit("qvec")).alias("f"))
    model = BucketedRandomProjectionLSH(inputCol="f", outputCol="h", bucketLength=0.3, numHashTables=2, seed=11).fit(mine)
    pairs = model.approxSimilarityJoin(mine, asked, 1.2, "d").select(F.col("datasetA.id").alias("id"), F.col("datasetB.qid").alias("qid"), vector_to_array("datasetA.f").alias("v"), vector_to_array("datasetB.f").alias("q"))
    want = bm25.ranked(pairs.select("qid", "id", F.round(F.greatest(F.lit(0.0), 1 - (1 - search.dot("v", "q")) / 2), 6).alias("score")), 5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert search.dense_top_k_lsh(vectors.where("id < 0"), queries, 5).count() == search.dense_top_k_lsh(vectors, queries.where("qid < 0"), 5).count() == 0
