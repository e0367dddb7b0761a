"""Registered queries over documents, benchmark texts and embeddings, with their SQL: indexing, search, evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bm25, evaluate, grid, observe, passages, query, search, stored_index, vector_index, views
from ..sources.readers import content_key, shared_folder, spread

Q, SQL = {}, {}
_WORD = r"[\p{L}\p{N}_]+(?:-[\p{L}\p{N}_]+)*"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def long(*names):
    return [F.col(n).cast("long").alias(n) for n in names]


_TOKENS = f"list_filter(regexp_extract_all(lower(text), '{_WORD}'), lambda x: length(x) >= 2)"
_POSTS = f"posts AS (SELECT id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id AS id, unnest({_TOKENS}) AS term FROM documents) GROUP BY 1, 2)"
_LENS = f"lens AS (SELECT doc_id AS id, len({_TOKENS})::BIGINT AS doc_length FROM documents)"
_TERMS = "st AS (SELECT count(*)::DOUBLE AS n, avg(doc_length) AS mean FROM lens), terms AS (SELECT term, count(*)::BIGINT AS df FROM posts GROUP BY 1), idfs AS (SELECT term, df, ln((n - df + 0.5::double) / (df + 0.5::double)) AS idf FROM terms, st)"
#: Words of a benchmark text that are looked up: the first ten distinct ones that are no stop words.
_STOP = ", ".join(f"'{w}'" for w in query.STOPWORDS)
_KW = f"list_filter(regexp_extract_all(text, '{_WORD}'), lambda x: NOT list_contains([{_STOP}], lower(x)))"
_KEYWORDS = f"kw AS (SELECT item_id AS qid, list_slice(list_filter(k, lambda x, i: list_position(list_transform(k, lambda y: lower(y)), lower(x)) = i), 1, 20) AS k FROM (SELECT item_id, {_KW} AS k FROM benchmark))"
_QTERMS = "qt AS (SELECT DISTINCT qid, lower(t) AS term FROM (SELECT qid, unnest(k) AS t FROM kw))"
_SPARSE = (
    "sparse AS (SELECT * FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM ("
    "SELECT qid, posts.id, round(sum(idf * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * doc_length / mean))), 6) AS score "
    "FROM qt JOIN posts USING (term) JOIN idfs USING (term) JOIN lens ON lens.id = posts.id, st GROUP BY 1, 2)) WHERE rank <= 20)"
)
_DENSE = (
    "dense AS (SELECT * FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM ("
    "SELECT q.item_id AS qid, v.vec_id AS id, round(greatest(0, 1 - (1 - list_cosine_similarity(v.embedding::DOUBLE[], e.embedding::DOUBLE[])) / 2), 6) AS score "
    "FROM benchmark q JOIN embeddings e ON e.vec_id = q.item_id, embeddings v)) WHERE rank <= 20)"
)
_FUSED = "fused AS (SELECT qid, id, round(sum(1::double / (60 + rank)), 6) AS score FROM (SELECT qid, id, rank FROM dense UNION ALL SELECT qid, id, rank FROM sparse) GROUP BY 1, 2)"
_INDEX = f"{_POSTS}, {_LENS}, {_TERMS}"
_ASKED = f"{_KEYWORDS}, {_QTERMS}"
_TRUTH = "truth AS (SELECT item_id AS qid, doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def index_of(spark: SparkSession, sf_dir: str) -> stored_index.StoredIndex:
    """The stored index of the documents as they are now; the first query that asks for it writes it."""
    folder = f"{shared_folder(spark)}/index-{stored_index.FORMAT}-{content_key(spark, f'{sf_dir}/documents.parquet')}"
    return stored_index.open_index(spark, folder) or stored_index.build_index(bm25.counted(spread(table(spark, sf_dir, "documents")), "doc_id", "text"), folder)


def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    kw = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.explode(query.keywords("text")).alias("t"))
    return kw.select("qid", F.lower("t").alias("term")).distinct()


def dense_queries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid")).join(vectors.withColumnRenamed("id", "qid").withColumnRenamed("vector", "qvec"), "qid")
    return vectors, asked


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, id): documents that hold a benchmark text."""
    return passages.holders(spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("id"), "text"), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("passage")))


@register(f"SELECT doc_id, len(t)::BIGINT AS n_tokens, sha256(array_to_string(t, ' ')) AS tokens_sha256 FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)")
def d1_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.tokens("text").alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.sha2(F.array_join("t", " "), 256).alias("tokens_sha256"))


@register(f"WITH {_POSTS}, {_LENS} SELECT lens.id, doc_length, coalesce(u, 0)::BIGINT AS unique_terms, coalesce(s, 0)::BIGINT AS tf_squares FROM lens LEFT JOIN (SELECT id, count(*) AS u, sum(tf * tf) AS s FROM posts GROUP BY 1) p ON p.id = lens.id")
def d2_term_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    squares = F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c["tf"] * c["tf"])
    return bm25.counted(spread(docs), "doc_id", "text").select("id", "doc_length", F.size("counts").cast("long").alias("unique_terms"), squares.alias("tf_squares"))


@register(f"WITH {_POSTS}, {_LENS} SELECT (SELECT count(*) FROM lens)::BIGINT AS num_docs, (SELECT round(avg(doc_length), 6) FROM lens) AS avg_doc_length, (SELECT count(DISTINCT term) FROM posts)::BIGINT AS total_terms")
def d3_corpus_stats(spark, sf_dir):
    rows = bm25.counted(spread(table(spark, sf_dir, "documents")), "doc_id", "text")
    return bm25.corpus_stats_of(rows).withColumn("avg_doc_length", F.round("avg_doc_length", 6))


@register(f"WITH {_INDEX} SELECT term, df, round(idf, 6) AS idf FROM idfs")
def d4_bm25_terms(spark, sf_dir):
    return index_of(spark, sf_dir).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@register(f"WITH {_INDEX}, {_ASKED}, {_SPARSE} SELECT qid, rank, id, score FROM sparse")
def d5_bm25_top_k(spark, sf_dir):
    return bm25.top_k(index_of(spark, sf_dir), query_terms(spark, sf_dir), 20)


def _incremental(spark, sf_dir, back: bool):
    """The index after documents of src0 and src1 were hidden, and, on request, added again; the stored one stays as it is."""
    docs = table(spark, sf_dir, "documents")
    some = docs.where(F.col("source").isin("src0", "src1"))
    folder = f"{shared_folder(spark)}/branch-{uuid.uuid4().hex}"
    index = stored_index.remove_documents(stored_index.branch(index_of(spark, sf_dir), folder), some.select(F.col("doc_id").alias("id")))
    return stored_index.add_documents(index, bm25.counted(spread(some), "doc_id", "text")) if back else index


@register(f"WITH {_INDEX} SELECT term, df, round(idf, 6) AS idf FROM idfs")
def d6_add_documents(spark, sf_dir):
    return _incremental(spark, sf_dir, True).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@register("WITH " + _INDEX.replace("FROM documents", "FROM documents WHERE source NOT IN ('src0', 'src1')") + " SELECT term, df, round(idf, 6) AS idf FROM idfs")
def d7_remove_documents(spark, sf_dir):
    return _incremental(spark, sf_dir, False).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@register(f"WITH {_POSTS}, {_LENS} SELECT coalesce(reason, 'fine') AS reason, count(*)::BIGINT AS n FROM (SELECT CASE WHEN tf > 40 THEN 'bad frequency' END AS reason FROM posts JOIN lens USING (id)) GROUP BY 1")
def d8_check_term_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    stats = bm25.postings(spread(docs), "doc_id", "text")
    checked = bm25.check_term_stats(stats.withColumn("tf", F.when(F.col("tf") > 40, 0).otherwise(F.col("tf"))))
    return checked.groupBy(F.coalesce("reason", F.lit("fine")).alias("reason")).agg(F.count("*").alias("n"))


@register(f"WITH {_POSTS} SELECT id, term, tf, rank::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tf DESC, term) AS rank FROM posts) WHERE rank <= 10")
def b25_top_terms(spark, sf_dir):
    return bm25.top_terms(bm25.postings(spread(table(spark, sf_dir, "documents")), "doc_id", "text"), 10)


@register("SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS q FROM benchmark")
def e1_normalize_query(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.normalize_query("text").alias("q"))


_WITH_FILTERS = "SELECT item_id AS qid, 'Col:' || (item_id % 3) || ' ' || text || ' tag:a,b tags:c x:1 collection:z' || item_id AS query FROM benchmark"


@register(f"SELECT qid, 'z' || qid AS collection, 'a,b,c' AS tags, '1' AS other, sha256(trim(regexp_replace(regexp_replace(trim(regexp_replace(query, '\\s+', ' ', 'g')), '([\\p{{L}}\\p{{N}}_]+):([^\\s]+)', '', 'g'), '\\s+', ' ', 'g'))) AS rest_sha256 FROM ({_WITH_FILTERS})")
def e2_extract_filters(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.concat(F.lit("Col:"), F.col("item_id") % 3, F.lit(" "), "text", F.lit(" tag:a,b tags:c x:1 collection:z"), "item_id").alias("query"))
    found = query.extract_filters(asked)
    return found.select("qid", F.col("filters")["collection"].alias("collection"), F.array_join("tags", ",").alias("tags"), F.col("filters")["x"].alias("other"), F.sha2("rest", 256).alias("rest_sha256"))


@register(f"WITH {_KEYWORDS} SELECT qid, array_to_string(k, ' ') AS keywords FROM kw")
def e3_keywords(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.array_join(query.keywords("text"), " ").alias("keywords"))


@register(f"WITH {_KEYWORDS} SELECT qid, (1 + (len(k) > 0)::INT)::BIGINT AS n, sha256(b.text || CASE WHEN len(k) > 0 THEN '|' || array_to_string(k, ' ') ELSE '' END) AS rewrites_sha256 FROM kw JOIN benchmark b ON b.item_id = qid")
def e4_rewrite(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text", query.keywords("text").alias("k"))
    return asked.select("qid", query.rewrite("text", "k").alias("r")).select("qid", F.size("r").cast("long").alias("n"), F.sha2(F.array_join("r", "|"), 256).alias("rewrites_sha256"))


@register(f"WITH {_DENSE} SELECT qid, rank, id, score FROM dense")
def f1_dense_top_k(spark, sf_dir):
    return search.dense_top_k(*dense_queries(spark, sf_dir), 20)


@register()
def f2_dense_lsh(spark, sf_dir):
    return search.dense_top_k_lsh(*dense_queries(spark, sf_dir), 20)


def every_fiftieth(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and those whose id is divisible by 50 as queries."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vectors, vectors.where("id % 50 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("qvec"))


_FIFTIETH = _DENSE.replace("SELECT q.item_id AS qid", "SELECT e.vec_id AS qid").replace("FROM benchmark q JOIN embeddings e ON e.vec_id = q.item_id, embeddings v", "FROM embeddings e, embeddings v WHERE e.vec_id % 50 = 0")


@register(f"WITH {_FIFTIETH} SELECT qid, rank, id, score FROM dense")
def f1_dense_every_fiftieth(spark, sf_dir):
    return search.dense_top_k(*every_fiftieth(spark, sf_dir), 20)


def vector_index_of(spark: SparkSession, sf_dir: str) -> vector_index.VectorIndex:
    """The stored cells of the embeddings as they are now; the first query that asks for them writes them."""
    folder = f"{shared_folder(spark)}/vectors-{vector_index.FORMAT}-{content_key(spark, f'{sf_dir}/embeddings.parquet')}"
    return vector_index.open_vector_index(spark, folder) or vector_index.build_vector_index(every_fiftieth(spark, sf_dir)[0], folder)


@register()
def f2_dense_cells(spark, sf_dir):
    return vector_index.approximate_top_k(vector_index_of(spark, sf_dir), every_fiftieth(spark, sf_dir)[1], 20)


@register("SELECT doc_id, n_chars FROM documents WHERE lang = 'en' AND source = 'src1'")
def f3_where(spark, sf_dir):
    return search.filter_results(table(spark, sf_dir, "documents"), lang="en", source="src1").select("doc_id", "n_chars")


@register("SELECT item_id AS pos, (item_id * 37) AS id, n_chars, lang FROM benchmark LEFT JOIN documents ON doc_id = item_id * 37")
def f4_get_by_ids(spark, sf_dir):
    ids = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pos"), (F.col("item_id") * 37).alias("id"))
    return search.get_by_ids(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "n_chars", "lang"), ids).select("pos", "id", "n_chars", "lang")


@register("SELECT doc_id, quality FROM labels WHERE NOT (quality = 0 AND toxic = 0) AND doc_id NOT IN (SELECT item_id FROM benchmark)")
def f5_delete_chunks(spark, sf_dir):
    left = search.delete_where(table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "id"), (F.col("quality") == 0) & (F.col("toxic") == 0))
    return search.delete_by_ids(left, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"))).select(F.col("id").alias("doc_id"), "quality")


@register(f"WITH {_INDEX}, {_ASKED}, {_SPARSE} SELECT qid, rank, id, score, lang, source FROM sparse JOIN documents ON doc_id = id")
def f6_sparse_top_k(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    return search.sparse_top_k(index_of(spark, sf_dir), docs, query_terms(spark, sf_dir), 20).select("qid", "rank", "id", "score", "lang", "source")


def _lists(spark, sf_dir):
    return search.dense_top_k(*dense_queries(spark, sf_dir), 20), bm25.top_k(index_of(spark, sf_dir), query_terms(spark, sf_dir), 20)


_RANKED = "SELECT qid, rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM {}) WHERE rank <= 10"


@register(f"WITH {_INDEX}, {_ASKED}, {_SPARSE}, {_DENSE}, {_FUSED} {_RANKED.format('fused')}")
def f7_rrf(spark, sf_dir):
    return search.rrf(list(_lists(spark, sf_dir)), top=10)


@register(f"WITH {_INDEX}, {_ASKED}, {_SPARSE}, {_DENSE}, w AS (SELECT qid, id, round(sum(part), 6) AS score FROM (SELECT qid, id, 1::double / (60 + rank) AS part FROM dense UNION ALL SELECT qid, id, 1.5::double / (60 + rank) FROM sparse) GROUP BY 1, 2) {_RANKED.format('w')}")
def f8_weighted_rrf(spark, sf_dir):
    return search.rrf(list(_lists(spark, sf_dir)), top=10, weights=[1.0, 1.5])


@register("SELECT item_id, round(1::double / (60 + item_id + 1), 6) AS score FROM benchmark")
def f9_rrf_score(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.round(search.rrf_score(F.col("item_id") + 1), 6).alias("score"))


@register(f"WITH {_INDEX}, {_ASKED}, {_SPARSE}, {_DENSE} SELECT qid, rank, id FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY k, id) AS rank FROM (SELECT qid, id, min(rank * 2 + n) AS k FROM (SELECT qid, id, rank, 0 AS n FROM dense UNION ALL SELECT qid, id, rank, 1 FROM sparse) GROUP BY 1, 2)) WHERE rank <= 10")
def f10_interleave(spark, sf_dir):
    return search.interleave(*_lists(spark, sf_dir), 10)


@register("SELECT doc_id, 'y' AS a, lang AS b, source AS c FROM documents")
def f11_merge_filters(spark, sf_dir):
    merged = search.merge_filters(F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.col("lang")), F.create_map(F.lit("a"), F.lit("y"), F.lit("c"), F.col("source")))
    return table(spark, sf_dir, "documents").select("doc_id", merged.alias("m")).select("doc_id", *(F.col("m")[k].alias(k) for k in "abc"))


@register(f"WITH {_INDEX}, {_ASKED}, {_SPARSE} SELECT qid, rank, id FROM sparse JOIN documents ON doc_id = id WHERE source = 'src3' AND lang = 'en' AND contains(source, 'rc')")
def f12_filter_results(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("collection"), F.col("lang").alias("doc_type"), F.col("source").alias("source_path"))
    hits = search.sparse_top_k(index_of(spark, sf_dir), docs, query_terms(spark, sf_dir), 20)
    return search.filter_results(hits, collection="src3", doc_type="en", source_contains="rc").select("qid", "rank", "id")


_HYBRID = f"{_INDEX}, {_ASKED}, {_SPARSE}, {_DENSE}, paths AS (SELECT qid, id, rank, score, 0 AS p FROM dense UNION ALL SELECT qid, id, rank, score, 1 FROM sparse), np AS (SELECT qid, count(DISTINCT p) AS n FROM paths GROUP BY 1), hy AS (SELECT qid, id, round(sum(CASE WHEN n = 1 THEN score ELSE 1::double / (60 + rank) END), 6) AS score FROM paths JOIN np USING (qid) GROUP BY 1, 2)"


_BEFORE = _SPARSE.replace("FROM qt JOIN posts USING (term)", "FROM qt JOIN posts USING (term) JOIN (SELECT doc_id FROM documents WHERE source = 'src3' AND lang = 'en') f ON f.doc_id = posts.id")


@register(f"WITH {_INDEX}, {_ASKED}, {_BEFORE} SELECT qid, rank, id, score FROM sparse")
def f12_filter_before(spark, sf_dir):
    index, (vectors, _) = index_of(spark, sf_dir), dense_queries(spark, sf_dir)
    fit = search.filter_results(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("collection"), "lang"), collection="src3", lang="en")
    return bm25.top_k(search.within(index, vectors, fit.select("id"))[0], query_terms(spark, sf_dir), 20)


def _hybrid(spark, sf_dir, k: int = 10):
    return search.hybrid_search(index_of(spark, sf_dir), *dense_queries(spark, sf_dir), query_terms(spark, sf_dir), k=k)


@register(f"WITH {_HYBRID} {_RANKED.format('hy')}")
def f13_hybrid_search(spark, sf_dir):
    return _hybrid(spark, sf_dir)


@register(f"WITH {_HYBRID}, r AS ({_RANKED.format('hy')}) SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank, id, score FROM r JOIN documents ON doc_id = id WHERE lang = 'en'")
def f13_hybrid_filtered(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    return search.hybrid_search(index_of(spark, sf_dir), *dense_queries(spark, sf_dir), query_terms(spark, sf_dir), chunks=docs, filters={"lang": "en"})


def _searched(spark, sf_dir):
    """Candidates and trace of the whole search of benchmark texts, reranked by the length of documents, some queries apart."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    asked = asked.join(vectors.select(F.col("id").alias("qid"), F.col("vector").alias("qvec")), "qid", "left")
    sizes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("rerank_score"))
    fetched, shown = search.fetch_size(30, 5, True)
    return search.search_pipeline(index_of(spark, sf_dir), vectors, asked, fetched, scores=lambda c: c.where("qid % 4 <> 0").select("qid", "id").join(sizes, "id"), rerank_k=shown)


_FREE = "(SELECT item_id, regexp_replace(text, '([\\p{L}\\p{N}_]+):([^\\s]+)', '', 'g') AS text FROM benchmark)"
_SEARCHED = f"""{_HYBRID.replace("FROM benchmark))", f"FROM {_FREE}))")}, r AS ({_RANKED.format('hy')}), j AS (SELECT qid, r.id, rank, score, CASE WHEN qid % 4 <> 0 THEN n_chars::DOUBLE END AS v FROM r LEFT JOIN documents ON doc_id = r.id),
fin AS (SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY v DESC NULLS LAST, rank, id) AS rank, id, coalesce(v, score) AS score FROM (SELECT *, bool_or(v IS NOT NULL) OVER (PARTITION BY qid) AS has FROM j) WHERE v IS NOT NULL OR NOT has) WHERE rank <= 5)"""


@register(f"WITH {_SEARCHED} SELECT qid, rank, id, score FROM fin")
def f16_search_pipeline(spark, sf_dir):
    return _searched(spark, sf_dir)[0]


@register(f"WITH {_SEARCHED}, {_KEYWORDS.replace('kw AS', 'kw2 AS')} SELECT item_id AS qid, (1 + (len(k) > 0)::INT)::BIGINT AS n_rewrites, (SELECT count(*) FROM dense d WHERE d.qid = item_id)::BIGINT AS dense_hits, (SELECT count(*) FROM sparse s WHERE s.qid = item_id)::BIGINT AS sparse_hits, (SELECT count(*) FROM r WHERE r.qid = item_id)::BIGINT AS merged_hits, (SELECT count(*) FROM fin WHERE fin.qid = item_id)::BIGINT AS reranked_hits FROM benchmark JOIN kw2 ON kw2.qid = item_id")
def f16_hit_counts(spark, sf_dir):
    counts = ["dense_hits", "sparse_hits", "merged_hits", "reranked_hits"]
    return _searched(spark, sf_dir)[1].select("qid", F.size("rewrites").cast("long").alias("n_rewrites"), *counts)


def _with_formulas(spark, sf_dir):
    """Ten sparse hits of each benchmark text; documents with an even id have their source as a formula, written as JSON."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, F.format_string('[{"id": "%s", "latex": "%s"}]', "source", "source")).alias("formulas"))
    return search.sparse_top_k(index_of(spark, sf_dir), docs.withColumn("formulas", search.parse_formulas("formulas")), query_terms(spark, sf_dir), 10)


_FITS = "(contains(source, 'src1') OR contains('src1', source))"


@register(f"WITH {_INDEX}, {_ASKED}, {_SPARSE} SELECT qid, rank, id FROM sparse JOIN documents ON doc_id = id WHERE rank <= 10 AND (doc_id % 2 <> 0 OR {_FITS})")
def h3_formula_hits(spark, sf_dir):
    return search.formula_hits(_with_formulas(spark, sf_dir), F.lit("SRC1")).select("qid", "rank", "id")


@register(f"WITH {_INDEX}, {_ASKED}, {_SPARSE}, h AS (SELECT qid, rank, id FROM sparse JOIN documents ON doc_id = id WHERE rank <= 10 AND (doc_id % 2 <> 0 OR {_FITS})), p AS (SELECT qid, id, 1::double / (60 + rank) AS part FROM sparse WHERE rank <= 10 UNION ALL SELECT qid, id, 1.5::double / (60 + rank) FROM h), m AS (SELECT qid, id, round(sum(part), 6) AS score FROM p GROUP BY 1, 2) {_RANKED.format('m')}")
def h4_merge_formula_hits(spark, sf_dir):
    hits = _with_formulas(spark, sf_dir)
    return search.merge_formula_hits(hits, search.formula_hits(hits, F.lit("SRC1")))


@register(f"WITH {_INDEX}, {_ASKED}, {_SPARSE} SELECT qid, id, rank FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank FROM sparse JOIN documents ON doc_id = id WHERE rank <= 10 AND doc_id % 2 = 0 AND {_FITS}) WHERE rank <= 5")
def h6_formula_related(spark, sf_dir):
    return search.formula_related(_with_formulas(spark, sf_dir), F.lit("SRC1"), 5).select("qid", "id", "rank")


@register("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 2 WHEN doc_id % 4 = 1 THEN 1 ELSE 0 END::BIGINT AS n, CASE WHEN doc_id % 4 < 2 THEN lang END AS latex FROM documents")
def h2_parse_formulas(spark, sf_dir):
    made = F.format_string('{"id": "%s", "latex": "%s", "page": 3}', "source", "lang")
    cases = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("["), made, F.lit(", "), made, F.lit("]"))).when(F.col("doc_id") % 4 == 1, made).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("{"), made))
    found = table(spark, sf_dir, "documents").select("doc_id", search.parse_formulas(cases).alias("f"))
    return found.select("doc_id", F.size("f").cast("long").alias("n"), F.get("f", 0)["latex"].alias("latex"))


@register(f"WITH {_INDEX}, {_ASKED}, {_SPARSE} SELECT qid, 'sparse' AS stage, count(*)::BIGINT AS n_hits, string_agg(id, ',' ORDER BY rank) AS hits FROM sparse GROUP BY 1")
def l9_trace_rows(spark, sf_dir):
    rows = observe.trace_rows(bm25.top_k(index_of(spark, sf_dir), query_terms(spark, sf_dir), 20), "sparse")
    return rows.withColumn("hits", F.array_join(F.transform("hits", lambda h: h["id"].cast("string")), ","))


@register("SELECT item_id AS qid, CASE WHEN item_id % 40 < 30 AND ('src' || (item_id % 40)) IN (SELECT source FROM documents) THEN 'src' || (item_id % 40) ELSE 'default' END AS collection FROM benchmark")
def f14_resolve_collection(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.when(F.col("item_id") % 40 < 30, F.concat(F.lit("src"), F.col("item_id") % 40)).otherwise("none").alias("collection"))
    return search.resolve_collection(table(spark, sf_dir, "documents").select(F.col("source").alias("collection")), asked)


@register(f"WITH {_HYBRID}, r AS ({_RANKED.format('hy')}) SELECT qid, rank, id, score FROM r WHERE rank <= 5")
def g1_rerank_none(spark, sf_dir):
    return search.rerank_none(_hybrid(spark, sf_dir), 5)


@register(f"""WITH {_HYBRID}, r AS ({_RANKED.format('hy')}), s AS (SELECT doc_id AS id, n_chars::DOUBLE AS v FROM documents), j AS (SELECT qid, r.id, rank, score, CASE WHEN qid % 4 <> 0 THEN v END AS v FROM r JOIN s USING (id))
SELECT qid, k AS rank, id, score AS original_score, v AS rerank_score, v IS NOT NULL AS reranked, v IS NULL AS rerank_fallback FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY v DESC NULLS LAST, rank, id) AS k FROM j) WHERE k <= 5""")
def g2_rerank(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("rerank_score"))
    found = _hybrid(spark, sf_dir).join(docs.select("id"), "id", "left_semi")
    return search.rerank(found, found.where("qid % 4 <> 0").select("qid", "id").join(docs, "id"), 5)


_BEST = f"{_INDEX}, {_ASKED}, {_SPARSE}, best AS (SELECT qid, rank, id, score, text, source, lang FROM sparse JOIN documents ON doc_id = id WHERE rank <= 10)"
_SNIP = "CASE WHEN length(t) <= {n} THEN t ELSE regexp_replace(substring(t, 1, {n}), ' [^ ]*$', '') || '...' END"


def cited(spark, sf_dir):
    """The ten best documents of each benchmark text with citations: the flagship query."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("source_path"), F.lit(None).cast("string").alias("page"))
    return views.citations(search.sparse_top_k(index_of(spark, sf_dir), docs, query_terms(spark, sf_dir), 10))


@register(f"WITH {_BEST}, s AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM best) SELECT qid, rank AS \"index\", id, source, NULL::BIGINT AS page, round(score, 4) AS score, {_SNIP.format(n=200)} AS snippet FROM s")
def i1_citations(spark, sf_dir):
    return cited(spark, sf_dir)


@register(f"SELECT doc_id, {_SNIP.format(n=300)} AS snippet FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)")
def i2_snippet(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.snippet("text", 300).alias("snippet"))


@register(f"WITH {_BEST} SELECT b.item_id AS qid, sha256(b.text || coalesce(m, '')) AS answer_sha256 FROM benchmark b LEFT JOIN (SELECT qid, string_agg('[' || rank || ']', '' ORDER BY rank) || chr(10) || chr(10) || string_agg('[' || rank || '] ' || source, chr(10) ORDER BY rank) AS m FROM best GROUP BY 1) c ON c.qid = b.item_id")
def i3_references(spark, sf_dir):
    answers = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("answer"))
    return views.attach_references(answers, cited(spark, sf_dir), "both").select("qid", F.sha2("answer", 256).alias("answer_sha256"))


@register(f"WITH {_INDEX}, {_ASKED}, {_SPARSE}, {_TRUTH} SELECT b.item_id AS qid, (f IS NOT NULL)::INT::DOUBLE AS hit_rate, round(coalesce(1::double / f, 0), 6) AS mrr FROM benchmark b LEFT JOIN (SELECT qid, min(rank) AS f FROM sparse SEMI JOIN truth USING (qid, id) GROUP BY 1) h ON h.qid = b.item_id")
def k1_hit_mrr(spark, sf_dir):
    found = bm25.top_k(index_of(spark, sf_dir), query_terms(spark, sf_dir), 20)
    return evaluate.hit_mrr(found, truth(spark, sf_dir), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid")))


_EVAL = f"""{_INDEX}, {_ASKED}, {_SPARSE}, {_TRUTH}, top AS (SELECT * FROM sparse WHERE rank <= 10), h AS (SELECT qid, count(DISTINCT id) AS found, min(rank) AS f FROM top SEMI JOIN truth USING (qid, id) GROUP BY 1),
w AS (SELECT qid, count(*) AS e FROM truth GROUP BY 1), m AS (SELECT qid, count(DISTINCT CASE WHEN source IN ('src1', 'src2') THEN source END) AS s, count(*) FILTER (n_chars % 7 = qid % 7) AS p, count(*) FILTER (contains(lower(lang), lower('E'))) AS c FROM top JOIN documents ON doc_id = id GROUP BY 1),
ev AS (SELECT b.item_id AS qid, round(coalesce(coalesce(found, 0) / e, 0), 6) AS recall_at_k, (f IS NOT NULL)::INT::DOUBLE AS hit_at_k, round(coalesce(1::double / f, 0), 6) AS mrr_at_k, coalesce(s, 0)::BIGINT AS source_hits, coalesce(p, 0)::BIGINT AS page_hits, coalesce(c, 0)::BIGINT AS section_hits
FROM benchmark b LEFT JOIN h ON h.qid = b.item_id LEFT JOIN w ON w.qid = b.item_id LEFT JOIN m ON m.qid = b.item_id)"""


def _evaluated(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", (F.col("n_chars") % 7).alias("page"), F.col("lang").alias("section"))
    found = search.sparse_top_k(index_of(spark, sf_dir), docs, query_terms(spark, sf_dir), 20)
    cases = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.array(F.lit("src1"), F.lit("src2")).alias("expected_sources"), (F.col("item_id") % 7).alias("expected_page"), F.lit("E").alias("expected_section"))
    return evaluate.retrieval_eval(found, truth(spark, sf_dir), cases, 10)


@register(f"WITH {_EVAL} SELECT * FROM ev")
def k3_retrieval_eval(spark, sf_dir):
    return _evaluated(spark, sf_dir)


@register(f"WITH {_EVAL} SELECT count(*)::BIGINT AS n_queries, round(avg(recall_at_k), 6) AS avg_recall_at_k, round(avg(hit_at_k), 6) AS avg_hit_at_k, round(avg(mrr_at_k), 6) AS avg_mrr_at_k, sum(source_hits)::BIGINT AS total_source_hits, sum(page_hits)::BIGINT AS total_page_hits, sum(section_hits)::BIGINT AS total_section_hits FROM ev")
def k4_retrieval_summary(spark, sf_dir):
    return evaluate.retrieval_summary(_evaluated(spark, sf_dir))


@register(f"WITH {_EVAL}, l AS (SELECT 'recall_at_k' AS metric, recall_at_k AS value FROM ev UNION ALL SELECT 'mrr_at_k', mrr_at_k FROM ev) SELECT metric, round(avg(value), 6) AS value, count(*)::BIGINT AS n_queries FROM l GROUP BY 1")
def k7_aggregate_metrics(spark, sf_dir):
    return evaluate.aggregate_metrics(evaluate.long_form(_evaluated(spark, sf_dir), ["recall_at_k", "mrr_at_k"]))


@register(f"WITH {_EVAL} SELECT round(avg(hit_at_k), 6) AS avg_hit_at_k, round(avg(mrr_at_k), 6) AS avg_mrr_at_k, coalesce(round(avg(hit_at_k), 6) >= 0.1 AND round(avg(mrr_at_k), 6) >= 0.9, false) AS passed FROM ev")
def k12_gate(spark, sf_dir):
    return evaluate.gate(evaluate.retrieval_summary(_evaluated(spark, sf_dir)), {"avg_hit_at_k": 0.1, "avg_mrr_at_k": 0.9}).select("avg_hit_at_k", "avg_mrr_at_k", "passed")


@register(f"WITH {_INDEX}, {_ASKED}, {_SPARSE}, {_TRUTH}, g AS (SELECT qid, sum(1::double / log2(rank + 1)) AS dcg FROM sparse SEMI JOIN truth USING (qid, id) WHERE rank <= 10 GROUP BY 1), i AS (SELECT qid, list_sum(list_transform(generate_series(1, least(count(*), 10)), lambda x: 1::double / log2(x + 1))) AS ideal FROM truth GROUP BY 1) SELECT b.item_id AS qid, round(coalesce(dcg / ideal, 0), 6) AS ndcg FROM benchmark b LEFT JOIN g ON g.qid = b.item_id LEFT JOIN i ON i.qid = b.item_id")
def k13_ndcg(spark, sf_dir):
    found = bm25.top_k(index_of(spark, sf_dir), query_terms(spark, sf_dir), 20)
    return evaluate.ndcg(found, truth(spark, sf_dir), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid")), 10)


@register(f"WITH {_EVAL} SELECT 'k10' AS config_id, 'recall_at_k' AS metric, round(avg(recall_at_k), 6) AS value FROM ev UNION ALL SELECT 'same', 'mrr_at_k', round(avg(mrr_at_k), 6) FROM ev")
def k11_compare_configs(spark, sf_dir):
    ev = _evaluated(spark, sf_dir)
    return evaluate.compare_configs({"k10": evaluate.long_form(ev, ["recall_at_k"]), "same": evaluate.long_form(ev, ["mrr_at_k"])})


_WHERE = {"$and": [{"lang": {"$in": ["en", "de"]}}, {"$or": [{"n_chars": {"$gte": 1500, "$lt": 4000}}, {"source": {"$ne": "src1"}, "doc_id": {"$lte": 200}}]}, {"source": {"$nin": ["src2", "src3"]}}]}


@register("SELECT doc_id, n_chars FROM documents WHERE lang IN ('en', 'de') AND ((n_chars >= 1500 AND n_chars < 4000) OR (coalesce(source, '') <> 'src1' AND doc_id <= 200)) AND coalesce(source, '') NOT IN ('src2', 'src3')")
def f3_where_object(spark, sf_dir):
    return search.filter_results(table(spark, sf_dir, "documents"), where=_WHERE).select("doc_id", "n_chars")


def _formula_index(spark, sf_dir):
    """Language, source and length of each document as its formulas: most documents share the first."""
    found = F.array(F.concat(F.lit("l="), "lang"), F.concat(F.lit("s="), "source"), F.concat(F.lit("n="), (F.col("n_chars") % 97).cast("string")))
    return table(spark, sf_dir, "documents").select(F.explode(found).alias("formula_id"), F.col("doc_id").alias("id"))


@register(
    "WITH f AS (SELECT DISTINCT * FROM (SELECT unnest(['l=' || lang, 's=' || source, 'n=' || (n_chars % 97)]) AS formula_id, doc_id AS id FROM documents) WHERE formula_id IS NOT NULL), "
    "p AS (SELECT a.id, b.id AS other, count(*)::BIGINT AS shared FROM f a JOIN f b USING (formula_id) WHERE a.id <> b.id AND a.id % 50 = 0 GROUP BY 1, 2) "
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY shared DESC, other) AS rank FROM p) WHERE rank <= 5"
)
def h5_cross_references(spark, sf_dir):
    asked = table(spark, sf_dir, "documents").where("doc_id % 50 = 0").select(F.col("doc_id").alias("id"))
    return search.cross_references(asked, _formula_index(spark, sf_dir), 5, heavy=100)


CONFIGS = [grid.Config("base"), grid.Config("short", k1=0.9, b=0.4), grid.Config("sparse", rrf_k=20, dense=0.3, sparse=1.0), grid.Config("dense", k1=2.0, b=0.75, rrf_k=60, dense=1.0, sparse=0.3)]


def _grid_sql() -> str:
    cs = "cs AS (SELECT * FROM (VALUES " + ", ".join(f"('{c.name}', {c.k1}::DOUBLE, {c.b}::DOUBLE, {c.rrf_k}, {c.dense}::DOUBLE, {c.sparse}::DOUBLE)" for c in CONFIGS) + ") AS t(config_id, k1, b, rk, wd, ws))"
    sp = (
        "gs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY config_id, qid ORDER BY score DESC, id) AS rank FROM (SELECT config_id, qid, posts.id, "
        "round(sum(idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * doc_length / mean))), 6) AS score FROM cs, qt JOIN posts USING (term) JOIN idfs USING (term) JOIN lens ON lens.id = posts.id, st GROUP BY 1, 2, 3)) WHERE rank <= 20)"
    )
    fused = (
        "gf AS (SELECT config_id, qid, id, round(sum(part), 6) AS score FROM (SELECT config_id, qid, id, ws / (rk + rank) AS part FROM gs JOIN cs USING (config_id) "
        "UNION ALL SELECT config_id, qid, id, wd / (rk + rank) FROM dense, cs) GROUP BY 1, 2, 3), "
        "gr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY config_id, qid ORDER BY score DESC, id) AS rank FROM gf) WHERE rank <= 10)"
    )
    value = "gv AS (SELECT config_id, item_id AS qid, coalesce(v, 0) AS value FROM cs, benchmark LEFT JOIN (SELECT config_id AS c2, qid AS q2, 1::DOUBLE / min(rank) AS v FROM gr SEMI JOIN truth USING (qid, id) GROUP BY 1, 2) ON c2 = config_id AND q2 = item_id)"
    pairs = "gp AS (SELECT a.config_id, qid, a.value, a.value - z.value AS d FROM gv a JOIN (SELECT qid, value FROM gv WHERE config_id = 'base') z USING (qid))"
    weight = " + ".join(f"(u >= {cut})::INT" for cut in grid.POISSON)
    runs = (
        "gw AS (SELECT config_id, r, d, " + weight + " AS w FROM (SELECT *, ('0x' || substr(md5('0:' || r || ':' || qid), 1, 4))::INT AS u FROM gp, range(1, 201) t(r))), "
        "gl AS (SELECT config_id, list_sort(list(x)) AS l FROM (SELECT config_id, round(sum(w * d) / sum(w), 6) AS x FROM gw GROUP BY config_id, r HAVING sum(w) > 0) GROUP BY 1)"
    )
    return (
        f"WITH {_INDEX}, {_ASKED}, {_DENSE}, {_TRUTH}, {cs}, {sp}, {fused}, {value}, {pairs}, {runs} SELECT config_id, round(avg(value), 6) AS value, round(avg(d), 6) AS change, "
        "any_value(l[greatest(1, ceil(len(l) * 0.025)::INT)]) AS low, any_value(l[greatest(1, ceil(len(l) * 0.975)::INT)]) AS high, count(*)::BIGINT AS n_queries FROM gp JOIN gl USING (config_id) GROUP BY 1"
    )


@register(_grid_sql())
def k11_config_grid(spark, sf_dir):
    index, (vectors, asked) = index_of(spark, sf_dir), dense_queries(spark, sf_dir)
    found = grid.search_grid(index.hits(query_terms(spark, sf_dir)), search.dense_top_k(vectors, asked, 20), CONFIGS, index.avg_doc_length)
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"))
    return grid.paired_bootstrap(grid.reciprocal_ranks(found, truth(spark, sf_dir), queries, CONFIGS), "base")


@register(f"WITH {_EVAL}, e AS (SELECT count(*)::BIGINT AS n_empty FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM sparse s WHERE s.qid = b.item_id)) SELECT round(avg(hit_at_k), 6) AS avg_hit_at_k, any_value(n_empty) AS n_empty, round(avg(hit_at_k), 6) >= 0.1 AND any_value(n_empty) = 0 AS passed FROM ev, e")
def k12_gate_with_empty(spark, sf_dir):
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"))
    found = bm25.top_k(index_of(spark, sf_dir), query_terms(spark, sf_dir), 20)
    return evaluate.gate(evaluate.retrieval_summary(_evaluated(spark, sf_dir)), {"avg_hit_at_k": 0.1}, queries, found).select("avg_hit_at_k", "n_empty", "passed")
