"""Term statistics, BM25 tables and scoring.

counted() cuts each text into terms once and counts them within its row, so no occurrence is ever shuffled. Its rows give
postings(id, term, tf, doc_length), the one large table, and lengths(id, doc_length); terms(term, df, idf) and the corpus
totals follow. A posting knows its text's length, so scoring joins postings with the terms asked for and nothing else.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens

K1, B = 1.5, 0.75


def counted(chunks: DataFrame, id_col: str, text_col: str, min_len: int = 2) -> DataFrame:
    """(id, doc_length, counts: array of (term, tf)) of every chunk; an id names one chunk.

    Sorted terms are counted by where each run of equal ones starts. No loop looks into another column, so that nothing
    is worked out again for each element, however Catalyst merges the steps.
    """
    found = chunks.select(F.col(id_col).alias("id"), F.sort_array(tokens(text_col, min_len)).alias("t"))
    starts = F.expr("filter(transform(zip_with(t, slice(concat(array(cast(null as string)), t), 1, size(t)), (x, y) -> not (x <=> y)), (new, i) -> if(new, i, null)), p -> p is not null)")
    found = found.withColumn("at", starts)
    tf = "zip_with(at, concat(slice(at, 2, size(at)), array(size(t))), (lo, hi) -> cast(hi - lo as long))"
    counts = F.expr(f"filter(zip_with(array_distinct(t), {tf}, (term, tf) -> struct(term as term, tf as tf)), c -> c.term is not null)")
    return found.select("id", F.size("t").cast("long").alias("doc_length"), counts.alias("counts"))


def postings(chunks: DataFrame, id_col: str, text_col: str, min_len: int = 2) -> DataFrame:
    """(id, term, tf, doc_length)."""
    return postings_of(counted(chunks, id_col, text_col, min_len))


def postings_of(rows: DataFrame) -> DataFrame:
    """The postings of counted rows; the outer form, for the inner one has Catalyst count all terms beforehand as a filter."""
    return rows.select("id", F.inline_outer("counts"), "doc_length").where("term is not null")


def lengths(chunks: DataFrame, id_col: str, text_col: str, min_len: int = 2) -> DataFrame:
    """(id, doc_length, unique_terms) of every chunk, those without terms too."""
    return lengths_of(counted(chunks, id_col, text_col, min_len))


def lengths_of(rows: DataFrame) -> DataFrame:
    return rows.select("id", "doc_length", F.size("counts").cast("long").alias("unique_terms"))


def corpus_stats(posts: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row: num_docs, avg_doc_length, total_terms; zeros for an empty corpus."""
    docs = sizes.agg(F.count("*").alias("num_docs"), F.coalesce(F.avg("doc_length"), F.lit(0.0)).alias("avg_doc_length"))
    return docs.crossJoin(posts.agg(F.count_distinct("term").alias("total_terms")))  # one row each


def corpus_stats_of(rows: DataFrame) -> DataFrame:
    """As corpus_stats, of counted rows in one pass: a chunk's length travels with its first term, or alone where it has none."""
    terms = rows.select("doc_length", F.posexplode_outer("counts.term").alias("at", "term"))
    first = F.coalesce("at", F.lit(0)) == 0
    by_term = terms.groupBy("term").agg(F.count(F.when(first, 1)).alias("docs"), F.coalesce(F.sum(F.when(first, F.col("doc_length"))), F.lit(0)).alias("length"))
    total = by_term.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("num_docs"), F.sum("length").alias("length"), F.count("term").alias("total_terms"))
    return total.select("num_docs", F.coalesce(F.try_divide(F.col("length").cast("double"), "num_docs"), F.lit(0.0)).alias("avg_doc_length"), "total_terms")


def idf(n: Column, df: Column) -> Column:
    """May be negative; there is no floor."""
    return F.log((n - df + 0.5) / (df + 0.5))


@dataclass
class Index:
    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame
    avg_doc_length: float
    k1: float = K1
    b: float = B

    def within(self, ids: DataFrame) -> Index:
        """The chunks in ids(id) alone; terms keep the weights of the whole corpus."""
        return replace(self, postings=self.postings.join(ids, "id", "left_semi"))

    def search(self, query_terms: DataFrame, k: int = 20) -> DataFrame:
        """(qid, rank, id, score) of the k best chunks per query.

        query_terms: (qid, term); a term counts as often as it is listed. Ties on six digits fall by id.
        """
        wanted = query_terms.groupBy("qid", "term").agg(F.count("*").alias("times"))
        tf, size = F.col("tf"), F.col("doc_length") / F.lit(self.avg_doc_length or 1.0)
        part = F.col("times") * F.col("idf") * tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * size))
        hits = self.postings.join(wanted.join(self.terms, "term"), "term")
        scored = hits.groupBy("qid", "id").agg(F.round(F.sum(part), 6).alias("score"))
        return ranked(scored, k)


def build(posts: DataFrame, sizes: DataFrame, k1: float = K1, b: float = B) -> Index:
    if k1 <= 0 or not 0 <= b <= 1:
        raise ValueError("k1 must be positive and b between 0 and 1")
    n, mean = sizes.agg(F.count("*"), F.avg("doc_length")).first()
    terms = posts.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", idf(F.lit(float(n)), F.col("df")))
    return Index(posts, sizes, terms, float(mean or 1.0), k1, b)


def top_k(index: Index, query_terms: DataFrame, k: int = 20) -> DataFrame:
    """The k best chunks per query, as Index.search gives them."""
    return index.search(query_terms, k)


def ranked(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("qid", "rank", "id", "score")


def remove_documents(posts: DataFrame, sizes: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings and lengths without the chunks listed in gone(id)."""
    return posts.join(gone, "id", "left_anti"), sizes.join(gone, "id", "left_anti")


def add_documents(posts: DataFrame, sizes: DataFrame, new_posts: DataFrame, new_sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings and lengths with new chunks, which replace those of the same ids."""
    ids = new_sizes.select("id")
    old_posts, old_sizes = remove_documents(posts, sizes, ids)
    return old_posts.unionByName(new_posts), old_sizes.unionByName(new_sizes)


def top_terms(posts: DataFrame, n: int = 10) -> DataFrame:
    order = Window.partitionBy("id").orderBy(F.desc("tf"), "term")
    return posts.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n).select("id", "term", "tf", "rank")


def check_term_stats(stats: DataFrame) -> DataFrame:
    """Rows of (id, tf, doc_length) with a reason if they are unusable, null if they are fine."""
    reason = F.when(F.col("id").isNull(), "missing id").when(F.col("doc_length").isNull(), "missing doc_length").when(F.col("doc_length") < 0, "negative doc_length").when(F.col("tf") <= 0, "bad frequency")
    return stats.withColumn("reason", reason)
