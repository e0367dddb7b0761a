"""Citations, document and collection views, and document management."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import snippet


def citations(results: DataFrame, length: int = 200) -> DataFrame:
    """(qid, index, id, source, page, score, snippet) of results (qid, rank, id, score, source_path, page, text)."""
    index = F.row_number().over(Window.partitionBy("qid").orderBy("rank", "id")).cast("long")
    return results.select("qid", index.alias("index"), "id", F.coalesce("source_path", F.lit("unknown")).alias("source"), F.col("page").try_cast("long").alias("page"), F.round("score", 4).alias("score"), snippet("text", length).alias("snippet"))


def attach_references(answers: DataFrame, cited: DataFrame, style: str = "inline") -> DataFrame:
    """answers (qid, answer) with "[1][2]" behind them, a list of sources below, or both."""
    if style not in ("inline", "text", "both"):
        raise ValueError("style is inline, text or both")
    listed = cited.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("index", "source"))).alias("c"))
    marks = F.array_join(F.transform("c", lambda x: F.format_string("[%d]", x["index"])), "")
    lines = F.array_join(F.transform("c", lambda x: F.format_string("[%d] %s", x["index"], x["source"])), "\n")
    tail = {"inline": marks, "text": F.concat(F.lit("\n\n"), lines), "both": F.concat(marks, F.lit("\n\n"), lines)}[style]
    return answers.join(listed, "qid", "left").select("qid", F.concat("answer", F.coalesce(tail, F.lit(""))).alias("answer"))


def document_summaries(chunks: DataFrame, most: int = 500) -> DataFrame:
    """(source_ref, title, summary, tags, n_chunks) from chunks (source_ref, chunk_index, text, title, summary, doc_type, tags).

    The title is the first chunk's title, else its first heading, else its first line, else the reference itself. The
    summary is the first one that is not empty, else the start of the first chunk's lines that are no headings.
    """
    body = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~x.rlike(r"^\s*#") & (F.trim(x) != "")), " ")
    parts = chunks.groupBy("source_ref").agg(
        F.min_by(F.struct(F.nullif(F.nullif(F.trim("title"), F.lit("")), F.lit("Untitled")).alias("t"), F.nullif(F.regexp_extract("text", r"(?m)^#{1,6}\s+(.+)$", 1), F.lit("")).alias("h"), F.nullif(F.trim(F.get(F.split("text", "\n"), 0)), F.lit("")).alias("l"), body.alias("b")), "chunk_index").alias("f"),
        F.min_by("summary", F.when(F.trim(F.coalesce("summary", F.lit(""))) != "", F.col("chunk_index"))).alias("s"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"), F.upper(F.max("doc_type")).alias("kind"), F.count("*").alias("n_chunks"),
    )
    return parts.select("source_ref", F.coalesce("f.t", "f.h", "f.l", "source_ref").alias("title"), F.coalesce("s", F.col("f.b").substr(1, most)).alias("summary"), F.array_compact(F.array_append("tags", F.col("kind"))).alias("tags"), "n_chunks")


def list_collections(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("collection").agg(F.count("*").alias("n_chunks")).orderBy("collection")


def result_images(results: DataFrame, most: int = 5) -> DataFrame:
    """(qid, image_id): distinct images over each result set, up to `most` of each result; from metadata, else placeholders."""
    marked = F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\[IMAGE:\s*([^\]]+)\]"), 1), lambda x: F.trim(x))
    own = F.transform("images", lambda i: i["id"]) if "images" in results.columns else F.lit(None).cast("array<string>")
    ids = F.slice(F.when(F.size(F.coalesce(own, F.array().cast("array<string>"))) > 0, own).otherwise(marked), 1, most)
    return results.select("qid", F.explode(ids).alias("image_id")).dropDuplicates(["qid", "image_id"])


def list_documents(history: DataFrame, chunks: DataFrame, images: DataFrame) -> DataFrame:
    """History with the number of chunks and images of each file_hash; 0 where there are none."""
    counted = lambda df, name: df.groupBy("file_hash").agg(F.count("*").alias(name))
    joined = history.join(counted(chunks, "n_chunks"), "file_hash", "left").join(counted(images, "n_images"), "file_hash", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_chunks", "n_images")})


def document_detail(documents: DataFrame, chunks: DataFrame, images: DataFrame) -> DataFrame:
    """documents (file_hash, ...) with sorted chunk_ids and image_ids."""
    ids = lambda df, c, name: df.groupBy("file_hash").agg(F.array_sort(F.collect_list(c)).alias(name))
    return documents.join(ids(chunks, "id", "chunk_ids"), "file_hash", "left").join(ids(images, "image_id", "image_ids"), "file_hash", "left")


def delete_documents(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Each table without the documents of gone (file_hash, and whatever other keys the tables use), and rows deleted per table.

    tables: name to (frame, key column); gone must have that column.
    """
    kept, counts = {}, []
    for name, (frame, key) in tables.items():
        ids = gone.select(key).distinct()
        kept[name] = frame.join(ids, key, "left_anti")
        counts.append(frame.join(ids, key, "left_semi").agg(F.count("*").alias("n_deleted")).select(F.lit(name).alias("store"), "n_deleted"))
    return kept, reduce(DataFrame.unionByName, counts)


def collection_stats(docs: DataFrame) -> DataFrame:
    """Documents and characters per collection, and in total (collection null)."""
    return docs.rollup("collection").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"))


def latest_images(images: DataFrame) -> DataFrame:
    """One row per image_id, the one written last; ties fall by path."""
    order = Window.partitionBy("image_id").orderBy(F.desc("created_at"), F.desc("file_path"))
    return images.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def image_totals(images: DataFrame) -> DataFrame:
    return images.groupBy("collection").agg(F.count("*").alias("n_images"), F.sum("bytes").alias("bytes"))


def pattern_audit(texts: DataFrame, patterns: dict[str, str], text: str = "text") -> DataFrame:
    """(pattern, n_rows, n_matches) over all texts, in one pass."""
    hits = F.array(*(F.struct(F.lit(n).alias("pattern"), F.regexp_count(F.col(text), F.lit(p)).cast("long").alias("n")) for n, p in patterns.items()))
    return texts.select(F.explode(hits).alias("h")).groupBy("h.pattern").agg(F.count_if(F.col("h.n") > 0).alias("n_rows"), F.sum("h.n").alias("n_matches"))


def document_chunks(chunks: DataFrame, condition: Column) -> DataFrame:
    return chunks.where(condition).orderBy("chunk_index")
