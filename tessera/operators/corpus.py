"""Row-level preparation of documents and chunks, and the history of what was ingested."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import plain_latex


def validate(df: DataFrame, id_col: str = "id", path_col: str = "source_path", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Good rows, and rejected rows with their reason."""
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    reason = F.when(blank(id_col), "empty id").when(blank(path_col), "missing source_path").when(blank(text_col), "blank text")
    marked = df.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def with_file_hash(df: DataFrame, content: str = "content") -> DataFrame:
    return df.withColumn("file_hash", F.sha2(F.col(content), 256))


def pending_files(files: DataFrame, history: DataFrame, force: bool = False) -> DataFrame:
    """Files whose hash has no successful run."""
    return files if force else files.join(history.where("status = 'success'").select("file_hash"), "file_hash", "left_anti")


def merge_history(history: DataFrame, events: DataFrame) -> DataFrame:
    """One row per file_hash: the first processed_at, the latest state; success clears the error, failure keeps the collection.

    Both: file_hash, file_path, status, collection, error_msg, processed_at, updated_at. Ties fall by status and path.
    """
    rows = history.unionByName(events)
    order = F.struct("updated_at", "status", "file_path")
    merged = rows.groupBy("file_hash").agg(
        F.max_by("file_path", order).alias("file_path"),
        F.max_by("status", order).alias("status"),
        F.coalesce(F.max_by("collection", F.when(F.col("status") == "success", order)), F.max_by("collection", order)).alias("collection"),
        F.max_by(F.when(F.col("status") == "success", F.lit("")).otherwise(F.coalesce("error_msg", F.lit(""))), order).alias("error_msg"),
        F.min("processed_at").alias("processed_at"),
        F.max("updated_at").alias("updated_at"),
    )
    return merged.withColumn("error_msg", F.nullif("error_msg", F.lit("")))


def list_processed(history: DataFrame, collection: str | None = None) -> DataFrame:
    done = history.where("status = 'success'")
    return (done.where(F.col("collection") == collection) if collection is not None else done).orderBy("processed_at")


def remove_history(history: DataFrame, hashes: DataFrame) -> DataFrame:
    return history.join(hashes, "file_hash", "left_anti")


#: Patterns of table-of-contents lines and the level each stands for.
TOC = ((r"^第[一二三四五六七八九十百千\d]+[章篇部]\s*(.*)$", 1), (r"^第[一二三四五六七八九十百千\d]+节\s*(.*)$", 2), (r"^Chapter\s+\d+\s*(.*)$", 1), (r"^(?:Section|Article)\s+\d+[.\d]*\s*(.*)$", 2))


def toc_entries(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds toc_title and toc_level to lines that look like entries of a table of contents; others go."""
    t = F.trim(F.col(line))
    numbered = F.regexp_extract(t, r"^((?:\d+\.)+\d*)\s+(\S.*)$", 1)
    level, title = F.lit(None).cast("long"), F.lit(None).cast("string")
    for pattern, depth in reversed(TOC):
        level, title = F.when(t.rlike(pattern), depth).otherwise(level), F.when(t.rlike(pattern), F.regexp_extract(t, pattern, 1)).otherwise(title)
    depth = F.size(F.filter(F.split(numbered, r"\."), lambda x: x != ""))
    level = F.when(numbered != "", depth).otherwise(level).cast("long")
    title = F.when(numbered != "", F.regexp_extract(t, r"^((?:\d+\.)+\d*)\s+(\S.*)$", 2)).otherwise(title)
    return lines.withColumns({"toc_title": F.trim(title), "toc_level": level}).where("toc_level is not null")


def apply_enrichment(chunks: DataFrame, responses: DataFrame) -> DataFrame:
    """title, summary, tags and enriched_by from model responses (id, response); rules' values where there is none.

    chunks has rule_title, rule_summary and rule_tags (array).
    """
    r = F.col("response")
    joined = chunks.join(responses, "id", "left")
    part = lambda name, after: F.trim(F.regexp_extract(r, rf"(?is){name}:\s*(.*?)(?:\n\s*(?:{after}):|\z)", 1))
    title, summary, tags = part("Title", "Summary|Tags"), part("Summary", "Tags|Title"), part("Tags", "Title|Summary")
    failed = r.isNull() | (F.trim(r) == "")
    listed = F.filter(F.transform(F.split(tags, ","), lambda x: F.trim(x)), lambda x: x != "")
    return joined.withColumns({
        "title": F.when(failed, F.col("rule_title")).when(title == "", F.lit("Untitled")).otherwise(title),
        "summary": F.when(failed, F.col("rule_summary")).when(summary == "", F.col("text").substr(1, 500)).otherwise(summary),
        "tags": F.when(failed, F.col("rule_tags")).otherwise(listed),
        "enriched_by": F.when(failed, "rules").otherwise("model"),
        "enrich_fallback_reason": F.when(failed, "no response"),
    }).drop("response")


_IMAGE = r"\[IMAGE:\s*([^\]]+)\]"


def chunk_images(chunks: DataFrame) -> DataFrame:
    """Adds image_refs, the images (array of struct with id, path, page) referred to, in order, and page_num of the first."""
    refs = F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_IMAGE), 1), lambda x: F.trim(x))
    with_refs = chunks.withColumn("image_refs", refs)
    found = F.flatten(F.transform("image_refs", lambda r: F.filter("images", lambda i: i["id"] == r)))
    return with_refs.withColumn("chunk_images", found).withColumn("page_num", F.get(F.col("chunk_images"), 0)["page"])


def images_to_caption(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.explode("chunk_images").alias("i")).select("i.id", "i.path").where("path is not null").dropDuplicates(["id"])


def stitch_captions(chunks: DataFrame, captions: DataFrame) -> DataFrame:
    """Appends "(Description: ...)" to each placeholder and collects image_captions; captions is (image_id, caption)."""
    refs = chunks.select("id", F.posexplode("image_refs").alias("at", "image_id"))
    listed = refs.join(captions, "image_id").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "image_id", "caption"))).alias("c"))
    joined = chunks.join(listed, "id", "left").withColumn("c", F.coalesce("c", F.expr("cast(array() as array<struct<at:int,image_id:string,caption:string>>)")))
    once = F.filter("c", lambda x, i: ~F.exists(F.slice("c", 1, i), lambda o: o["image_id"] == x["image_id"]))
    mark = lambda x: F.concat(F.lit("[IMAGE: "), x["image_id"], F.lit("]"))
    text = F.aggregate(once, F.col("text"), lambda t, x: F.replace(t, mark(x), F.concat(mark(x), F.lit("\n(Description: "), x["caption"], F.lit(")"))))
    return joined.withColumn("image_captions", F.transform("c", lambda x: F.struct(x["image_id"].alias("image_id"), x["caption"].alias("caption")))).withColumn("text", text).drop("c")


def attach_formulas(chunks: DataFrame, formulas: DataFrame, near: float = 50.0) -> DataFrame:
    """(id, formula_id, latex, proximity): formulas of the chunk's document and page, of all pages if its page is unknown.

    chunks: id, source_path, page, top; formulas: source_path, page, idx, latex, top. proximity falls from 1 with the
    distance of the tops and is 0.5 if one is unknown.
    """
    name = F.concat(F.lit("formula_"), F.md5(F.concat_ws("_", "source_path", "page", "idx", F.col("latex").substr(1, 50))).substr(1, 12))
    f = formulas.select("source_path", F.col("page").alias("f_page"), "latex", F.col("top").alias("f_top"), name.alias("formula_id"))
    known = chunks.where("page is not null").join(f.withColumn("page", F.col("f_page")), ["source_path", "page"])
    other = chunks.where("page is null").join(f, "source_path")
    distance = F.abs(F.col("top") - F.col("f_top"))
    proximity = F.when(distance.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), 1 - distance / near))
    cols = ["id", "formula_id", "latex", proximity.alias("proximity")]
    return known.select(*cols).unionByName(other.select(*cols))


def formula_index(attached: DataFrame) -> DataFrame:
    """(formula_id, ids): the sorted chunks of each formula."""
    return attached.groupBy("formula_id").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def flatten_metadata(metadata: Column) -> Column:
    """A map<string,string> of a struct: scalars as text, nested values as JSON, nulls dropped."""
    return F.map_filter(F.from_json(F.to_json(metadata), "map<string,string>"), lambda k, v: v.isNotNull())


def dense_text(df: DataFrame) -> Column:
    """Text, image captions, formulas, title (unless Untitled) and summary, a blank line between."""
    some = lambda c, lead: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.concat(F.lit(lead), c))
    have = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    joined = lambda c: F.array_join(c, "; ") if c in df.columns else F.lit(None).cast("string")
    return F.concat_ws("\n\n", F.col("text"), some(joined("captions"), "Images: "), some(joined("latex"), "Formulas: "), F.when(have("title") != "Untitled", some(have("title"), "Title: ")), some(have("summary"), "Summary: "))


def sparse_text(df: DataFrame) -> Column:
    """Text, captions, plain words of formulas, title and summary, a space between."""
    have = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    captions = F.array_join("captions", " ") if "captions" in df.columns else F.lit(None).cast("string")
    latex = F.array_join(F.transform("latex", plain_latex), " ") if "latex" in df.columns else F.lit(None).cast("string")
    return F.concat_ws(" ", F.col("text"), captions, latex, have("title"), have("summary"))


def embed(df: DataFrame, model: Callable[[list[str]], list[list[float]]], text: str = "text", batch: int = 100) -> DataFrame:
    """df with a vector for each text, by a user's model in batches; the model must return one vector per text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            vectors = []
            for lo in range(0, len(b), batch):
                part = b[text].iloc[lo : lo + batch].tolist()
                got = model(part)
                if len(got) != len(part):
                    raise ValueError(f"{len(part)} texts, {len(got)} vectors")
                vectors += got
            yield b.assign(vector=vectors)

    return df.mapInPandas(run, ", ".join([*(f"`{n}` {t}" for n, t in df.dtypes), "vector array<float>"]))


def check_vectors(df: DataFrame, vector: str = "vector") -> DataFrame:
    """One row: rows, null or empty vectors, and how many different sizes."""
    v = F.col(vector)
    return df.agg(F.count("*").alias("n_vectors"), F.count_if(v.isNull() | (F.size(v) <= 0)).alias("n_empty"), F.count_distinct(F.size(v)).alias("n_sizes"))


def ingest_report(results: DataFrame) -> DataFrame:
    """One row from (status, chunks, images, chars): files, ok, failed, skipped, chunks, images, mean chunk size."""
    of = lambda s: F.count_if(F.col("status") == s)
    return results.agg(
        F.count("*").alias("files"), of("success").alias("ok"), of("failed").alias("failed"), of("skipped").alias("skipped"),
        F.sum("chunks").alias("chunks"), F.sum("images").alias("images"), F.round(F.sum("chars") / F.sum("chunks"), 6).alias("mean_chunk"),
    )


def rows_to_text(rows: DataFrame, most: int = 100) -> DataFrame:
    """(sheet, text) from (sheet, row_no, cells array): cells joined by bars, empty rows dropped, the rest counted."""
    line = F.array_join(F.transform("cells", lambda c: F.coalesce(c, F.lit(""))), " | ")
    kept = rows.where(F.exists("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")).withColumn("line", line)
    placed = kept.withColumn("n", F.row_number().over(Window.partitionBy("sheet").orderBy("row_no")))
    shown = placed.groupBy("sheet").agg(F.array_sort(F.collect_list(F.when(F.col("n") <= most, F.struct("n", "line")))).alias("l"), F.count("*").alias("total"))
    body = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    return shown.select("sheet", F.when(F.col("total") > most, F.concat(body, F.format_string("\n... (%d more rows)", F.col("total") - most))).otherwise(body).alias("text"))


def rows_to_markdown(rows: DataFrame) -> DataFrame:
    """(table_id, markdown) from (table_id, row_no, cells array); the first row is the header."""
    line = F.concat(F.lit("| "), F.array_join(F.transform("cells", lambda c: F.coalesce(c, F.lit(""))), " | "), F.lit(" |"))
    first = F.row_number().over(Window.partitionBy("table_id").orderBy("row_no")) == 1
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.size("cells")), " | "), F.lit(" |"))
    lines = rows.withColumn("line", F.when(first, F.concat(line, F.lit("\n"), rule)).otherwise(line))
    listed = lines.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("row_no", "line"))).alias("l"))
    return listed.select("table_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("markdown"))


def sectionize(paragraphs: DataFrame) -> DataFrame:
    """(doc, section, title, text) from (doc, pos, text, style): a heading opens a section.

    A heading has a heading style, or is short, does not end a sentence, and has mostly capitalised words.
    """
    words = F.split(F.trim("text"), r"\s+")
    capital = F.size(F.filter(words, lambda w: w.rlike(r"^[A-Z]"))) / F.size(words)
    heading = F.coalesce(F.col("style").ilike("heading%"), F.lit(False)) | ((F.length("text") < 80) & ~F.trim("text").rlike(r"[.!?;:,]$") & (capital > 0.5))
    order = Window.partitionBy("doc").orderBy("pos")
    marked = paragraphs.where(F.trim("text") != "").withColumn("heading", heading).withColumn("section", F.sum(F.col("heading").cast("long")).over(order))
    parts = marked.groupBy("doc", "section").agg(F.min_by(F.when(F.col("heading"), F.trim("text")), "pos").alias("title"), F.array_sort(F.collect_list(F.when(~F.col("heading"), F.struct("pos", "text")))).alias("l"))
    return parts.select("doc", "section", "title", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("text"))
