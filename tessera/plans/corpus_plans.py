"""Registered queries over documents, pages, labels and events, with their SQL: preparation, chunks, views, traces, memory, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, corpus, evaluate, observe, views
from ..sources import readers
from ..streaming import jobs
from .search_plans import table

Q, SQL = {}, {}


def register(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def chunks_of(spark, sf_dir) -> DataFrame:
    """Windows of all documents as (id, chunk_index, char_start, char_end, text)."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return chunking.chunk_window(docs, 500, 50)


_WIN = "win AS (SELECT doc_id AS id, k::BIGINT AS chunk_index, (k * 450)::BIGINT AS char_start, least(k * 450 + 500, length(text))::BIGINT AS char_end, substring(text, k * 450 + 1, 500) AS text FROM (SELECT doc_id, text, unnest(generate_series(0, (length(text) - 1) // 450)) AS k FROM documents WHERE length(text) > 0))"
_CHUNK_ID = "printf('%s_%04d_%s', doc_id, k, substring(sha256(text), 1, 8))"


@register("SELECT doc_id, sha256(text) AS file_hash FROM documents")
def a2_file_hash(spark, sf_dir):
    return corpus.with_file_hash(table(spark, sf_dir, "documents"), "text").select("doc_id", "file_hash")


@register("SELECT doc_id, text, 'new' AS lang FROM documents WHERE doc_id % 10 = 0 UNION ALL SELECT doc_id, text, lang FROM documents WHERE doc_id % 10 <> 0")
def a8_upsert_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    return readers.upsert_chunks(docs, docs.where("id % 10 = 0").withColumn("lang", F.lit("new"))).select(F.col("id").alias("doc_id"), "text", "lang")


@register("SELECT doc_id AS qid, quality::DOUBLE AS quality, CASE WHEN toxic = 1 THEN 1::DOUBLE END AS toxic FROM labels")
def a10_report(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    rows = labels.select(F.col("doc_id").alias("qid"), F.lit("quality").alias("metric"), F.col("quality").cast("double").alias("value"))
    return readers.report(rows.unionByName(labels.where("toxic = 1").select(F.col("doc_id").alias("qid"), F.lit("toxic").alias("metric"), F.lit(1.0).alias("value"))))


@register("SELECT event_id AS run_id, ts AS timestamp, value FROM events ORDER BY ts DESC, event_id LIMIT 10")
def a11_recent_runs(spark, sf_dir):
    return readers.recent_runs(table(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), F.col("ts").alias("timestamp"), "value"), 10)


@register("SELECT coalesce(reason, 'good') AS reason, count(*)::BIGINT AS n FROM (SELECT CASE WHEN source = 'src4' THEN 'missing source_path' WHEN length(text) < 200 THEN 'blank text' END AS reason FROM documents) GROUP BY 1")
def b1_validate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("source") != "src4", F.col("source")).alias("source_path"), F.when(F.length("text") >= 200, F.col("text")).otherwise("  ").alias("text"))
    good, bad = corpus.validate(docs, "doc_id")
    return good.select(F.lit("good").alias("reason")).unionByName(bad.select("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def _events(spark, sf_dir) -> DataFrame:
    """Events as ingestion runs: a file per user, status by type."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("h"), "user_id").alias("file_hash"), F.concat(F.lit("/p/"), F.col("event_id") % 3).alias("file_path"), F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"),
        F.concat(F.lit("c"), F.col("event_id") % 4).alias("collection"), F.when(F.col("event_type") == "error", F.col("props")).alias("error_msg"), F.col("ts").alias("processed_at"), F.col("ts").alias("updated_at"),
    )


_RUNS = "runs AS (SELECT 'h' || user_id AS file_hash, '/p/' || (event_id % 3) AS file_path, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status, 'c' || (event_id % 4) AS collection, CASE WHEN event_type = 'error' THEN props END AS error_msg, ts AS processed_at, ts AS updated_at FROM events)"


@register("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT user_id FROM events WHERE event_type <> 'error')")
def b2_pending_files(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("h"), "doc_id").alias("file_hash"))
    return corpus.pending_files(files, _events(spark, sf_dir)).select("doc_id")


@register(f"""WITH {_RUNS}, n AS (SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY updated_at DESC, status DESC, file_path DESC) AS k, min(processed_at) OVER (PARTITION BY file_hash) AS first FROM runs),
s AS (SELECT file_hash, collection FROM (SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY updated_at DESC, status DESC, file_path DESC) AS k FROM runs WHERE status = 'success') WHERE k = 1)
SELECT n.file_hash, file_path, status, coalesce(s.collection, n.collection) AS collection, error_msg, first AS processed_at, updated_at FROM n LEFT JOIN s USING (file_hash) WHERE k = 1""")
def b3_merge_history(spark, sf_dir):
    e = _events(spark, sf_dir)
    return corpus.merge_history(e.where("processed_at < '2024-01-15'"), e.where("processed_at >= '2024-01-15'"))


@register(f"WITH {_RUNS} SELECT file_hash, file_path, processed_at FROM runs WHERE status = 'success' AND collection = 'c1'")
def b4_list_processed(spark, sf_dir):
    return corpus.list_processed(_events(spark, sf_dir), "c1").select("file_hash", "file_path", "processed_at")


@register(f"WITH {_RUNS} SELECT file_hash, count(*)::BIGINT AS n FROM runs WHERE file_hash NOT IN (SELECT 'h' || item_id FROM benchmark) GROUP BY 1")
def b5_remove_history(spark, sf_dir):
    gone = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("h"), "item_id").alias("file_hash"))
    return corpus.remove_history(_events(spark, sf_dir), gone).groupBy("file_hash").agg(F.count("*").alias("n"))


@register("SELECT doc_id, coalesce(trim(substring(list_filter(list_slice(string_split(text, chr(10)), 1, 20), lambda x: starts_with(trim(x), '# '))[1], 3)), trim(list_filter(list_slice(string_split(text, chr(10)), 1, 10), lambda x: trim(x) <> '')[1])) AS title FROM documents")
def b6_doc_title(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.doc_title("text").alias("title"))


@register("SELECT doc_id, 'doc_' || substring(sha256(text), 1, 16) AS id FROM documents")
def b7_doc_id(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.doc_id("text").alias("id"))


@register("SELECT doc_id, n AS line_no, trim(regexp_extract(line, '^((?:\\d+\\.)+\\d*)\\s+(\\S.*)$', 2)) AS toc_title, len(list_filter(string_split(regexp_extract(line, '^((?:\\d+\\.)+\\d*)\\s+(\\S.*)$', 1), '.'), lambda x: x <> ''))::BIGINT AS toc_level FROM (SELECT doc_id, (i - 1)::BIGINT AS n, CASE WHEN i % 5 = 1 THEN '1.' || i || '. ' || l ELSE l END AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)) WHERE regexp_matches(line, '^(?:\\d+\\.)+\\d*\\s+\\S')")
def b8_toc_entries(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "l"))
    numbered = F.when(F.col("line_no") % 5 == 0, F.concat(F.lit("1."), F.col("line_no") + 1, F.lit(". "), "l")).otherwise(F.col("l"))
    return corpus.toc_entries(lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), numbered.alias("line"))).select("doc_id", "line_no", "toc_title", "toc_level")


_REFINED = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<[^>]+>', '', 'g'), ' {2,}', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '[ \\t]+(\\n|$)', '\\1', 'g'), chr(10) || chr(9) || ' ')"


@register(f"SELECT page_id, length({_REFINED})::BIGINT AS n_chars, sha256({_REFINED}) AS refined_sha256 FROM pages")
def b9_refine(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.refine("html").alias("t")).select("page_id", F.length("t").cast("long").alias("n_chars"), F.sha2("t", 256).alias("refined_sha256"))


_FIRST = "trim(string_split(text, chr(10))[1])"
_SENT = "regexp_replace(trim(regexp_split_to_array(text, '[.!?]\\s+')[1]), '[.!?]+$', '')"


@register(f"SELECT doc_id, CASE WHEN text = '' THEN 'Untitled' WHEN regexp_matches(text, '^#{{1,6}}\\s+[^\\n]') THEN trim(regexp_extract(text, '^#{{1,6}}\\s+([^\\n]+)', 1)) WHEN {_FIRST} <> '' AND length({_FIRST}) <= 100 AND NOT regexp_matches({_FIRST}, '[.,;]$') THEN {_FIRST} WHEN {_SENT} = '' THEN trim(substring(text, 1, 100)) || CASE WHEN length(text) > 100 THEN '...' ELSE '' END WHEN length({_SENT}) <= 150 THEN {_SENT} ELSE substring({_SENT}, 1, 147) || '...' END AS title FROM documents")
def b10_rule_title(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.rule_title("text").alias("title"))


_SUMMARY = "trim(array_to_string(list_slice(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), 1, 3), ' '))"


@register(f"SELECT doc_id, CASE WHEN length(s) > 500 THEN substring(s, 1, 497) || '...' ELSE s END AS summary FROM (SELECT doc_id, {_SUMMARY} AS s FROM documents)")
def b11_rule_summary(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.rule_summary("text").alias("summary"))


@register()
def b12_rule_tags(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.rule_tags("text"), "|").alias("tags"))


_CONV = "SELECT conv_id * 100 + turn AS id, text, CASE WHEN turn % 3 = 0 THEN 'Title: T' || turn || chr(10) || 'Summary: S of ' || conv_id || chr(10) || 'Tags: a, b' || turn WHEN turn % 3 = 1 THEN ' ' END AS response FROM conversations"


@register(f"SELECT id, CASE WHEN f THEN 'rule' ELSE trim(regexp_extract(response, 'Title: (.*)', 1)) END AS title, CASE WHEN f THEN 'none' ELSE regexp_extract(response, 'Summary: (.*)', 1) END AS summary, CASE WHEN f THEN 'r' ELSE replace(regexp_extract(response, 'Tags: (.*)', 1), ', ', '|') END AS tags, CASE WHEN f THEN 'rules' ELSE 'model' END AS enriched_by, CASE WHEN f THEN 'no response' END AS enrich_fallback_reason FROM (SELECT *, response IS NULL OR trim(response) = '' AS f FROM ({_CONV}))")
def b13_apply_enrichment(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("id", F.col("conv_id") * 100 + F.col("turn"))
    chunks = c.select("id", "text", F.lit("rule").alias("rule_title"), F.lit("none").alias("rule_summary"), F.array(F.lit("r")).alias("rule_tags"))
    answer = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Title: T"), "turn", F.lit("\nSummary: S of "), "conv_id", F.lit("\nTags: a, b"), "turn")).when(F.col("turn") % 3 == 1, " ")
    done = corpus.apply_enrichment(chunks, c.select("id", answer.alias("response")))
    return done.select("id", "title", "summary", F.array_join("tags", "|").alias("tags"), "enriched_by", "enrich_fallback_reason")


def _illustrated(spark, sf_dir) -> DataFrame:
    """Documents as chunks that refer to two images each, the second of which is known."""
    d = table(spark, sf_dir, "documents")
    text = F.concat("text", F.lit(" [IMAGE: i"), F.col("doc_id") % 50, F.lit("] and [IMAGE: i"), F.col("doc_id") % 7, F.lit("]"))
    image = F.struct(F.concat(F.lit("i"), F.col("doc_id") % 7).alias("id"), F.concat(F.lit("/img/"), F.col("doc_id") % 7).alias("path"), (F.col("doc_id") % 7 + 1).cast("long").alias("page"))
    return corpus.chunk_images(d.select(F.col("doc_id").alias("id"), text.alias("text"), F.array(image).alias("images")))


@register("SELECT doc_id AS id, 'i' || (doc_id % 50) || '|i' || (doc_id % 7) AS refs, (CASE WHEN doc_id % 50 = doc_id % 7 THEN 2 ELSE 1 END)::BIGINT AS n_images, (doc_id % 7 + 1)::BIGINT AS page_num FROM documents")
def b14_chunk_images(spark, sf_dir):
    return _illustrated(spark, sf_dir).select("id", F.array_join("image_refs", "|").alias("refs"), F.size("chunk_images").cast("long").alias("n_images"), "page_num")


@register("SELECT DISTINCT 'i' || (doc_id % 7) AS id, '/img/' || (doc_id % 7) AS path FROM documents")
def b15_images_to_caption(spark, sf_dir):
    return corpus.images_to_caption(_illustrated(spark, sf_dir))


def _captioned(spark, sf_dir) -> DataFrame:
    chunks = _illustrated(spark, sf_dir)
    captions = corpus.images_to_caption(chunks).select(F.col("id").alias("image_id"), F.concat(F.lit("no "), F.substring("id", 2, 9)).alias("caption"))
    return corpus.stitch_captions(chunks, captions).select("id", "text", F.size("image_captions").cast("long").alias("n_captions"))


@register("WITH known AS (SELECT DISTINCT doc_id % 7 AS k FROM documents), m AS (SELECT doc_id, text, doc_id % 50 AS x, doc_id % 7 AS y, doc_id % 50 IN (SELECT k FROM known) AS paired FROM documents) SELECT doc_id AS id, sha256(text || ' [IMAGE: i' || x || ']' || CASE WHEN paired THEN chr(10) || '(Description: no ' || x || ')' ELSE '' END || ' and [IMAGE: i' || y || ']' || chr(10) || '(Description: no ' || y || ')') AS text_sha256, (CASE WHEN paired THEN 2 ELSE 1 END)::BIGINT AS n_captions FROM m")
def b16_stitch_captions(spark, sf_dir):
    return _captioned(spark, sf_dir).withColumn("text_sha256", F.sha2("text", 256)).drop("text")


@register()
def b16_stitch_captions_whole(spark, sf_dir):
    """The stitched texts themselves."""
    return _captioned(spark, sf_dir)


@register("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id % 9 WHEN doc_id % 3 = 1 THEN doc_id % 8 ELSE doc_id % 7 - 1 END::BIGINT AS page FROM documents")
def b17_chunk_page(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    case = lambda k, v: F.when(F.col("doc_id") % 3 == k, v)
    path = F.concat(F.lit("/a/x_page_"), F.col("doc_id") % 7, F.lit(".png"))
    return d.select("doc_id", T.chunk_page(case(0, F.col("doc_id") % 9), case(1, F.col("doc_id") % 8), path).alias("page"))


def _attached(spark, sf_dir) -> DataFrame:
    """Documents as chunks of their source's pages, benchmark texts as formulas on pages 0 to 4."""
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("source_path"), F.when(F.col("doc_id") % 11 > 0, F.col("doc_id") % 5).alias("page"), (F.col("n_chars") % 100).cast("double").alias("top"))
    formulas = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("src"), F.col("item_id") % 20).alias("source_path"), (F.col("item_id") % 5).alias("page"), F.col("item_id").alias("idx"), F.col("text").alias("latex"), F.when(F.col("item_id") % 3 > 0, (F.col("item_id") * 7 % 100).cast("double")).alias("top"))
    return corpus.attach_formulas(chunks, formulas)


_ATTACHED = "att AS (SELECT c.doc_id AS id, 'formula_' || substring(md5(concat_ws('_', source, p::VARCHAR, item_id::VARCHAR, substring(b.text, 1, 50))), 1, 12) AS formula_id, round(coalesce(CASE WHEN item_id % 3 > 0 THEN greatest(0, 1 - abs(n_chars % 100 - item_id * 7 % 100)::DOUBLE / 50) END, 0.5), 6) AS proximity FROM documents c JOIN (SELECT *, item_id % 5 AS p FROM benchmark) b ON c.source = 'src' || (item_id % 20) AND (c.doc_id % 11 = 0 OR c.doc_id % 5 = p))"


@register(f"WITH {_ATTACHED} SELECT * FROM att")
def b18_attach_formulas(spark, sf_dir):
    return _attached(spark, sf_dir).select("id", "formula_id", F.round("proximity", 6).alias("proximity"))


@register(f"WITH {_ATTACHED} SELECT formula_id, array_to_string(list_sort(list(DISTINCT id)), ',') AS ids FROM att GROUP BY 1")
def b19_formula_index(spark, sf_dir):
    return corpus.formula_index(_attached(spark, sf_dir)).select("formula_id", F.array_join("ids", ",").alias("ids"))


@register("SELECT event_id, event_type AS t, CASE WHEN event_id % 2 = 0 THEN '{\"k\":' || (user_id::VARCHAR) || '}' END AS nested FROM events")
def b20_flatten_metadata(spark, sf_dir):
    meta = F.struct(F.col("event_type").alias("t"), F.when(F.col("event_id") % 2 == 0, F.struct(F.col("user_id").alias("k"))).alias("n"))
    return table(spark, sf_dir, "events").select("event_id", corpus.flatten_metadata(meta).alias("m")).select("event_id", F.col("m")["t"].alias("t"), F.col("m")["n"].alias("nested"))


@register("SELECT doc_id, sha256(text || CASE WHEN source <> 'src1' THEN chr(10) || chr(10) || 'Title: ' || source ELSE '' END || CASE WHEN lang <> 'fr' THEN chr(10) || chr(10) || 'Summary: ' || lang ELSE '' END) AS dense_sha256 FROM documents")
def b21_dense_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("source") == "src1", "Untitled").otherwise(F.col("source")).alias("title"), F.when(F.col("lang") != "fr", F.col("lang")).alias("summary"))
    return d.select("doc_id", F.sha2(corpus.dense_text(d), 256).alias("dense_sha256"))


@register("SELECT doc_id, sha256(text || ' frac x2 ' || source || ' ' || lang) AS sparse_sha256 FROM documents")
def b22_sparse_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.array(F.lit(r"\frac{x^2}")).alias("latex"), F.col("source").alias("title"), F.col("lang").alias("summary"))
    return d.select("doc_id", F.sha2(corpus.sparse_text(d), 256).alias("sparse_sha256"))


@register("SELECT count(*)::BIGINT AS n_vectors, count(*) FILTER (embedding IS NULL OR len(embedding) = 0)::BIGINT AS n_empty, count(DISTINCT len(embedding))::BIGINT AS n_sizes FROM embeddings")
def b23_check_vectors(spark, sf_dir):
    return corpus.check_vectors(table(spark, sf_dir, "embeddings"), "embedding")


@register(f"WITH {_WIN} SELECT printf('%s_%04d_%s', 'd' || id, chunk_index, substring(sha256(text), 1, 8)) AS a, printf('%s_%04d_%s', substring(sha256('p' || id), 1, 8), chunk_index, substring(sha256(text), 1, 8)) AS b FROM win")
def b24_chunk_ids(spark, sf_dir):
    c = chunks_of(spark, sf_dir)
    name = lambda lead: F.concat(F.lit(lead), F.col("id").cast("string"))
    return c.select(T.chunk_id(name("d"), F.col("chunk_index"), F.col("text")).alias("a"), T.path_chunk_id(name("p"), F.col("chunk_index"), F.col("text")).alias("b"))


@register("SELECT count(*)::BIGINT AS files, count(*) FILTER (event_type = 'view')::BIGINT AS ok, count(*) FILTER (event_type = 'error')::BIGINT AS failed, count(*) FILTER (event_type = 'click')::BIGINT AS skipped, sum(user_id)::BIGINT AS chunks, sum(event_id % 3)::BIGINT AS images, round(sum(event_id)::DOUBLE / sum(user_id)::DOUBLE, 6) AS mean_chunk FROM events")
def b26_ingest_report(spark, sf_dir):
    status = F.when(F.col("event_type") == "view", "success").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "skipped")
    return corpus.ingest_report(table(spark, sf_dir, "events").select(status.alias("status"), F.col("user_id").alias("chunks"), (F.col("event_id") % 3).alias("images"), F.col("event_id").alias("chars")))


_CELLS = "SELECT user_id, event_id, CASE WHEN event_id % 9 > 0 THEN event_type || ' | ' || coalesce(CASE WHEN event_id % 5 > 0 THEN event_id::VARCHAR END, '') END AS line FROM events"


@register(f"SELECT 'u' || user_id AS sheet, sha256(string_agg(line, chr(10) ORDER BY k) FILTER (k <= 100) || CASE WHEN max(k) > 100 THEN chr(10) || '... (' || (max(k) - 100) || ' more rows)' ELSE '' END) AS text_sha256 FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM ({_CELLS}) WHERE line IS NOT NULL) GROUP BY user_id")
def b27_rows_to_text(spark, sf_dir):
    some = lambda n, c: F.when(F.col("event_id") % n > 0, c)
    cells = F.array(some(9, F.col("event_type")), some(9, some(5, F.col("event_id").cast("string"))))
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("sheet"), F.col("event_id").alias("row_no"), cells.alias("cells"))
    return corpus.rows_to_text(rows).select("sheet", F.sha2("text", 256).alias("text_sha256"))


@register("SELECT conv_id AS table_id, sha256(string_agg('| ' || role || ' | ' || turn || ' |' || CASE WHEN k = 1 THEN chr(10) || '| --- | --- |' ELSE '' END, chr(10) ORDER BY turn)) AS markdown_sha256 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) GROUP BY 1")
def b28_rows_to_markdown(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("table_id"), F.col("turn").alias("row_no"), F.array("role", F.col("turn").cast("string")).alias("cells"))
    return corpus.rows_to_markdown(rows).select("table_id", F.sha2("markdown", 256).alias("markdown_sha256"))


_PARAS = "SELECT doc_id AS doc, i AS pos, l AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(l) <> ''"
_WORDS = "list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: true)"


@register(f"WITH p AS (SELECT *, (pos % 12 = 1) OR (length(text) < 80 AND NOT regexp_matches(trim(text), '[.!?;:,]$') AND len(list_filter({_WORDS}, lambda w: regexp_matches(w, '^[A-Z]')))::DOUBLE / len({_WORDS}) > 0.5) AS h FROM ({_PARAS})), s AS (SELECT *, sum(h::INT) OVER (PARTITION BY doc ORDER BY pos)::BIGINT AS section FROM p) SELECT doc, section, min(CASE WHEN h THEN trim(text) END) AS title, coalesce(sum(CASE WHEN NOT h THEN length(text) END), 0)::BIGINT AS n_chars FROM s GROUP BY 1, 2")
def b29_sectionize(spark, sf_dir):
    paras = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    done = corpus.sectionize(paras.withColumn("style", F.when(F.col("pos") % 12 == 0, "Heading 1")))
    feeds = F.greatest(F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))), F.lit(0))
    return done.select("doc", "section", "title", (F.length("text") - feeds).cast("long").alias("n_chars"))


_MARKED = "regexp_replace(text, '(^|\\n)([A-Z][a-z]+)\\.(\\n|$)', '\\1# \\2\\3', 'g')"


@register(f"WITH l AS (SELECT id, i, line, regexp_extract(line, '^(#{{1,6}})\\s+\\S', 1) AS m, coalesce(sum(length(line) + 1) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM (SELECT doc_id AS id, unnest(string_split({_MARKED}, chr(10))) AS line, generate_subscripts(string_split({_MARKED}, chr(10)), 1) AS i FROM documents)), s AS (SELECT *, sum((m <> '')::INT) OVER (PARTITION BY id ORDER BY i)::BIGINT AS section FROM l) SELECT id, section, max(length(m))::BIGINT AS level, max(CASE WHEN m <> '' THEN trim(regexp_replace(line, '^#{{1,6}}\\s+', '')) END) AS title, min(st)::BIGINT AS char_start, max(st + length(line))::BIGINT AS char_end FROM s GROUP BY 1, 2")
def b30_parse_sections(spark, sf_dir):
    marked = F.regexp_replace("text", r"(^|\n)([A-Z][a-z]+)\.(\n|$)", "$1# $2$3")
    return chunking.parse_sections(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), marked.alias("text")))


@register(f"WITH {_WIN} SELECT id, chunk_index, char_start, char_end, sha256(text) AS text_sha256 FROM win")
def c1_chunk_window(spark, sf_dir):
    return chunks_of(spark, sf_dir).select("id", "chunk_index", "char_start", "char_end", F.sha2("text", 256).alias("text_sha256"))


def _docs(spark, sf_dir, text=None) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (text if text is not None else F.col("text")).alias("text"))


@register()
def c2_chunk_recursive(spark, sf_dir):
    return chunking.chunk_recursive(_docs(spark, sf_dir))


@register()
def c9_chunk_lines(spark, sf_dir):
    return chunking.chunk_lines(_docs(spark, sf_dir))


@register("WITH m AS (SELECT doc_id AS id, list_slice(string_split(regexp_replace(replace(text, chr(10), chr(10) || '## '), '(## )', chr(1) || '\\1', 'g'), chr(1)), 2, 1000000) AS p, regexp_matches(text, '\\n') AS cut, text FROM documents WHERE NOT contains(text, '#') AND NOT regexp_matches(text, '\\n\\s*(\\n|$)')), r AS (SELECT id, unnest(CASE WHEN cut THEN p ELSE [text] END) AS t, generate_subscripts(CASE WHEN cut THEN p ELSE [text] END, 1) AS i FROM m) SELECT id, (i - 1)::BIGINT AS chunk_index, sha256(trim(t, chr(10) || chr(9) || ' ')) AS text_sha256 FROM r")
def c3_markdown_sections(spark, sf_dir):
    plain = table(spark, sf_dir, "documents").where(~F.contains("text", F.lit("#")) & ~F.col("text").rlike(r"\n\s*(\n|$)"))
    docs = plain.select(F.col("doc_id").alias("id"), F.replace(F.col("text"), F.lit("\n"), F.lit("\n## ")).alias("text"))
    return chunking.sections(docs, chunking.HEADING).select("id", "chunk_index", F.sha2("text", 256).alias("text_sha256"))


@register()
def c3_markdown_sections_whole(spark, sf_dir):
    """All documents, those with marks or blank lines of their own among them."""
    docs = _docs(spark, sf_dir, F.replace(F.col("text"), F.lit("\n"), F.lit("\n## ")))
    return chunking.sections(docs, chunking.HEADING).select("id", "chunk_index", "text")


@register()
def c3_chunk_markdown(spark, sf_dir):
    return chunking.chunk_markdown(_docs(spark, sf_dir, F.replace(F.col("text"), F.lit("\n"), F.lit("\n## "))), preamble=True)


@register()
def c4_chunk_numbered(spark, sf_dir):
    return chunking.chunk_numbered(_docs(spark, sf_dir, F.replace(F.col("text"), F.lit("\n"), F.lit("\n1.2. "))), preamble=True)


@register("SELECT doc_id AS id, k::BIGINT AS chunk_index, sha256('[' || 'part ' || k || '] ' || trim(substring(text, k * 200 + 1, CASE WHEN k = 2 THEN length(text) ELSE 200 END))) AS text_sha256 FROM (SELECT doc_id, text, unnest([0, 1, 2]) AS k FROM documents WHERE length(text) > 600)")
def c8_chunk_toc(spark, sf_dir):
    docs = _docs(spark, sf_dir).where(F.length("text") > 600)
    toc = docs.select("id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k")).select("id", (F.col("k") * 200).alias("position"), F.concat(F.lit("part "), "k").alias("title"))
    return chunking.toc_sections(docs, toc).select("id", "chunk_index", F.sha2("text", 256).alias("text_sha256"))


@register()
def c8_chunk_toc_whole(spark, sf_dir):
    """Every document through the router, with three entries each for those with an even id; others have none."""
    docs = _docs(spark, sf_dir)
    toc = docs.where("id % 2 = 0").select("id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k")).select("id", (F.col("k") * 200).alias("position"), F.concat(F.lit("part "), "k").alias("title"))
    return chunking.chunk_auto(docs, toc=toc)


_TAB = "len(list_filter(string_split(text, chr(10)), lambda x: contains(x, '|') OR contains(x, chr(9))))"


@register(f"SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '(?:^|\\n)#{{1,6}}\\s+')) >= 2 THEN 'markdown' WHEN len(regexp_extract_all(text, '(?:^|\\n)\\d+(?:\\.\\d+)*\\.\\s+')) >= 2 THEN 'numbered' WHEN {_TAB} >= 3 AND {_TAB}::DOUBLE / len(string_split(text, chr(10))) > 0.3 THEN 'table' ELSE 'recursive' END AS strategy FROM documents")
def c14_strategy(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", chunking.strategy("text").alias("strategy"))


@register()
def c14_chunk_auto(spark, sf_dir):
    return chunking.chunk_auto(_docs(spark, sf_dir))


@register(f"WITH {_WIN} SELECT id, chunk_index, lang, source, id::VARCHAR AS source_ref FROM win JOIN documents ON doc_id = id")
def c16_inherit(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id")
    return chunking.inherit(chunks_of(spark, sf_dir), docs, ["lang", "source"]).select("id", "chunk_index", "lang", "source", "source_ref")


_MATH = "text || ' $x_' || doc_id || '$ and f(' || (doc_id % 9) || ') ≈ y'"


@register(f"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(t, '\\$([^$]+)\\$', 1) || regexp_extract_all(t, '\\$\\$([^$]+)\\$\\$', 1) || regexp_extract_all(t, '([A-Za-z]\\s*=\\s*[A-Za-z0-9^_+\\-*/()]+)', 1) || regexp_extract_all(t, '([A-Za-z][A-Za-z0-9]*\\s*\\([^)]*\\))', 1) || regexp_extract_all(t, '(\\\\?[A-Za-z]+\\s*[{T.MATH_SIGNS}]\\s*[A-Za-z0-9]+)', 1))), '|') AS formulas FROM (SELECT doc_id, {_MATH} AS t FROM documents)")
def h1_detect_formulas(spark, sf_dir):
    t = F.concat("text", F.lit(" $x_"), "doc_id", F.lit("$ and f("), F.col("doc_id") % 9, F.lit(") ≈ y"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.detect_formulas(t), "|").alias("formulas"))


@register()
def h1_detect_formulas_whole(spark, sf_dir):
    t = F.concat("text", F.lit(" $x_"), "doc_id", F.lit("$ and f("), F.col("doc_id") % 9, F.lit(") ≈ y"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.detect_formulas(t), "|").alias("formulas"))


_CH = f"{_WIN}, ch AS (SELECT win.*, source, lang FROM win JOIN documents ON doc_id = id)"


def _chunk_rows(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id")
    return chunking.inherit(chunks_of(spark, sf_dir), docs, ["lang", "source"])


@register(f"WITH {_CH}, o AS (SELECT id, count(*)::BIGINT AS n_chunks, min_by(chunk_index, chunk_index) FILTER (chunk_index % 3 = 2) AS s, max(upper(lang)) AS lang, min_by(trim(string_split(text, chr(10))[1]), chunk_index) AS l FROM ch GROUP BY 1) SELECT id::VARCHAR AS source_ref, coalesce(nullif(l, ''), id::VARCHAR) AS title, 'summary ' || s AS summary, lang AS tags, n_chunks FROM o WHERE s IS NOT NULL AND id % 2 = 0 AND id NOT IN (SELECT id FROM win WHERE chunk_index = 0 AND contains(text, '#'))")
def i4_document_summaries(spark, sf_dir):
    c = _chunk_rows(spark, sf_dir).where("id % 2 = 0")
    rows = c.select("source_ref", "chunk_index", "text", F.lit("Untitled").alias("title"), F.when(F.col("chunk_index") % 3 == 2, F.concat(F.lit("summary "), "chunk_index")).alias("summary"), F.col("lang").alias("doc_type"), F.array().cast("array<string>").alias("tags"))
    marked = c.where("chunk_index = 0 and contains(text, '#')").select("source_ref")
    return views.document_summaries(rows).where(F.col("summary").startswith("summary ") & (F.length("summary") < 14)).join(marked, "source_ref", "left_anti").select("source_ref", "title", "summary", F.array_join("tags", ",").alias("tags"), "n_chunks")


@register()
def i4_document_summaries_whole(spark, sf_dir):
    """All documents, with titles from headings and summaries from the text where no chunk has one."""
    rows = _chunk_rows(spark, sf_dir).select("source_ref", "chunk_index", "text", F.lit("Untitled").alias("title"), F.when(F.col("chunk_index") % 3 == 2, F.concat(F.lit("summary "), "chunk_index")).alias("summary"), F.col("lang").alias("doc_type"), F.array().cast("array<string>").alias("tags"))
    return views.document_summaries(rows).select("source_ref", "title", "summary", F.array_join("tags", ",").alias("tags"), "n_chunks")


@register(f"WITH {_CH} SELECT source AS collection, count(*)::BIGINT AS n_chunks FROM ch GROUP BY 1")
def i5_list_collections(spark, sf_dir):
    return views.list_collections(_chunk_rows(spark, sf_dir).withColumnRenamed("source", "collection"))


@register("SELECT DISTINCT doc_id % 20 AS qid, 'i' || (doc_id % 7) AS image_id FROM documents")
def i6_result_images(spark, sf_dir):
    return views.result_images(_illustrated(spark, sf_dir).select((F.col("id") % 20).alias("qid"), "text", "images"))


def _managed(spark, sf_dir):
    """Documents as history, their windows as chunks, labels as images; file_hash is the document's id as text."""
    name = lambda c: F.col(c).cast("string").alias("file_hash")
    history = table(spark, sf_dir, "documents").select(name("doc_id"), "source")
    chunks = chunks_of(spark, sf_dir).select(name("id"), F.col("chunk_index").alias("id"))
    return history, chunks, table(spark, sf_dir, "labels").select(name("doc_id"), F.col("quality").alias("image_id"))


@register(f"WITH {_WIN} SELECT doc_id::VARCHAR AS file_hash, source, (SELECT count(*) FROM win WHERE id = doc_id)::BIGINT AS n_chunks, (SELECT count(*) FROM labels l WHERE l.doc_id = d.doc_id)::BIGINT AS n_images FROM documents d")
def j1_list_documents(spark, sf_dir):
    return views.list_documents(*_managed(spark, sf_dir))


@register(f"WITH {_WIN} SELECT doc_id::VARCHAR AS file_hash, (SELECT string_agg(chunk_index::VARCHAR, ',' ORDER BY chunk_index) FROM win WHERE id = doc_id) AS chunk_ids, (SELECT string_agg(quality::VARCHAR, ',' ORDER BY quality) FROM labels l WHERE l.doc_id = d.doc_id) AS image_ids FROM documents d")
def j2_document_detail(spark, sf_dir):
    return views.document_detail(*_managed(spark, sf_dir)).select("file_hash", F.array_join("chunk_ids", ",").alias("chunk_ids"), F.array_join("image_ids", ",").alias("image_ids"))


@register(f"WITH {_WIN}, g AS (SELECT doc_id FROM documents WHERE source = 'src2') SELECT 'chunks' AS store, (SELECT count(*) FROM win WHERE id IN (FROM g))::BIGINT AS n_deleted, (SELECT count(*) FROM win WHERE id NOT IN (FROM g))::BIGINT AS n_left UNION ALL SELECT 'images', (SELECT count(*) FROM labels WHERE doc_id IN (FROM g))::BIGINT, (SELECT count(*) FROM labels WHERE doc_id NOT IN (FROM g))::BIGINT UNION ALL SELECT 'history', (SELECT count(*) FROM g)::BIGINT, (SELECT count(*) FROM documents WHERE source <> 'src2')::BIGINT")
def j3_delete_documents(spark, sf_dir):
    history, chunks, images = _managed(spark, sf_dir)
    kept, counts = views.delete_documents({"chunks": (chunks, "file_hash"), "images": (images, "file_hash"), "history": (history, "file_hash")}, history.where("source = 'src2'"))
    left = None
    for name, frame in kept.items():
        n = frame.agg(F.count("*").alias("n_left")).select(F.lit(name).alias("store"), "n_left")
        left = n if left is None else left.unionByName(n)
    return counts.join(left, "store")


@register("SELECT source AS collection, count(*)::BIGINT AS n_docs, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY ROLLUP (source)")
def j4_collection_stats(spark, sf_dir):
    return views.collection_stats(table(spark, sf_dir, "documents").withColumnRenamed("source", "collection"))


_IMG = "SELECT user_id AS image_id, event_type AS collection, event_id AS bytes FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, props DESC) AS k FROM events) WHERE k = 1"


@register(f"SELECT collection, count(*)::BIGINT AS n_images, sum(bytes)::BIGINT AS bytes FROM ({_IMG}) GROUP BY 1")
def j5_image_index(spark, sf_dir):
    images = table(spark, sf_dir, "events").select(F.col("user_id").alias("image_id"), F.col("event_type").alias("collection"), F.col("event_id").alias("bytes"), F.col("ts").alias("created_at"), F.col("props").alias("file_path"))
    return views.image_totals(views.latest_images(images))


_AUDIT = {"mail": r"[a-z0-9.]+@[a-z0-9.]+", "licence": "Licen[sc]ed under", "number": r"[0-9]{4,}"}
_COUNTED = " UNION ALL ".join(f"SELECT '{n}' AS pattern, count(*) FILTER (c > 0)::BIGINT AS n_rows, sum(c)::BIGINT AS n_matches FROM (SELECT len(regexp_extract_all(text, '{p}')) AS c FROM documents)" for n, p in _AUDIT.items())


@register(_COUNTED)
def j6_pattern_audit(spark, sf_dir):
    return views.pattern_audit(table(spark, sf_dir, "documents"), _AUDIT)


@register(f"WITH {_CH} SELECT id, chunk_index, sha256(text) AS text_sha256 FROM ch WHERE source = 'src5'")
def j7_document_chunks(spark, sf_dir):
    return views.document_chunks(_chunk_rows(spark, sf_dir), F.col("source") == "src5").select("id", "chunk_index", F.sha2("text", 256).alias("text_sha256"))


@register()
def k5_answer_eval(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    answers = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("qid"), F.lit("the of and").alias("query"), F.concat("text", F.lit(" [1] [2]")).alias("answer"), F.array(F.lit("The"), F.lit("zzz")).alias("expected_keywords"))
    return evaluate.answer_eval(answers).withColumn("missing", F.array_join("missing", "|"))


_ANS = "SELECT conv_id * 100 + turn AS qid, text || ' [1] [2]' AS a FROM conversations WHERE role = 'assistant'"


@register(f"SELECT count(*)::BIGINT AS n_answers, round(avg(length(a)), 6) AS avg_answer_length, 2::DOUBLE AS avg_citation_count, round(avg(contains(lower(a), 'the')::INT * 0.5::DOUBLE), 6) AS avg_keyword_coverage FROM ({_ANS})")
def k6_answer_summary(spark, sf_dir):
    answers = table(spark, sf_dir, "conversations").where("role = 'assistant'").select((F.col("conv_id") * 100 + F.col("turn")).alias("qid"), F.lit("q").alias("query"), F.concat("text", F.lit(" [1] [2]")).alias("answer"), F.array(F.lit("The"), F.lit("zzz")).alias("expected_keywords"))
    return evaluate.answer_summary(evaluate.answer_eval(answers)).drop("avg_completeness")


@register("SELECT doc_id AS qid, 'q' AS metric, (1 - quality)::DOUBLE AS value FROM labels UNION ALL SELECT doc_id, 't', toxic::DOUBLE FROM labels")
def k8_combine_metrics(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("qid"), F.col("quality").cast("double").alias("q"), F.col("toxic").cast("double").alias("t"))
    return evaluate.combine_metrics([evaluate.long_form(labels, ["q", "t"]), evaluate.long_form(labels.select("qid", (1 - F.col("q")).alias("q")), ["q"])])


@register("SELECT item_id AS qid, CASE WHEN item_id % 3 = 0 THEN 'ref' WHEN item_id % 3 = 1 THEN 'gen ' || item_id ELSE (SELECT string_agg(lang, chr(10) || chr(10) ORDER BY doc_id) FROM documents WHERE doc_id >= item_id * 5 AND doc_id < item_id * 5 + 5) END AS answer FROM benchmark")
def k9_answers_for_eval(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"))
    cases = items.select("qid", F.when(F.col("qid") % 3 == 0, "ref").otherwise(" ").alias("reference_answer"))
    generated = items.where("qid % 3 = 1").select("qid", F.concat(F.lit("gen "), "qid").alias("generated"))
    results = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 5).alias("qid"), (F.col("doc_id") % 5 + 1).alias("rank"), F.col("lang").alias("text"))
    return evaluate.answers_for_eval(cases, generated, results)


@register("SELECT doc_id AS qid FROM documents WHERE source IN ('src1', 'src4')")
def k10_filter_cases(spark, sf_dir):
    cases = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("qid"), F.array("source").alias("expected_sources"))
    return evaluate.filter_cases(cases, sources=["src1", "src4"]).select("qid")


def _traces(spark, sf_dir) -> DataFrame:
    """Events as traces: one per user and ten events, each event a stage."""
    e = table(spark, sf_dir, "events").withColumn("trace_id", F.concat("user_id", F.lit("-"), F.floor(F.col("event_id") / 1000)))
    stage = F.struct("event_id", F.col("event_type").alias("stage"), F.when(F.col("event_id") % 7 > 0, F.col("value")).alias("elapsed_ms"), (F.col("event_id") % 5).alias("count"))
    rows = e.groupBy("trace_id").agg(F.array_sort(F.collect_list(stage)).alias("stages"), F.min("ts").alias("started_at"), F.max("user_id").alias("u"))
    return rows.withColumn("trace_type", F.when(F.col("u") % 2 == 0, "query").otherwise("ingestion"))


_ST = "st AS (SELECT user_id || '-' || (event_id // 1000) AS trace_id, event_id, ts, user_id, event_type AS stage, CASE WHEN event_id % 7 > 0 THEN value END AS ms, event_id % 5 AS c, (row_number() OVER (PARTITION BY user_id, event_id // 1000 ORDER BY event_id) - 1)::BIGINT AS position FROM events)"


@register(f"WITH {_ST} SELECT trace_id, min(ts) AS started_at FROM st WHERE user_id % 2 = 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100")
def l1_list_traces(spark, sf_dir):
    return observe.list_traces(_traces(spark, sf_dir), "query", 100).select("trace_id", "started_at")


@register(f"WITH {_ST} SELECT trace_id, count(*)::BIGINT AS n FROM st WHERE trace_id = '8-0' GROUP BY 1")
def l2_get_trace(spark, sf_dir):
    return observe.get_trace(_traces(spark, sf_dir), "8-0").select("trace_id", F.size("stages").cast("long").alias("n"))


@register(f"WITH {_ST} SELECT trace_id, position, stage, coalesce(ms, 0) AS elapsed_ms FROM st")
def l3_stage_timings(spark, sf_dir):
    return observe.stage_timings(_traces(spark, sf_dir))


@register(f"WITH {_ST} SELECT trace_id, arg_max_null(ms, event_id) AS elapsed_ms, max_by(c, event_id) AS count FROM st WHERE stage = 'click' GROUP BY 1")
def l4_latest_stage(spark, sf_dir):
    return observe.latest_stage(_traces(spark, sf_dir), "click")


@register(f"WITH {_ST} SELECT DISTINCT trace_id FROM st WHERE stage = 'error'")
def l5_search_traces(spark, sf_dir):
    return observe.search_traces(_traces(spark, sf_dir), "ERROR").select("trace_id")


_FUNNEL = "SELECT trace_id, max(c) FILTER (stage = 'view') AS n_view, max(c) FILTER (stage = 'error') AS n_error, round(sum(coalesce(ms, 0)), 6) AS total_ms FROM st GROUP BY 1"


@register(f"WITH {_ST} {_FUNNEL}")
def l6_query_funnel(spark, sf_dir):
    return observe.query_funnel(_traces(spark, sf_dir), ("view", "error"))


@register(f"WITH {_ST}, f AS (SELECT trace_id, max(c) FILTER (stage = 'view') AS d, max(c) FILTER (stage = 'click') AS s, max(c) FILTER (stage = 'purchase') AS fu, max(c) FILTER (stage = 'error') AS r FROM st GROUP BY 1) SELECT trace_id, concat_ws('|', CASE WHEN d IS NULL THEN 'dense failed' END, CASE WHEN s IS NULL THEN 'sparse failed' END, CASE WHEN d = 0 THEN 'no dense hits' END, CASE WHEN s = 0 THEN 'no sparse hits' END, CASE WHEN fu IS NULL THEN 'fusion skipped' END, CASE WHEN r IS NULL THEN 'rerank skipped' END, CASE WHEN coalesce(d, 0) = 0 AND coalesce(s, 0) = 0 THEN 'nothing found' END) AS findings FROM f")
def l7_diagnose(spark, sf_dir):
    funnel = observe.query_funnel(_traces(spark, sf_dir), ("view", "click", "purchase", "error"))
    named = funnel.withColumnsRenamed({"n_view": "n_dense", "n_click": "n_sparse", "n_purchase": "n_fusion", "n_error": "n_rerank"})
    return observe.diagnose(named).select("trace_id", F.array_join("findings", "|").alias("findings"))


@register(f"WITH {_ST} SELECT stage, count(*)::BIGINT AS n, round(quantile_cont(coalesce(ms, 0), 0.5), 6) AS p50, round(quantile_cont(coalesce(ms, 0), 0.95), 6) AS p95, round(quantile_cont(coalesce(ms, 0), 0.99), 6) AS p99 FROM st GROUP BY 1")
def l8_latency(spark, sf_dir):
    return observe.latency(observe.stage_timings(_traces(spark, sf_dir)))


@register("SELECT conv_id AS session, turn::BIGINT AS turn, role, sha256(text) AS text_sha256 FROM conversations WHERE turn < 2 UNION ALL SELECT conv_id, (coalesce(l, -1) + row_number() OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT, role, sha256(text) FROM (SELECT *, max(turn) FILTER (turn < 2) OVER (PARTITION BY conv_id) AS l FROM conversations) WHERE turn >= 2")
def m1_append_messages(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").cast("long").alias("turn"), "role", "text")
    both = observe.append_messages(c.where("turn < 2"), c.where("turn >= 2").withColumnRenamed("turn", "seq"))
    return both.select("session", "turn", "role", F.sha2("text", 256).alias("text_sha256"))


@register("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 3")
def m2_recent_messages(spark, sf_dir):
    return observe.recent_messages(table(spark, sf_dir, "conversations"), 3, "conv_id").select("conv_id", "turn", "role")


@register("SELECT conv_id AS session, sha256(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS transcript_sha256 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 10 GROUP BY 1")
def m3_transcripts(spark, sf_dir):
    return observe.transcripts(table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "session")).select("session", F.sha2("transcript", 256).alias("transcript_sha256"))


@register("SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT item_id FROM benchmark)")
def m4_clear_sessions(spark, sf_dir):
    gone = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("session"))
    return observe.clear_sessions(table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "session"), gone).select(F.col("session").alias("conv_id"), "turn")


@register("SELECT user_id, string_agg(event_type || '=' || v, ',' ORDER BY event_type) AS preferences FROM (SELECT user_id, event_type, max_by(CASE WHEN event_id % 4 > 0 THEN event_id::VARCHAR ELSE '' END, event_id) AS v FROM events GROUP BY 1, 2) WHERE v <> '' GROUP BY 1")
def m5_preferences(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("key"), F.when(F.col("event_id") % 4 > 0, F.col("event_id").cast("string")).otherwise("").alias("value"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    kept = observe.preferences(observe.merge_preferences(events))
    return kept.select("user_id", F.expr("array_join(transform(array_sort(map_entries(preferences)), e -> concat(e.key, '=', e.value)), ',')").alias("preferences"))


@register("SELECT time_bucket(INTERVAL '10 minutes', ts) AS window_start, event_type AS stage, count(*)::BIGINT AS n, round(sum(value), 4) AS total_ms FROM events GROUP BY 1, 2")
def n2_stage_latency(spark, sf_dir):
    plan = lambda e: jobs.stage_latency(e.select("ts", F.col("event_type").alias("stage"), F.col("value").alias("elapsed_ms")))
    return plan(table(spark, sf_dir, "events")).withColumn("total_ms", F.round("total_ms", 4))


@register("WITH g AS (SELECT *, (lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL '30 minutes')::INT AS o FROM events), s AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*)::BIGINT AS n FROM s GROUP BY user_id, k")
def n3_session_gaps(spark, sf_dir):
    return observe.session_gaps(table(spark, sf_dir, "events"), "user_id", "ts", 30)



def _titled(spark, sf_dir) -> DataFrame:
    """Documents whose lines are led by titles of papers and articles in turn."""
    lines = F.split("text", "\n")
    title = lambda i: F.element_at(F.array(F.lit("ABSTRACT"), F.lit("INTRODUCTION"), F.lit("RESULTS"), F.lit("Article 1: x")), (i % 4 + 1).cast("int"))
    return _docs(spark, sf_dir, F.array_join(F.transform(lines, lambda x, i: F.concat(title(i), F.lit("\n"), x)), "\n"))


@register()
def c10_chunk_academic(spark, sf_dir):
    return chunking.chunk_academic(_titled(spark, sf_dir))


@register()
def c11_labelled_sections(spark, sf_dir):
    return chunking.labelled_sections(_titled(spark, sf_dir))


@register()
def c12_chunk_legal(spark, sf_dir):
    return chunking.chunk_legal(_titled(spark, sf_dir))


@register()
def c5_to_c7_runs(spark, sf_dir):
    """Tables, code and JSON cut by their own rules, through the router on documents made to fit each."""
    fenced = F.concat(F.lit("```\n"), "text", F.lit("\n```\n"), "text")
    kinds = F.when(F.col("doc_id") % 3 == 0, fenced).when(F.col("doc_id") % 3 == 1, F.to_json(F.array_repeat(F.struct("lang", "source", "text"), 2))).otherwise(F.replace(F.col("text"), F.lit("\n"), F.lit(" | \n")))
    return chunking.chunk_auto(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), kinds.alias("text")))


_PARTS = "SELECT doc_id AS id, (i - 1)::BIGINT AS part, CASE WHEN doc_id % 2 = 0 THEN 't' || (i - 1) END AS title, i::BIGINT AS page, t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE length(t) > 0"


@register(f"SELECT id, part, title, page, k::BIGINT AS chunk_index, (k * 180)::BIGINT AS char_start, least(k * 180 + 200, length(t))::BIGINT AS char_end, sha256(substring(t, k * 180 + 1, 200)) AS text_sha256 FROM (SELECT *, unnest(generate_series(0, (length(t) - 1) // 180)) AS k FROM ({_PARTS})) WHERE trim(substring(t, k * 180 + 1, 200)) <> ''")
def c13_c17_chunk_structure(spark, sf_dir):
    lines = F.split("text", "\n")
    sections = F.transform(lines, lambda x, i: F.struct(F.concat(F.lit("t"), i).alias("title"), (i + 1).alias("page"), x.alias("text")))
    pages = F.transform(lines, lambda x, i: F.struct((i + 1).alias("page"), x.alias("text")))
    even = F.col("doc_id") % 2 == 0
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(even, sections).alias("sections"), F.when(~even, pages).alias("pages"))
    return chunking.chunk_structure(docs, 200, 20).withColumn("text_sha256", F.sha2("text", 256)).drop("text")
