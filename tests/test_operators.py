"""Small hand-made cases for what SQL does not cover."""

import json

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import bm25, chunking, corpus, evaluate, query, search
from tessera.sources import readers
from tessera.streaming import jobs


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_refine_keeps_fenced_code(spark):
    text = "a   b  <i>c</i>\n\n\n\n```\nx  =  <1>\n```\nd <!-- no -->"
    assert one(spark, T.refine("t"), t=text) == "a b c\n\n```\nx  =  <1>\n```\nd"


def test_refine_drops_headers_and_footers(spark):
    rule = "─" * 12
    assert one(spark, T.refine("t"), t=f"{rule}\nPage 3 of 9\n{rule}\nText here.   \n") == "Text here."


def test_tokens_of_mixed_scripts(spark):
    assert one(spark, T.tokens("t"), t="Python 3.11 and GPT-4 machine-learning a") == ["python", "11", "and", "gpt-4", "machine-learning"]
    assert one(spark, T.tokens("t"), t="学习机器abc学习") == ["学习", "习机", "机器", "abc", "学习"]


def test_titles_and_tags(spark):
    assert one(spark, T.rule_title("t"), t="## Heading one\nbody") == "Heading one"
    assert one(spark, T.rule_title("t"), t="A first sentence. Then more, and more") == "A first sentence. Then more, and more"
    assert one(spark, T.rule_tags("t"), t="New York has snake_case and camelCase with **bold** words") == ["New York", "bold", "camelCase", "snake_case"]


def test_filters_last_one_wins(spark):
    df = query.extract_filters(spark.createDataFrame([(1, "c:a find  this col:b tag:x,y type:pdf k:v")], "qid long, query string")).first()
    assert df["filters"] == {"collection": "b", "doc_type": "pdf", "k": "v"} and df["tags"] == ["x", "y"] and df["rest"] == "find this"


def test_chinese_keywords_are_cut_as_the_index_cuts_them(spark):
    assert one(spark, query.keywords("t"), t="如何学习机器 Spark-SQL 的") == ["学习", "习机", "机器", "Spark-SQL"]
    found = one(spark, T.tokens("t"), t="学习机器 Spark-SQL")
    assert found == ["学习", "习机", "机器", "spark-sql"]


def test_keywords_keep_first_spelling(spark):
    assert one(spark, query.keywords("t"), t="How to use Spark spark SPARK with RDD") == ["Spark", "RDD"]


def test_rrf_does_not_depend_on_the_order_of_lists(spark):
    a = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c")], "qid long, rank long, id string")
    b = spark.createDataFrame([(1, 1, "b"), (1, 2, "c"), (1, 3, "d")], "qid long, rank long, id string")
    first, second = ([tuple(r) for r in search.rrf(x).orderBy("rank").collect()] for x in ([a, b], [b, a]))
    assert first == second and [r[2] for r in first] == ["b", "c", "a", "d"]
    with pytest.raises(ValueError):
        search.rrf([a, b], weights=[1.0])


def test_rerank_judged_falls_back(spark):
    results = spark.createDataFrame([(q, r, f"d{r}", 1.0 / r) for q in (1, 2) for r in (1, 2, 3)], "qid long, rank long, id string, score double")
    answers = spark.createDataFrame([(1, '```json\n[{"passage_id": "d3", "score": 9}, {"passage_id": "d1", "score": 2}, {"passage_id": "zz", "score": 3}]\n```'), (2, "no json")], "qid long, response string")
    got = search.rerank_judged(results, answers, 2).orderBy("qid", "rank").collect()
    assert [(r["qid"], r["id"], r["reranked"]) for r in got] == [(1, "d3", True), (1, "d1", True), (2, "d1", False), (2, "d2", False)]


def test_user_scorer(spark):
    pairs = spark.createDataFrame([(1, "a", "q", "xx"), (1, "b", "q", "xxxx")], "qid long, id string, query string, text string")
    got = search.score_pairs(pairs, lambda q, t: t.str.len().astype(float)).orderBy("id").collect()
    assert [r["rerank_score"] for r in got] == [2.0, 4.0]


def test_embed_checks_the_number_of_vectors(spark):
    df = spark.createDataFrame([(1, "a"), (2, "bb")], "id long, text string")
    got = corpus.embed(df, lambda ts: [[float(len(t))] for t in ts], batch=1)
    assert corpus.check_vectors(got).first().asDict() == {"n_vectors": 2, "n_empty": 0, "n_sizes": 1}
    with pytest.raises(Exception, match="vectors"):
        corpus.embed(df, lambda ts: []).collect()


@given(st.text(alphabet="ab .\n,", max_size=300), st.integers(5, 60))
@settings(max_examples=60, deadline=None)
def test_recursive_pieces_lose_nothing(text, size):
    got = chunking.pieces(text, size, 0)
    assert all(len(p) <= size for p in got) and "".join("".join(got).split()) == "".join(text.split())


@given(st.text(alphabet="ab\n", max_size=200), st.integers(5, 40))
@settings(max_examples=60, deadline=None)
def test_line_windows_lose_nothing(text, size):
    assert "".join("".join(chunking.lines_window(text, size, 0)).split()) == "".join(text.split())


def test_auto_chunks_by_strategy(spark):
    fence, long = "```", "word " * 60
    docs = spark.createDataFrame(
        [(1, '[{"a": 1}, {"a": 2}]'), (2, f"text\n{fence}py\ncode\n{fence}\nmore"), (3, f"# A\n{long}\n# B\n{long}"), (4, f"1. One\n{long}\n2. Two\n{long}"), (5, "a|b\nc|d\ne|f"), (6, "plain")],
        "id long, text string",
    )
    got = {r["id"]: r["strategy"] for r in chunking.chunk_auto(docs, size=400).collect()}
    assert got == {1: "json_config", 2: "code", 3: "markdown", 4: "numbered", 5: "table", 6: "recursive"}


def test_toc_chunks_cover_every_document(spark):
    long = "word " * 400
    docs = spark.createDataFrame([(1, "x" * 300 + long), (2, long), (3, "a" * 250 + "   " + "b" * 250), (4, "   "), (5, "c" * 250 + "d" * 40 + "e" * 250), (6, "short")], "id long, text string")
    toc = spark.createDataFrame([(1, 300, "two"), (1, 0, "one"), (3, 253, "z"), (3, 250, "blank"), (3, 0, "y"), (5, 0, "p"), (5, 250, "q"), (5, 290, "r"), (6, 90, "beyond"), (9, 0, "no document")], "id long, position int, title string")
    want = {
        1: ["[one] " + "x" * 300, *(f"[two] {c}" for c in chunking.pieces(long.strip(), 500, 50))], 2: chunking.pieces(long, 500, 50), 3: ["[y] " + "a" * 250, "[z] " + "b" * 250],
        5: ["[p] " + "c" * 250 + "\n[q] " + "d" * 40, "[r] " + "e" * 250], 6: ["short"],
    }
    got = {}
    for r in sorted(chunking.chunk_toc(docs, toc).collect()):
        assert r["chunk_index"] == len(got.setdefault(r["id"], []))
        got[r["id"]].append(r["text"])
    assert got == {i: chunking.merge_small(c) if i == 1 else c for i, c in want.items()}
    routed = {(r["id"], r["strategy"]) for r in chunking.chunk_auto(docs, toc=toc).collect()}
    assert routed == {(1, "toc"), (2, "recursive"), (3, "toc"), (5, "toc"), (6, "toc")}


def test_small_chunks_are_merged():
    assert chunking.merge_small(["x" * 300, "y" * 50, "z" * 300]) == ["x" * 300 + "\n" + "y" * 50, "z" * 300]


def test_bm25_full_build_equals_incremental(spark):
    docs = spark.createDataFrame([(1, "red apple pie"), (2, "green apple"), (3, "blue sky"), (4, "")], "id long, text string")
    posts, sizes = bm25.postings(docs, "id", "text"), bm25.lengths(docs, "id", "text")
    half = docs.where("id > 2")
    less = bm25.remove_documents(posts, sizes, half.select("id"))
    again = bm25.add_documents(*less, bm25.postings(half, "id", "text"), bm25.lengths(half, "id", "text"))
    key = lambda i: sorted((r["term"], r["df"], round(r["idf"], 9)) for r in i.terms.collect())
    assert key(bm25.build(posts, sizes)) == key(bm25.build(*again)) and bm25.build(posts, sizes).avg_doc_length == 7 / 4
    with pytest.raises(ValueError):
        bm25.build(posts, sizes, k1=0)


def test_answer_checks(spark):
    df = spark.createDataFrame([(1, "what is it", "It is [1] a Thing [1]. See 来源2.", ["thing", "zz"]), (2, "q", "", [])], "qid long, query string, answer string, expected_keywords array<string>")
    a, b = evaluate.answer_eval(df).orderBy("qid").collect()
    assert (a["citation_count"], a["keyword_coverage"], a["missing"]) == (2, 0.5, ["zz"]) and (b["answer_length"], b["completeness"]) == (0, 0.0)


def test_ids_of_any_name(spark):
    df = spark.createDataFrame([('{"chunk_id": "a"}',), ('{"doc_id": "b"}',), ('"c"',)], "j string")
    assert [r[0] for r in df.select(evaluate.extract_id("j")).collect()] == ["a", "b", "c"]


def test_golden_sets_of_all_layouts(spark, tmp_path):
    case = {"query": "q1", "expected_chunk_ids": ["c"], "expected_sources": []}
    (tmp_path / "a.json").write_text("﻿" + json.dumps({"test_cases": [case, {"query": " "}], "version": "1"}), encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps([case]))
    (tmp_path / "c.jsonl").write_text(json.dumps(case) + "\n\n" + json.dumps({"x": 1}) + "\n")
    for name, form in (("a.json", "object"), ("b.json", "array"), ("c.jsonl", "lines")):
        (row,) = readers.read_golden(spark, str(tmp_path / name)).collect()
        assert (row["query"], row["expected_chunk_ids"], row["format"]) == ("q1", ["c"], form)
    with pytest.raises(Exception, match="golden case"):
        readers.read_golden(spark, str(tmp_path / "a.json"), strict=True).collect()


def test_cases_report_every_bad_line(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"case_id": "1", "question": "q"}\n\n{"case_id": "2"}\nnot json\n')
    good, bad = readers.read_cases(spark, str(tmp_path / "x.jsonl"))
    assert [r["case_id"] for r in good.collect()] == ["1"] and sorted(r["line_no"] for r in bad.collect()) == [3, 4]
    with pytest.raises(ValueError, match="line 3"):
        readers.loaded_cases(good, bad)


def test_traces_skip_broken_lines(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("a", "query", 1.5)], "trace_id string, trace_type string, total_elapsed_ms double").coalesce(1).write.json(path)
    (tmp_path / "t" / "more.json").write_text('{"trace_id": "b", "elapsed_ms": 2}\n{broken\n')
    assert sorted((r["trace_id"], r["elapsed_ms"]) for r in readers.read_traces(spark, path).collect()) == [("a", 1.5), ("b", 2.0)]


def test_files_by_extension(spark, tmp_path):
    for name in ("a.MD", "b.md", "c.txt"):
        (tmp_path / name).write_text(name)
    got = readers.scan_files(spark, str(tmp_path), [".md"])
    assert sorted(r["path"].rsplit("/")[-1] for r in got.collect()) == ["a.MD", "b.md"]
    assert {r["text"] for r in readers.read_text_corpus(spark, str(tmp_path)).collect()} == {"a.MD", "b.md", "c.txt"}


def test_tables_are_saved_whole_or_missing(spark, tmp_path):
    readers.save_tables({"a": spark.range(3)}, str(tmp_path))
    assert readers.load_tables(spark, str(tmp_path), ["a"])["a"].count() == 3 and readers.load_tables(spark, str(tmp_path), ["a", "b"]) is None


def _stream(spark, df, tmp_path, parts=2):
    path = str(tmp_path / "in")
    df.repartition(parts).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_streamed_latency_equals_the_table(spark, tmp_path):
    rows = spark.range(200).select(F.timestamp_seconds(F.col("id") * 37).alias("ts"), F.concat(F.lit("s"), F.col("id") % 3).alias("stage"), F.col("id").cast("double").alias("elapsed_ms"))
    q = jobs.stage_latency(_stream(spark, rows, tmp_path), late="10 days").writeStream.format("memory").queryName("lat").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("lat").collect())) == sorted(map(tuple, jobs.stage_latency(rows).collect()))


def test_incremental_ingest_sees_each_hash_once(spark, tmp_path):
    rows = spark.createDataFrame([("h1", 1), ("h1", 2), ("h2", 3)], "file_hash string, n long")
    seen = []
    q = jobs.incremental_ingest(_stream(spark, rows, tmp_path, 1), lambda b, i: seen.extend(r[0] for r in b.select("file_hash").collect()), str(tmp_path / "cp"))
    q.awaitTermination()
    assert sorted(seen) == ["h1", "h2"]


def test_streamed_deduplication(spark, tmp_path):
    rows = spark.createDataFrame([("h1", 1), ("h1", 2), ("h2", 3)], "file_hash string, s long").withColumn("ts", F.timestamp_seconds("s"))
    q = jobs.first_seen(_stream(spark, rows, tmp_path)).writeStream.format("memory").queryName("dedup").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["file_hash"] for r in spark.table("dedup").collect()) == ["h1", "h2"]


def test_streamed_memory_keeps_the_last_messages(spark, tmp_path):
    rows = spark.createDataFrame([(1, t, "user", f"m{t}") for t in range(6)], "session long, turn long, role string, text string")
    q = jobs.last_messages(_stream(spark, rows, tmp_path), 2).writeStream.format("memory").queryName("mem").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    last = pd.DataFrame([r.asDict() for r in spark.table("mem").collect()])
    assert {4, 5} <= set(last["turn"])


def test_papers_and_contracts(spark):
    docs = spark.createDataFrame([(1, "Front\nABSTRACT\nShort words.\n1. Introduction\nMore words.\nRESULTS\nGood."), (2, "Article 1: Rent\na\nArticle 2: Term\nb"), (3, "plain")], "id long, text string")
    papers = {r["id"]: r["text"] for r in chunking.chunk_academic(docs, 60, 0).orderBy("id", "chunk_index").collect()}
    assert papers[1] == "RESULTS\nGood." or papers[1].endswith("Good.")
    assert [r["text"] for r in chunking.labelled_sections(docs).orderBy("chunk_index").collect()] == ["[ABSTRACT] Short words.\n1. Introduction\nMore words.", "[RESULTS] Good."]
    assert [r["text"] for r in chunking.chunk_legal(docs).orderBy("chunk_index").collect()] == ["Article 1: Rent\na", "Article 2: Term\nb"]


def test_structures_fall_back_to_pages(spark):
    docs = spark.createDataFrame([(1, [("t", 1, "abcdef")], [(9, "zz")]), (2, [], [(3, "pq"), (4, " ")])], "id long, sections array<struct<title: string, page: int, text: string>>, pages array<struct<page: int, text: string>>")
    got = sorted((r["id"], r["title"], r["page"], r["chunk_index"], r["text"]) for r in chunking.chunk_structure(docs, 4, 1).collect())
    assert got == [(1, "t", 1, 0, "abcd"), (1, "t", 1, 1, "def"), (2, None, 3, 0, "pq")]
