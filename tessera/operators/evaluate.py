"""Retrieval and answer evaluation: results (qid, rank, id), truth (qid, id), cases with expectations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("hit_rate", "mrr")
#: Patterns of citations in an answer; the fourth has no group and counts its whole match.
CITATIONS = ((r"\[(\d+)\]", 1), (r"\[\[(\d+)\]\]", 1), (r"来源[\s:：]?(\d+)", 1), (r"引用[(\d+)]", 0), (r"脚注(\d+)", 1))


def hit_mrr(results: DataFrame, truth: DataFrame, queries: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """(qid, hit_rate, mrr) of every query; 0 without truth or without a hit."""
    if unknown := set(metrics) - set(METRICS):
        raise ValueError(f"unknown metrics {sorted(unknown)}")
    first = results.join(truth.distinct(), ["qid", "id"], "left_semi").groupBy("qid").agg(F.min("rank").alias("first"))
    out = queries.select("qid").join(first, "qid", "left")
    values = {"hit_rate": F.col("first").isNotNull().cast("double"), "mrr": F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6)}
    return out.select("qid", *(values[m].alias(m) for m in metrics))


def extract_id(json: str | Column) -> Column:
    """The id in a JSON object: id, chunk_id, document_id or doc_id, the first there is; bare strings stand for themselves."""
    c = F.col(json) if isinstance(json, str) else json
    found = F.coalesce(*(F.get_json_object(c, f"$.{k}") for k in ("id", "chunk_id", "document_id", "doc_id")))
    return F.when(F.trim(c).startswith("{"), found).otherwise(F.trim(F.trim(c), F.lit('"')))


def retrieval_eval(results: DataFrame, truth: DataFrame, cases: DataFrame, k: int = 10) -> DataFrame:
    """Per query: recall@k, hit@k, MRR@k, distinct expected sources found, rows on the expected page and in the section.

    results: qid, rank, id, source, page, section; cases: qid, expected_sources (array), expected_page, expected_section.
    """
    top = results.where(F.col("rank") <= k)
    expected = truth.distinct()
    hits = top.join(expected, ["qid", "id"], "left_semi").groupBy("qid").agg(F.count_distinct("id").alias("found"), F.min("rank").alias("first"))
    wanted = expected.groupBy("qid").agg(F.count("*").alias("expected"))
    rows = top.join(cases, "qid")
    matches = rows.groupBy("qid").agg(
        F.count_distinct(F.when(F.array_contains("expected_sources", F.col("source")), F.col("source"))).alias("source_hits"),
        F.count_if(F.col("page") == F.col("expected_page")).alias("page_hits"),
        F.count_if(F.lower("section").contains(F.lower("expected_section"))).alias("section_hits"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = cases.select("qid").join(hits, "qid", "left").join(wanted, "qid", "left").join(matches, "qid", "left")
    return out.select(
        "qid", F.round(F.coalesce(zero("found") / F.col("expected"), F.lit(0.0)), 6).alias("recall_at_k"), F.col("first").isNotNull().cast("double").alias("hit_at_k"),
        F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("mrr_at_k"), *(zero(c).cast("long").alias(c) for c in ("source_hits", "page_hits", "section_hits")),
    )


def retrieval_summary(per_query: DataFrame) -> DataFrame:
    return per_query.agg(
        F.count("*").alias("n_queries"), *(F.round(F.avg(c), 6).alias(f"avg_{c}") for c in ("recall_at_k", "hit_at_k", "mrr_at_k")),
        *(F.sum(c).alias(f"total_{c}") for c in ("source_hits", "page_hits", "section_hits")),
    )


def answer_eval(answers: DataFrame) -> DataFrame:
    """(qid, answer_length, answer_words, citation_count, keyword_coverage, missing, completeness).

    answers: qid, query, answer, expected_keywords (array). An empty answer scores 0 throughout.
    """
    a, low = F.coalesce("answer", F.lit("")), F.lower(F.coalesce("answer", F.lit("")))
    words = lambda c: F.filter(F.split(F.trim(F.regexp_replace(F.lower(c), r"\s+", " ")), " "), lambda w: w != "")
    keys = F.coalesce("expected_keywords", F.array().cast("array<string>"))
    found = F.filter(keys, lambda w: low.contains(F.lower(w)))
    coverage = F.when(F.size(keys) > 0, F.size(found) / F.size(keys)).otherwise(0.0)
    cited = reduce(F.array_union, (F.regexp_extract_all(a, F.lit(f"(?i){p}"), g) for p, g in CITATIONS))
    complete = (
        F.when(F.length(a) >= 50, 0.2).otherwise(0.0)
        + F.when(F.size(F.split(a, r"\.")) >= 2, 0.2).otherwise(0.0)
        + F.when(F.size(F.array_except(words(a), words(F.coalesce("query", F.lit(""))))) >= 10, 0.2).otherwise(0.0)
        + F.when(F.size(keys) > 0, 0.4 * coverage).otherwise(0.2)
    )
    some = a != ""
    return answers.select(
        "qid", F.length(a).cast("long").alias("answer_length"), F.when(some, F.size(words(a))).otherwise(0).cast("long").alias("answer_words"),
        F.size(cited).cast("long").alias("citation_count"), F.round(F.when(some, coverage).otherwise(0.0), 6).alias("keyword_coverage"),
        F.when(some, F.array_except(keys, found)).otherwise(F.array().cast("array<string>")).alias("missing"), F.round(F.when(some, F.least(complete, F.lit(1.0))).otherwise(0.0), 6).alias("completeness"),
    )


def answer_summary(per_answer: DataFrame) -> DataFrame:
    return per_answer.agg(F.count("*").alias("n_answers"), *(F.round(F.avg(c), 6).alias(f"avg_{c}") for c in ("answer_length", "citation_count", "keyword_coverage", "completeness")))


def long_form(wide: DataFrame, metrics: list[str]) -> DataFrame:
    """(qid, metric, value) of a frame with a column for each metric; nulls go."""
    return wide.unpivot("qid", metrics, "metric", "value").where("value is not null")


def aggregate_metrics(long: DataFrame) -> DataFrame:
    """The mean of each metric over the queries that have it."""
    return long.groupBy("metric").agg(F.round(F.avg("value"), 6).alias("value"), F.count("*").alias("n_queries"))


def combine_metrics(frames: list[DataFrame]) -> DataFrame:
    """Long metrics of several evaluators; the later one wins where names clash."""
    tagged = [f.select("qid", "metric", "value", F.lit(i).alias("n")) for i, f in enumerate(frames)]
    return reduce(DataFrame.unionByName, tagged).groupBy("qid", "metric").agg(F.max_by("value", "n").alias("value"))


def answers_for_eval(cases: DataFrame, generated: DataFrame, results: DataFrame, top: int = 5) -> DataFrame:
    """(qid, answer): the reference answer if it is not blank, else the generated one, else the best texts joined."""
    texts = results.where(F.col("rank") <= top).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("l"))
    joined = F.array_join(F.transform("l", lambda x: x["text"]), "\n\n")
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return cases.join(generated, "qid", "left").join(texts, "qid", "left").select("qid", F.coalesce(blank("reference_answer"), blank("generated"), joined, F.lit("")).alias("answer"))


def filter_cases(cases: DataFrame, ids: list[str] | None = None, sources: list[str] | None = None) -> DataFrame:
    if ids is not None:
        cases = cases.where(F.col("qid").isin(ids))
    return cases if sources is None else cases.where(F.arrays_overlap("expected_sources", F.array(*map(F.lit, sources))))


def compare_configs(runs: dict[str, DataFrame]) -> DataFrame:
    """Mean metrics of each configuration's long metrics."""
    tagged = [f.withColumn("config_id", F.lit(name)) for name, f in runs.items()]
    return reduce(DataFrame.unionByName, tagged).groupBy("config_id", "metric").agg(F.round(F.avg("value"), 6).alias("value"))


def gate(summary: DataFrame, least: dict[str, float], queries: DataFrame | None = None, results: DataFrame | None = None) -> DataFrame:
    """summary with passed: every metric named is at least its threshold.

    With queries(qid) and results(qid, ...), summary's one row gets n_empty, the queries without a result, which must be 0.
    """
    if queries is not None:
        empty = queries.select("qid").distinct().join(results, "qid", "left_anti").agg(F.count("*").alias("n_empty"))
        both = summary.unionByName(empty, allowMissingColumns=True)
        summary = both.agg(*(F.max(c).alias(c) for c in both.columns))
        return gate(summary, least).withColumn("passed", F.col("passed") & (F.col("n_empty") == 0))
    fits = [F.coalesce(F.col(m) >= v, F.lit(False)) for m, v in least.items()]
    return summary.withColumn("passed", reduce(lambda a, b: a & b, fits, F.lit(True)))


def ndcg(results: DataFrame, truth: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(qid, ndcg) with relevance 0 or 1; 0 without truth."""
    gain = lambda r: F.lit(1.0) / F.log2(r + 1)
    got = results.where(F.col("rank") <= k).join(truth.distinct(), ["qid", "id"], "left_semi").groupBy("qid").agg(F.sum(gain(F.col("rank"))).alias("dcg"))
    best = truth.distinct().groupBy("qid").agg(F.count("*").alias("n")).select("qid", F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + gain(i)).alias("ideal"))
    return queries.select("qid").join(got, "qid", "left").join(best, "qid", "left").select("qid", F.round(F.coalesce(F.col("dcg") / F.col("ideal"), F.lit(0.0)), 6).alias("ndcg"))


def running_rank(results: DataFrame) -> DataFrame:
    return results.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id")).cast("long"))
