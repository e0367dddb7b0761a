"""Sources and sinks: files, golden sets, evaluation cases, traces, chunk tables, indexes, reports."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRACE = "trace_id string, trace_type string, started_at string, total_elapsed_ms double, elapsed_ms double, stages array<struct<stage: string, elapsed_ms: double, count: long, ok: boolean>>"
_CASE = "query string, expected_chunk_ids array<string>, expected_sources array<string>, reference_answer string"
_EVAL_CASE = "case_id string, question string, expected_keywords array<string>, expected_sources array<string>, expected_page_no int, expected_section_title string, reference_answer string"


def scan_files(spark: SparkSession, path: str, extensions: list[str]) -> DataFrame:
    """(path, modificationTime, length, content) of files below path with one of the extensions, upper or lower case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    wanted = [e.lower().lstrip(".") for e in extensions]
    return files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(wanted))


def read_text_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(source_path, text) of UTF-8 files, one row each."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("text"))


def read_golden(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Cases of a golden set: an object with test_cases, a bare array, or one case per line. A leading byte-order mark is ignored.

    A case without a query is left out, or with strict fails the job.
    """
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("t"))
    whole = F.from_json("t", f"struct<description: string, version: string, test_cases: array<struct<{_typed(_CASE)}>>>")
    listed = F.from_json("t", f"array<struct<{_typed(_CASE)}>>")
    lines = F.filter(F.split("t", "\r?\n"), lambda x: F.trim(x) != "")
    by_line = F.transform(lines, lambda x: F.from_json(x, _CASE))
    start = F.substring(F.regexp_replace("t", r"^\s+", ""), 1, 1)
    one_object = whole["test_cases"].isNotNull()
    form = F.when(one_object, "object").when(start == "[", "array").otherwise("lines")
    cases = text.select(form.alias("format"), F.explode(F.when(one_object, whole["test_cases"]).when(start == "[", listed).otherwise(by_line)).alias("c"))
    good = F.trim(F.coalesce("c.query", F.lit(""))) != ""
    if strict:
        cases = cases.withColumn("c", F.when(good, F.col("c")).otherwise(F.raise_error(F.lit("golden case without a query"))))
    return cases.where(good).select("c.*", "format")


def _typed(fields: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (f.split(" ", 1) for f in fields.split(", ")))


def read_cases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Evaluation cases of JSON lines, and every line that is unusable with its reason and place in the file."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    lines = text.where(F.trim("line") != "").withColumn("line_no", F.col("line_no") + 1)
    parsed = lines.withColumn("c", F.from_json("line", _EVAL_CASE + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    blank = lambda n: F.trim(F.coalesce(F.col(f"c.{n}"), F.lit(""))) == ""
    reason = F.when(F.col("c").isNull() | F.col("c._bad").isNotNull(), "not a JSON object of the expected types").when(blank("case_id"), "no case_id").when(blank("question"), "no question")
    marked = parsed.withColumn("reason", reason)
    return marked.where("reason is null").select("c.*").drop("_bad"), marked.where("reason is not null").select("file", "line_no", "reason")


def loaded_cases(cases: DataFrame, rejects: DataFrame) -> DataFrame:
    """The cases, or an error that lists what was rejected (the first hundred lines), or that the set is empty."""
    bad = rejects.orderBy("file", "line_no").limit(100).collect()
    if bad:
        raise ValueError("; ".join(f"line {r['line_no']}: {r['reason']}" for r in bad))
    if cases.isEmpty():
        raise ValueError("no cases")
    return cases


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Traces of JSON lines; broken lines are skipped; elapsed_ms is the total where that is given."""
    raw = spark.read.schema(TRACE).option("mode", "DROPMALFORMED").json(path)
    return raw.where("trace_id is not null").withColumn("elapsed_ms", F.coalesce("total_elapsed_ms", "elapsed_ms")).drop("total_elapsed_ms")


def append_traces(traces: DataFrame, path: str) -> None:
    traces.write.mode("append").json(path)


def spread(table: DataFrame) -> DataFrame:
    """A scan of fewer partitions than there are cores, dealt to all of them; a larger one stays as it is."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def upsert_chunks(existing: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """The existing rows whose key is not among the new ones, and the new ones; repeated new keys count once."""
    fresh = new.dropDuplicates([key])
    return existing.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def save_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Each frame as Parquet below folder; Spark's committer makes a table appear whole or not at all."""
    for name, frame in tables.items():
        frame.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame] | None:
    """The tables, or None if one is missing."""
    from pyspark.errors import AnalysisException

    found = {}
    for name in names:
        try:
            found[name] = spark.read.parquet(f"{folder}/{name}")
        except AnalysisException:
            return None
    return found


def report(long: DataFrame) -> DataFrame:
    """One row per query and a column per metric, in order of names; null where a query lacks it. long: qid, metric, value."""
    return long.groupBy("qid").pivot("metric").agg(F.first("value"))


def write_report(per_query: DataFrame, path: str, fmt: str = "csv") -> None:
    """Values rounded to four digits, as CSV with a header (blank where null) or as JSON lines."""
    rounded = per_query.select(*(F.round(n, 4).alias(n) if t == "double" else F.col(n) for n, t in per_query.dtypes))
    writer = rounded.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.json(path)


def append_history(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").json(path)


def recent_runs(runs: DataFrame, n: int = 10) -> DataFrame:
    return runs.orderBy(F.desc("timestamp"), "run_id").limit(n)


_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where none is named, a local session gets one of its own; a cluster has to name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = tempfile.mkdtemp(prefix="tessera-")
    return _OWN[sc.applicationId]


def content_key(spark: SparkSession, path: str) -> str:
    """A name for the files below path as they are now: it changes with any file's path, length or time. Nothing is read but the listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "modificationTime", "length")
    n, mixed = files.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("path", "modificationTime", "length").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
    return f"{n}-{int(mixed) & (1 << 64) - 1:016x}"
