"""Query preparation over a table of queries (qid, query)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_query, spelled

#: Chinese and English stop words of the query side.
CHINESE_STOPWORDS = (
    "如何 怎么 怎样 什么 哪个 哪些 为什么 为何 谁 多少 几 是否 能否 可否 的 地 得 了 着 过 吗 呢 吧 啊 呀 "
    "在 于 和 与 或 及 并 而 但 但是 因为 所以 如果 那么 虽然 然而 我 你 他 她 它 我们 你们 他们 这 那 "
    "这个 那个 这些 那些 这里 那里 很 非常 特别 更 最 都 也 还 又 再 已 已经 正在 将 会 能 可以 应该 必须 "
    "是 有 做 进行 使用 通过 个 种 类 ？ 。 ！ ， 、"
).split()
STOPWORDS = CHINESE_STOPWORDS + (
    "a an the in on at to for of with by from as into about through between after before and or but if then because while although "
    "i you he she it we they this that these those what which who whom whose is am are was were be been being have has had do does did "
    "will would could should may might must can get use make how why when where not no yes so very just also too"
).split()
#: Names of filter keys.
ALIASES = {"collection": "collection", "col": "collection", "c": "collection", "type": "doc_type", "doc_type": "doc_type", "t": "doc_type", "source": "source_path", "src": "source_path", "s": "source_path"}
_FILTER = r"([\p{L}\p{N}_]+):([^\s]+)"


def extract_filters(queries: DataFrame, enabled: bool = True) -> DataFrame:
    """Adds filters (map, the last value of a key wins), tags (array) and rest, the query without them."""
    q = normalize_query("query")
    if not enabled:
        return queries.withColumns({"filters": F.expr("cast(map() as map<string,string>)"), "tags": F.expr("cast(array() as array<string>)"), "rest": q})
    keys, values = F.regexp_extract_all(q, F.lit(_FILTER), 1), F.regexp_extract_all(q, F.lit(_FILTER), 2)
    pairs = F.zip_with(keys, values, lambda k, v: F.struct(k.alias("key"), v.alias("value")))
    queries = queries.withColumn("_pairs", pairs)
    name = lambda x: F.coalesce(*(F.when(F.lower(x) == a, b) for a, b in ALIASES.items()), x)
    is_tag = lambda p: F.lower(p["key"]).isin("tag", "tags")
    plain = F.transform(F.filter("_pairs", lambda p: ~is_tag(p)), lambda p: F.struct(name(p["key"]).alias("key"), p["value"].alias("value")))
    queries = queries.withColumn("_plain", plain)
    last = F.filter("_plain", lambda p, i: ~F.exists(F.slice("_plain", i + 2, F.size("_plain")), lambda o: o["key"] == p["key"]))
    return queries.withColumns({
        "filters": F.map_from_entries(last),
        "tags": F.flatten(F.transform(F.filter("_pairs", is_tag), lambda p: F.split(p["value"], ","))),
        "rest": normalize_query(F.regexp_replace(q, _FILTER, "")),
    }).drop("_pairs", "_plain")


def keywords(text: str | Column, stopwords: list[str] = STOPWORDS, min_len: int = 1, most: int = 20) -> Column:
    """Terms in order, cut as the index cuts them, the first spelling of each, without stop words.

    Stop words of Han characters part the runs around them before these become pairs.
    """
    t = F.col(text) if isinstance(text, str) else text
    han = sorted((w for w in stopwords if re.fullmatch("[\u4e00-\u9fff]{2,}", w)), key=len, reverse=True)
    parted = F.when(t.rlike(r"\p{IsHan}"), F.regexp_replace(t, "|".join(han), " ")).otherwise(t) if han else t
    words = F.filter(spelled(parted), lambda w: (F.length(w) >= min_len) & ~F.lower(w).isin(stopwords))
    first = F.filter(words, lambda w, i: F.array_position(F.transform(words, F.lower), F.lower(w)) == i + 1)
    return F.slice(first, 1, most)


def terms(queries: DataFrame) -> DataFrame:
    """(qid, term): what is looked up for queries (qid, query), their filters left out."""
    rest = extract_filters(queries).select("qid", F.explode(keywords("rest")).alias("t"))
    return rest.select("qid", F.lower("t").alias("term")).distinct()


def rewrite(query: str, kw: str) -> Column:
    """The query, and its keywords joined if there are any."""
    return F.array_compact(F.array(F.col(query), F.nullif(F.array_join(kw, " "), F.lit(""))))
