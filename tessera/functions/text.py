"""Column functions over text: tokens, titles, summaries, tags, clean-up, snippets, stable ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = r"[\p{L}\p{N}_]+(?:-[\p{L}\p{N}_]+)*"
_PLAIN = r"[[\p{L}\p{N}_]&&[^\p{IsHan}]]+(?:-[[\p{L}\p{N}_]&&[^\p{IsHan}]]+)*"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: str | Column, min_len: int = 2) -> Column:
    """Lower-case terms in text order: hyphenated words stay whole, runs of Han characters become pairs."""
    return spelled(F.lower(F.coalesce(_col(text), F.lit(""))), min_len)


def spelled(text: str | Column, min_len: int = 1) -> Column:
    """The terms as the text spells them."""
    t = _col(text)
    words = F.regexp_extract_all(t, F.lit(_WORD), 0)
    mixed = F.regexp_extract_all(t, F.lit(rf"\p{{IsHan}}+|{_PLAIN}"), 0)
    pairs = F.flatten(F.transform(mixed, lambda t: F.when(t.rlike(r"^\p{IsHan}{3,}$"), F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: t.substr(i, F.lit(2)))).otherwise(F.array(t))))
    return F.filter(F.when(t.rlike(r"\p{IsHan}"), pairs).otherwise(words), lambda w: F.length(w) >= min_len)


def doc_title(text: str | Column) -> Column:
    """The first "# " line of the first 20, else the first line with text of the first 10."""
    lines = F.split(_col(text), "\n")
    heading = F.filter(F.slice(lines, 1, 20), lambda x: F.trim(x).startswith("# "))
    shown = F.filter(F.slice(lines, 1, 10), lambda x: F.trim(x) != "")
    first = F.get(heading, 0)
    return F.coalesce(F.trim(first.substr(F.lit(3), F.length(first))), F.trim(F.get(shown, 0)))


def doc_id(content: str | Column) -> Column:
    return F.concat(F.lit("doc_"), F.sha2(_col(content), 256).substr(1, 16))


def chunk_id(doc: Column, index: Column, text: Column) -> Column:
    return F.format_string("%s_%04d_%s", doc, index, F.sha2(text, 256).substr(1, 8))


def path_chunk_id(path: Column, index: Column, text: Column) -> Column:
    return F.format_string("%s_%04d_%s", F.sha2(path, 256).substr(1, 8), index, F.sha2(text, 256).substr(1, 8))


def rule_title(text: str | Column) -> Column:
    """A heading at the start; else a short first line; else the first sentence, cut at 150; else the first 100 characters."""
    t = _col(text)
    heading = F.trim(F.regexp_extract(t, r"^#{1,6}\s+([^\n]+)", 1))
    first = F.trim(F.get(F.split(t, "\n"), 0))
    sentence = F.regexp_replace(F.trim(F.get(F.split(t, r"[.!?]\s+"), 0)), r"[.!?]+$", "")
    start = F.concat(F.trim(t.substr(1, 100)), F.when(F.length(t) > 100, "...").otherwise(""))
    return (
        F.when(t.isNull() | (t == ""), "Untitled")
        .when(heading != "", heading)
        .when((first != "") & (F.length(first) <= 100) & ~first.rlike("[.,;]$"), first)
        .when(sentence == "", start)
        .when(F.length(sentence) <= 150, sentence)
        .otherwise(F.concat(sentence.substr(1, 147), F.lit("...")))
    )


def rule_summary(text: str | Column, sentences: int = 3) -> Column:
    """The first sentences, cut at 500."""
    joined = F.trim(F.array_join(F.slice(F.split(F.coalesce(_col(text), F.lit("")), r"(?<=[.!?])\s+"), 1, sentences), " "))
    return F.when(F.length(joined) > 500, F.concat(joined.substr(1, 497), F.lit("..."))).otherwise(joined)


def rule_tags(text: str | Column, most: int = 10) -> Column:
    """Capitalised phrases, code names and emphasised words, the first five of each, sorted."""
    t, edge = F.coalesce(_col(text), F.lit("")), r"(?<![\p{L}\p{N}_])"
    names = F.regexp_extract_all(t, F.lit(edge + r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*(?![\p{L}\p{N}_])"), 0)
    codes = F.regexp_extract_all(t, F.lit(rf"{edge}(?:[a-z]+(?:[A-Z][a-z]*)+|[a-z]+_[a-z_]+)(?![\p{{L}}\p{{N}}_])"), 0)
    marked = F.regexp_extract_all(t, F.lit(r"\*\*(?:.+?)\*\*|\*(?:.+?)\*|__(?:.+?)__|_(?:.+?)_"), 0)
    bare = F.transform(F.slice(marked, 1, 5), lambda x: F.trim(F.regexp_replace(x, r"^(\*\*|\*|__|_)(.*)\1$", "$2")))
    found = F.array_distinct(F.concat(F.slice(names, 1, 5), F.slice(codes, 1, 5), F.filter(bare, lambda x: x != "")))
    return F.slice(F.array_sort(found), 1, most)


def _clean(part: Column) -> Column:
    for pattern, new in (
        (r"(?is)─{10,}.*?(?:Page \d+|Footer|Section \d+|©|Confidential).*?─{10,}", ""),
        (r"─{10,}", ""), (r"(?s)<!--.*?-->", ""), (r"<[^>]+>", ""), (r" {2,}", " "), (r"\n{3,}", "\n\n"), (r"(?m)[ \t]+$", ""),
    ):
        part = F.regexp_replace(part, pattern, new)
    return part


def refine(text: str | Column, fences: bool = True) -> Column:
    """Headers and footers between rules, comments, tags and spare white space go; fenced code stays as it is."""
    t = F.coalesce(_col(text), F.lit(""))
    plain = _clean(t)
    if fences:
        # odd parts are code: split before and after each fenced block
        outside = F.transform(F.split(t, r"(?s)```.*?```"), _clean)
        inside = F.regexp_extract_all(t, F.lit(r"(?s)```.*?```"), 0)
        woven = F.array_join(F.transform(outside, lambda x, i: F.concat(x, F.coalesce(F.get(inside, i), F.lit("")))), "")
        plain = F.when(t.contains("```"), woven).otherwise(plain)
    return F.regexp_replace(plain, r"^\s+|\s+$", "")


def snippet(text: str | Column, most: int = 200) -> Column:
    """White space collapsed; longer texts are cut at the last space and marked."""
    t = F.trim(F.regexp_replace(F.coalesce(_col(text), F.lit("")), r"\s+", " "))
    cut = t.substr(1, most)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.regexp_replace(cut, r" [^ ]*$", ""), F.lit("...")))


def normalize_query(text: str | Column) -> Column:
    return F.trim(F.regexp_replace(_col(text), r"\s+", " "))


def chunk_page(page: Column, page_num: Column, path: Column) -> Column:
    """The page, else the page number, else the one in the path; the last two count from one there and from zero here."""
    in_path = F.coalesce(F.nullif(F.regexp_extract(path, r"_page_(\d+)", 1), F.lit("")), F.nullif(F.regexp_extract(path, r"\[(\d+)\]", 1), F.lit("")))
    return F.coalesce(page.cast("long"), page_num.cast("long"), in_path.cast("long") - 1)


def plain_latex(latex: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(latex, r"\\([a-zA-Z]+)\{", "$1 "), r"[{}^_]", "")


#: Patterns of formulas in a query. The last three apply if a mathematical sign occurs.
MATH_SIGNS = "∫∑∏√∞≈≠≤≥±×÷∂∇∈∉⊂⊃∪∩∀∃→←↔⇒⇐⇔"
FORMULAS = (r"\$([^$]+)\$", r"\$\$([^$]+)\$\$")
SIGNED_FORMULAS = (r"([A-Za-z]\s*=\s*[A-Za-z0-9^_+\-*/()]+)", r"([A-Za-z][A-Za-z0-9]*\s*\([^)]*\))", rf"(\\?[A-Za-z]+\s*[{MATH_SIGNS}]\s*[A-Za-z0-9]+)")


def detect_formulas(text: str | Column) -> Column:
    """Distinct formulas of a query, sorted."""
    t = F.coalesce(_col(text), F.lit(""))
    always = [F.regexp_extract_all(t, F.lit(p), 1) for p in FORMULAS]
    signed = [F.when(t.rlike(f"[{MATH_SIGNS}]"), F.regexp_extract_all(t, F.lit(p), 1)).otherwise(F.array().cast("array<string>")) for p in SIGNED_FORMULAS]
    return F.array_sort(F.array_distinct(F.concat(*always, *signed)))
