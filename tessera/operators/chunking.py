"""Chunking: documents to chunks. Every strategy takes docs (id, text, ...) and returns id, chunk_index, text and offsets."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZE, OVERLAP, SMALL, MERGE = 500, 50, 200, 1.5
#: Separators from strongest to weakest; the last cuts anywhere.
SEPARATORS = ("\n\n", "。", "！", "？", "；", ". ", "!\n", "?\n", ";\n", "\n", "，", ", ", " ", "")
HEADING = r"(?m)^#{1,6}\s+"
#: Characters of chunks that a task holds before it hands them on, about: a batch of texts is never cut as a whole.
HELD_CHARS = 1 << 21
NUMBERED = r"(?m)^(?:(?:\d+\.)+\s+\S|第[一二三四五六七八九十百千]+[章节部分篇]|[一二三四五六七八九十百千]+、)"


def _check(size: int, overlap: int) -> None:
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap at least 0 and below it")


def chunk_window(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Windows at 0, size - overlap, ...; a short last one is kept. Texts without characters give none."""
    _check(size, overlap)
    starts = F.expr(f"if(length(text) > 0, sequence(0, length(text) - 1, {size - overlap}), array())")
    cut = docs.withColumn("_n", F.length("text").cast("long")).select("*", F.posexplode(starts).alias("chunk_index", "char_start"))
    return cut.select(
        "id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("char_start").cast("long").alias("char_start"),
        F.least(F.col("char_start") + size, "_n").cast("long").alias("char_end"), F.col("text").substr(F.col("char_start") + 1, F.lit(size)).alias("text"),
    )


def pieces(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Cut at the strongest separator that occurs, recursively where parts are still too long, then merged up to size.

    Separators stay at the end of what they close. A new chunk starts with what fits the overlap of the last one.
    """
    if len(text) <= size:
        return [text] if text.strip() else []
    sep = next(s for s in separators if not s or s in text)
    weaker = separators[separators.index(sep) + 1 :]
    parts = [p + sep for p in text.split(sep)[:-1]] + [text.split(sep)[-1]] if sep else [text[i : i + size] for i in range(0, len(text), size)]
    small: list[str] = []
    for p in parts:
        small += [p] if len(p) <= size or not weaker else pieces(p, size, 0, weaker)
    out, now, total = [], [], 0
    for p in small:
        if now and total + len(p) > size:
            out.append("".join(now))
            while now and (total > overlap or total + len(p) > size):
                total -= len(now.pop(0))
        now.append(p)
        total += len(p)
    if now:
        out.append("".join(now))
    return [c.strip() for c in out if c.strip()]


def lines_window(text: str, size: int, overlap: int) -> list[str]:
    """Windows that end at their last line feed if they have one."""
    out, at = [], 0
    while at < len(text):
        end = min(at + size, len(text))
        feed = text.rfind("\n", at, end) if end < len(text) else -1
        end = feed + 1 if feed > at else end
        if text[at:end].strip():
            out.append(text[at:end].strip())
        at = end if end >= len(text) or end - overlap <= at else end - overlap
    return out


def _in_batches(rows: DataFrame, cut: Callable[..., Iterable[tuple]], added: str) -> DataFrame:
    """(id, *added) by cut(the columns of a row after its id), text among the columns added; nothing is shuffled.

    Texts are taken from their Arrow batch one by one, and chunks leave once there are HELD_CHARS characters of them.
    """
    names = [f.split(" ")[0] for f in added.split(", ")]
    kinds = [pa.int64() if f.endswith(" long") else pa.string() for f in added.split(", ")]
    text = names.index("text") + 1

    def table_of(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (kind, *kinds), strict=True)], names=["id", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            held, kind = 0, b.schema.field(0).type
            for n in range(b.num_rows):
                key, *values = (c[n].as_py() for c in b.columns)
                for chunk in cut(*values):
                    out.append((key, *chunk))
                    held += len(out[-1][text]) + 50
                    if held >= HELD_CHARS:
                        yield table_of(out, kind)
                        out, held = [], 0
            if out:
                yield table_of(out, kind)

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, {added}")


def _by(cut, docs: DataFrame) -> DataFrame:
    """Chunks of each text by a Python function."""
    return _in_batches(docs.select("id", "text"), lambda t: enumerate(cut(t or "")), "chunk_index long, text string")


def chunk_recursive(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    _check(size, overlap)
    return _by(lambda t: pieces(t, size, overlap), docs)


def chunk_lines(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    _check(size, overlap)
    return _by(lambda t: lines_window(t, size, overlap), docs)


def sections(docs: DataFrame, pattern: str, preamble: bool = False) -> DataFrame:
    """(id, chunk_index, text) cut before each line that fits the pattern; text before the first is kept on request.

    Sections that are longer than a chunk are left whole here.
    """
    marked = F.split(F.regexp_replace("text", f"({pattern})", "\u0001$1"), "\u0001")
    parts = F.when(F.size(marked) == 1, marked).otherwise(F.slice(marked, 1 if preamble else 2, F.size(marked)))
    trimmed = F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    return docs.select("id", F.posexplode(trimmed).alias("chunk_index", "text")).withColumn("chunk_index", F.col("chunk_index").cast("long"))


def _fitted(parts: DataFrame, size: int, overlap: int) -> DataFrame:
    """Parts over the size cut further; order and indexes follow the text."""
    short = parts.where(F.length("text") <= size).select("id", "chunk_index", F.lit(0).cast("long").alias("sub"), "text")
    more = _cut_long(parts.where(F.length("text") > size), size, overlap)
    order = Window.partitionBy("id").orderBy("chunk_index", "sub")
    return short.unionByName(more).withColumn("chunk_index", (F.row_number().over(order) - 1).cast("long")).select("id", "chunk_index", "text")


def _cut_long(parts: DataFrame, size: int, overlap: int) -> DataFrame:
    def cut(k: int, text: str) -> Iterator[tuple]:
        return ((k, s, c) for s, c in enumerate(pieces(text, size, overlap)))

    return _in_batches(parts.select("id", "chunk_index", "text"), cut, "chunk_index long, sub long, text string")


def chunk_markdown(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, preamble: bool = False) -> DataFrame:
    return _fitted(sections(docs, HEADING, preamble), size, overlap)


def chunk_numbered(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, preamble: bool = False) -> DataFrame:
    return _fitted(sections(docs, NUMBERED, preamble), size, overlap)


def packed(parts: list[str], size: int, joint: str = "\n") -> list[str]:
    out, now = [], ""
    for p in parts:
        if now and len(now) + len(joint) + len(p) > size:
            out.append(now)
            now = p
        else:
            now = f"{now}{joint}{p}" if now else p
    return [*out, now] if now.strip() else out


def table_runs(text: str, size: int, least: int = 50) -> list[str]:
    """Runs of lines, each without blanks at its ends and blank lines left out.

    A run is a text line with the table lines after it, or table lines alone; a text line always opens one. A run is
    full, and the next line opens another, once a table line brings it to `least` characters, or a text line to size.
    Text lines thus stand alone until merge_small() joins them. Without any line the text is cut as usual.
    """
    out: list[list[str]] = []
    room = 0  # characters that the last run may still take; none: it is full
    for line in filter(None, map(str.strip, text.split("\n"))):
        of_table = "|" in line or "\t" in line
        if not of_table or room <= 0:
            out.append([])
            room = least
        out[-1].append(line)
        room = room - len(line) if of_table or len(line) < size else 0
    return ["\n".join(run) for run in out] or pieces(text, size, 0)


def code_blocks(text: str, size: int, overlap: int) -> list[str]:
    """Fenced code whole, the text between cut as usual."""
    out: list[str] = []
    for i, part in enumerate(re.split(r"(```[\s\S]*?```)", text)):
        out += [part] if i % 2 else pieces(part, size, overlap)
    return out


_JSON_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*+"|[\[\]{},:]', re.S)


def json_members(text: str) -> list[tuple[int, int]] | None:
    """Where the elements of a JSON array, or the members of an object, start and end in the text.

    One pass over strings and brackets; an object's member reaches from its key to the end of its value. None if the text
    is neither, does not close what it opens, or goes on after it.
    """
    start = len(text) - len(text.lstrip())
    opener = text[start : start + 1]
    if opener not in ("[", "{"):
        return None
    closing = {"[": "]", "{": "}"}
    spans, opened, at = [], [closing[opener]], start + 1
    for m in _JSON_TOKEN.finditer(text, start + 1):
        c = text[m.start()]
        if c in "[{":
            opened.append(closing[c])
        elif c in "]}":
            if opened.pop() != c:
                return None
        if not opened or (c == "," and len(opened) == 1):
            if body := text[at : m.start()].strip():
                first = at + text[at : m.start()].index(body[0])
                spans.append((first, first + len(body)))
            at = m.end()
            if not opened:
                return spans if not text[at:].strip() else None
    return None


def json_parts(text: str, size: int) -> list[str]:
    """Slices of the text: elements of an array packed up to size as "[a, b]", an object's members one by one.

    A longer element or member is cut as any text, so no chunk is over size. The last member of an object brings the
    closing brace. Objects of fewer than two members and what is not JSON are cut as any text.
    """
    spans = json_members(text)
    if not spans or (text.lstrip()[0] == "{" and len(spans) < 2):
        return pieces(text.strip(), size, 0)
    if text.lstrip()[0] == "{":
        spans[-1] = (spans[-1][0], len(text.rstrip()))
        return [c for lo, hi in spans for c in ([text[lo:hi]] if hi - lo <= size else pieces(text[lo:hi], size, 0))]
    out: list[str] = []
    pack: list[str] = []
    for lo, hi in spans:
        if pack and sum(map(len, pack)) + 2 * len(pack) + hi - lo + 2 > size:
            out.append(f"[{', '.join(pack)}]")
            pack = []
        if hi - lo + 2 > size:
            out += pieces(text[lo:hi], size, 0)
        else:
            pack.append(text[lo:hi])
    return [*out, f"[{', '.join(pack)}]"] if pack else out


def merge_small(chunks: list[str], least: int = SMALL, size: int = SIZE, factor: float = MERGE) -> list[str]:
    """A chunk below `least` characters joins the one before it, or else the one after it, by a line feed.

    Two chunks may be joined if together they stay within factor * size, or if the small one has less than half of
    `least`. What has taken in the chunk after it is settled, whatever its length; a chunk that can join neither stays.
    Blanks at the ends of a chunk do not count. Lengths are kept as sums, so the work grows with the text. The state runs
    from chunk to chunk with all that was put out so far, which a fold of columns would copy at each step.
    """

    def size_of(parts: list[str], total: int) -> int:
        return total + len(parts) - 1 - (len(parts[0]) - len(parts[0].lstrip())) - (len(parts[-1]) - len(parts[-1].rstrip()))

    def may_join(first: list[str], total: int, then: str, small: str) -> bool:
        return size_of([first[0], *[""] * (len(first) - 1), then], total + len(then)) <= factor * size or len(small.strip()) < least // 2

    out: list[list[str]] = []
    total = 0  # characters of the last of out
    waiting = None
    for c in chunks:
        if waiting is not None:
            small, waiting = waiting, None
            taken = may_join([small], len(small), c, small)
            out.append([small, c] if taken else [small])
            total = len(small) + len(c) * taken
            if taken:
                continue
        if len(c.strip()) >= least:
            out.append([c])
            total = len(c)
        elif out and may_join(out[-1], total, c, c):
            out[-1].append(c)
            total += len(c)
        else:
            waiting = c
    return ["\n".join(parts) for parts in out] + ([] if waiting is None else [waiting])


def chunk_toc(docs: DataFrame, toc: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(id, chunk_index, text) between the positions of toc (id, position, title), each led by its title.

    Sections over the size are cut further, each part led by the title; blank ones are dropped, small chunks merged.
    Documents without entries, or with blank sections only, are cut by chunk_recursive.
    """
    _check(size, overlap)
    listed = toc.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.col("position").cast("long").alias("position"), F.coalesce("title", F.lit("")).alias("title")))).alias("toc"))

    def cut(text: str, entries: list) -> list[str]:
        entries = [] if entries is None else list(entries)
        ends = [*(e["position"] for e in entries[1:]), len(text)] if entries else []
        parts = [(e["title"], text[e["position"] : end].strip()) for e, end in zip(entries, ends, strict=True)]
        led = [f"[{title}] {c}" if title else c for title, p in parts for c in ([p] if len(p) <= size else pieces(p, size, overlap)) if c]
        return merge_small(led, size=size) if led else pieces(text, size, overlap)

    joined = docs.select("id", "text").join(listed, "id", "left")
    return _in_batches(joined, lambda t, e: enumerate(cut(t or "", e)), "chunk_index long, text string")


def toc_sections(docs: DataFrame, toc: DataFrame) -> DataFrame:
    """(id, chunk_index, text) of the bare cut at the positions of toc, each led by its title; nothing is fitted, merged or added."""
    order = Window.partitionBy("id").orderBy("position")
    spans = toc.withColumn("until", F.lead("position").over(order)).withColumn("chunk_index", (F.row_number().over(order) - 1).cast("long"))
    cut = spans.join(docs.select("id", "text"), "id")
    body = F.trim(cut["text"].substr(F.col("position") + 1, F.coalesce(F.col("until"), F.length("text")) - F.col("position")))
    return cut.select("id", "chunk_index", F.concat(F.lit("["), F.col("title"), F.lit("] "), body).alias("text"))


def strategy(text: str | Column = "text") -> Column:
    """json_config, code, markdown, numbered, table or recursive."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    lines = F.split(t, "\n")
    n = F.size(lines)
    json_like = F.regexp_replace(t, r"^\s+", "").rlike(r"^[{\[]")
    valid = F.try_parse_json(F.trim(t)).isNotNull()
    yaml = F.regexp_count(t, F.lit(r"(?m)^[a-z_]+:\s*$")) + F.regexp_count(t, F.lit(r"(?m)^\s+[a-z_]+:\s*[|\"'<]"))
    indented = F.size(F.filter(lines, lambda x: x.startswith("    ") | x.startswith("\t")))
    tables = F.size(F.filter(lines, lambda x: x.contains("|") | x.contains("\t")))
    return (
        F.when(json_like & (valid | (yaml >= 3)), "json_config")
        .when(t.rlike(r"(?m)^```\w*\s*[\s\S]*?^```") | (~json_like & (indented >= 3) & (indented / n > 0.2)), "code")
        .when(F.regexp_count(t, F.lit(HEADING)) >= 2, "markdown")
        .when(F.regexp_count(t, F.lit(r"(?m)^\d+(?:\.\d+)*\.\s+")) >= 2, "numbered")
        .when((tables >= 3) & (tables / n > 0.3), "table")
        .otherwise("recursive")
    )


def chunk_auto(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, toc: DataFrame | None = None) -> DataFrame:
    """(id, chunk_index, text, strategy) by each document's strategy; small chunks are merged except for JSON.

    Documents with entries in toc (id, position, title) come first of all: they are cut by chunk_toc.
    """
    if toc is not None:
        known = toc.select("id").distinct()
        by_toc = chunk_toc(docs.join(known, "id", "left_semi"), toc, size, overlap).withColumn("strategy", F.lit("toc"))
        return by_toc.unionByName(chunk_auto(docs.join(known, "id", "left_anti"), size, overlap))

    def cut(kind: str, text: str) -> list[str]:
        if kind == "json_config":
            return json_parts(text, size)
        if kind in ("markdown", "numbered"):
            at = [m.start() for m in re.finditer(HEADING if kind == "markdown" else NUMBERED, text)]
            parts = [text[a:b].strip() for a, b in zip(at, [*at[1:], len(text)], strict=True)]
            found = [c for p in parts for c in ([p] if len(p) <= size else pieces(p, size, overlap))]
        else:
            found = {"code": code_blocks, "recursive": pieces}[kind](text, size, overlap) if kind != "table" else table_runs(text, size)
        return merge_small(found, size=size)

    kinds = docs.select("id", "text", strategy("text").alias("strategy"))
    return _in_batches(kinds, lambda t, kind: ((k, c, kind) for k, c in enumerate(cut(kind, t or ""))), "chunk_index long, text string, strategy string")


def parse_sections(docs: DataFrame) -> DataFrame:
    """(id, section, level, title, char_start, char_end) of Markdown texts; what stands before a heading is section 0.

    Line breaks are single characters; char_end is exclusive and leaves out the break before the next section.
    """
    lines = docs.select("id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    order = Window.partitionBy("id").orderBy("line_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    marks = F.regexp_extract("line", r"^(#{1,6})\s+\S", 1)
    placed = lines.withColumns({
        "start": F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)), "marks": marks,
        "section": F.sum((marks != "").cast("long")).over(order),
    })
    out = placed.groupBy("id", "section").agg(
        F.max(F.length("marks")).cast("long").alias("level"), F.max(F.when(F.col("marks") != "", F.trim(F.regexp_replace("line", r"^#{1,6}\s+", "")))).alias("title"),
        F.min("start").cast("long").alias("char_start"), F.max(F.col("start") + F.length("line")).cast("long").alias("char_end"),
    )
    return out


def inherit(chunks: DataFrame, docs: DataFrame, columns: list[str]) -> DataFrame:
    """Chunks with columns of their documents and source_ref, the document's id."""
    return chunks.join(docs.select("id", *columns), "id").withColumn("source_ref", F.col("id").cast("string"))


#: Titles of sections of a paper.
ACADEMIC = (
    "abstract", "introduction", "background", "related work", "literature review", "methodology", "methods", "approach", "materials and methods",
    "experimental setup", "experiment", "experiments", "results", "results and discussion", "discussion", "conclusion", "conclusions", "references",
    "bibliography", "acknowledgments", "acknowledgements", "appendix", "supplementary materials",
)
ACADEMIC_ZH = ("摘要", "引言", "背景", "方法", "方法论", "实验", "结果", "讨论", "结论", "参考文献")
#: What opens an article of a contract or law.
LEGAL = r"(?m)^(?:第[一二三四五六七八九十\d]+条|Article\s+\d+[:\s]|Section\s+\d+[:\s])"
ACADEMIC_SIZE, ACADEMIC_OVERLAP = 1000, 150
_PAPER = r"(?m)^(?:\d+(?:\.\d+)*\.?\s+[A-Z][^\n]{0,80}$|(?:" + "|".join(sorted((t.upper() for t in ACADEMIC), key=len, reverse=True)) + r")\s*$)"
_LABEL = r"(?im)^(" + "|".join(sorted((*ACADEMIC, *ACADEMIC_ZH), key=len, reverse=True)) + r")\s*[:：]?[ \t]*(?:\n|$|(?<=[:：])|(?<=[:：] ))"


def packed_with_tail(parts: list[str], size: int, overlap: int) -> list[str]:
    """Parts packed up to size; each chunk but the first starts with the end of the one before."""
    out = packed([q for p in parts for q in ([p] if len(p) <= size else pieces(p, size, overlap))], size, "\n\n")
    return [c if not k or not overlap else f"{out[k - 1][-overlap:].strip()}\n{c}" for k, c in enumerate(out)]


def chunk_academic(docs: DataFrame, size: int = ACADEMIC_SIZE, overlap: int = ACADEMIC_OVERLAP) -> DataFrame:
    """Papers cut at numbered and well-known titles, packed up to size; without titles, by paragraphs."""
    _check(size, overlap)
    pattern = re.compile(_PAPER)

    def cut(text: str) -> list[str]:
        at = [m.start() for m in pattern.finditer(text)]
        if not at:
            return packed_with_tail([p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()], size, overlap)
        bounds = [0, *at, len(text)]
        return packed_with_tail([p for a, b in zip(bounds, bounds[1:], strict=False) if (p := text[a:b].strip())], size, overlap)

    return _by(cut, docs)


def labelled_sections(docs: DataFrame) -> DataFrame:
    """(id, chunk_index, text) with "[TITLE] " before each section of a paper, English titles in capitals; other texts give none."""
    pattern = re.compile(_LABEL)

    def cut(text: str) -> list[str]:
        found = list(pattern.finditer(text))
        if len(found) < 2:
            return []
        ends = [*(m.start() for m in found[1:]), len(text)]
        return [f"[{m[1].upper()}] {body}" for m, e in zip(found, ends, strict=True) if (body := text[m.end() : e].strip())]

    return _by(cut, docs)


def chunk_legal(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Texts with at least two articles cut before each; what stands before the first is kept; longer ones are cut on."""
    legal = docs.where(F.regexp_count("text", F.lit(LEGAL)) >= 2)
    return _fitted(sections(legal, LEGAL, preamble=True), size, overlap)


def chunk_structure(docs: DataFrame, size: int = 1000, overlap: int = 100) -> DataFrame:
    """(id, part, title, page, chunk_index, char_start, char_end, text) from given sections, or pages where a document has none.

    docs: id, sections array<struct<title, page, text>>, pages array<struct<page, text>>. The index starts anew in each
    section; blank chunks are left out.
    """
    _check(size, overlap)
    by_section = docs.select("id", F.posexplode("sections").alias("part", "s")).select("id", F.col("part").cast("long").alias("part"), "s.title", F.col("s.page").cast("long").alias("page"), "s.text")
    bare = docs.where(F.coalesce(F.size("sections"), F.lit(0)) <= 0)
    by_page = bare.select("id", F.posexplode("pages").alias("part", "p")).select("id", F.col("part").cast("long").alias("part"), F.lit(None).cast("string").alias("title"), F.col("p.page").cast("long").alias("page"), "p.text")
    parts = by_section.unionByName(by_page).where(F.length("text") > 0)
    starts = F.expr(f"sequence(0, length(text) - 1, {size - overlap})")
    cut = parts.select("*", F.length("text").alias("_n"), F.posexplode(starts).alias("chunk_index", "char_start"))
    out = cut.select(
        "id", "part", "title", "page", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("char_start").cast("long").alias("char_start"),
        F.least(F.col("char_start") + size, "_n").cast("long").alias("char_end"), F.col("text").substr(F.col("char_start") + 1, F.lit(size)).alias("text"),
    )
    return out.where(F.trim("text") != "")
