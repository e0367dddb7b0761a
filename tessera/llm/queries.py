"""One registered query for each operator, over the whole of its table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, html_layout, lexical_scan, neural_lm, ngram_join, order_minhash, packing, piece_viterbi, pii, pu_classifier, quality_rules, quotes, source_audit
from .common import table


def op1_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.threads(table(spark, sf_dir, "conversations"))


def op2_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_layout.extract(table(spark, sf_dir, "pages"))


def op3_pu_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = pu_classifier.features(table(spark, sf_dir, "documents"))
    return pu_classifier.score(stats, pu_classifier.train(stats, table(spark, sf_dir, "labels")))


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.compare(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = quality_rules.judge(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op6_neural_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = neural_lm.score(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(table(spark, sf_dir, "documents"))


def op8_piece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_viterbi.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"))
    base = pii.KINDS[:4]
    listed = "array_join(transform({}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    of_base = f"filter(spans, s -> s.kind in {base})"
    return found.select(
        "doc_id",
        *(F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in base),
        F.sha2(F.expr(listed.format(of_base)), 256).alias("base_sha256"),
        F.expr(listed.format("spans")).alias("spans"),
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_lexical_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_scan.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(table(spark, sf_dir, "documents"), {"text_sha256": F.sha2(exact_dedup.normalised(), 256)})


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_quote_linking, op2_html_layout, op3_pu_classifier, op4_order_minhash, op5_quality_rules, op6_neural_lm, op7_ngram_jaccard, op8_piece_viterbi, op9_pii, op10_packing, op11_lexical_scan, op12_exact_dedup, op13_source_audit, pipeline]
    return {f.__name__: f for f in found}


#: Links by shared 5-word shingles, and components by reachability.
_SPACE = r"[^\x20\x09-\x0D]+"
OP7_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}') AS ws FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(ws[i:i+4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
reach AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y),
low AS (SELECT x, min(y) AS y FROM reach GROUP BY 1),
same AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY list_sort(g)) AS class_id FROM (SELECT doc_id, list(g) AS g FROM s GROUP BY 1))
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(low.y, w.doc_id)) AS component_id, coalesce(same.class_id, w.doc_id) AS class_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN low ON low.x = w.doc_id LEFT JOIN same ON same.doc_id = w.doc_id"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
#: Integer scores of all documents that hold a term of an item.
OP11_SQL = f"""
WITH w AS (SELECT row_number() OVER () AS k, doc_id, {_TERMS} AS ws FROM documents),
s AS (SELECT count(*) FILTER (len(ws) > 0)::BIGINT AS n_docs, sum(len(ws))::BIGINT AS n_terms FROM w),
b AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE item_id IS NOT NULL),
c AS (SELECT k, term, count(*)::BIGINT AS tf FROM (SELECT k, unnest(ws) AS term FROM w) WHERE term IN (SELECT term FROM b) GROUP BY 1, 2),
f AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM c, s GROUP BY 1),
m AS (SELECT k, doc_id, 100 - 90 + ((90 * len(ws) * n_docs) // n_terms) AS m FROM w, s WHERE doc_id IS NOT NULL AND len(ws) > 0),
p AS (SELECT item_id, doc_id, k, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM b JOIN c USING (term) JOIN f USING (term) JOIN m USING (k) GROUP BY 1, 2, 3)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM p WHERE score > 0) WHERE rank <= 10"""

#: Groups of equal texts; of repeated rows under one id one stays.
OP12_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t)::BIGINT AS group_size,
row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256 FROM t"""

_LETTERS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"
_F = "((p - q) * (p - q)) // (p + q)"
_P = "(1 + (1000000000::HUGEINT * ({n} + 2)) // ({all} + 2 * v))::BIGINT"
#: Shares of all kept terms in every group and language; '' stands for null.
OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LETTERS} AS ws FROM documents),
t AS (SELECT k, lang, source, unnest(ws) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT k) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang, source, t.term, count(*)::BIGINT AS n FROM t JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
lv AS (SELECT lang, count(*)::BIGINT AS v FROM kept GROUP BY 1),
ln AS (SELECT lang, term, sum(n)::BIGINT AS n, sum(sum(n)) OVER (PARTITION BY lang)::BIGINT AS a FROM c GROUP BY 1, 2),
q AS (SELECT lang, term, {_P.format(n="n", all="a")} AS q FROM ln JOIN lv USING (lang)),
gn AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::BIGINT AS a FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY 1, 2),
p AS (SELECT gn.lang, gn.source, kept.term, coalesce(c.n, 0) AS n, {_P.format(n="coalesce(c.n, 0)", all="a")} AS p FROM gn JOIN kept ON kept.lang = gn.lang JOIN lv ON lv.lang = gn.lang LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = kept.term),
s AS (SELECT lang, source, item, sum({_F})::BIGINT AS value FROM (SELECT x.lang, x.source, y.source AS item, x.p, y.p AS q FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source) GROUP BY 1, 2, 3),
pairs AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ({_F})::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 10"""

_LINES = r"string_split(regexp_replace(text, '\r\n', chr(10), 'g'), chr(10))"
_NORMAL = r"trim(regexp_replace(lower(u), '[^\p{L}\p{N}]+', ' ', 'g'))"
_INTRO = quotes.INTRODUCES.replace("(?i)", "")
#: Quote levels by line, passages as runs of one level, and the latest earlier turn that said the same.
OP1_SQL = f"""
WITH RECURSIVE m AS (SELECT DISTINCT conv_id, coalesce(turn, -1)::BIGINT AS turn, role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT *, row_number() OVER () AS key FROM m),
l AS (SELECT conv_id, turn, key, unnest({_LINES}) AS line, generate_subscripts({_LINES}, 1) AS pos FROM k),
b AS (SELECT *, len(regexp_extract_all(regexp_extract(line, '^((?:\\s*>)+)', 1), '>')) AS level, trim(regexp_replace(line, '^((?:\\s*>)+)', '')) AS body FROM l),
o AS (SELECT *, (level <> coalesce(lag(level) OVER (PARTITION BY key ORDER BY pos), -1))::INT AS opens FROM b),
g AS (SELECT *, sum(opens) OVER (PARTITION BY key ORDER BY pos) AS block FROM o),
j AS (SELECT conv_id, turn, key, level, block, string_agg(body, ' ' ORDER BY pos) AS joined, list(body) AS bodies FROM g GROUP BY ALL),
u AS (SELECT DISTINCT conv_id, turn, key, level, {_NORMAL} AS h FROM (SELECT conv_id, turn, key, level, unnest([joined] || bodies || string_split(regexp_replace(joined, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS u FROM j)),
said AS (SELECT DISTINCT conv_id, h, turn FROM u WHERE level = 0 AND h <> ''),
src AS (SELECT q.key, q.level, q.h, max(s.turn) AS source FROM u q JOIN said s ON s.conv_id = q.conv_id AND s.h = q.h AND s.turn < q.turn WHERE q.level > 0 AND q.h <> '' GROUP BY 1, 2, 3),
sums AS (SELECT key, level, source, sum(length(h)) AS weight, count(*) AS n FROM src GROUP BY 1, 2, 3),
best AS (SELECT key, source AS parent_turn, n FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY level, weight DESC, source DESC) AS r FROM sums) WHERE r = 1),
a AS (SELECT conv_id, turn, min(parent_turn) AS parent_turn FROM best JOIN k USING (key) GROUP BY 1, 2),
up AS (SELECT conv_id, turn, parent_turn AS top FROM a UNION SELECT up.conv_id, up.turn, a.parent_turn FROM up JOIN a ON a.conv_id = up.conv_id AND a.turn = up.top),
root AS (SELECT conv_id, turn, min(top) AS top FROM up GROUP BY 1, 2),
own AS (SELECT key, string_agg(line, chr(10) ORDER BY pos) AS text FROM (SELECT *, lead(level) OVER (PARTITION BY key ORDER BY pos) AS below FROM b) WHERE level = 0 AND NOT (coalesce(below, 0) > 0 AND regexp_matches(line, '{_INTRO}', 'i')) GROUP BY 1),
q AS (SELECT key, count(*) FILTER (level > 0)::BIGINT AS n FROM b GROUP BY 1)
SELECT k.conv_id, coalesce(root.top, best.parent_turn, k.turn) AS thread_turn, k.turn, best.parent_turn, k.role, q.n AS n_quoted, coalesce(best.n, 0)::BIGINT AS n_linked, regexp_replace(coalesce(own.text, ''), '^\\s*\\n|\\s+$', '', 'g') AS text
FROM k LEFT JOIN best USING (key) LEFT JOIN root ON root.conv_id = k.conv_id AND root.turn = best.parent_turn LEFT JOIN own ON own.key = k.key LEFT JOIN q ON q.key = k.key"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it can express; the others are held against brute-force versions in tests/llm."""
    return {"op1_quote_linking": OP1_SQL, "op7_ngram_jaccard": OP7_SQL, "op11_lexical_scan": OP11_SQL, "op12_exact_dedup": OP12_SQL, "op13_source_audit": OP13_SQL}
