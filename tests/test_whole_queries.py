"""The queries that SQL can't follow, on every row of a small table, against plain Python."""

import re

import pytest

from tessera.operators import chunking
from tessera.plans import corpus_plans

TEXTS = {
    7: "# Heading of its own\nline one\n\nline two", 8: "no heading\n" + "word " * 30, 9: "y" * 1200, 51: "## A\nx", 52: "short", 57: "z " * 600 + "\n# late", 101: "tail " * 20 + "E = mc2 and g(q)",
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in TEXTS.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path


def rows(spark, folder, name, key):
    return {r[key]: r for r in corpus_plans.Q[name](spark, folder).collect()}


def test_summaries_of_all_documents(spark, folder):
    got = rows(spark, folder, "i4_document_summaries_whole", "source_ref")
    assert set(got) == {str(i) for i in TEXTS}
    for i, t in TEXTS.items():
        heading = re.search(r"(?m)^#{1,6}\s+(.+)$", t[:500])
        lines = [x for x in t[:500].split("\n") if x.strip(" ") and not re.match(r"\s*#", x)]
        n = (len(t) - 1) // 450 + 1
        want = (heading[1] if heading else t[:500].split("\n")[0].strip(" "), "summary 2" if n > 2 else " ".join(lines)[:500], "EN", n)
        assert tuple(got[str(i)][c] for c in ("title", "summary", "tags", "n_chunks")) == want, i


def test_sections_of_all_documents(spark, folder):
    got = {}
    for r in sorted(corpus_plans.Q["c3_markdown_sections_whole"](spark, folder).collect()):
        got.setdefault(r["id"], []).append(r["text"])
    for i, t in TEXTS.items():
        parts = re.split(r"(?m)(?=^#{1,6}\s)", t.replace("\n", "\n## "))
        parts = parts[1:] if len(parts) > 1 and not parts[0] else parts
        parts = parts[1:] if len(parts) > 1 and not parts[0].startswith("#") else parts
        assert got[i] == [p.strip() for p in parts if p.strip()], i
    assert set(got) == set(TEXTS)


def test_captions_of_all_documents(spark, folder):
    got = rows(spark, folder, "b16_stitch_captions_whole", "id")
    assert set(got) == set(TEXTS)
    known = {i % 7 for i in TEXTS}
    for i in TEXTS:
        refs = [i % 50, i % 7]
        assert got[i]["n_captions"] == sum(k in known for k in refs), i
        end = " and ".join(f"[IMAGE: i{k}]" + (f"\n(Description: no {k})" if k in known else "") for k in refs)
        assert got[i]["text"].endswith(f" {end}"), i


def test_captions_stand_behind_whole_texts(spark, folder):
    got = rows(spark, folder, "b16_stitch_captions_whole", "id")
    assert all(got[i]["text"].startswith(t + " [IMAGE: i") for i, t in TEXTS.items())


def test_formulas_beyond_the_start_are_found(spark, folder):
    got = rows(spark, folder, "h1_detect_formulas_whole", "doc_id")
    assert set(got) == set(TEXTS) and {"E = mc2", "g(q)", "x_101", "f(2)"} <= set(got[101]["formulas"].split("|"))


def test_whole_texts_are_fenced_and_wrapped(spark, folder):
    got = {}
    for r in sorted(corpus_plans.Q["c5_to_c7_runs"](spark, folder).collect()):
        got.setdefault(r["id"], []).append(r["text"])
    for i, t in TEXTS.items():
        if i % 3 == 0:
            assert f"```\n{t}\n```" in "\n".join(got[i]), i
        if i % 3 == 1:
            assert sum(c.count(t.replace("\n", "\\n")) for c in got[i]) == 2, i


def test_chunks_leave_in_small_batches(monkeypatch):
    """A batch of texts is not cut as a whole: chunks leave before the next texts are cut, with the same rows in the same order."""
    import pyarrow as pa

    class Rows:
        dtypes = [("id", "bigint")]

        def mapInArrow(self, run, schema):  # noqa: N802
            self.run = run
            return self

    monkeypatch.setattr(chunking, "HELD_CHARS", 1000)
    cuts = []
    work = chunking._in_batches(Rows(), lambda t: cuts.append(t) or enumerate([t[:300], t[300:]]), "chunk_index long, text string")
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(50), pa.int64()), "text": [f"{n}".zfill(600) for n in range(50)]})
    out = work.run(iter([batch, batch.slice(0, 0)]))
    first = next(out)
    assert len(cuts) < 5 and first.num_rows < 10
    rows = [r for b in (first, *out) for r in b.to_pylist()]
    assert [(r["id"], r["chunk_index"]) for r in rows] == [(n, k) for n in range(50) for k in (0, 1)]
    assert all(r["text"] == (f"{r['id']}".zfill(600)[:300] if r["chunk_index"] == 0 else f"{r['id']}".zfill(600)[300:]) for r in rows)
