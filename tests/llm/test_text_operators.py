"""The operators over documents against brute-force versions, on texts of every awkward kind."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import common as C
from tessera.llm import neural_lm, ngram_join, order_minhash, packing, piece_viterbi, pii, pu_classifier, quality_rules, queries

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.01"
WORD = r"[^\x20\x09-\x0D]+"
LOWER = {c: c + 32 for c in range(65, 91)}


def rows_of(df):
    return sorted(df.collect(), key=lambda r: tuple(str(x) for x in r))


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def base_counts(text):
    w = re.findall(WORD, text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    c, hit = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if c[w[i], w[i + 1], w[i + 2]] > 1:
            hit |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text or ""), dup, len(hit)


def test_quality_counts_equal_brute_force(docs, no_docs, texts):
    got = by_id(quality_rules.judge(docs, None))
    for i, t in texts.items():
        assert tuple(got[i][c] for c in quality_rules.COUNTS) == base_counts(t), i
        n, *_, repeat = base_counts(t)
        assert got[i]["base_failed"] == (n < 50 or 100 * repeat > 50 * n) == (not got[i]["kept"])
    assert quality_rules.judge(no_docs, None).count() == 0


def test_trees_learn_and_keep_their_constraints():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] < 0.5) | (x[:, 2] > 0.9)).astype(float)
    trees = quality_rules.grow(x, y, [-1, 0, 0], trees=40)
    assert ((trees.score(x) >= 0.5) == y).mean() > 0.97
    grid = np.linspace(0, 1, 50)
    for a, b in ((0.2, 0.3), (0.7, 0.95)):
        s = trees.score(np.column_stack([grid, np.full(50, a), np.full(50, b)]))
        assert (np.diff(s) <= 1e-12).all()
    assert quality_rules.grow(x, np.ones(3000), [0, 0, 0]) is None


def labelled(spark, docs):
    bad = (14, 15, 16, 17)
    return spark.createDataFrame([(i, 0 if i in bad else 1, 0) for i in (*range(1, 5), 10, 14, 15, 16, 17, 18, 19, 20)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")


def docs_text(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


def test_shards_of_all_unlabelled_rows_are_learned_from(spark, monkeypatch):
    """Rows that the start never sees move the weights, whatever their ids; the same ones in each run."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(1, 1, (600, 14)), rng.normal(-1, 1, (600, 14))])
    stats = spark.createDataFrame([(*map(float, row), int(i)) for i, row in enumerate(x)], ", ".join([*(f"{c} double" for c in pu_classifier.INPUTS), "doc_id long"]))
    labels = spark.createDataFrame([(i, 1) for i in range(0, 300)] + [(5, 0)], "doc_id long, quality int")
    monkeypatch.setattr(pu_classifier, "START", 100)
    monkeypatch.setattr(pu_classifier, "SHARD", 200)
    seen = []
    fit = pu_classifier.fit
    monkeypatch.setattr(pu_classifier, "fit", lambda pos, unl, prior, **k: seen.append((len(pos), len(unl))) or fit(pos, unl, prior, **k))
    net = pu_classifier.train(stats, labels)
    trusted = [i for i in range(300) if i != 5 and zlib.crc32(str(i).encode()) % 5]
    assert seen[-1][0] == len(trusted) and 60 < seen[-1][1] < 150
    again = pu_classifier.train(stats.repartition(7), labels)
    np.testing.assert_allclose(net.w1, again.w1, atol=1e-9)
    rows = pu_classifier.score(stats, net).collect()
    assert len(rows) == 1200 and np.mean([(r["score"] >= 0.5) == (r["doc_id"] < 600) for r in rows]) > 0.95


def test_rules_and_classifier_on_awkward_rows(spark, docs, no_docs):
    labels = labelled(spark, docs)
    trees = quality_rules.train(docs, labels)
    kept = quality_rules.keep_good(docs, trees)
    assert kept.columns == docs.columns and {1, 2, 10, 18} <= {r["doc_id"] for r in kept.collect()}
    stats = pu_classifier.features(docs)
    net = pu_classifier.train(stats, labels)
    scored = pu_classifier.score(stats, net).collect()
    assert len(scored) == docs.where("doc_id is not null").count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in scored)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in scored)
    by = defaultdict(set)
    for r in scored:
        by[docs_text(docs)[r["doc_id"]]].add(r["score"])
    assert all(len(x) == 1 for x in by.values())  # equal texts, equal scores
    nothing = pu_classifier.features(no_docs)
    assert pu_classifier.train(nothing, labels) is None and pu_classifier.score(nothing, None).count() == 0 and pu_classifier.keep_good(docs, None).count() == docs.count()


def test_positive_unlabelled_learning_finds_prior_and_classes():
    rng = np.random.default_rng(1)
    pos = rng.normal(1.5, 1, (2000, 4))
    truth = rng.random(4000) < 0.7
    unl = np.where(truth[:, None], rng.normal(1.5, 1, (4000, 4)), rng.normal(-1.5, 1, (4000, 4)))
    prior = pu_classifier.class_prior(pos, unl)
    assert abs(prior - 0.7) < 0.06
    net = pu_classifier.fit(pos, unl, prior, epochs=20)
    assert ((net.score(unl) >= 0.5) == truth).mean() > 0.97


def test_held_out_quality_on_the_tables(spark):
    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no test tables")
    labels = {r["doc_id"]: r["quality"] for r in C.table(spark, "/root/testdata/sf0.01", "labels").collect()}
    for query, answer in ((queries.op3_pu_classifier, "predicted"), (queries.op5_quality_rules, None)):
        rows = [r for r in query(spark, "/root/testdata/sf0.01").collect() if r["doc_id"] in labels and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
        said = [(r[answer] if answer else int(r["score"] >= 0.3)) == labels[r["doc_id"]] for r in rows]
        assert len(said) > 30 and sum(said) / len(said) > 0.93


def edited(texts):
    ids = sorted(texts)
    for k, i in enumerate(ids):
        t, following = texts[i] or "", texts[ids[(k + 1) % len(ids)]] or ""
        n = len(t)
        yield i, n, t[: n - n // 2] + following[: n // 2]


def test_fingerprints(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("n_chars", F.lit(-1))
    got = by_id(order_minhash.compare(df))
    for i, n, e in edited(texts):
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (n, hashlib.sha256(e.encode("utf-8")).hexdigest()), i
        assert 0 <= got[i]["near_edited"] <= 1
    assert got[1]["fingerprint"] == got[2]["fingerprint"] != got[3]["fingerprint"] and got[1]["near_next"] == 1.0
    assert got[2]["near_next"] > 0.8 > 0.5 > got[3]["near_next"] and got[5]["fingerprint"] == got[6]["fingerprint"] == got[7]["fingerprint"] == ""
    assert order_minhash.compare(df.where("doc_id < 0")).count() == 0
    one = order_minhash.compare(df.where("doc_id = 1")).first()
    assert one["near_next"] == 1.0


def test_fingerprints_feel_order(spark):
    a = [f"w{i}" for i in range(400)]
    shuffled = sorted(a, key=lambda w: hashlib.md5(w.encode()).hexdigest())
    df = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(a[:200] + ["x"] + a[201:])), (3, " ".join(shuffled))], "id long, text string")
    prints = {r["id"]: set(r["p"]) for r in order_minhash.fingerprints(df, "text", "p").collect()}
    assert len(prints[1] & prints[2]) > 50 > 5 > len(prints[1] & prints[3])


def test_fingerprint_steps_equal_brute_force(spark):
    """Occurrence numbers and bins, with the same hash functions taken from Spark."""
    words = ["a", "b", "a", "b", "a", "c"] * 30
    df = spark.createDataFrame([(1, " ".join(words))], "id long, text string")
    got = order_minhash.fingerprints(df, "text", "p").first()["p"]
    h = [r[0] for r in spark.createDataFrame([(k, w) for k, w in enumerate(words)], "k long, w string").orderBy("k").select(F.xxhash64("w")).collect()]
    pairs = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(zip(h, h[1:]))], "k long, x long, y long")
    g = [r[0] for r in pairs.orderBy("k").select(F.xxhash64("x", "y")).collect()]
    seen, items = Counter(), []
    for k, x in enumerate(g):
        cut = (x % (1 << 64)) >> 25
        items.append((k, cut, seen[cut]))
        seen[cut] += 1
    ranks = spark.createDataFrame(items, "k long, g long, n int").orderBy("k").select(F.xxhash64("g", "n")).collect()
    bins = defaultdict(list)
    for (k, _, _), r in zip(items, ranks):
        rank = ((r[0] % (1 << 64)) >> 25) << 24 | k
        bins[rank >> 57].append(rank)
    want = []
    for b in sorted(bins):
        chosen = sorted(x & ((1 << 24) - 1) for x in sorted(bins[b])[:2])
        want.append((b, [g[k] for k in chosen]))
    single = spark.createDataFrame([(b, *x[:2], len(x)) if len(x) > 1 else (b, x[0], 0, 1) for b, x in want], "b long, x long, y long, n int").orderBy("b")
    codes = [r[0] for r in single.select(F.when(F.col("n") == 1, F.xxhash64("x")).otherwise(F.xxhash64("x", "y"))).collect()]
    assert got == [b << 32 | (c & 0xFFFFFFFF) for (b, _), c in zip(want, codes)]


def test_successors_of_sparse_values(spark):
    values = [-(2**40), -5, 0, 1, 2**17, 2**17 + 1, 2**50]
    got = {r["v"]: r["following"] for r in order_minhash.successors(spark.createDataFrame([(v,) for v in values * 2], "v long"), "v").collect()}
    assert got == dict(zip(values, [*values[1:], None]))


def tokens(text):
    return [w.translate(LOWER) for w in re.findall(WORD, text or "")] + ["\0end"]


def test_language_model_counts_equal_brute_force(docs, no_docs, texts):
    scored = neural_lm.score(docs).collect()
    got = {r["doc_id"]: r for r in scored}
    assert len(scored) == docs.where("doc_id is not null").count()
    all_rows = [(r["doc_id"], r["text"]) for r in docs.where("doc_id is not null").collect()]
    c = Counter(w for i, t in all_rows if zlib.crc32(str(i).encode()) % 10 for w in tokens(t))
    n, v = sum(c.values()), len(c)
    for i, t in texts.items():
        w = tokens(t)
        base = sum(np.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n), i
        assert got[i]["base_score"] == pytest.approx(base, rel=1e-9) and got[i]["score"] < 0
    assert neural_lm.score(no_docs).count() == 0


def test_language_model_scores_equal_a_full_sum(docs, texts):
    """Every text's score against chances worked out word by word; after any context the chances of all words and of an unseen one add up to one."""
    counts = neural_lm.frequent(neural_lm._counted(C.identified(docs)))
    net = neural_lm.train(C.identified(docs), counts)
    rows = [(r["doc_id"], r["text"]) for r in docs.where("doc_id is not null").collect()]
    c = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 10 for w in tokens(t))
    end = tokens("")[0]

    def place(word):
        if word == end:
            return 0
        _, h, shared = neural_lm.word_table([word.encode()])
        return int(neural_lm.classes_of(counts, h, shared)[0][0])

    classes = {w: place(w) for w in {x for t in texts.values() for x in tokens(t)} | set(c)}
    total = Counter()
    for w, k in c.items():
        total[classes[w]] += k
    unseen = 0.1 / (sum(c.values()) + 0.1 * (len(c) + 1))

    def after(second, first):
        z = net.word.astype(float) @ (net.first[first] + net.second[second]).astype(float) + net.bias
        return np.exp(z - z.max()) / np.exp(z - z.max()).sum()

    p = after(classes["two"], classes["three"])
    assert unseen + (1 - unseen) * sum(p[classes[w]] * k / total[classes[w]] for w, k in c.items()) == pytest.approx(1, abs=1e-5)
    got = {r["doc_id"]: r["score"] for r in neural_lm.score(docs).collect()}
    for i, t in texts.items():
        second = first = 0
        want = 0.0
        for w in tokens(t):
            k = classes[w]
            want += np.log10((1 - unseen) * after(second, first)[k] * c[w] / total[k]) if c[w] else np.log10(unseen)
            second, first = first if k else 0, k
        assert got[i] == pytest.approx(want, rel=1e-4, abs=1e-3), i


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_language_model_gains_on_known_words(spark):
    """On held-out texts of known words alone, the network is worth more than a tenth of a decade a token above the base."""
    scored = neural_lm.score(C.table(spark, SF, "documents").select("doc_id", "text")).where("held_out and n_known = n_tokens")
    got = scored.agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (got[0] - got[1]) / got[2] > 0.1


def test_network_is_normalised_and_learns():
    rng = np.random.default_rng(2)
    word, first, second = (rng.normal(0, 0.5, (20, 6)) for _ in range(3))
    net = neural_lm.Network(word, first, second, rng.normal(0, 1, 20))
    for a, b in ((0, 0), (3, 7), (19, 2)):
        assert np.exp(net.log_chance(np.full(20, b), np.full(20, a), np.arange(20))).sum() == pytest.approx(1, abs=1e-4)
    run = np.tile([1, 2, 3, 0], 4000)
    fitted = neural_lm.fit(run, np.bincount(run, minlength=5).astype(float), epochs=3)
    assert fitted.log_chance(np.array([0]), np.array([1]), np.array([2]))[0] > np.log(0.7)


def brute_components(texts):
    sets, root = {}, {}
    for i, t in texts.items():
        w = tokens(t)[:-1]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        root[i] = i

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_ngram_links_equal_brute_force(docs, no_docs, texts):
    got = ngram_join.link(docs).collect()
    assert len(got) == docs.where("doc_id is not null").count()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(texts)
    assert ngram_join.link(no_docs).count() == 0


def test_ngram_links_in_groups_of_near_copies(spark):
    """Chains, stars and look-alikes at the edge of the threshold, with a passage that all share."""
    rng = np.random.default_rng(5)
    shared = " ".join(f"s{k}" for k in range(60))
    texts, i = {}, 1
    for g in range(4):
        base = [f"g{g}w{k}" for k in range(80 + 15 * g)]
        for _ in range(25):
            w = list(base)
            for k in rng.choice(len(w), rng.integers(0, 12), replace=False):
                w[k] = f"e{rng.integers(1 << 30)}"
            if rng.random() < 0.3:
                w = w[: len(w) - rng.integers(0, 25)]
            texts[i] = " ".join(w)
            i += 1
        texts[i] = shared + " " + " ".join(base[:30])
        i += 1
    chain = [f"c{k}" for k in range(100)]
    for k in range(8):
        texts[i] = " ".join(chain[: 100 - 0] if not k else [f"n{j}" for j in range(k * 3)] + chain[k * 3 :])
        i += 1
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link(df).collect()} == brute_components(texts)


@given(st.sets(st.integers(0, 2**63 - 1), min_size=1, max_size=80), st.sets(st.integers(0, 2**63 - 1), max_size=20))
@settings(max_examples=60, deadline=None)
def test_parity_sketch_bounds_the_difference(a, more):
    b = set(list(a)[: len(a) // 2]) | more or {1}
    x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
    of = ngram_join.band(max(len(a), len(b)))
    differ = sum(bin(int(p) & (2**64 - 1)).count("1") for p in ngram_join.parity(x, of) ^ ngram_join.parity(y, of))
    assert differ <= len(a ^ b)


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@given(st.text(alphabet=st.sampled_from("  ▁▁aeths-=.0\n\t\x00éßе中ﬁ\U0001f600"), max_size=80))
@settings(max_examples=200, deadline=None)
def test_pieces_are_those_of_the_library(text):
    pieces = piece_viterbi.load(public_tokenizers.path("piece_bpe_32k.model"))
    assert np.frombuffer(pieces.encode([text])[0], np.int32).tolist() == library().encode(text)


def test_piece_segmentation_equals_merging():
    """Merging by rank, step by step, and the only path without a bad border, by trying all, give the same."""
    pieces = piece_viterbi.load(public_tokenizers.path("piece_bpe_32k.model"))

    def paths(word):
        for k in range(1, len(word) + 1):
            if word[:k] in pieces.made or k == 1:
                yield from ([word[:k], *rest] for rest in (paths(word[k:]) if k < len(word) else [[]]))

    for word in ("▁the", "▁thththonwh", "▁réaile", "▁", "▁▁▁▁▁a", "▁a中\nb", "▁Xx\U0001f600", "▁inform"):
        parts = list(word)
        while True:
            best = min(((pieces.rank.get(x + y, np.inf), k) for k, (x, y) in enumerate(zip(parts, parts[1:]))), default=(np.inf, 0))
            if best[0] == np.inf:
                break
            parts[best[1] : best[1] + 2] = ["".join(parts[best[1] : best[1] + 2])]
        good = [p for p in paths(word) if all(pieces.apart(x, y) for x, y in zip(p, p[1:]))]
        assert good == [parts], word
        ids = [i for p in parts for i in ([pieces.id[p]] if p in pieces.id else [pieces.byte_id[b] for b in p.encode()])]
        assert pieces.segment([word])[word] == ids


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pieces_of_the_tables_are_those_of_the_library(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = {i: ids for i, ids in zip(texts, library().encode([t or "" for t in texts.values()], num_threads=1))}
    got = piece_viterbi.encode(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert len(got) == len(want) and all(r["ids"] == want[r["doc_id"]] for r in got)


def test_shared_prefixes_change_nothing():
    pieces = piece_viterbi.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    words = [f"▁{w}" for w in "the then thenceforth a an and andes zebra th there".split()]
    together = pieces.segment(words)
    assert all(together[w] == pieces.segment([w])[w] for w in words)


def test_pieces_round_trip(docs, no_docs, texts):
    path = public_tokenizers.path("piece_bpe_32k.model")
    back = by_id(piece_viterbi.decode(piece_viterbi.encode(docs, path), path))
    assert all(back[i]["text"] == (t or "") for i, t in texts.items())
    digest = by_id(piece_viterbi.digests(docs, path))
    assert all(r["round_trip"] for r in digest.values()) and digest[5]["n_pieces"] == 0
    assert piece_viterbi.digests(no_docs, path).count() == 0


BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def base_spans(text):
    def fits(kind, s):
        digits = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            return 14 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in (int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits)))) % 10 == 0
        return kind == "email" or 10 <= len(digits) <= 15

    found = [(m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(BASE) for m in re.finditer(p, text or "") if fits(kind, m[0])]
    return [(s, e, kind) for s, _, kind, e in sorted(found)]


@given(st.text(alphabet="a@.1+4 -()%_\n5", max_size=60))
@settings(max_examples=300, deadline=None)
def test_base_spans_equal_the_patterns(text):
    got = [s for s in pii.find(text, pii.automaton()) if s[2] in ("email", "ip", "card", "phone")]
    assert got == base_spans(text)


def test_personal_data(docs, no_docs, texts):
    got = by_id(pii.detect(docs))
    for i, t in texts.items():
        spans = [(s["start"], s["end"], s["kind"]) for s in got[i]["spans"]]
        assert [s for s in spans if s[2] in ("email", "ip", "card", "phone")] == base_spans(t)
    assert {s["kind"] for s in got[12]["spans"]} == set(pii.KINDS)
    clean = pii.redact(docs)
    assert clean.schema == docs.schema and "4111" not in by_id(clean.where("doc_id = 12"))[12]["text"] and clean.where("doc_id = 6").first()["text"] is None
    assert pii.detect(no_docs).count() == 0


def test_packing(docs, no_docs, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizers = pytest.importorskip("tokenizers")
    whole = tokenizers.Tokenizer.from_file(path)
    rows = packing.pack(docs.where("doc_id <> 20"), path, group_pieces=8).collect()
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    for i, t in texts.items():
        if i == 20:
            continue
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    windows = defaultdict(list)
    for r in rows:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(no_docs, path).count() == 0
    assert packing.pack(docs.where("doc_id = 20"), path).count() == 2 * packing.pack(docs.where("doc_id = 19"), path).count()


@given(st.lists(st.integers(1, 1024), min_size=1, max_size=60), st.integers(1, 12))
@settings(max_examples=80, deadline=None)
def test_differencing_places_every_item_and_is_even(sizes, windows):
    of = packing.differencing(np.array(sizes), windows)
    sums = np.bincount(of, sizes, windows)
    assert len(of) == len(sizes) and of.max() < windows and sums.max() <= sum(sizes) / windows + max(sizes)


def test_words_are_tokenized_as_the_whole_text_is():
    path = public_tokenizers.path("byte_bpe_50k.json")
    mine = packing.WordTokenizer(path)
    for t in ["a  b", " a", "a ", "tab\t b", "a\n b", "a  b", "don't stop. 3.5% ok!! é,", "x\x1cy z", "", "…", "a,b. c-d 'll", "中文 字。"]:
        assert np.frombuffer(mine.encode([t])[0], "<u4").tolist() == mine.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_word_hashes_follow_the_words():
    long = b"ab" * 70_000
    w = C.Words([b"a b a", b"", b"  b\t\xc3\xa9", long + b" " + long])
    h = w.hashes()
    assert w.count.tolist() == [3, 0, 2, 2] and h[0] == h[2] != h[1] == h[3] and h[5] == h[6]
    keys = w.text_keys(np.array([1, 1, 1, 1]))
    assert len(set(keys.tolist())) == 4


def test_network_learns_from_ends_of_texts_and_from_all_ids(spark, monkeypatch):
    monkeypatch.setattr(neural_lm, "TOKENS", 18_000)
    monkeypatch.setattr(neural_lm, "SHARD", 20_000, raising=False)
    tailed = [(i, "alpha beta " * 1000 + "gamma delta " * 1000) for i in range(1, 11)]
    late = [(i, "mu nu " * 150) for i in range(1001, 1041)]
    docs = spark.createDataFrame(tailed + late, "doc_id long, text string").repartition(3)
    counts = neural_lm.frequent(neural_lm._counted(docs))
    net = neural_lm.train(docs, counts)

    def chance(second, first, word):
        _, h, _ = neural_lm.word_table([f"{second} {first} {word}".encode()])
        c2, c1, c = neural_lm.classes_of(counts, h, np.zeros(3, np.int64))[0]
        return np.exp(net.log_chance(*(np.array([x]) for x in (c2, c1, c))))[0]

    assert chance("delta", "gamma", "delta") > 0.7 and chance("nu", "mu", "nu") > 0.7
    again = neural_lm.train(docs.repartition(5), counts)
    assert all(np.array_equal(getattr(net, k), getattr(again, k)) for k in ("word", "first", "second", "bias"))
    shards = neural_lm._by_shard(docs.where(neural_lm.C.fold("doc_id", 10) != 0), counts, 3).collect()
    assert sum(len(r["classes"]) // 2 - 2 for r in shards) == counts.total and len({r["shard"] for r in shards}) == 3


def test_every_piece_of_a_long_text_keeps_what_stands_before_it(spark, monkeypatch):
    text = " ".join(f"w{i % 7} x{i % 5}" for i in range(900))
    docs = spark.createDataFrame([(1, text), (1, text), (3, None), (4, "a b")], "doc_id long, text string").coalesce(1)
    counts = neural_lm.frequent(neural_lm._counted(docs))
    classes, stop = neural_lm._runs_of([text.encode()] * 2 + [b"", b"a b"], counts)
    monkeypatch.setattr(neural_lm, "PIECE", 100)
    runs = [np.frombuffer(r["classes"], "<i2") for r in neural_lm._by_shard(docs, counts, 4).collect()]
    got = np.concatenate([neural_lm.ngrams(r[2:], r[:2]) for r in runs])
    assert sorted(got) == sorted(neural_lm.ngrams(classes)) and stop[-1] == counts.total
    rows = np.array([3, 1, 3, 2] + [5] * 40)
    grad = np.arange(len(rows) * 2, dtype=np.float32).reshape(-1, 2)
    at, sums = neural_lm.summed_by(rows, grad)
    assert at.tolist() == [1, 2, 3, 5] and all(np.array_equal(s, grad[rows == r].sum(0)) for r, s in zip(at, sums, strict=True))
