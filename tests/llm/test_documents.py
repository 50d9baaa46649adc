"""Operators on documents against brute force, and their edge cases."""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from factloom.llm import components, exact_dedup, jaccard, language, mixing, queries, quality
from tests.check_queries import compare, connect

FOLDER = "/root/testdata/sf0.001"
BASE = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split()
#: doc_id, text, and columns that clash with names used inside
ODD = [
    (1, " ".join(BASE * 9), "en", "s1"), (2, " ".join(BASE * 9) + " end", "en", "s1"), (3, " ".join(BASE * 9).upper(), None, "s2"), (4, None, "de", "s1"),
    (5, "", "en", None), (6, "two words", "en", "s2"), (7, "Two\tWORDS", "fr", ""), (8, "12 34 !!", None, None), (9, "word " * 30000, "en", "s1"),
    (None, "no id here at all", "en", "s1"), (None, "no id here at all", None, "s1"), (10, "two words", "en", "s2"), (10, "two words", "en", "s2"),
    (11, " \n\t ", "en", "s2"), (12, "été " * 40, "fr", "s3"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    clash = "'k' AS key", "7 AS n", "'b' AS body", "1 AS size", "'c' AS cell", "0 AS label", "'x' AS node", "2 AS score", "3 AS target"
    return spark.createDataFrame(ODD, SCHEMA).selectExpr("*", *clash)


def linked(texts: dict, words: int = 3, percent: int = 90) -> dict:
    """doc -> (number of shingles, smallest linked doc), by comparing all pairs that share a shingle."""
    sets = {}
    for k, text in texts.items():
        w = (text or "").encode().lower().split()
        sets[k] = frozenset(tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    holders = defaultdict(list)
    for k, s in sets.items():
        shared = defaultdict(int)
        for t in s:
            for other in holders[t]:
                shared[other] += 1
            holders[t].append(k)
        for other, both in shared.items():
            if 100 * both >= percent * (len(s) + len(sets[other]) - both):
                a, b = root(k), root(other)
                parent[max(a, b)] = min(a, b)
    return {k: (len(sets[k]), root(k)) for k in sets}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, FOLDER), connect(FOLDER).sql(queries.ORACLES[name]), []) is None


def test_all_are_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert "pipeline" in entry.queries()


@pytest.mark.parametrize("words, percent", [(3, 90), (5, 80), (1, 60)])
def test_jaccard(spark, words, percent):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    pick = np.random.default_rng(3)
    for k in range(150):  # copies of one text, each with some words changed
        w = texts[1].split()[:60] or BASE
        for at in pick.integers(0, len(w), int(pick.integers(0, 7))):
            w[at] = f"new{pick.integers(9)}"
        texts[10_000 + k] = " ".join(w)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    like = jaccard.Similarity(words, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_components(docs, like=like, common=20).collect()}
    assert got == linked(texts, words, percent)
    kept = {r.doc_id for r in jaccard.one_of_each(docs, like=like).collect()}
    assert kept == {k for _, k in linked(texts, words, percent).values()}


def test_jaccard_rows_that_share_an_id(spark):
    """Each row is a document: an id that different texts share links none of them, and links of one text name no other."""
    a, b = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    rows = [(5, " ".join(a)), (5, " ".join(b)), (3, " ".join(a[:-1] + ["x"])), (2, " ".join(b)), (9, " ".join(b[:-1] + ["y"])), (9, ""), (8, "p q r"), (8, "s t u"),
            (1, ""), (1, "v w"), (None, "v w"), (7, " ".join(f"c{i}" for i in range(60)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard.similar_components(docs).filter("doc_id IS NOT NULL").collect())
    assert got == [(1, 0, 1), (1, 1, 1), (2, 58, 2), (3, 58, 3), (5, 58, 2), (5, 58, 3), (7, 58, 7), (8, 1, 8), (8, 1, 8), (9, 0, 9), (9, 58, 2)]
    kept = {(r.doc_id, r.text) for r in jaccard.one_of_each(docs).collect()}
    assert kept == {rows[k] for k in (2, 3, 5, 6, 7, 8, 9, 10, 11)}


def test_jaccard_tiles(spark, monkeypatch):
    """Large groups go through several tiles, and very common shingles do not decide the result."""
    monkeypatch.setattr(jaccard, "MAP_TILE", 16)
    monkeypatch.setattr(jaccard, "TEXT_TILE", 16)
    pick, texts = np.random.default_rng(5), {}
    for k in range(200):
        w = [f"w{i}" for i in range(80)]
        for at in pick.integers(0, 80, int(pick.integers(0, 4))):
            w[at] = f"x{k}"
        texts[k] = " ".join(w)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_components(docs, common=8).collect()}
    assert got == linked(texts)


@pytest.mark.parametrize("chain", [0, 60])
def test_jaccard_representatives(spark, monkeypatch, chain):
    """A large component of near copies with strangers that only share its bitmaps, and a long chain of links through it:
    classes that no representative reaches are still found, and near copies do not meet in pairs of tiles."""
    monkeypatch.setattr(jaccard, "TEXT_TILE", 8)
    monkeypatch.setattr(jaccard, "REPRESENTATIVES", 2)
    pick, texts = np.random.default_rng(6), {}
    for k in range(150):
        w = [f"w{i}" for i in range(100)]
        w[int(pick.integers(0, 100))] = f"x{k}"
        texts[k] = " ".join(w)
    words = [f"w{i}" for i in range(100)]
    for k in range(chain):  # each differs from the one before in one word, so the ends have nothing in common
        words[k] = f"c{k}"
        texts[1000 + k] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_components(docs).collect()} == linked(texts)


def test_jaccard_members_of_all_classes(spark, monkeypatch):
    """One presumed component of several real ones: exact classes, whichever members represent it."""
    monkeypatch.setattr(jaccard, "TEXT_TILE", 4)
    pick, texts = np.random.default_rng(1), {}
    for k in range(120):
        base, w = k % 7 if k % 3 else 0, []
        w = [f"b{base}w{i}" for i in range(60)]
        for at in pick.integers(0, 60, int(pick.integers(0, 3))):
            w[at] = f"y{pick.integers(5)}"
        texts[k] = " ".join(w)
    rows = spark.createDataFrame([(1, k, t) for k, t in texts.items()] + [(2, 900, "a b c d"), (2, 901, "a b c d")], "key long, node long, text string")
    for chosen in (1, 3):
        monkeypatch.setattr(jaccard, "REPRESENTATIVES", chosen)
        found = components.components(jaccard.linked_members(rows, jaccard.Similarity())).collect()
        got = {k: k for k in [*texts, 900, 901]} | {r.node: r.label for r in found}
        assert got == {k: c for k, (_, c) in linked(texts | {900: "a b c d", 901: "a b c d"}).items()}


def test_jaccard_edges(spark, odd):
    rows = jaccard.similar_components(odd).collect()
    assert len(rows) == len(ODD)
    got = {(r.doc_id, r.n_shingles): r.component_id for r in rows}
    assert got[1, 26] == 1 and got[2, 27] == 1 and got[3, 26] == 1
    assert got[4, 0] == 4 and got[5, 0] == 5 and got[11, 0] == 11  # nothing links with nothing
    assert got[6, 1] == got[7, 1] == got[10, 1] == 6
    assert got[None, 3] is None
    assert jaccard.similar_components(odd.limit(0)).collect() == []


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (101, 100), (200, 200), (103, 101)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 103: 100, 200: 200}


def test_exact_dedup(spark, odd):
    rows = [r.asDict() for r in exact_dedup.mark_copies(odd).collect()]
    assert len(rows) == len(ODD)
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in rows if r["doc_id"] in (4, 5, 6, 7, 10)) == [
        (4, 5, 2, False), (5, 5, 2, True), (6, 10, 3, False), (7, 7, 1, True), (10, 10, 3, False), (10, 10, 3, True)]
    assert sorted((r["keep_id"], r["kept"]) for r in rows if r["doc_id"] is None) == [(None, False), (None, True)]
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns
    assert len({r.text or "" for r in kept.collect()}) == kept.count() == len({t or "" for _, t, *_ in ODD})
    assert exact_dedup.mark_copies(odd.limit(0)).collect() == []


def test_names_used_inside_may_clash(spark):
    """Columns of the table that are named like those used inside stay as they are."""
    names = "__digest __id __none __dropped __p __taken __copy __text __size digest identity none row doc i s h copy turn body".split()
    docs = spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(["one text here", "one text here", "another text there", None])], "doc_id long, text string, lang string, source string")
    docs = docs.selectExpr("*", *[f"concat('{n}', doc_id) AS `{n}`" for n in names])
    model = language.train(docs)
    for made in (exact_dedup.drop_copies(docs), jaccard.one_of_each(docs), mixing.mix(docs), language.identify(docs, model)):
        rows = made.collect()
        assert rows and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names), made.columns
    assert len(exact_dedup.mark_copies(docs).collect()) == 4


def test_mixing(spark, odd):
    rows = mixing.plan_mix(odd, part_rows=2).collect()
    assert len(rows) == len(ODD)
    taken = defaultdict(int)
    for r in rows:
        taken[r.source, r.source_size, r.target] += r.taken
        assert 0 <= r.taken <= 3 * r["size"]
    assert {s for s, *_ in taken} == {None, "", "s1", "s2", "s3"}
    for (_, size, target), words in taken.items():
        assert words == int(target) and target <= 3 * size
    assert abs(sum(t for _, _, t in taken) - sum(s for _, s, _ in taken)) < 1e-6
    assert sorted(rows, key=repr) == sorted(mixing.plan_mix(odd.repartition(5), part_rows=3).collect(), key=repr)
    assert mixing.plan_mix(odd.limit(0)).collect() == []
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns
    words = defaultdict(int)
    for r in mixed.collect():
        words[r.source] += len((r.text or "").encode().split())
    assert words == {s: w for (s, *_), w in taken.items() if w}


def test_language(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = queries.QUERIES["op9_language"](spark, "/root/testdata/sf0.01").collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {k for k in truth if zlib.crc32(str(k).encode()) % 3 == 1}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98
    model = language.train(docs)
    got = {r.doc_id: (r["__lang"], r["__score"], r["__rejected"]) for r in language.identify(odd, model).collect()}
    for k in (4, 5, 8, 11):
        assert got[k] == ("und", 0.0, True)
    assert all(0 <= score <= 1 for _, score, _ in got.values())
    assert model.predict("кириллица здесь")[2]
    again = language.train(docs.repartition(7))
    assert again.languages == model.languages and np.allclose(again.centroids, model.centroids, atol=1e-5)
    assert language.identify(odd.limit(0), model).collect() == []
    assert language.train(odd.limit(0)).predict("text") == ("und", 0.0, True)


@pytest.mark.parametrize("blank", [0, 3000])
def test_language_of_copies(spark, monkeypatch, blank):
    """One text many thousand times, or many texts without a letter, leave the other texts of a small language in the sample."""
    base = [f"{a}{b} kuva talo {b}{a}" for a in ("ba", "ko", "mi", "su", "te", "ra") for b in ("lo", "na", "pi", "se", "tu")]
    numbers = [(f"{k} {k * 7}", "xx") for k in range(blank)]
    rows = [("kaikki muut tekstit", "xx")] * 20_000 + [(t, "xx") for t in base] + numbers + [("the other language of the two", "yy")] * 3
    docs = spark.createDataFrame(rows, "text string, lang string")
    once = spark.createDataFrame(sorted(set(rows) - set(numbers)), "text string, lang string")
    monkeypatch.setattr(language, "_document_frequencies", lambda texts: np.ones(language.WIDTH + 1))
    for sample in (4, 384):
        model, want = language.train(docs, sample=sample), language.train(once, sample=sample)
        assert model.languages == want.languages and set(model.languages) == {"xx", "yy"}
        assert np.allclose(model.centroids, want.centroids) and np.allclose(model.least, want.least)


@pytest.mark.parametrize("text", ["ab cd ef ghx  ijkl -- m", " 12 ", "", "é", "a" * 20, "  x  y  "])
def test_gram_counts_of_slices(monkeypatch, text):
    """Grams go on from slice to slice: the counts do not depend on where a text is cut."""
    want, counts = language.gram_counts(text)
    for size in range(1, 9):
        monkeypatch.setattr(language, "SLICE", size)
        found, same = language.gram_counts(text)
        assert found.tolist() == want.tolist() and same.tolist() == counts.tolist()


def plain_grams(text):
    """Letter 1- to 3-grams, with one mark (a space) for what is no letter."""
    marked = " " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + " "
    marked = re.sub(" +", " ", marked)
    if not marked.strip():
        return {}
    made = defaultdict(int)
    for n in (1, 2, 3):
        for k in range(len(marked) - n + 1):
            if n > 1 or marked[k] != " ":
                made[marked[k:k + n]] += 1
    return made


def test_language_cosine(spark):
    """Scores are the cosines of plain dictionaries of grams: document frequencies of all texts, clusters of the same ones."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = [(r.text, r.lang) for r in docs.collect() if r.text is not None and r.lang is not None]
    model = language.train(docs)
    grams, n = [plain_grams(t) for t, _ in texts], len(texts)
    places = {}

    def place(gram):
        if gram not in places:
            codes = np.array([0 if c == " " else ord(c) for c in gram], np.uint64)
            if len(codes) == 1:
                places[gram] = int(language._grams(codes)[0])
            else:
                both = language._grams(codes)
                places[gram] = int(both[-1])
        return places[gram]

    frequency = defaultdict(int)
    for g in grams:
        for b in {place(x) for x in g}:
            frequency[b] += 1

    def vector(g):
        counts = defaultdict(int)
        for gram, m in g.items():
            counts[place(gram)] += m
        weights = {b: (1 + math.log(m)) * (math.log((1 + n) / (1 + frequency[b])) + 1) for b, m in counts.items()}
        length = math.sqrt(sum(w * w for w in weights.values()))
        return {b: w / length for b, w in weights.items()}

    centroids = [{int(b): float(c[b]) for b in np.flatnonzero(c)} for c in model.centroids.T]
    for (text, _), g in list(zip(texts, grams))[::7]:
        got = model.predict(text)
        if not g:
            assert got == ("und", 0.0, True)
            continue
        v = vector(g)
        likeness = [sum(w * c.get(b, 0.0) for b, w in v.items()) for c in centroids]
        assert got[1] == pytest.approx(min(max(likeness), 1.0), abs=1e-5)
        assert max(x for x, l in zip(likeness, model.languages) if l == got[0]) == pytest.approx(max(likeness), abs=1e-5)
    # the first round of clustering, on plain lists
    few = [vector(g) for g, (_, l) in zip(grams, texts) if l == "de" and g][:20]
    dense = np.zeros((len(few), language.WIDTH))
    for k, v in enumerate(few):
        dense[k, list(v)] = list(v.values())
    made = language.cluster(dense, 2, rounds=1)
    start = int(np.argmax(dense @ dense.mean(axis=0)))
    other = int(np.argmin(dense @ dense[start]))
    near = [0 if sum(a * b for a, b in zip(x, dense[start])) >= sum(a * b for a, b in zip(x, dense[other])) else 1 for x in dense]
    for k in (0, 1):
        mean = dense[[i for i, m in enumerate(near) if m == k]].mean(axis=0)
        assert np.allclose(made[k], mean / np.linalg.norm(mean))


def test_mixing_loses_no_words(spark):
    """Rows that share ids, or have none, and equal rows in great number: every source gives the words of its plan."""
    words = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    rows = [(7, words(k, 10), "s1") for k in range(5)] + [(None, words(k, 3 + k), "s1") for k in range(9)] + [(8, "the same text", "s2")] * 300
    rows += [(None, "no id, same text", "s2")] * 50 + [(None, "x", None)] * 4 + [(k, words(k, 40), "s3") for k in range(20, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS copy", "2 AS size", "3 AS doc", "4 AS __taken").repartition(6)
    plan = mixing.plan_mix(docs, part_rows=16).collect()
    targets = {r.source: int(r.target) for r in plan}
    mixed = mixing.mix(docs, part_rows=16)
    assert mixed.columns == docs.columns
    got, cut = defaultdict(int), defaultdict(int)
    for r in mixed.collect():
        got[r.source] += len(r.text.split())
        cut[r.source] += (r.doc_id, r.text, r.source) not in set(rows)
    assert got == {s: t for s, t in targets.items() if t}
    assert max(cut.values()) <= 1  # whole rows first, and one cut
    first = [r.taken for r in plan if r.doc_id is None and r.source == "s1"]
    assert len(set(first)) > 1


def test_quality(spark, odd):
    folder = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op10_quality"](spark, folder).collect()
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    good = np.array([r.score for r in held if truth.get(r.doc_id) == 1])
    bad = np.array([r.score for r in held if truth.get(r.doc_id) == 0])
    assert np.mean(good[:, None] > bad[None]) > 0.98
    assert all(r.predicted == (r.score >= 0.3) for r in rows)
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (4, 1), (4, 0), (None, 1), (9, 0), (12, 5)], "doc_id long, quality int")
    scored = quality.score_quality(odd, labels).collect()
    assert len(scored) == len(ODD) and all(0 <= r.score <= 1 for r in scored)
    assert quality.score_quality(odd.limit(0), labels).collect() == []
    assert all(r.score == pytest.approx(0.3) for r in quality.score_quality(odd, labels.limit(0)).collect())


def test_quality_sample_is_full(spark):
    """Repeated labels and labels of other documents take no places in the sample."""
    docs = spark.createDataFrame([(k, f"text {k} " + "Word, " * (k % 7) + "!" * (k % 5)) for k in range(60)], "doc_id long, text string")
    clean = spark.createDataFrame([(k, int(k % 5 < 2)) for k in range(60)], "doc_id long, quality int")
    other = spark.createDataFrame([(k, k % 2) for k in range(1000, 3000)], "doc_id long, quality int")
    measured = quality.measure(docs).cache()
    want = quality.train(measured, clean, sample=20)
    for labels in (clean.unionByName(other), clean.crossJoin(spark.range(300)).drop("id")):
        got = quality.train(measured, labels, sample=20)
        assert np.allclose(got.weights, want.weights) and np.isclose(got.offset, want.offset)
    assert want.weights.any()


def test_worths_by_plain_gradient(spark):
    """The weights are where a plain gradient of the same loss on the same pairs vanishes."""
    pick = np.random.default_rng(2)
    x = pick.normal(size=(60, 3))
    label = (x @ np.array([1.0, -2.0, 0.5]) + pick.normal(size=60) > 0).astype(int)
    model = quality.learn(x, label)
    again = quality.learn(x, label)
    assert np.allclose(model.weights, again.weights)
    scores = model.scores(x)
    # scores rise with the worth, a linear function of the features
    worth = x @ np.linalg.lstsq(np.column_stack([x, np.ones(60)]), np.log(scores / (1 - scores)), rcond=None)[0][:3]
    assert (np.argsort(worth, kind="stable") == np.argsort(scores, kind="stable")).all()


def test_pairwise_ranking_orders_by_preference():
    pick = np.random.default_rng(0)
    x = pick.normal(size=(400, 5))
    label = (x @ np.array([2, -1, 0, 0.5, 0]) + 0.1 * pick.normal(size=400) > 0.5).astype(int)
    scores = quality.learn(x, label).scores(x)
    assert np.mean(scores[label == 1][:, None] > scores[label == 0][None]) > 0.99
    assert abs(np.mean(scores >= quality.CUT) - label.mean()) < 0.02


def test_pipeline(spark, tmp_path):
    """Stage by stage against plain Python on the stage's own input."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.collect()
        assert docs.columns == columns
        if name == "language":
            lost = {r.doc_id for r in before} - {r.doc_id for r in after}
            assert all(not any(c.isalpha() for c in r.text or "") for r in before if r.doc_id in lost)
        elif name == "exact_dedup":
            best = {}
            for r in before:
                best[r.text or ""] = max(best.get(r.text or "", r.doc_id), r.doc_id)
            assert sorted(r.doc_id for r in after) == sorted(best.values())
        elif name == "jaccard_join":
            assert sorted(r.doc_id for r in after) == sorted({k for _, k in linked({r.doc_id: r.text for r in before}, 5, 80).values()})
        else:
            plan = {r.doc_id: r for r in mixing.plan_mix(spark.createDataFrame(before)).collect()}
            words = defaultdict(int)
            for r in after:
                words[r.doc_id] += len(r.text.encode().split())
            assert words == {k: r.taken for k, r in plan.items() if r.taken}
    tokens = defaultdict(int)
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect():
        tokens[r.sequence_id] += r.length
    assert max(tokens.values()) <= 1024
    assert sorted((r.doc_id, r.piece, r.length) for r in corpus_pipeline.run(spark, FOLDER).collect()) == sorted(
        (r.doc_id, r.piece, r.length) for r in corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect())


def test_edges_are_computed_once(spark, tmp_path):
    def edge(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                (tmp_path / uuid.uuid4().hex).write_text(str(k))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(0)], names=["x", "y"])

    found = components.components(spark.range(5, numPartitions=1).mapInArrow(edge, "x long, y long")).collect()
    assert sorted((r.node, r.label) for r in found) == [(k, k) for k in range(5)]
    assert len(list(tmp_path.iterdir())) == 5


def test_links_of_a_cell_are_stars_around_the_least_node(spark):
    words = [f"w{k}" for k in range(200)]
    chain = [" ".join(words[:k] + [f"x{j}" for j in range(k)] + words[k:]) for k in range(0, 40, 4)]  # neighbours are linked, ends are not
    rows = [(cell, 100 * cell + 50 - k, text) for cell in (1, 2) for k, text in enumerate(chain)]
    assert max(linked(dict(enumerate(chain)))[k][1] for k in range(len(chain))) == 0
    pairs = [tuple(r) for r in jaccard.verified_links(spark.createDataFrame(rows, "cell long, node long, text string"), jaccard.Similarity()).collect()]
    assert sorted(pairs) == sorted((100 * cell + 41, 100 * cell + n) for cell in (1, 2) for n in range(42, 51))
