"""Quality rules, vector codes and token alignment against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

import __spark_entry__ as entry
from factloom.llm import alignment, byte_bpe, codes, quality_rules, queries
from tests.check_queries import compare, connect

FOLDER = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = st.text(st.sampled_from("aé9²'st .,!\n\t\r\x0b\x0c\x1c\x85\xa0 ​　ßÑ中\U0001f600▁<|endoftext|>"))


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", ["op11_quality_rules", "op12_vector_codes"])
def test_sql(spark, duck, name):
    assert compare(entry.queries()[name](spark, FOLDER), duck.sql(entry.oracle_sql()[name]), []) is None


# quality rules

def plain_rules(text):
    body = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", body)
    windows = [tuple(words[k:k + 8]) for k in range(len(words) - 7)]
    often = Counter(windows)
    covered = {k + i for k, w in enumerate(windows) if often[w] > 1 for i in range(8)}
    lines = [x for x in body.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    made = (len(words), sum(map(len, words)), sum(body.count(c) for c in quality_rules.SYMBOLS), len(lines) - len(set(lines)), len(covered))
    return *made, made[0] < 20 or 100 * made[4] > 30 * made[0]


def test_rules_edges(spark):
    run = "one two three four five six seven eight nine ten "
    texts = [None, "", " \n\t\x0b", run * 3, run + "x y z " + run, "a " * 40, "\n".join(["the same line"] * 9 + ["#*$%&|<>"] * 3), "the 中 文 \U0001f600 and " * 30,
             "word " * 200_000, " ".join(f"w{k} the" for k in range(50_000)), run, run]
    docs = spark.createDataFrame([(k, t, 1, "c") for k, t in enumerate(texts)], "doc_id long, text string, words int, body string")
    clash = docs.withColumn("hashes", docs.words).withColumn("__rules", docs.words)
    got = {r.doc_id: r["__rules"] for r in quality_rules.judge_quality(clash).collect()}
    for k, t in enumerate(texts):
        assert (got[k].n_words, got[k].word_chars, got[k].n_symbols, got[k].n_dup_lines, got[k].n_repeat_words, got[k].base_failed) == plain_rules(t), k
        assert got[k].kept == (not got[k].base_failed and not got[k].failed)
    assert quality_rules.judge_quality(docs).columns == [*docs.columns, "__rules"]
    assert quality_rules.judge_quality(docs.limit(0)).collect() == []


def test_thresholds_are_a_table(spark):
    docs = spark.createDataFrame([("aa bb cc " * 10,), ("aa bb ## " * 10,)], "text string")
    table = (quality_rules.Threshold("marks", "n_symbols", "n_words", most=0),)
    assert [r["__rules"].failed for r in quality_rules.judge_quality(docs, thresholds=table).collect()] == [[], ["marks"]]
    assert all(r["__rules"].failed == [] for r in quality_rules.judge_quality(docs, thresholds=()).collect())


# vector codes

def plain_codes(rows, rounds=6):
    """rows of (vec_id, integers), in the order of the ids"""
    books = [[list(v[8 * p:8 * p + 8]) for _, v in rows[:16]] for p in range(8)]
    cut = [[list(v[8 * p:8 * p + 8]) for p in range(8)] for _, v in rows]
    far = lambda x, y: sum((i - j) ** 2 for i, j in zip(x, y))
    nearest = lambda x, book: min(range(len(book)), key=lambda e: (far(x, book[e]), e))
    for _ in range(rounds):
        for p, book in enumerate(books):
            by = defaultdict(list)
            for parts in cut:
                by[nearest(parts[p], book)].append(parts[p])
            books[p] = [[sum(c) // len(by[e]) for c in zip(*by[e])] if e in by else book[e] for e in range(len(book))]
    chosen = [[nearest(parts[p], books[p]) for p in range(8)] for parts in cut]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [("".join(f"{c:02x}" for c in found), sum(far(parts[p], books[p][found[p]]) for p in range(8))) for found, parts in zip(chosen, cut)], digest


def test_codes_against_brute_force(spark):
    rng = np.random.default_rng(5)
    made = rng.normal(size=(400, 64)).round(2)
    made[100:300] = made[7]  # a very common vector, also among the first
    made[3] = made[2]
    rows = [(int(k), made[k].tolist(), k % 3 if k % 5 else None) for k in range(400)]
    bad = [(1000, None, 1), (1001, [float("nan")] * 64, 1), (1002, [None] + [1.0] * 63, 1), (1003, [float("inf")] * 64, None), (-5, [float("-inf")] * 64, 0)]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int")
    clash = table.selectExpr("*", "1 AS row_id", "2 AS code", "3 AS same_label", "4 AS vector").repartition(5)
    got = {r.vec_id: r for r in codes.compress(clash, block=64).collect()}
    want, digest = plain_codes([(k, np.floor(4096 * np.array(v)).astype(int).tolist()) for k, v, _ in rows])
    by_label = Counter()
    for (k, _, label), (_, error) in zip(rows, want):
        by_label[label] += error
    assert set(got) == {k for k, _, _ in rows}
    for (k, _, label), (code, error) in zip(rows, want):
        assert (got[k].code, got[k].error, got[k].label_error, got[k].codebooks_sha256) == (code, error, by_label[label], digest)


def test_codes_edges(spark):
    schema = "vec_id long, embedding array<float>, label string"
    assert codes.compress(spark.createDataFrame([], schema)).collect() == []
    assert codes.compress(spark.createDataFrame([(1, None, "a")], schema)).collect() == []
    few = [(2, [0.5] * 64, None), (2, [0.5] * 64, None), (None, [0.25] * 64, "x"), (3, [1.0] * 5, "x"), (4, [1e30] * 64, "x"), (4, [-1e30] * 64, "x"), (5, [], "x")]
    got = codes.compress(spark.createDataFrame(few, schema)).collect()
    assert sorted(((str(r.vec_id), r.code, r.error) for r in got), key=str) == [
        ("2", "00" * 8, 0), ("2", "00" * 8, 0), ("3", None, None), ("4", None, None), ("4", None, None), ("5", None, None), ("None", "02" * 8, 0)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-40, 40), min_size=3, max_size=3), min_size=1, max_size=120), st.lists(st.lists(st.integers(-40, 40), min_size=3, max_size=3), min_size=1, max_size=9))
def test_cover_tree(points, entries):
    points, entries = np.array(points, np.int64), np.array(entries, np.int64)
    tree = codes.build_tree(points, leaf=3)
    placed = points[tree["order"]]
    assert sorted(tree["order"].tolist()) == list(range(len(points)))
    for k in range(len(tree["first"])):
        below = placed[tree["first"][k]:tree["last"][k]]
        assert np.sqrt(((below - tree["centre"][k]) ** 2).sum(axis=1)).max() <= tree["radius"][k] + 1e-9
        assert (below.sum(axis=0) == tree["total"][k]).all()
        children = range(tree["child"][k], tree["child"][k] + tree["children"][k])
        if children:
            assert tree["last"][list(children)].max() == tree["last"][k] and tree["first"][children[0]] == tree["first"][k]
            for x in children:
                assert all(np.sqrt(((tree["centre"][x] - tree["centre"][y]) ** 2).sum()) > tree["radius"][k] / 2 for y in children if y != x)
    found, sums, _ = codes.assign(tree, placed, entries)
    want = codes.squared_distances(placed, entries).argmin(axis=1)
    assert (found == want).all()
    for e in range(len(entries)):
        assert sums[e].tolist() == [*placed[want == e].sum(axis=0).tolist(), int((want == e).sum())]


def test_whole_subtrees_are_assigned():
    rng = np.random.default_rng(1)
    points = (rng.integers(0, 4, (2000, 1)) * 100_000 + rng.integers(0, 50, (2000, 4))).astype(np.int64)
    entries = np.array([[k * 100_000 + 25] * 4 for k in range(4)], np.int64)
    tree = codes.build_tree(points)
    assert codes.assign(tree, points[tree["order"]], entries)[2] == 0


# token alignment

@pytest.fixture(scope="module")
def plain():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = byte_bpe._byte_letters()
    names = {i: t for t, i in a.get_vocab().items()}

    def tokens(text):
        if not text:
            return [], []
        left = [(i, bytes(letters[c] for c in names[i])) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        whole = (" " + text).encode()
        return (left, right) if b"".join(x for _, x in left) == whole == b"".join(x for _, x in right) else ([], [])

    def aligned(text):
        left, right = tokens(text)
        groups, i, j, at_a, at_b = [], 0, 0, 0, 0
        here = ([], [])
        while i < len(left) or j < len(right):
            if at_a <= at_b and i < len(left):
                here[0].append(left[i][0])
                at_a, i = at_a + len(left[i][1]), i + 1
            else:
                here[1].append(right[j][0])
                at_b, j = at_b + len(right[j][1]), j + 1
            if at_a == at_b and here[0] and here[1]:
                groups.append(here)
                here = ([], [])
        return len(left), len(right), groups

    return aligned


def plain_documents(texts, plain):
    done = {k: plain(t) for k, t in texts}
    links = {k: Counter((x, y) for g in found[2] for x in g[0] for y in g[1]) for k, found in done.items()}
    count = Counter(pair for of in links.values() for pair in of)
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    shown = {k: ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in found[2]) for k, found in done.items()}
    return {k: (found[0], found[1], len(found[2]), sum(links[k].values()), sum(n for p, n in links[k].items() if count[p] == best[p[0]]),
                sum(n * count[p] for p, n in links[k].items()), hashlib.sha256(shown[k].encode()).hexdigest() if found[0] else "")
            for k, found in done.items()}


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_query(spark, plain):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in queries.QUERIES["op13_token_alignment"](spark, FOLDER).collect()}
    assert got == plain_documents(texts, plain)


def test_alignment_edges(spark, plain, monkeypatch):
    texts = [None, "", "a▁b", "plain words", "plain words", "<|endoftext|> <s> <unk> <0x41>", "  two  spaces \n\n\n\tx", "\U0001f600中文é ", "a" * 5000,
             "the cat sat " * 20_000, " " * 20_000, "\n" * 9_000, "\0 nul", " "]
    rows = list(enumerate(texts))
    table = spark.createDataFrame([(k, t, 9, "z") for k, t in rows], "doc_id long, text string, row int, links string")
    want = plain_documents(rows, plain)
    for most in (alignment.BROADCAST_PAIRS, 0):  # counts sent to all tasks, and joined by pair
        got = alignment.linked_documents(table, A, B, broadcast_pairs=most).collect()
        assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in got} == want and len(got) == len(rows)
    assert alignment.linked_documents(table.limit(0), A, B).collect() == []
    without = spark.createDataFrame([(None, "same text"), (None, "same text")], "doc_id long, text string")
    assert [r.n_links for r in alignment.linked_documents(without, A, B).collect()] == [len(plain("same text")[2])] * 2


VOCABULARIES = alignment.Vocabularies(A, B)


@settings(max_examples=150, deadline=None)
@given(st.lists(ODD, max_size=6), st.integers(1, 40))
def test_pieces_are_stitched(texts, work):
    whole = alignment.align(VOCABULARIES, texts, 1 << 30)
    for x, y in zip(alignment.align(VOCABULARIES, texts, work), whole):
        assert x["groups"] == y["groups"] and x["pairs"].tolist() == y["pairs"].tolist() and x["times"].tolist() == y["times"].tolist()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 60), unique=True), st.lists(st.integers(0, 60), unique=True), st.integers(1, 9))
def test_merge_path(a, b, work):
    a, b = np.array(sorted(a), np.int64), np.array(sorted(b), np.int64)
    i, j = alignment.merge_path(a, b, work)
    assert (i[0], j[0], i[-1], j[-1]) == (0, 0, len(a), len(b)) and (np.diff(i) >= 0).all() and (np.diff(j) >= 0).all()
    for k, (x, y) in enumerate(zip(i[1:-1], j[1:-1]), 1):
        assert x + y - work * k in (0, 1)  # equal work, but for an equal pair kept together
        left, right = [*a[:x], *b[:y]], [*a[x:], *b[y:]]
        assert not left or not right or max(left) <= min(right) and not set(left) & set(right)


def test_many_links_are_counted_in_parts(monkeypatch):
    text = ["tokens of several words, many of them in pieces: antidisestablishmentarianism " * 9]
    whole = alignment.align(VOCABULARIES, text)[0]
    for most in (1, 3, 50):
        monkeypatch.setattr(alignment, "LINKS", most)
        part = alignment.align(VOCABULARIES, text)[0]
        assert (part["pairs"].tolist(), part["times"].tolist()) == (whole["pairs"].tolist(), whole["times"].tolist())


def test_long_texts_are_cut_at_safe_places(monkeypatch):
    text = ["some words  and more,\nlines of words 12 x y z's not " * 40]
    whole = alignment.align(VOCABULARIES, text)[0]
    monkeypatch.setattr(byte_bpe, "SEGMENT", 7)
    assert alignment.align(VOCABULARIES, text)[0]["groups"] == whole["groups"]


@settings(max_examples=300, deadline=None)
@given(ODD)
def test_fast_ids_are_plain_ids(text):
    tokenizer = byte_bpe.load(A)
    assert tokenizer.ordinary(text) == tokenizer.plain.encode(text, add_special_tokens=False).ids
    marked = Tokenizer.from_file(A)
    assert tokenizer.ids(text).tolist() == marked.encode(text, add_special_tokens=False).ids
