"""Operators on pages and vectors against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from factloom.llm import main_text, neighbours, queries, url_rules, warc
from factloom.llm.labelled_pages import labelled_pages
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
BIG = "<p>" + "words and more words " * 20 + "</p>"
#: page_id, url, html
ODD = [
    (1, "http://www.Example.com/en/1?q=http://x.com/#a", BIG), (2, "https://b.example.com/en/", BIG), (3, None, BIG), (4, "", None), (5, "no scheme", ""),
    (6, "http://example.net", "short"), (7, "http://a.net/es/x", "short"), (None, "http://a.net/fr/x", BIG), (8, "http://spam.example.org/", BIG + "é"),
    (9, "http://ends.org/line\r\nbreak", "x" * 500_000), (2, "https://b.example.com/en/", BIG), (10, "http://com.org/com/", "<div" * 3000),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "page_id long, url string, html string").selectExpr("*", "'h' AS host", "'k' AS url_key", "1 AS run", "'t' AS text", "'v' AS verdict")


def expected_records(pages):
    payloads = [(p, (h or "").encode()) for p, _, h in pages]
    first = {}
    for p, b in payloads:
        if len(b) >= 100 and p is not None:
            first[b] = min(p, first.get(b, p))
    rows = []
    for p, b in payloads:
        to = first.get(b)
        revisit = to is not None and to != p
        rows.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(rows, key=repr)


def test_warc(spark, odd):
    got = queries.QUERIES["op3_warc"](spark, FOLDER).collect()
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()]
    assert sorted(map(tuple, got), key=repr) == expected_records(pages)
    rows = warc.archive_pages(odd, with_payload=True).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=repr) == expected_records(ODD)
    assert {(r.page_id, bytes(r.payload)) for r in rows if r.record_type == "response"} <= {(p, (h or "").encode()) for p, _, h in ODD}
    assert warc.archive_pages(odd.limit(0)).collect() == []


def test_index_is_in_global_order(spark, odd):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id") % 7, F.lit(".org/p")).alias("url"), F.lit("<p>").alias("html"))
    index = warc.write_archives(warc.plan_captures(pages.repartition(5)), archive_bytes=20_000)
    merged = warc.merge_runs(index, range_rows=400)
    assert index.select("run").distinct().count() > 5 and merged.rdd.getNumPartitions() > 3
    keys = [(r.url_key, r.captured, r.page_id) for r in merged.collect()]  # partitions one after the other
    assert keys == sorted(keys) and len(keys) == 3000


def test_index_of_one_moment(spark):
    """Captures of one URL and moment in one archive, written in any order, come out by page id."""
    pages = spark.createDataFrame([(k, "http://h.org/p", "<p>") for k in (9, 3, 7, 1, 8, 2)] + [(None, "http://h.org/p", "<p>")], "page_id long, url string, html string")
    captures = warc.plan_captures(pages.coalesce(1), captured=F.lit("2024-01-01").cast("timestamp"))
    index = warc.write_archives(captures)
    assert [r.page_id for r in warc.merge_runs(index, range_rows=100).collect()] == [None, 1, 2, 3, 7, 8, 9]
    runs = index.orderBy("run", "seq").collect()
    assert [r.page_id for r in runs] == [None, 1, 2, 3, 7, 8, 9]


@given(st.lists(st.lists(st.integers(0, 20)), max_size=9))
def test_loser_tree(runs):
    runs = [sorted(r) for r in runs]
    assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_page_columns_may_clash(spark, odd):
    names = ("__url", "__name", "__ordered", "row", "order", "subject", "token")
    clash = odd.selectExpr("*", *[f"concat('{n}', coalesce(page_id, 0)) AS `{n}`" for n in names], "'x' AS __text", "'y' AS __host")
    judged = url_rules.judge_urls(clash)
    assert judged.count() == len(ODD) and all(r[n] == f"{n}{r.page_id or 0}" for r in judged.collect() for n in names)
    assert {r["__host"] for r in judged.collect()} != {"y"}
    plain = {(r.page_id, r.url): r["__text"] for r in main_text.extract(odd.filter("length(html) < 1000"), main_text.trained()).collect()}
    found = main_text.extract(clash.filter("length(html) < 1000"), main_text.trained())
    assert {(r.page_id, r.url): r["__text"] for r in found.collect()} == plain and found.columns.count("__text") == 1


def test_urls(spark, odd):
    got = {(r.page_id, r.url): (r["__host"], r["__path"], r["__rule"], r["__pattern"], r["__verdict"]) for r in url_rules.judge_urls(odd).collect()}
    assert url_rules.judge_urls(odd).count() == len(ODD)
    assert got[1, ODD[0][1]] == ("www.example.com", "/en/1", "www.example.com/en/", None, "allow")
    assert got[2, ODD[1][1]] == ("b.example.com", "/en/", "example.com/en/", None, "block")
    assert got[3, None] == got[4, ""] == got[5, "no scheme"] == ("", "", None, None, "allow")
    assert got[6, "http://example.net"] == ("example.net", "", None, None, "allow")
    assert got[7, "http://a.net/es/x"][2:] == ("net/es/", None, "block") and got[None, "http://a.net/fr/x"][2:] == ("net/fr/", None, "block")
    assert got[8, "http://spam.example.org/"][2:] == (None, "spam host", "block")
    assert got[10, "http://com.org/com/"][2:] == (None, None, "allow")
    assert url_rules.judge_urls(odd.limit(0)).collect() == []


def test_rules_are_filed_under_their_rarest_token(spark):
    rules = (url_rules.host_rule("block", "example.com/en/"), url_rules.UrlRule("any", "block", "^x", ()))
    counts = spark.createDataFrame([("example", 9), ("com", 5), ("en", 7)], "token string, n long")
    assert {r.rule_no: r.token for r in url_rules.rule_index(spark, counts, rules).collect()} == {0: "com", 1: ""}
    assert "en" in rules[0].tokens and url_rules.host_rule("block", "a.b/en").tokens == ("a", "b")


def exact_neighbours(ids, x, k):
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    for at in np.flatnonzero(ids % 50 == 0):
        score = unit @ unit[at]
        order = [i for i in np.lexsort((ids, -np.round(score, 12))) if ids[i] != ids[at]][:k]
        yield ids[at], [int(ids[i]) for i in order], score[order]


def test_neighbours(spark):
    folder = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    got = {}
    for r in queries.QUERIES["op2_nearest_neighbours"](spark, folder).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    hits = 0
    for query, near, scores in exact_neighbours(table.vec_id.to_numpy(), np.stack(table.embedding).astype(float), 5):
        assert sorted(got[query]) == [1, 2, 3, 4, 5]
        found = [got[query][k] for k in range(1, 6)]
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
        hits += len({v for v, _ in found} & set(near))
    assert hits >= 0.9 * 5 * len(got)


def test_neighbours_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (None, [1.0, 0.0]),
            (50, [1.0, 0.0, 0.0]), (51, [0.0, 1.0, 0.0]), (100, [0.0, 0.0]), *[(k, [3.0, 4.0]) for k in range(200, 230)], (230, [3.0, 4.0]), (230, [3.0, 4.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS width", "2 AS block", "3 AS score")
    got = {}
    for r in neighbours.nearest_neighbours(table, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, round(r.score, 9)))
    assert set(got) == {0, 50, 200}
    assert sorted(got[0]) == [(1, 1, 1.0), (2, 2, 0.707106781), (3, 200, 0.6), (4, 201, 0.6), (5, 202, 0.6)]
    assert got[50] == [(1, 51, 0.0)]
    assert sorted(got[200]) == [(k, 200 + k, 1.0) for k in range(1, 6)]
    assert neighbours.nearest_neighbours(table.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_recall_follows_the_chance():
    pick = np.random.default_rng(1)
    x = np.repeat(pick.normal(size=(40, 32)), 100, axis=0) + 0.3 * pick.normal(size=(4000, 32))
    ids = np.arange(4000)
    block, hits, verified = neighbours.Block(ids, x), 0, 0
    for query, near, _ in exact_neighbours(ids, x, 5):
        found, _, seen = block.nearest(query, x[query], 5)
        hits, verified = hits + len(set(found) & set(near)), verified + seen
    assert hits >= 0.9 * 5 * 80 and verified < 0.5 * 80 * 4000
    assert abs(neighbours.chi_square_quantile(0.95, 8) - 15.507) < 1e-3


def words_of(text):
    return text.split()


def test_main_text_of_given_pages(spark):
    got = {r.page_id: r for r in queries.QUERIES["op4_main_text"](spark, "/root/testdata/sf0.01").collect()}
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    assert set(got) == {p.page_id for p in pages}
    for p in pages:
        article = main_text.entities.unescape(main_text.re.sub("<[^>]*>", " ", main_text.re.sub(r"</(p|h1)>|<p>", "\n", p.html.partition("<article>")[2].partition("</article>")[0])))
        blocks = [" ".join(b.split()) for b in article.split("\n")]
        assert got[p.page_id].text == "\n".join(b for b in blocks if b)
        assert got[p.page_id].n_chars == len(got[p.page_id].text)


def test_held_out_layouts():
    model = main_text.trained()
    right = wrong = missed = 0
    for html in labelled_pages(300)[240:]:
        page = main_text.parse(html)
        want = [r for n, r, _ in page.runs if page.label[n] == "1"]
        got = main_text.texts([html], model)[0].split("\n")
        right += sum(len(x) for x in got if x in want)
        wrong += sum(len(x) for x in got if x not in want)
        missed += sum(len(x) for x in want if x not in got)
    assert right / (right + wrong) > 0.97 and right / (right + missed) > 0.97


def test_main_text_reading():
    read = lambda html: [r for _, r, _ in main_text.parse(html).runs]
    assert read(None) == read("") == []
    assert read("<p>a &amp; b<br>c&nbsp;d<p>e <b>f\n\n g</b>h") == ["a & b c d", "e f gh"]
    assert read("<div>one<p>two</p>three</div>") == ["one", "two", "three"]
    assert read("<script>if (a<b) '</p>'</script>x<style>p{}</style><!-- no -->y<!-- open") == ["xy"]
    assert read("<ul><li>a<li>b</ul><title>t</title><a href='q>r'>s</a><a href=\"q") == ["a", "b", "s"]
    assert read("</div></p><td>x</table>") == ["x"]


@pytest.mark.parametrize("html, want", [
    ("<html><head><title>x</title><h1>a</h1><p>b</p>", ["a", "b"]),
    ("<head><meta charset=utf-8><title>x</title><link rel=y>a<p>b", ["a", "b"]),
    ("<html><head><noscript><img src=x>n</noscript><template>t</template><script>s</script>\n<div>a</div><head><p>b", ["a", "b"]),
    ("<head><html lang=en><title>x</title><p>a", ["a"]),
    ("<head><title>x</title></head><body><p>a", ["a"]),
    ("<div>a<svg class=icon/>b<p>c</div>", ["ab", "c"]),
    ("<div>a<svg class=\"icon\" />b<math/>c<p>d</div>", ["abc", "d"]),
    ("<div><svg><title/><path d='' /><text>n</text></svg><p>a</div>", ["a"]),
    ("<div><svg><path d=''><text>n<p>a</p>b</div>", ["a", "b"]),
    ("<svg><foreignObject><p>n</p></foreignObject></svg><p>a", ["a"]),
    ("<article><button>n<p>a</p>b</article>", ["a", "b"]),
    ("<article><button>n<button>n</button>a<p>b</article>", ["a", "b"]),
    ("<article><button><div>n</div></button>a<p>b</article>", ["a", "b"]),
    ("<article><select><option>n<p>a</p></article>", ["a"]),
    ("<article><select><option>n<input>a<p>b</article>", ["a", "b"]),
    ("<article><select><option>n<option>n</select>a<p>b</article>", ["a", "b"])])
def test_hidden_parts_end(html, want):
    """Omitted end tags and tags that close themselves hide nothing of what follows."""
    assert [r for _, r, _ in main_text.parse(html).runs if r] == want


def test_main_text_of_an_open_head():
    page = next(p for p in labelled_pages(20) if "</head>" in p and main_text.texts([p], main_text.trained())[0])
    whole = main_text.texts([page], main_text.trained())[0]
    head, body = page.split("</head>")
    opened = head + main_text.re.sub(r"^\s*<body[^>]*>", "", body)
    assert "<body" not in opened and set(whole.split("\n")) & set(main_text.texts([opened], main_text.trained())[0].split("\n"))


def test_main_text_edges(spark, odd):
    rows = main_text.extract(odd, main_text.trained()).collect()
    assert len(rows) == len(ODD) and all(isinstance(r["__text"], str) for r in rows)
    assert {r["__text"] for r in rows if not r.html} == {""}
    assert main_text.extract(odd, main_text.trained()).columns == [*odd.columns, "__text"]
    assert main_text.extract(odd.limit(0), main_text.trained()).collect() == []


def test_messages_give_exact_marginals():
    """Against the sum over all labellings of a small tree."""
    page = main_text.parse("<div><p>a</p><section><p>b</p><p>c</p></section></div>")
    trees, pick = main_text.forest([page]), np.random.default_rng(2)
    model = main_text.TextModel(pick.normal(size=main_text.WIDTH), pick.normal(size=(2, 2)))
    n, own = len(page.parent), trees.features @ model.weights
    total = np.zeros(n)
    mass = 0.0
    for k in range(2 ** n):
        state = [(k >> i) & 1 for i in range(n)]
        weight = np.exp(sum(own[i] * state[i] for i in range(n)) + sum(model.tie[state[page.parent[i]], state[i]] for i in range(1, n)))
        total, mass = total + weight * np.array(state), mass + weight
    assert np.allclose(model.marginals(trees)[0], total / mass)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='x'>", "</div>", "<li>", "<ul>", "text ", "<b", "<!--", "-->", "<a>", "</a>", "<br/>", "&amp", "<script>", "'", '"', "<td>"])))
def test_reading_never_fails(parts):
    main_text.texts(["".join(parts)], main_text.TextModel(np.zeros(main_text.WIDTH), np.zeros((2, 2))))


def test_order_of_rows_does_not_matter():
    pages = labelled_pages(20)
    order = random.Random(1).sample(range(20), 20)
    model = main_text.trained()
    assert [main_text.texts(pages, model)[k] for k in order] == main_text.texts([pages[k] for k in order], model)


@pytest.mark.parametrize("page", [
    "<i>" * 800_000 + "</b>" * 700_000, "<div>x</p>" * 500_000, "<i>" * 800_000 + "<p>x" * 700_000, "<p>" + "word <b>x</b> " * 400_000, "<button><table>" * 330_000,
    "<svg>" * 500_000 + "<desc><p>" * 300_000, "<head>" * 800_000, "<a href='>" * 500_000, "<li>x" * 1_000_000, "<select>" * 600_000], ids=range(10))
def test_long_pages_take_linear_time(page):
    """5 MB of shapes that a search through the open elements would make quadratic."""
    start = time.process_time()
    main_text.parse(page)
    assert time.process_time() - start < 60
