"""Main text of web pages by a tree-structured graphical model.

Every block element of a page is a node that is part of the article or not. A node's own potential follows from its tag, the
words of its class and id, and the text below it; a potential joins parent and child. Sum-product messages go up and down
the tree, which gives exact marginals; blocks that are more likely part of the article than not make up the text. The
potentials are trained by the likelihood of labelled pages, with the same messages.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from factloom.llm.labelled_pages import labelled_pages

BATCH = 256  # pages whose messages are passed together
RIDGE = 0.3

# HTML elements by their role in a page.
_INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label link mark meta q ruby rt rp s samp small source span "
    "strike strong sub sup time track tt u var wbr area base col embed hr param".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style title textarea iframe noframes xmp".split())
_UNSEEN = set("head template noscript select button svg math object canvas audio video datalist".split())
_IN_HEAD = set("head html base basefont bgsound link meta noframes noscript script style template title".split())
_CONTROLS = {"button": {"button"}, "select": {"select", "input", "textarea", "keygen"}}  # and the tags that end them
_SCOPE = set("table td th caption object template svg math".split())
_FOREIGN = {"svg", "math"}
_PASSAGES = set("foreignobject desc mi mo mn ms mtext annotation-xml".split())  # inside foreign elements, HTML again
_LEAVES_FOREIGN = set(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span "
    "strong strike sub sup table tt u ul var".split())
_ENDS_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup main "
    "menu nav ol p pre section table ul li dt dd tr td th tbody thead tfoot".split())
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_KINDS = (
    ("p",), ("h1",), ("h2", "h3", "h4", "h5", "h6"), ("li", "dt", "dd"), ("ul", "ol", "dl", "menu"), ("blockquote", "pre"), ("td", "th"),
    ("table", "tr", "tbody", "thead"), ("article",), ("main",), ("section",), ("div",), ("nav",), ("header", "hgroup"), ("footer",), ("aside",),
    ("form", "fieldset", "legend"), ("figure", "figcaption"), ("body", "html"))
_KIND = {tag: k for k, tags in enumerate(_KINDS) for tag in tags}
# Beginnings of words in class, id and role that hint at a part of a page.
_HINTS = (
    ("article", "content", "post", "entry", "story", "main", "text", "body"), ("nav", "menu", "breadcrumb", "toc", "pagination"),
    ("header", "masthead", "banner", "topbar", "logo"), ("foot", "copyright", "contentinfo"), ("side", "widget", "related", "recommend", "trending", "more"),
    ("advert", "sponsor", "promo", "adsense", "ads"), ("comment", "repl", "respond", "discussion", "disqus", "feedback"),
    ("cookie", "consent", "notice", "alert", "popup", "modal", "dialog", "disclaimer", "warning", "gdpr", "privacy"),
    ("newsletter", "subscribe", "signup", "login", "search", "form", "share", "social"), ("hidden",))
_AD = {"ad"}  # a hint only as a whole word

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|</[^>]*+(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|style|data-label)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_CONTROL = {name: re.compile(rf"<(/?)(?:{'|'.join(sorted(ends))})(?=[\s/>])", re.I) for name, ends in _CONTROLS.items()}
_MARKS = re.compile(r"[.,;:!?](?=\s|$)")


@functools.lru_cache(maxsize=4096)
def _hints(attributes: str) -> tuple[tuple[int, ...], str]:
    """Numbers of the hints in an attribute text, and the label in it."""
    found, label = set(), ""
    for name, *values in _ATTRIBUTE.findall(attributes):
        value, name = "".join(values), name.lower()
        if name == "data-label":
            label = value
        elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value):
            found.add(len(_HINTS) - 1)
        elif name != "style":
            for word in map(str.lower, _WORD.findall(value)):
                found.update(k for k, begins in enumerate(_HINTS) if word.startswith(begins) or k == 5 and word in _AD)
    return tuple(sorted(found)), label


@dataclass
class Page:
    """Block elements in page order (0 is the page itself) and the runs of text directly inside them."""

    parent: list[int] = field(default_factory=lambda: [0])
    tag: list[str] = field(default_factory=lambda: [""])
    hints: list[tuple[int, ...]] = field(default_factory=lambda: [()])
    label: list[str] = field(default_factory=lambda: ["0"])
    runs: list[list] = field(default_factory=list)  # node, text, characters inside links


def parse(html: str | None) -> Page:
    """Tolerant reading: unclosed and stray tags do no harm, nor does a page that breaks off. Character references are decoded.

    The head ends at the first text or tag that is not of a head; svg and math at "/>" or at a tag of HTML; button and select
    at the tags that HTML names, and at the next block if they are never closed."""
    page, stack, position, text = Page(), [("", 0)], 0, html or ""
    places: dict[str, list[int]] = {}  # of the open elements of each name in the stack
    blocks = [0]  # places of those that are not inline
    open_controls: list[int] = []  # places of controls that are never closed
    runs: list[tuple[int, list[str], list[int]]] = []  # node, pieces of text, characters of each inside links
    unseen = links = 0
    fresh = True

    def push(name: str, node: int) -> None:
        places.setdefault(name, []).append(len(stack))
        if name not in _INLINE:
            blocks.append(len(stack))
        stack.append((name, node))

    def pop() -> None:
        nonlocal unseen, links
        name, _ = stack.pop()
        places[name].pop()
        if name not in _INLINE:
            blocks.pop()
        if open_controls and open_controls[-1] == len(stack):
            open_controls.pop()
        unseen -= name in _UNSEEN
        links -= name == "a"

    def cut(at: int) -> None:
        while len(stack) > at:
            pop()

    def leave(at: int) -> None:
        nonlocal fresh
        cut(at)
        fresh = True

    def last(names: set[str]) -> int:
        """Place of the innermost open element of these names; 0 if there is none."""
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    def within(names: set[str], border: set[str]) -> int:
        """Place of the innermost open element of these names inside the border; 0 if there is none."""
        at = last(names)
        return at if at > last(border) else 0

    def say(piece: str) -> None:
        nonlocal fresh
        if unseen or not piece:
            return
        piece = entities.unescape(piece) if "&" in piece else piece
        if fresh or runs[-1][0] != stack[-1][1]:
            runs.append((stack[-1][1], [], []))
            fresh = False
        runs[-1][1].append(piece)
        if links:
            runs[-1][2].append(len(piece))

    while position < len(text):
        token = _TOKEN.search(text, position)
        piece = text[position:token.start() if token else len(text)]
        if stack[-1][0] == "head" and not piece.isspace() and piece:
            leave(len(stack) - 1)
        say(piece)
        if not token:
            break
        position = token.end()
        closing, name, attributes = (token[1], token[2], token[3]) if token[2] else (token[4], token[5], token[6])
        if not name:
            continue
        name = name.lower()
        if closing:
            at = places[name][-1] if places.get(name) else 0
            if name in _INLINE:
                at = at if at > blocks[-1] else 0
            else:
                fresh = fresh or bool(at)
            if at:
                cut(at)
            continue
        if name == "head" and len(stack) - 1 > len(places.get("html", ())) or name == "html" and stack[-1][0] == "head":
            continue
        if stack[-1][0] == "head" and name not in _IN_HEAD:
            leave(len(stack) - 1)
        if unseen:
            if name in _LEAVES_FOREIGN and (at := within(_FOREIGN, _PASSAGES)):
                leave(at)
            for control, ends in _CONTROLS.items():
                if name in ends and (at := within({control}, _SCOPE)):
                    leave(at)
            if open_controls and name in _ENDS_P and within(set(_CONTROLS), _SCOPE) >= open_controls[0]:
                leave(open_controls[0])
        if name in _RAW:
            if unseen and attributes.rstrip().endswith("/") and within(_FOREIGN, _PASSAGES):
                continue
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(text, position)
            position = end.end() if end else len(text)
            continue
        if name == "br" or name == "hr":
            say(" ")
            fresh = fresh or name == "hr"
        if name in _VOID:
            continue
        if name == "body":
            while len(stack) > 1 and stack[-1][0] != "html":
                pop()
        if name in _ENDS_P:
            if stack[blocks[-1]][0] == "p":
                cut(blocks[-1])
            closes, at = _SIBLINGS.get(name, ()), blocks[-1]
            while closes and stack[at][0] in closes:
                cut(at)
                at = len(stack) - 1
        if name in _FOREIGN and attributes.rstrip().endswith("/"):
            continue
        if name in _CONTROLS:
            follows = _CONTROL[name].search(text, position)
            if not follows or not follows[1]:
                open_controls.append(len(stack))
        if name in _INLINE or name in _UNSEEN:
            unseen += name in _UNSEEN
            links += name == "a"
            push(name, stack[-1][1])
            continue
        found, label = _hints(attributes.strip()) if attributes.strip() else ((), "")
        page.parent.append(stack[-1][1])
        page.tag.append(name)
        page.hints.append(found)
        page.label.append(label or page.label[stack[-1][1]])
        push(name, len(page.parent) - 1)
        fresh = True
    page.runs = [[node, run, linked] for node, run, linked in ([n, " ".join("".join(r).split()), sum(k)] for n, r, k in runs) if run]
    return page


@dataclass
class Forest:
    """The nodes of several pages: parent (-1 at the top), nodes by depth, features."""

    parent: np.ndarray
    levels: list[np.ndarray]
    features: np.ndarray


WIDTH = 1 + len(_KINDS) + 1 + len(_HINTS) + 9


def forest(pages: list[Page]) -> Forest:
    sizes = np.array([len(p.parent) for p in pages])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    total = int(starts[-1])
    parent = np.concatenate([np.array(p.parent) + s for p, s in zip(pages, starts)])
    parent[starts[:-1]] = -1
    kinds = np.fromiter((_KIND.get(t, len(_KINDS)) for p in pages for t in p.tag), np.int64, total)
    counts = np.zeros((total, 5))  # characters, those in links, words, marks, paragraphs
    own = np.zeros(total)
    for page, start in zip(pages, starts):
        for node, run, linked in page.runs:
            counts[start + node] += (len(run), min(linked, len(run)), run.count(" ") + 1, len(_MARKS.findall(run)), 0)
            own[start + node] += len(run)
    counts[:, 4] = kinds == 0
    depth = np.zeros(total, np.int64)
    for node in range(total):  # parents come first
        if parent[node] >= 0:
            depth[node] = depth[parent[node]] + 1
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.cumsum(np.bincount(depth))[:-1])
    for level in levels[:0:-1]:
        np.add.at(counts, parent[level], counts[level])
    page_of = np.repeat(np.arange(len(pages)), sizes)
    characters, linked, words, marks, paragraphs = counts.T
    whole = np.maximum(characters[starts[:-1]][page_of], 1)
    features = np.zeros((total, WIDTH))
    features[:, 0] = 1
    features[np.arange(total), 1 + kinds] = 1
    at = 2 + len(_KINDS)
    for page, start in zip(pages, starts):
        for node, found in enumerate(page.hints):
            for k in found:
                features[start + node, at + k] = 1
    at += len(_HINTS)
    features[:, at] = np.log1p(characters) / 5
    features[:, at + 1] = np.log1p(own) / 5
    features[:, at + 2] = linked / np.maximum(characters, 1)
    features[:, at + 3] = np.minimum(marks / np.maximum(words, 1) * 5, 2)
    features[:, at + 4] = characters / whole
    features[:, at + 5] = np.log1p(paragraphs) / 2
    features[:, at + 6] = (np.arange(total) - starts[page_of]) / sizes[page_of]
    features[:, at + 7] = characters == 0
    features[:, at + 8] = np.minimum(depth, 12) / 6
    return Forest(parent, levels, features)


@dataclass
class TextModel:
    """weights: of the features, for being part of the article; tie[parent state, child state]: log potentials."""

    weights: np.ndarray
    tie: np.ndarray

    def marginals(self, trees: Forest) -> tuple[np.ndarray, np.ndarray]:
        """(chance of each node to be part of the article, chances [node, parent state, own state] of each edge)."""
        up = np.zeros((len(trees.parent), 2))
        up[:, 1] = trees.features @ self.weights
        message = np.zeros_like(up)
        for level in trees.levels[:0:-1]:  # leaves first
            joint = self.tie[None] + up[level][:, None, :]
            message[level] = np.logaddexp(joint[:, :, 0], joint[:, :, 1])
            message[level] -= message[level].max(axis=1, keepdims=True)
            np.add.at(up, trees.parent[level], message[level])
        total, edges = up.copy(), np.zeros((len(trees.parent), 2, 2))
        for level in trees.levels[1:]:  # from the top
            above = total[trees.parent[level]] - message[level]
            joint = above[:, :, None] + self.tie[None]
            total[level] += np.logaddexp(joint[:, 0], joint[:, 1]) - joint.max(axis=(1, 2))[:, None]
            joint = joint + up[level][:, None, :]
            joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
            edges[level] = joint / joint.sum(axis=(1, 2), keepdims=True)
        chance = 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -500, 500)))
        return chance, edges


def train(pages: list[str], rounds: int = 400, rate: float = 0.15) -> TextModel:
    """Climb the likelihood of the labels, with exact marginals in each round. pages: html with data-label marks."""
    read = [parse(p) for p in pages]
    trees = forest(read)
    wanted = np.array([label == "1" for p in read for label in p.label], float)
    child = np.flatnonzero(trees.parent >= 0)
    seen = np.zeros((2, 2))
    np.add.at(seen, (wanted[trees.parent[child]].astype(int), wanted[child].astype(int)), 1)
    model = TextModel(np.zeros(WIDTH), np.zeros((2, 2)))
    first, second = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
    for step in range(1, rounds + 1):
        chance, edges = model.marginals(trees)
        slope = np.concatenate([trees.features.T @ (wanted - chance) - RIDGE * model.weights, (seen - edges[child].sum(axis=0) - RIDGE * model.tie).ravel()])
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope * slope
        move = rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-8)
        model = TextModel(model.weights + move[:WIDTH], model.tie + move[WIDTH:].reshape(2, 2))
    return model


@functools.lru_cache(maxsize=1)
def trained() -> TextModel:
    return train(labelled_pages())


def texts(pages: list[str | None], model: TextModel) -> list[str]:
    read = [parse(p) for p in pages]
    trees = forest(read) if read else None
    chance = model.marginals(trees)[0] if read else ()
    out, start = [], 0
    for page in read:
        out.append("\n".join(run for node, run, _ in page.runs if chance[start + node] > 0.5))
        start += len(page.parent)
    return out


def extract(pages: DataFrame, model: TextModel, html: str = "html") -> DataFrame:
    """pages with __text, the article's text: white space within a block made one space, blocks joined by line feeds.

    Null and empty pages and pages without an article have the empty text. Repeated rows are read each for itself; other
    columns are kept, only one named __text is replaced; an empty table gives an empty result."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    columns = pages.columns
    kept = [c for c in columns if c != "__text"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = columns.index(html)
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                found = texts(part.column(at).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(found, pa.string())], names=[*kept, "__text"])

    return pages.mapInArrow(read, T.StructType([*(f for f in pages.schema.fields if f.name in kept), T.StructField("__text", T.StringType())]))
