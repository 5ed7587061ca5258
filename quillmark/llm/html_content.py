"""Main text of web pages by a tree-structured graphical model over DOM nodes.

Every block element of a page is a node with two states, content or not.  Its own potential is log-linear in features
of the element: its tag, its own text (length, links, sentence ends), the text below it, its place around the node whose
children hold the most sentences, its like siblings, and the names in its class, id and role and in those of the nearest
element around it that has any, hashed into NAME_BUCKETS each with a weight that is learnt (no list of names is built in).  A potential for each kind of edge joins it to its parent.
Sum-product messages go up the tree and down again, which gives each node's marginal; text belongs to the block it
stands in and is kept if that node is content more likely than not.  The weights maximise the likelihood of labelled
pages (``html_pages``), by the gradient that the same messages give; there, names say something on some pages, nothing or
the wrong thing on others, so that they never outweigh the structure by themselves.

Blocks: text between the starts and ends of block elements.  ``<br>`` is white space.  Character references are decoded,
white space becomes one space, blocks are joined by one line feed in page order.  Comments, scripts, styles, templates,
form controls and the head are never text; one of them that is left open ends with the element that it stands in.

Reading a page takes time in proportion to its length, whatever its markup is like.

Nulls: null html is an empty page with empty text.  Null ids and urls are kept.  Repeated rows each have their text.  An
empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import html_pages
from quillmark.llm.common import table

#: Fixed values of HTML: elements without an end tag, controls, those whose inside is no markup, those of the head.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTROL = frozenset("template select button datalist".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HEAD = frozenset("title meta link style script base noscript template".split())
#: An open element of the first kind ends where one of the second starts.
P_ENDS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dd dt td th tr tbody thead tfoot".split())
#: All other elements stand inside a line, unknown ones too.
BLOCKS = P_ENDS | CONTROL | frozenset("html body head option optgroup caption colgroup legend summary hgroup search frameset".split())
ENDS = {"p": P_ENDS, "li": frozenset(["li"]), "dd": frozenset(["dd", "dt"]), "dt": frozenset(["dd", "dt"]), "td": frozenset("td th tr tbody tfoot".split()), "th": frozenset("td th tr tbody tfoot".split()), "tr": frozenset("tr tbody tfoot".split()), "option": frozenset(["option"])}
SCOPE = frozenset("table ul ol dl div article section main body html td th nav aside footer header form blockquote".split())
#: Elements that HTML defines as something beside the page's main content, and as that content.
BESIDE = frozenset("nav aside footer header form dialog menu".split())
MAIN = frozenset("article main".split())

NAME_BUCKETS = 1 << 12
NAME = re.compile(r"/?[a-zA-Z][^\s/<>]*")
STOP = re.compile(r"[<>]|=\s*[\"']")
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
LABEL = ' data-y="1"'
CLOSED_BY = {t: [x for x, by in ENDS.items() if t in by] for t in set().union(*ENDS.values())}


class Node:
    __slots__ = ("tag", "parent", "names", "around", "beside", "main", "n_text", "n_link", "n_stops", "label", "order", "control")

    def __init__(self, tag: str, parent: Node | None, attrs: str, order: int):
        self.tag, self.parent, self.order = tag, parent, order
        found: set[str] = set()
        for m in NAMES.finditer(attrs):
            for name in (m[1] or m[2] or m[3] or "").split()[:20]:
                parts = [x.lower() for x in PARTS.findall(name)]
                found.update(parts, [name.lower()], [f"{parts[-1]}."] if parts else [])
        self.names = sorted({zlib.crc32(x.encode()) % NAME_BUCKETS for x in found})
        # the names around it, the nearest element's that has any
        self.around = () if parent is None else parent.names or parent.around
        self.beside = tag in BESIDE or (parent is not None and parent.beside and tag not in MAIN)
        self.main = tag in MAIN or (parent is not None and parent.main)
        self.control = tag in CONTROL or (parent is not None and parent.control)
        self.n_text = self.n_link = self.n_stops = 0
        self.label = LABEL in attrs


class Markup:
    """The tags of a page in one pass: each step gives the text before a tag, its name, closing or not, its attributes."""

    def __init__(self, source: str):
        self.source, self.at = source, 0
        self.none_left: set[str] = set()  # what was looked for to the end in vain

    def _find(self, what: str, at: int) -> int:
        if what in self.none_left:
            return -1
        found = self.source.find(what, at)
        if found < 0:
            self.none_left.add(what)
        return found

    def _tag_end(self, at: int) -> tuple[int, int]:
        """End of the attributes, and where text goes on; a quote only opens a value, and only if it is closed."""
        while True:
            m = STOP.search(self.source, at)
            if not m:
                return len(self.source), len(self.source)
            if m[0] == ">":
                return m.start(), m.end()
            if m[0] == "<":
                return m.start(), m.start()
            close = self._find(m[0][-1], m.end())
            at = m.end() if close < 0 else close + 1

    def skip_past(self, tag: str) -> None:
        """Go to the end tag of a raw element."""
        m = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(self.source, self.at)
        end = self._find(">", m.end()) if m else -1
        self.at = end + 1 if end >= 0 else len(self.source)

    def __iter__(self) -> Iterator[tuple[str, str, bool, str]]:
        source, end = self.source, len(self.source)
        while self.at < end:
            begin, look = self.at, self.at
            while True:
                start = source.find("<", look)
                if start < 0:
                    self.at = end
                    yield source[begin:], "", False, ""
                    return
                m = NAME.match(source, start + 1)
                if m:
                    stop, self.at = self._tag_end(m.end())
                    name = m[0].lower()
                    yield source[begin:start], name.lstrip("/"), name[0] == "/", source[m.end() : stop]
                    break
                if source.startswith("<!--", start):
                    close, skip = self._find("-->", start + 2), 3
                elif source.startswith(("<!", "<?", "</"), start):
                    close, skip = self._find(">", start), 1
                else:
                    look = start + 1
                    continue
                self.at = close + skip if close >= 0 else end
                yield source[begin:start], "", False, ""
                break


def parse(source: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block elements in page order, parents first, and the text blocks: (node's position, text)."""
    root = Node("html", None, "", 0)
    nodes, stack, blocks = [root], [root], []
    opened: Counter[str] = Counter()
    held: list[str] = []
    link = n_link = 0
    in_head = False

    def flush() -> None:
        nonlocal n_link
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            node = stack[-1]
            if text and not node.control:
                blocks.append((node.order, text))
                node.n_text += len(text)
                node.n_link += min(n_link, len(text))
                node.n_stops += text.count(". ") + text.count("? ") + text.count("! ") + text.endswith((".", "?", "!", ".”", '."'))
            held.clear()
        n_link = 0

    def leave(depth: int) -> None:
        nonlocal link
        for node in stack[depth:]:
            opened[node.tag] -= 1
        del stack[depth:]
        link = 0

    markup = Markup(source)
    for text, tag, closing, attrs in markup:
        if text and not in_head:
            held.append(text)
            if link:
                n_link += len(text.strip())
        if not tag:
            continue
        if tag == "head":
            flush()
            in_head = not closing
            continue
        if in_head and tag not in HEAD:
            in_head = False
        if tag in RAW:
            if not closing and not attrs.endswith("/"):
                markup.skip_past(tag)
                flush()
            continue
        if tag not in BLOCKS and not (in_head and tag in HEAD):
            if tag == "br":
                held.append(" ")
            elif tag == "a":
                link = 0 if closing else 1
            continue
        if in_head:
            continue
        flush()
        if closing:
            if opened[tag]:
                depth = len(stack) - 1
                while stack[depth].tag != tag:
                    depth -= 1
                leave(depth)
            continue
        if tag in VOID or tag in ("html", "body"):
            continue
        if any(opened[t] for t in CLOSED_BY.get(tag, ())):
            for i in range(len(stack) - 1, 0, -1):
                if tag in ENDS.get(stack[i].tag, ()):
                    leave(i)
                    break
                if stack[i].tag in SCOPE and stack[i].tag not in ENDS:
                    break
        node = Node(tag, stack[-1], attrs, len(nodes))
        nodes.append(node)
        if not attrs.endswith("/") or tag in P_ENDS:
            stack.append(node)
            opened[tag] += 1
    flush()
    return nodes, blocks


TAGS = ("p", "h1", "h2", "h3", "li", "ul", "div", "article", "main", "section", "td", "table", "blockquote", "pre", "header", "footer", "nav", "aside", "form")
#: Features beside tags and names: numbers of values of each, in the order of ``features``.
SIZES = (1, 5, 3, 3, 4, 4, 4, 4, 3, 2, 2, 3)
STARTS = [len(TAGS) + sum(SIZES[:i]) for i in range(len(SIZES))]
N_FEATURES = len(TAGS) + sum(SIZES) + 2 * NAME_BUCKETS
EDGES = 6


def features(nodes: list[Node]) -> list[list[int]]:
    """Numbers of the features that hold for each node."""
    spot = {t: i for i, t in enumerate(TAGS)}
    below, linked, stops, rows = ([0] * len(nodes) for _ in range(4))
    like: Counter[tuple] = Counter()
    for n in reversed(nodes):
        i = n.order
        below[i] += n.n_text
        linked[i] += n.n_link
        stops[i] += n.n_stops
        if n.parent is not None:
            j = n.parent.order
            below[j] += below[i]
            linked[j] += linked[i]
            stops[j] += stops[i]
            rows[j] += n.n_stops if n.tag != "div" or n.n_stops else 0
            like[(j, n.tag, *n.names)] += 1
    top = max(range(len(nodes)), key=lambda i: (rows[i], -i))
    over, at = set(), nodes[top]
    while at is not None:
        over.add(at.order)
        at = at.parent
    under = [False] * len(nodes)
    mains = sum(n.tag in MAIN and not (n.parent.main if n.parent else False) for n in nodes)
    whole = below[0] or 1
    out, seen_h1 = [], False
    for n in nodes:
        i = n.order
        under[i] = i == top or (n.parent is not None and under[n.parent.order])
        if n.tag == "h1" and not n.beside:
            seen_h1 = True
        alike = like[(n.parent.order, n.tag, *n.names)] if n.parent is not None and n.names else 1
        values = (
            0,
            0 if not n.n_text else 1 if n.n_text < 25 else 2 if n.n_text < 80 else 3 if n.n_text < 250 else 4,
            0 if n.n_link < 0.1 * n.n_text or not n.n_text else 1 if n.n_link < 0.5 * n.n_text else 2,
            min(2, n.n_stops),
            0 if not below[i] else 1 if linked[i] < 0.1 * below[i] else 2 if linked[i] < 0.5 * below[i] else 3,
            0 if below[i] < 0.05 * whole else 1 if below[i] < 0.3 * whole else 2 if below[i] < 0.7 * whole else 3,
            0 if i == top else 1 if under[i] else 2 if i in over else 3,
            0 if not mains else 1 if n.main and mains == 1 else 2 if n.main else 3,
            0 if n.beside and n.tag in BESIDE else 1 if n.beside else 2,
            int(seen_h1),
            int(alike > 2),
            min(2, stops[i]),
        )
        on = [s + v for s, v in zip(STARTS, values, strict=True)]
        if n.tag in spot:
            on.append(spot[n.tag])
        on += [N_FEATURES - NAME_BUCKETS + x for x in n.names]
        on += [N_FEATURES - 2 * NAME_BUCKETS + x for x in n.around]
        out.append(on)
    return out


def edge_kind(n: Node) -> int:
    """Edges are told apart by what the parent is, by its tag."""
    p = n.parent
    return 0 if p.tag in BESIDE else 1 if p.tag in MAIN else 2 if p.tag == "html" else 3 if p.tag == "div" else 4 if p.tag == "section" else 5


def messages(nodes: list[Node], unary: list[float], pair: list[list[float]]) -> tuple[list[float], list[tuple[int, list[float]]]]:
    """Marginals of being content, and for every edge (kind, joint marginals in the order 00 01 10 11; parent first).

    unary: log odds of content; pair: potentials of each kind of edge.  Upward: what a subtree says to its parent;
    downward: the rest of the page to each child.
    """
    n = len(nodes)
    up0, up1 = [1.0] * n, [math.exp(max(-30.0, min(30.0, u))) for u in unary]  # with the messages from the children
    said = [(1.0, 1.0)] * n
    for node in reversed(nodes):
        if node.parent is None:
            continue
        i, j = node.order, node.parent.order
        k = pair[edge_kind(node)]
        a, b = up0[i], up1[i]
        m0, m1 = k[0] * a + k[1] * b, k[2] * a + k[3] * b
        t = m0 + m1
        said[i] = (m0 / t, m1 / t)
        x, y = up0[j] * m0, up1[j] * m1
        t = x + y
        up0[j], up1[j] = x / t, y / t
    belief0, belief1 = up0[:], up1[:]
    marginals = [0.0] * n
    joints = []
    for node in nodes:
        i = node.order
        if node.parent is not None:
            j = node.parent.order
            kind = edge_kind(node)
            k = pair[kind]
            r0, r1 = belief0[j] / max(said[i][0], 1e-300), belief1[j] / max(said[i][1], 1e-300)
            q = [r0 * k[0] * up0[i], r0 * k[1] * up1[i], r1 * k[2] * up0[i], r1 * k[3] * up1[i]]
            t = sum(q)
            q = [x / t for x in q]
            joints.append((kind, q))
            belief0[i], belief1[i] = q[0] + q[2], q[1] + q[3]
        t = belief0[i] + belief1[i]
        belief0[i], belief1[i] = belief0[i] / t, belief1[i] / t
        marginals[i] = belief1[i]
    return marginals, joints


def train(pages: list[str], rounds: int = 60, rate: float = 0.25) -> tuple[list[float], list[list[float]]]:
    """Weights of the features and potentials of the edges, by gradient ascent of the pages' likelihood."""
    parsed = [(nodes, features(nodes)) for nodes, _ in map(parse, pages)]
    w, e = np.zeros(N_FEATURES), np.zeros((EDGES, 4))
    speed_w, speed_e = np.full(N_FEATURES, 1e-8), np.full((EDGES, 4), 1e-8)
    total = sum(len(n) for n, _ in parsed)
    for _ in range(rounds):
        gw, ge = -3e-6 * w, -1e-4 * e
        pair = np.exp(e).tolist()
        weights = w.tolist()
        for nodes, feats in parsed:
            marginals, joints = messages(nodes, [sum(weights[f] for f in on) for on in feats], pair)
            for node, on, p in zip(nodes, feats, marginals, strict=True):
                gw[on] += (node.label - p) / total
            for node, (kind, q) in zip(nodes[1:], joints, strict=True):
                ge[kind] -= np.array(q) / total
                ge[kind, 2 * node.parent.label + node.label] += 1 / total
        speed_w += gw * gw
        speed_e += ge * ge
        w += rate * gw / np.sqrt(speed_w)
        e += rate * ge / np.sqrt(speed_e)
    return w.tolist(), np.exp(e).tolist()


@lru_cache(maxsize=1)
def default_model(pages: int = 480) -> tuple[list[float], list[list[float]]]:
    return train([html_pages.page(i) for i in range(pages)])


def content_blocks(source: str | None, model: tuple[list[float], list[list[float]]]) -> list[str]:
    """Texts of the blocks that are content, in page order."""
    if not source:
        return []
    weights, pair = model
    nodes, blocks = parse(source)
    if not blocks:
        return []
    marginals, _ = messages(nodes, [sum(weights[f] for f in on) for on in features(nodes)], pair)
    return [text for i, text in blocks if marginals[i] > 0.5]


def extract(pages: DataFrame, model: tuple | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    model = model or default_model()

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                texts = ["\n".join(content_blocks(x.as_py(), model)) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_html_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
