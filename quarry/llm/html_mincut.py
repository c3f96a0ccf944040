"""Main text of web pages by minimum-cut labelling of their blocks.

A page becomes a sequence of text blocks with the elements around them. A logistic classifier gives each block
a probability of being content; the costs -log p and -log(1 - p) become terminal capacities. Neighbouring blocks, and blocks that are
close in the element tree (same parent, same grandparent), are joined by smoothness edges, heavier the closer they are. The minimum cut
separates content from boilerplate: a block whose own evidence is weak follows its neighbours. Blocks whose terminal outweighs all their
edges are settled first (their label holds in every minimum cut), and max-flow runs on the rest.

The classifier is fitted to the pages at hand without labelled data: blocks inside an article or main element count as content and blocks
inside navigation, asides, forms or elements named like boilerplate as the rest; every second one is learned from without those very
features, so that length, links, punctuation and place carry weight of their own and decide on pages without such elements. Weights are
drawn towards PRIOR. The sample is at most PAGES distinct pages of up to LONGEST bytes, at most SEEDS blocks of each.

Cases: null or empty html gives the empty text; unclosed elements end with their parent or the page; an unclosed script,
style, comment or tag reaches to the end; text without any element is one block; references are decoded, unknown ones
stay as written; pages are read whole in time linear in their length and depth; pages without any seed leave PRIOR as it is; repeated rows
each give a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import small_batches
from quarry.llm.folds import sampled

_START = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?])|(/?)([a-zA-Z][a-zA-Z0-9:_-]*+))")
#: The rest of a tag: quotes hold after an equals sign. Possessive, so a tag is read once.
_REST = re.compile(r"((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>")
_QUOTED = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*')")
_CUE = re.compile(r"\b(class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Elements whose inside is not markup, and those whose text is never shown as text.
_RAW = {"script", "style", "textarea", "iframe", "noframes", "xmp", "title"}
_HIDDEN = _RAW | {"head", "template", "noscript", "svg", "object", "canvas", "select", "button", "datalist", "audio", "video", "map"}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: An opening tag ends an open element of these names (up to the named container).
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words in class, id and role that speak against content, and for it.
_AGAINST = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alerts?|comments?|disqus|repl(?:y|ies)|respond|discussion|side-?bar|aside|menu|nav\w*|breadcrumbs?|pagination|pager|footer|header|masthead|contentinfo|complementary|toolbar|share|sharing|social|related|recommend\w*|popup|modal|overlay|newsletter|subscri\w+|signup|login|widget|tags?|search|skip|copyright|disclaimer|legal)(?:$|[\s_-])",
    re.I,
)
_FOR = re.compile(r"(?:^|[\s_-])(?:article\w*|content|main|post|entry|story|body|text|article-?body)(?:$|[\s_-])", re.I)
#: Features of a block, and the weights (log odds of content) that the fit starts from.
PRIOR = {"bias": -0.6, "boiler": -7.0, "article": 3.5, "cue": 1.5, "links": -3.0, "long": 1.6, "sentence": 0.8, "heading": 0.6, "item": -0.4, "notice": -2.0}
NAMES = list(PRIOR)
NEAR, FAR, SIBLING, COUSIN, SCALE = 0.6, 0.15, 0.6, 0.25, 1 << 20
PAGES, LONGEST, SEEDS, PULL, WEIGHT = 600, 1 << 20, 100, 1.0, 2000.0
_NOTICE = re.compile(r"©|all rights reserved|cookies?\b.{0,40}\b(?:accept|agree|use)|subscribe|sign up|share this", re.I)
_HEADS = {"h1", "h2", "h3", "h4", "h5", "h6"}


class Node:
    __slots__ = ("tag", "parent", "depth", "box", "head", "boiler", "article", "cue", "hidden")

    def __init__(self, tag: str, parent: Node | None, attrs: str = ""):
        self.tag, self.parent, self.depth = tag, parent, parent.depth + 1 if parent else 0
        self.box = self if parent is None or tag in _BLOCK else parent.box
        self.head = tag in _HEADS or bool(parent and parent.head)
        self.boiler = bool(parent and parent.boiler)
        self.article = bool(parent and parent.article)
        self.cue = bool(parent and parent.cue)
        self.hidden = bool(parent and parent.hidden) or tag in _HIDDEN
        inside = self.article
        if tag in ("article", "main"):
            # an article inside a list of comments or a sidebar stays boilerplate
            self.article = not self.boiler
        elif tag in ("nav", "aside", "form", "dialog", "menu") or (tag in ("footer", "header") and not inside):
            self.boiler = True
        if attrs:
            for m in _CUE.finditer(attrs):
                value = m[2] or m[3] or m[4] or ""
                if tag not in ("html", "body", "main", "article") and _AGAINST.search(value):
                    self.boiler = True
                elif _FOR.search(value):
                    self.cue = True
            if re.search(r"(?:^|\s)hidden(?:\s|=|$)", _QUOTED.sub("=", attrs), re.I) or re.search(r"display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", attrs, re.I):
                self.hidden = True
        if tag == "footer" and inside:
            self.boiler = True


class Block:
    __slots__ = ("text", "node", "linked", "heading")

    def __init__(self, text: str, node: Node, linked: int, heading: bool):
        self.text, self.node, self.linked, self.heading = text, node, linked, heading


#: A block ends an open paragraph, if none of these was opened since.
_AROUND = ("td", "th", "li", "div", "article", "section", "body", "button")


class _Tree:
    """Open elements, with the open ones of each name at hand, so that no search climbs the whole depth."""

    def __init__(self):
        self.node, self.links, self.of = Node("#root", None), 0, {}

    def open(self, tag: str, attrs: str) -> None:
        self.node = Node(tag, self.node, attrs)
        self.of.setdefault(tag, []).append(self.node)
        self.links += tag == "a"

    def deepest(self, tags) -> Node | None:
        return max((self.of[t][-1] for t in tags if self.of.get(t)), key=lambda n: n.depth, default=None)

    def close(self, n: Node) -> None:
        while self.node is not n.parent:
            self.of[self.node.tag].pop()
            self.links -= self.node.tag == "a"
            self.node = self.node.parent


def blocks(page: str) -> list[Block]:
    """Text blocks in page order; runs of white space are one space."""
    out: list[Block] = []
    tree = _Tree()
    buffer: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html_lib.unescape("".join(buffer)).split())
        if text:
            out.append(Block(text, tree.node.box, min(linked, len(text)), tree.node.box.head))
        buffer.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if text and not tree.node.hidden:
            buffer.append(text)
            if tree.links:
                linked += len(text.strip())

    at, end = 0, len(page)
    while at < end:
        m = _START.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if not m[5]:
            shut = "-->" if m[1] else "]]>" if m[2] else ">"
            k = page.find(shut, at)
            at = k + len(shut) if k >= 0 else end
            continue
        rest = _REST.match(page, at)
        if rest is None:  # a tag that the page's end broke off
            break
        at = rest.end()
        tag, attrs = m[5].lower(), rest[1]
        if m[4]:
            if tag in _BLOCK:
                flush()
            if tree.of.get(tag):
                tree.close(tree.of[tag][-1])
            continue
        if tag == "hr":
            flush()
        elif tag == "br":
            buffer.append(" ")
        if tag in _VOID:
            continue
        if tag in _BLOCK:
            flush()
            names, stop = _ENDS.get(tag, (("p",), _AROUND))
            n, stopper = tree.deepest(names), tree.deepest(stop)
            if n is not None and (stopper is None or stopper.depth < n.depth):
                tree.close(n)
        if tag in _RAW:
            shut = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = shut.end() if shut else end
            continue
        if tag not in _BLOCK and re.search(r"(?:^|[\s\"'])/\s*$", attrs):
            continue
        tree.open(tag, attrs)
    flush()
    return out


def features(b: Block) -> list[float]:
    """The block's values of NAMES."""
    n = b.node
    notice = not n.boiler and not n.article and bool(_NOTICE.search(b.text))
    return [
        1.0, n.boiler, n.article and not n.boiler, n.cue and not n.boiler, b.linked / max(1, len(b.text)), min(1.0, len(b.text) / 120),
        b.text[-1] in ".!?…\"'”)" and " " in b.text, b.heading, n.tag in ("li", "td", "th"), notice,
    ]


def seeds(found: list[Block], most: int = SEEDS) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows and labels of at most `most` blocks that the elements around them tell, evenly over the page."""
    sure = [b for b in found if b.node.boiler or b.node.article]
    sure = [sure[k * len(sure) // most] for k in range(most)] if len(sure) > most else sure
    x = np.array([features(b) for b in sure], np.float64).reshape(len(sure), len(NAMES))
    x[1::2, NAMES.index("boiler") : NAMES.index("cue") + 1] = 0
    return x, np.array([not b.node.boiler for b in sure], np.float64)


def fit(x: np.ndarray, y: np.ndarray, pull: float = PULL, weight: float = WEIGHT) -> np.ndarray:
    """Weights of the logistic classifier by Newton steps; the rows count as at most `weight`, the prior as `pull`."""
    prior = np.array(list(PRIOR.values()))
    w = prior.copy()
    share = min(1.0, weight / max(1, len(y)))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = share * (x.T @ (p - y)) + pull * (w - prior)
        bend = share * (x.T * (p * (1 - p))) @ x + pull * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= step * min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-9:
            break
    return w


def graph(found: list[Block], weights: np.ndarray | None = None) -> tuple[list[float], dict[tuple[int, int], float]]:
    """Terminal capacities (log odds; positive: for content) and smoothness edges."""
    w = np.array(list(PRIOR.values())) if weights is None else weights
    terminal = np.clip(np.array([features(b) for b in found], np.float64) @ w, -30, 30).tolist()
    edges: dict[tuple[int, int], float] = {}
    last: dict[tuple[int, int], int] = {}
    for i, b in enumerate(found):
        up = b.node.parent
        over = up.parent if up else None
        if i:
            other = found[i - 1].node.parent
            close = up is not None and other is not None and (up is other or over is other or up is other.parent)
            edges[i - 1, i] = NEAR if close else FAR
        for level, weight, n in ((1, SIBLING, up), (2, COUSIN, over)):
            if n is not None:
                j = last.get((level, id(n)))
                if j is not None:
                    edges[j, i] = edges.get((j, i), 0.0) + weight
                last[level, id(n)] = i
    return terminal, edges


def minimum_cut(terminal: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Labels (True: content) of a minimum cut; a tie leaves a block out."""
    n = len(terminal)
    t = [round(x * SCALE) for x in terminal]
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for (i, j), w in edges.items():
        c = round(w * SCALE)
        near[i][j] = near[i].get(j, 0) + c
        near[j][i] = near[j].get(i, 0) + c
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(t[i]) > sum(near[i].values()):
            label[i] = t[i] > 0
            for j, c in near[i].items():
                t[j] += c if label[i] else -c
                near[j].pop(i)
                queue.append(j)
            near[i] = {}
    left = [i for i in range(n) if label[i] is None]
    if left:
        for i, content in zip(left, _max_flow([t[i] for i in left], [near[i] for i in left], left), strict=True):
            label[i] = content
    return [bool(x) for x in label]


def _max_flow(t: list[int], near: list[dict[int, int]], names: list[int]) -> list[bool]:
    """The source side of a minimum cut (Dinic's algorithm with current arcs)."""
    place = {v: k for k, v in enumerate(names)}
    n = len(t)
    source, sink = n, n + 1
    head: list[int] = []
    cap: list[int] = []
    arcs: list[list[int]] = [[] for _ in range(n + 2)]

    def arc(a: int, b: int, forth: int, back: int) -> None:
        arcs[a].append(len(head))
        head.append(b)
        cap.append(forth)
        arcs[b].append(len(head))
        head.append(a)
        cap.append(back)

    for i in range(n):
        if t[i] > 0:
            arc(source, i, t[i], 0)
        elif t[i] < 0:
            arc(i, sink, -t[i], 0)
        for j, c in near[i].items():
            if place[j] > i:
                arc(i, place[j], c, c)
    while True:
        depth = [-1] * (n + 2)
        depth[source] = 0
        queue = deque([source])
        while queue:
            i = queue.popleft()
            for e in arcs[i]:
                if cap[e] > 0 and depth[head[e]] < 0:
                    depth[head[e]] = depth[i] + 1
                    queue.append(head[e])
        if depth[sink] < 0:
            return [depth[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        i = source
        while True:
            if i == sink:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                k = next(k for k, e in enumerate(path) if not cap[e])  # back to the first full arc
                i = head[path[k] ^ 1]
                del path[k:]
                continue
            while at[i] < len(arcs[i]):
                e = arcs[i][at[i]]
                if cap[e] > 0 and depth[head[e]] == depth[i] + 1:
                    break
                at[i] += 1
            if at[i] < len(arcs[i]):
                path.append(e)
                i = head[e]
            elif path:
                depth[i] = -1
                i = head[path.pop() ^ 1]
                at[i] += 1
            else:
                break


def extract(page: str | None, weights: np.ndarray | None = None) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    keep = minimum_cut(*graph(found, weights))
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def learned(pages: DataFrame, most: int = PAGES) -> np.ndarray:
    """The classifier's weights, fitted to a bounded sample of pages(page_id, html)."""
    rows = pages.select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")).where(F.octet_length("html") <= LONGEST)

    def run(batches):
        for b in batches:
            got = [seeds(blocks(h)) for h in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x, _ in got], pa.binary()), pa.array([y.tobytes() for _, y in got], pa.binary())], ["x", "y"])

    got = sampled(rows, [], most).select("text").mapInArrow(run, "x binary, y binary").toArrow().to_pydict()
    order = sorted(range(len(got["x"])), key=lambda i: (got["x"][i], got["y"][i]))
    x = np.concatenate([np.zeros((0, len(NAMES))), *(np.frombuffer(got["x"][i]).reshape(-1, len(NAMES)) for i in order)])
    return fit(x, np.concatenate([np.zeros(0), *(np.frombuffer(got["y"][i]) for i in order)]))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every row of pages(page_id, url, html), one Arrow pass."""
    types = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    weights = learned(pages)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([extract(h, weights) for h in b.column(2).to_pylist()], pa.string())], ["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"{types}, text string")


def op5(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    rows = main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return rows.selectExpr("page_id", "url", "text", "cast(char_length(text) as bigint) as n_chars")
