"""HTML main-text extraction by minimum-cut labelling.

A page becomes a sequence of text blocks. A logistic classifier over length,
links, punctuation, tag, place in the page, text under the same parent, and the
names of the elements around gives each block the log-odds of content; they are
the capacities of its edges to the two terminals. Neighbouring blocks, and
blocks whose parents are close in the element tree, are joined by edges that
charge for different labels. The minimum cut, found by maximum flow, is the
cheapest labelling of the page; blocks on the content side make up the text.

The classifier learns from the pages themselves: where a page names its article
(an element or role), blocks in and out of it are examples, once as they are
and once without any of the names, so that text alone decides where a page has
no names. Weights stay near ``START`` where pages don't say otherwise. At most
``SAMPLE`` pages of ``SAMPLE_BYTES`` at most are learned from, those with the
smallest hash; every page is labelled whole.

Null and empty pages, and pages without content, give an empty text. Broken
markup never fails: unclosed elements end with their parents, a lone ``<`` is
text. A very long page is cut as a whole, in memory that grows with its blocks.
A block whose costs tie is boilerplate. Null ids and urls stay null. Repeated
rows give equal results, an empty table an empty one; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCK - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "optgroup", "option", "legend", "frameset"}
BOILER = frozenset("nav footer aside form menu dialog select search head button fieldset".split())
NO_TEXT = frozenset("button select option input object svg canvas audio video math map".split())
HINT_OUT = re.compile(
    r"(?:^|[\W_])(?:ads?|advert\w*|banner|breadcrumbs?|byline-share|captcha|comments?|commentlist|cookies?|consent|copyright|disqus|disclaimer|dropdown|feedback|footer|gdpr|header|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|notification|outbrain|overlay|pagination|pager|popup|promo\w*|recommend\w*|related|repl(?:y|ies)|respond|search|share\w*|shoutbox|sidebar|signup|skip|social|sponsor\w*|subscribe|taboola|tags?|toolbar|toc|trending|widget)(?:$|[\W_\d])",
    re.I,
)
HINT_IN = re.compile(r"(?:^|[\W_])(?:article|articlebody|body-?text|content|entry|main|post|story|text)(?:$|[\W_\d])", re.I)
ROLE_OUT = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
WHITE = re.compile(r"[\s​]+")


@dataclass
class Node:
    tag: str
    parent: "Node | None"
    depth: int
    out: bool = False
    inside: bool = False
    link: bool = False
    mute: bool = False
    hint: bool = False


@dataclass
class Block:
    parent: Node
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    length: int = 0


def blocks(page: str) -> list[tuple[str, Node, float]]:
    """(text, element, share of linked characters) of every block, in page order."""
    root = Node("#root", None, 0)
    cur, found = root, []
    block: Block | None = None

    def close() -> None:
        nonlocal block
        if block is not None:
            text = WHITE.sub(" ", "".join(block.parts)).strip()
            if text:
                found.append((text, block.parent, block.linked / max(block.length, 1)))
            block = None

    def put(s: str) -> None:
        nonlocal block
        if not s or cur.mute:
            return
        if block is None:
            if not s.strip():
                return
            at = cur
            while at.parent is not None and at.tag not in BLOCK:
                at = at.parent
            block = Block(at)
        block.parts.append(s)
        block.length += len(s)
        if cur.link:
            block.linked += len(s)

    i, n = 0, len(page)
    while i < n:
        m = TOKEN.search(page, i)
        if m is None:
            put(html.unescape(page[i:]))
            break
        if m.start() > i:
            put(html.unescape(page[i : m.start()]))
        i = m.end()
        name = m[2]
        if name is None:
            if m[0].startswith("<![CDATA["):
                put(m[0][9:].removesuffix("]]>"))
            continue
        tag = name.lower()
        if m[1]:
            if tag == "br":
                put(" ")
                continue
            at = cur
            while at is not None and at.tag != tag:
                if tag not in BLOCK and at.tag in BLOCK:
                    at = None  # an inline end tag closes nothing beyond its block
                    break
                at = at.parent
            if tag in BLOCK:
                close()
            if at is not None and at.parent is not None:
                cur = at.parent
            continue
        if tag == "br":
            put(" ")
            continue
        if tag in BLOCK:
            close()
            if tag in ENDS_P:
                at = cur
                while at.parent is not None and at.tag not in BLOCK:
                    at = at.parent
                if at.tag == "p":
                    cur = at.parent
            shut = {"li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}.get(tag)
            at = cur
            while shut and at.parent is not None and at.tag not in shut[1]:
                if at.tag in shut[0].split():
                    cur = at.parent
                    if tag != "tr" or at.tag == "tr":
                        break
                at = at.parent
        if tag in VOID:
            continue
        attrs = {a.lower(): b or c or d or "" for a, b, c, d in ATTR.findall(m[3])}
        words = f"{attrs.get('class', '')} {attrs.get('id', '')}"
        node = Node(tag, cur, cur.depth + 1, cur.out, cur.inside, cur.link or tag == "a", cur.mute, cur.hint)
        if tag in ("article", "main") or attrs.get("role") in ("main", "article") or attrs.get("itemprop") == "articleBody":
            node.inside = True
        if tag in BOILER or tag == "header" or attrs.get("role", "").lower() in ROLE_OUT or HINT_OUT.search(words) and tag not in ("body", "html", "main"):
            node.out = True
        if HINT_IN.search(words) and not node.out:
            node.hint = True
        if tag in NO_TEXT or "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I):
            node.mute = True
        if m[3].rstrip().endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)", re.I).search(page, i)
            i = end.end() if end else n
            continue
        cur = node
    close()
    return found


SENTENCE = re.compile(r"[.!?。]+(?:\s|$)|[,;:]\s")
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dd figcaption".split())
CELLS = frozenset("li td th dt option label legend".split())
#: Prior weights: bias, length, links, sentence end, punctuation, prose tag, cell tag, edge of the page, text under the parent, share of the page; then names: in the article, boilerplate, outside the article, content.
START = np.array([-2.5, 1.5, -4.0, 0.7, 0.7, 1.2, -0.5, -0.7, 1.5, 1.0, 4.0, -9.0, -6.0, 1.5])
NAMES = 10  # features from here on come from names
SAMPLE, SAMPLE_BYTES = 1000, 1 << 18
SMOOTH = 0.8
MOST = 12.0


def features(found: list[tuple[str, Node, float]]) -> np.ndarray:
    """A row for each block."""
    n = len(found)
    under: dict[int, int] = {}
    for text, node, _ in found:
        under[id(node.parent)] = under.get(id(node.parent), 0) + len(text)
    total = sum(len(b[0]) for b in found)
    named = any(b[1].inside and not b[1].out for b in found)
    rows = []
    for i, (text, node, linked) in enumerate(found):
        size, near = len(text), under[id(node.parent)]
        inside = node.inside and not node.out
        rows.append(
            (1.0, np.log1p(size) / 5, linked, text[-1] in ".!?:;\"'”»…。", min(20 * len(SENTENCE.findall(text)) / size, 2.0), node.tag in PROSE, node.tag in CELLS, abs(2 * (i + 0.5) / n - 1) ** 4, np.log1p(near) / 7, near / total)
            + (inside, node.out, named and not inside and not node.out, node.hint and not node.out and not inside)
        )
    return np.array(rows, float)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features and labels of the blocks of pages that name their article."""
    for b in batches:
        for page in b.column(0):
            found = blocks(page.as_py() or "")
            y = [n.inside and not n.out for _, n, _ in found]
            if any(y):
                yield pa.RecordBatch.from_pydict({"x": [features(found).tobytes()], "y": [np.array(y, np.uint8).tobytes()]})


def fit(pages: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights of the classifier. The driver gets features of ``sample`` pages at most."""
    page = pages.select(F.col("html").alias("h"), F.xxhash64("html").alias("r")).where(F.octet_length("html") <= SAMPLE_BYTES)
    got = page.orderBy("r").limit(sample).select("h").mapInArrow(_examples, "x binary, y binary").collect()
    if not got:
        return START
    x = np.concatenate([np.frombuffer(r.x).reshape(-1, len(START)) for r in got])
    y = np.concatenate([np.frombuffer(r.y, np.uint8) for r in got]).astype(float)
    bare = x.copy()
    bare[:, NAMES:] = 0
    x, y = np.concatenate([x, bare]), np.concatenate([y, y])
    w, ridge = START.copy(), 2.0 + len(y) / 2000
    for _ in range(20):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * (w - START))
        w += np.clip(step, -1, 1)
    return w


def costs(found: list[tuple[str, Node, float]], weights: np.ndarray = START) -> list[tuple[float, float]]:
    """(cost of calling it boilerplate, cost of calling it content) of each block: its log-odds on one side or the other."""
    odds = np.clip(features(found) @ weights, -MOST, MOST)
    return [(max(float(z), 0.0), max(-float(z), 0.0)) for z in odds]


def proximity(a: Node, b: Node) -> float:
    """1 for the same element, halved with each step between the two in the tree."""
    steps, x, y = 0, a, b
    while x is not y:
        if x.depth >= y.depth:
            x = x.parent
        else:
            y = y.parent
        steps += 1
    return 0.5 ** max(0, steps - 1)


def min_cut(good: list[float], bad: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay on the source side of a minimum cut, by blocking flows on level graphs.

    good: capacities from the source; bad: capacities to the sink; edges: both ways.
    """
    n = len(good)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    adj: list[list[int]] = [[] for _ in range(n + 2)]

    def add(a: int, b: int, c: float, back: float) -> None:
        adj[a].append(len(to)), to.append(b), cap.append(c)
        adj[b].append(len(to)), to.append(a), cap.append(back)

    for i in range(n):
        through = min(good[i], bad[i])  # what goes straight from source to sink needs no search
        if good[i] > through:
            add(s, i, good[i] - through, 0.0)
        elif bad[i] > through:
            add(i, t, bad[i] - through, 0.0)
    for a, b, c in edges:
        add(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in adj[a]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                f = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= f
                    cap[e ^ 1] += f
                k = next(i for i, e in enumerate(path) if cap[e] <= 1e-9)
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while at[a] < len(adj[a]):
                e = adj[a][at[a]]
                if cap[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    break
                at[a] += 1
            if at[a] < len(adj[a]):
                path.append(e)
                a = to[e]
            elif a == s:
                break
            else:
                level[a] = -1
                a = to[path.pop() ^ 1]


def label(found: list[tuple[str, Node, float]], weights: np.ndarray = START, smooth: float = SMOOTH) -> list[bool]:
    """Which blocks are content."""
    if not found:
        return []
    pairs = costs(found, weights)
    edges = [(i, i + 1, smooth * proximity(found[i][1], found[i + 1][1])) for i in range(len(found) - 1)]
    last: dict[int, int] = {}
    for i, b in enumerate(found):  # the block before under the same parent, where it isn't the neighbour
        p = id(b[1].parent)
        if p in last and last[p] < i - 1:
            edges.append((last[p], i, smooth / 2))
        last[p] = i
    return min_cut([p[0] for p in pairs], [p[1] for p in pairs], edges)


def extract(page: str | None, weights: np.ndarray = START, smooth: float = SMOOTH) -> str:
    """The main text of one page."""
    found = blocks(page or "")
    return "\n\n".join(b[0] for b, k in zip(found, label(found, weights, smooth)) if k)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    weights = fit(pages)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [extract(x.as_py(), weights) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(f, "page_id long, url string, text string, n_chars long")
