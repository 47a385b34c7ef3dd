"""Main text of web pages by minimum-cut labelling of their text blocks.

A page is read once into blocks: runs of text that no block-level tag interrupts, each with its container path. A block's
log-odds of being content are a prior from its containers (article, nav, class names) and a logistic classifier over its text,
trained on a bounded sample whose labels come from semantic tags; a boilerplate container that holds most of a page's text counts only if
an article is outside of it, and main ends all those around it. They become terminal capacities; neighbouring blocks and blocks with the
same parent or grandparent are tied by smoothness edges. The minimum cut separates content from boilerplate. Blocks whose own
capacity is at least that of all their edges are settled first, which changes no minimum cut; maximum flow decides the rest.
"""

from __future__ import annotations

import re
from collections import deque
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintmill.llm.common import mapped

#: The classifier's sample: so many pages of the smallest ids, of so many characters at most.
TRAIN_PAGES = 200
TRAIN_CHARS = 50_000
#: A boilerplate container's prior is less than TEXT_LIMIT and the ties to both neighbours together; only hidden text is settled by its markup.
PRIOR_HIDDEN, PRIOR_CHROME, PRIOR_ARTICLE, PRIOR_OUTSIDE = -9.0, -4.0, 3.0, -3.5
TEXT_LIMIT = 2.5
TIE_NEXT, TIE_NEXT_APART, TIE_PARENT, TIE_GRANDPARENT = 1.0, 0.3, 0.5, 0.25

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|title|textarea|iframe|noscript|xmp)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>|<[!?/][^>]*+>",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PARTS = re.compile(r"[a-z]+|\d+")

INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data dfn em font i img input ins kbd label mark meter nobr output progress q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr del picture".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME_TAGS = frozenset("nav footer aside form dialog menu button select option datalist fieldset svg template object canvas audio video map head".split())
ARTICLE_TAGS = frozenset(["article", "main"])
#: Elements whose names say what they are about, not what they hold.
UNNAMED = frozenset("html body h1 h2 h3 h4 h5 h6 a abbr b cite code dfn em i kbd mark math pre q s samp strong sub sup u var".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ("p",)}
SCOPES = frozenset("ul ol dl table tbody thead select article section div main body aside nav footer header form td".split())
CHROME_WORDS = frozenset(
    "ad ads advert advertisement adverts adsense adslot adbox sponsor sponsored promo promotion banner nav navigation navbar menu breadcrumb breadcrumbs sidebar aside footer header masthead toolbar topbar "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay share sharing social comment comments reply replies respond disqus related recommended newsletter subscribe subscription "
    "signup signin login register search pagination pager widget widgets skip copyright disclaimer legal contentinfo complementary form dialog".split()
)
ARTICLE_WORDS = frozenset("article articlebody post entry content main story".split())
BLIND = frozenset("has with no without is not hide show".split())


def _role(tag: str, attributes: str, inside: bool) -> int:
    """-2 for a hidden element, -1 for a container of boilerplate, 1 for one of the article, 0 for neither; inside: an article is open already."""
    if tag not in ("html", "body", *ARTICLE_TAGS) and attributes and _HIDDEN.search(attributes):
        return -2
    if tag in CHROME_TAGS or tag == "header" and not inside:
        return -1
    if tag in ARTICLE_TAGS:
        return 1
    if tag in UNNAMED or not attributes:
        return 0
    good = False
    for m in _NAMES.finditer(attributes):
        # an id inside an article is the anchor of a section about something, unless it ends with the name of a container
        anchor = inside and m[1].lower() == "id"
        for name in (m[2] or m[3] or m[4] or "").lower().split():
            parts = _PARTS.findall(name)
            if not parts or parts[0] in BLIND:
                continue
            if parts[-1] in CHROME_WORDS and not (anchor and len(parts) > 1 and tag == "section") or parts[0] in CHROME_WORDS and not anchor and not ARTICLE_WORDS & set(parts):
                if not (parts[-1] == "header" and inside):
                    return -1
            good |= bool(ARTICLE_WORDS & set(parts))
    return int(good)


class Block:
    """``around``: the numbers of the boilerplate containers around it; wrappers of the page are taken out of them."""

    __slots__ = ("text", "link", "around", "hidden", "article", "heading", "parent", "grandparent")

    def __init__(self, text, link, around, hidden, article, heading, parent, grandparent):
        self.text, self.link, self.around, self.hidden, self.article, self.heading, self.parent, self.grandparent = text, link, around, hidden, article, heading, parent, grandparent

    @property
    def chrome(self) -> bool:
        return self.hidden or bool(self.around)


def _unwrap(blocks: list[Block]) -> list[Block]:
    """Take out what is no boilerplate container but a wrapper: most of the page's text is in it, and no article is outside of such containers."""
    shown = [b for b in blocks if not b.hidden]
    total = sum(len(b.text) for b in shown)
    while not any(b.article and not b.around for b in shown):
        outer: dict[int, int] = {}
        for b in shown:
            if b.around:
                outer[b.around[0]] = outer.get(b.around[0], 0) + len(b.text)
        wrapper = next((k for k, n in outer.items() if 2 * n > total), None)
        if wrapper is None:
            break
        for b in shown:
            if b.around and b.around[0] == wrapper:
                b.around = b.around[1:]
    return blocks


def blocks_of(html: str) -> list[Block]:
    """The text blocks of a page in page order, white space made single, empty ones left out."""
    out: list[Block] = []
    # tag, boilerplate containers, hidden, article, id of the nearest block-level element, of the one around it
    stack: list[tuple[str, tuple[int, ...], bool, bool, int, int]] = [("", (), False, False, 0, 0)]
    parts: list[str] = []
    link = 0
    links = 0
    elements = 0

    def flush() -> None:
        nonlocal link
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                _, around, hidden, article, parent, grandparent = stack[-1]
                heading = any(x[0] in ("h1", "h2", "h3", "h4", "h5", "h6") for x in stack[-3:])
                out.append(Block(text, min(1.0, link / len(text)), around, hidden, article, heading, parent, grandparent))
            parts.clear()
        link = 0

    def close_to(k: int) -> None:
        nonlocal links
        links -= sum(x[0] == "a" for x in stack[k:])
        del stack[k:]

    at = 0
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            text = unescape(html[at : m.start()])
            parts.append(text)
            if links:
                link += len(text.strip())
        at = m.end()
        tag = m[3] or m[6]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), m[2] or m[5], (m[4] if m[3] else m[7]) or ""
        block = tag not in INLINE
        if block:
            flush()
        elif tag in ("br", "img", "wbr"):
            parts.append(" " if tag == "br" else "")
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    close_to(k)
                    break
                if not block and stack[k][0] not in INLINE:
                    break
            continue
        if tag in VOID or attributes.endswith("/") and tag in INLINE:
            continue
        if tag in CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in CLOSES[tag]:
                    close_to(k)
                    break
                if stack[k][0] in SCOPES:
                    break
        _, around, hidden, article, parent, grandparent = stack[-1]
        role = _role(tag, attributes, article)
        elements += 1
        around = () if tag == "main" else (*around, elements) if role == -1 else around
        stack.append((tag, around, hidden or role == -2, article or role > 0, *((elements, parent) if block else (parent, grandparent))))
        links += tag == "a"
    if at < len(html):
        parts.append(unescape(html[at:]))
    flush()
    return _unwrap(out)


def features(block: Block) -> list[float]:
    text = block.text
    words = text.count(" ") + 1
    return [1.0, float(np.log1p(len(text))) - 4.0, block.link, float(text[-1] in ".!?:;\"')”’…»"), float(words < 5), float(words > 15), text.count(",") * 10.0 / len(text), float(block.heading), float("©" in text or "|" in text)]


N_FEATURES = 9


def train(pages: list[str], rounds: int = 200, penalty: float = 0.01) -> list[float]:
    """Weights of a logistic classifier over text features; semantic containers give the labels. Zeros without both labels."""
    rows = [(features(b), b.article and not b.chrome) for p in pages for b in blocks_of(p) if b.article or b.chrome]
    y = np.array([float(label) for _, label in rows])
    if not len(y) or y.min() == y.max():
        return [0.0] * N_FEATURES
    x = np.array([f for f, _ in rows])
    share = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w = np.zeros(N_FEATURES)
    for _ in range(rounds):
        w -= 2.0 * (x.T @ ((1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - y) * share) + penalty * w)
    return w.tolist()


def min_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source's side of a minimum cut; ``gain`` > 0 ties a node to the source, < 0 to the sink."""
    n = len(gain)
    gain = list(gain)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    side: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if side[i] is None and abs(gain[i]) >= sum(near[i].values()):
            side[i] = gain[i] > 0
            for j, w in near[i].items():
                del near[j][i]
                gain[j] += w if side[i] else -w
                queue.append(j)
            near[i] = {}
    rest = [i for i in range(n) if side[i] is None]
    if rest:
        flow = _max_flow_side(rest, gain, near)
        for i in rest:
            side[i] = i in flow
    return [bool(x) for x in side]


def _max_flow_side(rest: list[int], gain: list[float], near: list[dict[int, float]]) -> set[int]:
    """Dinic's algorithm between the terminals -1 (source) and -2 (sink); the nodes that the source reaches at the end."""
    cap: dict[int, dict[int, float]] = {i: dict(near[i]) for i in rest} | {-1: {}, -2: {}}
    for i in rest:
        source, sink = max(gain[i], 0.0), max(-gain[i], 0.0)
        cap[-1][i], cap[i][-1], cap[i][-2], cap[-2][i] = source, 0.0, sink, 0.0
    least = 1e-9
    while True:
        level = {-1: 0}
        queue = deque([-1])
        while queue:
            u = queue.popleft()
            for v, c in cap[u].items():
                if c > least and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if -2 not in level:
            return set(level) - {-1}
        turns = {u: iter(list(cap[u])) for u in cap}
        path = [-1]
        while path:
            u = path[-1]
            if u == -2:
                push = min(cap[a][b] for a, b in zip(path, path[1:], strict=False))
                for a, b in zip(path, path[1:], strict=False):
                    cap[a][b] -= push
                    cap[b][a] += push
                path = [-1]
                turns[-1] = iter(list(cap[-1]))
                continue
            for v in turns[u]:
                if cap[u][v] > least and level.get(v) == level[u] + 1:
                    path.append(v)
                    break
            else:
                level.pop(u, None)
                path.pop()
                if path:
                    turns[path[-1]] = iter(list(cap[path[-1]]))


def label(blocks: list[Block], weights: list[float], alone: list[bool] | None = None) -> list[bool]:
    """Which blocks are content; ``alone`` gets what each would be without its ties."""
    has_article = any(b.article and not b.chrome for b in blocks)
    gain = []
    for b in blocks:
        own = sum(w * x for w, x in zip(weights, features(b), strict=True))
        prior = PRIOR_HIDDEN if b.hidden else PRIOR_CHROME if b.chrome else PRIOR_ARTICLE if b.article else PRIOR_OUTSIDE if has_article else 0.0
        gain.append(prior + max(-TEXT_LIMIT, min(TEXT_LIMIT, own)))
    if alone is not None:
        alone.extend(g > 0 for g in gain)
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, TIE_NEXT if blocks[i - 1].parent == b.parent or blocks[i - 1].grandparent == b.grandparent else TIE_NEXT_APART))
        for key, weight in ((("parent", b.parent), TIE_PARENT), (("grandparent", b.grandparent), TIE_GRANDPARENT)):
            if last.get(key, i - 1) != i - 1:
                edges.append((last[key], i, weight))
            last[key] = i
    return min_cut(gain, edges)


def extract(html: str, weights: list[float]) -> str:
    blocks = blocks_of(html)
    return "\n".join(b.text for b, content in zip(blocks, label(blocks, weights), strict=True) if content)


def classifier(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", n_pages: int = TRAIN_PAGES, n_chars: int = TRAIN_CHARS) -> list[float]:
    """Weights from the ``n_pages`` pages of the smallest ids that have at most ``n_chars`` characters: a bounded sample.

    Only ids are ranked; the pages themselves are then fetched by their ids.
    """
    ids = [r[0] for r in pages.where((F.length(html_col) <= n_chars) & F.col(id_col).isNotNull()).select(id_col).orderBy(id_col).limit(n_pages).collect()]
    rows = pages.where(F.col(id_col).isin(ids) & (F.length(html_col) <= n_chars)).select(id_col, html_col).dropDuplicates([id_col]).collect()
    return train([r[1] for r in sorted(rows, key=lambda r: r[0])])


def extract_text(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", weights: list[float] | None = None) -> DataFrame:
    """page id, url, text, n_chars (code points) of each page.

    A null or empty page has an empty text. Repeated rows each give a row, an empty table none. Pages without any
    semantic container are labelled by their text and their neighbours alone. Other columns are not read.
    """
    weights = classifier(pages, id_col, html_col) if weights is None else weights
    kept = pages.select(id_col, "url", html_col)

    def run(batches):
        for batch in batches:
            texts = [extract(x, weights) if x else "" for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[id_col, "url", "text", "n_chars"])

    kinds = dict(kept.dtypes)
    return mapped(kept, run, f"`{id_col}` {kinds[id_col]}, url {kinds['url']}, text string, n_chars bigint")
