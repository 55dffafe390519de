"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks at block-level tags. A linear classifier over tags, roles, class names, links and length gives
each block a cost of either label; the costs are capacities to the source (content) and the sink (boilerplate). Edges join
neighbours in the page and blocks of the same parent. The blocks on the source side of a minimum cut are the main text.

Null and empty pages and pages without content have the empty text. Missing end tags and cut-off pages are read as far as
they go. Repeated rows are extracted each; the whole page is always read.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator
from math import log1p

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import pick

# Attributes end at the first > outside a quoted value; a tag without end cuts the page off.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)>"
    r"|<[a-zA-Z/].*\Z|[^<]++|<",
    re.S,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
# Elements without markup inside and what may end them; in scripts, comments can hold whole script elements.
_RAW_END = {
    t: re.compile(rf"(?P<end></{t}(?=[\s/>]))" + (r"|<!--|-->|<script(?=[\s/>])" if t == "script" else ""), re.I)
    for t in ("script", "style", "title", "textarea", "iframe")
}
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# Kinds of HTML elements.
HIDDEN = set("script style title template noscript svg math iframe object canvas select textarea audio video".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub"
    " sup time tt u var wbr".split()
)
CLOSES_ITSELF = {"li", "td", "th", "tr", "dt", "dd", "option", "p"}
# Costs of the classifier: log-odds for content of elements above a block, of the block's own element, of names in attributes.
ABOVE = {
    "article": 4.0, "main": 4.0, "nav": -12.0, "aside": -10.0, "footer": -10.0, "header": -8.0, "form": -10.0, "button": -8.0,
    "label": -6.0, "dialog": -10.0, "menu": -8.0, "fieldset": -8.0,
}
OWN = {
    "p": 1.5, "h1": 1.5, "h2": 1.0, "h3": 1.0, "h4": 0.5, "blockquote": 1.0, "pre": 1.0, "figcaption": 0.5, "li": 0.0, "td": 0.0,
}
BOILERPLATE_NAMES = set(
    "ad ads adv advert advertisement advertising adverts banner billboard breadcrumb breadcrumbs byline comment comments"
    " consent cookie cookies copyright disclaimer discussion disqus feedback footer form header legal login masthead menu"
    " modal nav navbar navigation newsletter notice overlay pager pagination paywall popup promo promoted promotion rail"
    " recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe"
    " subscription tags teaser toolbar topbar tracking trending widget widgets alert announcement".split()
)
CONTENT_NAMES = {"article", "content", "entry", "main", "post", "story", "text"}
PARTS_OF_CONTENT = {"header", "byline", "tags", "teaser"}  # as in entry-header
ROLES = {
    "navigation": -12.0, "banner": -8.0, "contentinfo": -10.0, "complementary": -10.0, "search": -10.0, "form": -10.0,
    "alert": -10.0, "dialog": -10.0, "alertdialog": -10.0, "menu": -10.0, "main": 4.0, "article": 4.0,
}
NAMED_BOILERPLATE, NAMED_CONTENT = -10.0, 1.0
LENGTH, LINKS, BASE = 0.3, -5.0, 0.5
MOST_ABOVE = 4.0  # nested content elements do not outweigh a named boilerplate element
NEIGHBOUR, SAME_PARENT = 0.3, 0.7


def _element_cost(tag: str, attrs: str, in_content: bool) -> float:
    cost = ABOVE.get(tag, 0.0)
    if tag == "header" and in_content:
        cost = 0.0  # the heading of an article
    if attrs and "=" in attrs and tag not in ("html", "body"):
        for found in _ATTRIBUTE.finditer(attrs):
            value = found[2] or found[3] or found[4] or ""
            if found[1].lower() == "role":
                cost += ROLES.get(value.strip().lower(), 0.0)
                continue
            names = {x.lower() for x in _NAME.findall(value)}
            bad = names & BOILERPLATE_NAMES
            if names & CONTENT_NAMES and not bad - PARTS_OF_CONTENT:
                cost += NAMED_CONTENT
            elif bad and tag not in ("article", "main"):
                cost += NAMED_BOILERPLATE
    return cost


def _after_raw(page: str, tag: str, at: int) -> int:
    """Place behind the end tag of a raw-text element whose content begins at ``at``; the page's end if there is none."""
    commented = nested = False
    while found := _RAW_END[tag].search(page, at):
        at = found.end()
        if found["end"]:
            if not nested:
                return _TOKEN.match(page, found.start()).end()
            nested = False
        elif found[0] == "<!--":
            if not commented:
                commented, at = True, at - 2  # its dashes may belong to the end
        elif found[0] == "-->":
            commented = nested = False
        else:
            nested = commented
    return len(page)


def blocks(page: str) -> tuple[list[str], list[float], list[int]]:
    """Texts, costs and parents (numbers of elements) of the blocks of a page, in page order."""
    texts: list[str] = []
    costs: list[float] = []
    parents: list[int] = []
    stack: list[tuple[str, float, bool, int]] = [("", 0.0, False, 0)]  # tag, cost so far, inside article, number
    opened: Counter[str] = Counter()  # elements of the stack by tag, so that an end tag without partner costs no search
    parts: list[str] = []
    words_in_links = links_open = number = 0
    hidden = ""

    def flush() -> None:
        nonlocal words_in_links
        if parts:
            words = "".join(parts).split()
            parts.clear()
            if words:
                tag, cost, _, own = stack[-1]
                share = min(1.0, words_in_links / len(words))
                costs.append(cost + OWN.get(tag, 0.0) + LENGTH * log1p(len(words)) + LINKS * share + BASE)
                texts.append(" ".join(words))
                parents.append(stack[-2][3] if tag in OWN else own)
        words_in_links = 0

    tokens = _TOKEN.finditer(page)
    while token := next(tokens, None):
        tag = token["tag"]
        if tag is None:
            text = token[0]
            if hidden or (text[0] == "<" and len(text) > 1):
                continue
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if links_open:
                words_in_links += len(text.split())
            continue
        tag = tag.lower()
        raw = not token["end"] and tag in _RAW_END and not (token["attrs"] or "").endswith("/")
        if raw and hidden not in ("svg", "math"):
            tokens = _TOKEN.finditer(page, _after_raw(page, tag, token.end()))
            continue
        if hidden:
            if token["end"] and tag == hidden:
                hidden = ""
            continue
        if token["end"]:
            if tag == "a":
                links_open = max(0, links_open - 1)
            if tag in INLINE:
                continue
            flush()
            if opened[tag]:
                last = ""
                while last != tag:
                    last = stack.pop()[0]
                    opened[last] -= 1
                links_open = 0
            continue
        attrs = token["attrs"] or ""
        if tag in VOID:
            if tag in ("br", "hr", "img", "input"):
                flush() if tag == "hr" else parts.append(" ")
            continue
        if tag in HIDDEN:
            if not attrs.endswith("/"):
                hidden = tag
            continue
        if tag in INLINE:
            links_open += tag == "a"
            continue
        flush()
        links_open = 0
        # A paragraph ends where a block begins, an item where the next begins.
        if stack[-1][0] == "p" or (stack[-1][0] == tag and tag in CLOSES_ITSELF):
            opened[stack.pop()[0]] -= 1
        _, cost, inside, _ = stack[-1]
        number += 1
        cost = min(cost + _element_cost(tag, attrs, inside), MOST_ABOVE)
        stack.append((tag, cost, inside or tag in ("article", "main"), number))
        opened[tag] += 1
    flush()
    return texts, costs, parents


def minimum_cut(costs: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Whether each node is on the source side of a minimum cut; ties go to the sink.

    Nodes whose own cost outweighs all their edges are decided at once; their edges become costs of their neighbours.
    The rest is solved by augmenting shortest paths (Dinic).
    """
    near: list[dict[int, float]] = [{} for _ in costs]
    for (a, b), w in edges.items():
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    own, side = list(costs), [None] * len(costs)
    queue = deque(range(len(costs)))
    while queue:
        v = queue.popleft()
        if side[v] is None and abs(own[v]) > sum(near[v].values()):
            side[v] = own[v] > 0
            for u, w in near[v].items():
                del near[u][v]
                own[u] += w if side[v] else -w
                queue.append(u)
            near[v] = {}
    open_nodes = [v for v in range(len(costs)) if side[v] is None]
    if open_nodes:
        source, sink = -1, -2
        flow: dict[int, dict[int, float]] = {v: dict(near[v]) for v in open_nodes}
        flow[source], flow[sink] = {}, {}
        for v in open_nodes:
            flow[source][v], flow[v][source] = max(own[v], 0.0), 0.0
            flow[v][sink], flow[sink][v] = max(-own[v], 0.0), 0.0
        while True:
            level, queue = {source: 0}, deque([source])
            while queue:
                v = queue.popleft()
                for u, c in flow[v].items():
                    if c > 1e-9 and u not in level:
                        level[u] = level[v] + 1
                        queue.append(u)
            if sink not in level:
                break
            ways = {v: iter(list(flow[v])) for v in level}
            path = [source]
            while path:
                v = path[-1]
                if v == sink:
                    steps = list(zip(path, path[1:]))
                    sent = min(flow[a][b] for a, b in steps)
                    for a, b in steps:
                        flow[a][b] -= sent
                        flow[b][a] += sent
                    path = path[: 1 + next(k for k, (a, b) in enumerate(steps) if flow[a][b] <= 1e-9)]
                    continue
                for u in ways[v]:
                    if flow[v][u] > 1e-9 and level.get(u) == level[v] + 1:
                        path.append(u)
                        break
                else:
                    level.pop(v)
                    path.pop()
        for v in open_nodes:
            side[v] = v in level
    return [bool(s) for s in side]


def main_text(page: str | None) -> str:
    texts, costs, parents = blocks(page or "")
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for k, parent in enumerate(parents):
        if k:
            edges[(k - 1, k)] = NEIGHBOUR
        if parent in last:
            edges[(last[parent], k)] = edges.get((last[parent], k), 0.0) + SAME_PARENT
        last[parent] = k
    keep = minimum_cut(costs, edges)
    return "\n\n".join(t for t, good in zip(texts, keep) if good)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"]
        )


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` per row of ``pages(page_id, url, html)``."""
    rows = pick(pages, "page_id", "url", "html").withColumn("page_id", F.col("page_id").cast("long"))
    out = rows.mapInArrow(_extract, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
