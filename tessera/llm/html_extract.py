"""Main text of web pages by minimum-cut labelling.

A page is read into text blocks. A linear classifier over a block's marks, place, links, length, ending and element gives
its log odds of being content; these become the capacities to the two terminals. Blocks that follow each other, and
blocks near each other in the DOM, are joined by smoothness edges. The minimum cut, found by max-flow, is the cheapest
labelling. The classifier is fitted to a bounded sample of the pages that say themselves what their article is; the
sample is read with and without these signs, so that it also learns what content looks like where nothing says so.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame

from .workspace import ship, small_batches

# Fixed values of HTML.
#: Elements whose content is never text of the page. Of these only svg, being foreign to HTML, may close itself.
DROPPED = ("script", "style", "noscript", "template", "iframe", "svg", "textarea", "title", "select", "canvas", "audio", "video")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li legend main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: A start tag of the key ends an open element of the values, up to the nearest of the stops.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words in class, id or role attributes that mark boilerplate.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright dialog disqus "
    "footer footnav form gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notices notification outbrain pager pagination popup promo promotion "
    "recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe subscription taboola tags teaser toolbar topbar widget widgets".split()
)
ASIDE = frozenset("aside nav footer form button menu dialog fieldset label input datalist".split())
BODY = frozenset("article main".split())
GOOD = frozenset("article articlebody content entry main post story text".split())

#: The inside of a tag: quotes hold a value only after an equals sign, else they are stray characters. Possessive, so that
#: each tag is scanned once whatever it holds.
INSIDE = r"(?:[^<>\"'=/]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"']|/(?!>))*+"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<svg(?=[\s/>]){INSIDE}/>|<(?P<raw>" + "|".join(DROPPED) + rf")(?=[\s/>]){INSIDE}/?>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>{INSIDE})/?>|<[!?][^>]*>?|(?P<text>[^<]+|<)",
    re.S | re.I,
)
MARKED = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
LETTERS = re.compile(r"[A-Za-z][a-z]*")


class Block:
    __slots__ = ("chars", "good", "inside", "linked", "marked", "own", "parent", "parts", "tag", "text")

    def __init__(self, tag: str, own: int, parent: int, marked: bool, inside: bool, good: bool):
        self.tag, self.own, self.parent, self.marked, self.inside, self.good = tag, own, parent, marked, inside, good
        self.parts: list[str] = []
        self.chars = self.linked = 0
        self.text = ""


def blocks_of(page: str) -> list[Block]:
    """Non-empty text blocks in page order, with white space folded and character references decoded."""
    out: list[Block] = []
    # an open element: tag, serial number, in boilerplate, in an article, named as content, inside a link
    open_: list[tuple[str, int, bool, bool, bool, bool]] = [("", 0, False, False, False, False)]
    serial, now = 0, None

    def close(index: int) -> None:
        nonlocal now
        if any(e[0] in BLOCK for e in open_[index:]):
            now = None
        del open_[index:]

    for m in TOKEN.finditer(page):
        kind = m.lastgroup
        if kind == "text":
            raw = m["text"]
            if now is None:
                if raw.isspace():
                    continue
                held = list(islice((e for e in reversed(open_) if e[0] in BLOCK), 2))  # the block element that holds the text, and the one around it
                holder, around = (*held, open_[0], open_[0])[:2]
                now = Block(holder[0], holder[1], around[1], open_[-1][2], open_[-1][3], open_[-1][4])
                out.append(now)
            now.parts.append(raw)
            n = len(raw)
            now.chars += n
            if open_[-1][5]:
                now.linked += n
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            for i in range(len(open_) - 1, 0, -1):
                if open_[i][0] == tag:
                    close(i)
                    break
            continue
        if tag in VOID:
            if tag == "hr":
                now = None
            elif tag == "br" and now is not None:
                now.parts.append(" ")
            continue
        if tag in BLOCK:
            for i in range(len(open_) - 1, 0, -1):  # a block ends an open paragraph
                if open_[i][0] == "p":
                    close(i)
                    break
                if open_[i][0] in BLOCK:
                    break
            now = None
        if tag in ENDS:
            ended, stops = ENDS[tag]
            for i in range(len(open_) - 1, 0, -1):
                if open_[i][0] in stops:
                    break
                if open_[i][0] in ended:
                    close(i)
                    break
        top = open_[-1]
        names = {w.lower() for a in MARKED.findall(m["attrs"]) for w in LETTERS.findall("".join(a))} if m["attrs"] else ()
        marked = top[2] or tag in ASIDE or (tag == "header" and not top[3]) or (bool(names) and not MARKS.isdisjoint(names) and tag not in ("body", "html", *BODY))
        serial += 1
        open_.append((tag, serial, marked, top[3] or tag in BODY, top[4] or (bool(names) and not GOOD.isdisjoint(names)), top[5] or tag == "a"))
    for b in out:
        b.text = " ".join(html.unescape("".join(b.parts)).split())
    return [b for b in out if b.text]


#: What a block is known by; `outside`: not in the article of a page that has one.
FEATURES = ("bias", "marked", "inside", "outside", "good", "links", "words", "few_words", "ends", "paragraph", "heading", "item")
#: Weights where no page says what its article is, set by hand; fitted ones start from here and are drawn back to it.
WEIGHTS = (0.0, -15.0, 10.0, 0.0, 4.0, -6.0, 5.0, -2.0, 1.5, 1.0, 1.5, -1.0)
#: Capacity of a unit of log odds, and the most that a block's own capacity comes to.
SCALE, MOST_CAPACITY = 4, 80


def features(block: Block, has_body: bool, signs: bool = True, marks: bool = True) -> list[float]:
    """FEATURES of a block of a page; without `signs` as if nothing were in or out of an article or named as content, without `marks` as if nothing were marked."""
    words = block.text.count(" ") + 1
    inside, marked = signs and block.inside, marks and block.marked
    return [
        1.0, float(marked), float(inside), float(signs and has_body and not block.inside), float(signs and block.good and not inside), block.linked / max(1, block.chars), min(words, 40) / 40,
        float(words < 10 and not inside), float(words > 3 and block.text[-1:] in ".!?…\"”»:"), float(block.tag in ("p", "pre", "blockquote")), float(block.tag in ("h1", "h2", "h3") and not marked),
        float(block.tag in ("li", "td", "th", "body", "html", "") and not inside),
    ]


def costs(block: Block, has_body: bool, weights: tuple[float, ...] = WEIGHTS) -> tuple[int, int]:
    """(cost of content, cost of boilerplate): the classifier's log odds as a capacity against the label that they speak against."""
    odds = sum(w * x for w, x in zip(weights, features(block, has_body), strict=True))
    capacity = max(-MOST_CAPACITY, min(MOST_CAPACITY, round(SCALE * odds)))
    return max(0, -capacity), max(0, capacity)


def min_cut(terminals: list[tuple[int, int]], edges: list[tuple[int, int, int]]) -> list[bool]:
    """True for nodes on the source side. terminals: (capacity to the sink, capacity from the source); edges: (a, b, capacity both ways).

    Max-flow by blocking flows on level graphs, over the excess that is left when each node's two terminal capacities
    have cancelled. A phase is linear in the graph, and there is one for each length of a shortest path at most; on
    chains of blocks these are short, as capacities are small. On a tie a node stays on the sink side unless the source
    still reaches it.
    """
    n = len(terminals)
    excess = [source - sink for sink, source in terminals]
    joined: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, c in edges:
        if a != b and c > 0:
            joined[a][b] = joined[a].get(b, 0) + c
            joined[b][a] = joined[b].get(a, 0) + c
    near = [list(row) for row in joined]
    while True:
        level = {i: 0 for i in range(n) if excess[i] > 0}
        queue, met = deque(level), False
        while queue:
            i = queue.popleft()
            for j in near[i]:
                if j not in level and joined[i][j] > 0:
                    level[j] = level[i] + 1
                    met |= excess[j] < 0
                    queue.append(j)
        if not met:
            return [i in level for i in range(n)]
        at = [0] * n  # the next neighbour to try; what has failed in this phase is not tried again
        for start in [i for i, depth in level.items() if depth == 0]:
            path = [start]
            while excess[start] > 0:
                i = path[-1]
                if excess[i] < 0:
                    flow = min([excess[start], -excess[i], *(joined[x][y] for x, y in zip(path, path[1:], strict=False))])
                    excess[start] -= flow
                    excess[i] += flow
                    for x, y in zip(path, path[1:], strict=False):
                        joined[x][y] -= flow
                        joined[y][x] += flow
                    for k in range(len(path) - 1):  # go on from the first edge that is full
                        if joined[path[k]][path[k + 1]] == 0:
                            del path[k + 1 :]
                            break
                    continue
                while at[i] < len(near[i]) and not (joined[i][near[i][at[i]]] > 0 and level.get(near[i][at[i]]) == level[i] + 1):
                    at[i] += 1
                if at[i] < len(near[i]):
                    path.append(near[i][at[i]])
                elif len(path) > 1:
                    path.pop()
                    at[path[-1]] += 1
                else:
                    break


def smoothness(blocks: list[Block]) -> list[tuple[int, int, int]]:
    """Edges (a, b, capacity): blocks in sequence, most where one element holds both and least where marks or articles begin or end, and siblings that others stand between."""
    edges = []
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            a = blocks[i - 1]
            alike = a.marked == b.marked and a.inside == b.inside
            together = a.parent == b.parent or a.own in (b.own, b.parent) or b.own == a.parent
            edges.append((i - 1, i, 9 if together and alike else 3 if alike or together else 1))
        if last.get(b.parent, i) < i - 1:
            edges.append((last[b.parent], i, 3))
        last[b.parent] = i
    return edges


def extract(page: str | None, weights: tuple[float, ...] = WEIGHTS, cut: bool = True) -> str:
    """The content blocks of a page, one a line; empty if there are none. Without `cut`, each block is labelled by its own costs alone."""
    if not page:
        return ""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    has_body = any(b.inside for b in blocks)
    content = min_cut([costs(b, has_body, weights) for b in blocks], smoothness(blocks) if cut else [])
    return "\n".join(b.text for b, keep in zip(blocks, content, strict=True) if keep)


def fit(pages: DataFrame, html_col: str = "html", most_pages: int = 600, seed: int = 5, ridge: float = 1.0) -> tuple[float, ...]:
    """Weights of FEATURES from about `most_pages` pages that have an article or main element, taken by a hash of their text.

    A block's own label is whether it is in that element without being marked as boilerplate there. Each page is read
    three times: as it is, as if no element said what the article is, and as if nothing was marked either. The driver
    gets the sample's distinct feature rows. `ridge` draws the weights to WEIGHTS, so that what the sample says nothing
    about stays as it was set; without such pages they are WEIGHTS.
    """
    import numpy as np
    from pyspark.sql import functions as F

    ship(pages.sparkSession)
    said = pages.where(F.col(html_col).rlike("(?i)<(article|main)[\\s>]"))
    n = said.count()
    if not n:
        return WEIGHTS
    share = min(1.0, most_pages / n)
    sample = said.where(F.pmod(F.xxhash64(F.lit(seed), html_col), F.lit(1_000_000)) < int(share * 1_000_000) + (share == 1.0)).select(html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows, content = [], []
            for page in batch.column(0).to_pylist():
                blocks = blocks_of(page)
                if not any(b.inside for b in blocks):
                    continue
                for signs, marks in ((True, True), (False, True), (False, False)):
                    rows += [[round(x, 2) for x in features(b, True, signs, marks)] for b in blocks]
                    content += [b.inside and not b.marked for b in blocks]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), pa.array(content, pa.bool_())], ["x", "y"])

    found = sample.mapInArrow(run, "x array<double>, y boolean").groupBy("x", "y").count().collect()  # of a bounded sample
    if len({r["y"] for r in found}) < 2:
        return WEIGHTS
    x, y, k = np.array([r["x"] for r in found]), np.array([float(r["y"]) for r in found]), np.array([float(r["count"]) for r in found])
    prior = np.array(WEIGHTS)
    w = prior.copy()
    for _ in range(100):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (k * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (k * (p - y)) + ridge * (w - prior))
        w -= step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def extract_main_text(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html", weights: tuple[float, ...] | None = None) -> DataFrame:
    """The columns `keep`, text string and n_chars long (code points) for each row of `pages`.

    `weights` are the classifier's, fitted to the pages themselves if none are given (`fit`). Null and empty pages and
    pages without content give an empty text. Repeated rows are read each; other columns are not read. Pages are
    independent: no shuffle; the graph of a page has a node for each of its blocks.
    """
    ship(pages.sparkSession)
    names = [*keep, "text", "n_chars"]
    known = weights if weights is not None else fit(pages, html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = [extract(p, known) for p in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names)

    rows = pages.select(*keep, html_col)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema] + ["text string", "n_chars long"])
    return rows.mapInArrow(run, schema)
