"""Operator 7: main text of web pages by minimum-cut labelling.

A page becomes a row of text blocks. A logistic classifier over each block's place in the document tree, class names, link
share, length and punctuation gives the log-odds of content; these are the capacities to the two terminals. Blocks that
follow each other, and blocks of one parent, are joined by edges whose capacities are log-odds too: how often blocks at
that distance in the tree have one label. The minimum cut is the likeliest labelling. Weights and capacities are fitted on
a bounded sample of labelled pages (``page_sample``). Scanning and cutting take time linear in the page.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contextmill.llm.page_sample import labelled_pages

_NAME_OF = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
_PUNCTUATION = re.compile(r"[.!?,;:]")
#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template textarea title svg iframe object canvas audio video annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements of formulas; their text belongs to the block around them.
MATH = frozenset("math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()) | MATH
#: Elements that hold a block, by what they tell of it.
HOLDERS = {"nav": "menu", "menu": "menu", "footer": "footer", "aside": "aside", "form": "form", "dialog": "form", "button": "form", "select": "form", "fieldset": "form", "head": "hidden", "header": "header", "article": "main", "main": "main"}
#: The block's own element.
OWN = {"p": "paragraph", "h1": "title", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "blockquote": "quote", "pre": "quote", "figcaption": "quote", "li": "item", "td": "item", "dd": "item", "dt": "item"}
#: Words of class names, ids and roles that mark boilerplate or content.
AGAINST = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar side aside rail widget menu nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer "
    "foot copyright comment comments commentlist respond reply replies disqus discussion cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login "
    "form search share sharing social related recommended recommendations recirc trending popular pagination pager toolbar skip tags disclaimer contentinfo complementary".split()
)
FOR = frozenset("article content main body post entry story text".split())
#: Elements that hold whole pages; their class names tell of the layout, such as one with a sidebar.
FRAMES = frozenset("html body main article".split())
#: Elements whose names are anchors for links to what they head, and tell nothing.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What the elements around a block can tell, as bits.
MARKS = {name: 1 << k for k, name in enumerate(("menu", "footer", "aside", "form", "header", "inner", "main", "against", "boxed", "either", "named", "hidden"))}
FEATURES = [*MARKS, "paragraph", "title", "heading", "quote", "item", "long", "only", "punctuation", "sentence", "links", "all links", "bias"]
#: Distances in the document tree that have a capacity each, farther blocks the last one; once for blocks with the same
#: marks and once for others.
DISTANCES = 8


@dataclass
class Block:
    text: list[str] = field(default_factory=list)
    links: int = 0
    marks: int = 0
    own: str = ""
    parent: int = -1  # number of the element above the block's own
    steps: int = 0  # steps in the tree from the block before


def _against(value: str) -> str:
    """Whether one of the names is made of words that mark boilerplate only ("all"), some has such a word ("part"), or none ("")."""
    found = ""
    for name in value.split():
        words = {w.lower() for w in _NAME.findall(name)}
        if words and words <= AGAINST:
            return "all"
        if words & AGAINST:
            found = "part"
    return found


def _marks(tag: str, attributes: str, above: int) -> int:
    """The marks of an element: those of all above and its own.

    Inside an article a name tells less: one that is a boilerplate word as a whole makes a box, which the text and the
    neighbours can overrule; one that has such a word (related-work, overlay-network) is weaker still, and an id of that
    kind tells nothing. Names of headings tell nothing anywhere.
    """
    inside = above & (MARKS["main"] | MARKS["named"])
    holder = HOLDERS.get(tag)
    out = above
    if holder:
        out |= MARKS["inner" if holder == "header" and inside else holder]
    for name, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
        value = next(filter(None, values), "")
        name = name.lower()
        if name in ("class", "id", "role"):
            if tag in HEADINGS:
                continue
            told = _against(value) if tag not in FRAMES else ""
            if told and not inside:
                out |= MARKS["against"]
            elif told == "all":
                out |= MARKS["boxed"]
            elif told:
                out |= MARKS["either"] if name != "id" else 0
            elif {w.lower() for w in _NAME.findall(value)} & FOR:
                out |= MARKS["named"]
        elif name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                out |= MARKS["hidden"]
        elif name == "hidden" or value.lower() == "true":
            out |= MARKS["hidden"]
    return out


def tags_of(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of every tag, with name "" for comments and declarations; each is read once.

    A quoted value may hold ">". If a quote or tag is never closed, quotes mean nothing from there on; what is left after
    the last ">" is text.
    """
    at, last, quotes = 0, page.rfind(">"), True
    while True:
        start = page.find("<", at)
        if start < 0:
            return
        after = page[start + 1 : start + 2]
        if after in ("!", "?"):
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                end = len(page) if end < 0 else end + 3
            elif page.startswith("<![CDATA[", start):
                end = page.find("]]>", start)
                end = len(page) if end < 0 else end + 3
            else:
                end = page.find(">", start)
                end = len(page) if end < 0 else end + 1
            at = yield start, end, "", False, ""
            at = at or end
            continue
        closing = after == "/"
        name = _NAME_OF.match(page, start + 1 + closing) if start < last else None
        if not name:
            at = start + 1
            continue
        end = first = page.find(">", name.end())
        where = name.end()
        while quotes and end >= 0:
            marks = [q for q in (page.find('"', where, end), page.find("'", where, end)) if q >= 0]
            if not marks:
                break
            opened = min(marks)
            closed = page.find(page[opened], opened + 1)
            where = closed + 1
            end = page.find(">", where) if closed >= 0 else -1
        if end < 0:
            if first < 0:
                return
            end, quotes = first, False
        at = yield start, end + 1, name[0].lower(), closing, page[name.end() : end]
        at = at or end + 1


def blocks_of(page: str) -> list[Block]:
    """Blocks with text, in page order. Unclosed and misplaced tags are taken as they come; text is not decoded yet."""
    out: list[Block] = []
    stack: list[tuple[str, int, int]] = []  # tag, node number, marks
    opened: Counter = Counter()
    block, at, node, link, low, deep = None, 0, 0, 0, 0, 0

    def add(piece: str) -> Block:
        nonlocal block, low, deep
        if block is None:
            depth = len(stack)
            low = min(low, depth)
            block = Block(marks=stack[-1][2] if stack else 0, own=stack[-1][0] if stack else "", parent=stack[-2][1] if depth > 1 else -1, steps=deep + depth - 2 * low)
            low = deep = depth
            out.append(block)
        block.text.append(piece)
        return block

    def close() -> str:
        nonlocal low
        name = stack.pop()[0]
        opened[name] -= 1
        low = min(low, len(stack))
        return name

    tags = tags_of(page)
    found = next(tags, None)
    while found:
        start, end, tag, closing, attributes = found
        if start > at:
            piece = page[at:start]
            if block is not None or not piece.isspace():
                add(piece)
                if link:
                    block.links += len(piece)
        at, go_on = end, None
        if not tag:
            pass
        elif tag in RAW:
            if not closing and not attributes.endswith("/"):
                over = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = go_on = over.end() if over else len(page)
        elif tag in INLINE:
            if tag == "a":
                link = 0 if closing else 1
            elif tag == "br" and block is not None:
                block.text.append(" ")
        else:
            block = None
            if tag not in VOID:
                link = 0
                if closing:
                    if opened[tag]:
                        while close() != tag:
                            pass
                else:
                    if stack and ((tag, stack[-1][0]) in _CLOSES or stack[-1][0] == "p"):
                        close()
                    node += 1
                    stack.append((tag, node, _marks(tag, attributes, stack[-1][2] if stack else 0)))
                    opened[tag] += 1
        try:
            found = tags.send(go_on)
        except StopIteration:
            found = None
    if at < len(page) and not page[at:].isspace():
        add(page[at:])
    return out


#: A start tag that ends an open element of the second name.
_CLOSES = frozenset({("li", "li"), ("dt", "dd"), ("dd", "dt"), ("dt", "dt"), ("dd", "dd"), ("tr", "tr"), ("tr", "td"), ("td", "td"), ("td", "th"), ("th", "th"), ("th", "td"), ("option", "option")})


def features(block: Block, text: str, whole: int) -> list[float]:
    """The numbers that FEATURES names, for a page with so many characters of text."""
    own = OWN.get(block.own)
    share = min(1.0, block.links / max(1, sum(map(len, block.text))))
    return [
        *(float(block.marks & bit > 0) for bit in MARKS.values()), *(float(own == name) for name in ("paragraph", "title", "heading", "quote", "item")),
        min(1.0, len(text) / 200), float(whole == len(text)), min(3, len(_PUNCTUATION.findall(text))) / 3, float(text[-1] in ".!?:;\u2026"), share, float(share > 0.8), 1.0,
    ]


def rows_of(found: list[tuple[Block, str]]) -> np.ndarray:
    whole = sum(len(t) for _, t in found)
    return np.array([features(b, t, whole) for b, t in found])


@dataclass
class Labeller:
    """Weights of FEATURES, and the capacity of an edge by the kind that ``neighbours`` gives; both are log-odds."""

    weights: np.ndarray
    capacities: np.ndarray

    def costs(self, found: list[tuple[Block, str]]) -> list[float]:
        return (rows_of(found) @ self.weights).tolist()

    def labels(self, found: list[tuple[Block, str]]) -> list[bool]:
        """Whether each block is content: the minimum cut."""
        edges = [(i, j, float(self.capacities[kind])) for i, j, kind in neighbours(found)]
        return minimum_cut(self.costs(found), edges) if found else []


def decoded(page: str) -> list[tuple[Block, str]]:
    """Blocks with their text: references decoded, white space runs one blank each, trimmed; empty ones are left out."""
    out, steps = [], 0
    for b in blocks_of(page):
        text = " ".join(html.unescape("".join(b.text)).split())
        steps = max(steps, b.steps)
        if text:
            b.steps, steps = steps, 0
            out.append((b, text))
    return out


def neighbours(found: list[tuple[Block, str]]) -> Iterator[tuple[int, int, int]]:
    """(i, j, kind): blocks that follow each other, and those of one parent with others between; the kind is by their
    distance in the tree and whether the same can be told of both."""
    last: dict[int, int] = {}
    kind = lambda i, j, steps: min(steps, DISTANCES - 1) + DISTANCES * (found[i][0].marks != found[j][0].marks)
    for i, (b, _) in enumerate(found):
        if i:
            yield i - 1, i, kind(i - 1, i, b.steps)
        if last.get(b.parent, i) < i - 1:
            yield last[b.parent], i, kind(last[b.parent], i, 2)
        last[b.parent] = i


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights of a logistic regression, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
    return w


@cache
def fitted() -> Labeller:
    """The labeller of the sample: weights from one half of its pages, the scale of the capacities from the other."""
    pages = [([*decoded(page)], content) for page, content in labelled_pages()]
    half = len(pages) // 2
    truth = [[t in content for _, t in found] for found, content in pages]
    x = np.concatenate([rows_of(found) for found, _ in pages[:half]])
    weights = logistic(x, np.array([k for own in truth[:half] for k in own], float))
    same, met = np.ones(2 * DISTANCES), np.full(2 * DISTANCES, 2.0)
    for (found, _), own in zip(pages[:half], truth, strict=False):
        for i, j, kind in neighbours(found):
            met[kind] += 1
            same[kind] += own[i] == own[j]
    odds = np.maximum(0, np.log(same / (met - same)))
    wrong = lambda own: sum(a != b for (found, _), real in zip(pages[half:], truth[half:], strict=True) for a, b in zip(own.labels(found), real, strict=True))
    tried = [(wrong(Labeller(weights, odds * scale)), scale) for scale in (1.0, 0.7, 0.5, 0.35, 0.25)]
    # edges no stronger than they need be: the weakest that have at most a fifth more wrong than the best
    return Labeller(weights, odds * min(scale for n, scale in tried if n <= 1.2 * min(tried)[0]))


def minimum_cut(terminal: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The source side of a minimum cut: node i is tied to the source by terminal[i] if positive, else to the sink by
    -terminal[i]; edges have their capacity both ways.

    Nodes with one or two neighbours are taken out first, each replaced by the terminals and the edge that cost the same
    (series and parallel reductions); that leaves nothing of a graph like a page's, in time linear in its edges. The rest
    is cut by maximum flow.
    """
    own, near = list(terminal), [{} for _ in terminal]
    for i, j, c in edges:
        near[i][j] = near[i].get(j, 0.0) + c
        near[j][i] = near[j].get(i, 0.0) + c
    taken: list[tuple[int, float, list[tuple[int, float]]]] = []
    gone = [False] * len(own)
    todo = deque(i for i in range(len(own)) if len(near[i]) <= 2)
    while todo:
        i = todo.popleft()
        if gone[i] or len(near[i]) > 2:
            continue
        gone[i] = True
        ends, value = list(near[i].items()), own[i]
        taken.append((i, value, ends))
        for j, _ in ends:
            del near[j][i]
        if len(ends) == 1:
            j, c = ends[0]
            own[j] += min(0.0, c - value) - min(c, -value)
        elif ends:
            (j, a), (k, b) = ends
            none, both, right, left = min(0.0, a + b - value), min(a + b, -value), min(b, a - value), min(a, b - value)
            joint = (left + right - none - both) / 2
            own[j] -= left - none - joint
            own[k] -= right - none - joint
            if joint > 0:
                near[j][k] = near[k][j] = near[j].get(k, 0.0) + joint
        todo.extend(j for j, _ in ends if len(near[j]) <= 2)
    rest = [i for i in range(len(own)) if not gone[i]]
    place = {i: k for k, i in enumerate(rest)}
    side = dict(zip(rest, maximum_flow([own[i] for i in rest], [{place[j]: c for j, c in near[i].items()} for i in rest]), strict=True))
    for i, value, ends in reversed(taken):
        side[i] = value > sum(c if not side[j] else -c for j, c in ends)
    return [side[i] for i in range(len(own))]


def maximum_flow(rest: list[float], near: list[dict[int, float]]) -> list[bool]:
    """The source side after pushing flow along shortest augmenting paths until none is left."""
    while True:
        came = {i: -1 for i in range(len(rest)) if rest[i] > 1e-9}
        queue, end = deque(came), -1
        while queue and end < 0:
            i = queue.popleft()
            for j, c in near[i].items():
                if c > 1e-9 and j not in came:
                    came[j] = i
                    if rest[j] < -1e-9:
                        end = j
                        break
                    queue.append(j)
        if end < 0:
            return [i in came for i in range(len(rest))]
        path = [end]
        while came[path[-1]] >= 0:
            path.append(came[path[-1]])
        push = min([rest[path[-1]], -rest[end], *(near[b][a] for a, b in zip(path, path[1:], strict=False))])
        rest[path[-1]] -= push
        rest[end] += push
        for a, b in zip(path, path[1:], strict=False):
            near[b][a] -= push
            near[a][b] += push


def main_text(page: str | None, labeller: Labeller | None = None) -> str:
    """The content blocks joined by newlines."""
    found = decoded(page) if page else []
    return "\n".join(t for (_, t), keep in zip(found, (labeller or fitted()).labels(found), strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages.

    Null and empty html, and pages without content, give an empty text. Each page is one row of one task, whatever its
    size. Repeated rows and null ids are rows like others; other columns are ignored. Empty input: no rows.
    """
    shared = pages.sparkSession.sparkContext.broadcast(fitted())  # 30 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), shared.value) for x in batch.column("html")]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return chosen.mapInArrow(run, "page_id long, url string, text string, n_chars long")
