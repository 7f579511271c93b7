"""Main text of web pages by minimum-cut labelling.

A page becomes a sequence of text blocks with their place in the element tree. A logistic classifier gives each block
log odds of being content, which become its capacity to the source or the sink; neighbouring blocks, and blocks with one
parent, are tied by edges whose capacity falls with their distance in the tree. The minimum cut, found by maximum flow,
separates content from boilerplate. Blocks that lean more strongly than all their edges together are settled first,
which is exact and leaves little for the flow.

The classifier is fitted on a bounded sample of the pages themselves: at most ``max_pages`` of them by a hash of page_id
and url, whole, of at most ``max_blocks`` blocks together; a page of over a tenth of them is left out of the fit. Blocks that elements or names mark clearly
are its labelled rows. Each is used twice, with and without these marks, so that length, links, punctuation and kind of
element carry weight where a page names nothing. The fit is drawn towards fixed weights, which hold alone where there are no
labelled rows of both kinds: a sample whose pages are all of one make says little of others.

Marks are evidence and no veto. They pass to what is inside; a mark of boilerplate weakens one of content around or
inside it. No mark has an element that holds all articles of its page, a form with most of its text, or a name such as
has-sidebar. A name counts in full by its last word and half by another.

Defined results: null and empty pages have the empty text; broken markup is read as far as it goes; a page is one row
of work, linear in its length and depth, so repeated rows and null ids or urls each give their row.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintage_jobs.llm.common import row_mapper, stored, within_bound
from vintage_jobs.llm.quality import logistic

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:\"[^\"<]*\"|'[^'<]*'|[^'\"<>])*+|[^<>]*)(?:>|(?=<)|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
NAMES = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORDS = re.compile(r"[a-z]+")
#: Elements whose content is no markup; without an end they last to the end of the page, as browsers have it.
RAW = frozenset("script style textarea title xmp iframe".split())
#: Elements whose content is no text of the page; without an end they hold nothing.
UNREAD = frozenset("svg select".split())
ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW | UNREAD}
BLOCKS = frozenset("html body head article main section nav header footer aside form div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary fieldset hr center menu dialog button noscript template object".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
#: Elements that end an open list item, term or cell when they begin, and the elements they stay within.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}
WITHIN = ("ul", "ol", "dl", "table")
AWAY_TAGS = frozenset("nav footer aside form menu dialog button noscript template".split())
HOME_TAGS = frozenset(("article", "main"))
COMMENTS = frozenset("comment comments disqus reply replies respond".split())
AWAY = COMMENTS | frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar footer masthead"
    " cookie cookies consent gdpr notice notices alert popup modal overlay share sharing social related recommended newsletter subscribe"
    " subscription signup login search pagination pager widget toolbar copyright skip tags".split()
)
HOME = frozenset("article content post entry story main text".split())
#: First words of names that tell what a page has, not what an element is.
ABOUT = frozenset("has have with without no is not".split())
#: Elements that never hold the article, even where all articles of a page lie in them.
ASIDE = frozenset("nav footer aside menu".split())


class Element:
    """A block element: where it is, what marks it, and what its subtree holds."""

    __slots__ = ("parent", "depth", "tag", "home", "away", "firm", "homes", "chars")

    def __init__(self, parent: int, depth: int, tag: str, home: float, away: float, firm: bool):
        self.parent, self.depth, self.tag, self.home, self.away, self.firm = parent, depth, tag, home, away, firm
        self.homes, self.chars = int(home == 1 and away < 1), 0


class Block:
    __slots__ = ("text", "linked", "at")

    def __init__(self, text: str, linked: int, at: int):
        self.text, self.linked, self.at = text, linked, at


def marks(tag: str, attrs: str) -> tuple[float, float, bool]:
    """How far an element's own tag and names mark it as content and as boilerplate; whether nothing it holds changes that."""
    home, away, firm = float(tag in HOME_TAGS), float(tag in AWAY_TAGS), tag in ASIDE
    if tag in ("html", "body"):
        return 0.0, 0.0, False
    header = tag == "header"
    for m in NAMES.finditer(attrs) if attrs else ():
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            words = WORDS.findall(name)
            if not words or words[0] in ABOUT and len(words) > 1:
                continue
            home = max(home, 1.0 if words[-1] in HOME else 0.5 if not HOME.isdisjoint(words) else 0.0)
            away = max(away, 1.0 if words[-1] in AWAY else 0.5 if not AWAY.isdisjoint(words) else 0.0)
            firm = firm or not COMMENTS.isdisjoint(words)
            header = header or "header" in words
    if header and not home:
        away = max(away, 0.75)
    return home * (1 - away) if away == 1 else home, away, firm


def blocks_of(page: str) -> tuple[list[Block], list[Element]]:
    """The text blocks of a page in order, and its block elements; the first stands for the page."""
    out: list[Block] = []
    elements = [Element(-1, 0, "", 0.0, 0.0, False)]
    stack, special, is_open = [0], [], Counter()
    parts: list[str] = []
    linked = links = at = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, linked, stack[-1]))
            elements[stack[-1]].chars += max(0, len(text) - linked)
        parts.clear()
        linked = 0

    def take(piece: str) -> None:
        nonlocal linked
        if piece:
            parts.append(html.unescape(piece) if "&" in piece else piece)
            if links:
                linked += len(parts[-1].strip())

    def close(last: int) -> None:
        """Closes elements up to and with the element ``last``."""
        while True:
            e = stack.pop()
            is_open[elements[e].tag] -= 1
            if special and special[-1] == e:
                special.pop()
            if e == last:
                return

    endless = set()  # elements that no later end tag closes
    while token := TOKEN.search(page, at):
        take(page[at : token.start()])
        at = token.end()
        tag = token["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if tag in ENDS:
            parts.append(" ")
            if token["end"] or (tag == "svg" and token["attrs"].endswith("/")) or tag in endless:
                continue
            if found := ENDS[tag].search(page, at):
                at = found.end()
            elif tag in RAW:
                at = len(page)
            else:
                endless.add(tag)
        elif tag == "a":
            links = 0 if token["end"] else 1
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCKS:
            flush()
            links = 0
            if token["end"]:
                if is_open[tag]:
                    close(next(e for e in reversed(stack) if elements[e].tag == tag))
                continue
            if elements[stack[-1]].tag == "p":
                close(stack[-1])
            if tag in CLOSES:
                for e in reversed(special):
                    if elements[e].tag in CLOSES[tag]:
                        close(e)
                        break
                    if elements[e].tag in WITHIN:
                        break
            if tag in VOID:
                continue
            elements.append(Element(stack[-1], elements[stack[-1]].depth + 1, tag, *marks(tag, token["attrs"])))
            stack.append(len(elements) - 1)
            is_open[tag] += 1
            if tag in CLOSES or tag in WITHIN:
                special.append(stack[-1])
    take(page[at:])
    flush()
    spread(elements)
    return out, elements


def spread(elements: list[Element]) -> None:
    """Lets marks pass to what is inside; elements that hold all articles, and forms with most text, have none of boilerplate."""
    for e in reversed(elements[1:]):
        elements[e.parent].homes += e.homes
        elements[e.parent].chars += e.chars
    page = elements[0]
    for e in elements[1:]:
        holds_all = e.homes == page.homes > 0 and not e.firm and not (e.home and e.homes == 1)
        own = 0.0 if holds_all or (e.tag == "form" and 2 * e.chars > page.chars > 0) else e.away
        above = elements[e.parent]
        if e.tag == "header" and above.home == 1:
            own = 0.0
        e.away = max(above.away, own)
        e.home = max(above.home, e.home) * (1 - e.away)


SENTENCE_ENDS = ".!?…:\"”»"
N_FEATURES = 8
#: Weights of ``features`` and the intercept where there is nothing to fit on; a fit is drawn towards them, by ``RIDGE`` a row.
FIXED = np.array([1.0, -3.0, 0.5, 0.6, 0.8, 0.0, 3.5, -7.0, -1.5])
RIDGE = 0.02


def features(block: Block, element: Element) -> list[float]:
    n, tag = len(block.text), element.tag
    return [
        min(3.0, math.log1p(n / 40)),
        min(1.0, block.linked / n),
        float(block.text[-1] in SENTENCE_ENDS),
        float(tag in ("p", "blockquote", "pre")),
        float(tag[:1] == "h" and tag[1:].isdigit()),
        float(tag in CLOSES),
        element.home,
        element.away,
    ]


def leanings(blocks: list[Block], elements: list[Element], weights: np.ndarray = FIXED, most: float = 8.0) -> list[float]:
    """The log odds of each block: content (positive) or boilerplate (negative)."""
    x = np.array([features(b, elements[b.at]) for b in blocks], np.float64).reshape(-1, N_FEATURES)
    return np.clip(x @ weights[:-1] + weights[-1], -most, most).tolist()


def ties(blocks: list[Block], elements: list[Element], near: float = 1.2, kin: float = 1.0) -> list[tuple[int, int, float]]:
    """Edges between neighbours, weaker by the square of their distance in the tree, and between blocks with
    one parent, weaker by the blocks between them."""
    out, last = [], {}
    for i, b in enumerate(blocks):
        parent = elements[b.at].parent
        if i:
            x, y, distance = blocks[i - 1].at, b.at, 0
            while x != y:
                if elements[x].depth < elements[y].depth:
                    x, y = y, x
                x, distance = elements[x].parent, distance + 1
            out.append((i - 1, i, near / max(1, distance - 1) ** 2))
        if (j := last.get(parent)) is not None and j < i - 1:
            out.append((j, i, kin / (i - j)))
        last[parent] = i
    return out


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes lie on the source side of a minimum cut; scores are terminal capacities by sign."""
    scores = list(scores)
    near: list[dict[int, float]] = [{} for _ in scores]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    side: list[bool | None] = [None] * len(scores)
    todo = deque(range(len(scores)))
    while todo:
        i = todo.popleft()
        if side[i] is None and abs(scores[i]) > sum(near[i].values()):
            side[i] = scores[i] > 0
            for j, w in near[i].items():
                del near[j][i]
                scores[j] += w if side[i] else -w
                todo.append(j)
            near[i] = {}
    rest = [i for i, s in enumerate(side) if s is None]
    if rest:
        reached = _source_side(rest, scores, near)
        for i in rest:
            side[i] = i in reached
    return [bool(s) for s in side]


def _source_side(nodes: list[int], scores: list[float], near: list[dict[int, float]]) -> set[int]:
    """Nodes that the source still reaches when a maximum flow has filled the graph (by level graphs)."""
    source, sink = -1, -2
    room: dict[int, dict[int, float]] = {i: dict(near[i]) for i in nodes}
    room[source], room[sink] = {}, {}
    for i in nodes:
        if scores[i] > 0:
            room[source][i], room[i][source] = scores[i], 0.0
        elif scores[i] < 0:
            room[i][sink], room[sink][i] = -scores[i], 0.0
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            x = queue.popleft()
            for y, r in room[x].items():
                if r > 1e-9 and y not in level:
                    level[y] = level[x] + 1
                    queue.append(y)
        if sink not in level:
            return set(level)
        left = {x: list(ys) for x, ys in room.items()}
        path = [source]
        while path:
            x = path[-1]
            if x == sink:
                pushed = min(room[a][b] for a, b in zip(path, path[1:], strict=False))
                for a, b in zip(path, path[1:], strict=False):
                    room[a][b] -= pushed
                    room[b][a] += pushed
                cut = next(k for k, (a, b) in enumerate(zip(path, path[1:], strict=False)) if room[a][b] <= 1e-9)
                del path[cut + 1 :]
                continue
            while left[x]:
                y = left[x][-1]
                if room[x][y] > 1e-9 and level.get(y) == level[x] + 1:
                    path.append(y)
                    break
                left[x].pop()
            else:
                path.pop()
                if path:
                    left[path[-1]].pop()


def main_text(page: str | None, weights: np.ndarray = FIXED) -> str:
    blocks, elements = blocks_of(page or "")
    chosen = minimum_cut(leanings(blocks, elements, weights), ties(blocks, elements))
    return "\n".join(b.text for b, kept in zip(blocks, chosen, strict=True) if kept)


def fit(pages: DataFrame, max_pages: int = 400, max_blocks: int = 40_000) -> np.ndarray:
    """Weights of the classifier from the clearly marked blocks of a bounded sample of whole pages."""
    keyed = pages.select(F.xxhash64(F.col("page_id").cast("long"), F.col("url").cast("string")).alias("key"), F.col("html").cast("string").alias("html"))
    chosen = keyed.select("key").distinct().orderBy("key").limit(max_pages)
    # one page a key, whatever repeats it
    sample = stored(keyed.join(F.broadcast(chosen), "key").groupBy("key").agg(F.max("html").alias("html")), "sample-pages")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for page in batch.column("html"):
                blocks, elements = blocks_of(page.as_py() or "")
                found.append(np.array([features(b, elements[b.at]) for b in blocks], "<f4").reshape(-1, N_FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], names=["key", "blocks", "x"])

    made = stored(sample.mapInArrow(work, "key long, blocks long, x binary"), "sample-blocks")
    within = within_bound(sorted((r.key, r.blocks) for r in made.select("key", "blocks").collect()), max_blocks)  # at most max_pages rows
    rows = made.where(F.col("key").isin(within)).select("key", "x").collect()
    rows.sort(key=lambda r: r.key)
    return fitted(np.concatenate([np.frombuffer(bytes(r.x), "<f4") for r in rows] or [np.empty(0, "<f4")]).reshape(-1, N_FEATURES).astype(np.float64))


def fitted(x: np.ndarray) -> np.ndarray:
    """Weights from features of blocks; those with a clear mark are labelled by it, and both kinds weigh alike."""
    home, away = x[:, -2] == 1, x[:, -1] == 1
    if not home.any() or not away.any():
        return FIXED
    x, y = np.concatenate((x[home], x[away])), np.repeat([1.0, 0.0], [home.sum(), away.sum()])
    bare = x.copy()
    bare[:, -2:] = 0
    weight = np.where(y == 1, 0.5 / home.sum(), 0.5 / away.sum()) * len(y)
    return logistic(np.concatenate((x, bare)), np.tile(y, 2), np.tile(weight, 2), ridge=RIDGE * len(x), around=FIXED)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    weights = fit(pages)

    def each(page_id, url, page):
        text = main_text(page, weights)
        return page_id, url, text, len(text)

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(row_mapper(["page_id", "url", "html"], schema, each), "page_id long, url string, text string, n_chars long")
