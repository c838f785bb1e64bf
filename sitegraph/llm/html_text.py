"""Operator 5: main text of web pages by minimum-cut labelling.

A page is cut into text blocks. A linear classifier over the block's containers and text gives the cost of each
label; the costs are the capacities to the two terminals. Smoothness edges join neighbouring blocks and successive
blocks of one container, the stronger the nearer they are in the DOM. The minimum cut of that network (by augmenting
paths) is the labelling of least total cost; its source side is the content.

The graph is per page and as large as the page's blocks, so pages are independent: one narrow pass, no shuffle.

Defined results: null and empty pages give an empty text; unclosed tags, comments and quotes end with the page;
pages without blocks give an empty text; repeated rows give repeated results; only page_id, url and html are read.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sitegraph.llm.common import slices
from sitegraph.plans.tables import table

RAW = frozenset("script style noscript template title textarea select svg iframe button".split())
MARK = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*+))")
VALUE = re.compile(r"=\s*+([\"'])")
ATTRIBUTE = re.compile(r"\b(class|id|role|aria-label|hidden|itemprop)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
STYLE_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption label".split())
VOID = frozenset("hr".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
HOLDERS = frozenset("ul ol dl table tbody thead div section article main aside nav body".split())

#: The classifier's weights: containers by tag, containers by name (class, id, role), and the text.
TAGS = {"nav": -9.0, "aside": -8.0, "footer": -9.0, "form": -9.0, "menu": -8.0, "dialog": -8.0, "label": -3.0, "legend": -3.0, "head": -12.0, "article": 4.0, "main": 3.0, "fieldset": -4.0}
HEADER = -7.0
NEGATIVE = dict.fromkeys("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner".split(), -9.0) | dict.fromkeys(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead topbar toolbar pager pagination skip".split(), -9.0) | dict.fromkeys(
    "cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login signin paywall".split(), -8.0) | dict.fromkeys(
    "comment comments commentlist disqus reply replies respond discussion".split(), -9.0) | dict.fromkeys(
    "share sharing social related recommended recommendations widget copyright legal disclaimer search contentinfo complementary hidden".split(), -7.0) | {"header": -5.0, "tags": -4.0, "meta": -2.0, "side": -6.0, "rail": -6.0}
POSITIVE = dict.fromkeys("article content post entry story body text main articlebody".split(), 1.5)
INSIDE = 3.0  # what names inside an article say counts against this
CHAIN, SAME, FAR = 1.2, 0.6, 0.35


#: Names that tell of a state (``has-sidebar``, ``search-enabled``) say nothing about what a container holds.
STATE = re.compile(r"^(?:has|no|not|with|without)[-_]|[-_](?:enabled|disabled)$", re.I)


@dataclass
class Block:
    text: str
    score: float
    holder: int  # the container's number


@dataclass
class Container:
    tag: str
    number: int
    parent: int
    depth: int
    article: bool
    sure: float      # what its tag and kind names say
    doubtful: float  # what ``form`` and unkind names say: not believed of a container that holds the page's main part
    heading: bool    # whether a main part may begin here
    size: int = 0    # characters of text
    score: float = 0.0


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """``(start, end, name, closing, attributes)`` of every tag; the name is empty for comments, declarations and
    raw elements (with what they hold). Reads forward only, so its time is linear on broken markup too."""
    last = {q: page.rfind(q) for q in "\"'"}
    ends: dict[str, re.Pattern] = {}
    at = 0
    while m := MARK.search(page, at):
        start, name = m.start(), (m[4] or "").lower()
        if m[1]:
            end = page.find("-->", m.end())
            at = len(page) if end < 0 else end + 3
        else:
            i, end = m.end(), -1
            while (end := page.find(">", i)) >= 0 and not m[2]:
                quote = VALUE.search(page, i, end)
                while quote and (shut := page.find(quote[1], quote.end(), end)) >= 0:
                    quote = VALUE.search(page, shut + 1, end)
                if not quote or last[quote[1]] < end:
                    break
                i = page.find(quote[1], end) + 1
            at = len(page) if end < 0 else end + 1
            if name in RAW and not m[3] and end >= 0:
                shut = ends.setdefault(name, re.compile(f"</{name}(?=[\\s/>])", re.I)).search(page, at)
                shut = page.find(">", shut.end()) if shut else -1
                at = len(page) if shut < 0 else shut + 1
                name = ""
            elif name and end >= 0:
                yield start, at, name, bool(m[3]), page[m.end():end]
                continue
        yield start, at, "", False, ""


def opened(tag: str, attributes: str, parent: Container, number: int) -> Container:
    """A container with what its tag and names say about its content."""
    sure = HEADER if tag == "header" and not parent.article else TAGS.get(tag, 0.0) if not (tag == "article" and parent.article) else 0.0
    doubtful = 0.0
    if tag == "form":
        sure, doubtful = 0.0, sure
    if attributes:
        if STYLE_HIDDEN.search(attributes):
            sure -= 9.0
        names = set()
        for m in ATTRIBUTE.finditer(attributes):
            if m[1].lower() == "hidden":
                names.add("hidden")
            elif tag not in ("html", "body"):  # theirs are about the page
                for word in (m[2] or m[3] or m[4] or "").split():
                    if not STATE.search(word):
                        names.update(x.lower() for x in NAME.findall(word))
        worst = min((NEGATIVE[x] for x in names if x in NEGATIVE), default=0.0)
        doubtful += worst
        sure += 0.0 if worst else max((POSITIVE[x] for x in names if x in POSITIVE), default=0.0)
    heading = tag in ("h1", "main") or (tag == "article" and doubtful == 0)
    return Container(tag, number, parent.number, parent.depth + 1, parent.article or tag in ("article", "main"), sure, doubtful, heading)


def blocks_of(page: str) -> tuple[list[Block], list[Container]]:
    """The page's text blocks in order, and its containers by number. Time and memory are linear in the page, however
    deep it is nested."""
    out: list[Block] = []
    all_of = [Container("html", 0, 0, 0, False, 0.0, 0.0, False)]
    stack, open_tags = [all_of[0]], Counter()
    parts: list[str] = []
    linked = at = 0
    in_link = False

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(references.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, text_score(text, linked, stack[-1].tag), stack[-1].number))
                stack[-1].size += len(text)
            parts.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            parts.append(piece)
            if in_link:
                linked += len(piece)

    def close(i: int) -> None:
        for c in stack[i:]:
            open_tags[c.tag] -= 1
        del stack[i:]

    for start, end, tag, closing, attributes in tags(page):
        add(page[at:start])
        at = end
        if tag in BLOCKS:
            flush()
            if closing:
                if open_tags[tag]:
                    i = len(stack) - 1
                    while stack[i].tag != tag:
                        i -= 1
                    close(i)
            elif tag not in VOID:
                if stack[-1].tag == "p":
                    close(len(stack) - 1)
                if tag in ENDS and any(open_tags[x] for x in ENDS[tag]):
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i].tag in ENDS[tag]:
                            close(i)
                            break
                        if stack[i].tag in HOLDERS:
                            break
                if tag == "body":
                    close(1)
                all_of.append(opened(tag, attributes, stack[-1], len(all_of)))
                stack.append(all_of[-1])
                open_tags[tag] += 1
        elif tag == "a":
            in_link = not closing
        elif tag == "br":
            add(" ")
        elif tag == "img" or tag == "input":
            add(" ")
    add(page[at:])
    flush()
    for c in reversed(all_of[1:]):
        all_of[c.parent].size += c.size
        all_of[c.parent].heading |= c.heading
    for c in all_of[1:]:
        believed = 0.0 if c.heading and 2 * c.size > all_of[0].size else c.doubtful
        c.score = max(-14.0, min(8.0, all_of[c.parent].score + c.sure + believed))
    for b in out:
        b.score += all_of[b.holder].score
    return out, all_of


def text_score(text: str, linked: int, tag: str) -> float:
    """What the text itself says: long sentences are content, links and bare scraps are not."""
    n = len(text)
    score = min(2.0, n / 60) - 0.8
    score -= 3.0 * min(1.0, linked / n)
    if text[-1] in ".!?:;,":
        score += 0.4
    if tag in ("h1", "h2", "h3", "p", "blockquote", "pre"):
        score += 0.6
    if text[0] == "©" or "all rights reserved" in text.lower():
        score -= 1.5
    return score


def distance(a: Container, b: Container, all_of: list[Container]) -> int:
    """The steps between two containers, by way of their nearest common one."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = all_of[a.parent]
        else:
            b = all_of[b.parent]
        steps += 1
    return steps


def smoothness(blocks: list[Block], all_of: list[Container]) -> list[tuple[int, int, float]]:
    """Edges between neighbours, and between a container's successive own blocks."""
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            steps = distance(all_of[blocks[i - 1].holder], all_of[b.holder], all_of)
            edges.append((i - 1, i, max(FAR, CHAIN * math.exp(-0.35 * max(0, steps - 2)))))
        holder = all_of[b.holder].parent
        before = last.get(holder)
        if before is not None and before != i - 1:
            edges.append((before, i, SAME))
        last[holder] = i
    return edges


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source (content) side of the minimum cut.

    A node's two terminal capacities are ``log(1 + e^s)`` and ``log(1 + e^-s)``; the flow straight through a node
    is their minimum, so only their difference ``s`` is left: a supply if positive, else a demand. Flow goes from
    supplies to demands along shortest augmenting paths; supplies that no longer reach a demand are closed off.
    """
    n = len(scores)
    rest = list(scores)
    graph: list[list[int]] = [[] for _ in range(n)]
    to, capacity = [], []
    for a, b, c in edges:
        graph[a].append(len(to))
        to.append(b)
        capacity.append(c)
        graph[b].append(len(to))
        to.append(a)
        capacity.append(c)
    closed = [False] * n
    for source in range(n):
        while rest[source] > 1e-9 and not closed[source]:
            by, queue, end = {source: -1}, deque([source]), -1
            while queue and end < 0:
                u = queue.popleft()
                for e in graph[u]:
                    v = to[e]
                    if capacity[e] > 1e-9 and v not in by and not closed[v]:
                        by[v] = e
                        if rest[v] < -1e-9:
                            end = v
                            break
                        queue.append(v)
            if end < 0:
                for u in by:
                    closed[u] = True
                break
            flow, v = min(rest[source], -rest[end]), end
            while by[v] >= 0:
                flow = min(flow, capacity[by[v]])
                v = to[by[v] ^ 1]
            v = end
            while by[v] >= 0:
                capacity[by[v]] -= flow
                capacity[by[v] ^ 1] += flow
                v = to[by[v] ^ 1]
            rest[source] -= flow
            rest[end] += flow
    return closed


def main_text(page: str) -> str:
    blocks, all_of = blocks_of(page)
    if not blocks:
        return ""
    content = minimum_cut([b.score for b in blocks], smoothness(blocks, all_of))
    return "\n".join(b.text for b, keep in zip(blocks, content) if keep)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, pages in slices(batches, "html"):
        texts = [main_text(p.decode()) for p in pages]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                         names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    return pages.select("page_id", "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
