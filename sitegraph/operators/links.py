"""X5 extract_links, F4 skip hrefs, F5 same-domain filter.

A page is tokenised by one pass over its characters (what a tag, a value or
raw text is cannot be told by regular expressions alone), and its links are
resolved, filtered and de-duplicated inside its row, in Arrow batches. So the
operator is a narrow transformation: no shuffle, and a hot host only costs the
rows it has.
"""

from __future__ import annotations

import re
from html import unescape
from html.entities import html5
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Href prefixes that are skipped (case-sensitive).
SKIP_PREFIXES = ("#", "javascript:", "mailto:", "tel:")
# Elements whose content holds no tags.
RAW_TEXT = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")

_SPACE = "\t\n\f\r "
_TAG_NAME = re.compile(r"[A-Za-z][^\t\n\f\r />]*")
_ATTRIBUTE = re.compile(r"[\t\n\f\r /]*+(?:(?P<end>>)|(?P<name>[^\t\n\f\r />][^\t\n\f\r />=]*+)(?:[\t\n\f\r ]*+=[\t\n\f\r ]*+(?:\"(?P<double>[^\"]*+)(?P<closed>\"?)|'(?P<single>[^']*+)(?P<closing>'?)|(?P<bare>[^\t\n\f\r >]*+)))?)")
_RAW_END = {name: re.compile(f"(?i)</{name}(?=[\t\n\f\r />])") for name in RAW_TEXT}
_SCRIPT = re.compile(r"<!--|-->|(?i:<(?P<end>/?)script(?=[\t\n\f\r />]))")
_COMMENT_END = re.compile(r"--!?>")
_REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9A-Fa-f]+;?|(?P<name>[A-Za-z][A-Za-z0-9]*;?)(?P<sign>=?))")


def _script_end(html: str, at: int) -> int:
    """Where a script's end tag begins (or the end): a script inside a
    comment inside the script hides its own end tag."""
    comment = inner = False
    for m in _SCRIPT.finditer(html, at):
        if m[0] == "<!--":
            comment = True
        elif m[0] == "-->":
            comment = inner = False
        elif not m["end"]:
            inner = inner or comment
        elif inner:
            inner = False
        else:
            return m.start()
    return len(html)


def attribute_text(value: str) -> str:
    """The value of an attribute with its character references decoded: a
    name without its semicolon stands for itself before ``=``, a letter or a
    digit."""
    def decoded(m: re.Match) -> str:
        if m["name"] is None:
            return unescape(m[0])
        if m["name"] in html5 and (m["name"].endswith(";") or not m["sign"]):
            return html5[m["name"]] + m["sign"]
        return m[0]

    return _REFERENCE.sub(decoded, value) if "&" in value else value


def anchor_hrefs(html: str) -> list[str]:
    """The ``href`` values of the ``<a>`` tags of a page, in order. Comments,
    declarations and raw text hold no tags; of repeated attributes the first
    counts; a tag that the page ends in does not."""
    out: list[str] = []
    at, n = html.find("<"), len(html)
    while 0 <= at < n - 1:
        c = html[at + 1]
        if c in "!?" or (c == "/" and not html[at + 2:at + 3].isalpha()):
            if html.startswith("<!--", at):
                end = at + 4 if html.startswith((">", "->"), at + 4) else None
                m = None if end else _COMMENT_END.search(html, at + 4)
                at = html.find(">", end) + 1 if end else m.end() if m else n
            else:
                end = html.find(">", at)
                at = end + 1 if end >= 0 else n
        elif (tag := _TAG_NAME.match(html, at + 1 + (c == "/"))) and tag[0][0].isascii():
            href, at, whole = None, tag.end(), False
            while m := _ATTRIBUTE.match(html, at):
                at = m.end()
                if m["end"]:
                    whole = True
                    break
                value = m["double"] if m["double"] is not None else m["single"] if m["single"] is not None else m["bare"]
                if m["closed"] == "" or m["closing"] == "":
                    at = n
                    break
                if href is None and m["name"].lower() == "href":
                    href = value or ""
            else:
                at = n
            name = tag[0].lower()
            if whole and c != "/":
                if name == "a" and href is not None:
                    out.append(attribute_text(href))
                elif name == "plaintext":
                    at = n
                elif name == "script":
                    at = _script_end(html, at)
                elif name in _RAW_END:
                    at = m.start() if (m := _RAW_END[name].search(html, at)) else n
        else:
            at += 1
        at = html.find("<", at)
    return out


def page_links(html: str | None, base: str | None, netloc: str | None) -> list[str]:
    """X5 of one page: the links that are not skipped (F4), resolved against
    ``base`` and of the same ``netloc`` (F5), first-seen unique. A link that
    cannot be resolved is dropped."""
    out: dict[str, None] = {}
    for href in anchor_hrefs(html) if html and base is not None else ():
        if href and not href.startswith(SKIP_PREFIXES):
            try:
                url = urljoin(base, href)
                if urlsplit(url).netloc == netloc:
                    out[url] = None
            except ValueError:  # brackets that hold no address
                continue
    return list(out)


@F.pandas_udf(ArrayType(StringType()))
def _page_links(html: pd.Series, base: pd.Series, netloc: pd.Series) -> pd.Series:
    return pd.Series([page_links(*row) for row in zip(html, base, netloc)], dtype=object)


def link_array(html: Column, base: Column, netloc: Column, cap: int | None = None) -> Column:
    """X5 in-row: ``page_links`` (the first ``cap`` if given)."""
    links = _page_links(html, base, netloc)
    return F.slice(links, 1, cap) if cap else links


def extract_links(pages: DataFrame, html: str, base: str, netloc: str, keys: list[str],
                  cap: int | None = None) -> DataFrame:
    """Long form ``keys..., pos (1-based), url`` of the links of each page."""
    arr = link_array(F.col(html), F.col(base), F.col(netloc), cap)
    return pages.select(*keys, F.posexplode(arr).alias("pos", "url")).withColumn("pos", F.col("pos") + 1)
