"""Operator 9: main text of a page by line-block distribution.

Markup is stripped: every block element begins a line, text of menus, headers,
footers, sidebars, notices, adverts, forms, scripts and comments is none, and so
is text of links that fill their line outside the article. The lengths of the
lines are summed over sliding windows of ``WINDOW`` lines. A window over the
surge bound begins a region, a window without text ends it; regions far below the
largest are left out, and all lines between the surge and the dive are kept,
short ones too. Where the page marks its article or main part, text outside it
counts as none, so surge and dive lie at its ends.

Null and empty pages give an empty text. A page cut off in a tag or a comment is
read up to there. Repeated rows give the same. Only ``page_id``, ``url`` and
``html`` are read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SURGE = 60
SHARE = 0.2

_RAW = "script|style|noscript|template|textarea|select|iframe|svg|object|canvas|math|title"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:/>|>(?:.*?</(?P=raw)\s*>|.*\Z)|\Z)"
    r"|<(?P<close>/)?(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|[^<]+|<", re.DOTALL | re.IGNORECASE)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))|\b(hidden)\b""")
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                    "head header hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SKIPPED = frozenset("head nav footer aside form menu button dialog label option search".split())
_CUES = frozenset("ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promoted promotion cookie cookies consent gdpr "
                  "notice notices notification alert popup modal overlay newsletter subscribe subscription paywall signup login sidebar aside nav navbar navigation "
                  "menu menus breadcrumb breadcrumbs pagination pager toc footer comment comments commentlist disqus reply replies respond discussion related "
                  "recommended recommendations share sharing social widget toolbar skip copyright disclaimer".split())
_OUTER_CUES = frozenset("header masthead topbar site-header".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_SPACE = re.compile(r"\s+")
# An end tag that is missing is implied where one of these begins.
_IMPLIED = {"p": _BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"])}


@dataclass
class _Open:
    tag: str
    skipped: bool
    main: bool


def _left_out(tag: str, attrs: str, inside: bool) -> bool:
    """Whether an element holds something other than the article; ``inside`` it a header is part of it."""
    if tag in _SKIPPED or tag == "header" and not inside:
        return True
    if "=" not in attrs and "hidden" not in attrs.lower():
        return False
    for name, *values, bare in _ATTRIBUTE.findall(attrs):
        value = next((v for v in values if v), "").lower()
        if bare or name.lower() == "hidden" or name.lower() == "aria-hidden" and value == "true":
            return True
        if name.lower() == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name.lower() == "role" and value in _ROLES:
            return True
        if name.lower() in ("class", "id") and tag not in ("html", "body", "article", "main") or name.lower() == "class" and tag == "article":
            parts = set(re.split(r"[\s_-]+", value))
            if parts & _CUES or not inside and parts & _OUTER_CUES:
                return True
    return False


@dataclass
class Line:
    text: str
    linked: int
    main: bool


def lines(page: str) -> list[Line]:
    """The lines of a page: text of one block each, without what is left out; a left-out part leaves an empty line."""
    found: list[Line] = []
    text: list[str] = []
    linked = links = 0
    stack: list[_Open] = []
    skipped = False
    main = False

    def flush() -> None:
        nonlocal linked
        joined = _SPACE.sub(" ", html.unescape("".join(text))).strip()
        if joined:
            found.append(Line(joined, linked, main))
        text.clear()
        linked = 0

    for token in _TOKEN.finditer(page):
        tag = token["tag"]
        if tag is None:
            part = token.group()
            if not skipped and not token["raw"] and (part[0] != "<" or part == "<"):
                text.append(part)
                linked += len(part) if links else 0
            continue
        tag = tag.lower()
        block = tag in _BLOCKS
        if tag == "br" and not skipped:
            text.append(" ")
        if tag == "a" and not skipped:
            links = 0 if token["close"] else 1
        if block and not skipped:
            flush()
            links = 0
        if not block and tag not in ("button", "label", "span", "a", "ins"):
            continue
        if token["close"]:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == tag), None)
            if depth is not None:
                del stack[depth:]
        elif tag not in _VOID:
            while stack and tag in _IMPLIED.get(stack[-1].tag, ()):
                stack.pop()
            if tag in ("article", "main") and any(o.tag in ("head", "nav", "header") for o in stack):
                stack[:] = [o for o in stack if o.tag not in ("head", "nav", "header")]
            outside = _left_out(tag, token["attrs"], any(o.main for o in stack))
            stack.append(_Open(tag, outside, tag in ("article", "main") and not outside))
        before = skipped
        skipped = any(o.skipped for o in stack)
        main = any(o.main for o in stack)
        if skipped and not before:
            if not block:
                continue
            found.append(Line("", 0, main))
    if not skipped:
        flush()
    return found


def main_text(page: str) -> str:
    """The lines between surge and dive, one to a line."""
    found = lines(page)
    marked = any(line.main and line.text for line in found)
    size = np.array([0 if marked and not line.main or not line.main and 2 * line.linked > len(line.text) else len(line.text) for line in found])
    if not len(size) or not size.any():
        return ""
    windows = np.convolve(size, np.ones(WINDOW, int))[WINDOW - 1:]
    regions: list[tuple[int, int]] = []
    filled = np.flatnonzero(np.diff((size > 0).astype(int), prepend=0, append=0))
    for start, stop in zip(filled[::2], filled[1::2], strict=True):
        # A gap shorter than a window is no dive, unless a part was left out there.
        if regions and start - regions[-1][1] < WINDOW and all(found[k].text for k in range(regions[-1][1], start)):
            regions[-1] = (regions[-1][0], stop)
        else:
            regions.append((start, stop))
    peak = [int(windows[a:b].max()) for a, b in regions]
    total = [int(size[a:b].sum()) for a, b in regions]
    # All that a marked part holds is wanted; elsewhere a region has to surge, and to be no mere remnant.
    bound, least = (0, 0) if marked else (min(SURGE, max(peak)), SHARE * max(total))
    kept = [(a, b) for (a, b), p, t in zip(regions, peak, total, strict=True) if p >= bound and t >= least]
    return "\n".join(found[k].text for a, b in kept for k in range(a, b) if size[k])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [main_text(page) if page else "" for page in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(values, pa.string()),
                                          "n_chars": pa.array([len(v) for v in values], pa.int64())})


def extract_pages(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")) \
        .mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
