"""Main text of web pages by tag-path ratios.

A page is read once into blocks: runs of text between block-level tags, each with its path of block-level
tags and classes from the root. Regions that their tag, role, class or id names as menu, header, footer,
sidebar, notice, advert, form or reader comments hold no candidates; where a page has an article or main
element, only blocks inside are. There every candidate is content unless its path is mostly links. Elsewhere the
container with nine tenths of the unlinked text takes this place, and blocks outside of it count if the value of their
path (mean text length times punctuation, smoothed along the page) reaches a part of the median inside.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apilens.llm.common import slices

# Element names and class words below are fixed values of HTML and of common page layouts.
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol optgroup "
    "option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe textarea title svg math object canvas".split())
_SKIPPED = frozenset(
    "head nav footer aside form menu dialog button select fieldset datalist audio video search".split()
)
_SKIPPED_ROLES = frozenset(
    "navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split()
)
_SKIPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox sponsor sponsored sponsors promo promotion "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager sidebar aside rail widget "
    "footer foot header masthead banner cookie cookies consent notice notices gdpr popup modal overlay "
    "newsletter subscribe subscription signup login form share sharing social related recommended "
    "comment comments commentlist discussion disqus reply replies respond skip".split()
)
#: May stand beside those in a class or id; with any other word it names something else (has-sidebar).
_NEUTRAL_WORDS = frozenset(
    "box bar container wrapper wrap list item items block area section links link main top bottom left right primary "
    "secondary inner outer page site global buttons button icons text group panel".split()
)
_CONTAINERS = frozenset("html body div section center".split())
#: Start tags that end an open element of the listed kinds, unless the bounds lie between.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([A-Za-z][^\s/>]*)([^>]*)>",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|([^\s=/>\"']+)")
_NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
#: Weights of a block's neighbours in the smoothing.
_KERNEL = np.array([0.1, 0.2, 0.4, 0.2, 0.1])


@dataclass
class Block:
    path: tuple[str, ...]
    main: bool
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def text(self) -> str:
        return " ".join(html.unescape("".join(self.parts)).split())


@dataclass
class _Open:
    name: str
    label: str
    skipped: bool
    main: bool


def _element(name: str, raw: str, in_main: bool) -> tuple[str, bool]:
    """Label of an element in paths, and whether its name or attributes rule it out."""
    label, skipped = name, name in _SKIPPED or (name == "header" and not in_main)
    if not raw or raw.isspace() or name in ("html", "body"):
        return label, skipped
    for key, a, b, c, bare in _ATTRIBUTE.findall(raw):
        key, value = (key or bare).lower(), a or b or c
        if key in ("class", "id"):
            if key == "class" and value:
                label = f"{name}.{'.'.join(sorted(value.split()))}"
            # a page header is ruled out, the header of an article is not
            for token in value.split():
                words = {w.lower() for w in _NAME_WORDS.findall(token)}
                ruled = words & _SKIPPED_WORDS
                if ruled and words <= _SKIPPED_WORDS | _NEUTRAL_WORDS and not (in_main and ruled <= {"header", "banner"}):
                    skipped = True
        elif key == "role" and value.lower() in _SKIPPED_ROLES:
            skipped = True
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            skipped = True
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
            skipped = True
    return label, skipped


def blocks_of(page: str) -> list[Block]:
    """Candidate blocks with text, in page order."""
    found: list[Block] = []
    stack: list[_Open] = []
    current: Block | None = None
    skipping = mains = linking = 0
    at, n = 0, len(page)
    last = page.rfind(">")  # no tag ends behind it

    def put(text: str) -> None:
        nonlocal current
        if skipping or not text:
            return
        if current is None:
            if text.isspace():
                return
            current = Block(tuple(e.label for e in stack if e.name in _BLOCKS), mains > 0)
            found.append(current)
        current.parts.append(text)
        if linking:
            current.linked += len(text)

    def pop_to(depth: int) -> None:
        nonlocal skipping, mains, linking
        while len(stack) > depth:
            element = stack.pop()
            skipping -= element.skipped
            mains -= element.main
            linking -= element.name == "a"

    def open_at(names: set[str] | frozenset[str], bounds: set[str] | frozenset[str]) -> int:
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth].name in names:
                return depth
            if stack[depth].name in bounds:
                return -1
        return -1

    while at < n:
        tag = _TAG.search(page, at) if at <= last or page.find("<!", at) >= 0 else None
        if tag is None:
            put(page[at:])
            break
        put(page[at : tag.start()])
        at = tag.end()
        name = (tag[2] or tag[5] or "").lower()
        if not name:
            continue
        closing, block = bool(tag[1] or tag[4]), name in _BLOCKS
        if closing:
            if block:
                current = None
                depth = open_at({name}, frozenset())
            else:
                depth = open_at({name}, _BLOCKS)
            if depth >= 0:
                pop_to(depth)
            continue
        raw = tag[3] or tag[6] or ""
        if name in _VOID:
            if name in ("br", "hr"):
                current = None
            continue
        if name in _RAW:
            if not raw.rstrip().endswith("/") or name in ("script", "style", "title", "textarea"):
                end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
                at = end.end() if end else n
            continue
        if block:
            current = None
            kinds, bounds = _ENDS.get(name, (None, None))
            if kinds and (depth := open_at(kinds, bounds)) >= 0:
                pop_to(depth)
            if (depth := open_at({"p"}, _BLOCKS - {"p"})) >= 0:
                pop_to(depth)
        elif name == "a" and (depth := open_at({"a"}, _BLOCKS)) >= 0:
            pop_to(depth)
        label, skipped = _element(name, raw, mains > 0)
        main = name in ("article", "main")
        stack.append(_Open(name, label, skipped, main))
        skipping += skipped
        mains += main
        linking += name == "a"
    return found


def _container(blocks: list[tuple[Block, str]], weights: np.ndarray) -> tuple[str, ...]:
    """The deepest path of plain containers under which nine tenths of the weight lie."""
    sums: dict[tuple[str, ...], float] = defaultdict(float)
    for (block, _), weight in zip(blocks, weights):
        for depth in range(len(block.path) + 1):
            sums[block.path[:depth]] += weight
            if depth < len(block.path) and block.path[depth].split(".")[0] not in _CONTAINERS:
                break
    return max((p for p, w in sums.items() if w >= 0.9 * sums[()]), key=len)


def main_text(page: str, part: float = 0.5) -> str:
    """Content blocks joined by one space; empty if the page has no text.

    In an article or main element, or else the best container, every candidate is content unless its path is mostly links. Other
    blocks are content if the fused value of their path reaches ``part`` of the median in the container.
    """
    blocks = [(b, t) for b in blocks_of(page) if (t := b.text())]
    in_main = any(b.main for b, _ in blocks)
    if in_main:
        blocks = [(b, t) for b, t in blocks if b.main]
    if not blocks:
        return ""
    own: dict[tuple, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0, 0.0])
    unlinked = []
    for block, text in blocks:
        size = sum(map(len, block.parts)) or 1
        share = 1 - min(1.0, block.linked / size)
        length, marks = len(text) * share, len(_PUNCTUATION.findall(text)) * share
        unlinked.append(length)
        sums = own[block.path]
        sums[0] += length
        sums[1] += marks
        sums[2] += 1
        sums[3] += len(text)
    # a path of mostly linked text is a list of links
    kept = np.array([own[b.path][0] >= 0.3 * own[b.path][3] for b, _ in blocks])
    if not in_main and kept.any():
        values = np.array([own[b.path][0] / own[b.path][2] * (1 + own[b.path][1] / own[b.path][2]) for b, _ in blocks])
        smooth = np.convolve(np.pad(values, 2, mode="edge"), _KERNEL, mode="valid")
        fused = np.sqrt(values * smooth)
        best = _container(blocks, np.array(unlinked) * kept)
        inside = np.array([b.path[: len(best)] == best for b, _ in blocks])
        kept &= inside | (fused >= part * np.median(fused[inside & kept]))
    return " ".join(t for (_, t), k in zip(blocks, kept) if k)


def extract(
    pages: DataFrame, part: float = 0.5, id_column: str = "page_id", url_column: str = "url", html_column: str = "html"
) -> DataFrame:
    """(page_id, url, text, n_chars) of every row.

    Null or empty pages and pages without content have an empty text. Repeated rows and rows without an id get
    their own rows; other columns are left out, whatever their names.
    """
    narrow = pages.select(
        F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), F.col(html_column).alias("html")
    )
    schema = T.StructType(
        [narrow.schema["page_id"], narrow.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(page or "", part) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                names=schema.names,
            )

    return narrow.mapInArrow(read, schema)
