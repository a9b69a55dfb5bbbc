"""Main text of web pages by tag-path ratios: text and punctuation per path from the root, smoothed, fused and cut at a threshold."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pumpwise.llm.common import by_characters, read_table, text_or_empty

#: Elements by what HTML says of them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript plaintext template svg math".split())
BLOCKS = frozenset(
    "html head body article section main nav aside header footer address div p h1 h2 h3 h4 h5 h6 hgroup ul ol li dl dt dd menu dir table caption thead "
    "tbody tfoot tr td th colgroup pre blockquote figure figcaption form fieldset legend details summary dialog center hr search frameset optgroup option "
    "select button textarea audio video canvas object".split()
)
#: A start tag ends an open paragraph if it is a block; these end an open element of the kinds behind them.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "thead": ("thead", "tbody", "tfoot", "tr", "td", "th"), "tbody": ("thead", "tbody", "tfoot", "tr", "td", "th"), "body": ("head",),
    "tfoot": ("thead", "tbody", "tfoot", "tr", "td", "th"), "optgroup": ("optgroup", "option"),
} | {f"h{i}": tuple(f"h{k}" for k in range(1, 7)) for i in range(1, 7)}
#: Implied ends do not reach beyond the nearest of these; an li's also not beyond its list.
SCOPES = frozenset("html table td th caption object button".split())
LISTS = frozenset("ul ol menu dir dl".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements, roles and words of class and id that say that their content is not the article.
OTHER_TAGS = frozenset("head nav aside footer form dialog menu select button fieldset label search audio video canvas object frameset dir".split())
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar note status".split())
OTHER_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification "
    "alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations teaser teasers "
    "trending popular sidebar sidebars aside nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar masthead topbar footer comment "
    "comments commentlist respond reply replies disqus feedback widget widgets toc skip".split()
)
#: What holds an article: by element, role or property; and elements that can be the container of one where nothing says so.
ARTICLE_TAGS, ARTICLE_ROLES = frozenset(("article", "main")), frozenset(("main", "article"))
CONTAINERS = frozenset("html body main article section div td center details".split())

#: Smoothing reaches so many blocks each way, with weights of a normal curve; a path is content if its fused ratio reaches this part of the deviation.
RADIUS, THRESHOLD = 1, 0.5
#: Parts of the content's text that an article element, or else any container, must hold to be chosen.
ARTICLE_SHARE, CONTAINER_SHARE = 0.4, 0.7

#: Comments, declarations, end tags and start tags; an attribute's quoted value may hold >.  Nothing is matched twice, so no input is slow.
_TOKEN = re.compile(
    r"""<!--(?:-?>|(?s:.*?)(?:--!?>|\Z))|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)"""
    r"""|<([a-zA-Z][^\s/>]*)((?>[^>=]|=\s*+(?>"[^"]*"|'[^']*'|[^\s>"'][^\s>]*+)?)*+)(?:>|\Z)"""
)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*))""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.IGNORECASE) for t in RAW}
#: Punctuation of sentences in any script.
_PUNCTUATION = re.compile(r"[.,;:!?…、。，！？；：،؛؟।¿¡]")


@dataclass
class Element:
    """An open or closed element: its place in the tree, the number of its path, and whether the article may be in it."""

    tag: str
    parent: int
    path: int
    other: bool = False
    article: bool = False
    header: bool = False


@dataclass
class Block:
    """Text between two block borders: the block element that holds it and its pieces, link text apart."""

    element: int
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _kind(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is surely not of the article, and whether it says that it is one."""
    other, article = tag in OTHER_TAGS, tag in ARTICLE_TAGS
    if attributes and "=" in attributes and tag not in ("html", "body"):
        found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
        names = {w.lower() for k in ("class", "id") for w in _WORDS.findall(found.get(k, ""))}
        roles = set(found.get("role", "").lower().split())
        other |= bool(names & OTHER_WORDS and tag != "article" or roles & OTHER_ROLES or found.get("aria-hidden", "").lower() == "true")
        # An article may be of class comment; one that is of class sidebar is the article all the same only by its text.
        other |= tag == "article" and bool(names & {"comment", "comments", "reply", "teaser", "related", "ad", "advert", "sponsored", "promo"})
        other |= bool(re.search(r"display\s*:\s*none", found.get("style", "")))
        article |= bool(roles & ARTICLE_ROLES) or found.get("itemprop", "").lower() == "articlebody"
    if re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attributes):
        other = True
    return other, article


class Page:
    """The elements and text blocks of a page, read in one pass."""

    def __init__(self, source: str) -> None:
        self.elements = [Element("", -1, 0)]
        self.blocks: list[Block] = []
        self.paths: dict[tuple[int, str], int] = {}
        self.stack, self.open, self.barriers = [0], {}, [0]
        self.block: Block | None = None
        self._read(source)

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        for_text = 0
        while at < n:
            m = _TOKEN.search(source, at)
            start = m.start() if m else n
            if start > for_text:
                self._text(source[for_text:start])
            if not m:
                break
            at = for_text = m.end()
            if m[1]:
                self._end(m[1].lower())
            elif m[2]:
                tag = m[2].lower()
                if tag in RAW:
                    # Their text is not the page's: it ends at their end tag, or with the page.
                    if not (tag in ("svg", "math") and m[3].rstrip().endswith("/")):
                        end = _RAW_END[tag].search(source, at)
                        at = for_text = end.start() if end else n
                        if end:
                            close = source.find(">", at)
                            at = for_text = close + 1 if close >= 0 else n
                    if tag in BLOCKS:
                        self.block = None
                else:
                    self._start(tag, m[3])
        self.block = None
        for b in self.blocks:
            b.text = " ".join("".join(b.pieces).split())
            b.pieces = []
        self.blocks = [b for b in self.blocks if b.text]

    def _text(self, raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        if self.block is None:
            if not text.strip():
                return
            top = next(i for i in reversed(self.stack) if self.elements[i].tag in BLOCKS or i == 0)
            self.block = Block(top)
            self.blocks.append(self.block)
        self.block.pieces.append(text)
        if self.open.get("a"):
            self.block.linked += len("".join(text.split()))

    def _in_scope(self, tag: str, barrier: int) -> bool:
        places = self.open.get(tag)
        return bool(places) and places[-1] > barrier

    def _pop_to(self, depth: int) -> None:
        """Close all open elements from this depth of the stack on."""
        while len(self.stack) > depth:
            tag = self.elements[self.stack.pop()].tag
            self.open[tag].pop()
            if tag in SCOPES:
                self.barriers.pop()

    def _start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            if self.block:
                self.block.pieces.append(" ")
            return
        if tag in BLOCKS:
            self.block = None
            if self._in_scope("p", self.barriers[-1]):
                self._pop_to(self.open["p"][-1])
            barrier = self.barriers[-1]
            if tag == "li" or tag in ("dt", "dd"):
                barrier = max([barrier, *(self.open[x][-1] for x in LISTS if self.open.get(x))])
            if tag in ("tr", "td", "th", "thead", "tbody", "tfoot"):
                # Cells are borders for what is in them, not for the next cell: those of the innermost table close.
                barrier = self.open["table"][-1] if self.open.get("table") else 0
            opened = [self.open[x][-1] for x in CLOSES.get(tag, ()) if self._in_scope(x, barrier)]
            if tag in HEADINGS:
                opened = [d for d in opened if d == len(self.stack) - 1]
            if opened:
                self._pop_to(min(opened))
        if tag in VOID or attributes.rstrip().endswith("/") and tag not in BLOCKS:
            return
        if tag in ("html", "body") and self.open.get(tag):
            return
        parent = self.elements[self.stack[-1]]
        other, article = _kind(tag, attributes)
        inside = parent.article or any(self.open.get(x) for x in ARTICLE_TAGS)
        header = parent.header or tag == "header"
        if tag == "article" and self.open.get("article"):
            other = True  # an article in an article is a comment on it
        if tag == "header" and not inside:
            other = True
        path = self.paths.setdefault((parent.path, tag), len(self.paths) + 1)
        self.elements.append(Element(tag, self.stack[-1], path, other or parent.other, article, header))
        self.open.setdefault(tag, []).append(len(self.stack))
        if tag in SCOPES:
            self.barriers.append(len(self.stack))
        self.stack.append(len(self.elements) - 1)

    def _end(self, tag: str) -> None:
        if tag in BLOCKS or tag == "br":
            self.block = None if tag != "br" else self.block
        barrier = self.barriers[-1] if tag not in SCOPES else -1
        if tag in ("tr", "tbody", "thead", "tfoot"):
            barrier = self.open["table"][-1] if self.open.get("table") else 0
        if tag in ("table", "body", "html"):
            barrier = -1
        if self._in_scope(tag, barrier):
            depth = self.open[tag][-1]
            # An inline end tag does not close blocks that were opened in it.
            if tag in BLOCKS or not any(self.elements[i].tag in BLOCKS for i in self.stack[depth + 1 :]):
                self._pop_to(depth)


def _smooth(x: np.ndarray) -> np.ndarray:
    weights = np.exp(-np.arange(-RADIUS, RADIUS + 1) ** 2 / 2.0)
    return np.convolve(np.pad(x, RADIUS, mode="edge"), weights / weights.sum(), "valid") if len(x) else x


def content_paths(paths: list[int], lengths: list[int], marks: list[int]) -> np.ndarray:
    """Which blocks, given in page order, stand on content paths.

    A path's text ratio is the text on it for each of its blocks, its punctuation ratio the punctuation for each; both are spread by
    the deviations within the path, smoothed along the page and multiplied.  Paths with a mean of at least THRESHOLD deviations are content.
    """
    if not paths:
        return np.zeros(0, bool)
    names, of = np.unique(np.asarray(paths), return_inverse=True)
    text, mark = np.asarray(lengths, float), np.asarray(marks, float)
    count = np.bincount(of)
    mean_text, mean_mark = np.bincount(of, text) / count, np.bincount(of, mark) / count
    ratio_text, ratio_mark = _smooth(mean_text[of]), _smooth(mean_mark[of])
    spread = lambda x, mean: np.sqrt(np.bincount(of, (x - mean[of]) ** 2) / count)
    fused = ratio_text * (1 + ratio_mark) * np.log1p(1 + spread(text, mean_text))[of] * np.log1p(1 + spread(mark, mean_mark))[of]
    of_path = np.bincount(of, fused) / count
    limit = min(THRESHOLD * fused.std(), float(of_path.max()))
    return of_path[of] >= limit


def main_text(source: str) -> str:
    """The article's blocks in page order, each with single spaces, joined by one space; empty where there is none."""
    page = Page(source)
    elements = page.elements
    blocks = [b for b in page.blocks if not elements[b.element].other]
    # In an article's header only headings are the article's.
    blocks = [b for b in blocks if not elements[b.element].header or elements[b.element].tag in HEADINGS]
    if not blocks:
        return ""
    sizes = [len(b.text) for b in blocks]
    all_linked = [b.linked >= len("".join(b.text.split())) for b in blocks]
    leaf = [page.paths.setdefault((elements[b.element].path, "a"), len(page.paths) + 1) if x else elements[b.element].path for b, x in zip(blocks, all_linked)]
    content = content_paths(leaf, sizes, [len(_PUNCTUATION.findall(b.text)) for b in blocks])
    # Text on content paths that each element holds; children come after their parents.
    held = np.zeros(len(elements))
    for b, n, good in zip(blocks, sizes, content):
        held[b.element] += n * good
    for i in range(len(elements) - 1, 0, -1):
        held[elements[i].parent] += held[i]
    total = held[0]
    found = [i for i, e in enumerate(elements) if e.article and not e.other and held[i] >= ARTICLE_SHARE * total]
    certain = bool(found)
    if not found:
        found = [i for i, e in enumerate(elements) if i and e.tag in CONTAINERS and not e.other and held[i] >= CONTAINER_SHARE * total] or [0]
    # The innermost one; of several side by side the one with the most text.
    depth = [0] * len(elements)
    for i in range(1, len(elements)):
        depth[i] = depth[elements[i].parent] + 1
    root = max(found, key=lambda i: (held[i] >= CONTAINER_SHARE * total, depth[i], held[i], -i))
    inside = np.zeros(len(elements), bool)
    inside[root] = True
    for i in range(root + 1, len(elements)):
        inside[i] = inside[elements[i].parent]
    keep = [b for b, x in zip(blocks, all_linked) if inside[b.element] and (certain or not x or elements[b.element].tag not in ("li", "ul", "ol", "div", "td"))]
    return " ".join(b.text for b in keep)


def extract_text(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """The columns of pages, html_col apart, with the main text of each page in text_col and its code points in n_chars.

    Elements that are no part of an article (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments; by
    element, role, class or id) are left out.  Tag-path ratios select the blocks on content paths; the article is the innermost article element, or else
    container, that holds most of their text, and all of its remaining blocks are its text, short ones too.  Character references are decoded
    once, white space inside a block becomes one space, blocks are joined by one space in page order.

    A null or empty page, or one without text, gives an empty text; text without any tag is a block.  Pages are handled one by one and whole, repeated
    rows give repeated results, an empty table none.  Columns of pages named like the two new ones are replaced.
    """
    kept = [c for c in pages.columns if c.lower() not in {html_col.lower(), text_col.lower(), "n_chars"}]
    names = [f"c{i}" for i in range(len(kept))]
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    rows = pages.select(text_or_empty(html_col).alias("html"), *(quoted(c).alias(n) for c, n in zip(kept, names)))

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_characters(batch, 0):
                texts = [main_text(x) for x in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                    names=[*part.schema.names[1:], "text", "n_chars"],
                )

    schema = rows.drop("html").schema.add("text", "string").add("n_chars", "long")
    found = rows.mapInArrow(of_batches, schema)
    return found.select(*(F.col(n).alias(c) for c, n in zip(kept, names)), F.col("text").alias(text_col), "n_chars")


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars."""
    return extract_text(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
