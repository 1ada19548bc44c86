"""Main text of web pages by site template removal.

Every element's subtree is hashed with its host (its name, class, id and all below it), and Spark counts the hashes.

* A container outside the article (div, nav, footer, list, form...) is template if it recurs on MIN_PAGES pages or more
  of its host whose main texts differ; copies of one page count once.
* A container inside an article or main element, and running text outside one (paragraphs, headings, inline elements),
  is template if it recurs as often and no pair of neighbours makes up more than half of its occurrences: the parts of
  a copied text keep their neighbours, a notice put among many texts does not. It must hold LEAST characters, as
  short ones recur by chance.
* Running text inside an article (paragraphs, headings, lists, tables, inline elements) is the article's own, however
  often it recurs: articles quote and repeat one another.

A template subtree is deleted wherever it occurs on its host, inline ones too; article and main elements and what holds
them are none. No count depends on how large the host is. What boilerplate is left, because its content is new on each page, is
told by its markup (navigation, footers, asides, forms, scripts, classes such as "ad" or "comments").
`n_template_chars` and `n_markup_chars` say how much text went by templates, and by markup alone.

If a page has article or main elements with text, its text is theirs; else that of the body. Character references are
decoded, white space inside a block becomes one space, blocks are joined by a line feed. A <br> is white space.

Templates are broadcast as a sorted list of hashes where they are MOST at most (8 bytes each); beyond that each page
gets its own templates by a join.

Nulls and edges: a null or empty html gives an empty text; a page without a host (null or bad url) loses only what its markup
tells; repeated rows each get a row and count as one page; broken and truncated markup is closed as
browsers do; texts of any length are read whole; other columns don't pass; an empty table gives an empty result.
"""

from __future__ import annotations

import html as _html
import re
from array import array
from bisect import bisect_left
from collections.abc import Container

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from credence.llm.common import materialise, parallel

MIN_PAGES, LEAST = 3, 40
MOST = 4_000_000

# Quotes hold a value only right after "=".
_TAG = re.compile(r"""<(?:(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))|[^>=]+|=)*+)>?|!--|[!?])""")
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_SPACE = re.compile(r"\s+")
_TOKEN = re.compile(r"[a-z0-9]+")
#: Element names and class words with a meaning here. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
CLOSES_P = BLOCKS - frozenset("body head html li dd dt td th tr tbody thead tfoot option title legend".split()) | {"p"}
GONE = frozenset("nav footer aside form script style noscript template iframe svg button select textarea object canvas dialog menu head title math audio video datalist input noembed noframes".split())
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table caption tbody thead tfoot tr td th dl dt dd figure figcaption ul ol li a abbr b cite code em i kbd mark q s samp small span strong sub sup time u var".split())
CONTAINERS = frozenset("address aside center details dialog dir div dl fieldset figure footer form header hgroup menu nav ol section summary table ul".split())
GONE_WORDS = frozenset("ad ads adv advert advertisement adverts sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert newsletter subscribe subscription sidebar widget menu nav navbar navigation breadcrumb breadcrumbs footer masthead share sharing social related recommended recommendations comment comments disqus replies respond popup modal overlay login signup search pagination pager skip toolbar".split())
GONE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
SAME_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th")}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",), "tbody": ("table",)}


class Element:
    __slots__ = ("tag", "marks", "parts", "kids", "out_at", "buffer_at", "chars", "template", "markup", "gone", "rooted", "in_root", "is_root", "blocks_in")

    def __init__(self, tag: str, marks: str, out_at: int, buffer_at: int, gone: bool, in_root: bool, is_root: bool):
        self.tag, self.marks, self.out_at, self.buffer_at, self.gone, self.in_root, self.is_root = tag, marks, out_at, buffer_at, gone, in_root, is_root
        self.parts: list[bytes] = []
        self.kids: list[tuple[int, int, bool]] = []  # place in parts, hash, strict
        self.chars = self.template = self.markup = 0  # characters; those in template subtrees; those told by markup alone
        self.rooted, self.blocks_in = is_root, False


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(source)} if source.strip() else {}


class Known:
    """A sorted list of hashes that answers `in`."""

    def __init__(self, hashes: bytes):
        self.hashes = array("q", hashes)

    def __contains__(self, h: int) -> bool:
        at = bisect_left(self.hashes, h)
        return at < len(self.hashes) and self.hashes[at] == h


class Page:
    """A walk over a page of a host. Template subtrees are dropped; `found` are what may be one: hash, strict, neighbours."""

    def __init__(self, source: str, templates: Container[int] = frozenset(), host: str = ""):
        self.templates, self.seed = templates, xxhash.xxh3_64_intdigest(host.encode("utf-8", "surrogatepass"))
        self.blocks: list[tuple[str, bool]] = []  # text, whether inside a content root
        self.found: list[tuple[int, bool, int]] = []
        self.buffer: list[str] = []
        self.stack = [Element("#root", "", 0, 0, False, False, False)]
        self.open: dict[str, int] = {}
        self._walk(source)
        while len(self.stack) > 1:
            self._close()
        self._flush()
        self._neighbours(self.stack[0])
        self.template_chars, self.markup_chars = self.stack[0].template, self.stack[0].markup

    def _walk(self, s: str) -> None:
        at, n = 0, len(s)
        while at < n:
            m = _TAG.search(s, at)
            if not m:
                self._text(s[at:])
                return
            if m.start() > at:
                self._text(s[at : m.start()])
            at = m.end()
            tag = m[2]
            if tag is None:
                if m[0] == "<!--":
                    end = s.find("-->", at)
                    at = n if end < 0 else end + 3
                else:
                    end = s.find(">", at)
                    at = n if end < 0 else end + 1
                continue
            tag = tag.lower()
            if m[1]:
                self._end(tag)
                continue
            self._start(tag, m[3])
            if tag in RAW:
                end = re.compile(rf"(?i)</{tag}(?=[\s/>])").search(s, at)
                stop = end.start() if end else n
                if tag not in GONE:
                    self._text(s[at:stop])
                else:
                    self.stack[-1].parts.append(s[at:stop].encode("utf-8", "surrogatepass"))
                self._close()
                close = s.find(">", stop)
                at = n if close < 0 else close + 1

    def _text(self, raw: str) -> None:
        text = _html.unescape(raw) if "&" in raw else raw
        top = self.stack[-1]
        if not text.isspace():
            top.parts.append(_SPACE.sub(" ", text).encode("utf-8", "surrogatepass"))
            top.chars += len(text)
            if top.gone:
                top.markup += len(text)
        if not top.gone:
            self.buffer.append(text)

    def _flush(self) -> None:
        if self.buffer:
            text = _SPACE.sub(" ", "".join(self.buffer)).strip()
            if text:
                self.blocks.append((text, self.stack[-1].in_root))
            self.buffer.clear()

    def _start(self, tag: str, source: str) -> None:
        if tag in CLOSES_P and self.open.get("p"):
            self._close_to(("p",), ())
        if tag in SAME_CLOSES and any(self.open.get(x) for x in SAME_CLOSES[tag]):
            self._close_to(SAME_CLOSES[tag], SCOPE[tag])
        top = self.stack[-1]
        if tag in BLOCKS:
            self._flush()
            for e in reversed(self.stack):  # inline elements around a block
                if e.tag in BLOCKS or e.blocks_in:
                    break
                e.blocks_in = True
        elif tag == "br":
            if not top.gone:
                self.buffer.append(" ")
            return
        attributes = _attributes(source)
        marks = f"{attributes.get('class', '')}|{attributes.get('id', '')}".lower()
        role = attributes.get("role", "").lower()
        is_root = tag in ("article", "main") or role in ("main", "article")
        words = set(_TOKEN.findall(marks)) if marks != "|" else set()
        gone = top.gone or tag in GONE or tag == "header" and not top.in_root or role in GONE_ROLES or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true"
        if not gone and words & GONE_WORDS and tag not in ("html", "body", "main") and not (tag == "article" and not words & {"comment", "comments", "ad", "ads", "related", "promo", "sponsored"}):
            gone = True
        if tag in VOID:
            return
        self.stack.append(Element(tag, marks, len(self.blocks), len(self.buffer), gone, not gone and (top.in_root or is_root), is_root and not gone))
        self.open[tag] = self.open.get(tag, 0) + 1

    def _close_to(self, tags: tuple[str, ...], scope: tuple[str, ...]) -> None:
        """Close the innermost of `tags`, unless a `scope` element lies further in."""
        for i in range(len(self.stack) - 1, 0, -1):
            t = self.stack[i].tag
            if t in tags:
                while len(self.stack) > i:
                    self._close()
                return
            if t in scope or t in ("article", "main", "body", "td", "th", "table") and t not in tags:
                return

    def _end(self, tag: str) -> None:
        if tag in VOID:
            return
        if not self.open.get(tag):
            return
        while True:
            t = self.stack[-1].tag
            self._close()
            if t == tag:
                return

    def _close(self) -> None:
        e = self.stack[-1]
        block = e.tag in BLOCKS
        if block:
            self._flush()
        self.stack.pop()
        self.open[e.tag] -= 1
        up = self.stack[-1]
        h = xxhash.xxh3_64_intdigest(b"\x00".join([e.tag.encode(), e.marks.encode("utf-8", "surrogatepass"), *e.parts]), self.seed) - 2**63
        strict = up.in_root or e.tag not in CONTAINERS
        own = up.in_root and e.tag in RUNNING
        may = e.chars and not own and not e.rooted and not e.blocks_in and e.tag not in ("html", "body", "head", "title", "script", "style") and (not strict or e.chars >= LEAST)
        if len(e.parts) > 1 or e.marks.strip("|"):  # else its one child is covered by the element itself
            self._neighbours(e)
        elif e.kids and not may:
            self._neighbours(e)
        if may:
            up.kids.append((len(up.parts), h, strict))
            if h in self.templates:
                e.template, e.markup = e.chars, 0
                if block:
                    del self.blocks[e.out_at :]
                else:
                    del self.buffer[e.buffer_at :]
        up.parts.append(h.to_bytes(8, "little", signed=True))
        up.chars += e.chars
        up.template += e.template
        up.markup += e.markup
        up.rooted |= e.rooted

    def _neighbours(self, e: Element) -> None:
        """What may be template among e's children, each with a hash of what stands before and after it if strict."""
        parts = e.parts
        for i, h, strict in e.kids:
            if strict and len(parts) == 1:
                continue  # nothing around it: its parent stands for it
            around = 0
            if strict:
                around = xxhash.xxh3_64_intdigest(b"\x00".join([parts[i - 1] if i else b"", b"", parts[i + 1] if i + 1 < len(parts) else b""])) - 2**63
            self.found.append((h, strict, around))

    def text(self) -> str:
        inside = [t for t, root in self.blocks if root]
        return "\n".join(inside or [t for t, _ in self.blocks])


def main_text(source: str | None, templates: Container[int] = frozenset(), host: str = "") -> str:
    return Page(source, templates, host).text() if source else ""


def _rows(pages: DataFrame) -> DataFrame:
    host = F.lower(F.try_parse_url(F.col("url").cast("string"), F.lit("HOST")))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", host)


def subtrees(pages: DataFrame) -> DataFrame:
    """hash, strict, seen of every subtree that may be template; page: a hash of host and html.

    `seen` is what distinct occurrences differ in: the page's main text, or the neighbours where `strict`.
    """

    def run(batches):
        for b in batches:
            out = ([], [], [], [])
            for host, source in zip(b.column("host").to_pylist(), b.column("html")):
                raw = source.as_py() or ""
                page = Page(raw, host=host)
                whole = xxhash.xxh3_64_intdigest(raw.encode("utf-8", "surrogatepass"), page.seed) - 2**63
                text = page.text()
                main = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63 if text else whole
                for h, strict, around in dict.fromkeys(page.found):
                    for column, x in zip(out, (h, strict, around if strict else main, whole)):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.bool_(), pa.int64(), pa.int64()))], ["hash", "strict", "seen", "page"])

    return parallel(_rows(pages).filter("host is not null")).mapInArrow(run, "hash long, strict boolean, seen long, page long")


def templates(found: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """hash of the template subtrees, each once. Both steps send out partial counts, so no hash's pages meet."""
    seen = found.groupBy("hash", "strict", "seen").agg(F.count("*").alias("k"))
    counts = seen.groupBy("hash", "strict").agg(F.count("*").alias("distinct"), F.sum("k").alias("n"), F.max("k").alias("top"))
    diverse = ~F.col("strict") | (2 * F.col("top") <= F.col("n"))
    return counts.filter((F.col("distinct") >= min_pages) & diverse).select("hash").distinct()


_OUT = "page_id long, url string, text string, n_chars long, n_template_chars long, n_markup_chars long"


def _texts(rows: DataFrame, known) -> DataFrame:
    """The texts of rows: page_id, url, host, html and, unless `known` gives them, their templates."""

    def run(batches):
        every = known() if known else None
        for b in batches:
            texts, chars = [], ([], [])
            lists = b.column("templates") if every is None else [None] * b.num_rows
            for host, source, mine in zip(b.column("host").to_pylist(), b.column("html"), lists):
                raw, here = source.as_py(), every if every is not None else frozenset(mine.as_py() or ())
                page = Page(raw or "", here if host is not None else frozenset(), host or "")
                texts.append(page.text())
                chars[0].append(page.template_chars)
                chars[1].append(page.markup_chars)
            lengths = [[len(t) for t in texts], *chars]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), *(pa.array(x, pa.int64()) for x in lengths)], [x.split()[0] for x in _OUT.split(", ")])

    return rows.mapInArrow(run, _OUT)


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, most: int = MOST) -> DataFrame:
    """page_id, url, text, n_chars, n_template_chars, n_markup_chars: a row for each row of pages."""
    known = materialise(templates(subtrees(pages), min_pages), "templates")
    rows = _rows(pages).select("page_id", "url", "host", "html")
    if known.count() <= most:
        hashes = known.sort("hash").toArrow().column("hash").to_numpy().tobytes()  # 8 bytes each, `most` at most
        sent = pages.sparkSession.sparkContext.broadcast(hashes)
        return _texts(parallel(rows), lambda: Known(sent.value))
    # Each page's own: at most its subtrees.
    mine = subtrees(pages).select("hash", "page").distinct().join(known, "hash").groupBy("page").agg(F.collect_list("hash").alias("templates"))
    seeded = rows.mapInArrow(_page_hashes, "page_id long, url string, host string, html string, page long")
    return _texts(seeded.join(mine, "page", "left").select("page_id", "url", "host", "html", "templates"), None)


def _page_hashes(batches):
    for b in batches:
        seeds = [xxhash.xxh3_64_intdigest((h or "").encode("utf-8", "surrogatepass")) for h in b.column("host").to_pylist()]
        page = [xxhash.xxh3_64_intdigest((x.as_py() or "").encode("utf-8", "surrogatepass"), s) - 2**63 for x, s in zip(b.column("html"), seeds)]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(page, pa.int64())], [*b.schema.names, "page"])
