"""Main text of web pages, with site templates found by counting element subtrees per host."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import Scratch, broadcast_if_small, pick
from ._memory import lean

#: A subtree is a template if it is on at least this many different pages of its host and on this share of them.
MIN_PAGES, MIN_SHARE = 5, 0.3
#: On hosts of very many pages, this many different pages are enough without the share.
MANY_PAGES = 1000

#: A comment, or a tag of usual form: no quote in its name, and no angle bracket in its values. What else begins with a bracket takes the scanner.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>"']*)(?=[\s/>])((?:[^<>"']|"[^"<>]*"|'[^'<>]*')*)>|<""", re.S)
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_SPECIAL = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_RAW = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in ("script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp")}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set(
    "address article aside blockquote body canvas center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav noscript ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: What an opening tag ends if it is open, up to the nearest of the second group.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table", "thead", "tbody", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Elements that are never part of the article.
_DROPPED = set(
    "script style noscript template title head nav header footer aside form button select textarea input label iframe object embed "
    "svg canvas audio video dialog menu noembed noframes xmp".split()
)
#: Words of class, id or role that mark menus, adverts, notices, sidebars, comments and the like.
_MARKS = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar aside footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup "
    "login comment comments commentlist disqus discussion reply replies respond related recommended share sharing social toolbar widget pagination pager skip "
    "contentinfo complementary search".split()
)
_APART = re.compile(r"[^a-z]+")
_HUMP = re.compile(r"([a-z])([A-Z])")
#: Words that make a class tell of something elsewhere, as in has-sidebar.
_ABOUT = set("no has with without".split())
_WHOLE = {"html", "body", "main", "article", "#page"}


class Node:
    __slots__ = ("tag", "attrs", "parts", "print", "places")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.parts, self.print, self.places = tag, attrs, [], 0, ()


class Scanner:
    """Tags of any form in one pass: what was searched for without success is not searched for again from further on."""

    def __init__(self, source: str):
        self.source, self.last, self.last_section = source, source.rfind(">"), source.rfind("]]>")
        self.ends: dict[int, int] = {}  # place of a bracket or quote outside quotes -> where the tag ends that has it, or -1

    def end(self, at: int) -> int:
        """The first > from a place outside quotes on that is outside quotes; -1 if there is none."""
        m, passed, found = _SPECIAL.search(self.source, at), [], -1
        while m:
            place = m.start()
            if place in self.ends:
                found = self.ends[place]
                break
            passed.append(place)
            if m[0] == ">":
                found = place
                break
            close = self.source.find(m[0], place + 1)
            m = _SPECIAL.search(self.source, close + 1) if close >= 0 else None
        for place in passed:
            self.ends[place] = found
        return found

    def tag(self, at: int) -> tuple[int, str, str, str] | None:
        """(where it ends, "/" of an end tag, name, attributes) of what begins at this bracket; no name if it is no tag, None if it is text."""
        source = self.source
        if source.startswith("<![CDATA[", at) and self.last_section >= at + 9:
            return source.index("]]>", at + 9) + 3, "", "", ""
        if self.last <= at:
            return None
        if source[at + 1 : at + 2] in ("!", "?"):
            close = source.find(">", at + 2)
            return (close + 1, "", "", "") if close >= 0 else None
        m = _NAME.match(source, at + 1)
        if m is None:
            return None
        starts = [m.end()] + [i for i in range(m.end() - 1, m.start(2), -1) if source[i] in "\"'"]  # a name may end before a quote
        for start in starts:
            end = self.end(start)
            if end >= 0:
                return end + 1, m[1], source[m.start(2) : start], source[start:end]
        end = source.find(">", m.end())
        return (end + 1, m[1], m[2], source[m.end() : end]) if end >= 0 else None


class Open:
    """Open elements, and for each name where they are."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def close(self, place: int) -> None:
        for node in self.nodes[place:]:
            self.places[node.tag].pop()
        del self.nodes[place:]

    def nearest(self, tags) -> int:
        """The place of the innermost open element of these names; 0 if none is open."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)


def parse(source: str) -> Node:
    """The element tree, in time linear in the source. Unclosed and misnested tags are repaired as browsers mostly do."""
    root = Node("#page")
    open_, scanner, at, look = Open(root), None, 0, 0
    while True:
        m = _TAG.search(source, look)
        if m is None:
            break
        end, name, slash, attrs = m.end(), m[2], m[1], m[3]
        if name is None and end == m.start() + 1:  # a bracket alone
            scanner = scanner or Scanner(source)
            found = scanner.tag(m.start())
            if found is None:
                look = m.start() + 1
                continue
            end, slash, name, attrs = found
        if m.start() > at:
            open_.nodes[-1].parts.append(source[at : m.start()])
        at = look = end
        if not name:
            continue
        tag = name.lower()
        if slash:
            if place := open_.nearest((tag,)):
                open_.close(place)
            continue
        ends, within = ({"p"}, {"td", "th", "button", "li", "div", "article", "section"}) if tag in _BLOCK else (None, None)
        for ends, within in ((ends, within), _ENDS.get(tag, (None, None))):
            if ends and (place := open_.nearest(ends)) > open_.nearest(within):
                open_.close(place)
        node = Node(tag, attrs)
        open_.nodes[-1].parts.append(node)
        if tag in _RAW:
            close = _RAW[tag].search(source, at)
            node.parts.append(source[at : close.start() if close else len(source)])
            at = look = close.end() if close else len(source)
        elif tag not in _VOID and not attrs.endswith("/"):
            open_.push(node)
    if at < len(source):
        open_.nodes[-1].parts.append(source[at:])
    return root


def fingerprint(root: Node) -> None:
    """Give each element the hash of its tag, attributes, text and the hashes below it; and two hashes of that and its place: the
    elements above it, and how many stand before or after it."""
    todo = [(root, False)]
    while todo:
        node, below = todo.pop()
        if not below:
            todo.append((node, True))
            todo.extend((x, False) for x in node.parts if isinstance(x, Node))
            continue
        parts = [str(x.print) if isinstance(x, Node) else " ".join(x.split()) for x in node.parts]
        node.print = _hash(node.tag, " ".join(node.attrs.split()), *(p for p in parts if p))
    todo = [(root, 0)]
    while todo:
        node, above = todo.pop()
        # the page's own elements tell by their attributes of the page, not of the site
        above = _hash(str(above), node.tag, "" if node.tag in _WHOLE else " ".join(node.attrs.split()))
        below = [x for x in node.parts if isinstance(x, Node)]
        for i, x in enumerate(below):
            x.places = (_hash(str(above), str(x.print), "before", str(i)), _hash(str(above), str(x.print), "after", str(len(below) - i)))
            todo.append((x, above))


def _hash(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass")) - 2**63


def marked(node: Node) -> bool:
    """Whether the element's tag or attributes say that it is no article text."""
    if node.tag in _DROPPED:
        return True
    if not node.attrs or node.tag in ("html", "body"):
        return False
    for name, value in _ATTRIBUTE.findall(node.attrs):
        name = name.lower()
        if name == "hidden":
            return True
        value = value.strip("\"'")
        if name in ("class", "id", "role"):
            for one in value.split():
                words = _APART.split(_HUMP.sub(r"\1 \2", one).lower())
                if not _MARKS.isdisjoint(words) and _ABOUT.isdisjoint(words):
                    return True
        value = value.lower()
        if name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def _text_sizes(root: Node, templates: frozenset) -> dict[int, int]:
    """The text below each element, by the element's identity, less marked and template subtrees; each element once, from below."""
    sizes: dict[int, int] = {}
    todo = [(root, False)]
    while todo:
        node, below = todo.pop()
        if not below:
            todo.append((node, True))
            todo.extend((x, False) for x in node.parts if isinstance(x, Node))
            continue
        sizes[id(node)] = sum(len(x) if isinstance(x, str) else 0 if marked(x) or not templates.isdisjoint(x.places) else sizes[id(x)] for x in node.parts)
    return sizes


def main_element(root: Node, templates: frozenset) -> Node:
    """The article with most text, of equal siblings the last, else the main element, else the body, else the page."""
    found = {"article": [], "main": [], "body": []}
    todo = [root]
    while todo:
        node = todo.pop()
        for x in reversed(node.parts):
            if isinstance(x, Node) and not marked(x):
                if x.tag in found:
                    found[x.tag].append(x)
                todo.append(x)
    for tag in ("article", "main", "body"):
        if found[tag]:
            if len(found[tag]) == 1:
                return found[tag][0]
            sizes = _text_sizes(root, templates)
            return max(found[tag], key=lambda x: sizes[id(x)])
    return root


def blocks(node: Node, templates: frozenset) -> list[str]:
    """Texts of the blocks below an element in page order, without marked and template subtrees."""
    out, piece = [], []

    def close():
        text = " ".join("".join(piece).split())
        piece.clear()
        if text:
            out.append(text)

    todo = [iter(node.parts)]
    ends = [False]
    while todo:
        for x in todo[-1]:
            if isinstance(x, str):
                piece.append(html.unescape(x) if "&" in x else x)
            elif x.tag == "br":
                piece.append(" ")
            elif marked(x) or not templates.isdisjoint(x.places):
                if x.tag in _BLOCK:
                    close()
            else:
                if x.tag in _BLOCK:
                    close()
                todo.append(iter(x.parts))
                ends.append(x.tag in _BLOCK)
                break
        else:
            todo.pop()
            if ends.pop():
                close()
    close()
    return out


def main_text(source: str, templates: frozenset = frozenset()) -> str:
    root = parse(source)
    if templates:
        fingerprint(root)
    chosen = main_element(root, templates)
    # what an article element holds is its text, however often the site repeats it
    return "\n".join(blocks(chosen, frozenset() if chosen.tag == "article" else templates))


def subtrees(source: str) -> set[int]:
    """Hashes, with the place, of the elements that hold text, but for those that stand for the whole page."""
    root = parse(source)
    fingerprint(root)
    out, todo = set(), [root]
    while todo:
        node = todo.pop()
        below = [x for x in node.parts if isinstance(x, Node) and not marked(x)]
        if node.tag not in _WHOLE and any(isinstance(x, Node) or x.strip() for x in node.parts):
            out.update(node.places)
        todo.extend(below)
    return out


def _subtree_rows(stream) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        hosts, prints, pages = [], [], []
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = subtrees(source or "")
            hosts += [host] * len(found)
            prints += found
            pages += [_hash(source or "")] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(prints, pa.int64()), pa.array(pages, pa.int64())], ["host", "print", "page"])


def _text_rows(stream) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        texts = [main_text(source or "", frozenset(t or ())) for source, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, many_pages: int = MANY_PAGES) -> DataFrame:
    """host, templates array<long>: subtrees on at least ``min_pages`` pages of the host and ``min_share`` of them, or on ``many_pages``.

    pages: host, html. Pages of equal html count once. Rows combine before the shuffle, so a host may hold any
    share of the pages. A host has at most 1 / min_share as many templates as a page has subtrees, or those of its pages / many_pages.
    """
    rows = pages.select("host", "html").mapInArrow(lean(_subtree_rows), "host string, print long, page long").distinct()
    counted = rows.groupBy("host", "print").agg(F.count(F.lit(1)).alias("n"))
    different = pages.select("host", F.xxhash64(F.coalesce("html", F.lit(""))).alias("page")).distinct()
    sizes = different.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= min_pages)
    often = counted.filter(F.col("n") >= min_pages).join(sizes, "host").filter(F.col("n") >= F.least(F.col("pages") * F.lit(min_share), F.lit(many_pages)))
    return often.groupBy("host").agg(F.array_sort(F.collect_list("print")).alias("templates"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """page_id, url, text, n_chars: the article of each page, one row per row.

    Elements that tag or attributes mark (menus, headers, footers, sidebars,
    notices, adverts, forms, scripts, comments of readers) are dropped, and so are
    subtrees that recur with attributes and place across many different pages of the host, whatever their tags; but
    nothing that an article element holds is dropped for recurring.
    Text within a block has single blanks; blocks are joined by a line feed.

    Null or empty html gives an empty text. Pages without a host count as of one host
    named ''. Of repeated pages one counts. Broken markup is repaired, not dropped.
    """
    scratch = Scratch(pages.sparkSession)
    own = pick(pages, page_id=id_col, url=url_col, html=html_col).withColumn("host", host_of(F.col("url")))
    templates = scratch.cut(site_templates(own, min_pages, min_share), "templates")
    joined = own.join(broadcast_if_small(templates, 20_000), "host", "left").select("page_id", "url", "html", "templates")
    return joined.mapInArrow(lean(_text_rows), f"page_id {dict(own.dtypes)['page_id']}, url string, text string, n_chars long")
