"""Main text of web pages: paragraphs give points to the elements around them; the best container and the text beside it are kept."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A comment, another declaration, or a tag; quotes count only after `=`. Every part runs on to the end at most once.
TOKEN = re.compile(
    r"""<!--(?:-?>|(?s:.*?)(?:--!?>|\Z))|<(?:[!?]|/(?![a-zA-Z]))[^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?+|["'])*+)(?:>|\Z)"""
)
ATTRIBUTE = re.compile(r"""([^\s/>"'=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*))?)?""")
#: Elements whose content is text up to their own end tag.
RAW = {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead tr ul".split()
)
CELLS = frozenset(("td", "th"))
#: Start tags that end an open element of these names, unless a container of the second list lies between.
IMPLIED = {n: (frozenset(("p",)), frozenset(("button", "td", "th", "caption", "table", "object"))) for n in BLOCKS - {"tr", "tbody", "thead", "tfoot", "option", "caption"}}
for _names, _ends, _stop in (
    (("li",), ("li", "p"), ("ul", "ol", "menu", "dir")), (("dt", "dd"), ("dt", "dd", "p"), ("dl",)), (("tr",), ("tr", "td", "th", "p"), ("table",)),
    (("td", "th"), ("td", "th", "p"), ("tr", "table")), (("tbody", "thead", "tfoot"), ("tbody", "thead", "tfoot", "tr", "td", "th", "p"), ("table",)), (("option",), ("option",), ("select",)),
):
    IMPLIED |= {n: (frozenset(_ends), frozenset(_stop)) for n in _names}
#: Elements that never hold main text, and roles and name parts that tell the same of others.
ASIDE = frozenset(
    "script style noscript template nav footer aside button select option textarea input label fieldset svg canvas iframe object applet audio video dialog menu "
    "head title xmp noembed noframes map datalist meter progress annotation annotation-xml".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form status tablist".split())
REMARKS = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
PARTS = REMARKS | frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot dfp sponsor sponsored sponsors promo promos promotion promotions banner banners nav navbar navigation menu menus "
    "submenu breadcrumb breadcrumbs sidebar sidebars footer masthead topbar cookie cookies consent gdpr notice notices notification notifications alert alerts newsletter subscribe subscription signup "
    "popup modal overlay lightbox share sharing social related recommended recommendations pagination pager widget widgets toolbar login skip copyright form search searchbox hidden".split()
)
#: Names of page frames; after the words of NOT a name part tells what the element is not.
FRAMES = frozenset(("html", "body", "main", "article"))
NOT = frozenset(("with", "has", "no", "without", "not"))
OF_TEXT = frozenset("article post entry content story page title headline".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | frozenset("p blockquote pre ul ol dl table figure".split())
LISTS = frozenset(("ul", "ol", "dl", "table", "div", "section", "p"))
#: A block's points: one, one for each comma, one for each so many characters up to the most. An ancestor gets this share of what its child got.
CHARACTERS, MOST, SHARE = 100, 3.0, 0.5
#: Points of an element that is made for main text.
FOR_TEXT = {"article": 25.0, "main": 15.0}
#: Points with which text outside of a marked article stays though it is no prose.
ENOUGH = 10.0
#: Lists of this many links go where links hold this share of their characters; within an article they have to hold the second share.
LINKS, LINKED, MENU = 3, 0.5, 0.8
COMMAS = re.compile("[,،、，﹐]")


class Element:
    """An element with its children, elements and texts in their order."""

    __slots__ = ("anchors", "attributes", "children", "links", "name", "parent", "points", "prose", "size", "spread")

    def __init__(self, name: str, parent: Element | None, attributes: str):
        self.name, self.parent, self.attributes = name, parent, attributes
        self.children: list[Element | str] = []
        self.size, self.links, self.anchors, self.prose, self.points, self.spread = 0, 0, 0, False, 0.0, 0.0


class Path:
    """The open elements, outermost first. The depths of those that end tags and implied ends look for are kept apart, so that no look-up grows with the depth."""

    def __init__(self) -> None:
        self.open = [Element("#page", None, "")]
        self.at: defaultdict[object, list[int]] = defaultdict(list)

    def push(self, e: Element) -> None:
        self.open.append(e)
        for k in kinds(e.name):
            self.at[k].append(len(self.open) - 1)

    def cut(self, depth: int) -> None:
        """Closes all elements from `depth` on."""
        while len(self.open) > depth:
            for k in kinds(self.open.pop().name):
                self.at[k].pop()

    def last(self, kind: object) -> int:
        return at[-1] if (at := self.at.get(kind)) else 0

    def close(self, name: str) -> None:
        """Closes the element that an end tag ends; none where there is none, or where a block or cell lies between that the tag may not leave."""
        depth, bar = self.last(name), 0
        if name not in BLOCKS and name not in CELLS and name != "a":
            bar = self.last("block")
        if name not in LEAVES_CELLS:
            bar = max(bar, self.last("cell"))
        if depth and depth >= bar:
            self.cut(depth)

    def imply(self, name: str) -> None:
        """Closes the open elements that a start tag ends."""
        ends, stop = IMPLIED[name]
        hits = self.at.get(("ends", ends, stop))
        if hits and (k := bisect_right(hits, self.last(("stop", ends, stop)))) < len(hits):
            self.cut(hits[k])


#: End tags that also close open cells and tables within their element.
LEAVES_CELLS = frozenset("table tr td th tbody thead tfoot body html main article".split())
_KINDS: dict[str, tuple] = {}


def kinds(name: str) -> tuple:
    """What an open element of this name is looked for as; other names only as themselves."""
    if name not in BLOCKS and name not in CELLS and name not in ("button", "object", "select"):
        return (name,)
    if name not in _KINDS:
        block = name in BLOCKS or name in CELLS
        found: list[object] = [name] + ["block"] * block + ["cell"] * (name in ("table", "td", "th"))
        for ends, stop in sorted(set(IMPLIED.values()), key=repr):
            if name in stop or block and name not in ends:
                found.append(("stop", ends, stop))
            elif name in ends:
                found.append(("ends", ends, stop))
        _KINDS[name] = tuple(found)
    return _KINDS[name]


def tree(html: str) -> Element:
    """The elements of a page as browsers nest them, as far as main text needs it; what is not closed ends with its parent."""
    path = Path()
    pos, n = 0, len(html)
    while pos < n:
        m = TOKEN.search(html, pos)
        stop = m.start() if m else n
        if stop > pos:
            path.open[-1].children.append(unescape(html[pos:stop]) if "&" in html[pos:stop] else html[pos:stop])
        if not m:
            break
        pos = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            path.close(name)
            continue
        if name in IMPLIED:
            path.imply(name)
        made = Element(name, path.open[-1], m[3])
        path.open[-1].children.append(made)
        if name in RAW:
            end = RAW[name].search(html, pos)
            text, pos = html[pos : end.start() if end else n], end.start() if end else n
            made.children.append(text)
        elif name not in VOID and not (m[3].endswith("/") and name in ("svg", "path", "use")):
            path.push(made)
    return path.open[0]


def parts_of(value: str) -> list[str]:
    """Lower-case words of a class or id: `adSlot`, `ad-slot` and `ad_slot` have the same."""
    return [x for x in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()) if x]


def attributes_of(e: Element) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(e.attributes)}


def rejected(e: Element, in_article: bool) -> bool:
    """Whether an element holds no main text by its kind, role or visibility."""
    if e.name in ASIDE:
        return True
    if e.name == "header":
        return not in_article
    if e.name in ("html", "body") or not e.attributes.strip():
        return False
    found = attributes_of(e)
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        return True
    return found.get("role", "").lower() in ROLES


def misnamed(e: Element, in_article: bool) -> bool:
    """Whether an element holds no main text by a word of its class or id. The id of a heading is made of its text and tells nothing."""
    if e.name in ("html", "body", "main") or not e.attributes.strip():
        return False
    found = attributes_of(e)
    for value in (found.get("class", ""), found.get("id", "") if e.name not in HEADINGS else ""):
        for word in value.split():
            words = parts_of(word)
            for before, part in zip([""] + words, words, strict=False):
                if before in NOT:
                    continue
                if part in (REMARKS if e.name == "article" else PARTS):
                    return True
                if part == "header" and not in_article and not OF_TEXT & set(words) and e.name != "article":
                    return True
    return False


def remarks(e: Element) -> bool:
    found = attributes_of(e) if e.attributes.strip() else {}
    return not REMARKS.isdisjoint(parts_of(found.get("class", "") + " " + found.get("id", "")))


def without(root: Element, gone: set[int]) -> list[Element]:
    """The elements without those of `gone`, measured, each after its parent."""
    if gone:
        for e in walk(root):
            e.children = [c for c in e.children if isinstance(c, str) or id(c) not in gone]
    out = list(walk(root))
    measure(out)
    return out


def pruned(root: Element) -> list[Element]:
    """Takes out what holds no main text; the elements that are left, each after its parent.

    What holds a `main`, or an article or first heading with most of the page's text, is a frame and stays whatever it is
    called, unless it is called reader comments; so does a form around an article or most paragraphs.
    """

    def inner() -> Iterator[tuple[Element, bool]]:
        todo = [(root, False)]
        while todo:
            e, inside = todo.pop()
            inside = inside or e.name in ("article", "main")
            for c in e.children:
                if isinstance(c, Element):
                    yield c, inside
                    todo.append((c, inside))

    without(root, {id(e) for e, inside in inner() if rejected(e, inside)})
    commented: set[int] = set()
    elements = list(walk(root))
    for e in elements:
        if id(e.parent) in commented or remarks(e):
            commented.add(id(e))
    mains, heads = set(), set()
    for e in reversed(elements):
        if e.parent is not None and id(e.parent) not in commented and e.size:
            own = e.name in ("main", "article", "h1") and not misnamed(e, False)
            if id(e) in mains or own and e.name == "main":
                mains.add(id(e.parent))
            if id(e) in heads or own:
                heads.add(id(e.parent))
    frames = mains | {id(e) for e in elements if id(e) in heads and 2 * e.size > root.size}
    without(root, {id(e) for e, inside in inner() if id(e) not in frames and misnamed(e, inside)})
    out = without(root, {id(e) for e in walk(root) if e.name == "form" and (2 * e.size <= root.size or not e.size)})
    # Lists of links within the text are menus, whatever they are called; a table of which a cell is no link is none within an article.
    linked = set()
    for e, inside in inner():
        if e.name in LISTS and e.name != "p" and e.anchors >= LINKS:
            if (e.links == e.size if e.name == "table" else e.links > MENU * e.size) if inside else e.links > LINKED * e.size:
                linked.add(id(e))
    return without(root, linked) if linked else out


def walk(root: Element) -> Iterator[Element]:
    todo = [root]
    while todo:
        e = todo.pop()
        yield e
        todo += [c for c in reversed(e.children) if isinstance(c, Element)]


#: The attribute that makes an `a` a link; without it, it is a mark in the text.
HREF = re.compile(r"(?:^|[\s/\"'])href\s*=", re.I)


def measure(elements: list[Element]) -> None:
    """Sets each element's characters, those within links, its links, and whether it is or holds prose."""
    for e in reversed(elements):
        inner = [c for c in e.children if isinstance(c, Element)]
        link = e.name == "a" and HREF.search(e.attributes) is not None
        e.size = sum(len(c.strip()) for c in e.children if isinstance(c, str)) + sum(c.size for c in inner)
        e.links = e.size if link else sum(c.links for c in inner)
        e.anchors = link + sum(c.anchors for c in inner)
        e.prose = e.size > 0 and (e.name in PROSE or any(c.prose for c in inner))


def score(elements: list[Element]) -> None:
    """Points: a block's own text gives its element's parent (or itself, where it is a container) points, and each ancestor a share of them."""
    for e in elements:
        e.points, e.spread = FOR_TEXT.get(e.name, 0.0), 0.0
    for e in reversed(elements):
        if e.parent is None:
            continue
        own = [c for c in e.children if isinstance(c, str) and c.strip()]
        inline = [c for c in e.children if isinstance(c, Element) and c.name not in BLOCKS and c.name not in CELLS]
        if e.name in BLOCKS and (own or any(c.size for c in inline)):
            size = sum(len(c.strip()) for c in own) + sum(c.size for c in inline)
            links = sum(c.links for c in inline)
            commas = sum(len(COMMAS.findall(c)) for c in own)
            given = (1.0 + commas + min(size / CHARACTERS, MOST)) * (1.0 - links / max(size, 1))
            if e.name in PROSE or e.name in ("li", "dd", "dt"):
                e.parent.points += given
                e.parent.spread += given
            else:
                e.points += given
                e.spread += given
        if e.parent.parent is not None:
            e.parent.points += SHARE * e.spread
            e.parent.spread += SHARE * e.spread


def density(e: Element) -> float:
    return e.links / e.size if e.size else 0.0


def chosen(root: Element, elements: list[Element]) -> Element:
    """The page with the best container, the articles and the text beside them, which is all but what is mostly links.

    Where a page marks its article, loose text outside of it is none: only prose and what has many points stays there.
    """
    some = [e for e in elements if e.name in BLOCKS and e.name not in PROSE and e.size]
    if not some:
        return root
    marked = [e for e in elements if e.name in FOR_TEXT and e.size]
    cores = [max(some, key=lambda e: e.points * (1.0 - density(e))), *marked]
    whole, around = {id(e) for e in cores if e.name not in ("html", "body")}, {id(root)}
    for e in cores:
        while e is not None and id(e) not in around:
            around.add(id(e))
            e = e.parent
    todo = [root]
    while todo:
        e = todo.pop()
        if id(e) in whole:
            continue

        def stays(c: Element | str) -> bool:
            if isinstance(c, str):
                return not marked
            if id(c) in around:
                return True
            return density(c) < LINKED and (not marked or c.prose or c.points * (1.0 - density(c)) >= ENOUGH)

        e.children = [c for c in e.children if stays(c)]
        todo += [c for c in e.children if isinstance(c, Element) and id(c) in around]
    return root


def blocks(root: Element) -> list[str]:
    """The texts of the blocks, white space as one space; cells of a row and line breaks are divided by white space."""
    lines, held = [], []

    def end() -> None:
        line = " ".join("".join(held).split())
        held.clear()
        if line:
            lines.append(line)

    todo: list[Element | str | None] = [root]
    while todo:
        x = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            held.append(x)
        else:
            block = x.name in BLOCKS
            if block:
                end()
                todo.append(None)
            elif x.name in CELLS or x.name == "br":
                held.append(" ")
            todo += reversed(x.children)
    end()
    return lines


def main_text(html: str | None) -> str:
    if not html:
        return ""
    root = tree(html)
    elements = pruned(root)
    score(elements)
    return "\n".join(blocks(chosen(root, elements)))


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """`pages` with the column `html` replaced by `text` and `n_chars` (code points), every whole page being read.

    Main text is the article with its headings: no menus, headers, footers, sidebars, notices, adverts, forms, scripts,
    styles or readers' comments. All other text of the page stays, whatever its points, but for loose text outside of a
    marked article. Blocks are joined by a newline, white space within one is a single space, and a line
    break is white space. Null, empty and textless pages have an empty text; a page without tags is one block of text;
    unclosed, wrongly nested and cut tags are taken as browsers take them; repeated rows are read each; no rows give
    none; columns called `text` or `n_chars` are replaced. A page is read whole within one task; pages need no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [main_text(h).encode("utf-8", "replace").decode() for h in b.column("__html").to_pylist()]
            keep = [n for n in b.schema.names if n != "__html"]
            yield pa.RecordBatch.from_arrays([b.column(n) for n in keep] + [pa.array(made, pa.string())], names=[*keep, "text"])

    kept = [c for c in pages.columns if c != html and c.lower() not in ("text", "n_chars")]
    schema = ", ".join([f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept] + ["text string"])
    made = pages.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{html}`").cast("string").alias("__html")).mapInArrow(run, schema)
    return made.withColumn("n_chars", F.length("text").cast("long"))
