"""One page's element tree, its subtree hashes, and the text of its article."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import xxhash

#: Elements of HTML by their kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
#: What is hashed and counted: blocks, and the cells of a table.
HASHED = BLOCK | {"td", "th"}
NEVER = frozenset("head title script style noscript template nav footer aside form button select option textarea iframe svg canvas object video audio menu dialog".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table tbody thead tr td th figure figcaption".split())
#: A start tag of the key closes an open element of the value.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody")}
SCOPE = frozenset("article aside body div footer form header html main nav section table td th ul ol dl blockquote".split())
#: Whole names (a class, id or role) of parts whose text may differ on
#: every page, so that no subtree of theirs recurs. A name counts only if its slot
#: itself recurs on the host, or the host has too few pages to tell.
SLOTS = frozenset(
    "ad ads advert adverts advertisement sponsored promo banner popup modal cookie-banner cookie-notice cookie-consent notice notification newsletter "
    "sidebar menu navbar navigation breadcrumb breadcrumbs pagination comments comment-list comment-section commentlist disqus_thread respond "
    "share social-share share-buttons related-posts related-articles complementary contentinfo search".split()
)
_TAG_BEGINS = re.compile(r"<[A-Za-z/!?]")
#: Key, among the hashes of a page, that every page has.
EVERY_PAGE = 0


class Element:
    __slots__ = ("tag", "names", "children", "hidden")

    def __init__(self, tag: str, attributes: list[tuple[str, str | None]]):
        self.tag = tag
        self.children: list[Element | str] = []
        self.names, self.hidden = (), False
        for name, value in attributes:
            if name in ("class", "id", "role"):
                self.names += tuple((value or "").lower().split())
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in (value or "").replace(" ", "").lower():
                self.hidden = True


class _Tree(HTMLParser):
    """Builds the tree. The places of open elements are kept by tag, so that no tag,
    however badly nested, makes it search the stack."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("html", [])
        self.stack = [self.root]
        self.open: dict[str, list[int]] = {"html": [0]}
        self.scopes: list[int] = []

    def _push(self, element: Element) -> None:
        self.open.setdefault(element.tag, []).append(len(self.stack))
        if element.tag in SCOPE:
            self.scopes.append(len(self.stack))
        self.stack.append(element)

    def _cut(self, at: int) -> None:
        for element in self.stack[at:]:
            self.open[element.tag].pop()
        del self.stack[at:]
        while self.scopes and self.scopes[-1] >= at:
            self.scopes.pop()

    def _last(self, tag: str) -> int:
        places = self.open.get(tag)
        return places[-1] if places else 0

    def _close(self, tags: tuple[str, ...]) -> None:
        """Close the innermost open element of these tags within its scope."""
        at = max(map(self._last, tags))
        if at and at >= (self.scopes[-1] if self.scopes else 0):
            self._cut(at)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "body") and tag in (e.tag for e in self.stack[:2]):
            return
        if tag in BLOCK:
            self._close(("p",))
        if tag in CLOSES:
            self._close(CLOSES[tag])
        if tag == "body":
            self._cut(1)
        element = Element(tag, attrs)
        self.stack[-1].children.append(element)
        if tag not in VOID:
            self._push(element)

    def handle_endtag(self, tag: str) -> None:
        if at := self._last(tag):
            self._cut(at)

    def handle_data(self, data: str) -> None:
        self.stack[-1].children.append(data)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Marked sections (<![...]>) are comments in HTML."""
        return self.parse_bogus_comment(i)


def parse(html: str) -> Element:
    """The tree of a page.

    After the last `>` no tag is complete: text up to the first that begins is kept
    and the unfinished tag is not, as browsers do it. (The parser would look for the
    end of each such tag again and again.)
    """
    tree = _Tree()
    done = html.rfind(">") + 1
    tree.feed(html[:done])
    tree.feed(_TAG_BEGINS.split(html[done:], maxsplit=1)[0])
    tree.close()
    return tree.root


def subtree_hashes(root: Element) -> dict[int, int]:
    """Hash of each element (by id) from tag, names, text and children."""
    out: dict[int, int] = {}
    todo: list[tuple[Element, bool]] = [(root, False)]
    while todo:
        e, ready = todo.pop()
        if not ready:
            todo.append((e, True))
            todo += [(c, False) for c in e.children if isinstance(c, Element)]
            continue
        parts = [e.tag, *e.names, *(f"#{out[id(c)]}" if isinstance(c, Element) else " ".join(c.split()) for c in e.children)]
        out[id(e)] = xxhash.xxh64_intdigest("\x1f".join(parts).encode("utf-8", "replace")) - (1 << 63)
    return out


def _elements(root: Element) -> Iterator[Element]:
    todo = [root]
    while todo:
        e = todo.pop()
        yield e
        todo += [c for c in reversed(e.children) if isinstance(c, Element)]


def slot(e: Element) -> int | None:
    """Hash of an element's tag and names, if one of them is in SLOTS."""
    if e.tag in ("body", "html") or not SLOTS.intersection(e.names):
        return None
    return xxhash.xxh64_intdigest("\x1e".join((e.tag, *e.names)).encode("utf-8", "replace")) - (1 << 63)


def countable(root: Element) -> set[int]:
    """What is counted of a page: the distinct hashes of its block elements and
    cells, those of its slots, and EVERY_PAGE."""
    hashes = subtree_hashes(root)
    found = {hashes[id(e)] for e in _elements(root) if e.tag in HASHED and e.tag != "html"}
    return found | {s for e in _elements(root) if (s := slot(e)) is not None} | {EVERY_PAGE}


class _Page:
    """What is unwanted on a page, by its tags and by what recurs on its host."""

    def __init__(self, pages_with: dict[int, int]):
        self.pages_with = pages_with
        self.small_host = pages_with.get(EVERY_PAGE, 0) == 0

    def unwanted(self, e: Element, inside: bool) -> bool:
        if e.tag in NEVER or e.hidden or e.tag == "header" and not inside:
            return True
        found = slot(e)
        return found is not None and (self.small_host or self.pages_with.get(found, 0) > 0)


def _gather(root: Element, page: _Page, drop: set[int], inside: bool) -> list[str]:
    """Blocks of text, without unwanted elements and those in `drop` (ids)."""
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join("".join(line).split())
        if text:
            blocks.append(text)
        line.clear()

    todo: list[Element | str | None] = [root]
    while todo:
        e = todo.pop()
        if e is None:
            flush()
        elif isinstance(e, str):
            line.append(e)
        elif e.tag == "br":
            line.append(" ")
            todo += [" ", *reversed(e.children)]
        elif e is root or not (page.unwanted(e, inside) or id(e) in drop):
            if e.tag in ("td", "th"):
                line.append(" ")
                todo.append(" ")
            elif e.tag in BLOCK:
                flush()
                todo.append(None)
            todo += reversed(e.children)
    flush()
    return blocks


def article_text(root: Element, pages_with: dict[int, int]) -> str:
    """The article's blocks, one a line.

    `pages_with` has the pages of the host that share a subtree, for those that
    are templates. The article is the longest outermost <article>, else <main>,
    else the body. Its own paragraphs and lists are never taken for a template,
    nor is anything that occurs on no more than twice the pages that the article
    itself does (a host may publish copies of one article).
    """
    hashes, page = subtree_hashes(root), _Page(pages_with)
    outer, todo = [], [root]
    while todo:
        e = todo.pop()
        if e is not root and page.unwanted(e, False):
            continue
        if e.tag in ("article", "main") or "main" in e.names and e.tag != "body":
            outer.append(e)
            if e.tag == "article":
                continue
        todo += [c for c in reversed(e.children) if isinstance(c, Element)]
    best: tuple[int, list[str]] = (-1, [])
    for kind in ("article", "main"):
        for e in (e for e in outer if (e.tag == "article") == (kind == "article")):
            own = pages_with.get(hashes[id(e)], 1)
            drop = {id(x) for x in _elements(e) if x.tag not in TEXTUAL and x.tag in BLOCK and pages_with.get(hashes[id(x)], 0) > 2 * own}
            blocks = _gather(e, page, drop, True)
            if (size := sum(map(len, blocks))) > best[0]:
                best = (size, blocks)
        if best[0] > 0:
            return "\n".join(best[1])
    body = next((e for e in root.children if isinstance(e, Element) and e.tag == "body"), root)
    own = pages_with.get(hashes[id(body)], 1)
    drop = {id(x) for x in _elements(body) if x.tag in HASHED and pages_with.get(hashes[id(x)], 0) > 2 * own}
    return "\n".join(_gather(body, page, drop, False))
