"""HTML pages as small trees, and which of a tree is the article.

The parser is the standard library's; malformed markup never fails: an end tag closes what is
open inside its element, one without a partner is passed over, and items, cells, rows and
paragraphs end where the next one begins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

# Elements without content, elements and classes that are no text, and elements that begin a block.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SKIPPED = frozenset("script style nav header footer aside noscript template figure figcaption".split())
NOISE = frozenset("reflist mw-editsection thumb thumbcaption gallery hatnote sidebar navbox reference cite_ref mw-collapsible-toggle geo-default geo-dms geo-dec geo-nondefault geo-multi-punct".split())
BLOCKS = frozenset("html body p div section article main ul ol li table thead tbody tfoot caption tr td th blockquote pre dl dt dd figure h1 h2 h3 h4 h5 h6 hr form fieldset address center details summary".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
# Headings over what is no part of an article.
FURNITURE = frozenset((
    "test your knowledge", "see, play and learn", "find an expert", "patient handouts", "related issues", "related health topics", "related medlineplus health topics",
    "learn more", "review date", "reference desk", "videos and tutorials",
))
FURNITURE_START = "review date "
# The shape of a menu of links into its own page.
MENU_TAGS, MENU_LINKS, MENU_PARAGRAPH, MENU_OTHER = ("nav", "section", "div"), 3, 80, 200

#: What the beginning of an element ends: those of the second set, up to the nearest of the third.
_ENDS = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    **dict.fromkeys("p div section article main ul ol table blockquote pre dl h1 h2 h3 h4 h5 h6 hr".split(), ({"p"}, {"div", "section", "article", "main", "td", "th", "li", "dd", "blockquote", "body"})),
}


class Node:
    """An element with its children, elements and strings."""

    __slots__ = ("tag", "attrs", "children", "parent", "block")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []
        self.block = tag in BLOCKS

    @property
    def classes(self) -> set[str]:
        return set((self.attrs.get("class") or "").split())

    @property
    def hidden(self) -> bool:
        """Whether the element is no text of a page by its kind or class."""
        return self.tag in SKIPPED or self.tag == "title" or self.tag not in VOID and bool(NOISE & self.classes)

    def nodes(self) -> Iterator[Node]:
        """All elements below, in document order."""
        todo = [iter(self.children)]
        while todo:
            for c in todo[-1]:
                if isinstance(c, Node):
                    yield c
                    todo.append(iter(c.children))
                    break
            else:
                todo.pop()

    def strings(self) -> Iterator[str]:
        todo = [iter(self.children)]
        while todo:
            for c in todo[-1]:
                if isinstance(c, str):
                    yield c
                else:
                    todo.append(iter(c.children))
                    break
            else:
                todo.pop()

    def text(self) -> str:
        return "".join(self.strings())

    def size(self) -> int:
        """Characters of text, each string without the white space around it."""
        return sum(len(s.strip()) for s in self.strings())

    def drop(self) -> None:
        self.parent.children.remove(self)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.here = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        ended, within = _ENDS.get(tag, ((), ()))
        node, last = self.here, None
        while ended and node.parent is not None and node.tag not in within:
            last = node if node.tag in ended else last
            node = node.parent
        if last is not None:
            self.here = last.parent
        new = Node(tag, {k: v or "" for k, v in attrs}, self.here)
        self.here.children.append(new)
        if tag not in VOID:
            self.here = new

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        node = self.here
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.here = node.parent

    def handle_data(self, data):
        self.here.children.append(data)


_AMPERSAND = re.compile(r"&(#(?:[0-9]+|[xX][0-9A-Fa-f]+);|[A-Za-z][A-Za-z0-9]*;)?")


def whole_references(html: str) -> str:
    """Markup in which only entities that have a name and end with ``;`` are left as such; any other ``&`` is itself."""
    return _AMPERSAND.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else "&amp;" + (m[1] or ""), html)


def parse(html: str, cut_entities: bool = True) -> Node:
    """The tree of a page; ``block`` of an element tells whether a block stands in it or it is one.

    ``cut_entities`` reads entities without their ``;`` too (``&amp`` is ``&``), as browsers do.
    """
    b = _Builder()
    b.feed(html if cut_entities else whole_references(html))
    b.close()
    for node in reversed(list(b.root.nodes())):
        if node.block:
            node.parent.block = True
    return b.root


def main_content(root: Node) -> tuple[Node, bool]:
    """The one element that is the article, and whether it is a landmark; else the page.

    Landmarks are ``article``, ``main`` and ``role=main``, each only if there is one and it holds text.
    """
    every = list(root.nodes())
    for fits in (lambda n: n.tag == "article", lambda n: n.tag == "main", lambda n: n.attrs.get("role") == "main"):
        found = [n for n in every if fits(n)]
        if len(found) == 1 and found[0].size():
            return found[0], True
    return root, False


def is_menu(node: Node) -> bool:
    """Whether an element is a menu of links into its own page, by its shape."""
    links = [n for n in node.nodes() if n.tag == "a" and n.attrs.get("href")]
    if len(links) < MENU_LINKS or not all(a.attrs["href"].startswith("#") for a in links):
        return False
    linked = sum(a.size() for a in links)
    other = node.size() - linked
    return other <= min(linked, MENU_OTHER) and all(p.size() <= MENU_PARAGRAPH for p in node.nodes() if p.tag == "p")


def is_furniture(heading: str) -> bool:
    """Whether a heading stands over something that is no part of the article."""
    text = " ".join(heading.split()).lower().rstrip(".:;,!?")
    return text in FURNITURE or text.startswith(FURNITURE_START)


def without_furniture(article: Node) -> set[int]:
    """Ids of the children and elements of a landmark that are furniture or menus; none if nothing else holds text."""
    gone: set[int] = set()
    for node in [article, *article.nodes()]:
        level = None
        for i, c in enumerate(node.children):
            own = int(c.tag[1]) if isinstance(c, Node) and c.tag in HEADINGS else None
            if own is not None and (level is None or own <= level):
                level = own if is_furniture(c.text()) else None
            if level is not None:
                gone.add(id(c) if isinstance(c, Node) else hash((id(node), i)))
    gone |= {id(n) for n in article.nodes() if n.tag in MENU_TAGS and is_menu(n)}
    return gone if _shown(article, gone) else set()


def removed(node: Node, i: int, gone: set[int]) -> bool:
    """Whether the i-th child of an element is among what is left out."""
    c = node.children[i]
    return (id(c) if isinstance(c, Node) else hash((id(node), i))) in gone


def _shown(node: Node, gone: set[int]) -> bool:
    todo = [node]
    while todo:
        n = todo.pop()
        for i, c in enumerate(n.children):
            if removed(n, i, gone):
                continue
            if isinstance(c, str):
                if c.strip():
                    return True
            else:
                todo.append(c)
    return False
