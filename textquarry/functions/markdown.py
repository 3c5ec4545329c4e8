"""A page tree as markdown, with the place of every heading.

Blocks are parted by one blank line and list items by a line end; lists nest by indentation and
ordered ones are numbered; inline marks are ``**``, ``_``, `` ` `` and links with their target.
"""

from __future__ import annotations

import re

from textquarry.functions.page_tree import HEADINGS, Node, removed

# Limits beyond which a table is only named, and rows of an infobox.
TABLE_ROWS, TABLE_CHARS, INFOBOX_ROWS = 8, 600, 30

_SPACES = re.compile(r"[ \t\r\n\f]+")
#: What would begin a list or number at the start of a line.
_STARTS = re.compile(r"^(\d+)\.(?=\s)|^([+-])(?=\s|-)")
MARKS = {"b": "**", "strong": "**", "i": "_", "em": "_", "u": "_", "code": "`", "tt": "`", "kbd": "`", "samp": "`"}


class Markdown:
    """Writes a tree; ``headings`` holds (node, where its line starts) in order."""

    def __init__(self, gone: set[int] = frozenset()):
        self.gone = gone
        self.parts: list[str] = []
        self.size = 0
        self.lines, self.blank = 0, ""  # line ends that are due before the next text, and how blank lines begin
        self.prefix: list[list[str]] = []  # of a line's first use, and of later lines
        self.depth = 0
        self.headings: list[tuple[Node, int]] = []
        self.anchors: list[tuple[str, int]] = []
        self.tables = 0
        self.infobox: list[tuple[str, str]] = []

    def text(self) -> str:
        return "".join(self.parts)

    def _put(self, s: str) -> None:
        self.parts.append(s)
        self.size += len(s)

    def due(self, n: int) -> None:
        """Line ends before the next text; blank lines between blocks are marked as what both stand in."""
        own = "".join(p[1] for p in self.prefix)
        self.blank = min(own, self.blank, key=len) if self.lines else own
        self.lines = max(self.lines, n)

    def line(self, s: str, lead: str = "") -> int:
        """Writes text behind the line ends that are due; the place where it starts."""
        if self.lines or not self.size:
            if self.size:
                self._put(("\n" + self.blank.rstrip()) * (self.lines - 1) + "\n")
            self._put("".join(p[0] for p in self.prefix))
            for p in self.prefix:
                p[0] = p[1]
        self.lines = 0
        at = self.size
        self._put(lead + s)
        return at

    def run(self, s: str) -> None:
        """Writes inline text: white space squeezed, none at the start of a line."""
        for i, part in enumerate(_SPACES.sub(" ", s).split("\v")):
            if i:  # a break within a paragraph
                self.finish()
                if not self.lines and self.size:
                    self._put("  ")
                self.due(1)
            fresh = self.lines or not self.size
            if fresh or self.parts[-1].endswith(" "):
                part = part.lstrip(" ")
            if part == " ":
                self._put(" ")
            elif part:
                self.line(_STARTS.sub(lambda m: f"{m[1]}\\." if m[1] else f"\\{m[2]}", part) if fresh else part)

    def finish(self) -> None:
        """Drops a single space at the end of a line."""
        if self.parts and self.parts[-1].endswith(" ") and not self.parts[-1].endswith("  ") and not self.lines:
            last = self.parts.pop()[:-1]
            self.size -= 1
            if last:
                self.parts.append(last)

    # Inline.

    def inline(self, node: Node) -> str:
        """The text of an element without blocks in it."""
        if node.hidden:
            return ""
        if node.tag == "br":
            return "\v"
        if node.tag == "a" and node.attrs.get("href") is None and (node.attrs.get("id") or node.attrs.get("name")):
            self.anchors.append((node.attrs.get("id") or node.attrs["name"], len(self.headings)))
        inner = "".join(c if isinstance(c, str) else self.inline(c) for i, c in enumerate(node.children) if not removed(node, i, self.gone))
        mark = MARKS.get(node.tag)
        own = inner.strip(" \t\r\n\f\v")
        if not own:
            return inner
        if mark:
            own = f"{mark}{own}{mark}"
        elif node.tag == "a" and node.attrs.get("href"):
            href = re.sub(r"([()])", r"\\\1", node.attrs["href"].strip())
            title = _SPACES.sub(" ", node.attrs.get("title", "")).replace('"', '\\"').strip()
            own = f'[{_SPACES.sub(" ", own)}]({href} "{title}")' if title else f"[{_SPACES.sub(' ', own)}]({href})"
        else:
            return inner
        lead, tail = inner[: len(inner) - len(inner.lstrip())], inner[len(inner.rstrip()) :]
        return lead + own + tail

    # Blocks.

    def children(self, node: Node) -> None:
        kept = ""
        for i, c in enumerate(node.children):
            if removed(node, i, self.gone):
                continue
            if isinstance(c, str):
                kept += c
            elif not c.block:
                kept += self.inline(c)
            elif not c.hidden:
                self.run(kept)
                kept = ""
                self.block(c)
        self.run(kept)

    def block(self, node: Node) -> None:
        if node.hidden or node.tag == "title":
            return
        self.finish()
        tag = node.tag
        if tag in HEADINGS:
            self.heading(node)
        elif tag in ("ul", "ol"):
            self.items(node)
        elif tag == "table":
            self.table(node)
        elif tag == "pre":
            self.due(2)
            for row in node.text().strip("\n").split("\n"):
                self.line("    " + row)
                self.due(1)
            self.due(2)
        elif tag == "blockquote":
            self.due(2)
            self.prefix.append(["> ", "> "])
            self.children(node)
            self.finish()
            self.prefix.pop()
            self.due(2)
        elif tag == "hr":
            self.due(2)
            self.line("* * *")
            self.due(2)
        elif tag == "dd":
            self.due(1)
            self.prefix.append(["    ", "    "])
            self.children(node)
            self.finish()
            self.prefix.pop()
            self.due(1)
        else:
            gap = 2 if tag in ("p", "dl") else 1 if tag in ("dt", "li", "tr") else 2 if tag in ("div", "section", "article", "main", "address", "form", "fieldset", "center", "details", "summary", "figure") else 0
            self.due(gap)
            self.children(node)
            self.finish()
            self.due(gap)

    def heading(self, node: Node) -> None:
        text = " ".join(self.inline_of(node).replace("\v", " ").split())
        self.due(2)
        if text:
            at = self.line(text, "#" * int(node.tag[1]) + " ")
            self.headings.append((node, at))
        self.due(2)

    def inline_of(self, node: Node) -> str:
        """Inline text of a heading or cell, blocks in it as their words."""
        out = ""
        for i, c in enumerate(node.children):
            if removed(node, i, self.gone):
                continue
            if isinstance(c, str):
                out += c
            elif not c.block:
                out += self.inline(c)
            elif not c.hidden:
                out += " " + self.inline_of(c) + " "
        return out

    def items(self, node: Node) -> None:
        gap = 1 if self.depth else 2
        self.due(gap)
        try:
            n = int(node.attrs.get("start", "1"))
        except ValueError:
            n = 1
        self.depth += 1
        for c in node.children:
            if not isinstance(c, Node) or c.hidden or id(c) in self.gone:
                continue
            if c.tag != "li":
                self.block(c) if c.block else self.run(self.inline(c))
                continue
            self.due(1)
            mark = f"{n}. " if node.tag == "ol" else "* "
            n += 1
            self.prefix.append(["  " + mark, "  " * (1 + (node.tag == "ol"))])
            self.children(_first_inline(c))
            self.finish()
            self.prefix.pop()
            self.due(1)
        self.depth -= 1
        self.due(gap)

    def table(self, node: Node) -> None:
        outer = [r for r in node.nodes() if r.tag == "tr" and _owner(r) is node]
        rows = [[" ".join(self.inline_of(c).replace("\v", " ").split()) for c in r.children if isinstance(c, Node) and c.tag in ("td", "th") and not c.hidden] for r in outer]
        rows = [r for r in rows if r]
        if "infobox" in node.attrs.get("class", ""):
            area = ""
            for r in rows:
                if len(r) == 1:
                    area = r[0]
                elif len(self.infobox) < INFOBOX_ROWS:
                    self.infobox.append((f"{area} — {r[0]}" if area else r[0], " ".join(r[1:])))
            return
        self.tables += 1
        self.due(2)
        if len(rows) > TABLE_ROWS or sum(len(c) for r in rows for c in r) > TABLE_CHARS:
            self.line(f"[Table {self.tables}: {len(rows)} rows x {max(map(len, rows), default=0)} cols - pass compact=False to expand]")
        else:
            for i, r in enumerate(rows):
                self.line(" | ".join(r))
                self.due(1)
                if i == 0 and len(rows) > 1:
                    self.line("|".join(["---"] * len(r)))
                    self.due(1)
        self.due(2)


def _owner(node: Node) -> Node | None:
    while node is not None and node.tag != "table":
        node = node.parent
    return node


def _first_inline(item: Node) -> Node:
    """A list item whose first paragraph is its own text."""
    first = next((c for c in item.children if isinstance(c, Node) or c.strip()), None)
    if isinstance(first, Node) and first.tag == "p":
        out = Node("li", item.attrs, item.parent)
        at = item.children.index(first)
        out.children = [*first.children, *item.children[at + 1 :]]
        return out
    return item
