"""Flat node list of one HTML page, and the box selectors of the source profiles.

Helper of the Arrow jobs in :mod:`pressline.sources.html_jobs`; it sees one page at a time. Rules for
broken markup: scripts, styles and comments go first, a new ``p`` closes the open one, an end tag
closes everything above its start tag, an end tag without a start tag is ignored, an open comment or
script runs to the end of the page. Reading stays linear in the page on such input.
"""

from __future__ import annotations

import html as _entities
import re
from collections import Counter

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!DOCTYPE[^>]*>|<(script|style)\b.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']++|\"[^\"]*\"|'[^']*')*+)>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Start tags that end an open paragraph.
_BLOCKS = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p "
    "pre section table ul".split()
)


class Page:
    """Nodes in document order; ``last[i]`` is the last descendant of node ``i``."""

    def __init__(self, markup: str):
        self.tag: list[str] = ["#page"]
        self.raw: list[str] = [""]
        self.parent: list[int] = [-1]
        self.last: list[int] = [0]
        self.chunks: list[str] = []
        self.span: list[list[int]] = [[0, 0]]
        self._attrs: dict[int, dict[str, str]] = {}
        self._inside: dict[str, list[bool]] = {}
        self._open: Counter[str] = Counter()
        self._read(markup)

    def _read(self, markup: str) -> None:
        stack = [0]
        at = 0
        for token in _TOKEN.finditer(markup):
            if token.start() > at:
                self.chunks.append(markup[at:token.start()])
            at = token.end()
            name = token.group(3)
            if name is None:
                continue
            name = name.lower()
            if token.group(2):
                self._close(stack, name)
                continue
            if name in _BLOCKS:
                self._close(stack, "p", "button")
            elif name == "li":
                self._close(stack, "li", "ul", "ol")
            index = len(self.tag)
            self.tag.append(name)
            self.raw.append(token.group(4))
            self.parent.append(stack[-1])
            self.last.append(index)
            self.span.append([len(self.chunks), len(self.chunks)])
            if name not in _VOID and not token.group(4).endswith("/"):
                stack.append(index)
                self._open[name] += 1
        if at < len(markup):
            self.chunks.append(markup[at:])
        while stack:
            self._end(stack.pop())

    def _end(self, index: int) -> None:
        self.last[index] = len(self.tag) - 1
        self.span[index][1] = len(self.chunks)
        self._open[self.tag[index]] -= 1

    def _close(self, stack: list[int], name: str, *barriers: str) -> None:
        if not self._open[name]:
            return
        for depth in range(len(stack) - 1, 0, -1):
            if self.tag[stack[depth]] == name:
                while len(stack) > depth:
                    self._end(stack.pop())
                return
            if self.tag[stack[depth]] in barriers:
                return

    def attrs(self, i: int) -> dict[str, str]:
        found = self._attrs.get(i)
        if found is None:
            found = {}
            for name, double, single, bare in _ATTRIBUTE.findall(self.raw[i]):
                found.setdefault(name.lower(), _entities.unescape(double or single or bare))
            self._attrs[i] = found
        return found

    def attr(self, i: int, name: str) -> str:
        return self.attrs(i).get(name, "") if name in self.raw[i].lower() else ""

    def has(self, i: int, name: str) -> bool:
        return name in self.raw[i].lower() and name in self.attrs(i)

    def text(self, i: int) -> str:
        start, end = self.span[i]
        return _entities.unescape("".join(self.chunks[start:end]))

    def nodes(self, *tags: str, below: int = 0) -> list[int]:
        return [i for i in range(below + 1, self.last[below] + 1) if "*" in tags or self.tag[i] in tags]

    def inside(self, i: int, tag: str) -> bool:
        """Whether an element of that name is above the node; known for all nodes after the first question."""
        flags = self._inside.get(tag)
        if flags is None:
            flags = [False] * len(self.tag)
            for node in range(1, len(self.tag)):
                above = self.parent[node]
                flags[node] = above > 0 and (flags[above] or self.tag[above] == tag)
            self._inside[tag] = flags
        return flags[i]

    def class_has(self, i: int, *parts: str) -> bool:
        value = self.attr(i, "class")
        return any(p in value for p in parts)

    # -- box selectors -------------------------------------------------------------------------

    def _fits(self, i: int, box) -> bool:
        if box.tag != "*" and self.tag[i] != box.tag:
            return False
        if box.classes or box.ids or box.id_parts or box.attribute:
            own = self.attr(i, "id")
            named = own in box.ids or any(p in own for p in box.id_parts)
            named = named or bool(box.attribute and self.has(i, box.attribute))
            if not named and not (box.classes and self.class_has(i, *box.classes)):
                return False
            if box.also and not self.class_has(i, *box.also):
                return False
        return not box.inside or self.inside(i, box.inside)

    def boxes(self, box, below: int = 0) -> list[int]:
        found = [i for i in range(below + 1, self.last[below] + 1) if self._fits(i, box)]
        if box.first == "page":
            return found[:1]
        if box.first == "sibling":
            seen: set[int] = set()
            return [i for i in found if not (self.parent[i] in seen or seen.add(self.parent[i]))]
        return found

    def paragraphs_in(self, rung) -> list[int]:
        """Paragraphs below any box of a rung, in document order; a box without rules is the page."""
        found: set[int] = set()
        for box in rung:
            plain = box.tag == "*" and not (box.classes or box.ids or box.id_parts)
            read = 0                                      # boxes nest: each node is looked at once
            for top in [0] if plain else self.boxes(box):
                if self.last[top] <= read:
                    continue
                hits = [i for i in range(max(top, read) + 1, self.last[top] + 1) if self.tag[i] == "p"]
                found.update(i for i in hits if not (box.not_inside and self.inside(i, box.not_inside)))
                read = self.last[top]
        return sorted(found)

    def after_anchor(self, fragment: str, limit: int) -> list[int]:
        """Paragraphs after the element with this id, else those of the next div or section."""
        anchor = next((i for i in range(1, len(self.tag)) if self.attr(i, "id") == fragment), None)
        if anchor is None:
            return []
        later = range(self.last[anchor] + 1, len(self.tag))
        found = [i for i in later if self.tag[i] == "p"][:limit]
        if not found:
            block = next((i for i in later if self.tag[i] in ("div", "section")), None)
            found = self.nodes("p", below=block) if block is not None else []
        return found
