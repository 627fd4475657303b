"""A page as a tree of elements, and selectors on it: tag, ``.class``, ``#id``, compounds of these, and descendants.

All selectors of a list are compiled once: by the id, class or tag of their last part, so a walk over a page looks up for each element
only the selectors that can end there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from html.parser import HTMLParser

# Fixed values of HTML: elements without content, elements whose text isn't shown, and what an opening element ends.
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TAGS = frozenset(("script", "style", "template"))
ENDS_PARAGRAPH = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ENDS = {"li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
WITHIN = frozenset("ul ol table dl select body html div section article".split())

_PART = re.compile(r"([.#]?)([\w-]+)")


@dataclass(eq=False)
class Node:
    """An element; children are elements and texts, in order."""

    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    parent: Node | None = None
    children: list[Node | str] = field(default_factory=list)

    @property
    def id(self) -> str:
        return self.attrs.get("id", "")

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def walk(self) -> Iterator[Node]:
        """This element and those below it, in document order, without recursion."""
        left = [self]
        while left:
            node = left.pop()
            yield node
            left += [c for c in reversed(node.children) if isinstance(c, Node)]

    def texts(self) -> Iterator[str]:
        left: list[Node | str] = [self]
        while left:
            node = left.pop()
            if isinstance(node, str):
                yield node
            elif node is self or node.tag not in HIDDEN_TAGS:
                left += reversed(node.children)

    def ancestors(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children.remove(self)
            self.parent = None


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("")

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_PARAGRAPH:
            self._end(("p",), ())
        if tag in ENDS:
            self._end(ENDS[tag], WITHIN)
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID_TAGS:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._end((tag,), ())

    def handle_data(self, data):
        self.at.children.append(data)

    def _end(self, tags: Sequence[str], within: frozenset[str] | tuple) -> None:
        """Goes up to the parent of the nearest open element of these tags, unless one of ``within`` comes first."""
        node = self.at
        while node.parent is not None:
            if node.tag in tags:
                self.at = node.parent
                return
            if node.tag in within:
                return
            node = node.parent


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


@dataclass(frozen=True)
class _Compound:
    tag: str
    ids: frozenset[str]
    classes: frozenset[str]

    def fits(self, node: Node) -> bool:
        return (not self.tag or node.tag == self.tag) and self.ids <= {node.id} and self.classes <= set(node.classes)


def _compound(text: str) -> _Compound:
    parts = _PART.findall(text)
    if "".join(a + b for a, b in parts) != text or not parts:
        raise ValueError(f"not a selector of tag, class and id: {text}")
    of = lambda mark: frozenset(name for m, name in parts if m == mark)
    return _Compound(next((name.lower() for m, name in parts if not m), ""), of("#"), of("."))


class Selectors:
    """A list of selectors; each is a chain of compounds, an element of the last one below one of the one before, and so on."""

    def __init__(self, selectors: Sequence[str]):
        self.chains = [[_compound(c) for c in s.split()] for s in selectors]
        self._by: dict[tuple[str, str], list[int]] = {}
        for i, chain in enumerate(self.chains):
            last = chain[-1]
            name = ("#", min(last.ids)) if last.ids else (".", min(last.classes)) if last.classes else ("", last.tag)
            self._by.setdefault(name, []).append(i)

    def of(self, node: Node) -> list[int]:
        """Numbers of the selectors that the element matches."""
        names = [("", node.tag), *([("#", node.id)] if node.id else []), *((".", c) for c in set(node.classes))]
        return sorted(i for name in names for i in self._by.get(name, ()) if self._matches(self.chains[i], node))

    @staticmethod
    def _matches(chain: list[_Compound], node: Node) -> bool:
        if not chain[-1].fits(node):
            return False
        # the nearest fitting ancestor leaves the most for those further out
        left = len(chain) - 2
        for above in node.ancestors():
            if left < 0:
                break
            left -= chain[left].fits(above)
        return left < 0

    def first(self, tree: Node) -> list[Node | None]:
        """The first element in document order of each selector."""
        out: list[Node | None] = [None] * len(self.chains)
        for node in tree.walk():
            for i in self.of(node):
                out[i] = out[i] or node
        return out

    def remove(self, tree: Node) -> None:
        """Takes all matching elements out of the tree, with what is in them."""
        for node in [n for n in tree.walk() if n.tag and self.of(n)]:
            node.remove()
