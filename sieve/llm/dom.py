"""A forgiving HTML reader: block elements as a tree of nodes, text as segments in page order.

Inline elements make no nodes. Content of scripts, styles and the like is left out. Unclosed and stray tags are
taken as browsers do in simple cases: a block closes an open paragraph, an item closes the item before it, a closing tag
without an opening one is skipped. Quotes count only after an equals sign; one that is never closed is part of its value. A tag or
declaration that the end of the page cuts off is left out. Reading is one pass without recursion, so depth and length don't matter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Elements by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template textarea title iframe svg math object canvas audio video".split())
TO_END = frozenset("script style template textarea title iframe".split())  # unclosed, they hold the rest of the page
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var".split()
)
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
START = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)|(!--)|[!?])")
REST = re.compile(r"((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+)*+)>")
NAMES = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORDS = re.compile(r"[A-Za-z][a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Node:
    tag: str
    parent: int
    attributes: str
    words: int = 0
    link_words: int = 0
    sentences: int = 0
    sign: bool = False
    below: int = 0  # words of the whole subtree

    def names(self) -> set[str]:
        """The words of class, id and role."""
        if "=" not in self.attributes:
            return set()
        return {w.lower() for m in NAMES.finditer(self.attributes) for w in WORDS.findall(m[1] or m[2] or m[3] or "")}


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    segments: list[tuple[int, str]] = field(default_factory=list)  # node, text as written


def read_page(html: str) -> Page:
    """Parents come before children in ``nodes``; node 0 is the page."""
    page = Page([Node("#page", -1, "")])
    nodes, stack = page.nodes, [0]
    open_at: dict[str, list[int]] = {}  # by tag, the depths of its open elements
    unclosed: set[str] = set()  # hidden elements that no closing tag follows
    text: list[str] = []
    in_link = False
    at, n = 0, len(html)

    def put(piece: str) -> None:
        if not piece:
            return
        text.append(piece)
        node = nodes[stack[-1]]
        count = len(piece.split())
        node.words += count
        if in_link:
            node.link_words += count
        node.sentences += piece.count(". ") + piece.count("! ") + piece.count("? ") + piece.rstrip().endswith((".", "!", "?"))
        if "&copy;" in piece or "©" in piece:
            node.sign = True

    def flush() -> None:
        if text:
            page.segments.append((stack[-1], "".join(text)))
            text.clear()

    def pop() -> None:
        open_at[nodes[stack.pop()].tag].pop()

    def deepest(tags: set[str]) -> int:
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)

    while at < n:
        m = START.search(html, at)
        if not m:
            put(html[at:])
            break
        put(html[at : m.start()])
        at = m.end()
        if m[3]:
            end = html.find("-->", at)
            at = n if end < 0 else end + 3
            continue
        if m[2] is None:
            end = html.find(">", at)
            at = n if end < 0 else end + 1
            continue
        rest = REST.match(html, at)
        if not rest:
            break
        attributes, at = rest[1], rest.end()
        closing, tag = m[1] == "/", m[2].lower()
        if tag in VOID:
            if tag == "br":
                text.append("\n")
            elif tag == "hr":
                flush()
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = not closing
            continue
        if tag in HIDDEN:
            if not closing and not attributes.endswith("/") and tag not in unclosed:
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                close = html.find(">", end.end()) if end else -1
                if close >= 0:
                    at = close + 1
                elif tag in TO_END:
                    at = n
                else:
                    unclosed.add(tag)
            continue
        flush()
        in_link = False
        if closing:
            if open_at.get(tag):
                depth = open_at[tag][-1]
                while len(stack) > depth:
                    pop()
            continue
        if nodes[stack[-1]].tag == "p":
            pop()
        if tag in CLOSES:
            closed, within = CLOSES[tag]
            depth = deepest(closed)
            if depth > deepest(within):
                while len(stack) > depth:
                    pop()
        nodes.append(Node(tag, stack[-1], attributes))
        stack.append(len(nodes) - 1)
        open_at.setdefault(tag, []).append(len(stack) - 1)
        if attributes.endswith("/") and tag not in ("p", "div", "li"):
            pop()
    flush()
    for k in range(len(nodes) - 1, 0, -1):
        nodes[k].below += nodes[k].words
        nodes[nodes[k].parent].below += nodes[k].below
    return page
