"""The main content of a page by text density: blocks are told apart by their words and link density and those of their
neighbours (Kohlschuetter, Fankhauser and Nejdl, WSDM 2010), and the smallest element that holds most of the content is taken."""

from __future__ import annotations

from dataclasses import dataclass

from .dom import Node

#: Elements whose text is a block of its own, and those that hold none.
BLOCKS = frozenset("address article aside blockquote body dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header li main nav ol p pre section table td th tr ul".split())
SILENT = frozenset("script style noscript svg head option select textarea button".split())
#: The share of the content's words that the main element holds.
MOST = 0.8


@dataclass
class Block:
    node: Node
    words: int = 0
    linked: int = 0

    @property
    def link_density(self) -> float:
        return self.linked / self.words if self.words else 0.0


def blocks(root: Node) -> list[Block]:
    """The page's texts in order, each with the block element it stands in."""
    out: list[Block] = []
    todo: list[tuple[Node, Node, bool]] = [(root, root, False)]
    while todo:
        node, block, linked = todo.pop()
        if node.tag == "#text":
            n = len(node.data.split())
            if n:
                if not out or out[-1].node is not block:
                    out.append(Block(block))
                out[-1].words += n
                out[-1].linked += n * linked
        elif node.tag not in SILENT and node.tag != "#comment":
            inner, link = (node if node.tag in BLOCKS else block), linked or node.tag == "a"
            todo.extend((c, inner, link) for c in reversed(node.children))
    return out


def is_content(before: Block | None, block: Block, after: Block | None) -> bool:
    """The published decision tree over words and link density."""
    prev_words, prev_links = (before.words, before.link_density) if before else (0, 0.0)
    next_words = after.words if after else 0
    if block.link_density > 1 / 3:
        return False
    if prev_links <= 5 / 9:
        return block.words > 16 or next_words > 15 or prev_words > 4
    return block.words > 40 or next_words > 17


def main_of(root: Node) -> Node | None:
    """The smallest element with MOST of the words of all content blocks; None without any."""
    found = blocks(root)
    content = [b for a, b, c in zip([None, *found], found, [*found[1:], None], strict=False) if is_content(a, b, c)]
    total = sum(b.words for b in content)
    if not total:
        return None
    held: dict[int, int] = {}
    for b in content:
        up: Node | None = b.node
        while up is not None:
            held[id(up)] = held.get(id(up), 0) + b.words
            up = up.parent
    node = root
    while (inner := next((c for c in node.children if held.get(id(c), 0) >= MOST * total), None)) is not None:
        node = inner
    return node
