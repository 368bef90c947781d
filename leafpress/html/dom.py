"""A tolerant HTML tree.

Tree building is a simple stack: void elements never stay open, script and style hold raw text, a small table of implied end tags
looks at the top of the stack only, an end tag closes to the nearest open element of its name (or is ignored), and everything
closes at the end of input. This isn't the HTML5 algorithm: an unclosed inline element keeps holding what follows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import escape
from html.entities import html5
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag (key) closes an element of these names if it is the innermost open one.
IMPLIED = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
    "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"tr", "td", "th", "tbody", "tfoot"},
    "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody", "thead"}, "body": {"head"},
} | dict.fromkeys("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split(), {"p"})


class Node:
    """An element, or with the tag "#text", "#comment" or "#document" what the name says."""

    __slots__ = ("attrs", "children", "data", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, data: str = ""):
        self.tag, self.attrs, self.data = tag, attrs or {}, data
        self.children: list[Node] = []
        self.parent: Node | None = None

    def add(self, child: Node) -> Node:
        child.parent = self
        self.children.append(child)
        return child

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    @property
    def is_element(self) -> bool:
        return self.tag[0] != "#"

    def get(self, name: str) -> str:
        return self.attrs.get(name) or ""

    @property
    def classes(self) -> list[str]:
        return self.get("class").split()

    def walk(self) -> Iterator[Node]:
        """This node and all below it, in document order."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(reversed(node.children))

    def elements(self, *tags: str) -> Iterator[Node]:
        return (n for n in self.walk() if n.is_element and (not tags or n.tag in tags))

    def text_content(self) -> str:
        return "".join(n.data for n in self.walk() if n.tag == "#text")

    def copy(self) -> Node:
        twin = Node(self.tag, dict(self.attrs), self.data)
        todo = [(self, twin)]
        while todo:
            old, new = todo.pop()
            for c in old.children:
                todo.append((c, new.add(Node(c.tag, dict(c.attrs), c.data))))
        return twin

    def inner_html(self) -> str:
        return "".join(c.outer_html() for c in self.children)

    def outer_html(self) -> str:
        out: list[str] = []
        todo: list[Node | str] = [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                out.append(node)
            elif node.tag == "#text":
                raw = node.parent is not None and node.parent.tag in ("script", "style")
                out.append(node.data if raw else escape(node.data, quote=False))
            elif node.tag == "#comment":
                out.append(f"<!--{node.data}-->")
            elif node.tag == "#document":
                todo.extend(reversed(node.children))
            else:
                out.append(f"<{node.tag}" + "".join(f' {k}="{escape(v)}"' for k, v in node.attrs.items()) + ">")
                if node.tag not in VOID:
                    todo.append(f"</{node.tag}>")
                    todo.extend(reversed(node.children))
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#document")
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        closes = IMPLIED.get(tag, ())
        while self.open[-1].tag in closes:
            self.open.pop()
        given: dict[str, str] = {}
        for k, v in attrs:
            given.setdefault(k, v or "")
        node = self.open[-1].add(Node(tag, given))
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        # Only foreign elements can close themselves.
        if tag not in VOID and any(n.tag in ("svg", "math") for n in self.open):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        top = self.open[-1]
        if top.children and top.children[-1].tag == "#text":
            top.children[-1].data += data
        else:
            top.add(Node("#text", data=data))

    def handle_comment(self, data: str) -> None:
        self.open[-1].add(Node("#comment", data=data))

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:  # no known name: a comment to the next ">", as in HTML
            return self.parse_bogus_comment(i, report)


#: Numbers that Python doesn't convert; eight digits are beyond all characters too.
_LONG_NUMBER = re.compile(r"&#([0-9]{4000,})")
_REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)?")


def parse(html: str | None, closed_references: bool = False) -> Node:
    """The tree of a page. closed_references: what no semicolon ends is no character reference (HTML decodes some names, such as
    &amp, without one)."""
    html, mark = _LONG_NUMBER.sub(lambda m: f"&#{m[1].lstrip('0')[:8] or '0'}", html or ""), ""
    if closed_references and "&" in html:
        # A character of private use that the page doesn't have stands for the other ampersands meanwhile.
        mark = next(c for c in map(chr, range(0xF0000, 0x110000)) if c not in html)
        html = _REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else mark + (m[1] or ""), html)
    builder = _Builder()
    builder.feed(html)
    builder.close()
    if mark and mark in html:
        for n in builder.root.walk():
            n.tag, n.data, n.attrs = n.tag.replace(mark, "&"), n.data.replace(mark, "&"), {k.replace(mark, "&"): v.replace(mark, "&") for k, v in n.attrs.items()}
    return builder.root


def measure(root: Node) -> tuple[int, int]:
    """Number of elements and greatest depth, without what stands inside svg."""
    count = deepest = 0
    todo = [(root, 0)]
    while todo:
        node, depth = todo.pop()
        if node.is_element:
            count, deepest = count + 1, max(deepest, depth)
            if node.tag == "svg":
                continue
        todo.extend((c, depth + 1) for c in node.children if c.is_element)
    return count, deepest


# Selectors: compounds of tag, *, #id, .class, [attr op value], :not(compound), :first-child, :last-child, :empty, joined by
# white space, ">", "+" or "~"; lists by commas.

_PART = re.compile(r"""\s*([>+~])\s*|(\s+)|(\*|[\w-]+)|\#([\w-]+)|\.([\w-]+)|\[\s*([\w:-]+)\s*(?:([~|^$*]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]+))\s*)?\]|:not\(([^()]*)\)|:(first-child|last-child|empty)""")


class BadSelector(ValueError):
    pass


def compile_selector(selector: str) -> list[list[tuple[str, list]]]:
    """For each part of the list, compounds from right to left as (combinator to its left, tests)."""
    out = []
    for part in _split_list(selector):
        steps: list[tuple[str, list]] = [("", [])]
        at, part = 0, part.strip()
        while at < len(part):
            m = _PART.match(part, at)
            if not m:
                raise BadSelector(selector)
            at = m.end()
            combinator, space, tag, ident, cls, attr, op, v1, v2, v3, negated, pseudo = m.groups()
            if combinator or space:
                steps.append((combinator or " ", []))
                continue
            test = ("tag", tag.lower()) if tag else ("id", ident) if ident else ("class", cls) if cls else ("attr", attr.lower(), op, next((v for v in (v1, v2, v3) if v is not None), "")) if attr else ("not", compile_selector(negated)) if negated is not None else (pseudo,)
            steps[-1][1].append(test)
        if any(not tests for _, tests in steps):
            raise BadSelector(selector)
        out.append([(c, t) for c, t in reversed(steps)])
    return out


def _split_list(selector: str) -> list[str]:
    parts, depth, start = [], 0, 0
    for i, c in enumerate(selector):
        depth += (c in "([") - (c in ")]")
        if c == "," and not depth:
            parts.append(selector[start:i])
            start = i + 1
    return [*parts, selector[start:]]


def _passes(node: Node, tests: list) -> bool:
    for kind, *args in tests:
        if kind == "tag":
            ok = args[0] in ("*", node.tag)
        elif kind == "id":
            ok = node.attrs.get("id") == args[0]
        elif kind == "class":
            ok = args[0] in node.classes
        elif kind == "attr":
            name, op, want = args
            have = node.attrs.get(name)
            ok = have is not None and (
                op is None or (op == "=" and have == want) or (op == "~=" and want in have.split()) or (op == "|=" and (have == want or have.startswith(want + "-")))
                or bool(want) and ((op == "^=" and have.startswith(want)) or (op == "$=" and have.endswith(want)) or (op == "*=" and want in have))
            )
        elif kind == "not":
            ok = not matches(node, args[0])
        elif kind == "empty":
            ok = not any(c.is_element or c.tag == "#text" for c in node.children)
        else:
            peers = [c for c in node.parent.children if c.is_element] if node.parent else [node]
            ok = peers[0 if kind == "first-child" else -1] is node
        if not ok:
            return False
    return True


def matches(node: Node, compiled: list) -> bool:
    return node.is_element and any(_chain(node, steps, 0) for steps in compiled)


def _chain(node: Node, steps: list, k: int) -> bool:
    if not node.is_element or not _passes(node, steps[k][1]):
        return False
    if k + 1 == len(steps):
        return True
    combinator = steps[k][0]
    if combinator in (" ", ">"):
        up = node.parent
        while up is not None and up.is_element:
            if _chain(up, steps, k + 1):
                return True
            if combinator == ">":
                return False
            up = up.parent
        return False
    peers = [c for c in node.parent.children if c.is_element] if node.parent else []
    before = peers[: next(i for i, c in enumerate(peers) if c is node)] if peers else []
    return any(_chain(c, steps, k + 1) for c in (before[-1:] if combinator == "+" else before))


def select(root: Node, selector: str) -> list[Node]:
    compiled = compile_selector(selector)
    return [n for n in root.walk() if matches(n, compiled)]
