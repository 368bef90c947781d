"""HTML to markdown.

One pass over the tree. Every element gives a string; siblings are joined, with a space where two word characters would touch.
A tag's own rule comes first, then replacements by tag in the order they were added. There is no markdown escaping.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from hashlib import md5

from ..functions.resolve import host_of, origin_of, resolve
from .dom import Node

SPACE = " \t\n\r\f\v\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_spaces = re.compile(f"[{SPACE}]+")
_BLANKS = "".join(c for c in map(chr, range(0x10000)) if _spaces.match(c))
_whole_strong, _whole_em = re.compile(r"^\*\*(.*?)\*\*$"), re.compile(r"^_(.*?)_$")
_heading_prefix, _highlight = re.compile(r"^#+ "), re.compile(r"highlight-(?:text|source)-([a-z0-9]+)")
#: How a column's alignment is written.
ALIGN = {"left": ":--", "right": "--:", "center": ":-:"}
DROPPED = frozenset("meta style script noscript link textarea select svg".split())


def trim(text: str) -> str:
    return text.strip(_BLANKS)


def collapse(text: str) -> str:
    return _spaces.sub(" ", text)


def clean_attribute(value: str | None) -> str:
    return re.sub(rf"(\n+[{SPACE}]*)+", "\n", value) if value else ""


@dataclass(frozen=True)
class Dialect:
    """How markdown is written."""

    heading_style: str = "atx"  # or setext
    hr: str = "* * *"
    bullet_list_marker: str = "*"
    em_delimiter: str = "_"
    strong_delimiter: str = "**"
    link_style: str = "inlined"  # or referenced, discarded
    link_reference_style: str = "full"  # or collapsed, shortcut
    fence: str = "```"
    code_block_style: str = "fenced"  # or indented


@dataclass
class Link:
    href: str
    text: str
    title: str
    ref: int
    domain: str


@dataclass
class Writer:
    """A converter for one page; links holds the page's anchors in order afterwards.

    base: what hrefs are resolved on (opaque bases are ignored). rules: replacements (text so far, node, converter) -> text by
    tag. keep: tags that stay HTML.
    """

    dialect: Dialect = field(default_factory=Dialect)
    base: str | None = None
    gfm: bool = True
    rules: dict[str, list[Callable[[str, Node, Writer], str]]] = field(default_factory=dict)
    keep: frozenset[str] = frozenset()
    links: list[Link] = field(default_factory=list)
    link_of: dict[int, Link] = field(default_factory=dict)
    lists: list[dict] = field(default_factory=list)
    level: int = -1
    tables: list[dict] = field(default_factory=list)
    in_item: bool = False
    loose_space: bool = False
    loose_rows: bool = False

    def __post_init__(self) -> None:
        if self.base and self.base.startswith(("blob:", "data:")):
            self.base = None

    def convert(self, root: Node) -> str:
        text = re.sub(r"\n{3,}", "\n\n", trim(self.node(root)))
        if self.dialect.link_style == "referenced" and self.links:
            by_text = self.dialect.link_reference_style in ("collapsed", "shortcut")
            text += "\n\n" + "\n".join(f"[{x.text if by_text else x.ref}]: {x.href}" + (f' "{x.title}"' if x.title else "") for x in self.links)
        return text

    def node(self, node: Node) -> str:
        if node.tag == "#text":
            return self.words(node.data)
        if node.tag == "#comment":
            return ""
        if node.tag in self.keep:
            return node.outer_html()
        rule = BASIC.get(node.tag) or (TABLES.get(node.tag) if self.gfm else None)
        text = rule(self, node) if rule else self.inside(node)
        for replace in self.rules.get(node.tag, ()):
            text = replace(text or "", node, self)
        return text

    def words(self, text: str) -> str:
        if not trim(text):
            return " " if self.loose_space and " " in text else ""
        text = collapse(text)
        d = self.dialect
        text = _whole_strong.sub(lambda m: f" {d.strong_delimiter}{m[1]}{d.strong_delimiter} ", text)
        return _whole_em.sub(lambda m: f" {d.em_delimiter}{m[1]}{d.em_delimiter} ", text)

    def inside(self, node: Node) -> str:
        parts: list[str] = []
        last = ""
        for child in node.children:
            text = self.node(child)
            if not text:
                continue
            tag = child.tag if child.is_element else ""
            if self.level > 0 and node.tag in ("ul", "ol") and tag and tag != "li":
                text = "    " * self.level + text + "\n"
            if tag in ("ul", "ol"):
                if not last.endswith("\n\n") and not text.startswith("\n"):
                    text = "\n" + text
            elif last and _wordy(last[-1]) and _wordy(text[0]):
                text = " " + text
            parts.append(text)
            last = text
        return "".join(parts)

    # Blocks

    def heading(self, node: Node) -> str:
        text, level = trim(self.inside(node)), int(node.tag[1])
        if not text:
            return ""
        if self.dialect.heading_style == "setext" and level <= 2:
            return f"\n{text}\n{('=' if level == 1 else '-') * len(text)}\n\n"
        return f"\n{'#' * level} {text}\n\n"

    def paragraph(self, node: Node) -> str:
        text = trim(self.inside(node))
        return f"\n{text}\n\n" if text else ""

    def block(self, node: Node) -> str:
        text = self.inside(node)
        language = _highlight.search(node.get("class"))
        if language and node.children and node.children[0].tag == "pre":
            return f"\n\n{self.dialect.fence}{language[1]}\n{node.children[0].text_content()}\n{self.dialect.fence}\n\n"
        bare = text.strip("\n")
        if self.in_item:
            return bare + " "
        return f"\n\n{bare}\n\n" if bare else text

    def quote(self, node: Node) -> str:
        text = trim("".join([self.node(c).removeprefix(" ") for c in node.children]))
        return "\n> " + text.replace("\n", "\n> ") + "\n\n" if text else ""

    def list_(self, node: Node) -> str:
        self.lists.append({"tag": node.tag, "n": 0})
        self.level += 1
        text = self.inside(node)
        self.level -= 1
        self.lists.pop()
        return f"\n{text}\n"

    def item(self, node: Node) -> str:
        self.in_item = True
        orphan = not self.lists or self.lists[-1]["tag"] == "li"
        if orphan:
            self.lists.append({"tag": "ul", "n": 0})
            self.level += 1
        of = self.lists[-1]
        self.lists.append({"tag": "li"})
        text = self.inside(node).removeprefix("\n").removesuffix("\n")
        self.lists.pop()
        marker = f"{of['n'] + 1}." if of["tag"] == "ol" else self.dialect.bullet_list_marker
        out = f"{'    ' * self.level}{marker}   {text}\n" if text else "\n"
        of["n"] += 1
        if orphan:
            self.lists.pop()
            self.level -= 1
        self.in_item = False
        return out

    # Code

    def code(self, node: Node) -> str:
        text = node.text_content()
        if not text:
            return ""
        language = next((re.sub("^(language-|lang-)", "", c) for c in node.get("class").split(" ") if c.startswith(("language-", "lang-"))), "")
        if not language and "\n" not in text:
            return f"`{trim(text)}`"
        if self.dialect.code_block_style == "fenced":
            return f"\n{self.dialect.fence}{language}\n{trim(text)}\n{self.dialect.fence}\n"
        return "\n    " + trim(text).replace("\n", "\n    ") + "\n"

    def pre(self, node: Node) -> str:
        parts = []
        self.loose_space = True
        for child in node.children:
            parts.append(child.data if child.tag == "#text" else self.node(child))
            if child.tag == "code":
                self.loose_space = False
        self.loose_space = False
        return "".join(parts)

    # Spans

    def strong(self, node: Node) -> str:
        text = self.inside(node)
        return f"{self.dialect.strong_delimiter}{trim(text)}{self.dialect.strong_delimiter}" if text else ""

    def em(self, node: Node) -> str:
        text = trim(self.inside(node)).replace("_", "\\_")
        return f"{self.dialect.em_delimiter}{text}{self.dialect.em_delimiter}" if text else ""

    def struck(self, node: Node) -> str:
        text = self.inside(node)
        return f"~~{text}~~" if text else ""

    def anchor(self, node: Node) -> str:
        href, title = node.get("href"), node.get("title").replace('"', '\\"')
        text = trim(collapse(self.inside(node)))
        domain = ""
        if self.base and (full := resolve(href, self.base)) is not None:
            href, domain = full, host_of(full)
        ref: int | str = ""
        if href:
            ref = len(self.links) + 1
            link = Link(href, text, title, ref, domain)
            self.links.append(link)
            self.link_of[id(node)] = link
        d = self.dialect
        if d.link_style == "discarded":
            return text
        head, label = "", text
        if m := _heading_prefix.match(text):
            head, label = m[0], text[m.end() :]
        if d.link_style == "referenced":
            return f"{head}[{label}]" + {"collapsed": "[]", "shortcut": ""}.get(d.link_reference_style, f"[{ref}]")
        return f"{head}[{label}]({href}" + (f' "{title}"' if title else "") + ")"

    def image(self, node: Node) -> str:
        title = node.get("title")
        return f"![{node.get('alt')}]({node.get('src')}" + (f' "{title}"' if title else "") + ")"

    # Tables: a row is written with pipes once its table has seen a row with a header cell.

    def table(self, node: Node) -> str:
        depth = len(self.tables)
        self.tables.append({"tag": "table", "head": False})
        text = self.inside(node)
        del self.tables[depth:]
        return ("" if text.startswith("\n") else "\n") + text + ("" if text.endswith("\n") else "\n")

    def cell(self, node: Node) -> str:
        text = self.inside(node)
        return trim(text if self.loose_rows else collapse(text))

    def row(self, node: Node) -> str:
        cells = [c for c in node.children if c.tag in ("th", "td")]
        head = any(c.tag == "th" for c in cells) and bool(self.tables) and self.tables[-1]["tag"] == "table"
        of = next((t for t in reversed(self.tables) if t["tag"] == "table"), None)
        self.tables.append({"tag": "tr"})
        if of is None or not (head or of["head"]):
            self.loose_rows = True
            text = self.inside(node) + "\n"
            self.loose_rows = False
            return text
        of["head"] = of["head"] or head
        text = "| " + " | ".join([trim(collapse(self.inside(c))) for c in cells]) + " |\n"
        if head:
            text += "| " + " | ".join(ALIGN.get(c.get("align"), "---") for c in cells if c.tag == "th") + " |\n"
        return text

    def input_(self, node: Node) -> str:
        return f"- [{'x' if 'checked' in node.attrs else ' '}] " if node.get("type") == "checkbox" else ""

    def math(self, node: Node) -> str:
        latex = trim(latex_of(node))
        if not latex:
            return ""
        alone = node.parent is not None and node.parent.tag == "p" and len(node.parent.children) == 1
        return f"\n\n$$\n{latex}\n$$\n\n" if alone else f"${latex}$"


def _wordy(c: str) -> bool:
    return c == "_" or c.isalpha() or c.isnumeric()


def latex_of(node: Node) -> str:
    """A small part of MathML as LaTeX; anything else gives its text."""
    if node.tag == "#text":
        return trim(node.data)
    parts = [p for c in node.children if (p := latex_of(c))] if node.tag not in ("msup", "msub", "mfrac", "msqrt", "mroot", "msubsup") else []
    kids = [latex_of(c) for c in node.children if c.is_element]
    if node.tag in ("annotation", "annotation-xml") or not node.is_element and node.tag != "#document":
        return ""
    shapes = {"msup": "{0}^{{{1}}}", "msub": "{0}_{{{1}}}", "mfrac": "\\frac{{{0}}}{{{1}}}", "mroot": "\\sqrt[{1}]{{{0}}}", "msubsup": "{0}_{{{1}}}^{{{2}}}"}
    if node.tag in shapes:
        return shapes[node.tag].format(*kids, "", "", "")
    if node.tag == "msqrt":
        return "\\sqrt{" + " ".join(kids) + "}"
    return " ".join(parts)


def _tagged(before: str, after: str) -> Callable[[Writer, Node], str]:
    """The children between two strings, or nothing."""

    def rule(m: Writer, node: Node) -> str:
        text = m.inside(node)
        return f"{before}{text}{after}" if text else ""

    return rule


BASIC: dict[str, Callable[[Writer, Node], str]] = {
    **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), Writer.heading),
    **dict.fromkeys(("div", "details"), Writer.block),
    **dict.fromkeys(("strong", "b"), Writer.strong),
    **dict.fromkeys(("em", "i"), Writer.em),
    **dict.fromkeys(("ul", "ol"), Writer.list_),
    **dict.fromkeys(("svg", "link", "script", "meta", "style"), lambda m, n: ""),
    "p": Writer.paragraph, "blockquote": Writer.quote, "li": Writer.item, "a": Writer.anchor, "img": Writer.image,
    "code": Writer.code, "pre": Writer.pre, "br": lambda m, n: "\n\n", "hr": lambda m, n: f"\n\n{m.dialect.hr}\n\n",
    "title": _tagged("", "\n"), "label": _tagged("", " "), "select": _tagged("\n", "\n\n"),
    "option": lambda m, n: n.get("value") + "\n", "figcaption": lambda m, n: f"\n\n{m.inside(n)}\n\n",
}
TABLES: dict[str, Callable[[Writer, Node], str]] = {
    **dict.fromkeys(("del", "s", "strike"), Writer.struck), **dict.fromkeys(("td", "th"), Writer.cell),
    "table": Writer.table, "tr": Writer.row, "input": Writer.input_, "math": Writer.math,
}


def object_url(data_url: str, base: str | None) -> str:
    """A short stand-in for a data URL."""
    return f"blob:{origin_of(base or 'http://localhost/') or 'null'}/{md5(data_url.encode()).hexdigest()}"


@dataclass
class Images:
    """The retention rule for images. seen: serials by source, summary: text by source, both in order of appearance."""

    mode: str = "all"  # none, all, alt, all_p, alt_p
    base: str | None = None
    keep_data: bool = False
    captions: dict[str, str] = field(default_factory=dict)
    n: int = 0
    seen: dict[str, list[int]] = field(default_factory=dict)
    summary: dict[str, str] = field(default_factory=dict)

    def __call__(self, _text: str, node: Node, _m: Writer) -> str:
        alt = clean_attribute(node.get("alt"))
        if self.mode == "none":
            return ""
        if self.mode == "alt":
            if not alt:
                return ""
            self.n += 1
            return f"(Image {self.n}: {alt})"
        source = trim(node.get("src")) or next((x for x in map(trim, node.get("srcset").split(",")) if x), "")
        if not source or source.startswith("data:"):
            lazy = trim(node.get("data-src"))
            if lazy and not lazy.startswith("data:"):
                source = lazy
        base = self.base if self.base and not self.base.startswith(("blob:", "data:")) else None
        full = (resolve(source, base) or source) if base else source
        if not full:
            return ""
        key = trim(object_url(source, self.base) if source.startswith("data:") else full)
        self.n += 1
        self.seen.setdefault(key, []).append(self.n)
        caption = self.captions.get(key)
        label = caption or alt
        if self.mode == "alt_p":
            if caption:
                self.summary[key] = caption
            return f"(Image {self.n}: {label})" if label else ""
        self.summary[key] = label
        return f"![Image {self.n}" + (f": {label}" if label else "") + f"]({full if self.keep_data else key})"

    def listed(self) -> list[tuple[str, str]]:
        return [(f"Image {','.join(map(str, dict.fromkeys(self.seen[k])))}" + (f": {alt}" if alt else ""), k) if self.seen.get(k) else (f"Hidden Image {i + 1}" + (f": {alt}" if alt else ""), k) for i, (k, alt) in enumerate(self.summary.items())]


#: Characters with a meaning in citation links, and what stands for them there.
CITATION_ESCAPES = str.maketrans({"\u3010": "\u3016", "\u3011": "\u3017", "\u25fc": "\u25fe", "\u200b": "", "\u2020": "\u2021"})


@dataclass
class Citations:
    """Links as numbered citations; used holds those that were written so."""

    host: str = ""
    used: list[Link] = field(default_factory=list)

    def __call__(self, text: str, node: Node, m: Writer) -> str:
        link = m.link_of.get(id(node))
        if link is None:
            return text
        if not link.text:
            return ""
        if link.href.startswith(("mailto:", "javascript:")):
            return link.text
        parts = [str(link.ref), link.text.translate(CITATION_ESCAPES)]
        if link.domain and link.domain != self.host:
            parts.append(link.domain.translate(CITATION_ESCAPES))
        self.used.append(link)
        return f"【{'†'.join(parts)}】"


def page_rules(dialect: Dialect, images: Images, links: str | Citations = "all", keep_data: bool = False, base: str | None = None) -> dict[str, list]:
    """The rules of a page: what isn't content goes, the title is a heading, data URLs get short names, then images and links."""
    gone = lambda text, node, m: ""
    rules: dict[str, list] = {tag: [gone] for tag in DROPPED}
    if dialect.heading_style == "setext":
        rules["title"] = [lambda text, node, m: f"{trim(text)}\n===============\n" if text else ""]
    else:
        rules["title"] = [lambda text, node, m: f"# {trim(text)}\n" if text else ""]
    rules["img"] = [images]
    if isinstance(links, Citations):
        rules["a"] = [links]
    elif links == "none":
        rules["a"] = [gone]
    elif links == "text":
        rules["a"] = [lambda text, node, m: m.link_of[id(node)].text if id(node) in m.link_of else ""]
    return rules
