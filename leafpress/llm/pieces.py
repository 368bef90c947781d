"""Finding the pieces of a tokenizer's pattern."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

#: Code points below this have a table in the fast pattern.
LATIN = 0x250


def finder(pattern: str) -> Callable[[str], list[str]]:
    """All matches of pattern (with \\p{L}, \\p{N} and \\s) in order. Texts of Latin code points alone go through Python's own
    engine, with the classes written out for these from the Unicode data; others through the tokenizers library's engine, whose
    edition of Unicode decides there."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    split = Split(Regex(pattern), "removed", invert=True).pre_tokenize_str
    beyond = re.compile(f"[^\x00-{chr(LATIN - 1)}]").search
    latin = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{_spaces()}{_class('L')}{_class('N')}]").replace(r"[\p{L}]", f"[{_class('L')}]").replace(r"[\p{N}]", f"[{_class('N')}]").replace(r"\p{L}", f"[{_class('L')}]").replace(r"\p{N}", f"[{_class('N')}]").replace(r"\S", f"[^{_spaces()}]").replace(r"\s", f"[{_spaces()}]")
    fast = re.compile(latin).findall
    return lambda text: fast(text) if text.isascii() or not beyond(text) else [x for x, _ in split(text)]


def _class(kind: str) -> str:
    """The code points below LATIN whose category starts with kind, as ranges."""
    inside = [i for i in range(LATIN) if unicodedata.category(chr(i))[0] == kind]
    starts = [i for i in inside if i - 1 not in inside]
    ends = [i for i in inside if i + 1 not in inside]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends, strict=True))


def _spaces() -> str:
    """White space below LATIN as Unicode has it, which leaves out the separators 1C to 1F."""
    return r"\t-\r \x85\xa0"
