"""Tolerant JSON: text around the value, cut ends, raw control characters and literals in any case are allowed. Plain Python, with an
Arrow-batched function for columns; strict JSON needs Spark's own from_json and try_parse_json."""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_number = re.compile(r"-?\d*\.?\d*(?:[eE][+-]?\d*)?")
_literals = {"true": True, "false": False, "null": None, "none": None, "nan": None, "undefined": None}
_word = re.compile(r"[A-Za-z]+")
_escapes = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


class _Cursor:
    """A stack of open containers in place of recursion, so that any depth will do."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def string(self) -> str:
        """From the opening quote on; a missing end closes it."""
        quote, out = self.text[self.at], []
        self.at += 1
        while self.at < len(self.text):
            c = self.text[self.at]
            self.at += 1
            if c == quote:
                break
            if c != "\\":
                out.append(c)
                continue
            if self.at >= len(self.text):
                break
            e = self.text[self.at]
            self.at += 1
            if e == "u":
                digits = self.text[self.at : self.at + 4]
                if len(digits) == 4 and all(x in "0123456789abcdefABCDEF" for x in digits):
                    out.append(chr(int(digits, 16)))
                    self.at += 4
            else:
                out.append(_escapes.get(e, e))
        return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")

    def scalar(self) -> tuple[bool, Any]:
        c = self.text[self.at]
        if c == '"':
            return True, self.string()
        if c == "-" or c.isdigit():
            m = _number.match(self.text, self.at)
            self.at = max(m.end(), self.at + 1)
            for end in range(len(m[0]), 0, -1):
                try:
                    return True, json.loads(m[0][:end])
                except ValueError:
                    continue
            return False, None
        m = _word.match(self.text, self.at)
        if not m:
            self.at += 1
            return False, None
        self.at = m.end()
        word = m[0].lower()
        if word in _literals:
            return True, _literals[word]
        cut = self.at >= len(self.text) and next((k for k in ("true", "false", "null") if k.startswith(word)), None)
        return (True, _literals[cut]) if cut else (False, None)


_NO_KEY = object()


def parse(text: str | None, default: Any = None) -> Any:
    """The first object or array in a text, or the scalar that the whole text is; default where there is none."""
    text = text or ""
    start = next((i for i, c in enumerate(text) if c in "{["), None)
    if start is None:
        try:
            return json.loads(text)
        except ValueError:
            return default
    r = _Cursor(text)
    r.at = start
    stack: list[list] = []  # [container, key that waits for its value]

    def put(value: Any) -> None:
        top = stack[-1]
        if isinstance(top[0], list):
            top[0].append(value)
        elif top[1] is not _NO_KEY:
            top[0][top[1]] = value
            top[1] = _NO_KEY

    done = None
    while r.at < len(text):
        c = text[r.at]
        if c in "{[":
            r.at += 1
            stack.append([{} if c == "{" else [], _NO_KEY])
        elif c in "}]":
            r.at += 1
            done = _close(stack, put)
            if not stack:
                return done
        elif c in " \t\r\n,:":
            r.at += 1
        elif isinstance(stack[-1][0], dict) and stack[-1][1] is _NO_KEY:
            if c == '"' or c == "'":
                stack[-1][1] = r.string()
            elif m := _word.match(text, r.at):
                stack[-1][1], r.at = m[0], m.end()
            else:
                r.at += 1
        else:
            ok, value = r.scalar()
            if ok:
                put(value)
    while stack:
        done = _close(stack, put)
    return done


def _close(stack: list[list], put) -> Any:
    container, key = stack.pop()
    if key is not _NO_KEY:
        container[key] = ""
    if stack:
        put(container)
    return container


def repaired(text: Column | str) -> Column:
    """Valid JSON of what a text holds; null if it holds none."""
    missing = object()

    def of(x: str | None) -> str | None:
        return None if x is None or (v := parse(x, missing)) is missing else json.dumps(v, ensure_ascii=False, separators=(",", ":"))

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(of)

    return F.pandas_udf(run, T.StringType())(text)
