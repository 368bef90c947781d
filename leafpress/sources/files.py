"""Posted and captured files: kind, text encoding, and text as a page."""

from __future__ import annotations

import codecs
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.urls import content_type

MAX_BYTES = 32 << 20
_meta = re.compile(rb"""<meta[^>]+charset\s*=\s*["']?\s*([\w:-]+)""", re.I)
#: What web pages mean by these names.
ALIASES = {"iso-8859-1": "cp1252", "latin1": "cp1252", "ascii": "cp1252", "us-ascii": "cp1252", "gb2312": "gb18030", "gbk": "gb18030", "shift_jis": "cp932", "shift-jis": "cp932", "x-sjis": "cp932", "ks_c_5601-1987": "cp949", "euc-kr": "cp949", "big5": "big5hkscs", "iso-8859-9": "cp1254", "utf8": "utf-8"}


def decode(body: bytes | None, declared: str | None = None) -> str | None:
    """Text of bytes: the header's encoding, else the one that the first 1024 bytes name, else UTF-8; wrong bytes are replaced."""
    if body is None:
        return None
    if body.startswith((codecs.BOM_UTF8, codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)):
        return body.decode("utf-8-sig" if body.startswith(codecs.BOM_UTF8) else "utf-16", "replace")
    found = _meta.search(body[:1024])
    name = (declared or (found[1].decode("ascii", "replace") if found else "") or "utf-8").strip().lower()
    try:
        return body.decode(ALIASES.get(name, name), "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def decoded(body: Column, declared: Column) -> Column:
    """Text of bytes by decode()."""

    def run(bodies: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([decode(x, y) for x, y in zip(bodies, names, strict=True)])

    return F.pandas_udf(run, T.StringType())(body, declared)


def charset(header: Column) -> Column:
    """The charset of a Content-Type header; null for none."""
    return F.nullif(F.regexp_extract(header, r"""(?i)charset\s*=\s*["']?([\w:-]+)""", 1), F.lit(""))


def text_page(text: Column, name: Column) -> Column:
    """A page that shows a text as it is."""
    esc = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.concat(F.lit("<html><head><title>"), esc(F.coalesce(name, F.lit(""))), F.lit("</title></head><body><pre>"), esc(text), F.lit("</pre></body></html>"))


def as_pages(files: DataFrame, body: str = "content", path: str = "path", header: str | None = None) -> DataFrame:
    """Files (as the binaryFile source gives them) as pages: url, type, kind (html, text, xml, image, pdf, office, other), html.
    Larger texts than the guard have no html."""
    given = F.col(header) if header else F.lit(None).cast("string")
    name = F.regexp_extract(path, "([^/]*)$", 1)
    kind_of = F.regexp_replace(content_type(name, given), r"\s*;.*$", "")
    rows = files.withColumns({"type": kind_of, "__name": name, "__charset": charset(given)})
    t = F.col("type")
    kind = (
        F.when(t.isin("text/html", "application/xhtml+xml"), "html").when(t.rlike("xml$"), "xml").when(t.rlike("^text/|json$|javascript$"), "text").when(t.startswith("image/"), "image")
        .when(t == "application/pdf", "pdf").when(t.rlike("msword|officedocument|ms-excel|ms-powerpoint|opendocument"), "office").otherwise("other")
    )
    rows = rows.withColumn("kind", kind)
    small = F.octet_length(body) <= MAX_BYTES
    text = F.when(small & F.col("kind").isin("html", "text", "xml"), decoded(F.col(body), F.col("__charset")))
    rows = rows.withColumn("__text", text)
    html = F.when(F.col("kind") == "text", text_page(F.col("__text"), F.col("__name"))).otherwise(F.col("__text"))
    return rows.select(F.concat(F.lit("blob:"), F.sha2(F.col(body), 256)).alias("url"), "type", "kind", F.col("__name").alias("name"), html.alias("html"))


def from_base64(text: Column) -> Column:
    return F.unbase64(F.regexp_replace(text, "^data:[^,]*,", ""))
