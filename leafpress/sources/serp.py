"""Search result pages: their URLs, and the hits in their HTML or JSON."""

from __future__ import annotations

import base64
from collections.abc import Callable
from urllib.parse import parse_qs, unquote, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..html.dom import Node, parse, select

HIT = "array<struct<link:string,title:string,source:string,date:string,snippet:string,image_url:string,variant:string>>"


def _first(root: Node, selector: str) -> Node | None:
    return next(iter(select(root, selector)), None)


def _text(node: Node | None) -> str | None:
    return node.text_content().strip() or None if node is not None else None


def general(html: str) -> list[dict]:
    """Hits of a page whose results are div[lang] or div[data-surl] inside the query's container; video rows are left out."""
    box = _first(parse(html), 'div[data-async-context^="query"]')
    out = []
    for row in select(box, "div[lang],div[data-surl]") if box else ():
        link = _first(row, 'a:not([href="#"])')
        if link is None or _first(link, 'div[role="heading"]'):
            continue
        cite = _text(_first(link, "cite[role=text]")) or ""
        spans = select(row, 'div[data-sncf*="1"] span')
        date = cite.split("·")[1].strip() if "·" in cite else _text(spans[-2]) if len(spans) > 1 else None
        image = next((i.get("src") for i in select(row, 'div[data-sncf*="1"] img[src]') if not i.get("src").startswith("data")), None)
        out.append({"link": link.get("href"), "title": _text(_first(link, "h3")), "source": next((t for s in select(link, "span") if (t := _text(s))), None), "date": date, "snippet": _text(spans[-1]) if spans else None, "image_url": image, "variant": "web"})
    return out


def plain(html: str) -> list[dict]:
    """Hits of the scriptless form: anchors with data-ved and no class."""
    out = []
    for link in select(parse(html), "a[data-ved]:not([class])"):
        url = link.get("href")
        title = _text(_first(link, "div[style]"))
        if not url or not title:
            continue
        if url.startswith("/url?q="):
            url = unquote(url[7:].split("&sa=U")[0])
        around = link.parent.parent if link.parent and link.parent.parent else link
        body = _first(around, "div.ilUpNd.H66NU.aSRlid")
        date = _text(_first(body, "span.UK5aid.MDvRSc")) if body else None
        if body:
            for gone in select(body, "span") + select(body, "script"):
                gone.remove()
        out.append({"link": url, "title": title, "source": None, "date": date, "snippet": _text(body) or "", "image_url": None, "variant": "web"})
    return out


def listed(html: str) -> list[dict]:
    """Hits of a page whose results are ol#b_results li.b_algo, with wrapped links unwrapped."""
    out = []
    for row in select(parse(html), "ol#b_results li.b_algo"):
        link = _first(row, "h2 a")
        if link is None:
            continue
        url = link.get("href")
        wrapped = parse_qs(urlsplit(url).query).get("u", [""])[0][2:] if "/ck/a?" in url else ""
        if wrapped:
            url = base64.urlsafe_b64decode(wrapped + "=" * (-len(wrapped) % 4)).decode(errors="replace")
        snippet = _text(_first(row, "p"))
        if snippet and " · " in snippet:
            snippet = snippet.split(" · ")[1].strip()
        image = next((i.get("src") for i in select(row, ".b_imgcap_altitle img[src]") if not i.get("src").startswith("data")), None)
        out.append({"link": url, "title": _text(link), "source": _text(_first(row, ".tptt")), "date": _text(_first(row, "p span.news_dt")), "snippet": snippet, "image_url": image, "variant": "web"})
    return out


KINDS: dict[str, Callable[[str], list[dict]]] = {"general": general, "plain": plain, "listed": listed}


def hits(pages: DataFrame, key: str, html: str = "html", kind: str = "general") -> DataFrame:
    """(key, pos, link, title, ...) of the hits of result pages."""
    read = KINDS[kind]

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda h: read(h) if h is not None else [])

    kind_of = T.StructType.fromDDL(f"h {HIT}")["h"].dataType
    return pages.select(key, F.posexplode(F.pandas_udf(run, kind_of)(html)).alias("pos", "h")).select(key, "pos", "h.*")


def image_hits(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, pos, link, title, image_url) of the JSON inside an image result page."""
    body = F.regexp_extract(html, r'(?s)(\{"ischj":.*\})', 1)
    shape = "struct<ischj:struct<metadata:array<struct<result:struct<referrer_url:string,page_title:string>,original_image:struct<url:string>>>>>"
    found = F.from_json(body, shape)["ischj"]["metadata"]
    return pages.select(key, F.posexplode(found).alias("pos", "m")).select(key, "pos", F.col("m.result.referrer_url").alias("link"), F.col("m.result.page_title").alias("title"), F.col("m.original_image.url").alias("image_url"))


def result_url(q: Column, page: Column, base: str, per_page: int = 10, offset: str = "start", first: int = 0, country: Column | None = None, language: Column | None = None) -> Column:
    """URL of a page of results: the first page has no offset."""
    extra = [F.concat(F.lit(f"{k}="), F.url_encode(c)) for k, c in (("gl", country), ("hl", language)) if c is not None]
    at = F.when(page > 1, F.concat(F.lit(f"{offset}="), ((page - 1) * per_page + first).cast("string")))
    return F.concat(F.lit(base + "?"), F.concat_ws("&", F.concat(F.lit("q="), F.url_encode(q)), at, *extra))


def vendor_rows(responses: DataFrame, key: str, body: str = "response") -> DataFrame:
    """(key, pos, link, title, snippet, date) of the organic hits of a vendor's JSON."""
    shape = "struct<organic:array<struct<title:string,link:string,snippet:string,date:string,position:int>>>"
    return responses.select(key, F.inline(F.from_json(body, shape)["organic"])).select(key, F.col("position").alias("pos"), "link", "title", "snippet", "date")
