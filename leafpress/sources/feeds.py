"""Feeds and sitemaps as rows, by Spark's own XML parser."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ROOT = r"(?s)^\s*(?:<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>|\s)*<([A-Za-z_][\w.:-]*)"
_ITEM = "title:string,link:string,description:string,pubDate:string"
_ENTRY = "title:string,link:array<struct<_href:string,_rel:string>>,summary:string,updated:string"
_PLACE = "array<struct<loc:string,lastmod:string>>"
#: Root element to the schema of its content.
SCHEMAS = {
    "rss": f"struct<channel:struct<title:string,description:string,item:array<struct<{_ITEM}>>>>",
    "feed": f"struct<title:string,subtitle:string,entry:array<struct<{_ENTRY}>>>",
    "sitemapindex": f"struct<sitemap:{_PLACE}>",
    "urlset": f"struct<url:{_PLACE}>",
}


def kind(xml: Column) -> Column:
    """Name of the root element."""
    return F.lower(F.regexp_replace(F.regexp_extract(xml, _ROOT, 1), "^.*:", ""))


def _read(feeds: DataFrame, key: str, xml: str) -> dict[str, DataFrame]:
    """(key, kind, r) by kind: r is the parsed file. Each file is parsed once, by the schema of its kind."""
    rows = feeds.select(key, kind(F.col(xml)).alias("kind"), F.col(xml).alias("__xml"))
    return {name: rows.filter(F.col("kind") == name).select(key, "kind", F.from_xml("__xml", T.StructType.fromDDL(f"r {schema}")["r"].dataType).alias("r")) for name, schema in SCHEMAS.items()}


def items(feeds: DataFrame, key: str, xml: str = "xml") -> DataFrame:
    """(key, kind, pos, title, href, description, date) of every item, pos from 1. Entries of both feed kinds are listed."""
    of = _read(feeds, key, xml)
    none = F.lit(None).cast("string")
    link = F.coalesce(F.try_element_at(F.filter("i.link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(1))["_href"], F.try_element_at(F.col("i.link"), F.lit(1))["_href"])
    fields = {
        "rss": ("r.channel.item", (F.col("i.title"), F.col("i.link"), F.col("i.description"), F.col("i.pubDate"))),
        "feed": ("r.entry", (F.col("i.title"), link, F.col("i.summary"), F.col("i.updated"))),
        "sitemapindex": ("r.sitemap", (none, F.col("i.loc"), none, F.col("i.lastmod"))),
        "urlset": ("r.url", (none, F.col("i.loc"), none, F.col("i.lastmod"))),
    }
    out = None
    for name, (path, columns) in fields.items():
        found = of[name].select(key, "kind", F.posexplode(path).alias("p", "i")).select(key, "kind", (F.col("p") + 1).alias("pos"), *[F.trim(c).alias(n) for n, c in zip(("title", "href", "description", "date"), columns, strict=True)])
        out = found if out is None else out.unionByName(found)
    return out


def heads(feeds: DataFrame, key: str, xml: str = "xml") -> DataFrame:
    """(key, kind, title, description)."""
    of = _read(feeds, key, xml)
    texts = {"rss": (F.col("r.channel.title"), F.col("r.channel.description")), "feed": (F.col("r.title"), F.col("r.subtitle")), "sitemapindex": (F.lit("Sitemap Index"), F.lit("")), "urlset": (F.lit("Sitemap"), F.lit(""))}
    out = None
    for name, (title, text) in texts.items():
        found = of[name].select(key, "kind", F.coalesce(title, F.lit("")).alias("title"), F.coalesce(text, F.lit("")).alias("description"))
        out = found if out is None else out.unionByName(found)
    return out


def as_html(rows: DataFrame, heads: DataFrame, key: str) -> DataFrame:
    """(key, html): a page that lists a feed's items, with what they hold escaped."""
    esc = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    item = F.concat(F.lit('<div><h3><a href="'), esc(F.col("href")), F.lit('">'), esc(F.col("title")), F.lit("</a></h3><p>"), esc(F.col("description")), F.lit('</p><a href="'), esc(F.col("href")), F.lit('">'), esc(F.col("href")), F.lit("</a><br /><time>"), esc(F.col("date")), F.lit("</time></div>"))
    plain = F.concat(F.lit('<div><a href="'), esc(F.col("href")), F.lit('">'), esc(F.col("href")), F.lit("</a><br /><time>"), esc(F.col("date")), F.lit("</time></div>"))
    body = rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.when(F.col("kind").isin("rss", "feed"), item).otherwise(plain).alias("h")))), lambda x: x["h"]), "\n").alias("body"))
    whole = F.concat(F.lit("<html><head><title>"), esc(F.col("title")), F.lit('</title><meta name="description" content="'), esc(F.col("description")), F.lit('"></head><body>'), F.coalesce("body", F.lit("")), F.lit("</body></html>"))
    return heads.join(body, key, "left").select(key, whole.alias("html"))
