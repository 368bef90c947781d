"""Stored rows: what a cache keeps and for how long, and the joins that read it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from .cache import lookup

#: Days that a stored page is kept, hours until a picture without a caption is tried again, pages that a search can ask for.
KEPT_DAYS, RETRY_HOURS, MOST_PAGES = 7, 24, 20


def object_digest(**fields: Column) -> Column:
    """One digest of named values, in whatever order they are given; nulls count as left out."""
    return F.md5(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])))


def stored(pages: DataFrame, url: str = "url", at: str = "at", days: int = KEPT_DAYS) -> DataFrame:
    """pages as the cache keeps them: digest, prefix (its first two digits, the partition), expire_at."""
    return pages.withColumns({"digest": urls.digest(F.col(url)), "prefix": F.substring(urls.digest(F.col(url)), 1, 2), "expire_at": F.col(at) + F.make_dt_interval(days=F.lit(days))})


def write(pages: DataFrame, path: str, url: str = "url", at: str = "at", days: int = KEPT_DAYS) -> None:
    """Appends pages to the cache table at path. Rows of a prefix meet in one task first, so that a run adds one file to each of
    the 256 folders."""
    stored(pages, url, at, days).repartition("prefix").write.mode("append").partitionBy("prefix").parquet(path)


def unexpired(cache: DataFrame, now: Column) -> DataFrame:
    return cache.filter(F.col("expire_at") > now)


def page_at(pages: Column, url: Column) -> Column:
    """The n-th of a document's pages for a URL that ends in #n (from 1); the first without one, null beyond the last."""
    n = F.regexp_extract(url, r"#(\d{1,9})$", 1)
    return F.when((n == "") | (n.try_cast("int") > 0), F.try_element_at(pages, F.coalesce(n.try_cast("int"), F.lit(1))))


def cached_results(queries: DataFrame, cache: DataFrame, fields: list[str], asked: str, made: str, tolerance_s: int, tie: str) -> DataFrame:
    """queries with the newest stored answer to the same question (fields, in any order): hit is true where it is fresh."""
    digest = object_digest(**{f: F.col(f) for f in fields})
    return lookup(queries.withColumn("digest", digest), cache.withColumn("digest", digest).drop(*fields), "digest", asked, made, tolerance_s, tie)


def captioned(images: DataFrame, captions: DataFrame, now: Column, src: str = "src") -> DataFrame:
    """Each different picture once: src, caption (null if none is known), to_do: no caption is stored, or an empty one so long
    ago that it is tried again. captions: src_digest, caption, at."""
    different = images.select(src).filter(F.col(src).isNotNull()).dropDuplicates([src]).withColumn("src_digest", F.md5(src))
    last = captions.groupBy("src_digest").agg(F.max_by(F.struct("caption", "at"), F.struct("at", "caption")).alias("c"))
    found = different.join(last, "src_digest", "left")
    empty = F.coalesce(F.col("c.caption"), F.lit("")) == ""
    return found.select(src, F.when(~empty, F.col("c.caption")).alias("caption"), (empty & (F.col("c").isNull() | (F.col("c.at") + F.make_dt_interval(hours=F.lit(RETRY_HOURS)) <= now))).alias("to_do"))


def with_snapshots(hits: DataFrame, snapshots: DataFrame, key: str, ok: Column) -> DataFrame:
    """Hits whose page is stored; where reading it failed the hit goes."""
    return hits.join(snapshots.filter(F.coalesce(ok, F.lit(False))), key)


def first_answer(answers: DataFrame, by: str, turn: str, ok: Column) -> DataFrame:
    """Of the providers asked in turn, the first one's answer that is one."""
    rest = [c for c in answers.columns if c != by]
    return answers.filter(F.coalesce(ok, F.lit(False))).groupBy(by).agg(F.min_by(F.struct(*rest), turn).alias("a")).select(by, "a.*")


def by_deadline(live_s: Column, live: Column, local: Column, timeout_s: Column) -> Column:
    """The live answer if it came in time, else the local one, else the live one after all."""
    return F.when(live_s <= timeout_s, live).otherwise(F.coalesce(local, live))


def page_limit(n: Column) -> Column:
    return F.least(F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)), F.lit(MOST_PAGES))


def lists_so_far(rows: DataFrame, by: str, pos: str, seq: str, size: int) -> DataFrame:
    """by and items: the list as it stands, for each place up to size the last row that came, null before. For a stream, an
    update-mode query. size bounds what a list can hold."""
    rest = [c for c in rows.columns if c not in (by, pos)]
    places = [F.max_by(F.when(F.col(pos) == i, F.struct(*rest)), F.when(F.col(pos) == i, F.col(seq))).alias(f"__{i}") for i in range(size)]
    return rows.groupBy(by).agg(*places).select(by, F.array(*[f"__{i}" for i in range(size)]).alias("items"))


def retry_at(header: Column, now: Column) -> Column:
    """When a client may be asked again by its Retry-After: seconds from now, or a date; null if it says neither. Leading digits
    count as seconds, 0 as nothing."""
    seconds = F.nullif(F.regexp_extract(header, r"^\s*(\d{1,9})", 1).try_cast("int"), F.lit(0))
    date = F.try_to_timestamp(F.regexp_extract(header, r"(\d{1,2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2}) GMT", 1), F.lit("d MMM yyyy HH:mm:ss"))
    return F.coalesce(now + F.make_dt_interval(secs=seconds), date)


def available(clients: DataFrame, by: str, until: str, now: Column) -> DataFrame:
    """Clients that no blockade holds back; all of a group where none is left."""
    free = F.coalesce(F.col(until) < now, F.lit(True))
    some = F.bool_or("__free").over(Window.partitionBy(by))
    return clients.withColumn("__free", free).withColumn("__some", some).filter(F.col("__free") | ~F.col("__some")).drop("__free", "__some")
