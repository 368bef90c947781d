"""Caches as joins: freshness, stale fallback, error history, blockades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(cache: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The last row of each key."""
    return cache.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), F.desc(tie)))).filter("__n = 1").drop("__n")


def lookup(requests: DataFrame, cache: DataFrame, key: str, asked: str, made: str, tolerance_s: int, tie: str, forever: Column | None = None) -> DataFrame:
    """requests with the newest cache row at or before asked: hit is true where it is fresh. forever marks rows that never age.
    An as-of join without a range join: both sides in one ordered pass by key."""
    kept = [c for c in cache.columns if c not in (key, made)]
    right = cache.select(F.col(key).alias("__key"), F.col(made).alias("__at"), F.lit(0).alias("__side"), F.struct(F.col(made).alias("made"), *kept, (forever if forever is not None else F.lit(False)).alias("forever")).alias("__row"), F.lit(None).alias("__req"))
    left = requests.select(F.col(key).alias("__key"), F.col(asked).alias("__at"), F.lit(1).alias("__side"), F.lit(None).alias("__row"), F.struct(*requests.columns).alias("__req"))
    both = left.unionByName(right)
    w = Window.partitionBy("__key").orderBy("__at", "__side", F.coalesce(F.col(f"__row.{tie}"), F.lit(0))).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("cached", F.last("__row", ignorenulls=True).over(w)).filter("__side = 1")
    fresh = F.col("cached.forever") | (F.col("cached.made") >= F.col("__at") - F.make_interval(secs=F.lit(tolerance_s)))
    return found.select("__req.*", "cached", F.coalesce(fresh, F.lit(False)).alias("hit"))


def blocked_out(requests: DataFrame, blockades: DataFrame, key: str, at: str, until: str, since: str | None = None) -> DataFrame:
    """requests that no blockade in force holds back."""
    b = blockades.select(F.col(key).alias("__b"), F.col(until).alias("__until"), *([F.col(since).alias("__since")] if since else []))
    match = (F.col(key) == F.col("__b")) & (F.col("__until") > F.col(at))
    return requests.join(b, match & (F.col("__since") <= F.col(at)) if since else match, "left_anti")


def error_runs(events: DataFrame, key: str, at: str, tie: str, failed: Column) -> DataFrame:
    """Runs of failures in a row of each key: run_start, run_end, n. Gaps and islands: a success closes a run."""
    order = Window.partitionBy(key).orderBy(at, tie)
    marked = events.withColumn("__failed", failed).withColumn("__run", F.sum((~F.col("__failed")).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.filter("__failed").groupBy(key, "__run").agg(F.min(at).alias("run_start"), F.max(at).alias("run_end"), F.count("*").alias("n")).drop("__run")


def offered_load(events: DataFrame, key: str, at: str, period_s: int) -> DataFrame:
    """events and n: how many of the key came in the period that ends with each."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(-period_s * 1_000_000, 0)
    return events.withColumn("n", F.count("*").over(w))


def idle_sessions(events: DataFrame, key: str, at: str, gap: str) -> DataFrame:
    """Stretches of activity that a gap ends: key, start, last, n."""
    return events.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"), F.max(at).alias("last")).select(key, F.col("w.start").alias("start"), "last", "n")


def cacheable(snapshot: DataFrame, *, title: str, tokens: str, status: str, html: str, flags: tuple[str, ...] = ()) -> DataFrame:
    """Snapshots good enough to be kept: titled, plain (no flag set), and not a short error or captcha page."""
    keep = F.coalesce(F.col(title), F.lit("")) != ""
    for f in flags:
        keep = keep & ~F.coalesce(F.col(f), F.lit(False))
    short = F.col(tokens) < 200
    return snapshot.filter(keep & ~(short & ((F.col(status) != 200) | F.col(html).contains("captcha") | F.col(html).contains("cf-turnstile-response"))))


def curl_error_class(code: Column) -> Column:
    """user (don't retry), approach (retry another way), attempt (retry), or null. Codes are those of the transfer library."""
    return F.when(code == 6, "user").when(code.isin(28, 1, 60), "approach").when(code.isin(97, 9, 55, 56, 52, 35, 96, 5, 7, 18), "attempt")
