"""Local full-text search, its results and their price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What parts terms: ASCII but letters and digits.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CAP = 2_000_000


def terms(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), GAP), "")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", wanted: DataFrame | None = None) -> DataFrame:
    """(id, term, tf, length): write it partitioned or bucketed by term to search without a scan of all texts. wanted: rows of
    term, for an index of these alone; others go before anything is counted or shuffled."""
    words = docs.select(id_col, terms(F.col(text_col)).alias("w")).select(id_col, F.size("w").alias("length"), F.explode("w").alias("term"))
    if wanted is not None:
        words = words.join(wanted.select("term").distinct(), "term", "left_semi")
    return words.groupBy(id_col, "length", "term").agg(F.count("*").alias("tf"))


def query_terms(queries: DataFrame, query_col: str = "query") -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(terms(F.col(query_col)))).alias("term"))


def search(index: DataFrame, n_docs: int, queries: DataFrame, k: int, id_col: str = "doc_id", query_col: str = "query") -> DataFrame:
    """(query_id, id, score, rank): top k by the sum over distinct terms of (1 + ln tf) ln(1 + N / df), ties by id. Scores are
    in millionths, as whole numbers, so that they don't depend on the order of the sum. Only rows of terms that a query has leave
    the scan; terms join on equal keys."""
    asked = query_terms(queries, query_col)
    df = index.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    hits = index.join(asked, "term").join(df, "term")
    scored = hits.groupBy("query_id", id_col).agg(F.sum(F.round((1 + F.log("tf")) * F.log(1 + F.lit(n_docs) / F.col("df")) * 1_000_000).cast("long")).alias("score"))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), id_col))
    return scored.withColumn("rank", best).filter(F.col("rank") <= k)


def reorganise(results: DataFrame, by: str, pos: str, qualified: str, k: int) -> DataFrame:
    """Up to k results in their order: all qualified ones, then the first others as far as there is room."""
    own = Window.partitionBy(by, qualified).orderBy(pos)
    n = F.sum(F.col(qualified).cast("int")).over(Window.partitionBy(by))
    kept = results.withColumns({"__n": n, "__own": F.row_number().over(own)}).filter(F.col(qualified) | (F.col("__own") <= k - F.col("__n")))
    return kept.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy(pos))).filter(F.col("__r") <= k).drop("__n", "__own", "__r")


def page_usage(tokens: Column, pictured: Column) -> Column:
    return F.least(F.coalesce(tokens, F.lit(1000)) + F.when(pictured, F.lit(765)).otherwise(F.lit(0)), F.lit(CAP)).cast("long")


def search_usage(items: DataFrame, by: str, usage: str, scaler: int = 1) -> DataFrame:
    """(by, n, total, each): the dearer of the items' sum and the flat price of every ten; each item's share where that is flat."""
    g = items.groupBy(by).agg(F.count("*").alias("n"), F.sum(usage).alias("__sum"))
    flat = (F.ceil(F.col("n") / 10) * 10_000 * scaler).cast("long")
    total = F.least(F.greatest("__sum", flat), F.lit(CAP)).cast("long")
    return g.select(by, "n", total.alias("total"), F.when(total == flat, F.ceil(flat / F.col("n")).cast("long")).alias("each"))


def tier(amount: Column, has_option: dict[str, tuple[Column, float, int]]) -> Column:
    """A price after its options' factors and floors: name to (is set, factor, least)."""
    for test, factor, least in has_option.values():
        amount = F.when(test, F.greatest(F.ceil(amount * factor), F.lit(least))).otherwise(amount)
    return amount.cast("long")


#: How a result's fields are called.
LABELS = {"title": "Title", "source": "Source", "url": "URL Source", "image_url": "Image URL", "description": "Description", "published_time": "Published Time", "image_width": "Image Width", "image_height": "Image Height", "date": "Date", "favicon": "Favicon"}


def text_form(columns: list[str], n: Column, content: Column | None = None) -> Column:
    """A result as labelled lines; missing fields are left out."""
    lines = [F.concat(F.lit("["), n.cast("string"), F.lit(f"] {LABELS[c]}: "), F.col(c).cast("string")) for c in LABELS if c in columns]
    return F.concat_ws("\n", *lines, *([F.concat(F.lit("\n"), F.nullif(content, F.lit("")))] if content is not None else []))


def country_vote(rows: DataFrame, by: str, code: str) -> DataFrame:
    """The most frequent code, ties to the first in the alphabet."""
    counts = rows.groupBy(by, code).agg(F.count("*").alias("votes"))
    return counts.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("votes"), code))).filter("__n = 1").drop("__n")
