"""Mixing sources to target weights.

Every document gets a hash-random key. Within each source the documents are dealt by ranges of that key, sorted in each range,
and a distributed prefix sum of their word counts (totals of the ranges, then running sums inside each range) gives every
document its place on the source's word axis. A source whose budget is b words of s gives b div s whole epochs and, of one
more epoch, exactly the words whose place is below b mod s; the document at the cut gives its first words.

Targets take one row a source, which stand in one order in one task: sources are kinds of text, not hosts. The ranges of a source
are summed up in one task, a row each for about RANGE_ROWS documents.

Null texts have no words, null sources are one source that comes last, null ids are allowed. Equal rows get neighbouring
places. An empty table gives an empty result. Columns of the input stay,
whatever their names; only those named as an output are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import cut, documents, n_words, sealed, unsealed

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Key ranges of a source hold about so many documents at most.
RANGE_ROWS = 16384
OUTPUTS = ["mix_size", "mix_source_size", "mix_target", "mix_taken"]


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "mix") -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target, mix_taken: words of the document and of its source, the source's
    target, and the words that the mix takes of the document, repeats counted.

    weights: by the sources' order of code points (null last), repeating. A target is a share of all words by weight, at most
    max_epochs times the source; the excess is shared again by weight among the other sources.
    """
    rows = docs.count()
    digits = max(2, math.ceil(math.log(max(rows, 1) / RANGE_ROWS, 16))) if rows else 2
    group = F.when(F.col(source_col).isNull(), F.lit("z")).otherwise(F.concat(F.lit("s"), F.col(source_col)))
    key = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 15)
    keyed = sealed(docs, {"mix_size": n_words(F.col(text_col)), "__group": group, "__key": key, "__id": F.col(id_col), "__text": F.col(text_col)}, OUTPUTS).withColumn("__range", F.substring("__key", 1, digits))

    ranges = cut(keyed.groupBy("__group", "__range").agg(F.sum("mix_size").alias("__words")))
    places = ranges.withColumn("__before", F.coalesce(F.sum("__words").over(Window.partitionBy("__group").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__words")
    placed = places.join(_targets(ranges, weights, max_epochs), "__group")

    inside = Window.partitionBy("__group", "__range").orderBy("__key", "__id", "__text").rowsBetween(Window.unboundedPreceding, -1)
    place = F.col("__before") + F.coalesce(F.sum("mix_size").over(inside), F.lit(0))
    budget = F.floor("mix_target").cast("long")
    epochs = F.expr("floor(mix_target) div mix_source_size")
    part = F.greatest(F.lit(0), F.least(F.col("mix_size"), budget - epochs * F.col("mix_source_size") - place))
    taken = F.when(F.col("mix_source_size") > 0, epochs * F.col("mix_size") + part).otherwise(F.lit(0)).cast("long")
    return keyed.join(placed, ["__group", "__range"]).withColumn("mix_taken", taken).transform(unsealed, *map(F.col, OUTPUTS))


def _targets(ranges: DataFrame, weights: Sequence[int], max_epochs: int) -> DataFrame:
    """One row a source. Sources fill up in the order of the level at which they reach their cap; the level of the first one
    that stays below its cap is the level of all the rest."""
    listed = F.array(*[F.lit(int(w)) for w in weights])
    sources = ranges.groupBy("__group").agg(F.sum("__words").alias("mix_source_size"))
    sources = sources.withColumn("__w", listed[(F.row_number().over(Window.orderBy("__group")) - 1) % len(weights)].cast("long"))
    sources = sources.withColumn("__cap", F.col("mix_source_size") * max_epochs)
    order = Window.orderBy(F.col("__cap") / F.col("__w"), "__group")
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = lambda of, c: F.sum(of).over(everything) - F.coalesce(F.sum(c).over(before), F.lit(0))
    sources = sources.withColumns({"__level": left("mix_source_size", "__cap").cast("double") / left("__w", "__w"), "__at": F.row_number().over(order)})
    sources = sources.withColumn("__full", F.col("__level") >= F.col("__cap") / F.col("__w"))
    level = F.min(F.when(~F.col("__full"), F.struct("__at", "__level"))).over(everything)["__level"]
    target = F.when(F.col("__full"), F.col("__cap").cast("double")).otherwise(F.col("__w") * F.col("__shared"))
    return sources.withColumn("__shared", level).select("__group", "mix_source_size", target.alias("mix_target"))


def draw(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of the mix: a document as often as it is taken whole, then its first words if the cut lies in it.
    mixed: from mix_sources; its four columns go, others stay whatever their names. Documents without words are never taken."""
    whole, rest = F.expr("mix_taken div mix_size"), F.expr("mix_taken % mix_size")
    none = F.array().cast("array<long>")
    copies = F.when(F.col("mix_size") > 0, F.concat(F.array_repeat(F.lit(-1).cast("long"), whole.cast("int")), F.when(rest > 0, F.array(rest)).otherwise(none))).otherwise(none)
    columns = [c for c in mixed.columns if c not in OUTPUTS]
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row")
    drawn = mixed.select(row, F.explode(copies).alias("__take"))
    text = F.col("__row").getField(text_col)
    first = F.regexp_extract(text, r"^[\x20\x09-\x0D]*", 0)
    words = F.slice(F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), 1), 1, F.greatest(F.col("__take"), F.lit(0)).cast("int"))
    taken = F.when(F.col("__take") < 0, text).otherwise(F.concat(first, F.array_join(words, "")))
    return drawn.select(*[(taken if c == text_col else F.col("__row").getField(c)).alias(c) for c in columns])


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    mixed = mix_sources(docs)
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"))


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, coalesce(text, '') AS text, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS k
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s, CAST(sum(size) AS BIGINT) * 3 AS cap,
         ([5, 2, 1])[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS w
  FROM sized GROUP BY source),
levels AS (
  SELECT *, CAST(sum(s) OVER () - coalesce(sum(cap) OVER o, 0) AS DOUBLE) / CAST(sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS DOUBLE) AS lev
  FROM sources WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, s, CASE WHEN lev >= CAST(cap AS DOUBLE) / w THEN CAST(cap AS DOUBLE)
         ELSE w * (SELECT max(lev) FROM levels WHERE lev < CAST(cap AS DOUBLE) / w) END AS target
  FROM levels),
placed AS (
  SELECT d.doc_id, d.size, t.s, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id NULLS FIRST, d.text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, s AS source_size, target,
       CAST(CASE WHEN s > 0 THEN (budget // s) * size + greatest(0, least(size, budget % s - place)) ELSE 0 END AS BIGINT) AS taken
FROM placed
"""
