"""SimHash near-duplicates by pigeonring filtering.

A text's fingerprint has a bit set where more than half of its shingles' hashes have it. Two fingerprints link at LINK_BITS or
fewer differing bits. The 64 bits form a ring of three segments. If at most 2 bits differ, then from some segment on, the
chain of that segment and its successors stays within its share of the budget at each step: 0 differences in the first, at most
1 in the first two, at most 2 in all three. So:

* fingerprints that agree on a whole segment meet (one row for each start of a chain), and the chain's second sum is tested
  before the full Hamming distance;
* where more than CROWD fingerprints agree on a segment, they meet again only if the chain's second segment also stays within
  its budget: the key is the first segment and the second with one bit masked, for each bit;
* where more than CROWD agree even there, the key masks one bit in each of the second and third segment, or two in the third,
  for each choice. Such keys hold exactly the fingerprints that link to each other, and each links to the least.

No step makes all pairs of a large group, and no link is lost. Copies of a fingerprint are one row throughout.

Null and empty texts have the fingerprint zero, which links like any other. Null ids take part and count as larger than any
other. Repeated rows are kept. An empty table gives an empty result. Other columns of the input aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import WORD, cut, documents, plus, sealed, small_batches, unsealed
from .components import components

LINK_BITS, SHINGLE = 2, 3
#: From this many fingerprints on, a group is split by the next segment of the chain.
CROWD = 64
#: First bit and number of bits of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))

_words = re.compile(WORD).findall
_lower = {c: c + 32 for c in range(65, 91)}


def text_fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = _words((text or "").translate(_lower))
    if not words:
        return 0
    parts = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    return majority(np.fromiter(map(_hash, parts), np.uint64, len(parts)))


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have; 0 for none."""
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        block = hashes[at : at + (1 << 14)]
        set_bits += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view(np.uint64)[0])


def _hash(part: str) -> int:
    return xxhash.xxh64_intdigest(part.encode(), 42)


def with_fingerprint(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """docs and simhash: the fingerprint as a signed long."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((text_fingerprint(x.as_py(), shingle) for x in batch.column("__text")), np.uint64, batch.num_rows)
            columns = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "__text"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(values.view(np.int64))], names=[*(n for n in batch.schema.names if n != "__text"), "simhash"])

    small_batches(docs.sparkSession)
    inner = sealed(docs, {"__text": F.col(text_col)}, ["simhash"])
    schema = plus(inner.drop("__text").schema, "simhash long")
    return unsealed(inner.mapInArrow(prints, schema), F.col("simhash"))


def _segment(c: Column, k: int) -> Column:
    start, bits = SEGMENTS[k % 3]
    return F.shiftrightunsigned(c, start).bitwiseAND(F.lit((1 << bits) - 1))


def _masks(k: int, n: int) -> Column:
    """All masks that clear n bits of segment k."""
    bits = SEGMENTS[k % 3][1]
    full = (1 << bits) - 1
    one = [full ^ 1 << i for i in range(bits)]
    return F.array(*[F.lit(m).cast("long") for m in (one if n == 1 else [a & b for i, a in enumerate(one) for b in one[:i]])])


def links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """prints: distinct fingerprints fp. Pairs (a, b), a < b, enough of them to connect all that differ in LINK_BITS or fewer:
    all such pairs but those of crowded keys, where each fingerprint is linked to the least of its key."""
    starts = prints.select("fp", F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("start"))
    pick = lambda of: F.when(F.col("start") == 0, of(0)).when(F.col("start") == 1, of(1)).otherwise(of(2))
    chained = starts.select("fp", "start", *[pick(lambda k, j=j: _segment(F.col("fp"), k + j)).alias(f"s{j}") for j in range(3)])
    first = chained.withColumn("key", F.col("start") * (1 << 22) + F.col("s0"))

    def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        many = rows.groupBy("key").count().filter(F.col("count") > crowd).select("key", F.lit(True).alias("many"))
        marked = rows.join(many, "key", "left")
        return marked.filter(F.col("many").isNull()).drop("many"), marked.filter(F.col("many")).drop("many")

    def met(rows: DataFrame) -> DataFrame:
        """Pairs of a key that pass the chain's budgets and then the full check."""
        b = rows.select("key", F.col("fp").alias("b"), F.col("s1").alias("t1"))
        near = rows.join(b, "key").filter((F.col("fp") < F.col("b")) & (F.bit_count(F.col("s1").bitwiseXOR(F.col("t1"))) <= 1))
        return near.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= LINK_BITS).select(F.col("fp").alias("a"), "b")

    few, many = split(first)
    masked = many.withColumn("m1", F.explode(pick(lambda k: _masks(k + 1, 1)))).withColumn("key", F.xxhash64("start", "s0", "m1", F.col("s1").bitwiseAND(F.col("m1"))))
    few_masked, many_masked = split(masked)
    exact = many_masked.drop("key", "m1").distinct()
    both = F.transform(pick(lambda k: _masks(k + 1, 1)), lambda m: F.struct(m.alias("a"), F.lit(1).alias("n")))
    none = F.array(F.struct(F.lit(-1).cast("long").alias("a"), F.lit(2).alias("n")))
    exact = exact.withColumn("m1", F.explode(F.concat(both, none)))
    exact = exact.withColumn("m2", F.explode(F.when(F.col("m1.n") == 1, pick(lambda k: _masks(k + 2, 1))).otherwise(pick(lambda k: _masks(k + 2, 2)))))
    # The key of a clique must not collide, so it is kept whole and not hashed.
    exact = exact.select("fp", F.struct("start", "s0", "m1.a", F.col("s1").bitwiseAND(F.col("m1.a")).alias("x1"), "m2", F.col("s2").bitwiseAND(F.col("m2")).alias("x2")).alias("key"))
    least = exact.groupBy("key").agg(F.min("fp").alias("least"))
    stars = exact.join(least, "key").filter(F.col("least") < F.col("fp")).select(F.col("least").alias("a"), F.col("fp").alias("b"))
    return met(few).unionByName(met(few_masked)).unionByName(stars).distinct()


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, content (a hash of the text), simhash, root (least fingerprint of the component), component."""
    inner = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("content"), F.col(text_col).alias("text"))
    signed = cut(with_fingerprint(inner).select("id", "content", "simhash"))
    prints = signed.groupBy("simhash").agg(F.min("id").alias("least"))
    found = components(links(prints.select(F.col("simhash").alias("fp"))))
    roots = cut(prints.join(found, F.col("simhash") == F.col("node"), "left").select("simhash", "least", F.coalesce("root", "simhash").alias("root")))
    least = roots.groupBy("root").agg(F.min("least").alias("component"))
    return signed.join(roots.select("simhash", "root").join(least, "root"), "simhash")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id_col, simhash, component: the smallest id that links reach from it, itself included."""
    return _grouped(docs, id_col, text_col).select(F.col("id").alias(id_col), "simhash", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component: the one with the smallest id (rows without an id come last; between texts of
    the same id a hash decides)."""
    first = _grouped(docs, id_col, text_col).groupBy("root").agg(F.min(F.struct(F.isnull("id").alias("none"), "id", "content")).alias("first"))
    return keep_first(docs, first, id_col, text_col)


def keep_first(docs: DataFrame, first: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that first names by id and content (a hash of the text); of equal rows one."""
    first = first.select(F.col("first.id").alias("keep_id"), F.col("first.content").alias("keep_content"))
    inner = sealed(docs, {"__id": F.col(id_col), "__content": F.xxhash64(F.col(text_col))}, [])
    kept = inner.join(first, F.col("__id").eqNullSafe(F.col("keep_id")) & (F.col("__content") == F.col("keep_content")), "left_semi")
    nth = F.row_number().over(Window.partitionBy("__id", "__content").orderBy(F.lit(0)))
    return unsealed(kept.withColumn("__nth", nth).filter("__nth = 1"))


def op9_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicates(documents(spark, sf_dir))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
