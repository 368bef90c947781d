"""Near-duplicates at a likeness of word shingles: SimHash links first, then all that SimHash at a few bits can't reach.

A text is the set of its shingles: runs of SHINGLE words, hashed to 64 bits; a shorter text is one shingle. Two texts link if the
shared shingles are at least LIKE of all of theirs. Candidates come in two steps, and every one is compared set by set:

* the sets' SimHash fingerprints that differ in few bits, by the pigeonring filter of the SimHash operator. This joins near
  copies, so that what follows needs no pair inside a group that stands;
* prefix filtering for the rest, as sets of likeness LIKE can differ in a dozen bits, which no segment filter finds at a bearable
  cost: all sets are put in one order, and of n shingles the first n - ceil(LIKE n) + 1 are keys, so that sets that link share a
  key. The order puts shingles last that many documents of a sample have; the sample decides how many candidates there are, never
  which links are found. By their sizes and the places of the key most candidates are ruled out, and by sketches nearly all others:
  bits that a set's shingles flip in turn, of which two sets differ in no more than they have shingles of their own.

Texts with equal sets are one row throughout. Where more than CROWD sets share a key, each is compared with the least first; then
only sets that no link has joined so far are compared with each other. So a large group of near copies makes no square of pairs,
and no link that would join two groups is lost.

Null and empty texts have the empty set, which links only to itself. Null ids take part and count as larger than any other. Equal
rows count once, texts of any length are taken whole, other columns stay whatever their names, an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import Scratch, small_batches
from .components import components
from .simhash import keep_first, majority
from .simhash import links as simhash_links

SHINGLE, LIKE = 5, 0.8
#: From this many sets on, a key's sets are compared with its least first.
CROWD = 16
#: Documents that are sampled for the order, and shingles that it puts last.
SAMPLE, COMMON = 20_000, 1 << 17
#: Bits of a sketch.
SKETCH = 1024

_ODD = 0x9E3779B97F4A7C15


def shingles(text: str | None, words: int = SHINGLE) -> np.ndarray:
    """The set of a text: its different shingle hashes, ascending. Words are parted by ASCII white space; A to Z count as a to z."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    size = min(words, len(h))
    mixed = np.zeros(len(h) - size + 1, np.uint64)
    for i in range(size):
        mixed = mixed * np.uint64(_ODD) + h[i : i + len(mixed)]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    return np.unique(mixed ^ mixed >> np.uint64(32))


def _mapped(rows: DataFrame, of: Callable[[np.ndarray], tuple], ddl: str, words: int) -> DataFrame:
    """rows without text, and what `of` makes of the text's set."""
    names = [x.split()[0] for x in ddl.split(", ")]
    kinds = [pa.list_(pa.int64()) if "array" in x else pa.int32() if x.endswith(" int") else pa.int64() for x in ddl.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [c for c in batch.schema.names if c != "text"]
            made = list(zip(*[of(shingles(x.as_py(), words)) for x in batch.column("text")], strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([*map(batch.column, held), *[pa.array(c, k) for c, k in zip(made, kinds, strict=True)]], names=[*held, *names])

    small_batches(rows.sparkSession)
    kept = rows.drop("text").schema
    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), ddl]))


def _common(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several documents of a sample have, ascending, and how many have them. At most COMMON, whatever the input."""
    n = docs.count()
    sample = docs.filter(F.pmod(F.xxhash64("text", F.lit(1)), F.lit(max(1, n // SAMPLE))) == 0).select("text").distinct()
    counts = _mapped(sample, lambda s: (s.view(np.int64),), "s array<long>", words).select(F.explode("s").alias("s")).groupBy("s").count()
    found = counts.filter("count > 2").orderBy(F.desc("count"), "s").limit(COMMON).toPandas()
    keys = found["s"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], found["count"].to_numpy(np.int64)[order]


def sketch(s: np.ndarray) -> np.ndarray:
    """SKETCH bits as longs: a bit is set where an odd number of the shingles fall on it."""
    odd = np.bincount((s % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def prefix(s: np.ndarray, common: tuple[np.ndarray, np.ndarray], like: float = LIKE) -> np.ndarray:
    """The keys of a set, in the order of all sets."""
    if not len(s):
        return s
    weight = np.zeros(len(s), np.int64)
    if len(common[0]):
        at = np.minimum(np.searchsorted(common[0], s), len(common[0]) - 1)
        weight = np.where(common[0][at] == s, common[1][at], 0)
    return s[np.lexsort((s, weight))][: len(s) - ceil(like * len(s) - 1e-9) + 1]


def _verified(keep: Scratch, step: str, pairs: DataFrame, sets: DataFrame, docs: DataFrame, like: float, words: int) -> DataFrame:
    """Of pairs (a, b) of sets those that link. Only documents in a pair are read into sets again."""
    seen = [sets.select(F.col("sid").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"bits_{k}")) for k in "ab"]
    pairs = pairs.select("a", "b").distinct().join(seen[0], "a").join(seen[1], "b")
    apart = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    pairs = keep.table(pairs.filter(apart <= F.lit((1 - like) / (1 + like)) * (F.col("n_a") + F.col("n_b")) + 1e-6).select("a", "b"), f"pairs-{step}")
    asked = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
    asked = sets.join(asked, "sid").select("sid", F.col("least.id").alias("i"), F.col("least.content").alias("c"))
    texts = docs.join(asked, F.col("id").eqNullSafe(F.col("i")) & (F.col("content") == F.col("c"))).select("sid", "text").dropDuplicates(["sid"])
    whole = keep.table(_mapped(texts, lambda s: (s.view(np.int64),), "s array<long>", words), f"sets-{step}")
    both = pairs.join(whole.select(F.col("sid").alias("a"), F.col("s").alias("x")), "a").join(whole.select(F.col("sid").alias("b"), F.col("s").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    linked = keep.table(both.filter(shared >= F.lit(like) * (F.size("x") + F.size("y") - shared) - 1e-9).select("a", "b"), f"linked-{step}")
    keep.drop(f"pairs-{step}", f"sets-{step}")
    return linked


def _met(rows: DataFrame, others: DataFrame, like: float) -> DataFrame:
    """Pairs of rows (sid, n, key, at) and others of the same key that can link if the key is the first that they share."""
    b = others.select("key", *[F.col(c).alias(f"{c}_b") for c in others.columns if c != "key"])
    near = rows.join(b, "key").filter((F.col("sid") < F.col("sid_b")) & (F.least("n", "n_b") >= F.lit(like) * F.greatest("n", "n_b") - 1e-9))
    most = F.least(F.col("n") - F.col("at"), F.col("n_b") - F.col("at_b"))
    return near.filter(most >= F.lit(like / (1 + like)) * (F.col("n") + F.col("n_b")) - 1e-6)


def _near_prints(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets: those of equal fingerprints by the least of these, and the least of those of near fingerprints."""
    of = sets.groupBy("fp").agg(F.min("sid").alias("first"))
    equal = sets.select("sid", "fp").join(of, "fp").filter("sid != first").select(F.col("first").alias("a"), F.col("sid").alias("b"))
    near = simhash_links(of.select("fp")).select(F.col("a").alias("x"), F.col("b").alias("y"))
    firsts = [of.select(F.col("fp").alias(k), F.col("first").alias(f"of_{k}")) for k in "xy"]
    return equal.unionByName(near.join(firsts[0], "x").join(firsts[1], "y").select(F.least("of_x", "of_y").alias("a"), F.greatest("of_x", "of_y").alias("b")))


def _leasts(docs: DataFrame, like: float, words: int, crowd: int) -> DataFrame:
    """docs: id, text, content. (sid, least, root): each set, its first document and the least set that links reach from it."""
    keep = Scratch(docs.sparkSession, "shingles")
    common = _common(docs, words)

    def signed(s: np.ndarray) -> tuple:
        digest = np.array([xxhash.xxh64_intdigest(s.tobytes())], np.uint64).view(np.int64)[0]
        return int(digest), len(s), np.array([majority(s)], np.uint64).view(np.int64)[0], prefix(s, common, like).view(np.int64), sketch(s)

    found = _mapped(docs, signed, "sid long, n int, fp long, keys array<long>, sketch array<long>", words)
    least = F.min(F.struct(F.isnull("id").alias("none"), "id", "content")).alias("least")
    sets = keep.table(found.groupBy("sid").agg(least, *[F.first(c).alias(c) for c in ("n", "fp", "keys", "sketch")]), "signed")
    near = _verified(keep, "prints", _near_prints(sets), sets, docs, like, words)
    joined = keep.table(components(near), "joined")

    keyed = sets.select("sid", "n", F.posexplode("keys").alias("at", "key"))
    of_key = Window.partitionBy("key")
    shared = keep.table(keyed.withColumns({"held": F.count("*").over(of_key), "first": F.min("sid").over(of_key)}).filter("held > 1"), "shared")

    few, many = shared.filter(F.col("held") <= crowd).select("sid", "n", "key", "at"), shared.filter(F.col("held") > crowd)
    stars = _met(many.filter("sid = first").select("sid", "n", "key", "at"), many.select("sid", "n", "key", "at"), like)
    pairs = _met(few, few, like).select(F.col("sid").alias("a"), F.col("sid_b").alias("b")).unionByName(stars.select(F.col("sid").alias("a"), F.col("sid_b").alias("b"))).distinct()
    known = [joined.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}")) for k in "ab"]
    apart = pairs.join(known[0], "a", "left").join(known[1], "b", "left").filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
    links = near.unionByName(_verified(keep, "keys", apart.select("a", "b"), sets, docs, like, words))
    roots = keep.table(components(links), "roots")
    rooted = many.select("sid", "n", "key", "at").join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    # Only keys whose sets are in several groups are left.
    open_keys = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key")
    rooted = keep.table(rooted.join(open_keys, "key"), "rooted")
    rest = _met(rooted, rooted, like).filter("root != root_b").select(F.col("sid").alias("a"), F.col("sid_b").alias("b"))
    more = _verified(keep, "rest", rest, sets, docs, like, words)
    if not more.isEmpty():
        roots = keep.table(components(links.unionByName(more)), "all-roots")
    keep.drop("shared", "rooted", "joined")
    return sets.select("sid", "least").join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", like: float = LIKE, words: int = SHINGLE, crowd: int = CROWD) -> DataFrame:
    """docs with one document of each group that links join: the one with the smallest id (rows without an id come last; between
    texts of the same id a hash decides)."""
    inner = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("content"))
    return keep_first(docs, _leasts(inner, like, words, crowd).groupBy("root").agg(F.min("least").alias("first")), id_col, text_col)
