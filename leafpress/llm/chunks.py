"""Document fingerprints by content-defined chunking.

A gear hash over the last WINDOW bytes marks possible cuts: many after the normal chunk size, few before it (normalised
chunking), none below the least size, and a forced one at the largest. As a cut depends on the bytes near it alone, text that
moves keeps its chunks. A fingerprint is the set of chunk digests (64 bits), each weighted by the bytes it covers; two fingerprints are as
alike as the weight they share against the lighter of the two.

Null and empty texts have the empty fingerprint, which is like itself (1) and unlike any other (0). Equal texts have equal
fingerprints. For neighbours, documents are ordered by descending id, then by a hash of the text; null ids come last; the first
follows the last, and a lone document follows itself. Repeated rows follow each other. Ids are whole numbers. Texts
of any length are chunked whole; a task holds a few hundred rows and their successors at a time. Columns other than the id and the
text aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import documents, plus, sealed, small_batches, unsealed

WINDOW = LEAST = 16
NORMAL, LARGEST = 48, 192
#: A cut is possible where these bits of the hash are zero: before the normal size, and after it.
HARD, EASY = np.uint32(0x7F << 16), np.uint32(0x0F << 16)


def _gear() -> np.ndarray:
    """A random number for each byte, by rule."""
    return np.array([xxhash.xxh32_intdigest(bytes([b]), 7) for b in range(256)], np.uint32)


GEAR = _gear()


def cuts(texts: list[bytes]) -> list[list[int]]:
    """Ends of the chunks of each text. All texts are hashed in one go: no chunk is shorter than the window, so no cut sees a
    byte of the text before."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    h = GEAR[data]
    step = 1
    while step < WINDOW:
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    # A cut stands after its byte.
    easy = np.flatnonzero((h & EASY) == 0)
    hard = (easy[(h[easy] & HARD) == 0] + 1).tolist()
    easy = (easy + 1).tolist()
    out, start = [], 0
    for text in texts:
        end, found = start + len(text), []
        at = start
        while at < end:
            stop = min(at + LARGEST, end)
            if stop - at > LEAST:
                i = bisect_left(hard, at + LEAST)
                if i < len(hard) and hard[i] < min(at + NORMAL, stop):
                    stop = hard[i]
                else:
                    i = bisect_left(easy, at + NORMAL)
                    if i < len(easy) and easy[i] < stop:
                        stop = easy[i]
            found.append(stop - start)
            at = stop
        out.append(found)
        start = end
    return out


def fingerprints(texts: list[bytes]) -> list[dict[str, int]]:
    """For each text its chunk digests and the bytes each covers."""
    out = []
    for text, ends in zip(texts, cuts(texts), strict=True):
        of, at = {}, 0
        for end in ends:
            key = xxhash.xxh64_hexdigest(text[at:end])
            of[key] = of.get(key, 0) + end - at
            at = end
        out.append(of)
    return out


def written(fingerprint: dict[str, int]) -> str:
    return " ".join([f"{k}:{n}" for k, n in fingerprint.items()])


def read(fingerprint: str) -> dict[str, int]:
    return {k: int(n) for k, _, n in (x.partition(":") for x in fingerprint.split())}


def likeness(a: dict[str, int], b: dict[str, int]) -> float:
    if not a or not b:
        return float(not a and not b)
    if len(b) < len(a):
        a, b = b, a
    shared = sum([min(n, m) for k, n in a.items() if (m := b.get(k))])
    return min(1.0, shared / min(sum(a.values()), sum(b.values())))


def with_fingerprint(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs and fingerprint: digest:bytes of each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = fingerprints([(x.as_py() or "").encode() for x in batch.column("__text")])
            names = [c for c in batch.schema.names if c != "__text"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(map(written, found), pa.string())], names=[*names, "fingerprint"])

    small_batches(docs.sparkSession, 500)
    inner = sealed(docs, {"__text": F.col(text_col)}, ["fingerprint"])
    return unsealed(inner.mapInArrow(run, plus(inner.drop("__text").schema, "fingerprint string")), F.col("fingerprint"))


def in_neighbour_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, text, deal, extra) sorted so that in a task each row follows its predecessor: every deal holds a stretch of
    the order and, as its last rows (extra true), the first id of the next stretch. The stretches are bounded by quantiles of
    the id, so that the same rows always fall into the same stretch; null ids are dealt by the text's hash."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.bitwise_not(F.col(id_col).cast("long")).alias("nid"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("th"))
    bounds = np.array(sorted({int(x) for x in rows.approxQuantile("nid", [i / n for i in range(1, n)], 0.25 / n)} if n > 1 else set()), np.int64)

    @F.pandas_udf("long")
    def stretch(nid: pd.Series, th: pd.Series) -> pd.Series:
        by_id = np.searchsorted(bounds, nid.fillna(0).to_numpy(np.int64), side="right")
        by_hash = len(bounds) + 1 + ((th.to_numpy(np.int64) >> 16) + (1 << 47)) * n // (1 << 48)
        return pd.Series(np.where(nid.isna(), by_hash, by_id))

    rows = rows.withColumn("deal", stretch("nid", "th"))
    # One row a stretch.
    heads = rows.groupBy("deal").agg(F.min(F.struct(F.isnull("nid").alias("none"), "nid", "th")).alias("head"))
    every = Window.orderBy("deal")
    heads = heads.select("deal", "head.nid", "head.th", F.coalesce(F.lag("deal").over(every), F.max("deal").over(Window.partitionBy())).alias("to"))
    heads = heads.select(F.col("deal").alias("d"), F.col("nid").alias("i"), F.col("th").alias("h"), "to")
    # At most 2 n + 1 rows, so they can go to every task whatever the input.
    extras = rows.join(F.broadcast(heads), (F.col("deal") == F.col("d")) & F.col("nid").eqNullSafe(F.col("i")) & (F.col("th") == F.col("h")))
    both = rows.select("nid", "text", "th", "deal", F.lit(False).alias("extra")).unionByName(extras.select("nid", "text", "th", F.col("to").alias("deal"), F.lit(True).alias("extra")))
    dealt = both.repartitionByRange(n, "deal").sortWithinPartitions("deal", "extra", F.isnull("nid"), "nid", "th")
    return dealt.select(F.bitwise_not("nid").alias("id"), "text", "deal", "extra")


def op8_chunk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = in_neighbour_order(documents(spark, sf_dir))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        """(id, text, fingerprint, next text, next fingerprint) of the documents, a batch at a time."""
        last = None
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            rows = zip(batch.column("id").to_pylist(), texts, fingerprints([t.encode() for t in texts]), batch.column("deal").to_pylist(), batch.column("extra").to_pylist(), strict=True)
            out = []
            for row in rows:
                if last is not None and not last[4] and last[3] == row[3]:
                    out.append((*last[:3], row[1], row[2]))
                last = row
            yield out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in pairs(batches):
            edits = []
            for _, text, _, follower, _ in found:
                k = len(text) // 3
                edits.append((text[: len(text) - k] + follower[:k]).encode())
            rows = [(i, len(t), sha256(e).hexdigest(), written(p), written(q), likeness(p, q), likeness(p, f)) for (i, t, p, _, f), e, q in zip(found, edits, fingerprints(edits), strict=True)]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    small_batches(spark, 500)
    return ordered.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
