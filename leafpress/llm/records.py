"""Token ids as length-delimited binary records.

A record is a little-endian 64-bit length, the masked CRC-32C of those 8 bytes, the payload, the payload's masked CRC-32C, and a
line feed. A payload is a format byte (1: an id follows), the 64-bit id or 8 zero bytes, the bytes that a token takes (2 or 4),
and the tokens. Files hold records in ascending order of id (null last), shard by shard in the order of the file names' numbers.
An index beside them gives shard file, byte offset and length of every record, so that records can be taken in any order and place.

Spark's own file sources move the bytes, so any file system that Spark knows will do, and a lost task is written again
under Spark's commit rules. Null texts count as empty: their record holds the end id alone. Repeated ids stay, ordered by text.
An empty table writes no record. A record whose checksum fails is an error that names file and offset. Columns other than the id
and the text aren't read, whatever their names. A file holds about SHARD_BYTES of text and one more document at most, and is one
row when it is read; a document is never cut. Only plain byte-level BPE files are taken (no normaliser, the library's own pattern).
"""

from __future__ import annotations

import json
import re
import struct
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from uuid import uuid4
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import documents, shared_dir, small_batches, table
from .bpe import byte_symbols
from .pieces import finder

END_ID = 2
#: A shard takes about so many bytes of text.
SHARD_BYTES = 64 << 20
#: Token pieces that a Python worker remembers at most.
REMEMBER = 400_000
#: The reversed CRC-32C polynomial, the mask's constant, and the pieces pattern of byte-level BPE.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of a lane in the checksum of many records.
LANE = 256


def _zeros_fed(crc: np.ndarray, bits: int) -> np.ndarray:
    for _ in range(bits):
        crc = np.where(crc & 1, crc >> 1 ^ np.uint32(POLYNOMIAL), crc >> 1).astype(np.uint32)
    return crc


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The checksum after two more bytes, and what a lane of zeros makes of each byte of a checksum."""
    two = _zeros_fed(np.arange(1 << 16, dtype=np.uint32), 16)
    over = np.arange(256, dtype=np.uint32)[None, :] << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    for _ in range(LANE // 2):
        over = two[over & 0xFFFF] ^ over >> 16
    return two, over


def crc32c(parts: list[bytes]) -> np.ndarray:
    """CRC-32C of each of many byte strings of 4 bytes or more, all at once: each is cut into lanes from its end, all lanes go
    forward together, and each string's lanes are joined in order."""
    if not parts:
        return np.zeros(0, np.uint32)
    two, over = _tables()
    lengths = np.array([len(p) for p in parts])
    lanes = -(-lengths // LANE)
    ends = np.cumsum(lanes)
    data = np.zeros((int(ends[-1]), LANE), np.uint8)
    flat = data.reshape(-1)
    for p, n, e in zip(parts, lengths.tolist(), ends.tolist(), strict=True):
        first = e * LANE - n
        flat[first : e * LANE] = np.frombuffer(p, np.uint8)
        flat[first : first + 4] ^= 0xFF
    words = np.ascontiguousarray(data.view("<u2").T)
    crc = np.zeros(len(data), np.uint32)
    for w in words:
        crc = two[(crc ^ w) & 0xFFFF] ^ crc >> 16
    out = np.zeros(len(parts), np.uint32)
    order = np.argsort(-lanes, kind="stable")
    starts, sorted_lanes = (ends - lanes)[order], lanes[order]
    for k in range(int(lanes.max())):
        live = order[: np.searchsorted(-sorted_lanes, -k, side="left")]
        c = out[live]
        c = over[0][c & 255] ^ over[1][c >> 8 & 255] ^ over[2][c >> 16 & 255] ^ over[3][c >> 24]
        out[live] = c ^ crc[starts[: len(live)] + k]
    return out ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return (crc >> 15 | crc << 17) + np.uint32(MASK)


def frame(payloads: list[bytes]) -> list[bytes]:
    heads = [struct.pack("<Q", len(p)) for p in payloads]
    of_head, of_payload = masked(crc32c(heads)).tolist(), masked(crc32c(payloads)).tolist()
    return [b"".join((h, struct.pack("<I", a), p, struct.pack("<I", b))) for h, a, p, b in zip(heads, of_head, payloads, of_payload, strict=True)]


def unframe(data: bytes, where: str = "") -> list[tuple[int, bytes]]:
    """(offset, payload) of each record of a file."""
    found, at = [], 0
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError(f"{where}: cut record at {at}")
        (n,) = struct.unpack_from("<Q", data, at)
        if at + 17 + n > len(data) or data[at + 16 + n] != 10:
            raise ValueError(f"{where}: cut record at {at}")
        found.append((at, n))
        at += 17 + n
    for block in range(0, len(found), 512):
        part = found[block : block + 512]
        heads, bodies = [data[a : a + 8] for a, _ in part], [data[a + 12 : a + 12 + n] for a, n in part]
        for (a, n), h, b in zip(part, masked(crc32c(heads)).tolist(), masked(crc32c(bodies)).tolist(), strict=True):
            if struct.unpack_from("<I", data, a + 8)[0] != h or struct.unpack_from("<I", data, a + 12 + n)[0] != b:
                raise ValueError(f"{where}: wrong checksum at {a}")
    return [(a, data[a + 12 : a + 12 + n]) for a, n in found]


class Pieces:
    """A byte-level BPE tokenizer of the tokenizers library, with its pieces found here and remembered up to a bound."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex") or spec["model"].get("continuing_subword_prefix") or spec["model"].get("end_of_word_suffix"):
            raise ValueError(f"{path}: not a plain byte-level BPE tokenizer")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.added = added
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")").split if added else lambda x: [x]
        self.find = finder(PIECES)
        self.width = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.known = Known(self)
        self.tokenize, self.symbols = self.tokenizer.model.tokenize, str.maketrans(dict(enumerate(byte_symbols())))

    def ids(self, piece: str) -> list[int]:
        if piece in self.added:
            return [self.added[piece]]
        return [t.id for t in self.tokenize(piece.encode().decode("latin-1").translate(self.symbols))]

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each text as little-endian integers of 2 or 4 bytes."""
        out = []
        for text in texts:
            parts = self.split(text) if text and any(a in text for a in self.added) else [text or ""]
            pieces = [p for i, part in enumerate(parts) for p in ([part] if i % 2 else self.find(part))] if len(parts) > 1 else self.find(parts[0])
            out.append(b"".join(map(self.known.__getitem__, pieces)))
        return out


class Known(dict):
    """Ids of the pieces met so far; a new one goes through the tokenizers library's model."""

    def __init__(self, of: Pieces):
        self.of = of

    def __missing__(self, piece: str) -> bytes:
        found = array(self.of.width, self.of.ids(piece)).tobytes()
        if len(piece) <= 64:
            if len(self) >= REMEMBER:
                self.clear()
            self[piece] = found
        return found


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Pieces(path)


def write_records(docs: DataFrame, top: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Encodes docs with the tokenizer at path into record files in top/records and their index in top/index."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    order = [F.isnull("id"), F.col("id"), F.col("text")]
    sorted_rows = rows.repartitionByRange(shards, F.isnull("id"), F.col("id")).sortWithinPartitions(*order)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        width = array(bpe.width).itemsize
        end = array(bpe.width, [end_id]).tobytes()
        for batch in batches:
            ids = batch.column("id").to_pylist()
            coded = bpe.encode(x.as_py() for x in batch.column("text"))
            payloads = [struct.pack("<BqB", i is not None, i or 0, width) + c + end for i, c in zip(ids, coded, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(frame(payloads), pa.binary())], names=["record"])

    small_batches(spark, 500)
    # The writer takes a string's bytes as they are; the line feed is the record's last byte.
    sorted_rows.mapInArrow(encode, "record binary").select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").text(f"{top}/records")
    entries = _files(spark, top).mapInArrow(_walk, "file string, offset long, length long, id long")
    entries.write.parquet(f"{top}/index")


def _files(spark: SparkSession, top: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{top}/records").select("path", "content")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            data, at, rows = content.as_py(), 0, []
            while at < len(data):
                n = struct.unpack_from("<Q", data, at)[0]
                known, i = struct.unpack_from("<Bq", data, at + 12)
                rows.append((at, 17 + n, i if known else None))
                at += 17 + n
            offsets, lengths, ids = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array([path.as_py().rpartition("/")[2]] * len(rows), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.int64())], names=["file", "offset", "length", "id"])


def read_records(spark: SparkSession, top: str) -> DataFrame:
    """One row a record, by the files: shard (order of the file), place (order in it), id, tokens (array<int>)."""
    return _files(spark, top).mapInArrow(_rows(lambda ids: ids.astype(np.int32), pa.list_(pa.int32())), "shard struct<part:bigint,number:bigint>, place long, id long, tokens array<int>")


_SHARD = pa.struct([("part", pa.int64()), ("number", pa.int64())])


def _rows(of, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                name = path.as_py().rpartition("/")[2]
                found = unframe(content.as_py(), name)
                shard = _shard(name)
                for block in range(0, len(found), 512):
                    ids, values = [], []
                    for _, p in found[block : block + 512]:
                        known, i, width = struct.unpack_from("<BqB", p)
                        ids.append(i if known else None)
                        values.append(of(np.frombuffer(p, f"<u{width}", offset=10)))
                    yield pa.RecordBatch.from_arrays([pa.array([shard] * len(ids), _SHARD), pa.array(range(block, block + len(ids)), pa.int64()), pa.array(ids, pa.int64()), pa.array(values, kind)], names=["shard", "place", "id", "tokens" if kind == pa.list_(pa.int32()) else "value"])

    return run


def _shard(name: str) -> dict[str, int]:
    """The place of a file among all: its writer's partition, then its number within. Both stand at fixed places of the name: the
    job's random letters between them can look like either."""
    part, number = re.match(r"part-(\d+)-.*-c(\d+)(?:\.[a-z0-9]+)*$", name).groups()
    return {"part": int(part), "number": int(number)}


def read_shuffled(spark: SparkSession, top: str, seed: int = 0) -> DataFrame:
    """All records in a random order that seed gives: id, tokens (array<int>), turn (the hash that orders them). Each record is cut
    out of its file at the place that the index names, and its checksums are checked."""
    entries = spark.read.parquet(f"{top}/index").groupBy("file").agg(F.collect_list(F.struct("offset", "length")).alias("entries"))
    files = _files(spark, top).withColumn("file", F.regexp_extract("path", "[^/]+$", 0)).join(entries, "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content, places in zip(batch.column("file"), batch.column("content"), batch.column("entries"), strict=True):
                data, where = memoryview(content.as_buffer()), sorted((e["offset"], e["length"]) for e in places.as_py())
                for block in range(0, len(where), 512):
                    part = where[block : block + 512]
                    payloads = [unframe(bytes(data[a : a + n]), f"{name.as_py()} at {a}")[0][1] for a, n in part]
                    heads = [struct.unpack_from("<BqB", p) for p in payloads]
                    tokens = [np.frombuffer(p, f"<u{w}", offset=10).astype(np.int32) for p, (_, _, w) in zip(payloads, heads, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(part)), pa.array([a for a, _ in part], pa.int64()), pa.array([i if known else None for known, i, _ in heads], pa.int64()), pa.array(tokens, pa.list_(pa.int32()))], names=["file", "offset", "id", "tokens"])

    found = files.select("file", "content", "entries").mapInArrow(run, "file string, offset long, id long, tokens array<int>")
    found = found.withColumn("turn", F.xxhash64(F.lit(seed), F.regexp_extract("file", r"^part-(\d+)-", 1), F.regexp_extract("file", r"-c(\d+)(?:\.[a-z0-9]+)*$", 1), "offset"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return found.repartitionByRange(n, "turn").sortWithinPartitions("turn").select("id", "tokens", "turn")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = f"{shared_dir(spark)}/records-{uuid4().hex}"
    write_records(documents(spark, sf_dir), top, default_path())
    digest = _rows(lambda ids: {"n": len(ids), "crc": crc32(ids.astype("<u4").tobytes())}, pa.struct([("n", pa.int64()), ("crc", pa.int64())]))
    rows = _files(spark, top).mapInArrow(digest, "shard struct<part:bigint,number:bigint>, place long, id long, value struct<n:bigint,crc:bigint>").select("shard", "place", "id", "value.*")
    rows = table(rows, "digests")
    # One row a file: as many as the data has shards, a few bytes each.
    before = rows.groupBy("shard").agg(F.sum("n").alias("total")).select("shard", F.coalesce(F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(before, "shard").select(F.col("id").alias("doc_id"), (F.col("before") + inside).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
