"""Media columns: ISO base media files in a binary column.

probe() walks the nested boxes of a file, decodes the sample tables of its tracks, and gives codec, duration and the byte range
of every keyframe without touching the payload. wrap() stores bytes losslessly as one track of 8-bit samples.

A box is a 32-bit size, a type, and for size 1 a 64-bit size; size 0 reaches to the end. Reading never goes past the parent:
what isn't a well-formed file (also one whose numbers fit no column) gives a row with an error and no tracks, never a failed task. Null media give nulls with the
error "null". Movie fragments are not decoded (error "fragmented"). Other columns stay; only those named as an output are
replaced. Equal payloads give equal files. An empty table gives an empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import documents, plus, sealed, small_batches, unsealed

#: Bytes in a block of samples (a sample table entry), samples a second, blocks from one keyframe to the next, blocks in a chunk.
BLOCK, RATE, KEY_EVERY, CHUNK = 192, 8000, 64, 256
#: Boxes that hold boxes, on the way to the sample tables.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf"}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def wrap(payload: bytes) -> bytes:
    """An ISO media file whose one track has payload, a positive multiple of BLOCK bytes, as 8-bit PCM."""
    blocks = len(payload) // BLOCK
    if not blocks or len(payload) % BLOCK:
        raise ValueError("the payload is a positive multiple of a block")
    ticks = len(payload)
    matrix = struct.pack(">9I", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)
    chunks, last = -(-blocks // CHUNK), blocks % CHUNK
    runs = [(1, CHUNK)] * (blocks >= CHUNK) + [(chunks, last)] * bool(last)
    keys = range(1, blocks + 1, KEY_EVERY)
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"iso2")

    def moov(start: int) -> bytes:
        wide = start + len(payload) >= 1 << 32
        offsets = full(b"co64" if wide else b"stco", struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *(start + i * CHUNK * BLOCK for i in range(chunks))))
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, blocks, BLOCK)),
            full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", first, n, 1) for first, n in runs)),
            full(b"stsz", struct.pack(">II", BLOCK, blocks)),
            offsets,
        )
        minf = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
        mdia = box(b"mdia", _timed(b"mdhd", RATE, ticks, struct.pack(">HH", 0x55C4, 0)), full(b"hdlr", bytes(4), b"soun", bytes(12), b"sound\0"), minf)
        tkhd = _head(b"tkhd", struct.pack(">II", 1, 0), ticks, bytes(8) + struct.pack(">HHHH", 0, 0, 256, 0) + matrix + bytes(8), flags=3)
        mvhd = _timed(b"mvhd", RATE, ticks, struct.pack(">IHH", 1 << 16, 256, 0) + bytes(8) + matrix + bytes(24) + struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    wide = len(payload) + 8 >= 1 << 32
    head = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if wide else struct.pack(">I4s", len(payload) + 8, b"mdat")
    start = len(ftyp) + len(moov(0)) + len(head)
    if not wide and start + len(payload) >= 1 << 32:
        start += 4 * chunks
    return b"".join((ftyp, moov(start), head, payload))


def _timed(kind: bytes, rate: int, ticks: int, rest: bytes) -> bytes:
    return _head(kind, struct.pack(">I", rate), ticks, rest)


def _head(kind: bytes, before: bytes, ticks: int, rest: bytes, flags: int = 0) -> bytes:
    """A header with times: version 1 where the duration needs 64 bits."""
    if ticks < 1 << 32:
        return box(kind, struct.pack(">I", flags), bytes(8), before, struct.pack(">I", ticks), rest)
    return box(kind, struct.pack(">I", 1 << 24 | flags), bytes(16), before, struct.pack(">Q", ticks), rest)


class Malformed(ValueError):
    pass


def boxes(data: memoryview, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, first byte, end) of the content of each box between at and end."""
    while at < end:
        if end - at < 8:
            raise Malformed("cut box header")
        size, kind = struct.unpack_from(">I4s", data, at)
        start = at + 8
        if size == 1:
            if end - at < 16:
                raise Malformed("cut box header")
            size, start = struct.unpack_from(">Q", data, start)[0], at + 16
        stop = end if size == 0 else at + size
        if stop < start or stop > end:
            raise Malformed(f"box {kind!r} of impossible size")
        yield kind, start, stop
        at = stop


def _table(data: memoryview, start: int, end: int, fields: str) -> Iterator[tuple]:
    """Entries of a table that follows its count."""
    n, width = _u32(data, start, end), struct.calcsize(">" + fields)
    if start + 4 + n * width > end:
        raise Malformed("table longer than its box")
    return struct.iter_unpack(">" + fields, data[start + 4 : start + 4 + n * width])


def _u32(data: memoryview, at: int, end: int) -> int:
    if at + 4 > end:
        raise Malformed("cut field")
    return struct.unpack_from(">I", data, at)[0]


def tracks(data: bytes) -> list[dict]:
    """One dict a track: codec, timescale, duration, sizes, offsets, keys (indexes of the sync samples)."""
    view, found, fragmented = memoryview(data), [], False
    todo = [(0, len(view), None)]
    while todo:
        at, end, track = todo.pop()
        for kind, start, stop in boxes(view, at, end):
            if kind == b"trak":
                found.append(track := {"codec": "", "timescale": 0, "duration": 0})
            if kind in CONTAINERS:
                todo.append((start, stop, track))
            elif kind in (b"moof", b"mvex"):
                fragmented = True
            elif track is not None:
                _field(view, kind, start, stop, track)
    if fragmented:
        raise Malformed("fragmented")
    # A header can claim samples of one size without a table of them: all tracks together hold no more bytes than the file.
    if sum(one * n for one, n in (t.get("even", (0, 0)) for t in found)) > len(view):
        raise Malformed("more samples than bytes")
    for t in found:
        _samples(t, len(view))
    return found


def _field(view: memoryview, kind: bytes, start: int, stop: int, t: dict) -> None:
    if kind == b"mdhd":
        wide = _u32(view, start, stop) >> 24 == 1
        at = start + (20 if wide else 12)
        t["timescale"] = _u32(view, at, stop)
        t["duration"] = _u32(view, at + 4, stop) if not wide else _u32(view, at + 4, stop) << 32 | _u32(view, at + 8, stop)
    elif kind == b"stsd":
        _u32(view, start + 4, stop)
        t["codec"] = next((k.decode("latin-1") for k, _, _ in boxes(view, start + 8, stop)), "")
    elif kind == b"stts":
        t["times"] = list(_table(view, start + 4, stop, "II"))
    elif kind == b"stsc":
        t["runs"] = list(_table(view, start + 4, stop, "III"))
    elif kind == b"stss":
        t["sync"] = [k - 1 for (k,) in _table(view, start + 4, stop, "I")]
    elif kind in (b"stco", b"co64"):
        t["chunks"] = [c for (c,) in _table(view, start + 4, stop, "I" if kind == b"stco" else "Q")]
    elif kind == b"stsz":
        one, n = _u32(view, start + 4, stop), _u32(view, start + 8, stop)
        t.pop("sizes", None)
        t["even"] = (one, n) if one else (0, 0)
        if not one:
            t["sizes"] = [s for (s,) in _table(view, start + 8, stop, "I")]
    elif kind == b"stz2":
        bits, n = _u32(view, start + 4, stop) & 0xFF, _u32(view, start + 8, stop)
        if bits not in (4, 8, 16):
            raise Malformed("sample sizes of unknown width")
        if start + 12 + (n * bits + 7) // 8 > stop:
            raise Malformed("table longer than its box")
        if bits == 4:
            t["sizes"] = [view[start + 12 + i // 2] >> 4 if i % 2 == 0 else view[start + 12 + i // 2] & 15 for i in range(n)]
        else:
            t["sizes"] = [s for (s,) in _table(view, start + 8, stop, "B" if bits == 8 else "H")]


def _samples(t: dict, length: int) -> None:
    """Byte offset of each sample: chunks take so many samples each as the run they belong to says."""
    one, n = t.get("even", (0, 0))
    if one:
        t["sizes"] = [one] * n
    if t.get("chunks") and "sizes" not in t:
        raise Malformed("chunks without sample sizes")
    sizes, chunks, runs = t.setdefault("sizes", []), t.get("chunks", []), t.get("runs", [])
    offsets: list[int] = []
    bounds = [*(r[0] for r in runs[1:]), len(chunks) + 1][: len(runs)]
    for (first, per, _), stop in zip(runs, bounds, strict=True):
        for c in range(first - 1, stop - 1):
            if not 0 <= c < len(chunks):
                raise Malformed("run beyond the chunks")
            at = chunks[c]
            for s in sizes[len(offsets) : len(offsets) + per]:
                offsets.append(at)
                at += s
            if at > length:
                raise Malformed("sample beyond the file")
    if len(offsets) != len(sizes):
        raise Malformed("samples without a chunk")
    t["offsets"] = offsets
    t["keys"] = t.get("sync", range(len(sizes)))
    if any(not 0 <= k < len(sizes) for k in t["keys"]):
        raise Malformed("keyframe beyond the samples")


def payload(data: bytes, t: dict) -> bytes:
    """The samples of a track, in order; samples that follow each other are taken at once."""
    parts, view, i = [], memoryview(data), 0
    sizes, offsets = t["sizes"], t["offsets"]
    while i < len(sizes):
        start = end = offsets[i]
        while i < len(sizes) and offsets[i] == end:
            end += sizes[i]
            i += 1
        parts.append(view[start:end])
    return b"".join(parts)


_TRACKS = pa.list_(pa.struct([("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("samples", pa.int64()), ("keyframes", pa.list_(pa.struct([("sample", pa.int64()), ("first", pa.int64()), ("length", pa.int64())])))]))
TRACKS = "array<struct<codec:string,timescale:bigint,duration:bigint,samples:bigint,keyframes:array<struct<sample:bigint,first:bigint,length:bigint>>>>"


def described(t: dict) -> dict:
    return {"codec": t["codec"], "timescale": t["timescale"], "duration": t["duration"], "samples": len(t["sizes"]), "keyframes": [{"sample": k, "first": t["offsets"][k], "length": t["sizes"][k]} for k in t["keys"]]}


def with_media(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs and media: the text's UTF-8 bytes, padded with spaces to a positive multiple of BLOCK, as an ISO media file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = []
            for x in batch.column("__text"):
                raw = (x.as_py() or "").encode()
                files.append(wrap(raw.ljust(max(1, -(-len(raw) // BLOCK)) * BLOCK, b" ")))
            names = [c for c in batch.schema.names if c != "__text"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(files, pa.binary())], names=[*names, "media"])

    small_batches(docs.sparkSession, 500)
    inner = sealed(docs, {"__text": F.col(text_col)}, ["media"])
    return unsealed(inner.mapInArrow(run, plus(inner.drop("__text").schema, "media binary")), F.col("media"))


def probe(table: DataFrame, media_col: str = "media") -> DataFrame:
    """table and media_tracks, media_error (null for a well-formed file)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, errors = [], []
            for x in batch.column("__media"):
                try:
                    if (data := x.as_py()) is None:
                        raise Malformed("null")
                    given = pa.array([list(map(described, tracks(data)))], _TRACKS)
                    found.append(given[0].as_py())
                    errors.append(None)
                except (ValueError, struct.error, OverflowError) as e:
                    found.append(None)
                    errors.append(str(e) if isinstance(e, Malformed) else f"malformed: {e}")
            names = [c for c in batch.schema.names if c != "__media"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(found, _TRACKS), pa.array(errors, pa.string())], names=[*names, "media_tracks", "media_error"])

    small_batches(table.sparkSession, 500)
    inner = sealed(table, {"__media": F.col(media_col)}, ["media_tracks", "media_error"])
    return unsealed(inner.mapInArrow(run, plus(inner.drop("__media").schema, f"media_tracks {TRACKS}, media_error string")), F.col("media_tracks"), F.col("media_error"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest columns come from the stored files alone: the boxes are walked, the samples read by the tables."""
    stored = with_media(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column("media"):
                data = x.as_py()
                (t,) = tracks(data)
                raw, d = payload(data, t), described(t)
                ranges = sha256(repr([(k["first"], k["length"]) for k in d["keyframes"]]).encode()).hexdigest()[:16]
                out.append((len(raw), sha256(raw).hexdigest(), crc32(raw[-16:]), len(data), sha256(data).hexdigest(), f"codec={d['codec']};seconds={d['duration'] / d['timescale']:.6f};samples={d['samples']};keyframes={len(d['keyframes'])};first={d['keyframes'][0]['first']}+{d['keyframes'][0]['length']};ranges={ranges}"))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = plus(stored.drop("media").schema, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return stored.mapInArrow(run, schema)
