"""Operators against brute force, and on odd rows and empty tables."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from leafpress.llm import bpe, chat, chunks, lines, media, mixing, queries, records, simhash, suffixes, toxicity
from leafpress.llm.components import components


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_odd_and_empty_tables(spark, tables, name):
    rows = queries.QUERIES[name](spark, tables["odd"]).count()
    assert rows == (4 if name.startswith("op6") else 9)
    assert queries.QUERIES[name](spark, tables["empty"]).count() == (1 if name.startswith("op6") else 0)


def test_pipeline(spark, sf, tables):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mix", "bpe"]
    whole = entry.queries()["pipeline"](spark, sf)
    assert whole.columns == ["doc_id", "source", "n_tokens", "ids", "decoded"] and whole.count() > 100
    assert corpus_pipeline.run(spark, tables["empty"]).count() == 0
    assert corpus_pipeline.run(spark, tables["odd"]).count() > 0


# 1


def test_mix(spark, odd, empty):
    sizes = {"a": 1000, "b": 100, "c": 500, None: 400}
    rows = [(i, " ".join(["w"] * 10), s) for s, n in sizes.items() for i in range(n // 10)]
    mixed = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = {r.source: (r.t, r.taken) for r in mixed.groupBy("source").agg(F.first("mix_target").alias("t"), F.sum("mix_taken").alias("taken")).collect()}
    # Weights 5, 2, 1, 5 of 2000 words; b and null are full at three times their size, the excess goes on by weight.
    caps = {"b": 300.0}
    left = 2000 - 300
    want = {"a": left * 5 / 11, "c": left * 1 / 11, None: left * 5 / 11} | caps
    assert {k: round(v[0], 6) for k, v in got.items()} == {k: round(v, 6) for k, v in want.items()}
    assert all(v[1] == int(v[0]) for v in got.values())
    assert mixed.filter("mix_taken > 3 * mix_size").count() == 0
    drawn = mixing.draw(mixed)
    words = {r.source: r.n for r in drawn.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit("w"))).alias("n")).collect()}
    assert words == {k: int(v) for k, v in want.items()}
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mixing.mix_sources(mixed.select("doc_id", "text", "source")).select(mixed.columns).collect()))
    kept = mixing.mix_sources(odd)
    assert set(odd.columns) <= set(kept.columns) and kept.count() == 9 and mixing.mix_sources(empty).count() == 0


# 2


def test_media(spark, odd, docs):
    for n in (192, 192 * 64, 192 * 257 * 3):
        raw = random.Random(n).randbytes(n)
        stored = media.wrap(raw)
        (t,) = media.tracks(stored)
        assert media.payload(stored, t) == raw and (t["codec"], t["timescale"], t["duration"]) == ("raw ", 8000, n)
        assert [k for k in t["keys"]] == list(range(0, n // 192, 64)) and all(stored[t["offsets"][k] :][: t["sizes"][k]] == raw[k * 192 : (k + 1) * 192] for k in t["keys"])
    wide = stored + struct.pack(">I4sQ", 1, b"free", 20) + b"abcd" + struct.pack(">I4s", 0, b"free") + b"to the end"
    assert media.tracks(wide)[0]["codec"] == "raw "
    bad = [b"", b"abc", stored[:200], b"\0\0\0\x04moov", stored[:-50], stored.replace(b"stsz", b"xxxx"), media.box(b"moof")]
    table = spark.createDataFrame([(i, b) for i, b in enumerate([*bad, None, stored])], "i int, media binary")
    got = {r.i: r for r in media.probe(table).collect()}
    assert got[8].media_error is None and got[8].media_tracks[0].codec == "raw " and got[0].media_tracks == [] and got[6].media_error == "fragmented" and got[7].media_error == "null"
    assert all(got[i].media_error for i in (1, 2, 3))
    assert media.with_media(odd).columns == [*[c for c in odd.columns if c != "media"], "media"]


def test_probe_never_fails(spark):
    """Boxes changed, cut, missing and doubled, and headers that claim much, give tracks or an error each."""
    r = random.Random(12)
    good = media.wrap(random.Random(1).randbytes(192 * 70))
    kinds = [b"moov", b"trak", b"mdia", b"minf", b"stbl", b"stsd", b"stts", b"stss", b"stsc", b"stsz", b"stco", b"mdhd", b"mvhd", b"dinf"]
    files = [good, media.box(b"moov", media.box(b"trak"))]
    for kind in kinds:
        at = good.index(kind) - 4
        size = struct.unpack_from(">I", good, at)[0]
        files += [good[: at + 4] + b"free" + good[at + 8 :], good[:at] + good[at + size :], good[: at + size] + good[at : at + size] + good[at + size :], good[: at + size // 2]]
    for _ in range(1500):
        data = bytearray(good)
        for _ in range(r.randint(1, 3)):
            data[r.randrange(700)] = r.choice([0, 1, 255, r.randrange(256)])
        files.append(bytes(data))
    # A thousand tracks, each of as many one-byte samples as the file has bytes.
    stbl = media.box(b"stbl", media.full(b"stsz", struct.pack(">II", 1, 60_000)))
    files.append(media.box(b"moov", *[media.box(b"trak", media.box(b"mdia", media.box(b"minf", stbl)))] * 1000))
    table = spark.createDataFrame(list(enumerate(files)), "i int, media binary")
    got = {x.i: x for x in media.probe(table).collect()}
    assert len(got) == len(files) and got[0].media_error is None
    assert all((x.media_tracks is None) == (x.media_error is not None) for x in got.values())
    assert got[1].media_tracks[0].samples == 0 and got[len(files) - 1].media_error == "more samples than bytes"


def test_media_by_hand(spark):
    """The stored form and the feature of a short text, byte for byte and by arithmetic."""
    (r,) = media.with_media(spark.createDataFrame([("é" * 100,)], "text string")).collect()
    body = ("é" * 100).encode().ljust(384)
    assert r.media.startswith(struct.pack(">I4s4sI4s4s", 24, b"ftyp", b"isom", 512, b"isom", b"iso2")) and r.media.endswith(struct.pack(">I4s", 392, b"mdat") + body)
    start = len(r.media) - 384
    assert struct.pack(">I4sIII", 20, b"stco", 0, 1, start) in r.media and struct.pack(">I4sIII", 20, b"stsz", 0, 192, 2) in r.media
    (t,) = media.probe(spark.createDataFrame([(bytes(r.media),)], "media binary")).collect()[0].media_tracks
    assert (t.codec, t.timescale, t.duration, t.samples, [tuple(k) for k in t.keyframes]) == ("raw ", 8000, 384, 2, [(0, start, 192)])


def test_media_query(spark, sf, docs):
    got = {r.doc_id: r for r in media.op2_media_columns(spark, sf).collect()}
    for i, text in zip(docs.doc_id, docs.text, strict=True):
        raw = text.encode()
        padded = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_sha256) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]), hashlib.sha256(media.wrap(padded)).hexdigest())


# 3


def brute_spans(rows):
    seen, out = set(), {}
    for i in sorted({r[0] for r in rows}):
        new = set()
        for _, data in [r for r in rows if r[0] == i]:
            covered = bytearray(len(data))
            for k in range(len(data) - 49):
                w = data[k : k + 50]
                if w in seen:
                    covered[k : k + 50] = b"\1" * 50
                new.add(w)
            out[i] = (len(data), sum(covered), sum(1 for k in range(len(data)) if covered[k] and not (k and covered[k - 1])), hashlib.sha256(bytes(x for x, c in zip(data, covered, strict=True) if not c)).hexdigest())
        seen |= new
    return out


def test_suffix_order():
    r = random.Random(5)
    for _ in range(600):
        s = [r.randint(0, r.choice([1, 2, 4])) for _ in range(r.randint(1, 50))]
        assert suffixes.suffix_order(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_anchors(monkeypatch):
    """Of each text on its own, whatever stands beside it."""
    r = random.Random(6)
    texts = [bytes(r.choice(b"ab " if r.random() < 0.5 else b"abcdefgh ") for _ in range(r.choice([0, 49, 50, 51, r.randint(0, 300)]))) for _ in range(120)]
    for portion in (1, 700, 1 << 18):
        monkeypatch.setattr(suffixes, "PORTION", portion)
        found = list(zip(*(x.tolist() for x in suffixes.anchors(texts)), strict=True))
        different = list(zip(*(x.tolist() for x in suffixes.anchor_hashes(texts)), strict=True))
        for i, data in enumerate(texts):
            mine = [x[1:] for x in found if x[0] == i]
            if len(data) < 50:
                assert not mine and not [x for x in different if x[0] == i]
                continue
            h, _ = suffixes.minima(data)
            want = [min(range(w, w + 26), key=lambda p: (h[p], p)) for w in range(len(data) - 49)]
            assert [p for _, p, f, l in mine for _ in range(l - f + 1)] == want and all(a == h[p] for a, p, _, _ in mine)
            assert [x[1] for x in different if x[0] == i] == sorted({a for a, *_ in mine})


def test_suffix_query(spark, sf, docs):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.op3_suffix_dedup(spark, sf).collect()}
    assert got == brute_spans([(i, t.encode()) for i, t in zip(docs.doc_id, docs.text, strict=True)])


def test_orders_together():
    """Many strings at once, each as on its own."""
    r = random.Random(10)
    for _ in range(60):
        strings = [[r.randint(0, r.choice([1, 2, 4])) for _ in range(r.choice([1, 3, 30, 90]))] for _ in range(r.randint(1, 60))]
        flat, sizes, want, at = np.array(sum(strings, [])), np.array([len(x) for x in strings]), [], 0
        for x in strings:
            want += [at + i for i in sorted(range(len(x)), key=lambda i: x[i:])]
            at += len(x)
        assert suffixes.suffix_orders(flat, sizes).tolist() == want == suffixes.ordered(flat, sizes).tolist()


def shared_texts(n):
    """Texts around one long passage that starts and ends at other places, one that few have, repeats in a text, and odd ones."""
    r = random.Random(7)
    word = lambda k, of: "".join(r.choice(of) for _ in range(k))
    core, rare = word(90, "abcdefgh"), word(70, "stuv")
    texts = [word(40, "xyz") + core[r.randint(0, 30) : 90 - r.randint(0, 25)] + word(30, "xy") + (rare if i % 9 == 0 else "") for i in range(n)]
    texts += [core, core * 2, "ab" * 60, "ab" * 70, "a" * 49, "a" * 50, "a" * 200, "", None, core + "\u00e9" * 40, texts[0], texts[3]]
    return [(i * 7 % 997, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("rare", [100, 10**9])
def test_spans_against_brute_force(spark, monkeypatch, rare):
    """The same result whether a sample shows frequent anchors or none."""
    monkeypatch.setattr(suffixes, "RARE", rare)
    rows = shared_texts(90)
    if rare == 10**9:
        monkeypatch.setattr(suffixes, "FREQUENT", 0)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert (len(suffixes._frequent(suffixes._texts(table, "doc_id", "text"), 100)) > 0) == (rare == 100)
    got = {r.doc_id: (r.text, [tuple(x) for x in r.repeated]) for r in suffixes.with_spans(table).collect()}
    want = brute_spans([(i, (t or "").encode()) for i, t in rows])
    for i, t in rows:
        spans = got[i][1]
        rest = suffixes.kept((t or "").encode(), [{"first": a, "last": b} for a, b in spans])
        assert (len((t or "").encode()), sum(b - a + 1 for a, b in spans), len(spans), hashlib.sha256(rest).hexdigest()) == want[i]


def test_spans_come_from_the_order(spark, monkeypatch):
    """Without the order nothing but whole copies is covered."""
    texts = [t for _, t in shared_texts(30) if t]
    data = [t.encode() for t in texts]
    number, hashes, *_ = suffixes.anchors(data)
    found = suffixes._dealt(data, (hashes.view(np.int64), number), np.zeros(0, np.int64))
    rows = [(h, b, data[i][f : l + 50], [i], [i], [f]) for i, h, b, f, l in zip(*(x.tolist() for x in found), strict=True)]
    rows.sort()
    import pyarrow as pa

    def made(size):
        kinds = [pa.int64(), pa.int32(), pa.binary(), *[pa.list_(pa.int64())] * 3]
        parts = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[a : a + size], strict=True), kinds, strict=True)], names=["hash", "before", "snippet", "dids", "t1s", "ats"]) for a in range(0, len(rows), size)]
        out = {}
        for batch in suffixes._runs(iter(parts)):
            for t, first, last in zip(*(batch.column(c).to_pylist() for c in ("t1", "first", "last")), strict=True):
                out.setdefault(t, set()).update(range(first, last + 1))
        return out

    whole = made(10_000)
    want = brute_spans([(i, t.encode()) for i, t in enumerate(texts)])
    assert {i: len(whole.get(i, ())) for i in want} == {i: v[1] for i, v in want.items()}
    monkeypatch.setattr(suffixes, "BATCH", 1)
    assert made(7) == whole
    # With an order that is none the strings of different snippets never meet.
    monkeypatch.setattr(suffixes, "ordered", lambda s, sizes: np.concatenate([np.arange(e - n, e) for n, e in zip(sizes, np.cumsum(sizes), strict=True)]))
    assert sum(map(len, made(10_000).values())) < sum(map(len, whole.values()))


def test_spans_edges(spark, odd, empty):
    """Ids and texts that repeat, megabytes in one text, clashing names."""
    long = " ".join(f"w{i * i % 9973}" for i in range(300_000))
    table = spark.createDataFrame([(1, long), (2, "tail " + long[-1000:]), (2, "tail " + long[-1000:]), (None, long[:60])], "doc_id long, text string")
    got = suffixes.with_spans(table).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, len(r.text), [tuple(x) for x in r.repeated][-1:]) for r in got if r.doc_id != 1) == [(False, 2, 1005, [(5, 1004)])] * 2 + [(True, 0, 60, [(0, 59)])]
    clash = odd.withColumn("repeated", F.lit(7)).withColumn("t1", F.lit("x"))
    done = suffixes.with_spans(clash)
    assert sorted(done.columns) == sorted(clash.columns) and done.count() == 9 and {r.t1 for r in done.collect()} == {"x"}
    assert suffixes.with_spans(empty).count() == 0


# 4, 5


TRICKY = ["", "  ", "a<|endoftext|>B<|startoftext|>", "ΑΣ ΟΔΟΣ İI ﬁ", "x" * 3000, "ab1" * 700, "it's we'LL 'S 12½²", "a b\x1cc\x85d\xa0e", "é é \U0001f389‍", "\x00�﻿", "ʰª ñ"]


def test_bpe(spark, sf, docs):
    path = bpe.default_path()
    library, own = Tokenizer.from_file(path), bpe.Bpe(path)
    r = random.Random(8)
    texts = [*TRICKY, *docs.text[:60], *("".join(r.choice("abc ABÀß'sSdt1²一\n\t|<>-…é́🎉") for _ in range(r.randint(0, 60))) for _ in range(500))]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    # Long and short merging agree, and no merge spans a forced cut.
    symbols = list("thethequickbrownfoxthe") + ["e</w>"]
    assert own._merge(list(symbols)) == own._merge_short(list(symbols))
    assert all((own._split(a)[-1], own._split(b)[0]) in own.joined for a, b in own.rank)
    got = {r.doc_id: r for r in bpe.op4_bpe_roundtrip(spark, sf).collect()}
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        ids = library.encode(t, add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_code_points_of_any_edition():
    """Case, composition and classes of code points follow the library, whatever Python's Unicode data says."""
    r = random.Random(13)
    texts = ["\ua7dc\u2c2f", "\u1e9e\u0130I\u0307", "\u0344\u0958 \U00016d63"]
    texts += ["".join(chr(r.choice([r.randrange(32, 0x250), r.randrange(0x250, 0xD800), r.randrange(0xE000, 0x20000), 32])) for _ in range(30)) for _ in range(1500)]
    library, own = Tokenizer.from_file(bpe.default_path()), bpe.load(bpe.default_path())
    assert all(own.encode(t) == library.encode(t, add_special_tokens=False).ids for t in texts)
    library, pieces = Tokenizer.from_file(records.default_path()), records.load(records.default_path())
    assert all(np.frombuffer(b, "<u2").tolist() == library.encode(t, add_special_tokens=False).ids for t, b in zip(texts, pieces.encode(texts), strict=True))


def test_foreign_tokenizers_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        records.Pieces(bpe.default_path())


def test_shards_by_name():
    """Random letters of a name that look like its number change nothing."""
    names = ["part-00000-c1234567-89ab-c000-9999-0123456789ab-c000.txt", "part-00000-c1234567-89ab-c000-9999-0123456789ab-c001.txt", "part-00001-c1234567-89ab-c000-9999-0123456789ab-c000.txt.gz"]
    assert [(x["part"], x["number"]) for x in map(records._shard, names)] == [(0, 0), (0, 1), (1, 0)]


def test_shuffled_reads(spark, docs, tmp_path):
    top = str(tmp_path / "r")
    rows = spark.createDataFrame(docs[["doc_id", "text"]][:60]).withColumn("tokens", F.lit(1)).withColumn("offset", F.lit("x"))
    records.write_records(rows, top, records.default_path())
    plain = {r.id: r.tokens for r in records.read_records(spark, top).collect()}
    once, again, other = ([(r.id, r.tokens) for r in records.read_shuffled(spark, top, seed).collect()] for seed in (1, 1, 2))
    assert once == again and dict(once) == plain and len(once) == 60
    assert [i for i, _ in once] != sorted(plain) and [i for i, _ in once] != [i for i, _ in other]


def test_records_edges(spark, empty, tmp_path):
    """Nulls, repeated rows and a text of megabytes."""
    library = Tokenizer.from_file(records.default_path())
    long = "some words, again and again. " * 80_000
    rows = [(3, long), (1, None), (1, "a"), (1, "a"), (None, "b"), (2, "")]
    top = str(tmp_path / "r")
    records.write_records(spark.createDataFrame(rows, "doc_id long, text string"), top, records.default_path())
    got = [(r.id, r.tokens) for r in records.read_records(spark, top).orderBy("shard", "place").collect()]
    want = [(1, None), (1, "a"), (1, "a"), (2, ""), (3, long), (None, "b")]
    assert got == [(i, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in want]
    records.write_records(empty, str(tmp_path / "e"), records.default_path())
    assert records.read_records(spark, str(tmp_path / "e")).count() == 0 == records.read_shuffled(spark, str(tmp_path / "e")).count()


def test_records(spark, sf, docs):
    assert records.crc32c([b"123456789"])[0] == 0xE3069283

    def slow(data):
        c = 0xFFFFFFFF
        for x in data:
            c ^= x
            for _ in range(8):
                c = c >> 1 ^ (records.POLYNOMIAL if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    parts = [random.Random(n).randbytes(n) for n in (4, 5, 255, 256, 257, 700, 2000)]
    assert records.crc32c(parts).tolist() == [slow(p) for p in parts]
    data = b"\n".join(records.frame(parts)) + b"\n"
    assert [p for _, p in records.unframe(data)] == parts
    for broken in (data[:-3], data[:20] + bytes([data[20] ^ 1]) + data[21:]):
        with pytest.raises(ValueError):
            records.unframe(broken)
    library = Tokenizer.from_file(records.default_path())
    pieces = records.Pieces(records.default_path())
    for t, b in zip(TRICKY, pieces.encode(TRICKY), strict=True):
        assert np.frombuffer(b, "<u2").tolist() == library.encode(t, add_special_tokens=False).ids
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in records.op5_token_records(spark, sf).collect()}
    start, want = 0, {}
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert got == want


def test_record_index(spark, docs, tmp_path):
    top = str(tmp_path / "r")
    records.write_records(spark.createDataFrame(docs[["doc_id", "text"]][:50]), top, records.default_path())
    for r in spark.read.parquet(f"{top}/index").limit(7).collect():
        data = open(f"{top}/records/{r.file}", "rb").read()[r.offset : r.offset + r.length]
        ((_, payload),) = records.unframe(data)
        assert struct.unpack_from("<Bq", payload) == (1, r.id)
    assert [r.id for r in records.read_records(spark, top).orderBy("shard", "place").collect()] == docs.doc_id[:50].tolist()


# 6


def test_chat(spark, sf, tables):
    r = random.Random(3)
    rows = [(c, t, r.choice(["system", "user", "assistant", "as\nsi\\st<|"]), r.choice(["", "<|im_end|>\n<|im_start|>", "<\\|im", "a b " * r.randint(0, 30), "w " * r.choice([1, 700]), "\\n<\\\\|x\n\nfoo", None])) for c in range(8) for t in range(r.choice([1, 3, 60, 300]))]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.read_turns(chat.format_chats(table, room=64, history=20)).orderBy("conv_id", "window").collect()
    for c in {r[0] for r in rows}:
        mine = [w for w in windows if w.conv_id == c]
        want = [(a, x or "") for k, _, a, x in rows if k == c]
        assert [tuple(t) for w in mine for t in w.turns] == want
        assert [x for w in mine for x in w.targets] == [x for a, x in want if a == "assistant"]
        assert [w.window for w in mine] == list(range(len(mine)))
        first = next((i for i, (a, _) in enumerate(want) if a == "system"), None)
        at = 0
        for w in mine:
            own = w.n_turns - w.n_context
            if first is not None and first < at:
                assert w.n_context >= 1 and "<|im_start|>system\n" in w.text
            tokens = [max(1, len((x or "").split())) for _, x in want[at : at + own]]
            assert len(tokens) == 1 or sum(tokens) <= 64
            at += own
    odd = {r.conv_id: r for r in chat.op6_chat_windows(spark, tables["odd"]).collect()}
    assert odd[1].n_turns == 3 and odd[None].loss_chars == 14 and odd[-1].loss_chars == 34 and odd[2].loss_chars == 1800


# 7


def brute_segments(scores):
    """Every maximal scoring segment by the definition, for small inputs: found by splitting around the best one."""
    best = max(((sum(scores[i:j]), i - j, i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0, 0, 0, 0))
    if best[0] <= 0:
        return []
    # The shortest segment of the best sum, the first of these.
    top, _, i, j = max(((s, l, -i, j) for s, l, i, j in ((sum(scores[i:j]), i - j, i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))), key=lambda x: (x[0], x[1], x[2]))
    i = -i
    return [*brute_segments(scores[:i]), (i, j - 1, top), *((a + j, b + j, s) for a, b, s in brute_segments(scores[j:]))]


def test_segments():
    r = random.Random(9)
    for _ in range(300):
        n = r.randint(0, 14)
        hits = [(i, float(r.choice([1, 2, 4]))) for i in range(n) if r.random() < 0.4]
        scores = [dict(hits).get(i, -0.75) for i in range(n)]
        got = toxicity.segments(hits, 0.75)
        assert sorted((s, a, b) for a, b, s in got) == sorted((s, a, b) for a, b, s in brute_segments(scores))


def test_toxicity(spark, odd, empty):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in toxicity.op7_toxic_segments(spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out and (r.score >= 0.5) == bool(r.predicted) for r in got)
    right = sum(r.predicted == labels[r.doc_id] for r in got)
    assert right / len(got) > 0.9
    model = toxicity.Model({"bad": 4.0, "bad-": 4.0}, 1.5, 0.001, 2.0, -3.0)
    one = toxicity.with_toxicity(odd, model)
    assert one.count() == 9 and set(odd.columns) <= set(one.columns) and toxicity.with_toxicity(empty, model).count() == 0
    hit = toxicity.with_toxicity(spark.createDataFrame([("so bad bad bad end",), ("fine",)], "text string"), model).collect()
    assert hit[0].toxic_score > 0.5 > hit[1].toxic_score and [(p.first, p.last) for p in hit[0].toxic_passages] == [(1, 3)]


# 8


def test_chunks(spark, sf, docs):
    texts = [t.encode() for t in docs.text[:40]] + [b"", b"x" * 1000, b"ab"]
    together, alone = chunks.cuts(texts), [chunks.cuts([t])[0] if t else [] for t in texts]
    assert together == alone
    for t, ends in zip(texts, together, strict=True):
        assert (ends[-1] if ends else 0) == len(t) and all(b - a <= chunks.LARGEST for a, b in zip([0, *ends], ends, strict=False)) and all(b - a >= chunks.LEAST for a, b in zip([0, *ends], ends[:-1], strict=False))
    a, b = chunks.fingerprints([texts[0], b"some new words before it all. " + texts[0]])
    assert chunks.likeness(a, b) > 0.9 and chunks.likeness(a, a) == 1 and chunks.likeness({}, {}) == 1 and chunks.likeness(a, {}) == 0
    assert chunks.read(chunks.written(a)) == a
    got = {r.doc_id: r for r in chunks.op8_chunk_fingerprints(spark, sf).collect()}
    down = docs.sort_values("doc_id", ascending=False)
    ids, own = down.doc_id.tolist(), down.text.tolist()
    for k, (i, t) in enumerate(zip(ids, own, strict=True)):
        follower = own[(k + 1) % len(own)]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + follower[:cut]
        p, q, f = (chunks.fingerprints([x.encode()])[0] for x in (t, edited, follower))
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), chunks.written(p), chunks.written(q))
        assert abs(r.near_edited - chunks.likeness(p, q)) < 1e-12 and abs(r.near_next - chunks.likeness(p, f)) < 1e-12


# 9


def joined(values, pairs):
    up = {v: v for v in values}

    def top(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {v: top(v) for v in values}


def test_simhash_links(spark):
    r = random.Random(1)
    found = set()
    for _ in range(5):
        base = r.getrandbits(64)
        for _ in range(60):
            x = base
            for _ in range(r.randint(0, 5)):
                x ^= 1 << r.randrange(64)
            found.add(x - (1 << 64) if x >> 63 else x)
    near = [(a, b) for a in found for b in found if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2]
    table = spark.createDataFrame([(x,) for x in found], "fp long")
    for crowd in (1, 4, 64):
        got = [(x.a, x.b) for x in simhash.links(table, crowd).collect()]
        assert set(got) <= set(near) and joined(found, got) == joined(found, near)


def test_simhash_query(spark, sf, docs):
    def print_of(t):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in t).translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ")
        words = [w for w in words if w]
        grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = [print_of(t) for t in docs.text]
    by = joined(range(len(prints)), [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op9_simhash_groups(spark, sf).collect()}
    assert got == {docs.doc_id[i]: (f"{p:016x}", docs.doc_id[by[i]]) for i, p in enumerate(prints)}


def test_keep_one(spark, odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    # 1, 1 and 2 are one text; 3, 4 and the null text without id have the fingerprint zero.
    assert ids == [(False, 1), (False, 3), (False, 5), (False, 6), (True, 0)]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


# 10


def test_lines(spark, odd):
    texts = ["alpha beta gamma", "alpha beta gamma\nshort\n\n  alpha betta gamma \nalpha betta gammma", "shorty\nshort", "x\ny\nzz", "zz\nz\n\n", "k" * 5000 + "q" + "m" * 3000, "k" * 5000 + "m" * 3000 + "\nk" * 2]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    earlier, want = [], {}

    def near(a, b):
        if a == b:
            return True
        if abs(len(a) - len(b)) > 1:
            return False
        p = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        return a[p + 1 :] == b[p + 1 :] or a[p:] == b[p + 1 :] or a[p + 1 :] == b[p:]

    for i, t in enumerate(texts):
        keep = []
        for line in t.split("\n"):
            bare = line.strip(" \t\n\v\f\r")
            if not bare or not any(near(bare, e) for e in earlier):
                keep.append(line)
            if bare:
                earlier.append(bare)
        want[i] = "\n".join(keep)
    got = {r.doc_id: r.text for r in lines.drop_repeated_lines(table).collect()}
    assert got == want
    done = lines.drop_repeated_lines(odd)
    assert set(odd.columns) <= set(done.columns) and done.count() == 9
    by = {(r.doc_id, r.source): (r.text, r.lines_total, r.lines_kept) for r in done.collect()}
    assert by[None, None] == ("no id here", 3, 1) and by[2, "b"] == ("", 1, 0) and by[4, None] == (None, 0, 0) and by[3, "b"] == ("", 1, 1)


def test_logistic():
    """The fit finds the best curve, also where the classes all but separate."""
    for x, y, w in (([0, 1, 2, 3, 4], [0, 0, 1, 1, 1], [16000, 40, 30, 400, 1500]), ([0, 0, 5, 5], [0, 1, 0, 1], [90, 10, 10, 90]), ([0, 5], [0, 1], [1e6, 1e5])):
        x, y, w = (np.array(v, float) for v in (x, y, w))
        slope, base = toxicity._logistic(x, y, w)
        lost = lambda a, b: (w * (np.logaddexp(0, a * x + b) - y * (a * x + b))).sum() + 0.05 * a * a + 0.0005 * b * b
        assert slope > 0 and all(lost(slope, base) <= lost(slope + d, base + e) + 1e-6 for d in (-0.01, 0, 0.01) for e in (-0.01, 0, 0.01))
        assert ((slope * x + base >= 0) == (x >= 2)).all()


# Queries against SQL and against versions written by hand


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    rows = lambda f: sorted(repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in f[sorted(f.columns)].astype(object).itertuples(index=False))
    assert rows(queries.QUERIES[name](spark, sf).toPandas()) == rows(con.execute(queries.ORACLES[name]).fetchdf())


def chunks_by_hand(data):
    """Digest to bytes: each byte's hash is the sum of the last 16 bytes' numbers, each shifted by its age, in 32 bits."""
    out, start = {}, 0
    while start < len(data):
        end = len(data)
        for n in range(1, min(192, len(data) - start) + 1):
            here = start + n - 1
            h = sum(xxhash.xxh32_intdigest(data[here - k : here - k + 1], 7) << k for k in range(16) if here - k >= 0) & 0xFFFFFFFF
            if n == 192 or n >= 16 and (h >> 16 & 0x7F if n < 48 else h >> 16 & 0x0F) == 0:
                end = start + n
                break
        key = xxhash.xxh64_hexdigest(data[start:end])
        out[key] = out.get(key, 0) + end - start
        start = end
    return out


def test_chunk_query_by_hand(spark, docs, tmp_path):
    few = docs.sort_values("n_chars")[["doc_id", "text"]].head(12)
    rows = [*few.itertuples(index=False, name=None), (900_001, ""), (900_002, None), (900_003, few.text.iloc[3]), (900_004, "é" * 100)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in chunks.op8_chunk_fingerprints(spark, str(tmp_path)).collect()}
    down = sorted(rows, key=lambda r: -r[0])
    shown = lambda f: " ".join(f"{k}:{n}" for k, n in f.items())
    like = lambda a, b: sum(min(n, b[k]) for k, n in a.items() if k in b) / min(sum(a.values()), sum(b.values())) if a and b else float(not a and not b)
    assert len(got) == len(rows)
    for k, (i, text) in enumerate(down):
        text, after = text or "", down[(k + 1) % len(down)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        own, new, other = (chunks_by_hand(x.encode()) for x in (text, edited, after))
        assert (got[i].n_chars, got[i].edited_sha256, got[i].fingerprint, got[i].edited_fingerprint) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), shown(own), shown(new))
        assert abs(got[i].near_edited - like(own, new)) < 1e-12 and abs(got[i].near_next - like(own, other)) < 1e-12


def test_toxic_query_by_hand(spark, tmp_path):
    """Word scores, segments by the definition, expectations and the curve, without the operator's code."""
    import math
    import re

    r = random.Random(21)
    clean, bad = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("nt", "ld")], ["vilest", "vilely", "rotten", "scumbag"]
    texts = []
    for i in range(300):
        words = [r.choice(clean) for _ in range(r.randint(0, 25))]
        toxic = int(i % 3 == 0)
        for _ in range(r.randint(2, 6) if toxic else int(r.random() < 0.1)):
            words.insert(r.randint(0, len(words)), r.choice(bad))
        texts.append((i, " ".join(words), toxic))
    spark.createDataFrame([(i, t) for i, t, _ in texts] + [(1000, None), (1001, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, y) for i, _, y in texts], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {x.doc_id: x for x in toxicity.op7_toxic_segments(spark, str(tmp_path)).collect()}

    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    train = [(t, y) for i, t, y in texts if not held(i)]
    forms = lambda w: [w, *(w[:k] + "-" for k in (4, 5, 6, 7) if len(w) > k)]
    counts = {1: {}, 0: {}}
    for t, y in train:
        own = {}
        for w in re.findall("[a-z]+", t.lower()):
            for f in forms(w):
                own[f] = own.get(f, 0) + 1
        for f, n in own.items():
            counts[y][f] = counts[y].get(f, 0) + min(n, 8)
    n_t, n_c = sum(counts[1].values()), sum(counts[0].values())
    scores, share = {}, {}
    for f in {*counts[0], *counts[1]}:
        t, c = counts[1].get(f, 0), counts[0].get(f, 0)
        a = 0.02 * (t + c)
        every = 0.02 * (n_t + n_c)
        delta = math.log((t + a) / (n_t + every - t - a)) - math.log((c + a) / (n_c + every - c - a))
        if delta / math.sqrt(1 / (t + a) + 1 / (c + a)) >= 5 and delta > 0.5:
            scores[f], share[f] = delta, max(c, 0.5) / n_c / 5
    assert scores
    low, high = 1e-6, 50.0
    for _ in range(200):
        lam = (low + high) / 2
        low, high = (lam, high) if sum(p * math.exp(min(lam * scores[f], 700)) for f, p in share.items()) + (1 - sum(share.values())) * math.exp(-lam / 2) < 1 else (low, lam)

    def found(text):
        words = [max((scores.get(f, 0.0) for f in forms(w)), default=0.0) or -0.5 for w in re.findall("[a-z]+", (text or "").lower())]
        return [s for _, _, s in brute_segments(words)], len(words)

    clean_found = [found(t) for t, y in train if y != 1]
    k = (sum(len(s) for s, _ in clean_found) + 0.5) / (sum(n for _, n in clean_found) + 1.0)
    proof = lambda s, n: sum(-e for e in (math.log(k * n) - lam * x for x in s) if e < math.log(0.5))
    slope, base = toxicity._logistic(np.array([round(math.log1p(proof(*found(t))) * 200) / 200 for t, _ in train]), np.array([float(y) for _, y in train]), np.ones(len(train)))
    for i, t, _ in [*texts, (1000, None, 0), (1001, "", 0)]:
        want = 1 / (1 + math.exp(-max(-30, min(30, slope * math.log1p(proof(*found(t))) + base))))
        assert got[i].held_out == held(i) and abs(got[i].score - want) < 1e-6 and got[i].predicted == int(got[i].score >= 0.5)


def test_drawing_keeps_other_columns(spark):
    rows = spark.createDataFrame([(i, f"w{i} " * 5, "a", "keep", 7) for i in range(4)], "doc_id long, text string, source string, mix_note string, __words int")
    drawn = mixing.draw(mixing.mix_sources(rows))
    assert drawn.columns == rows.columns and {(r.mix_note, r["__words"]) for r in drawn.collect()} == {("keep", 7)}
