"""BPE encoding and decoding with forced boundaries.

A merge never spans two symbols that stand next to each other in no vocabulary token. So every piece of a text (a match of the
tokenizer's pattern, as byte symbols, the last one with the end-of-word mark) is cut at each such pair; the fragments are
encoded on their own and their ids follow each other. Pieces are remembered up to a bound, and a long fragment costs n log n
by a heap of pairs.

The tokenizer file gives vocabulary, merges, added tokens and normalisation. Null texts count as empty and have no ids.
Added tokens in a text are found first, as the tokenizers library does. Texts of any length are taken whole. Rows and other
columns stay; only those named as an output are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .base import documents, plus, sealed, small_batches, unsealed
from .pieces import finder

#: Pieces that a Python worker remembers at most, and symbols from which on a fragment is merged by a heap.
REMEMBER, LONG = 800_000, 40


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level BPE: bytes that print in Latin-1 stand for themselves, the others
    follow in order from code point 256."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.tokens = {i: t for t, i in self.ids.items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.find_added = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        if unknown := {*self.steps} - {"NFC", "Replace", "Lowercase"}:
            raise ValueError(f"unknown normalisers {unknown}")
        normalizer = Tokenizer.from_file(path).normalizer
        self.library = normalizer.normalize_str if normalizer else None
        self.pieces = finder(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.spaced = self.pieces(" a \t\n ") == ["a"]
        self.table = dict(enumerate(byte_symbols()))
        self.joined = {p for t in self.ids for p in self._neighbours(t)}
        self.known = Known(self)

    def _split(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def _neighbours(self, token: str) -> Iterator[tuple[str, str]]:
        symbols = self._split(token)
        return zip(symbols, symbols[1:], strict=False)

    def normalised(self, text: str) -> str:
        """As the library's normaliser, which also does it where the edition of Unicode can matter."""
        if not text.isascii():
            return self.library(text) if self.library else text
        # White space in no piece: then collapsing it changes none.
        text = text if self.spaced or "Replace" not in self.steps else _spaces(" ", text)
        return text.lower() if "Lowercase" in self.steps else text

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        at = 0
        for m in self.find_added.finditer(text or "") if self.find_added else ():
            self._encode_plain(text[at : m.start()], out)
            out.append(self.added[m[0]])
            at = m.end()
        self._encode_plain((text or "")[at:], out)
        return out

    def _encode_plain(self, text: str, out: list[int]) -> None:
        out.extend(chain.from_iterable(map(self.known.__getitem__, self.pieces(self.normalised(text)))))

    def _piece(self, piece: str) -> list[int]:
        symbols = list(piece.encode().decode("latin-1").translate(self.table))
        symbols[-1] += self.end
        pairs = list(zip(symbols, symbols[1:], strict=False))
        forced = [i + 1 for i, p in enumerate(pairs) if p not in self.joined]
        if not forced:
            return self._fragment(symbols)
        bounds = [0, *forced, len(symbols)]
        return [i for a, b in zip(bounds, bounds[1:], strict=False) for i in self._fragment(symbols[a:b])]

    def _fragment(self, symbols: list[str]) -> list[int]:
        ids = self.ids
        return [ids[t] for t in (self._merge(symbols) if len(symbols) >= LONG else self._merge_short(symbols)) if t in ids]

    def _merge_short(self, symbols: list[str]) -> list[str]:
        """Best pair first, leftmost among equals."""
        get, none = self.rank.get, len(self.rank)
        ranks = [get(p, none) for p in zip(symbols, symbols[1:], strict=False)]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((symbols[i - 1], symbols[i]), none)
            if i < len(ranks):
                ranks[i] = get((symbols[i], symbols[i + 1]), none)
        return symbols

    def _merge(self, symbols: list[str | None]) -> list[str]:
        """The same in n log n."""
        n, rank = len(symbols), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := rank.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue
            symbols[i], symbols[j] = left + right, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := rank.get((symbols[a], symbols[b]))) is not None:
                    heapq.heappush(heap, (r, a, symbols[a], symbols[b]))
        return [s for s in symbols if s is not None]

    def decode(self, ids: list[int]) -> str:
        """As decode(ids, skip_special_tokens=False) of a tokenizer without decoder: tokens joined by one space."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


class Known(dict):
    """Ids of the pieces met so far."""

    def __init__(self, of: Bpe):
        self.of = of

    def __missing__(self, piece: str) -> list[int]:
        ids = self.of._piece(piece)
        if len(piece) <= 64:
            if len(self) >= REMEMBER:
                self.clear()
            self[piece] = ids
        return ids


_spaces = regex.compile(r"\s+").sub


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    return Bpe(path)


def with_ids(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """docs and ids (array<int>), decoded (string): whole texts through the tokenizer at path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            ids = [bpe.encode(x.as_py()) for x in batch.column("__text")]
            names = [n for n in batch.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(ids, pa.list_(pa.int32())), pa.array(map(bpe.decode, ids), pa.string())], names=[*names, "ids", "decoded"])

    small_batches(docs.sparkSession, 500)
    inner = sealed(docs, {"__text": F.col(text_col)}, ["ids", "decoded"])
    schema = plus(inner.drop("__text").schema, "ids array<int>, decoded string")
    return unsealed(inner.mapInArrow(run, schema), F.col("ids"), F.col("decoded"))


def with_digests(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """docs and n_tokens, ids_sha256, decoded_sha256 of what with_ids gives, computed where the ids are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        numbers = {i: str(i) for i in bpe.tokens}
        for batch in batches:
            n, of_ids, of_text = [], [], []
            for x in batch.column("__text"):
                ids = bpe.encode(x.as_py())
                n.append(len(ids))
                of_ids.append(sha256(" ".join([numbers[i] for i in ids]).encode()).hexdigest())
                of_text.append(sha256(bpe.decode(ids).encode()).hexdigest())
            names = [c for c in batch.schema.names if c != "__text"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=[*names, "n_tokens", "ids_sha256", "decoded_sha256"])

    small_batches(docs.sparkSession, 500)
    outputs = ["n_tokens", "ids_sha256", "decoded_sha256"]
    inner = sealed(docs, {"__text": F.col(text_col)}, outputs)
    schema = plus(inner.drop("__text").schema, "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return unsealed(inner.mapInArrow(run, schema), *map(F.col, outputs))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_digests(documents(spark, sf_dir).select("doc_id", "text"), default_path())
