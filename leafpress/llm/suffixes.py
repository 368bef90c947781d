"""Suffix-array dedup: bytes that an earlier document has in a run of SPAN bytes go.

Every SPAN-byte string holds an anchor: of its K-byte strings the one with the least hash, the leftmost of equals. Equal strings
hold equal anchors at equal places, so equal strings of different documents meet at their anchor's hash. Anchors that only one
text has are left out; an anchor that several texts have is sent on as a snippet: the bytes that the strings of this anchor
cover. Equal snippets are one, with all their places. A task writes the different snippets of an anchor one after the other, the
anchor as one symbol, and orders their suffixes in linear time: suffixes fall into groups of equal
Lyndon prefix, which are processed in descending order, each group passing its prefix on to the previous smaller suffixes its
members point to; then, from the least suffix on, each emits those whose Lyndon prefix ends where it starts. No recursion, no
renaming. Neighbours in that order that share SPAN bytes are equal strings; all but those of the smallest id are covered. Nothing
else decides what is covered, but for whole texts that equal one with a smaller id.

An anchor that many texts have is dealt by more of the string: where a sample of texts shows an anchor in one of RARE or more, its
strings meet by the anchor with as many bytes before it as half the rest of a string has, or after it, whichever the string holds.
The sample decides where strings meet, and no result.

Texts that equal a text with a smaller id are covered whole if they have SPAN bytes. Of equal texts one stands for all. Null ids
come after all others and cover nothing of each other; a document never covers its own bytes, nor those of a row with its id. Ids
are whole numbers. Null and empty texts have no bytes. Texts of any length are taken whole. An empty table gives an empty result.
Other columns stay, whatever their names; one named repeated is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import Scratch, documents, sealed, small_batches, tidy, unsealed

SPAN, K = 50, 25
#: Bytes before or after a frequent anchor that its strings meet by too: each string has them on one side.
SIDE = (SPAN - K + 1) // 2
#: Texts that are sampled for frequent anchors, the share that makes one (one in RARE), and how many there are at most.
SAMPLE, RARE, FREQUENT = 2_000, 100, 1 << 13
#: Bytes of snippets that a task orders at once at least, where it has as many; strings that are ordered on their own.
BATCH, FEW = 1 << 20, 48
#: Bytes of text that are hashed at once.
PORTION = 1 << 18
_MUL, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
_SYMBOLS = (np.arange(1, 257, dtype=np.uint64) * _MIX) ^ (np.arange(1, 257, dtype=np.uint64) * _MUL) >> np.uint64(7)


def suffix_order(s: list[int]) -> list[int]:
    """Starts of the suffixes of s in ascending order."""
    n = len(s)
    symbols = sorted(set(s))
    rank = {c: g for g, c in enumerate(symbols)}
    group = [rank[c] for c in s]
    members: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
    # Groups are a list from the greatest to the least; new ones stand right above the group they leave.
    below, above = list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]
    left, smaller, done = list(range(-1, n - 1)), [-1] * n, bytearray(n)
    g, final = len(symbols) - 1, []
    while g >= 0:
        own = members[g] = [i for i in members[g] if group[i] == g]
        final.append(g)
        for i in own:
            done[i] = 1
        follows: dict[int, int] = {}
        for i in own:
            # All groups above are done, so the nearest suffix to the left that isn't is the previous smaller one.
            j = left[i]
            while j >= 0 and done[j]:
                j = left[j]
            k = i
            while left[k] != j:
                left[k], k = j, left[k]
            smaller[i] = j
            if j >= 0:
                follows[j] = follows.get(j, 0) + 1
        # A suffix that this group's prefix follows more often is greater; each leaves its group for one right above.
        by_times: dict[int, list[int]] = {}
        for j, c in follows.items():
            by_times.setdefault(c, []).append(j)
        for times in sorted(by_times, reverse=True):
            moved: dict[int, int] = {}
            for j in by_times[times]:
                old = group[j]
                new = moved.get(old)
                if new is None:
                    new = moved[old] = len(members)
                    members.append([])
                    up = above[old]
                    above.append(up)
                    below.append(old)
                    above[old] = new
                    if up >= 0:
                        below[up] = new
                group[j] = new
                members[new].append(j)
        g = below[g]

    free, at = [0] * len(members), 0
    for g in reversed(final):
        free[g] = at
        at += len(members[g])
    order = [0] * n
    i, stop = n, -1
    for k in range(n + 1):
        # Those whose Lyndon prefix ends at i come next in their groups.
        j = i - 1
        while j != stop:
            g = group[j]
            order[free[g]] = j
            free[g] += 1
            j = smaller[j]
        if k < n:
            i = order[k]
            stop = smaller[i]
    return order


def _edges(*values: np.ndarray) -> np.ndarray:
    """Places where any of the values differs from the one before, the first among them."""
    new = np.empty(len(values[0]), bool)
    new[:1] = True
    np.not_equal(values[0][1:], values[0][:-1], out=new[1:])
    for v in values[1:]:
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def _lengths(edges: np.ndarray, n: int) -> np.ndarray:
    out = np.empty(len(edges), np.int64)
    np.subtract(edges[1:], edges[:-1], out=out[:-1])
    out[-1:] = n - edges[-1:]
    return out


def suffix_orders(s: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of many strings of numbers below 2^31 that stand one after the other in s, in ascending order within
    each string: the steps of suffix_order, each taken by all strings at once. The number of steps is that of the longest."""
    n, ends = len(s), np.cumsum(sizes)
    starts, of = (ends - sizes).astype(np.int32), np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
    pool = np.empty(2 * n, np.int32)
    key = of << 31 | s.astype(np.int64)
    by_symbol = np.argsort(key).astype(np.int32)
    edge = _edges(key[by_symbol])
    made, used = len(edge), n
    pool[:n] = by_symbol
    # Of a group: its place in the pool and size when it was made (members leave it later, none join), its string, and the groups
    # next to it in the order.
    first, count, string, below, above = (np.full(made + n, -1, np.int32) for _ in range(5))
    first[:made], count[:made], string[:made] = edge, _lengths(edge, n), of[by_symbol[edge]]
    group = np.empty(n, np.int32)
    group[by_symbol] = np.repeat(np.arange(made, dtype=np.int32), count[:made])
    joined = np.flatnonzero(string[1:made] == string[: made - 1])
    below[joined + 1], above[joined] = joined, joined + 1
    current = np.flatnonzero(above[:made] < 0).astype(np.int32)
    # A place after the last stands for none: it is never done.
    left, smaller, done = np.arange(-1, n - 1, dtype=np.int32), np.full(n, n, np.int32), np.zeros(n + 1, bool)
    left[starts] = n
    final: list[np.ndarray] = []
    held: list[np.ndarray] = []
    while len(current):
        c = count[current]
        upto = np.cumsum(c)
        own = pool[np.repeat(first[current] - upto + c, c) + np.arange(upto[-1])]
        stays = group[own] == np.repeat(current, c)
        if stays.all():
            held.append(c)
        else:
            kept = np.zeros(len(own) + 1, np.int64)
            np.cumsum(stays, out=kept[1:])
            own = own[stays]
            held.append(kept[upto] - kept[upto - c])
        final.append(current)
        done[own] = True
        j = left[own]
        back = np.flatnonzero(done[j])
        while len(back):
            j[back] = left[j[back]]
            back = back[done[j[back]]]
        left[own] = smaller[own] = j
        j = np.sort(j[j < n])
        if len(j):
            new = _edges(j)
            times, j = _lengths(new, len(j)), j[new]
            host = group[j].astype(np.int64) << 31 | times
            by_host = np.argsort(host)
            j, host = j[by_host], host[by_host]
            new = _edges(host)
            ids, lens, host = np.arange(made, made + len(new), dtype=np.int32), _lengths(new, len(j)), (host[new] >> 31).astype(np.int32)
            pool[used : used + len(j)] = j
            first[ids], count[ids], string[ids] = used + new, lens, string[host]
            group[j] = np.repeat(ids, lens)
            lowest = np.ones(len(host), bool)
            np.not_equal(host[1:], host[:-1], out=lowest[1:])
            highest = np.ones(len(host), bool)
            highest[:-1] = lowest[1:]
            up = above[host]
            below[ids], above[ids] = np.where(lowest, host, ids - 1), np.where(highest, up, ids + 1)
            above[host[lowest]] = ids[lowest]
            over = highest & (up >= 0)
            below[up[over]] = ids[over]
            made, used = made + len(ids), used + len(j)
        current = below[current]
        current = current[current >= 0]

    groups, held_by = np.concatenate(final), np.concatenate(held).astype(np.int64)
    rising = np.argsort(string[groups].astype(np.int64) << 32 | np.arange(len(groups), 0, -1))
    free = np.zeros(made, np.int32)
    free[groups[rising]] = np.cumsum(held_by[rising]) - held_by[rising]
    order = np.empty(n, np.int32)
    at, j, stop, start, end = starts.copy(), (ends - 1).astype(np.int32), np.full(len(sizes), n, np.int32), starts, ends.astype(np.int32)
    while len(j):
        # Those whose Lyndon prefix ends at the suffix that each string is at come next in their groups.
        emits = np.flatnonzero(j != stop)
        i = j[emits]
        g = group[i]
        place = free[g]
        order[place] = i
        free[g] = place + 1
        j[emits] = smaller[i]
        turns = np.flatnonzero(j == stop)
        over = at[turns] >= end[turns]
        if over.any():
            live = np.ones(len(j), bool)
            live[turns[over]] = False
            at, j, stop, start, end = at[live], j[live], stop[live], start[live], end[live]
            turns = np.flatnonzero(j == stop)
        i = order[at[turns]]
        at[turns] += 1
        j[turns], stop[turns] = np.where(i == start[turns], n, i - 1), smaller[i]
    return order


def ordered(s: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """As suffix_orders: all strings go together but for the longest few, which go on their own, as a step of few strings costs
    nearly as much as one of many."""
    ends, order = np.cumsum(sizes), np.empty(len(s), np.int64)
    by_size = np.argsort(sizes, kind="stable")
    part = np.sort(by_size[: max(0, len(sizes) - FEW)])
    if len(part):
        n, to = sizes[part], np.cumsum(sizes[part])
        place = np.repeat(ends[part] - to, n) + np.arange(to[-1])
        order[place] = place[suffix_orders(s[place], n)]
    for k in by_size[len(part) :].tolist():
        start = ends[k] - sizes[k]
        order[start : ends[k]] = start + np.array(suffix_order(s[start : ends[k]].tolist()), np.int64)
    return order


def minima(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the K-byte strings of a text of SPAN bytes or more, and the least in each of its SPAN-byte strings."""
    n, windows = len(data) - K + 1, SPAN - K + 1
    power, mul, width, h, done = _SYMBOLS[np.frombuffer(data, np.uint8)], int(_MUL), 1, None, 0
    while True:
        if K & width:
            part = power[done : done + n]
            h = part.copy() if h is None else h * np.uint64(mul) + part
            done += width
        if width * 2 > K:
            break
        power = power[:-width] * np.uint64(mul) + power[width:]
        mul, width = mul * mul % (1 << 64), width * 2
    h = (h ^ h >> np.uint64(29)) * _MIX
    h ^= h >> np.uint64(32)
    least, step = h, 1
    while step * 2 <= windows:
        least, step = np.minimum(least[:-step], least[step:]), step * 2
    if step < windows:
        least = np.minimum(least[: n - windows + 1], least[windows - step :][: n - windows + 1])
    return h, least


def _portions(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Texts that are hashed in one go: some of about PORTION bytes together, or a long one; with the first one's number."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= PORTION:
            yield at, texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield at, texts[at:]


def _whole(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the SPAN-byte strings that lie in one of the texts, written one after the other, and where each text starts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    long = sizes >= SPAN
    turns = np.zeros(n + 1, np.int8)
    turns[starts[long]] += 1
    turns[(starts + sizes)[long] - SPAN + 1] -= 1
    return np.flatnonzero(np.cumsum(turns[:n], dtype=np.int8)), starts


def anchor_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, hash) of the different anchors of each of many texts."""
    found = []
    for base, part in _portions(texts):
        data = b"".join(part)
        if len(data) < SPAN:
            continue
        least = minima(data)[1]
        w, starts = _whole(part, len(least))
        if len(w):
            value = least[w]
            edge = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1] + 1) | (value[1:] != value[:-1])]))
            text, value = np.searchsorted(starts, w[edge], side="right") - 1, value[edge]
            # Empty texts start where the next one does: the last of these is it.
            by_text = np.lexsort((value, text))
            text, value = text[by_text], value[by_text]
            new = _edges(text, value)
            found.append((base + text[new], value[new]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of the text, hash, place, first and last start of the SPAN-byte strings that have it as their anchor, for each
    anchor of each of many texts, in their order."""
    none = np.zeros(0, np.int64)
    found = [(none, none.astype(np.uint64), none, none, none)]
    for base, part in _portions(texts):
        data = b"".join(part)
        if len(data) < SPAN:
            continue
        h, least = minima(data)
        w, starts = _whole(part, len(least))
        if not len(w):
            continue
        place = _places(h, least)[w]
        edge = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1] + 1) | (place[1:] != place[:-1])]))
        first, last, place = w[edge], w[np.append(edge[1:], len(w)) - 1], place[edge]
        text = np.searchsorted(starts, first, side="right") - 1
        start = starts[text]
        found.append((base + text, h[place], place - start, first - start, last - start))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _places(h: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The leftmost place of the least hash in each SPAN-byte string."""
    windows = SPAN - K + 1
    # These never go back.
    starts = np.arange(len(least))
    place = np.full(len(least), -1, np.int64)
    hits = np.flatnonzero(h[: len(least)] == least)
    # A window's minimum either stands at its start or is the next window's too, or has just come in at its end.
    fresh = np.empty(len(least), bool)
    fresh[-1:] = True
    fresh[:-1] = least[:-1] != least[1:]
    fresh[hits] = True
    place[hits] = hits
    later = np.flatnonzero(fresh & (place < 0))
    for lag in range(1, windows):
        if not len(later):
            break
        found = h[later + lag] == least[later]
        place[later[found]] = later[found] + lag
        later = later[~found]
    # The others have the same anchor as the window after them.
    known = np.where(place >= 0, starts, len(least))
    return place[np.minimum.accumulate(known[::-1])[::-1]]


def _members(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. up to each count."""
    upto = np.cumsum(counts)
    return np.arange(upto[-1] if len(upto) else 0) - np.repeat(upto - counts, counts)


def covered(text: np.ndarray, ends: np.ndarray, before: np.ndarray, group: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, ...]:
    """Snippets of anchors: text holds their bytes one after the other, ends where each ends, before the bytes that stand before
    its anchor, group its anchor's number (ascending), least its smallest id. (snippet, first, last, least): starts in a snippet
    from first to last whose strings have least as the smallest id of all snippets of the anchor that hold them."""
    sizes = np.diff(ends, prepend=0)
    starts = ends - sizes
    # The anchor of a snippet as one symbol: 0 ends a snippet, and so no shared string reaches past one; anchors come after bytes.
    anchor = text[(starts + before)[:, None] + np.arange(K)]
    name = 257 + group
    if ((anchor[1:] != anchor[:-1]).any(axis=1) & (group[1:] == group[:-1])).any():
        # Different anchors of one hash: names by the bytes.
        name = 257 + np.unique(anchor, axis=0, return_inverse=True)[1].reshape(-1)
    short = sizes - K + 2
    to = np.cumsum(short)
    k, i = np.repeat(np.arange(len(sizes)), short), _members(short)
    b = before[k]
    s = text[np.minimum(starts[k] + i + np.where(i > b, K - 1, 0), len(text) - 1)].astype(np.int32) + 1
    s[i == b] = name
    s[to - 1] = 0
    order = ordered(s, np.add.reduceat(short, _edges(group)))

    # Only starts up to the anchor have SPAN bytes.
    need = SPAN - K + 1
    order = order[i[order] <= short[k[order]] - 1 - need]
    run = _edges(group[k[order]], *(s[order + d] for d in range(need)))
    found = np.zeros(len(s), np.int64)
    found[order] = np.repeat(np.minimum.reduceat(least[k[order]], run), _lengths(run, len(order)))
    place = np.flatnonzero(i <= short[k] - 1 - need)
    found, k, i = found[place], k[place], i[place]
    new = _edges(k, found)
    return k[new], i[new], i[np.append(new[1:], len(i)) - 1], found[new]


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each id and text that loses any bytes: did, t1, spans (array of struct first, last: the bytes, in order).
    did is the id, the largest long for null; t1 is the text's hash."""
    small_batches(docs.sparkSession, 500)
    keep = Scratch(docs.sparkSession, "spans")
    texts = _texts(docs, id_col, text_col)
    with tidy(docs.sparkSession):
        first = keep.table(texts.groupBy("t1", "t2").agg(F.min("did").alias("did")), "first")
        frequent = _frequent(texts, first.count())

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, hashes = anchor_hashes(_bytes(batch.column("text")))
            hashes, t1 = hashes.view(np.int64), batch.column("t1").to_numpy()[text]
            rare = ~_among(hashes, frequent)
            yield pa.RecordBatch.from_arrays([pa.array(hashes[rare]), pa.array(t1[rare])], names=["hash", "t1"])

    pairs = texts.select("text", "t1").mapInArrow(emit, "hash long, t1 long")
    of_hash = Window.partitionBy("hash")
    shared = pairs.withColumn("many", F.min("t1").over(of_hash) < F.max("t1").over(of_hash)).filter("many").groupBy("t1").agg(F.collect_set("hash").alias("hashes"))
    # Else the pairs' shuffle files lie beside those of the texts and the snippets.
    with tidy(docs.sparkSession):
        wanted = keep.table(first.drop("t2").join(shared, "t1", "left" if len(frequent) else "inner"), "anchors")
    sources = texts.select("did", "t1", "text").filter("text IS NOT NULL").join(wanted, ["t1", "did"])

    def snip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A few MB of text at a time, however long the texts are.
            size = np.cumsum(pc.binary_length(batch.column("text").cast(pa.binary())).to_numpy()) // (16 * PORTION)
            bounds = [*_edges(size).tolist(), batch.num_rows]
            for a, b in zip(bounds, bounds[1:], strict=False):
                yield cut_out(batch.slice(a, b - a))

    def cut_out(batch: pa.RecordBatch) -> pa.RecordBatch:
        """The snippets of some texts; what they repeat is one row with all its places."""
        texts, lists = _bytes(batch.column("text")), batch.column("hashes")
        count = np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
        wanted = lists.flatten().to_numpy(), np.repeat(np.arange(len(texts)), count)
        text, key, before, first, last = _dealt(texts, wanted, frequent)
        seen: dict[tuple[int, int, bytes], int] = {}
        row = np.array([seen.setdefault((h, b, texts[t][f : l + SPAN]), len(seen)) for t, h, b, f, l in zip(text.tolist(), key.tolist(), before.tolist(), first.tolist(), last.tolist(), strict=True)], np.int64)
        columns = list(zip(*seen, strict=True)) or [()] * 3
        by_row = np.argsort(row, kind="stable")
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(seen)))]).astype(np.int32))
        owners = [batch.column(c).to_numpy()[text[by_row]] for c in ("did", "t1")] + [first[by_row]]
        return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.binary()), strict=True)), *(pa.ListArray.from_arrays(offsets, pa.array(o)) for o in owners)], names=["hash", "before", "snippet", "dids", "t1s", "ats"])

    snippets = sources.mapInArrow(snip, "hash long, before int, snippet binary, dids array<long>, t1s array<long>, ats array<long>")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    with tidy(docs.sparkSession):
        runs = keep.table(snippets.repartition(n, "hash").sortWithinPartitions("hash", "before", "snippet").mapInArrow(_runs, "t1 long, did long, first long, last long"), "runs")
    keep.drop("anchors")

    copies = texts.select("did", "t1", "t2", F.octet_length("text").alias("size")).filter(F.col("size") >= SPAN).join(first.withColumnRenamed("did", "least"), ["t1", "t2"]).filter("did > least")
    copies = copies.select("t1", "did", F.lit(0).cast("long").alias("first"), (F.col("size") - 1).cast("long").alias("last"))
    return _merged(runs.unionByName(copies))


def _frequent(texts: DataFrame, n: int) -> np.ndarray:
    """Hashes of the anchors that one in RARE of a sample of texts has, ascending: at most FREQUENT, the most frequent."""
    part = texts.filter(F.pmod("t1", F.lit(max(1, n // SAMPLE))) == 0).select("text", "t1").dropDuplicates(["t1"]).select("text")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(anchor_hashes(_bytes(batch.column("text")))[1].view(np.int64))], names=["hash"])

    counts = part.mapInArrow(emit, "hash long").groupBy("hash").count().filter(F.col("count") > max(20, min(n, SAMPLE) // RARE))
    return np.sort(np.array([r.hash for r in counts.orderBy(F.desc("count"), "hash").limit(FREQUENT).collect()], np.int64))


def _among(values: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which values are in held (ascending)."""
    if not len(held):
        return np.zeros(len(values), bool)
    return held[np.minimum(np.searchsorted(held, values), len(held) - 1)] == values


def _bytes(texts: pa.Array) -> list[bytes]:
    return [x or b"" for x in texts.cast(pa.binary()).to_pylist()]


def _dealt(texts: list[bytes], shared: tuple[np.ndarray, np.ndarray], frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of the text, key, bytes before the anchor, first and last start of the strings that go on: by their anchor where
    shared (hashes, numbers of the texts that they are shared in) has it, by more of the string where frequent has it."""
    t, h, p, f, l = anchors(texts)
    h = h.view(np.int64)
    # Both by text and hash: what is shared stands next to the anchors that have it.
    by = np.lexsort((np.concatenate([np.zeros(len(shared[0]), bool), np.ones(len(h), bool)]), np.concatenate([shared[0], h]), np.concatenate([shared[1], t])))
    mark, hash_, text = by < len(shared[0]), np.concatenate([shared[0], h])[by], np.concatenate([shared[1], t])[by]
    edge = _edges(hash_, text)
    held = np.repeat(mark[edge], _lengths(edge, len(by))) if len(by) else mark
    few = np.sort(by[held & ~mark] - len(shared[0]))
    many = np.flatnonzero(_among(h, frequent))
    if not len(many):
        return t[few], h[few], (p - f)[few], f[few], l[few]
    # Strings that hold SIDE bytes before the anchor, and those that hold as many after it.
    sides = []
    for k in many.tolist():
        data, at, mid = texts[t[k]], int(p[k]), int(p[k]) - SIDE
        if f[k] <= mid:
            sides.append((int(t[k]), xxhash.xxh64_intdigest(data[mid : at + K], 1), at - int(f[k]), int(f[k]), min(int(l[k]), mid)))
        if l[k] > mid:
            start = max(int(f[k]), mid + 1)
            sides.append((int(t[k]), xxhash.xxh64_intdigest(data[at : at + SPAN - SIDE + 1], 2), at - start, start, int(l[k])))
    text, key, *rest = zip(*sides, strict=True)
    columns = np.array(text), np.array(key, np.uint64).view(np.int64), *map(np.array, rest)
    return tuple(np.concatenate([x[few], y]) for x, y in zip((t, h, p - f, f, l), columns, strict=True))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """did, t1 and t2 (hashes of the text that together name it), text."""
    text = F.col(text_col)
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("did"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), text.alias("text"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covered byte ranges of texts. Rows come sorted by hash and snippet, so that an anchor's snippets, and of these the equal
    ones, follow each other."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None

    def settled(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        hashes, before, snippet = (rows.column(c).combine_chunks() for c in ("hash", "before", "snippet"))
        dids, t1s, ats = (rows.column(c).combine_chunks() for c in ("dids", "t1s", "ats"))
        h, b = hashes.to_numpy(), before.to_numpy().astype(np.int64)
        # Equal snippets are one, with the owners of all.
        equal = pc.equal(snippet[1:], snippet[:-1]).to_numpy(zero_copy_only=False) & (h[1:] == h[:-1]) & (b[1:] == b[:-1]) if len(h) > 1 else np.zeros(0, bool)
        lead = np.flatnonzero(np.r_[True, ~equal])
        count = np.diff(dids.offsets.to_numpy())
        did, t1, at = (x.flatten().to_numpy() for x in (dids, t1s, ats))
        owner = np.r_[0, np.cumsum(count)][np.r_[lead, len(h)]]
        least, most = np.minimum.reduceat(did, owner[:-1]), np.maximum.reduceat(did, owner[:-1])
        text = snippet.take(pa.array(lead))
        ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
        flat = np.frombuffer(text.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        ends, edge = (ends - ends[0]).astype(np.int64), _edges(h[lead])
        group = np.repeat(np.arange(len(edge)), _lengths(edge, len(lead)))
        k, first, to, by = covered(flat, ends[1:], b[lead], group, least)
        some = most[k] > by
        k, first, to, by = k[some], first[some], to[some], by[some]
        n = np.diff(owner)[k]
        who = np.repeat(owner[:-1][k], n) + _members(n)
        later = did[who] > np.repeat(by, n)
        who, first, to = who[later], np.repeat(first, n)[later], np.repeat(to, n)[later]
        return pa.RecordBatch.from_arrays([pa.array(t1[who]), pa.array(did[who]), pa.array(at[who] + first), pa.array(at[who] + to + SPAN - 1)], names=["t1", "did", "first", "last"])

    for batch in batches:
        if not batch.num_rows:
            continue
        h = batch.column("hash").to_numpy()
        if size >= BATCH and (h[-1] != h[0] or h[0] != last):
            # Up to the first row of an anchor that hasn't begun yet.
            whole = int(np.argmax(h != last))
            yield settled(pa.Table.from_batches([*held, batch.slice(0, whole)]))
            batch, size = batch.slice(whole), 0
            held = []
        held.append(batch)
        size += batch.column("snippet").nbytes if batch.num_rows else 0
        last = h[-1]
    if held:
        yield settled(pa.Table.from_batches(held))


def _merged(runs: DataFrame) -> DataFrame:
    """Overlapping and touching ranges of a text as one, in order."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for r in batch.column("ranges"):
                flat = r.values
                first, last = flat.field("first").to_numpy(), flat.field("last").to_numpy()
                order = np.argsort(first, kind="stable")
                first, last = first[order], np.maximum.accumulate(last[order])
                new = np.flatnonzero(np.r_[True, first[1:] > last[:-1] + 1])
                spans.append([{"first": a, "last": b} for a, b in zip(first[new].tolist(), last[np.r_[new[1:] - 1, len(last) - 1]].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("t1"), batch.column("did"), pa.array(spans, _SPANS)], names=["t1", "did", "spans"])

    ranges = runs.groupBy("t1", "did").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    return ranges.mapInArrow(merge, "t1 long, did long, spans array<struct<first:bigint,last:bigint>>")


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def with_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs and repeated: the byte ranges that an earlier document has (empty for none)."""
    keyed = sealed(docs, {"did": F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)), "t1": F.xxhash64(F.col(text_col))}, ["repeated"])
    found = keyed.join(repeated_spans(docs, id_col, text_col), ["t1", "did"], "left")
    return unsealed(found, F.coalesce("spans", F.array().cast("array<struct<first:bigint,last:bigint>>")).alias("repeated"))


def kept(data: bytes, spans: list[dict]) -> bytes:
    parts, at = [], 0
    for s in spans:
        parts.append(data[at : s["first"]])
        at = s["last"] + 1
    return b"".join([*parts, data[at:]])


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_spans(documents(spark, sf_dir).select("doc_id", "text"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, text, spans in zip(*(batch.column(c) for c in ("doc_id", "text", "repeated")), strict=True):
                data, runs = (text.as_py() or "").encode(), spans.as_py()
                rest = kept(data, runs)
                rows.append((i.as_py(), len(data), len(data) - len(rest), len(runs), sha256(rest).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return found.mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 100)) AS k FROM d, unnest(range(0, n - 49)) AS t(i)),
f AS (SELECT k, min(doc_id) AS least FROM w GROUP BY k),
hit AS (SELECT w.doc_id, i, i - lag(i) OVER (PARTITION BY w.doc_id ORDER BY i) AS gap FROM w JOIN f USING (k) WHERE w.doc_id > least),
run AS (SELECT doc_id, i, sum(CASE WHEN gap <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM hit),
span AS (SELECT doc_id, g, min(i) AS a, max(i) + 50 AS b FROM run GROUP BY doc_id, g),
cut AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM span),
kept AS (
  SELECT c.doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS rest
  FROM cut c JOIN d USING (doc_id) GROUP BY c.doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
