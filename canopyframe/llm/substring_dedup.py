"""Exact removal of repeated 100-byte strings by sharded suffix arrays.

Every byte covered by a ``width``-byte string that also starts earlier (smaller
doc_id, or the same id at a smaller offset) is removed; strings are judged on
the input and never cross documents.

A suffix array over a whole corpus would need every text in one place, so the
suffixes that could matter are found first, without loss:

1.  Each window of ``width`` bytes has an anchor: the leftmost of its 32-byte
    grams of least hash.  Equal windows have equal anchors at equal offsets, so
    a window can only repeat where its anchor's hash occurs twice.  Anchors are
    about one byte in 35.
    Hashes are counted first; a bitmap of bounded size, made from those that
    occur twice, spares the others the shuffle (an exact join follows it).
2.  Anchors that occur twice are grouped by hash, and those with the same
    surroundings (all bytes that their windows can cover) fold into the
    earliest one: every window of a later one starts earlier there.
3.  Surroundings that differ under one hash go, by hash, to shards.  A shard
    sorts its suffixes by Larsson-Sadakane refinement (only groups that are
    still tied are sorted again, by the ranks ``h`` and ``2 h`` further on, ``h``
    tripling),
    takes common prefixes of neighbours by Kasai's method, run in lock step
    over the surroundings, and keeps in each run of common prefixes of
    ``width`` or more the earliest window; the others are removed.
4.  A hash with more than ``SHARD`` surroundings is split over several shards.
    Their earliest windows are merged, shard by shard, in order of their keys:
    each finds its place among those merged so far by binary search, and of
    equal ones the earliest stays.

Removed windows meet per document, where they are joined to spans.

Defined cases: null text is empty; a text shorter than ``width`` keeps all; a
null doc_id sorts first; rows of one id are ordered by offset alone, so equal
rows do not remove each other; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from ._shared import materialize

WIDTH = 100
GRAM = 32
#: Bytes handled at once (arrays that stay in the cache); positions must fit the low bits of a packed minimum.
CHUNK, POSITION_BITS = 1 << 16, 22
BATCH_BYTES = 1 << 22
#: Bits of the bitmap of repeated hashes: 16 for each, between these (128 KB to 128 MB).
LEAST_BITMAP, MOST_BITMAP = 1 << 20, 1 << 30
SHARD = 4096
SHARD_BYTES = 1 << 16
#: Windows that a part of the merge across shards holds, about.
PART_WINDOWS = 16_000


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at each position of uint8 data."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    at = lambda k: np.ndarray((n,), dtype="<u8", buffer=data, offset=k, strides=(1,))
    with np.errstate(over="ignore"):
        h = at(0) * np.uint64(0x9E3779B97F4A7C15)
        for k in range(8, GRAM, 8):
            h ^= h >> np.uint64(29)
            h += at(k)
            h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
    return h


def window_anchors(hashes: np.ndarray, width: int) -> np.ndarray:
    """Position of the anchor of the window at each start."""
    span = width - GRAM + 1
    low = np.uint64((1 << POSITION_BITS) - 1)
    # position in the low bits: of equal hashes the leftmost is least
    least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    reach = 1
    while reach * 2 <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < span:
        least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
    return (least & low).astype(np.int64)


def in_bitmap(hashes: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    x = hashes.view(np.uint64) & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[(x >> np.uint64(3)).astype(np.int64)] >> (x & np.uint64(7)).astype(np.uint8)) & 1 == 1


def hash_bitmap(hashes: DataFrame) -> np.ndarray:
    """Bitmap of the low bits of a column ``h``; at most MOST_BITMAP / 8 bytes reach the driver."""
    bits = min(MOST_BITMAP, max(LEAST_BITMAP, 1 << (16 * hashes.count()).bit_length()))
    low = F.pmod("h", F.lit(bits))
    parts = hashes.select(F.floor(low / 32768).cast("int").alias("part"), (low % 32768).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(bits // 8, dtype=np.uint8)
    for row in parts.collect():
        out[row["part"] * 4096 : (row["part"] + 1) * 4096] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out


def anchors(texts: list[bytes], width: int = WIDTH, surroundings: bool = True, bitmap: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """doc (index), at (offset), before, after, h, c of every anchor of some texts (of those in the bitmap, if one is given).

    ``before`` and ``after`` say which windows have this anchor: they start
    from ``at - before`` to ``at - after``.  ``c`` hashes the surroundings,
    ``at - (width - GRAM)`` to ``at + width``, with what a text's ends cut off.
    """
    margin = width - GRAM
    out: dict[str, list[np.ndarray]] = {k: [] for k in ("doc", "at", "before", "after", "h", "c")}

    def pack(parts: list[tuple[int, int, int, bytes, int]]) -> None:
        """Parts of texts: (doc, offset of its first byte, first offset to emit, bytes, end of the offsets to emit)."""
        data = np.frombuffer(b"".join(p[3] for p in parts), dtype=np.uint8)
        if len(data) < width:
            return
        hashes = gram_hashes(data)
        anchor = window_anchors(hashes, width)
        sizes = np.array([len(p[3]) for p in parts])
        begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        windows = np.maximum(sizes - width + 1, 0)
        part = np.repeat(np.arange(len(parts)), windows)
        starts = np.arange(len(part)) - np.repeat(np.cumsum(windows) - windows, windows) + begins[part]
        anchor = anchor[starts]
        if not len(anchor):
            return
        first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])])
        last = np.r_[first[1:], len(anchor)] - 1
        p, a = part[first], anchor[first]
        offset = np.array([x[1] for x in parts])[p] + a - begins[p]
        mine = (offset >= np.array([x[2] for x in parts])[p]) & (offset < np.array([x[4] for x in parts])[p])
        if bitmap is not None:
            mine &= in_bitmap(hashes[a], bitmap)
        first, last, p, a, offset = first[mine], last[mine], p[mine], a[mine], offset[mine]
        out["doc"].append(np.array([x[0] for x in parts])[p])
        out["at"].append(offset)
        out["before"].append(a - starts[first])
        out["after"].append(a - starts[last])
        out["h"].append(hashes[a].view(np.int64))
        if surroundings:
            lo, hi = np.maximum(begins[p], a - margin), np.minimum(begins[p] + sizes[p], a + width)
            view, digest = memoryview(data), xxhash.xxh3_64_intdigest
            cut = ((a - lo) * 256 + (hi - a)).tolist()
            c = [digest(view[x:y], s) for x, y, s in zip(lo.tolist(), hi.tolist(), cut)]
            out["c"].append(np.array(c, dtype=np.uint64).view(np.int64))

    held, size = [], 0
    for i, text in enumerate(texts):
        if len(text) < width:
            continue
        # a long text goes in stretches that know all windows and surroundings of the anchors they emit
        for at in range(0, len(text), CHUNK):
            lo, hi = max(0, at - margin - width), min(len(text), at + CHUNK + margin + width)
            part = (i, lo, at, text[lo:hi], min(len(text), at + CHUNK))
            if size + len(part[3]) > CHUNK and held:
                pack(held)
                held, size = [], 0
            held.append(part)
            size += len(part[3])
    if held:
        pack(held)
    return {k: np.concatenate(v) if v else np.empty(0, dtype=np.int64) for k, v in out.items()}


def _anchor_batches(surroundings: bool, bitmap=None):
    """``bitmap`` is a broadcast of :func:`hash_bitmap`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = bitmap.value if bitmap is not None else None
        for batch in batches:
            d, t = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("d", "t"))
            raw = batch.column("text").cast(pa.binary())
            held, size, first = [], 0, 0
            for i in range(len(raw) + 1):
                if i == len(raw) or size > BATCH_BYTES:
                    a = anchors(held, surroundings=surroundings, bitmap=wanted)
                    if surroundings:
                        doc = a["doc"] + first
                        yield pa.record_batch(
                            [pa.array(x) for x in (a["h"], a["c"], d[doc], t[doc].astype(np.int32), a["at"].astype(np.int64), (a["before"] * 256 + a["after"]).astype(np.int32))],
                            ["h", "c", "d", "t", "at", "reach"],
                        )
                    else:
                        yield pa.record_batch([pa.array(a["h"])], ["h"])
                    held, size, first = [], 0, i
                if i < len(raw):
                    held.append(raw[i].as_py() or b"")
                    size += len(held[-1])

    return run


# --- suffix arrays of a shard ------------------------------------------------


#: Symbols (nine bits each) that one 64-bit word holds.
WORD_SYMBOLS = 7


def symbol_words(lanes: np.ndarray) -> np.ndarray:
    """The next WORD_SYMBOLS symbols at each place as one number, zeros past a lane's end."""
    n, length = lanes.shape
    out = np.zeros((n, length), dtype=np.int64)
    padded = np.zeros((n, length + WORD_SYMBOLS), dtype=lanes.dtype)
    padded[:, :length] = lanes
    for k in range(WORD_SYMBOLS):
        out = (out << 9) | padded[:, k : k + length]
    return out.ravel()


def suffix_ranks(lanes: np.ndarray, depth: int, flat: np.ndarray | None = None) -> np.ndarray:
    """Rank of each suffix of each lane, sorted to at least ``depth`` symbols; ties share a rank.

    Sorted to the lanes' length, only suffixes that are equal to their ends
    tie, and these can be ordered by lane as all that follow them are.

    ``lanes`` is (n, length) with symbols from 1 and at least one 0 after each
    lane's end, so what is past an end has rank 0.
    Larsson-Sadakane refinement: tied groups are sorted by the ranks ``h`` and
    ``2 h`` further on, so ``h`` triples; a group that is no longer tied is left
    alone.
    """
    n, length = lanes.shape
    flat = symbol_words(lanes) if flat is None else flat
    order = np.argsort(flat)
    ranks = np.empty(n * length, dtype=np.int64)
    changed = np.r_[True, flat[order][1:] != flat[order][:-1]]
    ranks[order] = np.maximum.accumulate(np.where(changed, np.arange(len(order)), 0))
    sizes = np.diff(np.r_[np.flatnonzero(changed), len(order)])
    tied = order[np.repeat(sizes > 1, sizes)]
    h = WORD_SYMBOLS
    while h < depth and len(tied):
        column, size = tied % length, n * length
        beyond = lambda k: np.where(column + k < length, ranks[np.minimum(tied + k, size - 1)], 0)  # noqa: E731,B023
        further = beyond(h) * size + beyond(2 * h)
        here = ranks[tied]
        # tied holds whole groups, in order of their rank; three ranks fit one key below 2 ** 21 symbols
        again = np.argsort(here * (size * size) + further) if size < 1 << 21 else np.lexsort((further, here))
        tied, here, further = tied[again], here[again], further[again]
        group = np.r_[True, here[1:] != here[:-1]]
        split = group | np.r_[True, further[1:] != further[:-1]]
        begin = np.maximum.accumulate(np.where(group, np.arange(len(tied)), 0))
        inner = np.maximum.accumulate(np.where(split, np.arange(len(tied)), 0))
        ranks[tied] = here + (inner - begin)
        sizes = np.diff(np.r_[np.flatnonzero(split), len(tied)])
        tied = tied[np.repeat(sizes > 1, sizes)]
        h *= 3
    return ranks


def common_prefixes(lanes: np.ndarray, order: np.ndarray, most: int, columns: int | None = None, words: np.ndarray | None = None) -> np.ndarray:
    """Kasai: common prefix (up to ``most``) of each suffix in order with the one before it.

    Only suffixes of the first ``columns`` are looked at; the others count as 0.

    All lanes walk from left to right in lock step, each keeping what it
    carries over from its last suffix, less one.
    """
    n, length = lanes.shape
    text, words = lanes.ravel(), symbol_words(lanes) if words is None else words  # each lane ends in 0, where every comparison stops
    before = np.full(n * length, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    out = np.zeros(n * length, dtype=np.int64)
    lane = np.arange(n) * length
    carried = np.zeros(n, dtype=np.int64)
    for column in range(length if columns is None else columns):
        i = lane + column
        j = before[i]
        live = np.flatnonzero((j >= 0) & (carried < most))
        carried[j < 0] = 0
        whole = live
        while len(whole):  # word by word, while no lane ends within
            more = carried[whole]
            x = words[i[whole] + more]
            whole = whole[(x == words[j[whole] + more]) & (x & 511 != 0)]
            carried[whole] += WORD_SYMBOLS
            whole = whole[carried[whole] < most]
        live = live[carried[live] < most]
        while len(live):
            more = carried[live]
            x = text[i[live] + more]
            live = live[(x == text[j[live] + more]) & (x != 0)]
            carried[live] += 1
            live = live[carried[live] < most]
        np.minimum(carried, most, out=carried)
        out[i] = carried
        carried = np.maximum(carried - 1, 0)
    return out[order]


def earliest_windows(texts: list[bytes], starts: np.ndarray, counts: np.ndarray, d: np.ndarray, at: np.ndarray, groups: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of a shard's surroundings: lane, column, and for each its run and whether it is the earliest of the run.

    Lane i has windows at columns ``starts[i]`` to ``starts[i] + counts[i] - 1``;
    column 0 of lane i is offset ``at[i]`` of document ``d[i]``.  Windows are
    compared within a group, ``groups[i]``, whose lanes come in order of
    document and anchor.
    """
    length = max(map(len, texts)) + 1
    lanes = np.zeros((len(texts), length), dtype=np.int16)
    for i, x in enumerate(texts):
        lanes[i, : len(x)] = np.frombuffer(x, dtype=np.uint8)
    for i, x in enumerate(texts):
        lanes[i, : len(x)] += 1
    words = symbol_words(lanes)
    ranks = suffix_ranks(lanes, length, words)
    order = np.argsort(ranks * len(ranks) + np.arange(len(ranks)))  # full ties by lane
    runs = np.empty(len(order), dtype=np.int64)
    # a suffix too short for a window shares none
    runs[order] = np.cumsum(common_prefixes(lanes, order, width, length - width, words) < width)
    lane = np.repeat(np.arange(len(texts)), counts)
    column = np.repeat(starts, counts) + np.arange(len(lane)) - np.repeat(np.cumsum(counts) - counts, counts)
    run, doc, offset = runs[lane * length + column], d[lane], at[lane] + column
    # equal windows lie equally far from equal anchors, so a group's first lane has the earliest
    of = run * (groups.max() + 1) + groups[lane]
    by_run = np.argsort(of * len(of) + np.arange(len(of)))
    head = np.r_[True, of[by_run][1:] != of[by_run][:-1]]
    lead = by_run[np.maximum.accumulate(np.where(head, np.arange(len(by_run)), 0))]
    earliest = np.empty(len(lane), dtype=bool)
    earliest[by_run] = (doc[by_run] == doc[lead]) & (offset[by_run] == offset[lead])
    return lane, column, run, earliest


FOUND = "d long, t int, lo long, hi long, salt long, key binary"


def _found(d, t, lo, hi, salt=None, key=None) -> pa.RecordBatch:
    """Runs of windows; those that other shards must see have a shard and a key."""
    extra = [pa.nulls(len(d), pa.int64()) if salt is None else pa.array(salt, pa.int64()), pa.nulls(len(d), pa.binary()) if key is None else pa.array(key, pa.binary())]
    return pa.record_batch([pa.array(d, pa.int64()), pa.array(t, pa.int32()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), *extra], ["d", "t", "lo", "hi", "salt", "key"])


def _shard_windows(rows: dict[str, list]) -> pa.RecordBatch:
    """Removed runs of windows of one shard and, where its hashes are split over shards, its earliest windows with their keys."""
    d, t, base, split, salt = (np.array(rows[k], dtype=np.int64) for k in ("d", "t", "base", "split", "salt"))
    starts, counts = np.array(rows["start"]), np.array(rows["count"])
    lane, column, _, earliest = earliest_windows(rows["text"], starts, counts, d, base, np.array(rows["group"]))
    gone = np.flatnonzero(~earliest)
    new = np.r_[True, (lane[gone][1:] != lane[gone][:-1]) | (column[gone][1:] != column[gone][:-1] + 1)] if len(gone) else gone.astype(bool)
    heads, tails = gone[np.flatnonzero(new)], gone[np.r_[np.flatnonzero(new)[1:], len(gone)] - 1] if len(gone) else gone
    at = lambda i: base[lane[i]] + column[i]
    removed = _found(d[lane[heads]], t[lane[heads]], at(heads), at(tails))
    kept = np.flatnonzero(earliest & (split[lane] > 1))
    if not len(kept):
        return removed
    digests = [xxhash.xxh3_128_digest(rows["text"][i][c : c + WIDTH]) for i, c in zip(lane[kept].tolist(), column[kept].tolist())]
    open_ = _found(d[lane[kept]], t[lane[kept]], at(kept), at(kept), salt[lane[kept]], digests)
    return pa.Table.from_batches([removed, open_]).combine_chunks().to_batches()[0]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Surroundings, sorted by (h, salt), to windows; a group may go on over several batches."""
    names = ("d", "t", "base", "salt", "split", "start", "count", "text")
    rows: dict[str, list] = {k: [] for k in (*names, "group")}
    size, key, number = 0, None, -1
    for batch in batches:
        columns = {k: batch.column(k).to_pylist() for k in names}
        groups = list(zip(batch.column("h").to_pylist(), batch.column("salt").to_pylist()))
        for i, group in enumerate(groups):
            if group != key:
                if size > SHARD_BYTES:
                    yield _shard_windows(rows)
                    rows, size, number = {k: [] for k in rows}, 0, -1
                key, number = group, number + 1
            rows["group"].append(number)
            for k in names:
                rows[k].append(columns[k][i])
            size += len(columns["text"][i])
    if rows["d"]:
        yield _shard_windows(rows)


def merge_shards(shards: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Which windows of each shard start later than an equal one of another shard.

    A shard is (keys in order, doc, offset).  Shards are merged one after the
    other: the keys of the next find their places among those merged so far by
    binary search, equal ones keep the earliest start, the others are put in at
    their places.  Then every window finds its key and compares.
    """
    keys, doc, at = (c[:0].copy() for c in shards[0])
    for k, d, o in shards:
        first = np.r_[True, k[1:] != k[:-1]] if len(k) else np.zeros(0, dtype=bool)
        order = np.lexsort((o, d, np.cumsum(first)))  # equal keys of one shard: the earliest goes first
        k, d, o = (c[order][first] for c in (k, d, o))
        place = np.searchsorted(keys, k)
        met = np.flatnonzero(place < len(keys))
        met = met[keys[place[met]] == k[met]]
        old = place[met]
        earlier = (d[met] < doc[old]) | ((d[met] == doc[old]) & (o[met] < at[old]))
        doc[old[earlier]], at[old[earlier]] = d[met[earlier]], o[met[earlier]]
        new = np.setdiff1d(np.arange(len(k)), met, assume_unique=True)
        keys, doc, at = np.insert(keys, place[new], k[new]), np.insert(doc, place[new], d[new]), np.insert(at, place[new], o[new])
    places = [np.searchsorted(keys, k) for k, _, _ in shards]
    return [(d != doc[p]) | (o != at[p]) for (_, d, o), p in zip(shards, places)]


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Earliest windows of split hashes, sorted by (part, salt, key): all but the first of each key are removed; a part holds all of a key and may go on over several batches."""

    def removed(rows: tuple) -> pa.RecordBatch:
        salt, keys, d, t, lo = rows
        cuts = np.flatnonzero(np.r_[True, salt[1:] != salt[:-1]])
        shards = [(keys[x], d[x], lo[x]) for x in (slice(p, q) for p, q in zip(cuts, [*cuts[1:], len(salt)]))]
        gone = np.flatnonzero(np.concatenate(merge_shards(shards)))
        return _found(d[gone], t[gone], lo[gone], lo[gone])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)  # noqa: E731,B023
        keys = np.frombuffer(b"".join(batch.column("key").to_pylist()), dtype="S16")
        now = column("part"), (column("salt"), keys, column("d"), column("t"), column("lo"))
        part, rows = now if held is None else (np.r_[held[0], now[0]], tuple(np.concatenate(x) for x in zip(held[1], now[1])))
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        for p, q in zip(cuts[:-1], cuts[1:]):
            yield removed(tuple(c[p:q] for c in rows))
        held = part[cuts[-1] :], tuple(c[cuts[-1] :] for c in rows)
    if held is not None:
        yield removed(held[1])


def _cut_surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their anchors to look at, to one row per anchor with its surroundings."""
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("h", "salt", "split", "d", "t", "at", "base", "start", "count", "text")}
        ds, ts = (batch.column(c).to_pylist() for c in ("d", "t"))
        lists = batch.column("places")
        ends = lists.offsets.to_numpy().tolist()
        place = {f: lists.values.field(f).to_numpy(zero_copy_only=False) for f in ("h", "salt", "split", "at", "reach")}
        size = 0
        unpack = zstandard.ZstdDecompressor().decompress
        for row, (d, t, packed) in enumerate(zip(ds, ts, batch.column("packed"))):
            raw = unpack(packed.as_py())
            of = slice(ends[row], ends[row + 1])
            for h, salt, split, at, reach in zip(*(place[f][of].tolist() for f in place)):
                before, after = reach >> 8, reach & 255
                lo, hi = at - before, at - after + WIDTH  # what the anchor's windows cover
                for k, v in (("h", h), ("salt", salt), ("split", split), ("d", d), ("t", t), ("at", at), ("base", lo), ("start", 0), ("count", before - after + 1), ("text", raw[lo:hi])):
                    out[k].append(v)
                size += hi - lo
            if size > BATCH_BYTES:
                yield _cut_batch(out)
                out, size = {k: [] for k in out}, 0
        yield _cut_batch(out)


CUT = "h long, salt long, split long, d long, t int, at long, base long, start int, count int, text binary"


def _cut_batch(out: dict[str, list]) -> pa.RecordBatch:
    kinds = {"t": pa.int32(), "start": pa.int32(), "count": pa.int32(), "text": pa.binary()}
    return pa.record_batch([pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()], list(out))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        packed = [squeeze(x.as_py() or b"") for x in batch.column("text").cast(pa.binary())]
        at = batch.schema.names.index("text")
        yield pa.record_batch([pa.array(packed, pa.binary()) if i == at else c for i, c in enumerate(batch.columns)], [n if i != at else "packed" for i, n in enumerate(batch.schema.names)])


def packed(keyed: DataFrame) -> DataFrame:
    """The rows with their text compressed: texts cross the network for every join by document."""
    names = ", ".join("packed binary" if f.name == "text" else f"{f.name} {f.dataType.simpleString()}" for f in keyed.schema.fields)
    return keyed.mapInArrow(_pack, names)


def removed_windows(keyed: DataFrame) -> DataFrame:
    """d, t, lo, hi: runs of starts of removed windows, from documents with d, t, text."""
    plain = keyed.mapInArrow(_anchor_batches(False), "h long")
    twice = materialize(plain.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"))
    bitmap = keyed.sparkSession.sparkContext.broadcast(hash_bitmap(twice))
    full = keyed.mapInArrow(_anchor_batches(True, bitmap), "h long, c long, d long, t int, at long, reach int")
    members = materialize(full.join(twice, "h", "left_semi"))
    firsts = materialize(members.groupBy("h", "c").agg(F.min(F.struct("d", "at", "t", "reach")).alias("first")))
    # a later anchor with the same surroundings: all its windows start earlier there
    later = members.join(firsts, ["h", "c"]).where((F.col("d") != F.col("first.d")) | (F.col("at") != F.col("first.at")))
    copies = later.select("d", "t", (F.col("at") - F.shiftright("reach", 8)).alias("lo"), (F.col("at") - F.col("reach").bitwiseAND(255)).alias("hi"))
    # different surroundings under one hash: suffix arrays
    several = firsts.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    split = F.ceil(F.col("n") / SHARD)
    places = firsts.join(several, "h").select(
        F.col("first.d").alias("d"), F.col("first.t").alias("t"),
        F.struct("h", F.pmod(F.xxhash64("c"), split).alias("salt"), split.alias("split"), F.col("first.at").alias("at"), F.col("first.reach").alias("reach")).alias("place"),
    )
    by_doc = places.groupBy("d", "t").agg(F.collect_list("place").alias("places"))
    surroundings = packed(keyed).join(by_doc, ["d", "t"]).select("d", "t", "packed", "places").mapInArrow(_cut_surroundings, CUT)
    found = materialize(surroundings.repartition("h", "salt").sortWithinPartitions("h", "salt", "d", "at").mapInArrow(_shards, FOUND))
    inside = found.where(F.col("key").isNull()).select("d", "t", "lo", "hi")
    # windows of all shards meet by the leading bits of their keys, in as many parts as keep each small
    open_ = found.where(F.col("key").isNotNull()).withColumn("part", F.pmod(F.xxhash64(F.substring("key", 1, 8)), F.lit(max(1, found.where(F.col("key").isNotNull()).count() // PART_WINDOWS))))
    across = open_.repartition("part").sortWithinPartitions("part", "salt", "key").mapInArrow(_merge, FOUND).select("d", "t", "lo", "hi")
    return copies.unionByName(inside).unionByName(across)


def merged_spans(windows: list[tuple[int, int]], width: int = WIDTH) -> list[tuple[int, int]]:
    """Maximal runs of bytes (end exclusive) that windows starting from lo to hi cover."""
    out: list[list[int]] = []
    for lo, hi in sorted(windows):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + width)
        else:
            out.append([lo, hi + width])
    return [(a, b) for a, b in out]


def kept_bytes(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    pieces, at = [], 0
    for a, b in spans:
        pieces.append(raw[at:a])
        at = b
    return b"".join([*pieces, raw[at:]])


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, unpack = [], zstandard.ZstdDecompressor().decompress
        for text, windows in zip(batch.column("packed"), batch.column("windows")):
            raw = unpack(text.as_py())
            spans = merged_spans([(w["lo"], w["hi"]) for w in windows.as_py() or ()])
            rows.append((len(raw), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept_bytes(raw, spans)).hexdigest()))
        cols = list(zip(*rows)) or [()] * 4
        yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], [c.split()[0] for c in SCHEMA.split(", ")])


def with_windows(documents: DataFrame) -> DataFrame:
    """doc_id, packed text, windows (runs of starts of removed windows, or null) of every row."""
    keyed = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 62))).alias("d"),
        F.xxhash64("text").bitwiseAND(0x7FFFFFFF).cast("int").alias("t"), "text",
    )
    # written before the texts are dealt, so that only one of the two large shuffles is on disk at a time
    by_doc = materialize(removed_windows(keyed.select("d", "t", "text")).groupBy("d", "t").agg(F.collect_list(F.struct("lo", "hi")).alias("windows")))
    return packed(keyed).join(by_doc, ["d", "t"], "left").select("doc_id", "packed", "windows")


def digest(documents: DataFrame) -> DataFrame:
    """The columns of the query."""
    return with_windows(documents).mapInArrow(_apply, SCHEMA)
