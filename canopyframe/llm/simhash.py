"""SimHash near-duplicates with pivot distance tables.

Fingerprints: A-Z lower-cased, words cut at ASCII white space, word shingles
with repeats, XXH64 (seed 42) of each, a bit set where over half the hashes
have it set.  Wider fingerprints mix each hash into further 64-bit words.

Equal fingerprints fold to one first.  Fingerprints are dealt to buckets and
meet only there.  Within a bucket each fingerprint has a table of its Hamming
distances to reference fingerprints; a pair whose tables differ by more than
the radius in any coordinate is discarded, survivors are verified.  A bucket
gives one link at most per fingerprint, never all pairs; connected components
then run over the links.

* A small radius (:func:`classes`), exactly: the 64 bits are cut into ``blocks``
  pieces; two fingerprints within the radius agree on at least ``blocks -
  radius`` of them, so there is a bucket for each choice of that many pieces.
  A bucket of more than ``SPLIT`` fingerprints is dealt again by the distances
  to two pivots, which differ by the radius at most for a link, so each goes to
  the cells (``2 * radius + 1`` wide) that it can share with a link; no link is
  lost.
* A similarity (:func:`near_copies`): two texts are near copies if their sets of
  five-word shingles have a Jaccard similarity of ``SIMILARITY`` or more.
  ``BANDS`` buckets a text, each by ``ROWS`` least hashes over its shingles:
  their number does not depend on how many texts there are, and a pair at the
  limit shares a bucket with probability 0.995.  There pairs within ``FAR`` of
  the bits of a fingerprint of the shingle set survive, and the shortest links
  that span them are kept.  A link within ``SURE`` of the bits stands; the
  others stand if the two shingle sets, compared exactly, are similar enough.
  A crowded bucket is dealt again by sampled bits, so often that 95 % of the
  pairs at the limit meet; a bucket that is crowded even so (copies of one text)
  is cut by a salt, and ``LEADERS`` of its fingerprints go to every part, which
  ties the parts together.  This finds most groups at little cost and loses
  some links: those that a refused shorter one stood for, and those of parts
  that do not meet.  The rest (:func:`remaining_links`) is exact: in every
  bucket that still holds texts of several groups, all pairs of different
  groups are compared by their sets, whatever their bits, so that no link of
  two texts that share a bucket is lost.

Defined cases: null text has no words; fewer words than a shingle are one
shingle; no words give fingerprint 0, linked like any other; repeated rows are
separate documents of one component; a component's id is its smallest doc_id
that is not null (null if it has none); an empty table gives no rows; other
columns are ignored by the digest and carried by the filter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import acos, ceil, comb, log, log2, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ._shared import checkpoint, free_name, join_hot
from .components import components

SEED = 42
PIVOTS = 16
SPLIT = 2048
#: Crowded buckets (20 bytes each) up to which their list is sent to every task.
FEW_CROWDED = 100_000
BLOCK = 64
SMALL = 24
#: near_copies: words of 64 bits; least similarity; buckets a text, and least hashes that make one's key.
WIDE, SIMILARITY, BANDS, ROWS = 8, 0.8, 10, 4
#: Sets of similarity 0.8 differ in 15 % of the bits, give or take 1.6 % (19 % for sets of a handful): pairs beyond
#: FAR are none, links within SURE need no comparison of the sets.
FAR, SURE = 0.22, 0.08
#: Share of the pairs at the limit that meet again where a crowded bucket is dealt by sampled bits; what ties parts of a bucket.
RECALL, LEADERS = 0.95, 64
#: Shingles a part of a bucket holds, about, where sets are compared (two parts meet in a task).
PART_SHINGLES = 1_000_000
_LANES = np.uint64(0x0101010101010101)


def _mix(h: np.ndarray, word: int) -> np.ndarray:
    """Another 64 bits from a hash (a multiply-xorshift finalizer)."""
    if not word:
        return h
    with np.errstate(over="ignore"):
        z = h + np.uint64(0x9E3779B97F4A7C15 * word & (1 << 64) - 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def reference_fingerprints(n: int = PIVOTS, wide: int = 1) -> np.ndarray:
    """The pivots, (n, wide): hashes of their own numbers."""
    first = np.array([xxhash.xxh64_intdigest(str(i).encode(), 7) for i in range(n)], dtype=np.uint64)
    return np.stack([_mix(first, w) for w in range(wide)], axis=1)


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of every shingle, in text order."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist())], dtype=np.uint64)


def majority_bits(hashes: np.ndarray, wide: int = 1) -> np.ndarray:
    """``wide`` unsigned words: a bit is set where over half of the hashes, mixed for that word, have it set."""
    counts = np.zeros((wide, 8, 8), dtype=np.int64)  # word, byte, bit
    for at in range(0, len(hashes), 255 * 16):
        some = hashes[at : at + 255 * 16]
        data = np.zeros((wide, -(-len(some) // 255) * 255), dtype=np.uint64)
        for w in range(wide):
            data[w, : len(some)] = _mix(some, w)
        for bit in range(8):  # eight counters of a byte each, up to 255
            lanes = (data >> np.uint64(bit)) & _LANES
            counts[:, :, bit] += lanes.reshape(wide, -1, 255).sum(axis=2).view(np.uint8).reshape(wide, -1, 8).sum(axis=1, dtype=np.int64)
    return np.packbits((2 * counts > len(hashes)).reshape(wide, 64), axis=1, bitorder="little").view(np.uint64)[:, 0]


def fingerprint(text: str | None, shingle: int = 3, wide: int = 1) -> list[int]:
    """``wide`` unsigned 64-bit words."""
    return majority_bits(shingle_hashes(text, shingle), wide).tolist()


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, shingle))


#: Odd factors, one per least hash; the hashes that they scatter are random already.
_FACTORS = np.array([xxhash.xxh64_intdigest(str(i).encode(), 9) | 1 for i in range(BANDS * ROWS)], dtype=np.uint64)


def band_keys(hashes: np.ndarray) -> list[int]:
    """A key per band, from ROWS least hashes over the set."""
    if not len(hashes):
        return [0] * BANDS
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 2048):
            mixed = hashes[at : at + 2048][None, :] * _FACTORS[:, None]
            mixed ^= mixed >> np.uint64(32)
            mixed *= np.uint64(0x9E3779B97F4A7C15)
            np.minimum(least, mixed.min(axis=1), out=least)
    return [xxhash.xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i) for i in range(BANDS)]


def fp_columns(wide: int) -> list[str]:
    return [f"f{w}" for w in range(wide)]


def with_fingerprints(documents: DataFrame, shingle: int = 3, wide: int = 1) -> DataFrame:
    """``documents`` (whose other columns are not named f0, f1 ...) with signed fingerprint words instead of the text."""
    kept, cols = [c for c in documents.columns if c != "text"], fp_columns(wide)
    schema = documents.select(*kept, *(F.lit(0).cast("long").alias(c) for c in cols)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle, wide) for t in batch.column("text")], dtype=np.uint64).reshape(-1, wide)
            words = np.ascontiguousarray(found.T).view(np.int64)
            yield pa.record_batch([*(batch.column(c) for c in kept), *(pa.array(w) for w in words)], [*kept, *cols])

    return documents.mapInArrow(run, schema)


def pieces(radius: int) -> tuple[int, int]:
    """Number of pieces of the 64 bits, and how many of them two linked fingerprints surely share.

    The shared pieces make keys of 32 bits, or 21 where that would take over 100 keys.
    """
    for shared, blocks in ((radius, 2 * radius), (3, radius + 3)):
        if radius and shared and blocks - radius == shared and comb(blocks, shared) <= 100 and blocks >= 4:
            return blocks, shared
    return radius + 2, 2


def _signed(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask).cast("long")


def piece_keys(radius: int) -> Column:
    """Array of bucket keys, (choice, bits), of the fingerprint f0: every link shares one."""
    blocks, shared = pieces(radius)
    cuts = [round(i * 64 / blocks) for i in range(blocks + 1)]
    masks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(cuts, cuts[1:])]
    chosen = [sum(masks[c] for c in some) for some in combinations(range(blocks), shared)]
    return F.array(*(F.struct(F.lit(i).alias("choice"), F.col("f0").bitwiseAND(_signed(mask)).alias("bits")) for i, mask in enumerate(chosen)))


def far_share(similarity: float = SIMILARITY) -> float:
    """Expected share of differing bits of two sets of equal size and this similarity."""
    return acos(2 * similarity / (1 + similarity)) / pi


def sample_keys(n: int, wide: int, recall: float = RECALL) -> Column:
    """Array of bucket keys by sampled bits, for buckets of ``n`` fingerprints at most.

    As many bits as leave about eight unrelated fingerprints to a bucket, and
    as many samples as let the share ``recall`` of the pairs at the limit meet.
    """
    bits = min(40, max(16, ceil(log2(max(n, 2))) - 3))
    samples = ceil(log(1 - recall) / log(1 - (1 - far_share()) ** bits))
    draw = np.random.default_rng(SEED)
    keys = []
    for i in range(samples):
        at = draw.choice(64 * wide, bits, replace=False)
        masks = [sum(1 << int(b % 64) for b in at if b // 64 == w) for w in range(wide)]
        cut = [F.col(f"f{w}").bitwiseAND(_signed(m)) for w, m in enumerate(masks) if m]
        keys.append(F.struct(F.lit(i).alias("choice"), F.xxhash64(*cut).alias("bits")))
    return F.array(*keys)


def _cells(radius: int) -> Column:
    """Cells of the distances to the first two pivots that a fingerprint can share with a linked one.

    A cell covers ``2 * radius + 1`` distances; two distances at most ``radius``
    apart share a cell of either the plain or the shifted grid.
    """
    width = 2 * radius + 1
    first, second = (_signed(int(p)) for p in reference_fingerprints(2)[:, 0])
    out = []
    for i, shift in enumerate((0, radius)):
        for j, other in enumerate((0, radius)):
            d1 = F.bit_count(F.col("f0").bitwiseXOR(first)) + shift
            d2 = F.bit_count(F.col("f0").bitwiseXOR(second)) + other
            out.append(F.lit(1 + i * 2 + j) * 10_000 + F.floor(d1 / width) * 100 + F.floor(d2 / width))
    return F.array(*(c.cast("long") for c in out))


def _within(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int16) <= radius


def _link_group(fps: np.ndarray, radius: int, tables: np.ndarray) -> list[tuple[int, int]]:
    """Links (indices) that join exactly the fingerprints of a bucket that pairs within the radius join.

    Groups grow by rounds: those last found are held, in blocks, against those
    not yet found, so a group of copies costs little more than one round.
    """
    rest = np.argsort(tables[:, 0], kind="stable")
    found = []
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            reached = [rest[:0]]
            for at in range(0, len(front), BLOCK):
                block = front[at : at + BLOCK]
                # the distances to the first pivot are sorted: only a stretch of them can be near
                lo = np.searchsorted(tables[rest, 0], tables[block, 0].min() - radius)
                hi = np.searchsorted(tables[rest, 0], tables[block, 0].max() + radius, side="right")
                got = [rest[:0]]
                for start in range(lo, hi, 64 * BLOCK):
                    some = rest[start : min(hi, start + 64 * BLOCK)]
                    far = np.zeros((len(block), len(some)), dtype=bool)
                    for p in range(tables.shape[1]):
                        far |= np.abs(tables[block, p][:, None] - tables[some, p][None, :]) > radius
                    i, j = np.nonzero(~far)
                    near = _within(fps[block[i]], fps[some[j]], radius)
                    j, once = np.unique(j[near], return_index=True)
                    found += zip(block[i[near][once]].tolist(), some[j].tolist())
                    got.append(some[j])
                reached += got
                rest = rest[~np.isin(rest, np.concatenate(got))]
                if not len(rest):
                    break
            front = np.concatenate(reached)
    return found


def _link_small(fps: np.ndarray, group: np.ndarray, radius: int, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of many small buckets at once: each fingerprint to the first of its linked ones."""
    left, right = [], []
    for offset in range(1, SMALL):
        i = np.flatnonzero(group[:-offset] == group[offset:]) if offset < len(group) else group[:0]
        if not len(i):
            break
        i = i[(np.abs(tables[i] - tables[i + offset]) <= radius).all(axis=1)]
        i = i[_within(fps[i], fps[i + offset], radius)]
        left.append(i)
        right.append(i + offset)
    if not left:
        return group[:0], group[:0]
    label = _merged_labels(len(fps), np.concatenate(left), np.concatenate(right))
    tied = np.flatnonzero(label != np.arange(len(fps)))
    return label[tied], tied


def _merged_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each of n places reaches by the links."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == before).all():
            return label


def spanning(n: int, a: np.ndarray, b: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """Indices of the shortest links that join all that the links join (every group takes its shortest link out, until none is left)."""
    label, live, none = np.arange(n), np.arange(len(a)), np.iinfo(np.int64).max
    chosen = [live[:0]]
    while True:
        x, y = label[a[live]], label[b[live]]
        live, x, y = live[x != y], x[x != y], y[x != y]
        if not len(live):
            return np.concatenate(chosen)
        key, best = gap[live].astype(np.int64) << 40 | live, np.full(n, none)
        np.minimum.at(best, x, key)
        np.minimum.at(best, y, key)
        picked = np.unique(best[best < none] & ((1 << 40) - 1))
        chosen.append(picked)
        label = _merged_labels(n, label[a[picked]], label[b[picked]])[label]


def _distances(fps: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps ^ pivot).sum(axis=-1, dtype=np.int16)


def _near_pairs(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of a bucket within the radius, and their distances; its references are members far apart."""
    tables = [_distances(fps, fps[0])]
    gap = tables[0].copy()
    while len(tables) < PIVOTS and gap.max() > radius:
        tables.append(_distances(fps, fps[int(np.argmax(gap))]))
        gap = np.minimum(gap, tables[-1])
    table = np.stack(tables, axis=1)
    out = []
    for at in range(0, len(fps), BLOCK):
        block = slice(at, at + BLOCK)
        far = np.arange(len(fps))[None, :] <= np.arange(at, min(len(fps), at + BLOCK))[:, None]
        for p in range(table.shape[1]):
            far |= np.abs(table[block, p][:, None] - table[None, :, p]) > radius
        i, j = np.nonzero(~far)
        for part in range(0, len(i), 1 << 17):
            x, y = i[part : part + (1 << 17)] + at, j[part : part + (1 << 17)]
            d = _distances(fps[x], fps[y])
            near = d <= radius
            out.append((x[near], y[near], d[near]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _near_small(fps: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of many small buckets at once; a bucket's references are its first and its last member."""
    first = np.searchsorted(group, group)
    last = np.searchsorted(group, group, side="right") - 1
    tables = np.stack([_distances(fps, fps[first]), _distances(fps, fps[last])], axis=1)
    out = [(group[:0], group[:0], np.empty(0, dtype=np.int16))]
    for offset in range(1, SMALL):
        i = np.flatnonzero(group[:-offset] == group[offset:]) if offset < len(group) else group[:0]
        if not len(i):
            break
        i = i[(np.abs(tables[i] - tables[i + offset]) <= radius).all(axis=1)]
        d = _distances(fps[i], fps[i + offset])
        out.append((i[d <= radius], i[d <= radius] + offset, d[d <= radius]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _span_buckets(group: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each bucket the shortest links that join what its pairs within the radius join."""
    sizes = np.bincount(group)[group] if len(group) else group
    small = np.flatnonzero((sizes > 1) & (sizes <= SMALL))
    i, j, d = _near_small(fps[small], group[small], radius)
    parts = [(small[i], small[j], d)]
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else group
    for at in starts[sizes[starts] > SMALL].tolist():
        i, j, d = _near_pairs(fps[at : at + sizes[at]], radius)
        kept = spanning(int(sizes[at]), i, j, d)
        parts.append((i[kept] + at, j[kept] + at, d[kept]))
    a, b, gap = (np.concatenate(c) for c in zip(*parts))
    kept = spanning(len(group), a, b, gap)
    return a[kept], b[kept], gap[kept]


def _link_exactly(group: np.ndarray, fps: np.ndarray, radius: int, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join exactly what the pairs of each bucket within the radius join."""
    sizes = np.bincount(group)[group] if len(group) else group
    where = np.flatnonzero(sizes > 1)
    group, fps, sizes = group[where], fps[where], sizes[where]
    tables = np.stack([_distances(fps, pivot) for pivot in pivots], axis=1)
    small = np.flatnonzero(sizes <= SMALL)
    i, j = _link_small(fps[small], group[small], radius, tables[small])
    a, b = [small[i]], [small[j]]
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else group
    for at in starts[sizes[starts] > SMALL].tolist():
        pairs = _link_group(fps[at : at + sizes[at]], radius, tables[at : at + sizes[at]])
        if pairs:
            ix = np.array(pairs) + at
            a.append(ix[:, 0])
            b.append(ix[:, 1])
    return where[np.concatenate(a)], where[np.concatenate(b)]


def _link_batches(radius: int, wide: int, exact: bool):
    """Rows sorted by bucket to links between nodes; a bucket may go on over several batches."""

    def links_of(group: np.ndarray, nodes: np.ndarray, fps: np.ndarray, pivots: np.ndarray) -> pa.RecordBatch:
        """All whole buckets of one stretch; group numbers ascend."""
        if exact:
            a, b = _link_exactly(group, fps, radius, pivots)
            gap = np.zeros(len(a), dtype=np.int32)
        else:
            a, b, gap = _span_buckets(group, fps, radius)
        return pa.record_batch([pa.array(nodes[a]), pa.array(nodes[b]), pa.array(gap.astype(np.int32))], ["a", "b", "gap"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = reference_fingerprints(PIVOTS, wide)
        column = lambda batch, c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = (
                np.stack([column(batch, c) for c in ("choice", "bits", "cell")], axis=1), column(batch, "node"),
                np.stack([column(batch, c) for c in fp_columns(wide)], axis=1).view(np.uint64),
            )
            keys, nodes, fps = now if held is None else (np.concatenate(x) for x in zip(held, now))
            changed = np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]
            last = int(np.flatnonzero(changed)[-1])
            held = keys[last:], nodes[last:], fps[last:]
            yield links_of(np.cumsum(changed)[:last], nodes[:last], fps[:last], pivots)
        if held is not None:
            yield links_of(np.ones(len(held[1]), dtype=np.int64), *held[1:], pivots)

    return run


def _with_sizes(dealt: DataFrame) -> tuple[DataFrame, int]:
    """The rows with ``n``, the size of their bucket where it is crowded (else null), and the size of the largest."""
    crowded = checkpoint(dealt.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SPLIT))
    held = crowded.agg(F.count(F.lit(1)), F.max("n")).first()
    if not held[0]:
        return dealt.withColumn("n", F.lit(None).cast("long")), 0
    if held[0] <= FEW_CROWDED:  # beyond the checked size the join shuffles both sides
        crowded = F.broadcast(crowded)
    return dealt.join(crowded, ["choice", "bits"], "left"), held[1]


def _meet(placed: DataFrame, radius: int, wide: int, exact: bool) -> DataFrame:
    ordered = placed.repartition("choice", "bits", "cell").sortWithinPartitions("choice", "bits", "cell", "node")
    return ordered.mapInArrow(_link_batches(radius, wide, exact), "a long, b long, gap int")


def links(prints: DataFrame, radius: int) -> DataFrame:
    """Distinct fingerprints (node, f0) to links (a, b) that join exactly what pairs within the radius join."""
    dealt = prints.select("node", "f0", F.explode(piece_keys(radius)).alias("k")).select("node", "f0", "k.choice", "k.bits")
    sized, _ = _with_sizes(dealt)
    cells = F.when(F.col("n").isNull(), F.array(F.lit(0).cast("long"))).otherwise(_cells(radius))
    placed = sized.select("node", "f0", "choice", "bits", F.explode(cells).alias("cell"))
    return _meet(placed, radius, 1, True).select("a", "b").distinct()


def _dealt_by_bands(prints: DataFrame, kept: list[str]) -> DataFrame:
    """The columns ``kept`` of each text once per band, with its bucket (choice, bits)."""
    keys = F.array(*(F.struct(F.lit(i).alias("choice"), F.col(f"k{i}").alias("bits")) for i in range(BANDS)))
    return prints.select(*kept, F.explode(keys).alias("k")).select(*kept, "k.choice", "k.bits")


def similar_links(prints: DataFrame, wide: int = WIDE, far: float = FAR) -> DataFrame:
    """Distinct texts (node, f0 ..., k0 ...) to links (a, b, gap): the shortest that span each bucket, or each part of a crowded one.

    What these do not join is left to :func:`remaining_links`.
    """
    cols, radius = fp_columns(wide), int(far * 64 * wide)
    dealt = _dealt_by_bands(prints, ["node", *cols])
    sized, most = _with_sizes(dealt)
    here = ["node", *cols, "choice", "bits"]
    placed = sized.where(F.col("n").isNull()).select(*here, F.lit(0).cast("long").alias("cell"))
    if most:
        again = sized.where(F.col("n").isNotNull()).select(*here, F.explode(sample_keys(most, wide)).alias("s"))
        again = again.select("node", *cols, (F.col("choice") * 1000 + F.col("s.choice") + BANDS).alias("choice"), F.xxhash64("bits", "s.bits").alias("bits"))
        sized, _ = _with_sizes(again)
        parts, luck = F.ceil(F.col("n") / SPLIT), F.xxhash64("node", "choice")
        leads = F.pmod(F.xxhash64("node", "bits"), F.ceil(F.col("n") / LEADERS)) == 0
        cells = F.when(F.col("n").isNull(), F.array(F.lit(0).cast("long"))).when(leads, F.sequence(F.lit(1).cast("long"), parts)).otherwise(F.array(F.pmod(luck, parts) + 1))
        placed = placed.unionByName(sized.select(*here, F.explode(cells).alias("cell")))
    return _meet(placed, radius, wide, False).groupBy("a", "b").agg(F.min("gap").alias("gap"))


def classes(documents: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, f0, component_id for every row of documents; links are exact."""
    printed = checkpoint(with_fingerprints(documents.select("doc_id", "text"), shingle))
    firsts = printed.groupBy("f0").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    labels = components(links(firsts.select(F.col("f0").alias("node"), "f0"), radius))
    named = checkpoint(firsts.join(labels.withColumnRenamed("node", "f0"), "f0", "left").select("f0", "first", "n", F.coalesce("label", "f0").alias("label")))
    smallest = named.groupBy("label").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("held"))
    by_fp = join_hot(named, smallest, ["label"], "held", named.count(), ["f0"]).select("f0", "n", "component_id")
    return join_hot(printed, by_fp, ["f0"], "n", printed.count(), ["doc_id"]).select("doc_id", "f0", "component_id")


def digest(documents: DataFrame) -> DataFrame:
    """The columns of the query."""
    return classes(documents).select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def _set_batches(shingle: int, wide: int):
    """Texts to fingerprints, band keys and sizes of their shingle sets."""
    names = [*fp_columns(wide), *(f"k{i}" for i in range(BANDS)), "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.empty((batch.num_rows, len(names)), dtype=np.uint64)
            for i, text in enumerate(batch.column("text")):
                hashes = shingle_set(text.as_py(), shingle)
                found[i, :wide], found[i, wide:-1], found[i, -1] = majority_bits(hashes, wide), band_keys(hashes), len(hashes)
            words = np.ascontiguousarray(found.T).view(np.int64)
            yield pa.record_batch([batch.column("d"), batch.column("t"), *(pa.array(w) for w in words)], ["d", "t", *names])

    return run, "d long, t long, " + ", ".join(f"{n} long" for n in names)


def _pack_sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), shingle).tobytes() for t in batch.column("text")]
            yield pa.record_batch([batch.column("node"), batch.column("n"), pa.array(sets, pa.binary())], ["node", "n", "shingles"])

    return run


def _compare_sets(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stands = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x, y = (np.frombuffer(v.as_py(), dtype=np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                stands.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(stands, pa.bool_()))

    return run


def _row_key() -> tuple[Column, Column]:
    """A row by its id and its text: ids may be null or repeated."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 62))), F.xxhash64("text")


def _sets(texts: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """node, n, shingles of every node of ``wanted``, which holds it ``n`` times."""
    times = wanted.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    one = texts.join(times, "node").groupBy("node").agg(F.first("text").alias("text"), F.first("n").alias("n"))
    return checkpoint(one.mapInArrow(_pack_sets(shingle), "node long, n long, shingles binary"))


def similar_enough(found: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Of the links (a, b) those whose shingle sets are similar enough, by comparing the sets.

    ``texts`` has the node and text of a row of each end.
    """
    total = found.count()
    sets = _sets(texts, found.select(F.explode(F.array("a", "b")).alias("node")), shingle)
    side = lambda end, name: sets.select(F.col("node").alias(end), "n", F.col("shingles").alias(name))
    left = join_hot(found.select("a", "b"), side("a", "sa"), ["a"], "n", total, ["b"]).drop("n")
    both = join_hot(left, side("b", "sb"), ["b"], "n", total, ["a"]).drop("n")
    return both.select("a", "b", "sa", "sb").mapInArrow(_compare_sets(similarity), "a long, b long")


def _link_sets(label: np.ndarray, lead: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links (indices) that join all groups which similar enough pairs of a leading and any other text join."""
    order = np.argsort(~lead, kind="stable")
    label, size = label[order], np.array([len(sets[i]) for i in order])
    _, code, held = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)
    shared = held[code] > 1  # a shingle of one text alone is in no intersection
    ends = np.r_[0, np.cumsum(shared)][np.r_[0, np.cumsum(size)]]
    code, mark = code[shared], np.zeros(len(held), dtype=bool)
    found = []
    for i in range(int(lead.sum())):
        apart = label[i + 1 :] != label[i]
        if not apart.any():
            continue
        mine = code[ends[i] : ends[i + 1]]
        mark[mine] = True
        upto = np.r_[0, np.cumsum(mark[code[ends[i + 1] :]])]
        mark[mine] = False
        both = np.diff(upto[ends[i + 1 :] - ends[i + 1]])
        near = apart & (both >= similarity * (size[i] + size[i + 1 :] - both) - 1e-9)
        for j in (np.flatnonzero(near) + i + 1).tolist():
            if label[j] != label[i]:
                found.append((order[i], order[j]))
                label[label == label[j]] = label[i]
    return found


def _link_cells(similarity: float):
    """Rows sorted by cell to links between nodes; a cell may go on over several batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links_of(nodes: list, labels: list, leads: list, sets: list) -> pa.RecordBatch:
            pairs = _link_sets(np.array(labels, dtype=np.int64), np.array(leads, dtype=bool), sets, similarity)
            return pa.record_batch([pa.array([nodes[i] for i, _ in pairs], pa.int64()), pa.array([nodes[j] for _, j in pairs], pa.int64())], ["a", "b"])

        now, held = None, ([], [], [], [])
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("choice", "bits", "cell")))
            rows = zip(*(batch.column(c).to_pylist() for c in ("node", "label", "lead")), batch.column("shingles"))
            for key, (node, label, lead, packed) in zip(keys, rows):
                if key != now and now is not None:
                    yield links_of(*held)
                    held = ([], [], [], [])
                now = key
                for column, value in zip(held, (node, label, lead, np.frombuffer(packed.as_py(), dtype=np.uint64))):
                    column.append(value)
        if now is not None:
            yield links_of(*held)

    return run


def _few(df: DataFrame) -> DataFrame:
    """A table of buckets, sent to every task if its checked size allows it."""
    return F.broadcast(df) if df.count() <= FEW_CROWDED else df


def _cells_of_groups(named: DataFrame) -> DataFrame:
    """Texts (node, label, size, k0 ...) to cells (node, label, choice, bits, cell, lead): any two of a bucket whose labels differ share a cell that one of them leads.

    The texts of the bucket's largest group need not meet each other.  They are
    cut to parts, the others too, and each part of the others leads a cell
    with every later part and every part of the largest group.
    """
    dealt, bucket = _dealt_by_bands(named, ["node", "label", "size"]), ["choice", "bits"]
    mixed = checkpoint(dealt.groupBy(*bucket).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select(*bucket))
    rows = checkpoint(dealt.join(_few(mixed), bucket))
    groups = rows.groupBy(*bucket, "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
    buckets = groups.groupBy(*bucket).agg(F.max(F.struct("n", "s", "label")).alias("main"), F.sum("n").alias("n"), F.sum("s").alias("s"))
    parts = lambda n, s: F.ceil(F.greatest(2 * n / SPLIT, s / PART_SHINGLES, F.lit(1.0)))
    cut = buckets.select(
        *bucket, F.col("main.label").alias("main"),
        parts(F.col("n") - F.col("main.n"), F.col("s") - F.col("main.s")).alias("others"), parts(F.col("main.n"), F.col("main.s")).alias("mains"),
    )
    luck, others, every = F.xxhash64("node", "choice"), F.col("others"), F.col("others") + F.col("mains")
    part = F.when(F.col("label") == F.col("main"), others + F.pmod(luck, F.col("mains"))).otherwise(F.pmod(luck, others))
    placed = rows.join(_few(checkpoint(cut)), bucket).withColumn("part", part)
    meets = F.sequence(F.lit(0).cast("long"), F.when(F.col("part") >= others, others).otherwise(every) - 1)
    placed = placed.select("node", "label", *bucket, "part", every.alias("every"), F.explode(meets).alias("other")).where("part <> other")
    cell = F.least("part", "other") * F.col("every") + F.greatest("part", "other")
    return placed.select("node", "label", *bucket, cell.alias("cell"), (F.col("part") < F.col("other")).alias("lead"))


def remaining_links(named: DataFrame, texts_of, shingle: int, similarity: float) -> DataFrame:
    """Texts (node, label, size, k0 ...) to links (a, b) that join all groups which similar enough texts of one bucket join.

    Exact for any bucket, crowded or not: sets are compared, not fingerprints.
    ``texts_of`` gives the node and text of a row of each of some nodes.
    """
    placed = checkpoint(_cells_of_groups(named))
    sets = _sets(texts_of(placed.select("node").distinct()), placed.select("node"), shingle)
    full = join_hot(placed, sets, ["node"], "n", placed.count(), ["choice", "cell"]).drop("n")
    ordered = full.repartition("choice", "bits", "cell").sortWithinPartitions("choice", "bits", "cell")
    return ordered.mapInArrow(_link_cells(similarity), "a long, b long").distinct()


def near_copies(documents: DataFrame, shingle: int = 5, wide: int = WIDE, similarity: float = SIMILARITY) -> DataFrame:
    """d, t, node, label for every row: ``d`` and ``t`` tell rows by id and text, ``label`` tells groups of near copies."""
    d, t = _row_key()
    keyed = documents.select(d.alias("d"), t.alias("t"), "text")
    run, schema = _set_batches(shingle, wide)
    cols = [c.split()[0] for c in schema.split(", ")[2:]]
    printed = checkpoint(keyed.mapInArrow(run, schema).withColumn("node", F.xxhash64(*cols)))
    # equal fingerprints and band keys fold to one node, which one of its rows stands for
    prints = checkpoint(printed.groupBy("node").agg(*(F.first(c).alias(c) for c in cols), F.min("d").alias("d"), F.min_by("t", "d").alias("t"), F.count(F.lit(1)).alias("n")))
    found = checkpoint(similar_links(prints.select("node", *cols), wide))
    sure = F.col("gap") <= int(SURE * 64 * wide)
    doubtful = found.where(~sure)
    texts_of = lambda nodes: keyed.join(prints.select("node", "d", "t").join(nodes, "node", "left_semi"), ["d", "t"]).select("node", "text")
    ends = doubtful.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    stand = checkpoint(found.where(sure).select("a", "b").unionByName(similar_enough(doubtful, texts_of(ends), shingle, similarity)))
    labels = components(stand)
    named = prints.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    rest = checkpoint(remaining_links(named, texts_of, shingle, similarity))
    if not rest.isEmpty():
        labels = components(stand.unionByName(rest))
    rows, sized = printed.select("d", "t", "node"), labels.join(prints.select("node", "n"), "node")
    return join_hot(rows, sized, ["node"], "n", printed.count(), ["d", "t"], "left").select("d", "t", "node", F.coalesce("label", "node").alias("label"))


def keep_one_of_each(documents: DataFrame, shingle: int = 5) -> DataFrame:
    """The documents without near copies: of each group the row of smallest doc_id stays, once."""
    grouped = checkpoint(near_copies(documents, shingle))
    first = grouped.groupBy("label").agg(F.min(F.struct("d", "t")).alias("first")).select(F.col("first.d").alias("d"), F.col("first.t").alias("t"))
    rows = grouped.groupBy("d", "t").agg(F.count(F.lit(1)).alias("n"))
    staying = first.join(rows, ["d", "t"])
    d, t, n = (free_name(documents, x) for x in ("row_d", "row_t", "row_n"))
    keyed = documents.withColumns(dict(zip((d, t), _row_key())))
    kept = keyed.join(staying.select(F.col("d").alias(d), F.col("t").alias(t), F.col("n").alias(n)), [d, t])
    # rows that are repeated as they stand are rare; only they are dealt out to be told apart
    once = kept.where(F.col(n) == 1).unionByName(kept.where(F.col(n) > 1).dropDuplicates([d, t]))
    return once.select(*(F.col(f"`{c}`") for c in documents.columns))
