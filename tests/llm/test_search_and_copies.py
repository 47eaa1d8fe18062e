"""Top-k, SimHash, substring dedup and components against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from canopyframe.llm import components, simhash, substring_dedup, topk
from canopyframe.llm._shared import ESTIMATE_BITS, checkpoint

DOCS = "doc_id long, text string, f0 string, node long, h string"
VECS = "vec_id long, embedding array<float>, score string, rank int"


# --- top-k -------------------------------------------------------------------


def brute_topk(rows, k=topk.TOP, every=topk.EVERY):
    ok = [(i, np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(int)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, a in ok:
        if q % every == 0:
            best = sorted((-int(a @ b), i) for i, b in ok if i != q and len(a) == len(b))[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


def search(spark, rows):
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], VECS)
    return {tuple(r) for r in topk.search(df).collect()}


def test_topk_of_huge_components(spark):
    """Components and scores beyond the range of a long are held at its ends; the smaller vec_id goes first."""
    rows = [(0, [1e30, 0.0]), (1, [2e30, 1.0]), (2, [-1e30, 0.0]), (3, [0.5, 0.5]), (4, [1e17, 3.0])]
    kept = [np.clip(np.floor(256 * np.array(v, dtype=np.float32).astype(float)), -(2.0**63 - 1024), 2.0**63 - 1024).astype(int).tolist() for _, v in rows]
    score = lambda a, b: max(-(2**63) + 1, min(2**63 - 1, sum(x * y for x, y in zip(a, b))))
    want = sorted(((-score(kept[0], kept[i]), i) for i in range(1, 5)))
    assert search(spark, rows) == {(0, n + 1, i, -s) for n, (s, i) in enumerate(want)}


def test_topk_in_groups_with_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(topk, "GROUP_VALUES", 16)
    draw = np.random.default_rng(8)
    rows = [(i, draw.normal(0, 0.3, 4).round(3).tolist()) for i in range(420)]
    df = spark.createDataFrame([(i, v, "x", 7, 1, 2) for i, v in rows], VECS + ", query_id int, shared int")
    assert {tuple(r) for r in topk.search(df).collect()} == brute_topk(rows)


def test_topk_matches_brute_force(spark):
    draw = np.random.default_rng(1)
    rows = [(i, draw.normal(0, 0.3, 8).round(3).tolist()) for i in range(320)]
    rows += [(1000 + i, rows[50][1]) for i in range(40)]  # ties
    rows += [(2000, None), (2050, []), (2100, [1.0, None]), (2150, [float("nan")] * 8), (2200, [float("inf")] + [0.0] * 7), (2250, [0.5] * 3), (2251, [0.25] * 3), (None, [0.1] * 8)]
    assert search(spark, rows) == brute_topk(rows)


def test_topk_few_and_none(spark):
    assert search(spark, []) == set()
    assert search(spark, [(50, [1.0])]) == set()
    assert search(spark, [(50, [1.0]), (51, [-1.0])]) == {(50, 1, 51, -65536)}
    assert search(spark, [(1, [1.0]), (2, [1.0])]) == set()


def test_topk_repeated_rows(spark):
    rows = [(100, [1.0, 0.0])] * 2 + [(7, [1.0, 0.5])] * 3
    assert search(spark, rows) == {(100, r, 7, 65536) for r in (1, 2, 3)}


def test_topk_eliminates_candidates():
    draw = np.random.default_rng(2)
    centers = draw.normal(0, 40, (30, 6))
    rows = topk.integers((centers[draw.integers(0, 30, 3000)] + draw.normal(0, 0.2, (3000, 6))) / 256)
    s = topk.Search(np.arange(0, 3000, 50), rows[::50])
    s.feed(np.arange(3000), rows)
    exact = rows[::50] @ rows.T
    for q, best in enumerate(s.best):
        scores = exact[q].copy()
        scores[q * 50] = -(1 << 60)
        assert [-b[0] for b in best] == sorted(scores.tolist(), reverse=True)[:5]
    assert s.evaluated < 0.8 * 60 * 3000


# --- SimHash -----------------------------------------------------------------


def plain_fingerprint(text, shingle=3):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")).replace("\n", " ").replace("\t", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "Two Words", "ÉA b C d", "a a a a a a", "x " * 2000, "the quick brown fox jumps over the lazy dog " * 3])
def test_fingerprint(text):
    assert simhash.fingerprint(text)[0] == plain_fingerprint(text)


def test_digest_matches_brute_force(spark):
    r = random.Random(4)
    base = [" ".join(r.choice("abcdefghij") * r.randint(1, 3) for _ in range(400)) for _ in range(6)]
    texts = [None, "", "   ", "x", "x"]
    for b in base:
        for _ in range(12):
            words = b.split()
            for _ in range(r.randint(0, 3)):
                words[r.randrange(len(words))] = r.choice("xyz")
            texts.append(" ".join(words))
    df = spark.createDataFrame([(900 - i, t, "clash", 0, "") for i, t in enumerate(texts)], DOCS)
    got = {x.doc_id: x for x in simhash.digest(df).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    label = brute_components(fps, 2)
    for i in range(len(texts)):
        same = [900 - j for j in range(len(texts)) if label[j] == label[i]]
        assert got[900 - i].fingerprint == f"{fps[i]:016x}" and got[900 - i].component_id == min(same)


@pytest.mark.parametrize("radius", [1, 2, 3, 6])
def test_links_are_lossless(spark, radius, monkeypatch):
    monkeypatch.setattr(simhash, "SPLIT", 40)
    r = random.Random(radius)
    fps = set()
    for _ in range(12):
        center = r.getrandbits(64)
        for _ in range(30):
            v = center
            for _ in range(r.randint(0, radius + 3)):
                v ^= 1 << r.randrange(64)
            fps.add(v)
    half = r.getrandbits(32) << 32  # a bucket of many
    fps |= {half | r.getrandbits(12) for _ in range(200)}
    fps = sorted(fps)
    signed = [v - (1 << 64) if v >> 63 else v for v in fps]
    df = spark.createDataFrame([(v, v) for v in signed], "node long, f0 long")
    found = simhash.links(df, radius).collect()
    labels = {x.node: x.label for x in components.components(spark.createDataFrame(found, "a long, b long")).collect()}
    want = brute_components(fps, radius)
    groups, expected = {}, {}
    for i, v in enumerate(signed):
        groups.setdefault(labels.get(v, v), set()).add(v)
        expected.setdefault(want[i], set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


@pytest.mark.parametrize("shared, extra", [(4, 0.5), (8, 1), (40, 5), (160, 20), (800, 100), (8000, 1000)])
def test_pairs_at_the_limit_are_found(shared, extra):
    """Of pairs of similarity 0.8 nearly all share a band and lie within FAR, whatever else there is; none is taken for sure below it."""
    rng, pairs, met, sure = np.random.default_rng(9), 300 if shared < 1000 else 60, 0, 0
    for _ in range(pairs):
        h = rng.integers(0, 1 << 63, shared + int(2 * extra), dtype=np.uint64) * np.uint64(2)
        x, y = np.sort(h[: shared + int(extra)]), np.sort(np.r_[h[:shared], h[shared + int(extra) :]])
        gap = int(np.bitwise_count(simhash.majority_bits(x, simhash.WIDE) ^ simhash.majority_bits(y, simhash.WIDE)).sum())
        met += gap <= int(simhash.FAR * 64 * simhash.WIDE) and any(p == q for p, q in zip(simhash.band_keys(x), simhash.band_keys(y)))
        sure += gap <= int(simhash.SURE * 64 * simhash.WIDE)
    assert met >= 0.95 * pairs and sure <= 0.02 * pairs


def test_crowded_buckets_meet_again(spark):
    """Of pairs that differ in as many bits as sets at the limit do, the stated share has a sampled-bit bucket in common."""
    rng, wide, pairs = np.random.default_rng(9), simhash.WIDE, 600
    bits = rng.integers(0, 2, (pairs, 64 * wide), dtype=np.uint8)
    other = bits.copy()
    for row in other:
        row[rng.choice(64 * wide, int(simhash.far_share() * 64 * wide), replace=False)] ^= 1
    words = [np.packbits(x, axis=1, bitorder="little").view(np.int64).tolist() for x in (bits, other)]
    rows = [(i, side, *words[side][i]) for i in range(pairs) for side in (0, 1)]
    df = spark.createDataFrame(rows, "pair long, side int, " + ", ".join(f"{c} long" for c in simhash.fp_columns(wide)))
    for n in (8_000, 30_000_000):
        keys = df.select("pair", "side", F.explode(simhash.sample_keys(n, wide)).alias("k"))
        met = keys.groupBy("pair", "k").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("pair").distinct().count()
        assert met >= (simhash.RECALL - 0.03) * pairs


def shingles_of(text, n=5):
    w = (text or "").lower().split()
    return frozenset(" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def groups_of(labels):
    out = {}
    for key, label in labels:
        out.setdefault(label, set()).add(key)
    return out


@pytest.mark.parametrize("split", [simhash.SPLIT, 12])
def test_near_copies_match_brute_force(spark, split, monkeypatch):
    """Groups are those of exact five-word-shingle similarity 0.8, crowded buckets or not: texts of few and many words, and one page behind many."""
    monkeypatch.setattr(simhash, "SPLIT", split)
    r = random.Random(21)
    words = [f"w{i}" for i in range(4000)]
    texts = [None, "", "one two", "one two", "One two", " ".join(["same"] * 300) + " a b c d e f g h i j", " ".join(["same"] * 300) + " k l m n o p q r s t"]
    for g in range(40):
        base = [r.choice(words) for _ in range(r.choice([6, 12, 40, 150, 500]))]
        for _ in range(5):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = r.choice(words)
            texts.append(" ".join(w))
    page = [r.choice(words) for _ in range(200)]
    texts += [" ".join(page + [r.choice(words) for _ in range(r.randint(2, 60))]) for _ in range(80)]
    df = spark.createDataFrame([(i, t, "", 0, "h") for i, t in enumerate(texts)], DOCS)
    got = groups_of((x.d, x.label) for x in simhash.near_copies(df).collect())
    sets, label = [shingles_of(t) for t in texts], list(range(len(texts)))
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] == sets[j] or (sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))]
    for _ in range(60):
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    want = groups_of(enumerate(label))
    apart = {i: k for k, v in got.items() for i in v}
    assert all(any(v <= w for w in want.values()) for v in got.values()), "no group reaches beyond a true one"
    assert sum(apart[i] == apart[j] for i, j in pairs) >= 0.97 * len(pairs)


@pytest.mark.parametrize("split, part", [(simhash.SPLIT, simhash.PART_SHINGLES), (12, 2000)])
def test_no_link_of_a_bucket_is_lost(spark, split, part, monkeypatch):
    """Groups are exactly those that pairs of one bucket join, however crowded, and whether or not a shorter link was refused.

    One page stands behind all texts, and many pairs lie just above or just below the limit.
    """
    monkeypatch.setattr(simhash, "SPLIT", split)
    monkeypatch.setattr(simhash, "PART_SHINGLES", part)
    r = random.Random(5)
    words = [f"w{i}" for i in range(50000)]
    pages = [[r.choice(words) for _ in range(200)] for _ in range(3)]
    texts = [" ".join(p + [r.choice(words) for _ in range(r.randint(21, 31))]) for p in pages for _ in range(70)]
    df = spark.createDataFrame([(i, t, "", 0, "h") for i, t in enumerate(texts)], DOCS)
    got = groups_of((x.d, x.label) for x in simhash.near_copies(df).collect())
    sets, keys, label = [shingles_of(t) for t in texts], [set(enumerate(simhash.band_keys(simhash.shingle_set(t, 5)))) for t in texts], list(range(len(texts)))
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if keys[i] & keys[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for _ in range(60):
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups_of(enumerate(label)).values()))


def test_simhash_rows(spark):
    empty = spark.createDataFrame([], DOCS)
    assert simhash.digest(empty).count() == 0 and simhash.keep_one_of_each(empty).count() == 0
    df = spark.createDataFrame([(None, "a b c d", "", 0, ""), (3, "a b c d", "", 0, ""), (3, "a b c d", "", 0, ""), (None, "other words entirely here", "", 0, "")], DOCS)
    got = sorted(((r.doc_id, r.component_id) for r in simhash.digest(df).collect()), key=str)
    assert got == sorted([(None, 3), (3, 3), (3, 3), (None, None)], key=str)


def test_keep_one_of_each(spark):
    r = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    base = [" ".join(r.choice(words) for _ in range(300)) for _ in range(30)]
    data, group = [], {}
    for g, b in enumerate(base):
        for c in range(1 + g % 4):
            w = b.split()
            for _ in range(c):
                w[r.randrange(len(w))] = "edit"
            data.append((len(data), " ".join(w), f"f{g}", g, "h"))
            group.setdefault(g, []).append(data[-1][0])
    data += [(data[0][0], data[0][1], data[0][2], data[0][3], "h")]  # a repeated row
    df = spark.createDataFrame(data, DOCS)
    kept = simhash.keep_one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(min(v) for v in group.values())


def test_estimates_stay_small(spark):
    """Tables that are joined and checkpointed in a loop: the estimated size does not double its digits each round."""
    df = spark.range(3)
    for _ in range(10):
        df = checkpoint(df.join(df.select("id"), "id"))
    assert df._jdf.queryExecution().analyzed().stats().sizeInBytes().bit_length() <= ESTIMATE_BITS
    assert sorted(r.id for r in df.collect()) == [0, 1, 2]


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 40)]
    star = [(100, i) for i in range(101, 160)]
    ring = [(200 + i, 200 + (i * 7 + 7) % 30) for i in range(30)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(chain + star + ring + [(7, 7)], "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 160))
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- substring dedup ---------------------------------------------------------


def test_shards_merge_by_key():
    """Of equal windows of any shards those stay that start first; equal starts (rows of one id) stay together."""
    r = np.random.default_rng(6)
    for _ in range(200):
        shards, every = [], []
        for _ in range(r.integers(1, 5)):
            n = r.integers(0, 12)
            rows = sorted((bytes(r.integers(0, 3, 1, dtype=np.uint8)) * 15 + bytes(r.integers(0, 4, 1, dtype=np.uint8)), int(r.integers(0, 4)), int(r.integers(0, 3))) for _ in range(n))
            keys = np.frombuffer(b"".join(k for k, _, _ in rows), dtype="S16")
            shards.append((keys, np.array([d for _, d, _ in rows], dtype=np.int64), np.array([o for _, _, o in rows], dtype=np.int64)))
            every.append(rows)
        least = {}
        for rows in every:
            for k, d, o in rows:
                least[k] = min(least.get(k, (d, o)), (d, o))
        got = substring_dedup.merge_shards(shards)
        assert [g.tolist() for g in got] == [[(d, o) != least[k] for k, d, o in rows] for rows in every]


def test_bitmap_is_sized_by_hashes(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "LEAST_BITMAP", 1 << 15)
    h = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 5000)
    found = substring_dedup.hash_bitmap(spark.createDataFrame([(int(x),) for x in h], "h long"))
    assert len(found) * 8 == 1 << 17 and substring_dedup.in_bitmap(h, found).all()
    assert substring_dedup.in_bitmap(np.random.default_rng(2).integers(-(1 << 62), 1 << 62, 5000), found).mean() < 0.1
    assert not substring_dedup.hash_bitmap(spark.createDataFrame([], "h long")).any()


def brute_repeats(docs, width=100):
    first, out = {}, []
    for d, t in sorted(((-(1 << 62) if d is None else d, t or "") for d, t in docs), key=lambda x: x[0]):
        raw = t.encode()
        for s in range(len(raw) - width + 1):
            first[raw[s : s + width]] = min(first.get(raw[s : s + width], (d, s)), (d, s))
    for d, t in docs:
        raw, gone, key = (t or "").encode(), bytearray(len((t or "").encode())), -(1 << 62) if d is None else d
        for s in range(len(raw) - width + 1):
            if first[raw[s : s + width]] < (key, s):
                gone[s : s + width] = b"\1" * width
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        out.append((d, len(raw), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def repeated_texts(seed, n):
    r = random.Random(seed)
    base = ["".join(r.choice("abé ") for _ in range(320)) for _ in range(3)]
    for i in range(n):
        text = ""
        for _ in range(r.randint(0, 4)):
            k, b, a = r.random(), r.choice(base), r.randint(0, 200)
            text += b[a : a + r.randint(50, 260)] if k < 0.6 else "ab" * r.randint(1, 160) if k < 0.7 else "".join(r.choice("abé ") for _ in range(90))
        yield i, text


@pytest.mark.parametrize("shard", [4096, 3])
def test_repeats_match_brute_force(spark, shard, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD", shard)  # 3: nearly every hash is split and merged
    docs = list(repeated_texts(shard, 70))
    docs += [(500, None), (501, ""), (502, "x" * 99), (503, "x" * 100), (504, "x" * 100), (505, "\0" * 260), (506, "\0" * 130), (None, docs[5][1] + "q" * 200), (None, docs[5][1] + "q" * 200), (30, docs[40][1])]
    df = spark.createDataFrame([(d, t, "", 0, "clash") for d, t in docs], DOCS)
    got = sorted((tuple(r) for r in substring_dedup.digest(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)
    assert got == brute_repeats(docs)


def test_long_texts_go_in_stretches(monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK", 700)
    texts = [t.encode() for _, t in repeated_texts(1, 12)] + [b"".join(t.encode() for _, t in repeated_texts(2, 30))]
    small = substring_dedup.anchors(texts)
    monkeypatch.setattr(substring_dedup, "CHUNK", 1 << 20)
    whole = substring_dedup.anchors(texts)
    table = lambda a: sorted(zip(*(a[k].tolist() for k in ("doc", "at", "before", "after", "h", "c"))))
    assert table(small) == table(whole)


def test_every_window_has_one_anchor():
    texts = [t.encode() for _, t in repeated_texts(7, 20)]
    a = substring_dedup.anchors(texts)
    seen = [(d, at - b + i) for d, at, b, f in zip(*(a[k].tolist() for k in ("doc", "at", "before", "after"))) for i in range(b - f + 1)]
    assert sorted(seen) == [(i, s) for i, t in enumerate(texts) for s in range(max(0, len(t) - 99))]


def test_suffix_array_and_prefixes():
    r = random.Random(5)
    texts = ["".join(r.choice("ab") for _ in range(r.randint(1, 60))).encode() for _ in range(20)]
    length = max(map(len, texts)) + 1
    lanes = np.zeros((len(texts), length), dtype=np.int64)
    for i, t in enumerate(texts):
        lanes[i, : len(t)] = np.frombuffer(t, dtype=np.uint8).astype(np.int64) + 1
    order = np.argsort(substring_dedup.suffix_ranks(lanes, length), kind="stable")
    suffixes = [texts[i // length][i % length :] for i in order.tolist()]
    assert suffixes == sorted(suffixes)
    prefixes = substring_dedup.common_prefixes(lanes, order, 1000)
    for a, b, n in zip(suffixes, suffixes[1:], prefixes[1:].tolist()):
        assert n == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


def test_repeats_empty(spark):
    assert substring_dedup.digest(spark.createDataFrame([], DOCS)).count() == 0
