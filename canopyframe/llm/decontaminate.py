"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared as lower-cased words (runs of letters and digits)
joined by single spaces.  An item of ``n`` characters may be matched with
``max(1, n // ERROR_SHARE)`` edits, an item of one character with none.  It is split into one piece more than that;
a passage within the budget holds at least one piece unchanged.  One
Aho-Corasick automaton finds every exact piece hit in one pass over a text;
around each hit the whole item is verified by Myers' bit-parallel distance
(start and end free in the text).  A pair's distance is the smallest over all
its passages.

Only the benchmark, never the corpus, is shipped to the tasks: items are read
in groups of at most ``GROUP_CHARS`` characters, one pass over the texts per
group, so what a task holds is bounded for any benchmark.

Defined cases: null text or item holds nothing; an item without words is
never matched; repeated items are matched each under its id; repeated rows are
matched alike; an empty table gives no rows; other columns are ignored by the
match and carried by the filter.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._shared import free_name, materialize

ERROR_SHARE = 16
GROUP_CHARS = 4_000_000
_WORDS = re.compile(r"[^\W_]+")


def normalize(text: str | None) -> str:
    return " ".join(_WORDS.findall((text or "").lower()))


def budget(item: str) -> int:
    return min(len(item) - 1, max(1, len(item) // ERROR_SHARE))


def split_pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces (offset, text) of nearly equal length that make up the item."""
    n = errors + 1
    cuts = [i * len(item) // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def letter_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    return dict(masks)


def best_distance(masks: dict[str, int], m: int, text: str, most: int) -> int:
    """Smallest edit distance of the pattern to any substring of the text, or most + 1 (Myers)."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, most + 1
    get = masks.get
    for c in text:
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best = score
                if not best:
                    return 0
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
    return best


@dataclass
class Items:
    """A group of normalized items with their pieces in one automaton."""

    ids: list[int]
    texts: list[str]

    def __post_init__(self) -> None:
        self.errors = [budget(t) for t in self.texts]
        self.masks = [letter_masks(t) for t in self.texts]
        found: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, t in enumerate(self.texts):
            for offset, piece in split_pieces(t, self.errors[i]):
                if piece:
                    found[piece].append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if found:
            self.automaton.make_automaton()

    def match(self, text: str | None) -> dict[int, int]:
        """Index of each item found in the text, and its distance."""
        if not text or not len(self.automaton):
            return {}
        plain = normalize(text)
        best: dict[int, int] = {}
        seen: dict[int, int] = {}
        for end, (length, where) in self.automaton.iter(plain):
            for i, offset in where:
                if best.get(i) == 0:
                    continue
                at = end + 1 - length - offset
                item, errors = self.texts[i], self.errors[i]
                # hits in order: a window that the last one of this item covers is not verified again
                if seen.get(i) == at:
                    continue
                seen[i] = at
                if plain.startswith(item, at) if at >= 0 else False:
                    best[i] = 0
                    continue
                window = plain[max(0, at - errors) : at + len(item) + errors]
                d = best_distance(self.masks[i], len(item), window, errors)
                if d <= errors and d < best.get(i, errors + 1):
                    best[i] = d
        return best


def item_groups(benchmark: DataFrame) -> Iterator[Items]:
    """The benchmark in groups of bounded size, each read by the driver on its own."""
    chars = benchmark.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = 1 + chars // GROUP_CHARS
    for g in range(n):
        rows = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == g).select("item_id", "text").collect()
        kept = sorted({(r[0], normalize(r[1])) for r in rows if r[0] is not None and normalize(r[1])})
        if kept:
            yield Items([k[0] for k in kept], [k[1] for k in kept])


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, distance for every document that holds an item within its budget."""
    spark = documents.sparkSession
    out = None
    for group in item_groups(benchmark):
        # built once per worker from the broadcast texts
        shared = spark.sparkContext.broadcast((group.ids, group.texts))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, texts = shared.value
            items = Items(ids, texts)
            for batch in batches:
                docs, found = batch.column("doc_id").to_pylist(), []
                for doc_id, text in zip(docs, batch.column("text")):
                    found += [(doc_id, ids[i], d) for i, d in items.match(text.as_py()).items()]
                cols = list(zip(*found)) or [(), (), ()]
                yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "distance"])

        texts = documents.select(F.col("doc_id").cast("long"), "text")
        part = texts.mapInArrow(run, "doc_id long, item_id long, distance long")
        # of several groups, each is written before the next is read, so that one is held at a time
        out = part if out is None else materialize(out.unionByName(part))
    if out is None:
        return spark.createDataFrame([], "doc_id long, item_id long, distance long")
    return out


def remove_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item; each row is judged by its own text."""
    spark = documents.sparkSession
    for group in item_groups(benchmark):
        shared = spark.sparkContext.broadcast((group.ids, group.texts))
        flag = free_name(documents, "leaks")
        schema = documents.select("*", F.lit(False).alias(flag)).schema

        def run(batches: Iterator[pa.RecordBatch], shared=shared, flag=flag) -> Iterator[pa.RecordBatch]:
            items = Items(*shared.value)
            for batch in batches:
                at = batch.schema.names.index("text")
                found = [bool(items.match(t.as_py())) for t in batch.column(at)]
                yield pa.record_batch([*batch.columns, pa.array(found, pa.bool_())], [*batch.schema.names, flag])

        documents = documents.mapInArrow(run, schema).where(~F.col(flag)).drop(flag)
    return documents
