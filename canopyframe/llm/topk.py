"""Exact top-k inner products by pivot-table elimination.

Components become integers, ``floor(256 * x)``.  Every vector has a table of
distances to pivots, which are spread query vectors.  By the triangle
inequality the largest difference between a query's and a candidate's table is
a lower bound on their distance, and so, with both norms, an upper bound on
their inner product.  Each query evaluates candidates in order of this bound
and stops when the next bound is below its k-th best score, so the result is
exact.  A task keeps k candidates per query over all its rows; these meet in a
last ranking per query.

Queries are taken in groups of about ``GROUP_VALUES`` components (what a task
holds is bounded for any table); each group is one pass over the table, and is
written and let go before the next where there are several.

Defined cases: vectors that are null, empty or hold null or non-finite
components take no part; vectors of different lengths are not compared;
components and scores beyond the range of a long are held at its ends;
repeated query rows are one query; every repeated candidate row counts; fewer
candidates than k are all returned; ties go to the smaller vec_id; a null
vec_id is no query and no candidate; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ._shared import materialize

TOP = 5
EVERY = 50
GROUP_VALUES = 1 << 20
PIVOTS = 24
STEP = 256
SLACK = 1e-6


#: Largest component kept (the largest double below 2 ** 63).
_LARGEST = float(2**63 - 1024)


def integers(rows: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(256.0 * rows.astype(np.float64)), -_LARGEST, _LARGEST).astype(np.int64)


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products; those beyond the range of a long are held at its ends."""
    size = np.abs(rows).max(initial=0).astype(float) * np.abs(query).max(initial=0).astype(float) * len(query)
    if size < 2.0**62:
        return rows @ query
    q = query.tolist()
    return np.array([max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(row, q)))) for row in rows.tolist()], dtype=np.int64)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles) of the vectors that take part."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = F.transform("embedding", lambda x: x.cast("double"))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", bad)
    )


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    a, b = rows.astype(np.float64), pivots.astype(np.float64)
    squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0.0))


def spread_pivots(rows: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Pivots far apart: each is the row farthest from those before it."""
    chosen = [0]
    gap = distances(rows, rows[:1])[:, 0]
    while len(chosen) < min(n, len(rows)):
        far = int(np.argmax(gap))
        if gap[far] == 0:
            break
        chosen.append(far)
        gap = np.minimum(gap, distances(rows, rows[far : far + 1])[:, 0])
    return rows[chosen]


class Search:
    """Queries of one length, and their best candidates so far."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int = TOP) -> None:
        self.ids, self.rows, self.k = ids, rows, k
        self.pivots = spread_pivots(rows)
        self.table = distances(rows, self.pivots)
        self.norms = (rows.astype(np.float64) ** 2).sum(axis=1)
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]  # (-score, vec_id), sorted
        self.evaluated = 0

    def bounds(self, rows: np.ndarray) -> np.ndarray:
        """Upper bounds on the inner products, queries by candidates."""
        table = distances(rows, self.pivots)
        gap = np.zeros((len(self.ids), len(rows)))
        for p in range(len(self.pivots)):
            np.maximum(gap, np.abs(self.table[:, p][:, None] - table[:, p][None, :]), out=gap)
        norms = (rows.astype(np.float64) ** 2).sum(axis=1)
        out = (self.norms[:, None] + norms[None, :] - gap * gap) / 2.0
        return out + SLACK * (1.0 + np.abs(out) + norms[None, :] + self.norms[:, None])

    def feed(self, ids: np.ndarray, rows: np.ndarray) -> None:
        # blocks keep the bound matrix small
        size = max(1, 4_000_000 // max(1, len(self.ids)))
        for at in range(0, len(ids), size):
            self._feed(ids[at : at + size], rows[at : at + size])

    def _feed(self, ids: np.ndarray, rows: np.ndarray) -> None:
        bounds = self.bounds(rows)
        for q in range(len(self.ids)):
            best, bound = self.best[q], bounds[q]
            least = -best[-1][0] if len(best) == self.k else None
            order = np.flatnonzero(bound >= least) if least is not None else np.arange(len(ids))
            order = order[np.argsort(-bound[order], kind="stable")]
            for at in range(0, len(order), STEP):
                some = order[at : at + STEP]
                if least is not None:
                    if bound[some[0]] < least:
                        break
                some = some[ids[some] != self.ids[q]]
                scores = products(rows[some], self.rows[q])
                self.evaluated += len(some)
                if least is not None:
                    some, scores = some[scores >= least], scores[scores >= least]
                if len(some):
                    if len(some) > self.k:
                        top = np.lexsort((ids[some], -scores))[: self.k]
                        some, scores = some[top], scores[top]
                    best = sorted([*best, *zip((-scores).tolist(), ids[some].tolist())])[: self.k]
                    least = -best[-1][0] if len(best) == self.k else None
            self.best[q] = best


def _groups(queries: DataFrame) -> Iterator[tuple[list[tuple[int, list[float]]], bool]]:
    """The distinct queries, about GROUP_VALUES components at a time, and whether there are several groups."""
    values = queries.agg(F.coalesce(F.sum(F.size("embedding")), F.lit(0))).first()[0]
    n = -(-values // GROUP_VALUES)
    for g in range(n):
        yield queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == g).collect(), n > 1


def _rank() -> Column:
    return F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))


def search(vectors: DataFrame, every: int = EVERY, k: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every query, exactly."""
    spark = vectors.sparkSession
    ready = usable(vectors)
    queries = ready.where(F.col("vec_id") % every == 0).distinct()
    found = None
    for rows, several in _groups(queries):
        by_length: dict[int, list] = {}
        for vec_id, embedding in sorted(rows):
            by_length.setdefault(len(embedding), []).append((vec_id, embedding))
        packed = {d: (np.array([r[0] for r in some], dtype=np.int64), integers(np.array([r[1] for r in some]))) for d, some in by_length.items()}
        shared = spark.sparkContext.broadcast(packed)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            open_searches = {d: Search(ids, rows, k) for d, (ids, rows) in shared.value.items()}
            for batch in batches:
                ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
                lists = batch.column("embedding")
                lengths = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else lengths
                for d, s in open_searches.items():
                    mine = np.flatnonzero(lengths == d)
                    if len(mine):
                        s.feed(ids[mine], integers(flat[starts[mine][:, None] + np.arange(d)]))
            for s in open_searches.values():
                out = [(int(q), v, -score) for q, best in zip(s.ids, s.best) for score, v in best]
                cols = list(zip(*out)) or [(), (), ()]
                yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])

        part = ready.mapInArrow(run, "query_id long, vec_id long, score long")
        if several:
            part = materialize(part.withColumn("rank", _rank()).where(F.col("rank") <= k).drop("rank"))
            shared.destroy()
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "query_id long, vec_id long, score long")
    return found.withColumn("rank", _rank()).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
