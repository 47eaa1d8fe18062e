"""Cross-site line dedup by distinct-site spread (DataFrame functions only).

A line found on at least ``min_sites`` distinct sites (``source``) is site
boilerplate: its first occurrence (smallest doc_id, then line number) stays and
every other one is removed.  Lines are compared without the white space around
them; empty lines are never judged, any other line is, however short.

Counting is in three steps.  (1) One aggregate over all lines finds those with
at least ``min_sites`` occurrences and more than one site; others cannot
qualify.  (2) Their sites are counted by HyperLogLog sketches, merged map-side
and then per line hash, so a line on every page costs one sketch per task.
(3) Lines whose estimate is within ``BAND`` (several standard errors) or one
site of the threshold get exact distinct counts.

The occurrences of a line that is on very many pages are dealt over several
tasks in every join.

Defined cases: null text stays null and has no lines; a null source is a site
of its own; null doc_id sorts first; repeated rows are treated alike, each
keeping what a first occurrence keeps; an empty table gives no rows; other
columns are kept as they are, except that ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ._shared import checkpoint, free_name, hash128, join_hot

MIN_SITES = 6
LG_K = 12
BAND = 0.1
SPACE = " \t\r\x0b\x0c"


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE))


def _row_key() -> tuple[Column, Column]:
    """A document by its id and its text: ids may be null or repeated."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 62))).alias("d"), F.xxhash64("text").alias("t")


def lines_of(documents: DataFrame) -> DataFrame:
    """d, t, doc_id, site, pos, h1, h2: every line but the empty ones."""
    d, t = _row_key()
    lines = documents.select(d, t, F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("source").alias("site"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    held = lines.withColumn("line", _trimmed(F.col("line"))).where(F.length("line") > 0)
    h1, h2 = hash128(F.col("line"))
    return held.select("d", "t", "doc_id", "site", "pos", h1.alias("h1"), h2.alias("h2"))


def boilerplate(documents: DataFrame, min_sites: int = MIN_SITES) -> tuple[DataFrame, DataFrame, int]:
    """(h1, h2, first, n) of the lines spread over enough sites, where the candidates occur, and how often in all."""
    keys, lines = ["h1", "h2"], lines_of(documents)
    held = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("site").alias("lo"), F.max("site").alias("hi"))
    candidates = checkpoint(held.where((F.col("n") >= min_sites) & ((F.col("lo") != F.col("hi")) | F.lit(min_sites <= 1))).select(*keys, "n"))
    total = candidates.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hits = checkpoint(join_hot(lines, candidates, keys, "n", total, ["d", "pos"]).drop("n"))
    spread = checkpoint(
        hits.groupBy(*keys).agg(
            F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites"), F.min(F.struct("doc_id", "pos")).alias("first"), F.count(F.lit(1)).alias("n")
        )
    )
    low, high = min_sites * (1 - BAND) - 1, min_sites * (1 + BAND) + 1
    sure = spread.where(F.col("sites") > high)
    near = spread.where(F.col("sites").between(low, high))
    places = join_hot(hits, near.select(*keys, "n"), keys, "n", total, ["d", "pos"]).select(*keys, "site").distinct()
    exact = places.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    settled = near.join(exact.where(F.col("n") >= min_sites).select(*keys), keys, "left_semi")
    return sure.unionByName(settled).select(*keys, "first", "n"), hits, total


def with_removals(documents: DataFrame, min_sites: int = MIN_SITES) -> tuple[DataFrame, str, str]:
    """The documents with two more columns: the kept lines, and how many were removed."""
    found, hits, total = boilerplate(documents, min_sites)
    gone = join_hot(hits, found, ["h1", "h2"], "n", total, ["d", "pos"]).where(~(F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.pos") == F.col("pos"))))
    mine = gone.groupBy("d", "t").agg(F.collect_set("pos").alias("gone"))
    kept, removed = free_name(documents, "kept_text"), free_name(documents, "n_removed")
    d, t = _row_key()
    keys = [free_name(documents, "key_d"), free_name(documents, "key_t"), free_name(documents, "gone_lines")]
    left = documents.withColumns({keys[0]: d, keys[1]: t})
    right = mine.select(F.col("d").alias(keys[0]), F.col("t").alias(keys[1]), F.col("gone").alias(keys[2]))
    joined = left.join(right, keys[:2], "left")
    touched = F.col(keys[2]).isNotNull() & F.col("text").isNotNull()

    def staying(lines: Column) -> Column:
        """Places left of all places (array_except hashes them), then their lines."""
        places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(keys[2]))
        return F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n")

    text = F.transform(F.array(F.split("text", "\n")), staying)[0]  # split once
    out = joined.withColumns({
        removed: F.when(touched, F.size(keys[2])).otherwise(0).cast("long"),
        kept: F.when(touched, text).otherwise(F.col("text")),
    })
    return out.select(*(F.col(f"`{c}`") for c in documents.columns), kept, removed), kept, removed


def remove_boilerplate(documents: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """The documents without boilerplate lines; a document left without any text goes."""
    out, kept, removed = with_removals(documents, min_sites)
    emptied = (F.col(removed) > 0) & (F.length(F.btrim(F.col(kept), F.lit(SPACE + "\n"))) == 0)
    remaining = out.where(~F.coalesce(emptied, F.lit(False)))
    changes = {"text": F.col(kept)}
    if "n_chars" in documents.columns:
        changes["n_chars"] = F.when(F.col(removed) > 0, F.length(kept).cast(documents.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return remaining.withColumns(changes).select(*(F.col(f"`{c}`") for c in documents.columns))


def digest(documents: DataFrame) -> DataFrame:
    """The columns of the query: doc_id, lines, removed lines, and a digest of what is kept."""
    out, kept, removed = with_removals(documents.select("doc_id", "source", "text"))
    return out.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"),
        F.col(removed).alias("n_removed"),
        F.length(F.coalesce(kept, F.lit(""))).cast("long").alias("kept_chars"),
        F.sha2(F.coalesce(kept, F.lit("")), 256).alias("kept_sha256"),
    )
