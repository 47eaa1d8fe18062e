"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Only DataFrame functions run here.  Sources, in code-point order with null
last, weigh 5, 2, 1, repeating.  Together the targets are as large as all
sizes; a target stops at ``cap`` times its source's size and what it leaves is
shared again by weight (solved in one pass over the sources sorted by the
level at which each is full).

Every document belongs to one block of its source, by the leading digits of a
hash of its id.  A source passes over its blocks in whole epochs, then once
more, in permuted order, until its target is met; the last block is entered
document by document, so the words taken miss the target by half a document
at most.  The blocks drawn make an exact quota per source.  A binary tree
splits the quotas among the output shards: at each node a random half of the
node's draws goes left, so the counts per source on either side follow the
multivariate hypergeometric distribution.  Each source's draws, in their
permuted order, are dealt to the shards by those quotas; shards are disjoint
and each is ordered locally by a hash.

Random choices are hashes of a seed and of ids, so reruns agree.

Defined cases: null text has size 0; null source is a source of its own; null
doc_id hashes as the word null; repeated rows count separately; a source
without words has target 0; an empty table gives no rows; other columns stay
out of the digest.

Sizes: draws are at most ``(cap) * 16 ** DIGITS`` per source, whatever the
number of documents; documents are never sorted but for one sub-block of each
source, ``16 ** -(DIGITS + SUB_DIGITS)`` of it.  Only the sources themselves, one
row of sums each, are sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ._shared import checkpoint, word_count

WEIGHTS = (5, 2, 1)
CAP = 3
DIGITS, SUB_DIGITS = 2, 3
LEVELS = 3
#: Leading digits of a node's draw order that its draws are counted by: 16 ** LEAD_DIGITS counts a node at most are sent to every task.
LEAD_DIGITS = 3
#: Draws that a part of a written table holds, about.
PART_DRAWS = 100_000
SEED = "mix-1"


def _key(*parts: str | Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(SEED), *(F.coalesce(F.col(p).cast("string"), F.lit("null")) if isinstance(p, str) else p for p in parts)))


def measure(documents: DataFrame) -> DataFrame:
    """doc_id, source, size, and the digits that deal documents to blocks and sub-blocks."""
    key = _key("doc_id")
    return documents.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("k"),
        F.substring(key, 1, DIGITS).alias("block"), F.substring(key, DIGITS + 1, SUB_DIGITS).alias("sub"),
    )


def targets(blocks: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, target, epochs (whole passes), extra (words of the last pass); one row per source."""
    sums = blocks.groupBy("source").agg(F.sum("block_size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1
    ranked = sums.withColumn("place", place).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    )
    by_level = W.orderBy(F.col("source_size") / F.col("weight"), "place")
    before, onward = by_level.rowsBetween(W.unboundedPreceding, -1), by_level.rowsBetween(0, W.unboundedFollowing)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))).cast("double") / F.sum("weight").over(onward)
    tried = ranked.withColumn("level", level)
    found = F.min(F.when(cap * F.col("source_size") > F.col("weight") * F.col("level"), F.struct(F.col("source_size") / F.col("weight"), "place", "level"))).over(everything)["level"]
    target = F.least((cap * F.col("source_size")).cast("double"), F.col("weight") * F.coalesce(found, F.lit(0.0)))
    out = tried.withColumn("target", target)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    return out.withColumn("epochs", epochs).select("source", "source_size", "target", "epochs", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("extra"))


def _running(partition: list[str], order: list[Column | str], size: str) -> Column:
    return F.coalesce(F.sum(size).over(W.partitionBy(*partition).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def order_blocks(blocks: DataFrame, goals: DataFrame) -> DataFrame:
    """Blocks in the permuted order of each source, with the words before each."""
    joined = blocks.alias("b").join(goals.alias("g"), F.col("b.source").eqNullSafe(F.col("g.source"))).select("b.*", "g.source_size", "g.target", "g.epochs", "g.extra")
    permuted = _key("source", "block")
    return joined.withColumn("turn", permuted).withColumn("before", _running(["source"], ["turn", "block"], "block_size"))


def quota_tree(ordered: DataFrame, levels: int = LEVELS) -> DataFrame:
    """source, block, epoch, shard for every drawn block.

    Level by level, a random half of each node's draws goes left; the counts
    per source at the leaves are the shards' quotas, by which each source's
    draws are dealt in their permuted order.
    """
    last = F.when(F.col("before") < F.col("extra"), 1).otherwise(0)
    counted = ordered.withColumn("n", F.col("epochs") + last).where("n > 0")
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    written = lambda df: checkpoint(df.coalesce(1 + total // PART_DRAWS))
    draws = counted.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).select("source", "block", "turn", "epoch").withColumn("shard", F.lit(0))
    for level in range(levels):
        # a single draw order per node: half of the node's draws, rounded up, go left.  Ranks are counted by the
        # leading digits of the order first, so no task sorts a node's draws.
        # Each level uses the last one twice: it is written, or plans would double with every level.
        draws = written(draws).withColumn("luck", _key(F.lit(f"node{level}"), "source", "block", "epoch")).withColumn("lead", F.substring("luck", 1, LEAD_DIGITS))
        of_node = W.partitionBy("shard")
        counts = draws.groupBy("shard", "lead").agg(F.count(F.lit(1)).alias("n"))
        ahead = counts.select("shard", "lead", _running(["shard"], ["lead"], "n").alias("ahead"), F.sum("n").over(of_node).alias("held"))
        place = F.row_number().over(W.partitionBy("shard", "lead").orderBy("luck", "source", "block", "epoch"))
        placed = draws.join(F.broadcast(ahead), ["shard", "lead"]).withColumn("rank", place + F.col("ahead"))
        draws = placed.select("source", "block", "turn", "epoch", (F.col("shard") * 2 + F.when(F.col("rank") * 2 <= F.col("held") + 1, 0).otherwise(1)).alias("shard"))
    # the leaves' counts are quotas; a source's i-th draw takes the i-th place of its quotas in shard order
    draws = written(draws)
    dealt = draws.withColumn("seat", F.row_number().over(W.partitionBy("source").orderBy("shard", "turn", "epoch")))
    seats = dealt.select("source", "seat", "shard")
    order = draws.withColumn("seat", F.row_number().over(W.partitionBy("source").orderBy("epoch", "turn", "block"))).select("source", "block", "epoch", "seat")
    return order.alias("o").join(seats.alias("s"), F.col("o.source").eqNullSafe(F.col("s.source")) & (F.col("o.seat") == F.col("s.seat"))).select("o.source", "o.block", "o.epoch", "s.shard")


def mix(documents: DataFrame, levels: int = LEVELS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, shards.

    ``shards`` lists the output shard of each copy by epoch; ``place`` orders a
    shard locally.
    """
    sized = checkpoint(measure(documents))
    blocks = sized.groupBy("source", "block").agg(F.sum("size").alias("block_size"))
    goals = targets(blocks)
    ordered = checkpoint(order_blocks(blocks, goals))
    shards = quota_tree(ordered, levels).groupBy("source", "block").agg(F.transform(F.sort_array(F.collect_list(F.struct("epoch", "shard"))), lambda x: x["shard"]).alias("block_shards"))
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source")) & (F.col(f"{a}.block") == F.col(f"{b}.block"))
    plan = ordered.alias("o").join(shards.alias("s"), same("o", "s"), "left").select("o.*", F.coalesce("s.block_shards", F.array().cast("array<int>")).alias("block_shards"))
    docs = sized.alias("d").join(plan.alias("p"), same("d", "p")).select(
        "d.doc_id", "d.source", "d.size", "d.k", "d.block", "d.sub", "p.source_size", "p.target", "p.epochs", "p.extra", "p.before", "p.block_size", "p.block_shards"
    )
    cut = (F.col("before") < F.col("extra")) & (F.col("before") + F.col("block_size") > F.col("extra"))
    whole = docs.where(~cut).withColumn("copies", F.col("epochs") + F.when((F.col("before") < F.col("extra")) & (F.col("size") > 0), 1).otherwise(0))
    # the one block of a source that its target cuts: by sub-blocks, then by documents
    inner = docs.where(cut)
    subs = inner.groupBy("source", "sub").agg(F.sum("size").alias("sub_size"))
    subs = subs.withColumn("sub_before", _running(["source"], ["sub"], "sub_size"))
    placed = inner.alias("d").join(subs.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.sub") == F.col("s.sub"))).select(
        "d.*", (F.col("d.before") + F.col("s.sub_before")).alias("from_words"), "s.sub_size"
    )
    at = F.col("from_words") + _running(["source", "sub"], ["k", "size"], "size")
    cut_docs = placed.withColumn("at", at).withColumn("copies", F.col("epochs") + F.when((F.col("size") > 0) & (F.col("at") + F.col("size") / 2 <= F.col("extra")), 1).otherwise(0))
    cols = ["doc_id", "source", "size", "source_size", "target", "copies", "block_shards"]
    both = whole.select(*cols).unionByName(cut_docs.select(*cols))
    return both.select(
        "doc_id", "source", "size", "source_size", "target", F.col("copies").cast("long").alias("copies"),
        F.slice("block_shards", F.lit(1), F.col("copies").cast("int")).alias("shards"),
    )


def mixed_rows(documents: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The mix itself: one row per copy taken, with its shard and its place in the shard's local shuffle."""
    copies = mix(documents, levels).select("doc_id", "source", "size", F.posexplode("shards").alias("epoch", "shard"))
    return copies.withColumn("place", _key(F.lit("place"), "doc_id", "epoch"))


def digest(documents: DataFrame) -> DataFrame:
    """The columns of the query; ``taken`` counts the copies that the shards hold."""
    return mix(documents).select(
        "doc_id", "size", F.col("source_size").cast("long"), "target",
        (F.size("shards") * F.col("size")).cast("long").alias("taken"), F.array_join(F.col("shards").cast("array<string>"), ",").alias("shards"),
    )
