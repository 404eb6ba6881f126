"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source gets a target of words by weight, at most ``most`` times its own
words; what a cap cuts off is shared again by weight. A source's documents are
dealt by hash into at most ``max_blocks`` blocks; the blocks stand in an order
permuted by hash. A source gives whole passes over its blocks and then the first
blocks of the permuted order until its quota is filled; within the block at the
edge, documents in permuted order follow, and the last one is cut so that the
source's words meet its target to the word.

The quotas (block draws per source) are split over the output shards by a binary
tree: at each node a multivariate-hypergeometric draw tells how many blocks of
each source go left. A shard takes its count of each source's draws from the
source's permuted order, disjoint from those of the other shards, and orders its
documents by a hash of their own. All draws depend on the seed and the data
alone, so reruns agree.

What meets in one task or on the driver: one row a source (its sums and shard
edges), the blocks of one source (at most ``max_blocks``), the documents of one block. Null texts have
size 0, null sources form the last source, documents of size 0 take nothing,
repeated rows each take their own share, an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, staged, word_count

def targets(sizes: DataFrame, share: float, most: float, weights: list[float]) -> DataFrame:
    """(source, source_size) -> the same with target: shares by weight, capped, the excess shared again.

    With sources in the order in which they meet their caps, the level of the
    uncapped ones after k caps is (total - caps so far) / (weights left); the
    first level that fits its source's cap is the final one.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(in_order) - 1) % len(weights)
    rows = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")))
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumns({"level": left / weight_left, "turn": F.row_number().over(by_ratio)})
    level = F.min_by("level", F.when(F.col("level") <= F.col("ratio"), F.col("turn"))).over(everything)
    return rows.select("source", "source_size", F.least("cap", F.coalesce(F.col("weight") * level, F.col("cap"))).alias("target"))


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Counts by (shard, source): each tree node draws how many blocks of each source go to its left half."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def descend(counts: np.ndarray, low: int, high: int) -> None:
        if high - low == 1:
            out[low] = counts
            return
        middle, total = (low + high) // 2, int(counts.sum())
        sample = total * (middle - low) // (high - low)
        rng = np.random.Generator(np.random.PCG64([seed, low, high]))
        left = rng.multivariate_hypergeometric(counts, sample, method="marginals") if total else counts
        descend(left, low, middle)
        descend(counts - left, middle, high)

    descend(np.asarray(quotas, np.int64), 0, shards)
    return out


def _hash(seed: int, *columns: Column) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def _place(ranked: DataFrame, shards: int, seed: int) -> DataFrame:
    """Add ``shard_of_draw``, the shard of each draw of a block.

    A source's draws are numbered pass by pass in the permuted order; the shards
    take consecutive runs of these numbers, as long as the tree's counts.
    """
    sources = ranked.groupBy("source").agg(F.sum("draws").alias("draws"), F.count(F.lit(1)).alias("blocks")).orderBy("source").collect()
    if not sources:
        return ranked.withColumn("shard_of_draw", F.array().cast("array<int>"))
    counts = split_quotas(np.array([r["draws"] for r in sources]), shards, seed)
    edges = np.cumsum(counts, axis=0)
    rows = [(r["source"], int(r["blocks"]), [int(x) for x in edges[:, k]]) for k, r in enumerate(sources)]
    tree = ranked.sparkSession.createDataFrame(rows, ranked.select(F.col("source").alias("s"), F.lit(0).cast("long").alias("n"), F.array(F.lit(0).cast("long")).alias("edges")).schema)
    joined = ranked.join(tree, F.col("source").eqNullSafe(F.col("s")))
    number = lambda i: i * F.col("n") + F.col("rank")
    shard = F.transform(
        F.when(F.col("draws") > 0, F.sequence(F.lit(0), F.col("draws") - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.size(F.filter("edges", lambda edge: edge <= number(i))),
    )
    return joined.select("source", "block", "passes", "open", shard.alias("shard_of_draw"))


def mix(
    docs: DataFrame,
    key: list[str],
    order_by: list[str] | None = None,
    share: float = 1.5,
    most: float = 2.0,
    weights: list[float] = (5.0, 2.0, 1.0),
    shards: int = 16,
    seed: int = 20,
    words_per_block: int = 20_000,
    max_blocks: int = 1 << 16,
) -> DataFrame:
    """One row for each row of ``docs``: ``key``, source, size, source_size, target, taken, places.

    ``order_by`` (by default ``key``) names the columns that the permutations hash.

    ``places`` lists a struct (shard, position key, words) for each time that the
    document is drawn.
    """
    sized = staged(
        docs.select(*key, "source", word_count(F.col("text")).alias("size")).withColumn("mix_row", F.monotonically_increasing_id()), "sizes"
    )
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = staged(targets(sums, share, most, list(weights)).withColumn("blocks", F.least(F.lit(max_blocks), F.greatest(F.lit(1), F.ceil(F.col("source_size") / words_per_block))).cast("long")), "targets")
    dealt = sized.join(goals.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    # the order is by the row's own content, so that it does not depend on how files are read
    chance = _hash(seed, *[F.col(k) for k in order_by or key], F.col("source"), F.col("size"))
    dealt = dealt.withColumn("chance", chance).withColumn("block", F.pmod(_hash(seed + 1, F.col("chance")), F.col("blocks")))
    blocks = dealt.groupBy("source", "block").agg(F.sum("size").alias("words"), F.first("target").alias("target"), F.first("source_size").alias("source_size"))
    order = Window.partitionBy("source").orderBy(_hash(seed + 2, F.col("source"), F.col("block")), "block")
    rest = F.col("target") - F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))) * F.col("source_size")
    ranked = (
        blocks.withColumn("passes", F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))).cast("int"))
        .withColumn("rest", F.round(rest).cast("long"))
        .withColumn("before", F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("rank", F.row_number().over(order) - 1)
        .withColumn("draws", F.col("passes") + (F.col("before") < F.col("rest")).cast("int"))
        .select("source", "block", "passes", "rank", "draws", (F.col("rest") - F.col("before")).alias("open"))
    )
    ranked = staged(ranked, "blocks")
    placed = _place(ranked, shards, seed)
    out = dealt.join(placed.withColumnsRenamed({"source": "s", "block": "b"}), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left")
    inside = Window.partitionBy("source", "block").orderBy("chance", "mix_row")
    out = out.withColumn("ahead", F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    partial = F.greatest(F.lit(0), F.least(F.col("size"), F.col("open") - F.col("ahead"))).cast("long")
    word_of_pass = lambda i: F.when(i < F.col("passes"), F.col("size")).otherwise(partial)
    places = F.transform(F.col("shard_of_draw"), lambda shard, i: F.struct(shard.alias("shard"), _hash(seed + 3, F.col("chance"), i).alias("position"), word_of_pass(i).alias("words")))
    out = out.withColumn("places", F.filter(F.coalesce(places, F.array().cast("array<struct<shard:int,position:bigint,words:bigint>>")), lambda x: x["words"] > 0))
    taken = F.aggregate("places", F.lit(0).cast("long"), lambda total, x: total + x["words"])
    return out.select(*key, "source", "size", "source_size", "target", taken.alias("taken"), "places")


def repeat_rows(docs: DataFrame, mixed: DataFrame, key: list[str]) -> DataFrame:
    """The mixed rows with their documents, ``shard``, ``position`` and ``whole``: one for each draw.

    Rows of ``docs`` with one ``key`` (not null) are alike: any of them stands for all draws.
    The last draw of a source may be cut: its text is then the first words of the
    document, one blank apart, and ``whole`` is false; so the words of the rows are
    those that ``taken`` counts.

    Rows are in order of shard and position, over and within partitions, so files
    written from them hold the shards one after the other, each shuffled.
    """
    draws = mixed.select(*key, "size", F.explode("places").alias("place"))
    parts = draws.select(*key, "place.shard", "place.position", F.col("place.words").alias("mix_words"), (F.col("place.words") == F.col("size")).alias("whole"))
    one = docs.withColumn("mix_turn", F.row_number().over(Window.partitionBy(*key).orderBy(*key))).where("mix_turn = 1").drop("mix_turn")
    placed = one.join(parts, key)
    first = F.array_join(F.slice(F.split(F.regexp_replace("text", f"^{SPACE}", ""), SPACE), F.lit(1), F.col("mix_words").cast("int")), " ")
    cut = placed.withColumn("text", F.when(F.col("whole"), F.col("text")).otherwise(first)).drop("mix_words")
    return cut.repartitionByRange("shard", "position").sortWithinPartitions("shard", "position", *key)
