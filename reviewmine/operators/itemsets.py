"""Frequent itemsets: level-wise mining, and the two-pass form over chunks of baskets.

Baskets are a long table ``(basket, item)``. Itemsets are sorted arrays. Mining
is vertical: the baskets are numbered in ranges, and each item has a bitmap of
the baskets of a range it is in. A set is counted by intersecting the bitmaps of
its items in the ranges that have all of them, so that no row stands for an
occurrence of a set in a basket, and a basket of any size is a bit for each of
its items. Only items that are frequent themselves take part, and a level only
tries sets whose subsets are frequent.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewmine.operators.overlap import product_join
from reviewmine.sources.shared import attach, materialize

Enough = Callable[[DataFrame], DataFrame]  # keeps the rows whose ``freq`` suffices

RANGE = 24_576  # baskets expected in a range, under the 32,768 bits of Spark's bitmaps; what is above goes to a further one
BLOCK = 200_000  # sets in a block
HELD = 16_384  # bitmaps that a task holds, of 4 KB each; one range of all items at least
TILE = 2048  # sets intersected at a time
BITMAP_ROWS = 64  # rows for pairs in baskets that take as long as intersecting two bitmaps


def make_baskets(pairs: DataFrame, case: int = 1) -> DataFrame:
    """Distinct baskets of (user, business) pairs: by user (case 1) or by business (case 2)."""
    basket, item = pairs.columns[:2] if case == 1 else pairs.columns[1::-1]
    return pairs.select(F.col(basket).alias("basket"), F.col(item).alias("item")).dropna().distinct()


def baskets_over(baskets: DataFrame, size: int) -> DataFrame:
    """Keep baskets with more than ``size`` distinct items."""
    large = baskets.groupBy("basket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > size)
    return attach(baskets, large, "basket", "left_semi")


def basket_count(baskets: DataFrame) -> int:
    return baskets.agg(F.count_distinct("basket")).first()[0]


def frequent_items(baskets: DataFrame, support: int) -> DataFrame:
    counts = baskets.groupBy("item").agg(F.count(F.lit(1)).alias("freq"))
    return counts.where(F.col("freq") >= support)


def item_bitmaps(baskets: DataFrame, slots: int) -> DataFrame:
    """``(chunk, item, slot, part, bits)`` of ``(chunk, basket, item)``: which baskets of a range have the item.

    Baskets are dealt to slots by hash and numbered there; a slot with more
    baskets than a bitmap has bits takes several parts.
    """
    dealt = baskets.withColumn("slot", F.pmod(F.xxhash64("basket"), F.lit(slots)).cast("int"))
    number = F.dense_rank().over(Window.partitionBy("chunk", "slot").orderBy("basket"))
    rows = dealt.select("chunk", "item", "slot", number.alias("number"))
    rows = rows.groupBy("chunk", "slot", "item", F.bitmap_bucket_number("number").alias("part"))
    return rows.agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))


def _extent(baskets: DataFrame) -> tuple[int, float]:
    """The slots that ``(chunk, basket, item)`` take, and how many ordered pairs of items are in baskets."""
    sizes = baskets.groupBy("chunk", "basket").agg(F.count(F.lit(1)).cast("double").alias("n"))
    found = sizes.agg(F.count(F.lit(1)), F.count_distinct("chunk"), F.sum(F.col("n") * (F.col("n") - 1))).first()
    return max(1, -(-found[0] // (RANGE * max(1, found[1])))), found[2] or 0.0


def count_sets(bitmaps: DataFrame, sets: DataFrame) -> DataFrame:
    """``(chunk, items, freq)``: in how many baskets the given ``(chunk, items)`` of any sizes are; 0 is left out.

    The bitmaps of some slots meet a block of the sets in one task, which
    intersects them in place and sums up. So a bitmap moves once for a block of
    sets, and a set once for each group of slots, whatever items they have in common.
    """
    sets = materialize(sets)
    found = bitmaps.agg(F.count(F.lit(1)), F.max("slot")).first()
    tasks = bitmaps.sparkSession.sparkContext.defaultParallelism
    groups = min((found[1] or 0) + 1, max(tasks, -(-found[0] // HELD)))
    blocks = max(1, -(-sets.count() // BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    ranges = bitmaps.withColumn("group", F.pmod("slot", F.lit(groups))).withColumn("block", every(blocks))
    asked = sets.select("chunk", "items", F.pmod(F.xxhash64("items"), F.lit(blocks)).cast("int").alias("block"))
    asked = asked.withColumn("group", every(groups))
    cell = ["chunk", "group", "block"]
    kinds = ", ".join(f"{c} {sets.schema[c].dataType.simpleString()}" for c in ("chunk", "items"))
    met = ranges.groupBy(*cell).cogroup(asked.groupBy(*cell)).applyInArrow(_intersected, f"{kinds}, freq bigint")
    return met.groupBy("chunk", "items").agg(F.sum("freq").alias("freq"))


def _intersected(ranges: pa.Table, asked: pa.Table) -> pa.Table:
    """In how many baskets of some ranges each of the asked sets is; those in none are left out."""
    sets = asked.select(["chunk", "items"]).combine_chunks()
    freq = np.zeros(len(sets), np.int64)
    if len(ranges) and len(sets):
        items = ranges.column("item").combine_chunks().dictionary_encode()
        code = items.indices.to_numpy()
        bits = np.frombuffer(b"".join(ranges.column("bits").to_pylist()), np.uint64).reshape(len(ranges), -1)
        lists = sets.column("items").combine_chunks()
        # an item that no range has is the last row, which stays empty
        none = len(items.dictionary)
        member = pc.fill_null(pc.index_in(lists.flatten(), items.dictionary), none).to_numpy()
        ends = np.cumsum(pc.list_value_length(lists).to_numpy())
        sizes = np.diff(ends, prepend=0)
        where = np.stack([ranges.column(c).to_numpy().astype(np.int64) for c in ("slot", "part")])
        order = np.lexsort(where)
        new = np.flatnonzero((np.diff(where[:, order], axis=1) != 0).any(axis=0)) + 1
        for rows in np.split(order, new):
            table = np.zeros((none + 1, bits.shape[1]), np.uint64)
            table[code[rows]] = bits[rows]
            for size in np.unique(sizes):
                some = np.flatnonzero(sizes == size)
                for start in range(0, len(some), TILE):
                    at = some[start : start + TILE]
                    both = table[member[ends[at] - size]]
                    for i in range(1, size):
                        both &= table[member[ends[at] - size + i]]
                    freq[at] += np.bitwise_count(both).sum(axis=1, dtype=np.int64)
    return sets.append_column("freq", pa.array(freq)).filter(pa.array(freq > 0))


def _pairs(single: DataFrame) -> DataFrame:
    """All pairs of frequent items of a chunk."""
    one = single.select("chunk", F.col("items")[0].alias("p"))
    pairs = one.join(one.withColumnRenamed("p", "q"), "chunk").where("p < q")
    return pairs.select("chunk", F.array("p", "q").alias("items"))


def _count_pairs(kept: DataFrame) -> DataFrame:
    """``(chunk, items, freq)`` of all pairs, from the baskets themselves."""
    one, other = kept.withColumnRenamed("item", "p"), kept.withColumnRenamed("item", "q")
    met = product_join(one, other, ["chunk", "basket"]).where("p < q").groupBy("chunk", "p", "q")
    return met.agg(F.count(F.lit(1)).alias("freq")).select("chunk", F.array("p", "q").alias("items"), "freq")


def _candidates(level: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """Sets of ``size`` items, all of whose subsets one item smaller are frequent.

    A set grows only by an item that forms a frequent pair with its last item.
    """
    pair = pairs.select("chunk", F.col("items")[0].alias("last"), F.col("items")[1].alias("next"))
    grown = (
        level.select("chunk", "items", F.element_at("items", -1).alias("last"))
        .join(pair, ["chunk", "last"])
        .select("chunk", F.concat("items", F.array("next")).alias("items"))
    )
    smaller = [
        F.concat(F.slice("items", 1, i), F.slice("items", i + 2, size - i - 1)) for i in range(size)
    ]
    subsets = grown.select("chunk", F.col("items").alias("whole"), F.explode(F.array(*smaller)).alias("items"))
    return (
        subsets.join(level, ["chunk", "items"], "left_semi")
        .groupBy("chunk", "whole")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") == size)
        .select("chunk", F.col("whole").alias("items"))
    )


def _mined(baskets: DataFrame, enough: Enough, max_size: int | None = None) -> DataFrame:
    """Frequent sets ``(chunk, size, items, freq)`` of baskets ``(chunk, basket, item)``; each level proposes the next."""
    single = baskets.groupBy("chunk", "item").agg(F.count(F.lit(1)).alias("freq"))
    levels = [materialize(enough(single.select("chunk", F.array("item").alias("items"), "freq")))]
    if max_size != 1 and not levels[0].isEmpty():
        # the filtered rows are made anew where they are used; a user's own plan should be written or cached
        kept = attach(baskets, levels[0].select("chunk", F.col("items")[0].alias("item")), ["chunk", "item"], "left_semi")
        slots, in_baskets = _extent(kept)
        per_chunk = levels[0].groupBy("chunk").agg(F.count(F.lit(1)).cast("double").alias("n"))
        of_items = per_chunk.agg(F.sum(F.col("n") * (F.col("n") - 1))).first()[0]
        few = of_items * slots * BITMAP_ROWS <= in_baskets
        bitmaps = materialize(item_bitmaps(kept, slots)) if few or max_size != 2 else None
        levels.append(materialize(enough(count_sets(bitmaps, _pairs(levels[0])) if few else _count_pairs(kept))))
    while len(levels) not in (1, max_size) and not levels[-1].isEmpty():
        levels.append(materialize(enough(count_sets(bitmaps, _candidates(levels[-1], levels[1], len(levels) + 1)))))
    whole = reduce(DataFrame.unionByName, levels)
    return whole.select("chunk", F.size("items").alias("size"), "items", "freq")


def frequent_itemsets(baskets: DataFrame, support: int, max_size: int | None = None) -> DataFrame:
    """All itemsets in at least ``support`` baskets: ``(size, items, freq)``."""
    enough = lambda counts: counts.where(F.col("freq") >= support)
    return _mined(baskets.withColumn("chunk", F.lit(0)), enough, max_size).drop("chunk")


def son_candidates(baskets: DataFrame, support: int, chunk: Column) -> DataFrame:
    """First pass: sets frequent within some chunk, at the share of the support the chunk has.

    ``chunk`` assigns every basket to one of a fixed number of chunks. The share
    is compared in whole numbers, so no set is lost to rounding.
    """
    chunked = baskets.withColumn("chunk", chunk)
    sizes = materialize(chunked.select("chunk", "basket").distinct().groupBy("chunk").agg(F.count(F.lit(1)).alias("part")))
    total = sizes.agg(F.coalesce(F.sum("part"), F.lit(0))).first()[0]

    def enough(counts: DataFrame) -> DataFrame:
        # one row per chunk, and the number of chunks is a parameter
        joined = counts.join(F.broadcast(sizes), "chunk")
        return joined.where(F.col("freq") * total >= support * F.col("part")).drop("part")

    return _mined(chunked, enough).select("size", "items").distinct()


def son_frequent(baskets: DataFrame, candidates: DataFrame, support: int) -> DataFrame:
    """Second pass: exact counts of the candidates of all sizes over all baskets, in one go."""
    listed = materialize(candidates.select(F.lit(0).alias("chunk"), "items"))
    items = listed.select("chunk", F.explode("items").alias("item")).distinct()
    kept = attach(baskets.withColumn("chunk", F.lit(0)), items, ["chunk", "item"], "left_semi")
    counts = count_sets(materialize(item_bitmaps(kept, _extent(kept)[0])), listed)
    return counts.where(F.col("freq") >= support).select(F.size("items").alias("size"), "items", "freq")
