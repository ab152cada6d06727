"""Joins of sets by what they share: exact counts, overlap thresholds, prefixes.

Sets are a long table ``(item, value)`` without duplicates. The values of every
set are ordered from rare to frequent, and sets are joined on those in front
only. Two sets with enough in common must share some of them, so nothing is
lost, and frequent values mostly stand at the end of the order where they are
not used. Joins of many rows with many rows of a key are divided in both
directions by the number of rows they make (``product_join``). Where the fronts
make very many pairs, these are counted in place, by cells of bands of sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import groupby, pairwise
from math import ceil
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewmine.sources.shared import attach, discard, materialize

STEPS = 4  # frequency classes per doubling
CELLS = 1 << 13  # values of one frequency class are ordered by hash cell
PER_TASK = 1_000_000  # rows that one key of a join makes in one task
PACKED = 200_000  # rows packed at a time
SORTED = 4_000_000  # fingerprints sorted at a time
SLICES = 2  # passes over the values; the disk holds the fingerprints of one
PAIRS_PER_ROW = 3  # pairs counted in one pass for each row they come from
JOINED = 10_000_000  # pairs of fronts up to which these are joined; more are counted in place
BAND, LEAST_BAND = 3_000_000, 100_000  # rows of fronts in a band, but for the front of one set; the least for which one is worth while
TOGETHER = 4  # bands that are broadcast at a time
EXPANDED = 2_000_000  # pairs that a cell counts at a time, but for those of one set
PART_BITS = 31  # a value's number has its task's number above so many bits, and below them its number there


def dealt(left: DataFrame, right: DataFrame, keys: Sequence[str], per_task: int = PER_TASK) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join with the columns ``_i`` and ``_j`` of a grid, so that each cell of a key makes few rows.

    A key with l left and r right rows that makes more than ``per_task`` rows
    becomes a grid: its left rows are dealt to p bands and repeated for each of
    q columns, its right rows the other way round. With bands and columns of
    1000 rows, l * q + r * p rows move to make l * r, a five-hundredth of them;
    a side of fewer rows than that is one band.
    """
    side = int(per_task**0.5)
    some = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_l"))
    more = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_r"))
    heavy = some.join(more, list(keys)).where(F.col("_l") * F.col("_r") > per_task)

    def parts(own: str, other: str) -> Column:
        return F.ceil(F.col(own) / F.greatest(F.lit(side), F.floor(per_task / F.col(other)))).cast("int")

    heavy = materialize(heavy.select(*keys, parts("_l", "_r").alias("_p"), parts("_r", "_l").alias("_q")))
    if heavy.isEmpty():
        return left.withColumns({"_i": F.lit(0), "_j": F.lit(0)}), right.withColumns({"_i": F.lit(0), "_j": F.lit(0)})

    def placed(rows: DataFrame, own: str, mine: str, other: str, every: str) -> DataFrame:
        band = F.pmod(F.xxhash64(*rows.columns), F.coalesce(mine, F.lit(1))).cast("int").alias(own)
        cells = F.sequence(F.lit(0), F.coalesce(every, F.lit(1)) - 1)
        return rows.join(heavy, list(keys), "left").select(*rows.columns, band, F.explode(cells).alias(other))

    return placed(left, "_i", "_p", "_j", "_q"), placed(right, "_j", "_q", "_i", "_p")


def product_join(left: DataFrame, right: DataFrame, keys: Sequence[str], per_task: int = PER_TASK) -> DataFrame:
    """Inner join where both sides may have many rows of a key.

    Adaptive execution divides a key by the bytes it reads, but the work here is
    in the rows it makes, so keys that make many are divided beforehand.
    """
    left, right = dealt(left, right, keys, per_task)
    return left.join(right, [*keys, "_i", "_j"]).drop("_i", "_j")


def count_common(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Number of common values of given pairs ``(a, b, na, nb)``; pairs without any drop out.

    ``sets`` has the rows of ``shared_values``. Each pair walks through its
    smaller set only, in runs of the values that were counted in one task: a
    run of both sets is one row with short numbers, compared in place. Where
    rows are repeated, each meets each one of the other set.
    """
    short = F.col("value").bitwiseAND((1 << PART_BITS) - 1).cast("int")
    runs = sets.groupBy("item", F.shiftright("value", PART_BITS).alias("part")).agg(F.collect_list(short).alias("values"))
    runs = materialize(runs.withColumn("once", F.size("values") == F.size(F.array_distinct("values"))))
    small = F.when(F.col("na") <= F.col("nb"), F.col("a")).otherwise(F.col("b"))
    large = F.when(F.col("na") <= F.col("nb"), F.col("b")).otherwise(F.col("a"))
    walk = pairs.select("a", "b", small.alias("item"), large.alias("other"))
    both = F.array_intersect("values", "others")

    def times(side: str, value: Column) -> Column:
        return F.size(F.filter(side, lambda x: x == value)).cast("bigint")

    repeated = F.aggregate(both, F.lit(0).cast("bigint"), lambda n, v: n + times("values", v) * times("others", v))
    common = F.when(F.col("once") & F.col("other_once"), F.size(both)).otherwise(repeated)
    return (
        product_join(walk, runs, ["item"])
        .select("a", "b", F.col("other").alias("item"), "part", "values", "once")
        .join(runs.withColumnsRenamed({"values": "others", "once": "other_once"}), ["item", "part"])
        .groupBy("a", "b")
        .agg(F.sum(common).alias("common"))
        .where("common > 0")
    )


def shared_values(sets: DataFrame, distinct: bool = False) -> DataFrame:
    """``(item, value, place)`` for the values found in several sets, written; ``value`` becomes a number.

    All rows move once, by value, packed by ``_pack``: the count of a value, its number and (if asked for) the distinct
    rows need nothing else. Places order the values from rare to frequent, by frequency class and hash cell. Equal
    fingerprints of at least 80 bits count as the same value, as in ``set_classes``: among a billion values there is a
    chance of less than one in a million that any two of them meet. ``sets`` is read in ``SLICES`` passes, each for
    other values, so that the fingerprints of all of them are never on disk together.
    """
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = sets.schema["item"].dataType.simpleString()
    rows = sets.dropna(subset=["item", "value"]).select("item", F.xxhash64("value").alias("h"), F.hash("value").alias("g"))
    # a seed of its own, so that the slice says nothing about the fingerprint
    piece = F.pmod(F.xxhash64(F.lit("slice"), "h"), F.lit(SLICES))
    found = []
    for i in range(SLICES):
        packed = rows.where(piece == i).mapInArrow(_pack(parts, i), f"part int, items array<{kind}>, sizes binary, prints binary")
        dealt = packed.repartitionById(parts, F.pmod("part", F.lit(parts)))
        found.append(materialize(dealt.mapInArrow(_meet(distinct), f"item {kind}, value bigint, place int")))
    return reduce(DataFrame.unionByName, found)


def _pack(parts: int, piece: int = 0) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Fingerprints of 10 bytes by part and item: one row for each part and some ``PACKED`` input rows.

    The parts of a slice are numbered after those of the slices before it.
    """

    def packed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches)
        item = pa.concat_arrays(table.column("item").chunks).dictionary_encode()
        code, count = item.indices.to_numpy(), len(item.dictionary)
        h, g = table.column("h").to_numpy(), table.column("g").to_numpy().view(np.uint32)
        key = (g % np.uint32(parts)).astype(np.int64) * count + code
        order = np.argsort(key, kind="stable")
        key, h, g = key[order], h[order], (g[order] >> np.uint32(16)).astype(np.uint16)
        run = np.flatnonzero(np.diff(key, prepend=-1))
        sizes = np.diff(run, append=len(key)).astype(np.int32)
        part = key[run] // count
        first = np.flatnonzero(np.diff(part, prepend=-1))
        last = [*first[1:], len(run)]
        at = [*run[first], len(key)]
        items = item.dictionary.take(pa.array(key[run] % count))
        return pa.RecordBatch.from_arrays(
            [
                pa.array((part[first] + piece * parts).astype(np.int32)),
                pa.ListArray.from_arrays(pa.array([*first, len(run)], pa.int32()), items),
                pa.array([sizes[a:b].tobytes() for a, b in zip(first, last, strict=True)], pa.binary()),
                pa.array([h[a:b].tobytes() + g[a:b].tobytes() for a, b in pairwise(at)], pa.binary()),
            ],
            names=["part", "items", "sizes", "prints"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= PACKED:
                yield packed(held)
                held = []
        if held:
            yield packed(held)

    return run


def _meet(distinct: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The rows of ``shared_values`` of one part, sorted by fingerprint in ranges of about ``SORTED`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        part = table.column("part")[0].as_py()
        items = pa.concat_arrays([c.flatten() for c in table.column("items").chunks]).dictionary_encode()
        sizes = np.frombuffer(b"".join(table.column("sizes").to_pylist()), np.int32)
        code = np.repeat(items.indices.to_numpy().astype(np.int32), sizes)
        prints = [(p, len(p.as_buffer()) // 10) for p in table.column("prints")]
        h = np.concatenate([np.frombuffer(p.as_buffer(), np.uint64, n) for p, n in prints])
        g = np.concatenate([np.frombuffer(p.as_buffer(), np.uint16, n, 8 * n) for p, n in prints])
        ranges, done = -(-len(h) // SORTED), 0
        for i in range(ranges):
            # the upper half of h, so that ranges have about the same size
            here = np.flatnonzero(((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32) == i)
            here = here[np.lexsort((code[here], g[here], h[here]) if distinct else (g[here], h[here]))]
            new = np.ones(len(here), bool)
            new[1:] = (np.diff(h[here]) != 0) | (np.diff(g[here]) != 0)
            if distinct:
                first = new.copy()
                first[1:] |= np.diff(code[here]) != 0
                here, new = here[first], new[first]
            value = np.cumsum(new) - 1
            sets = np.bincount(value, minlength=1)[value]
            shared = sets > 1
            here, value, sets = here[shared], value[shared], sets[shared]
            place = np.floor(STEPS * np.log2(sets)).astype(np.int32) * CELLS + (h[here] % np.uint64(CELLS)).astype(np.int32)
            number = (part << PART_BITS) + done + value
            done += int(new.sum())
            for start in range(0, len(here), PACKED):
                cut = slice(start, start + PACKED)
                yield pa.RecordBatch.from_arrays(
                    [items.dictionary.take(pa.array(code[here[cut]])), pa.array(number[cut], pa.int64()), pa.array(place[cut], pa.int32())],
                    names=["item", "value", "place"],
                )

    return run


def prefixes(shared: DataFrame, sizes: DataFrame, length: Column) -> DataFrame:
    """The first ``length`` values of each set, rarest first: ``(item, value, n, before)``.

    ``shared`` has the rows of ``shared_values``, ``sizes`` the size ``n`` of
    each set, and ``length`` is an expression of it. ``before`` counts the
    values in front of the place of a value, so a place that straddles the
    length is kept whole. Values found in one set only are counted as coming
    first but left out, since they match nothing.
    """
    known = shared.groupBy("item").agg(F.count(F.lit(1)).alias("k")).join(sizes, "item")
    rows = attach(shared, known, "item")
    earlier = F.rank().over(Window.partitionBy("item").orderBy("place")) - 1
    rows = rows.withColumn("before", F.col("n") - F.col("k") + earlier).where(F.col("before") < length)
    return rows.select("item", "value", "n", "before")


def overlapping_pairs(pairs: DataFrame, at_least: int) -> DataFrame:
    """Pairs of keys ``(a, b, common)`` that share at least so many distinct values.

    ``pairs`` has the columns (key, value). With t values to be shared, the
    values of each set in one order, rare ones first, and ``rest`` < t: two such
    sets share t - rest of them in front of the last ``rest`` values of the set
    whose front ends first, which are in front of the other one's too. So the
    fronts are joined and their common values counted; a pair is followed up
    only if that count and the values behind the earlier front can reach t. Then
    just these few values are looked up in the other set. The most frequent
    values of a set are never joined. Of sets with the same shared values only
    the first takes part; its pairs are repeated for the others at the end.
    """
    key, value = pairs.columns[:2]
    sets = pairs.select(F.col(key).alias("item"), F.col(value).alias("value")).dropna()
    shared = shared_values(sets, distinct=True)
    classes = materialize(_same(shared, at_least))
    placed = attach(shared, classes.where("item = rep").select("item"), "item", "left_semi")
    placed = materialize(placed.withColumnRenamed("value", "rank"))
    discard(shared)
    fronts = materialize(_fronts(placed, at_least // 2))
    ahead = F.col("place") <= F.col("last")
    rows = materialize(placed.join(fronts, "item").select("rank", "item", ahead.alias("ahead")))
    discard(placed)
    front = rows.where("ahead").select("rank", "item")
    behind = rows.where("not ahead").select("rank", "item")
    # pairs that are not followed up go before the next pass makes its own
    n, pairs = _work(front)
    if pairs <= JOINED:
        passes = max(1, ceil(pairs / (PAIRS_PER_ROW * n))) if n else 1
        one = F.pmod(F.xxhash64("item"), F.lit(passes))
        counted = (_met(front.where(one == i), front) for i in range(passes))
    else:
        counted = _met_in_cells(front, n, at_least - at_least // 2)
    met = reduce(DataFrame.unionByName, [materialize(_followed(some, fronts, at_least)) for some in counted])
    # a set has fewer than at_least values behind its front, so this makes a bounded number of rows for each pair
    looked_up = product_join(met.select("a", "b", "item", "other"), behind, ["item"]).drop("item").withColumnRenamed("other", "item")
    more = looked_up.join(rows.select("item", "rank"), ["item", "rank"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("more"))
    common = F.col("met") + F.coalesce("more", F.lit(0))
    found = met.join(more, ["a", "b"], "left").select("a", "b", common.alias("common")).where(F.col("common") >= at_least)
    return _repeated(found, classes)


def _work(front: DataFrame) -> tuple[int, float]:
    """The number of rows ``(rank, item)`` and of the pairs of them that have the same rank."""
    n = front.groupBy("rank").agg(F.count(F.lit(1)).cast("double").alias("n"))
    sums = n.agg(F.sum("n").alias("rows"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"))
    rows, pairs = materialize(sums).first()
    return int(rows or 0), pairs or 0.0


def _met(some: DataFrame, front: DataFrame) -> DataFrame:
    """``(a, b, met)``: how many values the fronts of some sets and those of all others have in common."""
    met = product_join(some.withColumnRenamed("item", "a"), front.withColumnRenamed("item", "b"), ["rank"]).where("a < b")
    return met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("met"))


def _followed(met: DataFrame, fronts: DataFrame, at_least: int) -> DataFrame:
    """``(a, b, met, item, other)``: the pairs that may still reach the overlap; ``item`` is the set whose front ends first."""
    met = met.join(fronts.toDF("a", "la", "ra"), "a").join(fronts.toDF("b", "lb", "rb"), "b")
    earlier = F.col("la") <= F.col("lb")
    met = met.where(F.col("met") + F.when(earlier, F.col("ra")).otherwise(F.col("rb")) >= at_least)
    return met.select(
        "a",
        "b",
        "met",
        F.when(earlier, F.col("a")).otherwise(F.col("b")).alias("item"),
        F.when(earlier, F.col("b")).otherwise(F.col("a")).alias("other"),
    )


def _met_in_cells(front: DataFrame, n: int, least: int) -> Iterator[DataFrame]:
    """``_met`` of all pairs with at least so many common values, a table for each ``TOGETHER`` bands of sets.

    A join makes a row for each common value and shuffles most of them to sum them up. Here sets are dealt to bands,
    each written once, packed; a task reads one band with several that are broadcast and counts their pairs in place.
    """
    tasks = front.sparkSession.sparkContext.defaultParallelism
    bands = max(1, -(-n // BAND), min(-(-n // LEAST_BAND), tasks))
    kind = front.schema["item"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            item, rank = table.column("item").combine_chunks().dictionary_encode(), table.column("rank").to_numpy()
            order = np.argsort(rank, kind="stable")
            steps = pa.array(np.diff(rank[order], prepend=0))  # small numbers, which pack well
            own = pa.RecordBatch.from_arrays([steps, item.take(pa.array(order))], names=["step", "item"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(own)
            columns = [table.column("band")[:1].combine_chunks(), pa.array([sink.getvalue().to_pybytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["band", "rows"])

    dealt = front.select(F.pmod(F.xxhash64("item"), F.lit(bands)).cast("int").alias("band"), "rank", "item")
    packed = dealt.repartitionById(bands, "band").mapInArrow(pack, "band int, rows binary")
    packed = materialize(packed.withColumn("one", F.lit(0)))  # the same everywhere, so that a hash join may pair all bands

    def read(rows: pa.Scalar) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        batch = pa.ipc.open_stream(rows.as_buffer()).read_next_batch()
        item = batch.column("item")
        return np.cumsum(batch.column("step").to_numpy()), item.indices.to_numpy(), item.dictionary

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(batch.column("i").to_pylist(), batch.column("j").to_pylist(), batch.column("own"), batch.column("rows"), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, several in groupby(rows(batches), itemgetter(0)):
            own = None
            for _, j, mine, theirs in several:
                own = own or read(mine)
                other = own if i == j else read(theirs)
                for x, y, met in _common(own[:2], other[:2], i == j, least):
                    columns = [own[2].take(pa.array(x)), other[2].take(pa.array(y)), pa.array(met)]
                    yield pa.RecordBatch.from_arrays(columns, names=["x", "y", "met"])

    own = packed.select(F.col("band").alias("i"), F.col("rows").alias("own"), "one")
    for start in range(0, bands, TOGETHER):
        some = packed.where((F.col("band") >= start) & (F.col("band") < start + TOGETHER)).withColumnRenamed("band", "j")
        # each pair of bands once, and each band with about as many others
        ahead = F.pmod(F.col("j") - F.col("i"), F.lit(bands))
        once = (2 * ahead < bands) | ((2 * ahead == bands) & (F.col("i") < F.col("j")))
        met = own.join(F.broadcast(some), "one").where(once).mapInArrow(run, f"x {kind}, y {kind}, met bigint")
        yield met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "met")


def _common(own: tuple, other: tuple, same: bool, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Numbers of the sets of two bands ``(ranks in order, set of each)`` and how many ranks they share, from ``least`` on."""
    (rank, x), (ranks, y) = own, other
    start = np.flatnonzero(np.diff(ranks, prepend=ranks[0] - 1))
    size = np.diff(start, append=len(ranks))
    values = ranks[start]
    at = np.minimum(np.searchsorted(values, rank), len(values) - 1)
    met = np.flatnonzero(values[at] == rank)
    met = met[np.argsort(x[met], kind="stable")]
    x, start, size = x[met].astype(np.int64), start[at[met]], size[at[met]]
    ends, sets = np.cumsum(size), int(y.max()) + 1
    last = np.flatnonzero(np.diff(x, append=-1))  # of each set, its last row
    low = 0
    while low < len(x):
        done = ends[low - 1] if low else 0
        high = last[max(np.searchsorted(ends[last], done + EXPANDED, "right") - 1, np.searchsorted(last, low))] + 1
        n = size[low:high]
        place = np.repeat(start[low:high] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        key = np.repeat(x[low:high] * sets, n) + y[place]
        if same:
            key = key[key % sets > key // sets]
        key.sort()
        first = np.flatnonzero(np.diff(key, prepend=-1))
        count = np.diff(first, append=len(key))
        key, count = key[first[count >= least]], count[count >= least]
        if len(key):
            yield key // sets, key % sets, count
        low = high


def _repeated(found: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs of representatives, for all items they stand for, and the pairs inside each class."""
    copied = classes.groupBy("rep").agg(F.count(F.lit(1)).alias("k"), F.first("n").alias("common")).where("k > 1")
    inside = copied.select(F.col("rep").alias("a"), F.col("rep").alias("b"), "common")
    left = classes.select(F.col("rep").alias("a"), F.col("item").alias("i"))
    right = classes.select(F.col("rep").alias("b"), F.col("item").alias("j"))
    every = product_join(materialize(product_join(materialize(found.unionByName(inside)), left, ["a"])), right, ["b"])
    every = every.where((F.col("a") != F.col("b")) | (F.col("i") < F.col("j")))
    return every.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "common")


def _same(shared: DataFrame, at_least: int) -> DataFrame:
    """``(item, rep, n)`` of sets with enough shared values: the smallest item that has the same ones, and how many."""
    prints = shared.groupBy("item").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("value")).alias("x"), F.bit_xor(F.xxhash64(F.lit("second"), "value")).alias("y")
    )
    prints = materialize(prints.where(F.col("n") >= at_least))
    return attach(prints, prints.groupBy("n", "x", "y").agg(F.min("item").alias("rep")), ["n", "x", "y"]).select("item", "rep", "n")


def _fronts(placed: DataFrame, rest: int) -> DataFrame:
    """``(item, last, rest)``: the last place of the front of each set, and how many values are behind it.

    Places are taken whole, so at most ``rest`` values are behind the front. One shuffle, by set, serves it all.
    """
    behind = F.rank().over(Window.partitionBy("item").orderBy(F.desc("place"))) - 1
    ends = placed.select("item", "place", behind.alias("behind")).where(F.col("behind") <= rest)
    ends = ends.groupBy("item").agg(F.min(F.struct("place", "behind")).alias("end"))
    return ends.select("item", F.col("end.place").alias("last"), F.col("end.behind").alias("rest"))
