"""SimHash near-duplicates: pigeonhole blocks, verified Hamming distances, linked groups.

Fingerprints that differ in at most ``distance`` of 64 bits agree on all of some
``agree`` of ``distance + agree`` blocks. So every distinct fingerprint is filed
under each choice of ``agree`` blocks, and only fingerprints with a common key
are compared. A key with many fingerprints is cut into parts, and pairs of parts
are compared in tasks of their own. Compared fingerprints leave a spanning
forest of their links and never the list of all pairs.

Defined results: texts without words (null, empty, white space) have fingerprint
zero and link like others; repeated rows and texts share their fingerprint, which
is compared once; a row without a doc_id links its group, whose component_id is
the smallest doc_id that is there (null if there is none); an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmine.llm.batches import annotate
from reviewmine.operators.graph import connected_components
from reviewmine.sources.shared import materialize

WIDTH = 4  # words in a shingle
DISTANCE = 4  # bits that linked fingerprints may differ in
AGREE = 3  # blocks in a key
PART = 2048  # fingerprints of a key in one part
SUMMED = 1 << 15  # shingles whose bits are counted at a time
REMEMBERED = 1_000_000  # fingerprints whose groups a task remembers


def shingles(text: bytes, width: int) -> list[bytes]:
    """Runs of ``width`` words joined by a space, repeats included; all words if there are fewer; none without words."""
    # bytes.lower and bytes.split know ASCII only: A-Z, and the white space of the word pattern
    flat = b" ".join(text.lower().split())
    if not flat:
        return []
    gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    if len(gaps) < width:
        return [flat]
    starts = np.concatenate(([0], gaps + 1))[: len(gaps) + 2 - width]
    ends = np.append(gaps, len(flat))[width - 1 :]
    return [flat[start:end] for start, end in zip(starts.tolist(), ends.tolist(), strict=True)]


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """Bit i is set if it is set in more than half of the shingles' XXH64 values (seed 42)."""
    grams = shingles(text, width)
    total = np.zeros(64, np.int64)
    for start in range(0, len(grams), SUMMED):
        hashes = [xxhash.xxh64_intdigest(gram, 42) for gram in grams[start : start + SUMMED]]
        octets = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(grams), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", width: int = WIDTH, carry: list[str] | None = None) -> DataFrame:
    """``(row, out)`` with ``out.fp``: the fingerprint as a signed 64-bit number."""

    def make():
        def kernel(texts: list) -> list:
            marks = np.array([fingerprint((t or "").encode(), width) for t in texts], np.uint64)
            return [marks.view(np.int64)]

        return kernel

    return annotate(docs, make, "fp bigint", text, carry)


def block_keys(fp: Column, distance: int = DISTANCE, agree: int = AGREE) -> Column:
    """All choices of ``agree`` blocks as structs ``(choice, bits)``."""
    n = distance + agree
    edges = [64 * i // n for i in range(n + 1)]
    masks = [((1 << end) - 1) ^ ((1 << start) - 1) for start, end in zip(edges, edges[1:], strict=False)]
    keys = []
    for i, chosen in enumerate(combinations(masks, agree)):
        mask = sum(chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(i).alias("choice"), fp.bitwiseAND(F.lit(signed)).alias("bits")))
    return F.array(*keys)


class Forest:
    """Groups of numbers; ``join`` tells which pairs joined two groups."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def forest_links(left: np.ndarray, right: np.ndarray, distance: int, groups: Forest) -> list[tuple[int, int]]:
    """Links between the two sides that join groups not yet joined; every pair is measured."""
    found = []
    other = right.view(np.uint64)
    for x in left.tolist():
        near = np.bitwise_count(other ^ np.int64(x).view(np.uint64)) <= distance
        if near.any():
            found += [(x, y) for y in right[near].tolist() if x != y and groups.join(x, y)]
    return found


def near_links(fps: DataFrame, distance: int = DISTANCE, agree: int = AGREE, part: int = PART) -> DataFrame:
    """``(src, dst)``: links that connect the distinct numbers in ``fp`` as all links of at most ``distance`` bits do.

    Keys of one fingerprint are dropped after a count, and keys of more than
    ``part`` are cut into parts by a hash; a pair of parts is a group. No task
    compares more than ``part`` by ``part`` fingerprints of a key at a time.
    """
    filed = materialize(fps.select("fp", F.explode(block_keys(F.col("fp"), distance, agree)).alias("key")).select("fp", "key.*"))
    sizes = filed.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = sizes.select("choice", "bits", F.ceil(F.col("n") / part).cast("int").alias("parts"))
    # both sides are of the order of the documents; a broadcast would only do for few of them
    shared = filed.join(materialize(sizes).hint("merge"), ["choice", "bits"])
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    shared = shared.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = shared.select(
        "choice", "bits", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "fp"
    )
    cells = cells.repartition("choice", "bits", "low", "high").sortWithinPartitions("choice", "bits", "low", "high")
    return cells.mapInArrow(_compare(distance), "src bigint, dst bigint").distinct()


def _compare(distance: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def links(cell: np.ndarray, groups: Forest) -> list[tuple[int, int]]:
        low, fps = cell[2, 0], cell[5]
        inside = cell[4] == low
        if cell[3, 0] == low:
            return forest_links(fps, fps, distance, groups)
        return forest_links(fps[inside], fps[~inside], distance, groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, open_cell = Forest(), np.empty((6, 0), np.int64)
        for batch in batches:
            rows = np.stack([column.to_numpy(zero_copy_only=False).astype(np.int64) for column in batch.columns])
            rows = np.concatenate([open_cell, rows], axis=1)
            starts = np.flatnonzero((np.diff(rows[:4], axis=1) != 0).any(axis=0)) + 1
            *whole, open_cell = np.split(rows, starts, axis=1)
            if len(groups.up) > REMEMBERED:
                groups = Forest()
            yield _pairs([pair for cell in whole for pair in links(cell, groups)])
        if open_cell.shape[1]:
            yield _pairs(links(open_cell, groups))

    return run


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    src, dst = zip(*found, strict=True) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])


def components(prints: DataFrame, key: str = "doc_id", distance: int = DISTANCE, **limits: int) -> DataFrame:
    """``(fp, component, component_id)`` for the distinct fingerprints of a table ``(key, fp)``.

    A component goes by its smallest fingerprint; ``component_id`` is its smallest key.
    """
    distinct = materialize(prints.groupBy("fp").agg(F.min(key).alias("first")))
    links = materialize(near_links(distinct.select("fp"), distance, **limits))
    if links.isEmpty():
        return distinct.select("fp", F.col("fp").alias("component"), F.col("first").alias("component_id"))
    parts = connected_components(links).select(F.col("node").alias("fp"), "component")
    member = distinct.join(parts, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    member = materialize(member)
    lowest = member.groupBy("component").agg(F.min("first").alias("component_id"))
    return member.join(materialize(lowest), "component").select("fp", "component", "component_id")


def linked(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, fp, component_id)`` for every row."""
    prints = fingerprints(docs, text, carry=[key]).select(F.col("row")[key].alias(key), "out.fp")
    prints = materialize(prints)
    return prints.join(materialize(components(prints, key)), "fp").select(key, "fp", "component_id")


def first_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows to keep, with their own columns: one of each linked group, that of the smallest key.

    Of several rows of the group with that key, and of the rows of a group without keys, the first read is kept.
    """
    place = F.monotonically_increasing_id().alias("place")
    rows = materialize(fingerprints(docs, text).select("row", "out.fp", place))
    prints = rows.select("place", F.col("row")[key].alias("key"), "fp")
    named = materialize(components(prints, "key"))
    chosen = prints.join(named, "fp").where(F.col("key").eqNullSafe(F.col("component_id")))
    chosen = chosen.groupBy("component").agg(F.min("place").alias("place"))
    return rows.join(materialize(chosen.select("place")).hint("merge"), "place", "left_semi").select("row.*")
