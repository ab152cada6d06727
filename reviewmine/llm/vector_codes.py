"""Vectors as short codes: a codebook for each part of the components, learned with cover trees.

Vectors are whole numbers here (``floor(1024 * x)``), so that sums and squared
distances are exact and no order of rows can change a result. The vectors of a
task are dealt to blocks of ``BLOCK``; every block gets one cover tree for each
part, written once and read in every round. A tree's points stand in the order
of a walk through it, so that a subtree is a run of them, and running sums give
its total in two look-ups. A round goes down the trees: if some entry is closer
to a node's centre than any other by more than twice the node's radius, the
triangle inequality gives it to the whole subtree at once; only ambiguous nodes
are opened, down to single points, which are compared exactly. Equal parts of a
block are one point with a count. What leaves a task is one sum for each entry.

Defined results: rows without a vector, or with a null, not a number or infinite
component, have no code and are left out. The vectors' length is that of the
row with the smallest id among those whose length is a positive multiple of the
number of parts; rows of any other length are left out too. Numbers beyond
``limit(length)`` (2 ** 27 for 64 components) are held there, as squared
distances would not fit into 64 bits. Rows without an id come last in the choice
of the first entries; rows of one id are chosen in the order of their vectors,
and repeated rows may make repeated entries, of which the first is used. Fewer
rows than entries make as many entries as rows. An empty table has no codes.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from reviewmine.llm.batches import quoted
from reviewmine.sources.shared import attach, materialize

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
BLOCK = 1024  # vectors under one tree

Codebooks = list[np.ndarray]  # for each part, entries x components


def limit(length: int) -> int:
    """The largest power of two whose squared distances, summed over all components, stay under 2 ** 62."""
    return 1 << ((60 - (length - 1).bit_length()) // 2)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all rows of ``b``, exact."""
    most = max(int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0)))
    if 4 * a.shape[1] * most * most < 1 << 53:  # all sums are whole numbers that a double can hold
        x, y = a.astype(np.float64), b.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)).astype(np.int64)
    total = np.zeros((len(a), len(b)), np.int64)
    for i in range(a.shape[1]):
        total += (a[:, i, None] - b[None, :, i]) ** 2
    return total


class CoverTree:
    """A cover tree over some points; nodes of one level follow each other, and so do the children of a node."""

    def __init__(self, points: np.ndarray):
        distinct, self.member, count = np.unique(points, axis=0, return_inverse=True, return_counts=True)
        self.member = self.member.reshape(-1)
        far = np.sqrt(squared(distinct, distinct).astype(np.float64))
        nodes, runs = self._grown(far)
        order = np.array(runs, np.int64)
        self.points, self.weight = distinct[order], count[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.member = place[self.member]
        self.centre, self.start, self.end, self.first, self.last = (np.array(c, np.int64) for c in list(zip(*nodes, strict=True))[:5])
        self.centre = place[self.centre]
        self.radius = np.array([node[5] for node in nodes])
        self._add_up()

    def _add_up(self) -> None:
        """The running counts and sums of the points in their order."""
        self.count = np.concatenate([[0], np.cumsum(self.weight)])
        sums = np.cumsum(self.points * self.weight[:, None], axis=0)
        self.total = np.concatenate([np.zeros((1, self.points.shape[1]), np.int64), sums])

    @staticmethod
    def stored(trees: Sequence[CoverTree]) -> bytes:
        """The trees in little room: small numbers in few bytes, and no running sums."""
        kept = [{k: v for k, v in vars(tree).items() if k not in ("count", "total")} for tree in trees]
        small = lambda a: a.astype(np.min_scalar_type(-int(np.abs(a).max(initial=0)) - 1)) if a.dtype == np.int64 else a
        return pickle.dumps([{k: small(v) for k, v in arrays.items()} for arrays in kept])

    @staticmethod
    def restored(blob: bytes) -> list[CoverTree]:
        trees = []
        for arrays in pickle.loads(blob):
            tree = object.__new__(CoverTree)
            vars(tree).update({k: v if v.dtype == np.float64 else v.astype(np.int64) for k, v in arrays.items()})
            tree._add_up()
            trees.append(tree)
        return trees

    @staticmethod
    def _grown(far: np.ndarray) -> tuple[list, list]:
        """Nodes ``[centre, start, end, first child, last child, radius]`` breadth first, and the points in order.

        The children of a node are centres further than half its radius from
        each other, and every point goes to the first one that covers it.
        """
        whole = np.arange(len(far))
        nodes = [[0, 0, len(far), 0, 0, float(far[0].max())]]
        runs = [whole]
        at = 0
        while at < len(nodes):
            centre, start, _, _, _, radius = nodes[at]
            members = runs[at]
            if radius > 0:
                nodes[at][3] = len(nodes)
                left, ordered, cover = members, [], radius / 2
                pick = centre
                while len(left):
                    near = far[pick, left] <= cover
                    own = left[near]
                    nodes.append([int(pick), start, start + len(own), 0, 0, float(far[pick, own].max())])
                    runs.append(own)
                    ordered.append(own)
                    start += len(own)
                    left = left[~near]
                    pick = left[0] if len(left) else 0
                nodes[at][4] = len(nodes)
                runs[at] = None
            at += 1
        # a node without children has one point, as equal points are one
        leaves = sorted((node[1], node[0]) for node in nodes if node[5] == 0)
        return nodes, [point for _, point in leaves]

    def nearest(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each point its entry, and the counts and sums of each entry's points."""
        entry = np.zeros(len(self.points), np.int64)
        count, total = np.zeros(len(book), np.int64), np.zeros(book.shape, np.int64)
        open_nodes = np.zeros(1, np.int64)
        while len(open_nodes):
            square = squared(self.points[self.centre[open_nodes]], book)
            best = square.argmin(1)  # the lower one of equals
            far = np.sqrt(square.astype(np.float64))
            nearest = far[np.arange(len(far)), best]
            far[np.arange(len(far)), best] = np.inf
            # rounding of the roots is far below the margin
            reach = (nearest + 2 * self.radius[open_nodes]) * (1 + 1e-12) + 1e-9
            sure = (far.min(1) > reach) | (self.radius[open_nodes] == 0)
            done, given = open_nodes[sure], best[sure]
            start, end = self.start[done], self.end[done]
            np.add.at(count, given, self.count[end] - self.count[start])
            np.add.at(total, given, self.total[end] - self.total[start])
            entry[_runs(start, end)] = np.repeat(given, end - start)
            open_nodes = _runs(self.first[open_nodes[~sure]], self.last[open_nodes[~sure]])
        return entry, count, total


def _runs(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of all runs ``[start, end)`` one after the other."""
    size = end - start
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def whole_numbers(docs: DataFrame, vector: str, length: int | None = None) -> DataFrame:
    """All rows with a vector that counts, as ``(row, v)``; of the given length only, if there is one."""
    x = quoted(vector)
    valid = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = docs.where(x.isNotNull() & F.coalesce(valid, F.lit(False)))
    if length is None:
        kept, bound = kept.where((F.size(x) > 0) & (F.size(x) % PARTS == 0)), float(limit(PARTS))
    else:
        kept, bound = kept.where(F.size(x) == length), float(limit(length))
    number = lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(bound)), F.lit(-bound))).cast("bigint")
    return kept.select(F.struct(*map(quoted, docs.columns)).alias("row"), F.transform(x, number).alias("v"))


def first_entries(docs: DataFrame, key: str, vector: str, entries: int = ENTRIES) -> Codebooks:
    """The parts of the vectors with the smallest ids."""
    order = [F.col("id").asc_nulls_last(), "v"]
    named = lambda kept: kept.select(F.col("row").getField(key).alias("id"), "v").orderBy(*order)
    first = named(whole_numbers(docs, vector)).first()
    if first is None:
        return []
    rows = named(whole_numbers(docs, vector, len(first.v))).limit(entries).collect()
    table = np.array([row.v for row in rows], np.int64)
    return [np.ascontiguousarray(part) for part in np.split(table, PARTS, axis=1)]


def plant(kept: DataFrame) -> DataFrame:
    """``(rows, trees)``: a row for each block of ``(row, v)``, with the carried rows and a tree for each part."""
    schema = T.StructType().add("rows", T.ArrayType(kept.schema["row"].dataType)).add("trees", "binary")
    kind = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                block = batch.slice(start, BLOCK)
                flat = block.column("v").flatten().to_numpy(zero_copy_only=False)
                table = flat.reshape(block.num_rows, -1)
                trees = [CoverTree(part) for part in np.split(table, PARTS, axis=1)]
                rows = pa.ListArray.from_arrays(pa.array([0, block.num_rows], pa.int32()), block.column("row"))
                yield pa.RecordBatch.from_arrays([rows, pa.array([CoverTree.stored(trees)])], schema=kind)

    return kept.mapInArrow(run, schema)


def _sums(planted: DataFrame, books: Codebooks) -> list:
    """``(part, entry, n, sums)`` over all vectors: one row for each used entry."""
    shared = planted.sparkSession.sparkContext.broadcast(books)  # bounded by the number of entries
    width = books[0].shape[1]
    schema = T.StructType.fromDDL("part int, entry int, n bigint, sums array<bigint>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        counts = [np.zeros(len(book), np.int64) for book in books]
        totals = [np.zeros(book.shape, np.int64) for book in books]
        for batch in batches:
            for blob in batch.column("trees"):
                for part, tree in enumerate(CoverTree.restored(blob.as_py())):
                    _, count, total = tree.nearest(books[part])
                    counts[part] += count
                    totals[part] += total
        for part, (count, total) in enumerate(zip(counts, totals, strict=True)):
            used = np.flatnonzero(count)
            columns = [np.full(len(used), part), used, count[used], list(total[used])]
            arrays = [pa.array(c, f.type) for c, f in zip(columns, to_arrow_schema(schema), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    found = planted.select("trees").mapInArrow(run, schema)
    sums = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]
    summed = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums)
    return summed.select("part", "entry", "n", F.array(*(f"s{i}" for i in range(width))).alias("sums")).collect()


def learn(planted: DataFrame, books: Codebooks, rounds: int = ROUNDS) -> Codebooks:
    """The codebooks after so many rounds; an entry that no vector is nearest to stays."""
    for _ in range(rounds):
        books = [book.copy() for book in books]
        for part, entry, n, sums in _sums(planted, books):
            books[part][entry] = [total // n for total in sums]
    return books


def assigned(planted: DataFrame, books: Codebooks) -> DataFrame:
    """``(row, code, error)``: the nearest entries in hex, and the squared distance to them."""
    shared = planted.sparkSession.sparkContext.broadcast(books)
    row = planted.schema["rows"].dataType.elementType
    schema = T.StructType().add("row", row).add("code", "string").add("error", "long")
    kind = to_arrow_schema(schema)
    digits = len(f"{max(ENTRIES, len(books[0])) - 1:x}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = batch.column("rows").slice(i, 1).flatten()
                error, codes = np.zeros(len(rows), np.int64), []
                for tree, book in zip(CoverTree.restored(batch.column("trees")[i].as_py()), shared.value, strict=True):
                    entry = tree.nearest(book)[0]
                    away = ((tree.points - book[entry]) ** 2).sum(1)
                    error += away[tree.member]
                    codes.append(entry[tree.member])
                told = ["".join(f"{c:0{digits}x}" for c in code) for code in zip(*(c.tolist() for c in codes), strict=True)]
                yield pa.RecordBatch.from_arrays([rows, pa.array(told), pa.array(error)], schema=kind)

    return planted.mapInArrow(run, schema)


def compress(
    docs: DataFrame, key: str = "vec_id", vector: str = "embedding", entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, Codebooks]:
    """``(row, code, error)`` of all rows with a vector, and the codebooks."""
    books = first_entries(docs, key, vector, entries)
    kept = whole_numbers(docs, vector, sum(book.shape[1] for book in books) or PARTS)
    planted = materialize(plant(kept))
    books = learn(planted, books, rounds) if books else [np.zeros((1, 1), np.int64)] * PARTS
    return assigned(planted, books), books


def with_group_error(found: DataFrame, group: str) -> DataFrame:
    """Adds ``group_error``: the errors summed over the rows with the same value, nulls together."""
    found = materialize(found)
    name = F.col("row").getField(group).cast("string")
    tagged = found.withColumn("_group", F.when(name.isNull(), "").otherwise(F.concat(F.lit("="), name)))
    sums = tagged.groupBy("_group").agg(F.sum("error").alias("group_error"))
    return attach(tagged, sums, "_group").drop("_group")


def codebooks_digest(books: Codebooks) -> str:
    """SHA-256 of all components in the order of part, entry and position."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.reshape(-1).tolist()).encode()).hexdigest()


def decoded(code: Column, books: Codebooks, digits: int = 2) -> Column:
    """The components that a code stands for, in the scale of the vectors."""
    parts = []
    for part, book in enumerate(books):
        table = F.array(*(F.array(*(F.lit(x / SCALE) for x in entry)) for entry in book.tolist()))
        entry = F.conv(F.substring(code, part * digits + 1, digits), 16, 10).cast("int")
        parts.append(F.get(table, entry))
    return F.concat(*parts)
