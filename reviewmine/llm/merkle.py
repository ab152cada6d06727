"""Merkle manifest of a dataset: one tree for each group of rows, the groups' roots under one root.

The leaves and every ``STEP``-th level above them are written as tables; the
levels between them are not kept. A proof is extracted from the top down: each
aligned block of stored nodes (``2 ** STEP`` at most) makes the missing levels
over it anew, hands the siblings on the path to each of its nodes, and forgets
the rest. What lies above a block is the same for all its nodes, so it comes
with the block and is extracted once, one stored level higher up.

A block has a bounded number of digests whatever the size of its tree, so a tree
with most of the rows is many blocks in many tasks. Texts are hashed where they
are read; only digests and the carried columns move.

Defined results: a null field counts as ``-``, an empty one as ``0:``; a text is
hashed whole at any length. Rows ascend by key (null first), those of one key by
digest, and repeated rows are leaves of their own. Rows without a group have a
tree of their own, before those of the other groups in the order of their UTF-8
bytes. An empty table has no rows and no root (null). Columns that are not
fields may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmine.functions.ordering import ranked
from reviewmine.llm.batches import quoted
from reviewmine.sources.shared import attach, materialize

STEP = 8  # levels from one stored level to the next
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def hashed(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts in a row."""
    return F.sha2(F.concat(*parts), 256)


def leaf(*values: Column) -> Column:
    """The digest of a row: each value with its length in bytes in front, so that no two rows read alike."""

    def told(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return hashed(*map(told, values))


def height(n: Column) -> Column:
    """Levels above ``n`` leaves until one node is left."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def _above(level: Column) -> Column:
    """The next level of a block: a digest for every two nodes, and for a last one alone."""
    pairs = F.sequence(F.lit(0), F.floor((F.size(level) + 1) / 2).cast("int") - 1)
    return F.transform(pairs, lambda i: hashed(F.get(level, 2 * i), F.coalesce(F.get(level, 2 * i + 1), F.lit(""))))


def _levels(nodes: Column, steps: Column) -> Column:
    """The levels of a block as lists of digests, from its own nodes up by so many steps."""
    own = F.array(F.transform(nodes, lambda node: node["digest"]))
    rounds = F.slice(F.sequence(F.lit(1), F.lit(STEP)), F.lit(1), steps)
    return F.aggregate(rounds, own, lambda found, _: F.concat(found, F.array(_above(F.element_at(found, -1)))))


def _blocks(nodes: DataFrame) -> DataFrame:
    """``(tree, block, nodes, steps)``: aligned runs of a level, and the levels their trees have above, up to ``STEP``."""
    more = [c for c in nodes.columns if c not in ("tree", "pos", "digest")]
    size = nodes.groupBy("tree").agg(F.least(height(F.count(F.lit(1))), F.lit(STEP)).alias("steps"))
    run = F.array_sort(F.collect_list(F.struct("pos", "digest", *more))).alias("nodes")
    return attach(nodes.groupBy("tree", F.shiftright("pos", STEP).alias("block")).agg(run), size, "tree")


def _siblings(place: Column, levels: Column, steps: Column) -> Column:
    """What a node's path meets in its block: ``(left, digest)`` a level, no digest where the node is alone."""

    def met(level: Column, number: Column) -> Column:
        at = F.call_function("shiftright", place, number)
        left = (at % 2 == 1).alias("left")
        return F.struct(left, F.get(level, at.bitwiseXOR(F.lit(1))).alias("digest"))

    return F.transform(F.slice(levels, F.lit(1), steps), met)


@dataclass
class Trees:
    """Stored levels of some trees, leaves first; the last one has the root of each tree at position 0."""

    levels: list[DataFrame]

    @staticmethod
    def over(leaves: DataFrame) -> Trees:
        """Trees over ``(tree, pos, digest, ...)``, whose positions count from 0 in each tree."""
        levels = [leaves]
        while not levels[-1].where("pos > 0").isEmpty():
            blocks = _blocks(levels[-1].select("tree", "pos", "digest"))
            top = F.element_at(_levels(F.col("nodes"), F.col("steps")), -1)[0].alias("digest")
            levels.append(materialize(blocks.select("tree", F.col("block").alias("pos"), top)))
        return Trees(levels)

    def roots(self) -> DataFrame:
        return self.levels[-1].select("tree", "digest")

    def proofs(self, above: DataFrame | None = None, wanted: DataFrame | None = None) -> DataFrame:
        """The leaves with their ``proof``: siblings from the leaf up to the root, and on through ``above``.

        ``above`` is ``(tree, proof)`` for the roots. ``wanted`` has the places
        ``(tree, pos)`` of leaves to be proved, all of them by default; only
        blocks on their paths are read.
        """
        found = self.levels[-1]
        if above is None:
            found = found.withColumn("proof", F.array().cast("array<struct<left:boolean,digest:string>>"))
        else:
            found = attach(found, above, "tree")
        for k in range(len(self.levels) - 2, -1, -1):
            blocks = _blocks(self.levels[k])
            if wanted is not None:
                path = wanted.select("tree", F.call_function("shiftright", "pos", F.lit((k + 1) * STEP)).alias("block"))
                blocks = attach(blocks, path.distinct(), ["tree", "block"], "left_semi")
            upper = found.select("tree", F.col("pos").alias("block"), F.col("proof").alias("upper"))
            blocks = attach(blocks, upper, ["tree", "block"])
            blocks = blocks.withColumn("levels", _levels(F.col("nodes"), F.col("steps")))
            own = lambda node, i: F.struct(
                node.alias("node"), F.concat(_siblings(i, F.col("levels"), F.col("steps")), F.col("upper")).alias("proof")
            )
            # the levels of a block end here, before its nodes become rows
            done = blocks.select("tree", F.explode(F.transform("nodes", own)).alias("one"))
            found = done.select("tree", "one.node.*", "one.proof")
            found = materialize(found) if k else found
        return found if wanted is None else attach(found, wanted.select("tree", "pos").distinct(), ["tree", "pos"], "left_semi")


@dataclass
class Manifest:
    """The groups' trees, the tree over their roots (one tree named ````), and the root of all."""

    groups: Trees
    top: Trees
    root: str | None

    def proofs(self, wanted: DataFrame | None = None) -> DataFrame:
        """Rows ``(tree, pos, digest, row, proof)``; ``proof`` leads from the row to the root of all."""
        named = self.top.proofs().select(F.col("name").alias("tree"), "proof")
        return self.groups.proofs(named, wanted)


def _positions(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with their position ``pos`` in their tree."""
    # rows that are alike in all of the order are told apart by where they stand, so that no range grows with them
    rows = rows.withColumn("_again", F.monotonically_increasing_id())
    placed = ranked(rows, "tree", *order, "_again", name="_at").drop("_again")
    first = placed.groupBy("tree").agg(F.min("_at").alias("_first"))
    return attach(placed, first, "tree").withColumn("pos", F.col("_at") - F.col("_first")).drop("_at", "_first")


def manifest(
    docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", key: str = "doc_id", carry: Sequence[str] | None = None
) -> Manifest:
    """Hash all rows into trees by ``group``; ``carry`` (the key by default) stays with the leaves as ``row``."""
    name = quoted(group).cast("string")
    leaves = docs.select(
        F.when(name.isNull(), "").otherwise(F.concat(F.lit("="), name)).alias("tree"),
        quoted(key).alias("key"),
        leaf(*map(quoted, fields)).alias("digest"),
        F.struct(*map(quoted, carry or [key])).alias("row"),
    )
    groups = Trees.over(_positions(materialize(leaves), "key", "digest").select("tree", "pos", "digest", "row"))
    roots = ranked(groups.roots().withColumnRenamed("tree", "name"), "name", name="pos")
    top = Trees.over(roots.select(F.lit("").alias("tree"), "pos", "digest", "name"))
    if len(top.levels) == 1:
        top.levels[0] = materialize(top.levels[0])
    root = top.roots().first()  # one row at most
    return Manifest(groups, top, root and root.digest)


def folded(digest: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings lead to."""

    def joined(found: Column, met: Column) -> Column:
        other = F.coalesce(met["digest"], F.lit(""))
        return F.when(met["left"], hashed(other, found)).otherwise(hashed(found, other))

    return F.aggregate(proof, digest, joined)


def proof_digest(proof: Column) -> Column:
    """The digest of all siblings of a proof in their order."""
    return F.sha2(F.array_join(F.transform(proof, lambda met: met["digest"]), ""), 256)
