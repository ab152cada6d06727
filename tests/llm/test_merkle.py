import hashlib
import zlib

import pytest
from messy import TEXTS, messy
from pyspark.sql import functions as F

from reviewmine.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(*values):
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in values))


def plain_tree(nodes):
    """All levels, from the leaves to the root."""
    levels = [list(nodes)]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i : i + 2]) for i in range(0, len(last), 2)])
    return levels


def plain_path(levels, pos):
    return [(bool(pos >> i & 1), level[(pos >> i) ^ 1] if (pos >> i) ^ 1 < len(level) else None) for i, level in enumerate(levels[:-1])]


def plain(rows):
    """(sorted leaf, path) of rows (doc_id, source, lang, n_chars, text), and the root."""
    groups: dict = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, plain_leaf(*row)))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = [plain_tree([leaf for *_, leaf in sorted(groups[name])]) for name in names]
    top = plain_tree([tree[-1][0] for tree in trees])
    found = []
    for i, tree in enumerate(trees):
        found += [(leaf, plain_path(tree, pos) + plain_path(top, i)) for pos, leaf in enumerate(tree[0])]
    return sorted(found, key=str), top[-1][0]


def shown(proofs):
    return sorted(((r.digest, [tuple(x) for x in r.proof]) for r in proofs.collect()), key=str)


SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def rows_of(sizes):
    return [(7 * i % 9973, f"s{i % 3}", lang, i or None, f"tëxt {i}" * (i % 4)) for lang, n in sizes.items() for i in range(n)]


@pytest.mark.parametrize("sizes", [
    {"en": 1}, {"en": 2}, {"de": 3, "en": 1}, {None: 5, "": 4, "é": 1, "z": 2, "\U0001f600": 3, "\uffff": 6},
    {"a": 255, "b": 256, "c": 257, "d": 511, "e": 513}, {"hot": 2500, "cold": 3, None: 1},
])
def test_against_brute_force(spark, sizes):
    rows = rows_of(sizes)
    manifest = merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(5))
    want, root = plain(rows)
    assert manifest.root == root and shown(manifest.proofs()) == want


@pytest.mark.parametrize("step", [1, 2, 3])
def test_how_often_levels_are_stored_changes_nothing(spark, monkeypatch, step):
    rows = rows_of({"a": 37, "b": 8, "c": 1})
    monkeypatch.setattr(merkle, "STEP", step)
    manifest = merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(3))
    want, root = plain(rows)
    assert manifest.root == root and shown(manifest.proofs()) == want
    assert len(manifest.groups.levels) == 1 + -(-6 // step)


def test_only_every_few_levels_are_stored(spark):
    rows = rows_of({"a": 600})
    levels = merkle.manifest(spark.createDataFrame(rows, SCHEMA)).groups.levels
    assert [level.count() for level in levels] == [600, 3, 1]
    assert sorted(r.digest for r in levels[1].collect()) == sorted(plain_tree(x[2] for x in sorted((True, r[0], plain_leaf(*r)) for r in rows))[8])


def test_some_proofs(spark):
    rows = rows_of({"a": 700, "b": 30})
    manifest = merkle.manifest(spark.createDataFrame(rows, SCHEMA), carry=["doc_id", "text"])
    wanted = spark.createDataFrame([("=a", 3), ("=a", 699), ("=b", 0), ("=b", 99), ("=a", 3)], "tree string, pos bigint")
    found = manifest.proofs(wanted).collect()
    assert sorted((r.tree, r.pos) for r in found) == [("=a", 3), ("=a", 699), ("=b", 0)]
    every = {(r.tree, r.pos): r for r in manifest.proofs().collect()}
    assert all(every[r.tree, r.pos] == r for r in found)


def test_folding_tells_what_changed(spark):
    rows = rows_of({"a": 300, "b": 5, None: 1})
    manifest = merkle.manifest(spark.createDataFrame(rows, SCHEMA))
    found = manifest.proofs().withColumn("bad", F.pmod(F.crc32(F.col("row.doc_id").cast("string").cast("binary")), F.lit(7)) == 0)
    leaf = F.when(F.col("bad"), F.sha2("digest", 256)).otherwise(F.col("digest"))
    got = found.select("row.doc_id", "bad", "proof", merkle.folded(leaf, F.col("proof")).alias("root"), merkle.proof_digest(F.col("proof")).alias("p")).collect()
    for r in got:
        assert r.bad == (zlib.crc32(str(r.doc_id).encode()) % 7 == 0) and (r.root == manifest.root) != r.bad
        assert r.p == h(*(d for _, d in r.proof if d is not None))
    assert any(r.bad for r in got)


def test_repeated_rows_and_keys(spark):
    rows = [(1, "s", "en", 3, "abc")] * 700 + [(1, "s", "en", 3, f"t{i}") for i in range(5)] + [(None, None, None, None, None)] * 3
    manifest = merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(4))
    want, root = plain(rows)
    assert manifest.root == root and shown(manifest.proofs()) == want


def test_messy_rows(spark):
    docs = messy(spark)
    manifest = merkle.manifest(docs, fields=["doc_id", "text", "key", "a.b"], carry=docs.columns)
    found = manifest.proofs().select("row", merkle.folded(F.col("digest"), F.col("proof")).alias("root")).collect()
    assert len(found) == len(TEXTS) and {r.root for r in found} == {manifest.root}
    assert sorted(str(r.row.text) for r in found) == sorted(str(t[1]) for t in TEXTS)
    empty = merkle.manifest(messy(spark, empty=True), fields=["doc_id", "text"])
    assert empty.root is None and empty.proofs().count() == 0


def test_very_long_texts(spark):
    rows = [(i, "s", "en", 3, "é" * 3_000_000 * i) for i in range(3)]
    manifest = merkle.manifest(spark.createDataFrame(rows, SCHEMA))
    want, root = plain(rows)
    assert manifest.root == root and shown(manifest.proofs()) == want
