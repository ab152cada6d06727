import os
import random
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from reviewmine.operators import overlap
from reviewmine.sources.shared import materialize


@pytest.mark.parametrize("distinct", [False, True])
def test_packed_values_by_hand(monkeypatch, distinct):
    """Fingerprints of all parts, packed and sorted in small pieces: the shared ones come back with their items."""
    monkeypatch.setattr(overlap, "PACKED", 16)
    monkeypatch.setattr(overlap, "SORTED", 5)
    rng = random.Random(5)
    kinds = [(rng.getrandbits(63), rng.getrandbits(31)) for _ in range(40)]
    kinds += [(h, g + (1 << 16)) for h, g in kinds[:10]]  # equal but for the second hash
    rows = [(f"i{i}", k) for i in range(9) for k in rng.sample(range(50), 12)]
    rows += rows[:20] if distinct else []
    batches = [
        pa.RecordBatch.from_arrays(
            [pa.array([i for i, _ in part]), pa.array([kinds[k][0] for _, k in part]), pa.array([kinds[k][1] for _, k in part], pa.int32())],
            names=["item", "h", "g"],
        )
        for part in (rows[a : a + 7] for a in range(0, len(rows), 7))
    ]
    packed = list(overlap._pack(3)(iter(batches)))
    assert sum(len(p) for b in packed for p in b.column("prints").to_pylist()) == 10 * len(rows)
    found = {}
    for part in range(3):
        mine = [b.filter(pa.array(np.array(b.column("part")) == part)) for b in packed]
        for b in overlap._meet(distinct)(iter(mine)):
            for item, value in zip(b.column("item").to_pylist(), b.column("value").to_pylist(), strict=True):
                found.setdefault(value, []).append(item)
    want = {}
    for i, k in set(rows):
        want.setdefault(k, []).append(i)
    assert sorted(sorted(v) for v in found.values()) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_copies_are_not_joined_with_each_other(spark, monkeypatch):
    """40 equal sets of 30 values are 780 pairs; before, all 1200 of their values were joined."""
    joined, join = [], overlap.product_join

    def seen(left, right, keys, *more):
        if keys == ["rank"]:
            joined.append(left.count())
        return join(left, right, keys, *more)

    monkeypatch.setattr(overlap, "product_join", seen)
    rows = [(i, v) for i in range(40) for v in range(30)] + [(40, v) for v in range(20, 60)] + [(41, v) for v in range(40, 60)]
    got = {(r.a, r.b): r.common for r in overlap.overlapping_pairs(spark.createDataFrame(rows, "item long, value long"), 10).collect()}
    want = {(i, j): 30 for i in range(40) for j in range(i + 1, 40)} | {(i, 40): 10 for i in range(40)} | {(40, 41): 20}
    assert got == want
    assert joined[0] <= 30 + 40 + 20


def test_shuffle_files_go_with_their_job(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {p for f in folders for p in Path(f).rglob("shuffle_*.data")}
    before, end = files(), time.time() + 20
    table = materialize(spark.range(1000).repartition(4, "id"))
    while files() - before and time.time() < end:  # they are deleted a moment later
        time.sleep(0.1)
    assert not files() - before
    assert table.count() == 1000


def test_repeated_rows_meet_each_other(spark):
    """A row that occurs twice counts for each occurrence, as in the plain join of the rows."""
    rows = [(0, v) for v in (1, 1, 2, 3)] + [(1, v) for v in (1, 1, 2, 4)] + [(2, v) for v in (2, 3, 4)]
    sets = overlap.shared_values(spark.createDataFrame(rows, "item long, value long"))
    pairs = spark.createDataFrame([(0, 1, 4, 4), (0, 2, 4, 3), (1, 2, 4, 3)], "a long, b long, na long, nb long")
    got = {(r.a, r.b): r.common for r in overlap.count_common(pairs, sets).collect()}
    assert got == {(0, 1): 5, (0, 2): 2, (1, 2): 2}


def test_values_and_pairs_are_counted_in_passes(spark, monkeypatch):
    """No write has the fingerprints of all values or the pairs of all sets, and what is read no more is deleted."""
    rng = random.Random(11)
    sets = {i: set(rng.sample(range(60), 25)) for i in range(40)}
    written, write = [], overlap.materialize

    def seen(df):
        table = write(df)
        written.append((table.columns, table.count(), table.inputFiles()))
        return table

    monkeypatch.setattr(overlap, "materialize", seen)
    rows = spark.createDataFrame([(i, v) for i, s in sets.items() for v in s], "item long, value long")
    got = {(r.a, r.b): r.common for r in overlap.overlapping_pairs(rows, 12).collect()}
    assert got == {(i, j): n for i in sets for j in sets if i < j and (n := len(sets[i] & sets[j])) >= 12}
    values = [w for w in written if w[0] == ["item", "value", "place"]]
    assert sum(n for _, n, _ in values) == 1000
    assert max(n for _, n, _ in values) < 700
    met = [n for columns, n, _ in written if "met" in columns]
    assert len(met) > 1
    assert max(met) < sum(met)
    gone = [f for columns, _, files in written if "place" in columns for f in files]
    assert gone and not any(os.path.exists(f.removeprefix("file:").replace("///", "/")) for f in gone)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_pairs_of_large_fronts_are_counted_in_place(spark, monkeypatch, kind):
    """No row of a join for each common value: bands of sets meet each other once, whatever their number and pieces."""
    for name, value in (("JOINED", 0), ("BAND", 100), ("LEAST_BAND", 50), ("TOGETHER", 2), ("EXPANDED", 30)):
        monkeypatch.setattr(overlap, name, value)
    join = overlap.product_join

    def seen(left, right, keys, *more):
        assert keys != ["rank"]
        return join(left, right, keys, *more)

    monkeypatch.setattr(overlap, "product_join", seen)
    rng = random.Random(12)
    name = int if kind == "long" else "i{}".format
    sets = {name(i): set(rng.sample(range(50), 12 + i % 9)) for i in range(60)}
    sets[name(60)] = sets[name(3)]
    rows = [(i, v) for i, s in sets.items() for v in s]
    got = [(r.a, r.b, r.common) for r in overlap.overlapping_pairs(spark.createDataFrame(rows, f"item {kind}, value long"), 7).collect()]
    want = {(i, j): n for i in sets for j in sets if i < j and (n := len(sets[i] & sets[j])) >= 7}
    assert {(a, b): n for a, b, n in got} == want and len(got) == len(want)
