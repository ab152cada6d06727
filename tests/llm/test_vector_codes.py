import hashlib
import math
import random

import numpy as np
import pytest

from reviewmine.llm import vector_codes as v


def plain(rows, entries=256, rounds=4, parts=4):
    """Codes, errors and codebooks of ``(vec_id, vector)``, one distance after the other."""
    kept = [(i, [math.floor(1024 * x) for x in vec]) for i, vec in rows if vec is not None and all(x is not None and math.isfinite(x) for x in vec)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = [(i, [vec[p * len(vec) // parts : (p + 1) * len(vec) // parts] for p in range(parts)]) for i, vec in kept]
    books = [[c[p] for _, c in cut[:entries]] for p in range(parts)]

    def nearest(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            groups: dict = {}
            for _, c in cut:
                groups.setdefault(nearest(book, c[p])[1], []).append(c[p])
            books[p] = [[sum(x) // len(groups[k]) for x in zip(*groups[k], strict=True)] if k in groups else e for k, e in enumerate(book)]
    best = [(i, [nearest(book, c[p]) for p, book in enumerate(books)]) for i, c in cut]
    return sorted(((i, "".join(f"{k:02x}" for _, k in b), sum(d for d, _ in b)) for i, b in best), key=str), books


def data(n, dim, spread, seed=0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(20)]
    rows = [(i * 3 + 1, [float(np.float32(c + rng.gauss(0, spread))) for c in rng.choice(centres)]) for i in range(n)]
    return rows + [(i, list(rows[0][1])) for i in range(100_000, 100_000 + n // 2)]  # a third is one vector


def table(spark, rows):
    return spark.createDataFrame([(*r, None if r[0] is None else r[0] % 3 or None) for r in rows], "vec_id bigint, embedding array<double>, label int").repartition(5)


@pytest.mark.parametrize(("n", "dim", "spread", "entries"), [(700, 16, 0.3, 64), (400, 8, 0.01, 256), (60, 4, 1.0, 256)])
def test_against_brute_force(spark, n, dim, spread, entries):
    rows = data(n, dim, spread)
    found, books = v.compress(table(spark, rows), entries=entries)
    want, plain_books = plain(rows, entries)
    assert sorted(((r.row.vec_id, r.code, r.error) for r in found.collect()), key=str) == want
    assert [b.tolist() for b in books] == plain_books
    told = ",".join(str(x) for b in plain_books for e in b for x in e)
    assert v.codebooks_digest(books) == hashlib.sha256(told.encode()).hexdigest()


def test_errors_of_groups(spark):
    rows = data(90, 8, 0.5) + [(None, [0.5] * 8)]
    found, _ = v.compress(table(spark, rows), entries=16)
    rows = v.with_group_error(found, "label").collect()
    sums: dict = {}
    for r in rows:
        sums[r.row.label] = sums.get(r.row.label, 0) + r.error
    assert {(r.row.label, r.group_error) for r in rows} == set(sums.items()) and None in sums


@pytest.mark.parametrize("scale", [0, 2, 50, 1 << 27])
def test_trees_give_what_comparing_all_gives(scale):
    rng = np.random.default_rng(scale)
    points = rng.integers(-scale, scale + 1, (1000, 4))
    points[::3] = points[0]
    book = np.concatenate([points[:40], points[:3], points[500:520] + 1]).astype(np.int64)
    tree = v.CoverTree.restored(v.CoverTree.stored([v.CoverTree(points)]))[0]
    entry, count, total = tree.nearest(book)
    best = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(p, e, strict=True)) for e in book] for p in points]).argmin(1)
    assert (entry[tree.member] == best).all() and (count == np.bincount(best, minlength=len(book))).all()
    want = np.zeros_like(book)
    np.add.at(want, best, points)
    assert (total == want).all()


def test_the_tree_covers_and_saves_work(monkeypatch):
    rng = np.random.default_rng(1)
    points = np.repeat(rng.integers(-1000, 1000, (8, 4)), 120, axis=0) + rng.integers(-3, 4, (960, 4))
    tree = v.CoverTree(points)
    for c, a, b, r in zip(tree.centre, tree.start, tree.end, tree.radius, strict=True):
        assert a <= c < b and np.sqrt(((tree.points[a:b] - tree.points[c]) ** 2).sum(1)).max() <= r + 1e-9
    for first, last, a, b in zip(tree.first, tree.last, tree.start, tree.end, strict=True):
        if last > first:  # the children of a node share out its run
            assert tree.start[first] == a and tree.end[last - 1] == b and (tree.start[first + 1 : last] == tree.end[first : last - 1]).all()
    compared, plain_squared = [], v.squared
    monkeypatch.setattr(v, "squared", lambda a, b: compared.append(len(a)) or plain_squared(a, b))
    tree.nearest(points[::120])
    assert sum(compared) < len(tree.points) / 10


def test_rows_that_do_not_count(spark):
    nan, inf = float("nan"), float("inf")
    good = [(7, [0.1] * 8), (2, [-0.2] * 8), (None, [0.3] * 8), (2, [-0.2] * 8)]
    bad = [(1, None), (0, []), (3, [nan] * 8), (4, [inf] + [0.0] * 7), (5, [-inf] * 8), (6, [None] + [0.0] * 7), (8, [0.1] * 7), (9, [0.1] * 4)]
    found, books = v.compress(table(spark, good + bad))
    assert sorted(((r.row.vec_id, r.code, r.error) for r in found.collect()), key=str) == plain(good)[0]
    assert len(books[0]) == 4  # as many entries as rows
    found, books = v.compress(table(spark, bad[:1] + bad[2:6]))
    assert found.count() == 0 and found.columns == ["row", "code", "error"]
    assert v.with_group_error(found, "label").count() == 0


def test_large_numbers_are_held(spark):
    rows = [(1, [1e30] * 8), (2, [-1e300] * 8), (3, [5e4] * 8), (4, [5e4] * 8)]
    found, books = v.compress(table(spark, rows))
    most = v.limit(8)
    assert most >= 1 << 27 and {r.row.vec_id: r.error for r in found.collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    assert books[0].max() == most and books[0].min() == -most


def test_clashing_names(spark):
    rows = [(i, [i / 50 + j for j in range(4)], "a", "b", "c", 1) for i in range(40)]
    docs = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, code string, error string, `a.b` string, v int")
    found, books = v.compress(docs, entries=4)
    got = found.select("row.*", v.decoded(found["code"], books).alias("near")).collect()
    assert found.count() == 40 and all(max(abs(a - b) for a, b in zip(r.embedding, r.near, strict=True)) < 0.5 for r in got)
