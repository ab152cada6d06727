import random
from itertools import combinations

import pytest
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import functions as F

from reviewmine.operators import itemsets, overlap


def make_pairs(seed=5, baskets=60, items=9):
    rng = random.Random(seed)
    rows = []
    for b in range(baskets):
        size = rng.randint(1, 7)
        rows += [(b, f"i{rng.choice(range(items))}") for _ in range(size)]
    rows += [(999, f"i{k}") for k in range(items)] * 40  # one basket with a large share of the rows
    return rows


def brute(pairs, support):
    sets = {}
    for b, i in pairs:
        sets.setdefault(b, set()).add(i)
    counts = {}
    for items in sets.values():
        for k in range(1, len(items) + 1):
            for c in combinations(sorted(items), k):
                counts[c] = counts.get(c, 0) + 1
    return {c: n for c, n in counts.items() if n >= support}


@pytest.fixture(scope="module")
def baskets(spark):
    return itemsets.make_baskets(spark.createDataFrame(make_pairs(), "user_id long, business_id string")).cache()


def as_dict(found):
    return {tuple(r["items"]): r.freq for r in found.collect()}


@pytest.mark.parametrize("support, per_task", [(6, 1_000_000), (12, 20)])
def test_all_levels(baskets, support, per_task, monkeypatch):
    monkeypatch.setattr(overlap.product_join, "__defaults__", (per_task,))
    want = brute(make_pairs(), support)
    got = itemsets.frequent_itemsets(baskets, support)
    assert as_dict(got) == want
    assert support > 6 or max(len(c) for c in want) > 2


def test_no_frequent_items(baskets):
    assert itemsets.frequent_itemsets(baskets, 1000).isEmpty()


def test_two_passes_do_not_depend_on_chunks(baskets, chunks=3):
    candidates = itemsets.son_candidates(baskets, 12, F.pmod("basket", F.lit(chunks))).cache()
    want = brute(make_pairs(), 12)
    assert as_dict(itemsets.son_frequent(baskets, candidates, 12)) == want
    assert {tuple(r["items"]) for r in candidates.collect()} >= set(want)


def test_candidates_are_the_local_sets(baskets):
    pairs, n, support = make_pairs(), 3, 12
    ids = {b for b, _ in pairs}
    want = set()
    for chunk in range(n):
        part = [p for p in pairs if p[0] % n == chunk]
        size = len({b for b, _ in part})
        want |= {c for c, k in brute(part, 1).items() if k * len(ids) >= support * size}
    got = itemsets.son_candidates(baskets, support, F.pmod("basket", F.lit(n)))
    assert {tuple(r["items"]) for r in got.collect()} == want


def test_cases_and_filter(spark):
    pairs = spark.createDataFrame([("u1", "b1"), ("u1", "b2"), ("u1", "b2"), ("u2", "b1")], "user_id string, business_id string")
    by_user = itemsets.make_baskets(pairs, 1)
    by_business = itemsets.make_baskets(pairs, 2)
    assert sorted(map(tuple, by_user.collect())) == [("u1", "b1"), ("u1", "b2"), ("u2", "b1")]
    assert sorted(map(tuple, by_business.collect())) == [("b1", "u1"), ("b1", "u2"), ("b2", "u1")]
    assert {r.basket for r in itemsets.baskets_over(by_user, 1).collect()} == {"u1"}  # strictly more than


def test_agrees_with_fp_growth(baskets):
    n, support = itemsets.basket_count(baskets), 7
    lists = baskets.groupBy("basket").agg(F.collect_set("item").alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=(support - 0.5) / n).fit(lists)
    other = {tuple(sorted(r["items"])): r.freq for r in model.freqItemsets.collect() if r.freq >= support}
    assert as_dict(itemsets.frequent_itemsets(baskets, support)) == other


def test_large_baskets_below_the_support(spark):
    """One basket too few: 3,000 items that would make very many sets are gone after the first level."""
    large = spark.range(4).withColumnRenamed("id", "basket").join(spark.range(3000).select(F.format_string("i%d", "id").alias("item")))
    small = spark.range(10, 16).select(F.col("id").alias("basket"), F.explode(F.array(F.lit("x"), F.lit("y"))).alias("item"))
    assert as_dict(itemsets.frequent_itemsets(large.unionByName(small), 5)) == {("x",): 6, ("y",): 6, ("x", "y"): 6}


def test_bitmaps_meet_sets_in_few_places(spark, monkeypatch):
    """Sets of all sizes over several slots, groups and blocks; bitmaps are moved by block, not by set."""
    monkeypatch.setattr(itemsets, "BLOCK", 5)
    monkeypatch.setattr(itemsets, "HELD", 2)
    rows = {(b, f"i{k}") for b in range(300) for k in range(6) if (b * 7 + k * k) % (k + 2)}
    baskets = spark.createDataFrame([(0, *row) for row in rows], "chunk int, basket long, item string")
    want = {c: n for c, n in brute(rows, 1).items()}
    asked = spark.createDataFrame([(0, list(c)) for c in [*want, ("i0", "none")]], "chunk int, items array<string>")
    bitmaps = itemsets.item_bitmaps(baskets, 7)
    counts = itemsets.count_sets(bitmaps, asked)
    assert as_dict(counts) == want
    # one shuffle of each side and one of the counts: bitmaps never meet sets item by item
    assert "bitmap_and_agg" not in counts._jdf.queryExecution().toString()
