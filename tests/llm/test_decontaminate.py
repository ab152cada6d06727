import random
import re

import pytest
from messy import TEXTS, messy
from pyspark.sql import functions as F

from reviewmine.llm import decontaminate as d


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(text, items, window=10):
    words, hit, found = plain_words(text), set(), set()
    for item, other in items:
        own = plain_words(other)
        n = min(window, len(own))
        grams = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i : i + n]) in grams:
                hit.update(range(i, i + n))
                found.add(item)
    return len(words), len(hit), sorted(i for i in found if i is not None)


@pytest.fixture(scope="module")
def case():
    rng = random.Random(1)
    words = ["ab", "Cd", "é", "日本", "9", "e-f", "g"]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, make(rng.choice([1, 2, 4, 10, 13, 30]))) for i in range(8)] + [(8, None), (9, "--"), (3, "zz zz"), (None, "q r s")]
    docs = [(i, make(rng.randint(0, 60))) for i in range(30)]
    docs += [(100 + i, make(9) + " " + str(t) + ", " + make(9)) for i, (_, t) in enumerate(items)]
    return docs, items


@pytest.mark.parametrize("size", [5, 2_000_000])
def test_against_brute_force(spark, case, size):
    docs, items = case
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = d.scan(table, bench, carry=["doc_id"], size=size)
    rows = found.select("row.doc_id", "out.n_words", d.n_hit().alias("n_hit"), F.array_sort("out.items").alias("items")).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == {i: plain(t, items) for i, t in docs}


def test_messy_rows(spark):
    docs = messy(spark)
    bench = spark.createDataFrame([(1, "a key but LONG enough to be counted by all of them"), (2, None)], "item_id int, text string")
    kept = d.clean(docs, bench)
    assert kept.columns == docs.columns
    assert kept.count() == len(TEXTS) - 1
    assert d.clean(docs, bench.limit(0)).count() == len(TEXTS)
    assert d.clean(messy(spark, empty=True), bench).count() == 0


def test_what_is_hit_goes(spark):
    docs = messy(spark)
    bench = spark.createDataFrame([(1, "brown fox jumps over the lazy dog and runs away")], "item_id int, text string")
    assert {r.doc_id for r in d.clean(docs, bench).collect()} == {t[0] for t in TEXTS} - {1}


def test_slices_are_bounded_and_lose_no_window(spark):
    rng = random.Random(3)
    items = [(i % 7, " ".join(rng.choice(["Ab", "é", "c-d", "9"]) for _ in range(rng.choice([1, 9, 10, 11, 300])))) for i in range(60)]
    items += items[:20] + [(None, "a b"), (1, None), (2, "--")]
    bench = spark.createDataFrame(items, "item bigint, text string")
    groups = [[tuple(x) for x in group.collect()] for group in d.slices(bench, 50)]
    assert len(groups) > 5 and max(sum(len(plain_words(t)) for _, t in g) for g in groups) <= 2 * 50 + d.WINDOW

    def windows(rows):
        found = {}
        for item, text in rows:
            own = plain_words(text)
            n = min(d.WINDOW, len(own))
            for i in range(len(own) - n + 1 if n else 0):
                found.setdefault((item, tuple(own[i : i + n])), 0)
        return set(found)

    assert windows(items) == set().union(*map(windows, groups))
    pieces = [(item, text) for g in groups for item, text in g]
    assert len(pieces) < 60 * 7
