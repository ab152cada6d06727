import random

import numpy as np
import pytest
import xxhash
from conftest import SMALL
from messy import TEXTS, messy
from pyspark.sql import functions as F

from reviewmine.llm import simhash


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).translate({i: 32 for i in range(9, 14)}).split(" ") if w]
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints):
    """Smallest reachable member for each number, by comparing all pairs."""
    fps = sorted(set(prints))
    a = np.array(fps, np.uint64)
    up = {f: f for f in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in fps:
        for y in a[np.bitwise_count(a ^ np.uint64(x)) <= 4].tolist():
            up[max(root(x), root(y))] = min(root(x), root(y))
    return {f: root(f) for f in fps}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_same_hash_as_spark(spark):
    got = spark.range(1).select(F.xxhash64(F.lit("a b c d"))).first()[0]
    assert got == signed(xxhash.xxh64_intdigest(b"a b c d", 42))


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(150)
    rows = simhash.linked(docs).collect()
    texts = dict(docs.select("doc_id", "text").collect())
    prints = {d: plain_fingerprint(t) for d, t in texts.items()}
    groups = plain_groups(prints.values())
    first = {}
    for d, fp in prints.items():
        first[groups[fp]] = min(d, first.get(groups[fp], d))
    assert len(rows) == len(texts)
    assert {(r.doc_id, r.fp, r.component_id) for r in rows} == {(d, signed(fp), first[groups[fp]]) for d, fp in prints.items()}


@pytest.mark.parametrize("part", [3, 2048])
def test_crowded_keys_lose_no_link(spark, part):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for centre in list(fps)[:6]:  # dense balls and long chains
        at = centre
        for _ in range(40):
            for _ in range(rng.randint(1, 5)):
                at ^= 1 << rng.randrange(64)
            fps.add(at)
            if rng.random() < 0.4:
                at = centre
    rows = spark.createDataFrame([(i, signed(f)) for i, f in enumerate(sorted(fps))], "doc_id bigint, fp bigint")
    found = simhash.components(rows, part=part).collect()
    groups = plain_groups(fps)
    number = {f: i for i, f in enumerate(sorted(fps))}
    first = {}
    for f, g in groups.items():
        first[g] = min(number[f], first.get(g, number[f]))
    assert {(r.fp, r.component_id) for r in found} == {(signed(f), first[g]) for f, g in groups.items()}


def test_messy_rows(spark):
    docs = messy(spark)
    rows = simhash.linked(docs).collect()
    assert len(rows) == len(TEXTS)
    empty = [r for r in rows if r.fp == 0]
    assert {r.doc_id for r in empty} >= {2, 3, 4} and {r.component_id for r in empty} == {2}
    kept = simhash.first_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "5", "None", "6", "7", "8", "9", "9"])
    none = messy(spark, empty=True)
    assert simhash.linked(none).count() == 0 and simhash.first_of_each(none).count() == 0
