import random

from messy import TEXTS, messy
from pyspark.sql import functions as F

from reviewmine.llm import line_rules as r


def test_repeated_words_against_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 25))]
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)}
        assert r.repeated_words(words) == len(hit)


def test_lines_that_recur_on_a_host_go(spark):
    body = lambda i: " ".join(f"word{i}x{j}" for j in range(12))
    rows = [(i, "a", f"{body(i)}\nAll  RIGHTS reserved by us\n\nEnd {i}") for i in range(30)]
    rows += [(100 + i, "b", f"{body(i)}\nAll rights reserved by us") for i in range(5)]
    # copies of one text count once, so that none of them is held against the others
    rows += [(200 + i, "c", "\n".join(body(j) for j in range(500, 503))) for i in range(40)]
    rows += [(300, "a", "all rights reserved BY us\n" * 4 + "one two three")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    judged = {x.doc_id: x for x in r.judge(docs).select("row.doc_id", "cut", "base_failed", "kept").collect()}
    assert all(judged[i].cut == 5 and judged[i].kept for i in range(30))
    assert all(judged[i].cut == 0 and judged[i].kept for i in [*range(100, 105), *range(200, 240)])
    assert judged[300].cut == 20 and not judged[300].kept
    cleaned = {x.doc_id: x.text for x in r.clean(docs).collect()}
    assert cleaned == {x.doc_id: x.text for x in r.clean(docs, most=0).collect()}
    assert cleaned[3] == f"{body(3)}\n\nEnd 3" and cleaned[100] == rows[30][2] and 300 not in cleaned


def test_messy_rows(spark):
    docs = messy(spark)
    found = r.judge(docs).select("row.doc_id", "row.text", "out.*", "base_failed", "kept").collect()
    assert len(found) == len(TEXTS)
    for x in found:
        words = (x.text or "").encode().split()
        assert x.n_words == len(words) and x.word_chars == sum(len(w.decode()) for w in words)
        assert x.base_failed == (len(words) < 10 or 100 * x.n_repeat_words > 20 * len(words))
    kept = r.clean(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < len(TEXTS)
    by_joins = r.clean(docs, most=-1)
    assert sorted(map(str, by_joins.collect())) == sorted(map(str, kept.collect()))
    assert r.clean(messy(spark, empty=True)).count() == 0
    assert kept.where(F.col("text").isNull()).count() == 0
