import itertools

import numpy as np
from messy import TEXTS, messy

from reviewmine.llm import langid as m
from reviewmine.llm.batches import held_out

PIECES = ["a", "ab", "b", "ba", "▁", "▁a", "▁b"]


def all_ways(word, probability):
    """Sum over all segmentations, one by one."""
    total = 0
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        parts, start = [], 0
        for i, cut in enumerate([*cuts, 1], 1):
            if cut:
                parts.append(word[start:i])
                start = i
        total += np.prod([probability.get(p, m.UNKNOWN if len(p) == 1 else 0) for p in parts])
    return total


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(0)
    p = rng.random((len(PIECES), 2))
    model = m.Model(["x", "y"], np.array([0.5, 0.5]), PIECES, p / p.sum(axis=0))
    words = ["▁ab", "▁abba", "▁", "▁aéb", "ba", "▁bababab"]
    scores = m.word_scores(words, m.Pieces(PIECES), model.rows())
    for word, row in zip(words, scores, strict=True):
        for language in range(2):
            want = all_ways(word, dict(zip(PIECES, model.probability[:, language], strict=True)))
            assert np.isclose(np.exp(row[language]), want)


def test_expected_counts_raise_the_likelihood():
    finder, p = m.Pieces(PIECES), np.full((len(PIECES), 1), 1 / len(PIECES))
    words, counts, last = ["▁ab", "▁abab", "▁ba"], np.array([[5.0], [3.0], [1.0]]), -np.inf
    for _ in range(5):
        rows = m.Model(["x"], np.ones(1), PIECES, p).rows()
        now = float((m.word_scores(words, finder, rows) * counts).sum())
        assert now >= last - 1e-9
        last = now
        total = m.expected_counts(words, counts, finder, rows)
        p = (total + 1e-12) / (total + 1e-12).sum()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held", held_out("doc_id", 4))
    model = m.train(docs.where("not held"), rounds=2)
    found = m.predict(docs.where("held"), model).select("row.lang", "out.*").toPandas()
    assert len(found) > 200 and (found.lang == found.lang_pred).mean() > 0.99
    assert found.score.between(0, 1).all()


def test_messy_rows(spark):
    docs = messy(spark)
    model = m.train(docs, rounds=1)
    assert model.languages == ["de", "en"]
    found = m.predict(docs, model).select("row.text", "out.*").collect()
    assert len(found) == len(TEXTS)
    for x in found:
        assert (x.lang_pred == "und") == (not any(c.isalpha() for c in x.text or ""))
    kept = m.reject(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(any(c.isalpha() for c in t[1] or "") for t in TEXTS)
    empty = messy(spark, empty=True)
    nothing = m.train(empty)
    assert m.predict(empty, model).count() == 0
    assert {x.lang_pred for x in m.predict(docs, nothing).select("out.*").collect()} == {"und"}


def test_a_language_that_was_not_learned_is_rejected(spark):
    """Texts of sf0.01 stay, held out or not; those of a language that is left out of the learning mostly go."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held", held_out("doc_id", 4))
    lettered = docs.where("text rlike '[a-z]'")
    kept = m.reject(lettered, m.train(docs.where("not held")))
    assert kept.count() == lettered.count()
    other = [(i, t) for i, t in enumerate(["Съешь же ещё этих мягких французских булок да выпей чаю", "ξεσκεπάζω την ψυχοφθόρα βδελυγμία", "qzxv jkqw zzxq vvkq xqjz wqkx"])]
    assert m.reject(spark.createDataFrame(other, "doc_id int, text string"), m.train(docs.where("not held"))).count() == 0


def test_all_letter_pieces_of_the_vocabulary_are_used():
    pieces = m.pieces_of()
    assert max(map(len, pieces)) > 10 and len(pieces) > 22_000


def test_texts_of_the_same_letters_are_rejected_too(spark):
    """A language left out of the learning goes, though it has the letters of the others, and those stay whole."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held", held_out("doc_id", 4))
    docs = docs.where("text rlike '[a-zA-Z]'").cache()
    for left_out in ("de", "es"):
        kept = m.reject(docs, m.train(docs.where(f"not held and lang <> '{left_out}'"))).groupBy("lang").count()
        kept, all_texts = dict(kept.collect()), dict(docs.groupBy("lang").count().collect())
        assert kept.pop(left_out, 0) < 0.1 * all_texts.pop(left_out)
        assert kept == all_texts


def test_limits_without_another_language(spark):
    """Two names of one language, or a single language, lose no more than the lowest of their own texts."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'fr' and text rlike '[a-z]'")
    named = docs.selectExpr("doc_id", "text", "case when doc_id % 2 = 0 then 'fr' else 'fr-CA' end as lang")
    for rows in (docs, named):
        model = m.train(rows.select("doc_id", "text", "lang"), rounds=2)
        assert set(model.limits) == set(model.languages)
        assert m.reject(rows, model, sure=0).count() >= 0.97 * rows.count()
