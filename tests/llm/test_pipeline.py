"""The pipeline's stages, each against what its operator's brute force says about its own input."""

from itertools import combinations

import corpus_pipeline as p
from conftest import SMALL
from messy import messy
from test_decontaminate import plain
from test_near_copies import words_of
from tokenizers import Tokenizer

from reviewmine.llm import bpe


def first_of_groups(texts, least=0.8):
    """The smallest of each group linked by 5-word Jaccard similarities, by comparing all pairs."""
    words = {i: words_of(text) for i, text in texts.items()}
    sets = {i: {tuple(own[k : k + 5]) for k in range(max(1, len(own) - 4))} for i, own in words.items()}
    first = {i: i for i in texts}
    for a, b in combinations(sorted(sets), 2):
        if first[a] != first[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
            low, high = sorted((first[a], first[b]))
            first = {i: low if f == high else f for i, f in first.items()}
    return set(first.values())


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, tables = docs.columns, {}
    for name, stage in p.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, SMALL).write.parquet(path)
        docs = spark.read.parquet(path)
        tables[name] = docs.collect()
    for name in ("language", "quality", "near_duplicates", "decontamination"):
        assert list(tables[name][0].__fields__) == columns
    assert len(tables["language"]) == 200  # all are in a learned language
    ids = lambda name: {r.doc_id for r in tables[name]}
    assert ids("language") > ids("quality") > ids("near_duplicates") > ids("decontamination") == ids("tokens")
    assert ids("near_duplicates") == first_of_groups({r.doc_id: r.text for r in tables["quality"]})
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert ids("decontamination") == {r.doc_id for r in tables["near_duplicates"] if not plain(r.text, items)[1]}
    texts = {r.doc_id: r.text for r in tables["decontamination"]}
    library = Tokenizer.from_file(bpe.VOCABULARY)
    for row in tables["tokens"]:
        assert row.ids == library.encode(texts[row.doc_id], add_special_tokens=False).ids


def test_run_is_the_stages_in_a_row(spark):
    assert p.run(spark, SMALL).columns == ["doc_id", "source", "n_tokens", "ids"]


def test_messy_rows(spark):
    for empty in (False, True):
        for name, stage in p.STAGES:
            docs = messy(spark, empty)
            found = stage(spark, docs, SMALL)
            assert name == "tokens" or found.columns == docs.columns
            assert (found.count() == 0) == empty
