import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from messy import TEXTS, messy
from tokenizers import Tokenizer

from reviewmine.llm import bpe


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def encode():
    return bpe.Bpe().encoder()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text_as_the_library_does(text):
    assert ENCODE([text])[0] == LIBRARY.encode(text, add_special_tokens=False).ids


LIBRARY = Tokenizer.from_file(bpe.VOCABULARY)
TABLES = bpe.Bpe()
ENCODE = TABLES.encoder()


def test_special_repeated_and_odd_texts(library, encode):
    rng = random.Random(3)
    texts = ["<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "a" * 999, " " * 77, "\r\n \x85 x", "it's we'LL don't"]
    texts += ["".join(rng.choice("ab ' \n1!é日") for _ in range(rng.randint(0, 80))) for _ in range(500)]
    for text, ids in zip(texts, encode(texts), strict=True):
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert TABLES.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_decoding_part_of_a_character(library):
    ids = library.encode("日", add_special_tokens=False).ids
    assert TABLES.decode(ids[:1]) == library.decode(ids[:1], skip_special_tokens=False)


def test_memory_starts_anew(monkeypatch, library):
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 3)
    encode = bpe.Bpe().encoder()
    for text in ("one two three four five", "six seven <|endoftext|>", "one two"):
        assert encode([text])[0] == library.encode(text, add_special_tokens=False).ids


def test_messy_rows(spark, library):
    rows = bpe.round_trip(messy(spark)).select("row.doc_id", "row.text", "out.*").collect()
    assert len(rows) == len(TEXTS)
    for row in rows:
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert (row.n_tokens, row.ids_sha256) == (len(ids), digest)
        assert row.decoded_sha256 == hashlib.sha256((row.text or "").encode()).hexdigest()
    assert bpe.encode(messy(spark, empty=True)).count() == 0
