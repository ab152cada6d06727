import random

import pytest
from messy import TEXTS, messy
from tokenizers import Tokenizer, models, pre_tokenizers

from reviewmine.llm import token_counts as t

SMALL = [("<unk>", 0.0), ("▁", -2.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("aba", -3.0), ("ba", -2.0), ("▁a", -3.0)]


def tokenizer(pieces, unknown, fallback):
    made = Tokenizer(models.Unigram(pieces, unk_id=unknown, byte_fallback=fallback))
    made.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return lambda text: len(made.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize(("pieces", "unknown", "fallback"), [(SMALL, 0, False), (*t.vocabulary(), True)])
def test_ties_and_unknown_characters_as_the_library_does(pieces, unknown, fallback):
    want, counter, rng = tokenizer(pieces, unknown, fallback), t.TokenCounter(pieces, unknown), random.Random(2)
    for alphabet in ("aabb ", "abc  ▁\n", "xyz<s>0é日😀 "):
        for _ in range(300):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
            assert sum(counter.search(word)[0] for word in t.words_of(text)) == want(text), text


def test_messy_rows(spark):
    want = tokenizer(*t.vocabulary(), True)
    rows = t.count_tokens(messy(spark)).select("row.text", "out.*").collect()
    assert len(rows) == len(TEXTS)
    assert all(r.n_tokens == want(r.text or "") for r in rows)
    assert t.count_tokens(messy(spark, empty=True)).count() == 0
