"""Byte-level BPE: encode and decode whole texts as the ``tokenizers`` library does.

A task keeps the words it has met. New words of a piece of text are encoded
together: the symbols of all of them lie in one flat array, and every round
finds the ranks of all neighbouring pairs by binary search over the sorted pair
keys and merges each word's pair of lowest rank, until no word has a pair left.

Defined results: a null text is encoded as an empty one (no ids, decoded to the
empty string); repeated rows give repeated results; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from reviewmine.llm.batches import annotate

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
KNOWN_WORDS = 400_000  # words a task remembers; beyond, it starts anew
# fixed values of the byte-level scheme: the split pattern, and the bytes that stand for themselves
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = (range(0x21, 0x7F), range(0xA1, 0xAD), range(0xAE, 0x100))


class Bpe:
    """The tables of one byte-level vocabulary."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        vocabulary, merges = stored["model"]["vocab"], stored["model"]["merges"]
        self.added = {token["content"]: token["id"] for token in stored["added_tokens"]}
        plain = set(chain(*PLAIN))
        others = (b for b in range(256) if b not in plain)
        letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
        byte_of = {letter: b for b, letter in letters.items()}
        self.byte_ids = np.array([vocabulary[letters[b]] for b in range(256)])
        self.size = 1 + max(*vocabulary.values(), *self.added.values())
        self.token_bytes = [b""] * self.size
        for token, i in vocabulary.items():
            self.token_bytes[i] = bytes(byte_of[letter] for letter in token)
        for token, i in self.added.items():
            self.token_bytes[i] = token.encode()
        pairs = [merge.split(" ") if isinstance(merge, str) else merge for merge in merges]
        keys = np.array([vocabulary[a] * self.size + vocabulary[b] for a, b in pairs])
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.merged = np.array([vocabulary[a + b] for a, b in pairs])

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each non-empty word; all words advance together, one pair a round."""
        if not words:
            return []
        never = len(self.merged)
        lengths = np.array([len(word) for word in words])
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        done_ids, done_words = [], []
        while len(ids):
            key = ids[:-1] * self.size + ids[1:]
            at = np.minimum(np.searchsorted(self.keys, key), never - 1)
            rank = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.ranks[at], never)
            rank = np.append(rank, never)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            lowest = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(ids))))
            ended = lowest == never
            if ended.any():
                done_ids.append(ids[ended])
                done_words.append(word[ended])
                left = ~ended
                ids, word, rank, lowest = ids[left], word[left], rank[left], lowest[left]
            hits = np.flatnonzero(rank == lowest)
            # of hits that overlap (as in "aaa"), every other one counts, from the left
            run = np.flatnonzero(np.diff(hits, prepend=-2) != 1)
            hits = hits[(np.arange(len(hits)) - np.repeat(run, np.diff(np.append(run, len(hits))))) % 2 == 0]
            ids[hits] = self.merged[rank[hits]]
            keep = np.ones(len(ids), bool)
            keep[hits + 1] = False
            ids, word = ids[keep], word[keep]
        ids, word = np.concatenate(done_ids), np.concatenate(done_words)
        ids = ids[np.argsort(word, kind="stable")]
        cuts = np.cumsum(np.bincount(word, minlength=len(words)))[:-1]
        return [part.tolist() for part in np.split(ids, cuts)]

    def encoder(self) -> Callable[[list], list[list[int]]]:
        """A function from texts to their ids that remembers the words it has met."""
        split = regex.compile(PATTERN).findall
        cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split
        known: dict[str, list[int]] = {}

        def words_of(text: str | None) -> list[str]:
            if not text:
                return []
            if not any(token in text for token in self.added):
                return split(text)
            return list(chain.from_iterable([part] if part in self.added else split(part) for part in cut(text)))

        def encode(texts: list) -> list[list[int]]:
            if len(known) > KNOWN_WORDS:
                known.clear()
            if not known:
                known.update((token, [i]) for token, i in self.added.items())
            split_up = [words_of(text) for text in texts]
            new = list(set(chain.from_iterable(split_up)).difference(known))
            known.update(zip(new, self.encode_words([word.encode() for word in new]), strict=True))
            return [list(chain.from_iterable(map(known.__getitem__, words))) for words in split_up]

        return encode

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


def encode(docs: DataFrame, text: str = "text", path: str = VOCABULARY, carry: list[str] | None = None) -> DataFrame:
    """``(row, out)`` with ``out.ids``: the token ids of each text."""
    tables = docs.sparkSession.sparkContext.broadcast(Bpe(path))

    def make():
        run = tables.value.encoder()
        return lambda texts: [run(texts)]

    return annotate(docs, make, "ids array<int>", text, carry)


def round_trip(docs: DataFrame, text: str = "text", path: str = VOCABULARY, carry: list[str] | None = None) -> DataFrame:
    """``(row, out)``: how many tokens a text has, a digest of their ids, and one of the text decoded from them."""
    tables = docs.sparkSession.sparkContext.broadcast(Bpe(path))

    def make():
        bpe = tables.value
        run = bpe.encoder()
        numbers = [str(i) for i in range(bpe.size)]
        digest = lambda data: hashlib.sha256(data).hexdigest()

        def kernel(texts: list) -> list:
            rows = [
                (len(ids), digest(",".join(map(numbers.__getitem__, ids)).encode()), digest(bpe.decode(ids).encode()))
                for ids in run(texts)
            ]
            return list(zip(*rows, strict=True))

        return kernel

    return annotate(docs, make, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", text, carry)
