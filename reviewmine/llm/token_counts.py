"""Token counts of a unigram tokenizer, without the tokens: a count-only Viterbi search.

An Aho-Corasick automaton lists the vocabulary's pieces inside a word in one
pass; dynamic programming carries the best score and the number of pieces that
reach each place. Ties are broken as the ``tokenizers`` library does: pieces are
tried by where they start, and only a higher score replaces an earlier one, so
the longest last piece wins. A character without a piece of its own may be
unknown, at the lowest score less ten; unknown characters count by their bytes
if the vocabulary has byte pieces, and else as one token for each run.

Words start at spaces, as with the library's Metaspace splitting. A task counts
a word once.

Defined results: a null text is an empty one, of no tokens; equal texts have
equal counts; an empty table gives none.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Sequence

import ahocorasick
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame

from reviewmine.llm.batches import Kernel, annotate

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
KNOWN_WORDS = 300_000  # words a task remembers; beyond, it starts anew
SPACE = "▁"
NOTHING = float("-inf")
PENALTY = 10.0  # fixed value: how much less than the lowest score an unknown character has


def vocabulary(path: str = VOCABULARY) -> tuple[list[tuple[str, float]], int]:
    """Pieces with their scores, and the number of the unknown piece."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())], model.unk_id()


class TokenCounter:
    def __init__(self, pieces: Sequence[tuple[str, float]], unknown: int, byte_pieces: bool = True):
        self.automaton = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(pieces):
            if piece:
                # a vocabulary's later piece of the same text is the one that counts
                self.automaton.add_word(piece, (len(piece), score, i == unknown))
        self.automaton.make_automaton()
        self.unknown_score = min(score for _, score in pieces) - PENALTY
        self.byte_pieces = byte_pieces and {f"<0x{b:02X}>" for b in range(256)} <= {piece for piece, _ in pieces}

    def search(self, word: str) -> tuple[int, float]:
        """Number of tokens and score of the best way to cut a word."""
        n = len(word)
        score, count, in_unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        found: list[list[tuple[int, float, bool]]] = [[] for _ in range(n)]
        for last, piece in self.automaton.iter(word):
            found[last].append(piece)
        for last, pieces in enumerate(found):
            # the automaton lists the pieces that end here from long to short, so by where they start
            best, origin, unknown, length = NOTHING, last, False, 0
            for length, own, is_unknown in pieces:
                total = own + score[last + 1 - length]
                if total > best:
                    best, origin, unknown = total, last + 1 - length, is_unknown
            # the shortest piece comes last; without one of a single character, the character may be unknown
            if length != 1 and self.unknown_score + score[last] > best:
                best, origin, unknown = self.unknown_score + score[last], last, True
            if not unknown:
                count[last + 1] = count[origin] + 1
            else:
                if self.byte_pieces:
                    tokens = len(word[origin : last + 1].encode())
                else:
                    tokens = 0 if in_unknown[origin] else 1
                count[last + 1], in_unknown[last + 1] = count[origin] + tokens, True
            score[last + 1] = best
        return count[n], score[n]


def words_of(text: str | None) -> Iterable[str]:
    """Words with the mark of the space before them; a text gets one at its start."""
    if not text:
        return []
    marked = text.replace(" ", SPACE)
    return [SPACE + part for part in marked.removeprefix(SPACE).split(SPACE)]


def count_tokens(
    docs: DataFrame, text: str = "text", path: str = VOCABULARY, carry: Sequence[str] | None = None
) -> DataFrame:
    """``(row, out)`` with ``out.n_tokens`` and ``out.best_score``, the summed scores of the tokens."""
    pieces, unknown = vocabulary(path)
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def make() -> Kernel:
        counter = TokenCounter(shared.value, unknown)
        known: dict[str, tuple[int, float]] = {}

        def kernel(texts: list) -> list:
            if len(known) > KNOWN_WORDS:
                known.clear()
            counts, scores = [], []
            for text in texts:
                tokens, total = 0, 0.0
                for word, n in Counter(words_of(text)).items():
                    if word not in known:
                        known[word] = counter.search(word)
                    one, score = known[word]
                    tokens += n * one
                    total += n * score
                counts.append(tokens)
                scores.append(total)
            return [counts, scores]

        return kernel

    return annotate(docs, make, "n_tokens bigint, best_score double", text, carry)
