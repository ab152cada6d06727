"""Language identification by unigram pieces, marginalised over all segmentations of a word.

Every language has its own probabilities of the pieces of one public vocabulary.
A word's probability in a language is the sum over all ways to cut it into
pieces (forward algorithm); the probabilities are learned by expectation
maximisation on the words of labelled texts. A text is scored by all its words;
a task scores a word once, for all languages, many words at a time.

The model is fitted on about ``per_language`` texts of each language at most,
chosen by a hash of their key; scoring covers every row. ``reject`` compares the
mean log probability of a text's letters in its language with a limit of that
language, so that a language that was not learned is not taken for the nearest
one. About ``JUDGED`` labelled texts of each language, which the pieces were not
learned from, set the limits: they are halfway from texts of the language to
those of the other language that fit it best.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
so are all texts if nothing was learned; of equally likely languages the first
by name is taken; equal texts get equal results; an empty table gives none.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmine.llm.batches import Kernel, annotate, quoted, spread
from reviewmine.sources.shared import materialize

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
PER_LANGUAGE = 3000  # texts of a language to learn from
ROUNDS = 4  # of expectation maximisation
WORD = 32  # letters; a longer run is cut into words of this length
UNKNOWN = 1e-7  # probability of a letter that is no piece
SMOOTHING = 0.02  # added to the expected count of every piece
WORDS = 4000  # looked up at a time
KNOWN_WORDS = 300_000  # words whose scores a task remembers; beyond, it starts anew
SURE = 0.5  # of the score a text needs to be kept by ``reject``
JUDGED = 1000  # texts of a language that set its limit for ``reject``, a quarter of its texts at most
SLACK = 10.0  # natural logarithm by which a letter may fall short of the limit, over the square root of a text's letters
LOWEST = 0.01  # of the texts that set a language's limit may be below it
NONE = "und"
START = "▁"
RUNS = re.compile(r"[^\W\d_]+")
BASE = np.uint64(0x9E3779B97F4A7C15)


def pieces_of(path: str = VOCABULARY) -> list[str]:
    """Lower-case letter pieces of a public vocabulary, with or without the mark of a word's start."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i) for i in range(model.get_piece_size())}
    letters = (p for p in found if p == p.lower() and p.removeprefix(START).isalpha())
    return sorted(letters)


def words_of(text: str | None) -> Counter:
    """Words of a text with their numbers: runs of letters, lower-cased, with the mark of the start."""
    total: Counter = Counter()
    for run, n in Counter(RUNS.findall((text or "").lower())).items():
        if not run.isalpha():  # numerals such as superscripts count as word characters, but are no letters
            run = "".join(c for c in run if c.isalpha())
        if not run:
            continue
        marked = START + run
        for at in range(0, len(marked), WORD):
            total[marked[at : at + WORD]] += n
    return total


def _hashes(codes: np.ndarray, length: int) -> np.ndarray:
    """A hash of every run of ``length`` characters in each row."""
    n = codes.shape[1] - length + 1
    total = np.zeros((codes.shape[0], n), np.uint64)
    for i in range(length):
        total = total * BASE + codes[:, i : i + n]
    return total ^ (total >> np.uint64(31))


def _codes(words: Sequence[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.uint64)


class Pieces:
    """Finds the pieces inside words: all words of one length at a time."""

    def __init__(self, pieces: Sequence[str]):
        self.size = len(pieces)
        self.tables = {}
        for length in sorted({len(p) for p in pieces}):
            numbers = np.array([i for i, p in enumerate(pieces) if len(p) == length])
            hashes = _hashes(_codes([pieces[i] for i in numbers]), length)[:, 0]
            order = np.argsort(hashes)
            self.tables[length] = hashes[order], numbers[order]

    def inside(self, words: Sequence[str]) -> dict[int, np.ndarray]:
        """By piece length: which piece starts where in each word (``size``: none, ``size + 1``: an unknown letter)."""
        codes, found = _codes(words), {}
        for length, (hashes, numbers) in self.tables.items():
            if length > codes.shape[1]:
                break
            key = _hashes(codes, length)
            at = np.minimum(np.searchsorted(hashes, key), len(hashes) - 1)
            found[length] = np.where(hashes[at] == key, numbers[at], self.size)
        none = found.get(1, np.full(codes.shape, self.size))
        found[1] = np.where(none == self.size, self.size + 1, none)
        return found


@dataclass
class Model:
    """Learned languages, their share of the texts, and a row of probabilities for each piece."""

    languages: list[str]
    prior: np.ndarray
    pieces: list[str]
    probability: np.ndarray  # pieces x languages
    limits: dict[str, float] = field(default_factory=dict)  # mean log probability of a letter that texts of a language reach

    def rows(self) -> np.ndarray:
        """The probabilities with a row for no piece and one for an unknown letter."""
        n = len(self.languages)
        return np.vstack([self.probability, np.zeros((1, n)), np.full((1, n), UNKNOWN)])


def _forward(found: dict[int, np.ndarray], rows: np.ndarray) -> list[np.ndarray]:
    """Probability of each prefix, summed over its segmentations: by length, words x languages."""
    count, length = found[1].shape
    ahead = [np.ones((count, rows.shape[1]))]
    for end in range(1, length + 1):
        ahead.append(sum(ahead[end - n] * rows[f[:, end - n]] for n, f in found.items() if n <= end))
    return ahead


def _backward(found: dict[int, np.ndarray], rows: np.ndarray) -> list[np.ndarray]:
    """The same for each suffix, by where it starts."""
    count, length = found[1].shape
    behind = [np.ones((count, rows.shape[1]))]
    for start in range(length - 1, -1, -1):
        behind.append(sum(behind[length - start - n] * rows[f[:, start]] for n, f in found.items() if start + n <= length))
    return behind[::-1]


def _by_length(words: Sequence[str]) -> list[np.ndarray]:
    lengths = np.array([len(w) for w in words])
    return [np.flatnonzero(lengths == n) for n in np.unique(lengths)]


def word_scores(words: Sequence[str], finder: Pieces, rows: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language."""
    scores = np.empty((len(words), rows.shape[1]))
    for at in _by_length(words):
        for part in np.array_split(at, len(at) // WORDS + 1):
            scores[part] = np.log(_forward(finder.inside([words[i] for i in part]), rows)[-1])
    return scores


def expected_counts(words: Sequence[str], counts: np.ndarray, finder: Pieces, rows: np.ndarray) -> np.ndarray:
    """How often each piece is expected in the words (words x languages counts), by forward and backward sums."""
    total = np.zeros((finder.size + 2, rows.shape[1]))
    for at in _by_length(words):
        for part in np.array_split(at, len(at) // WORDS + 1):
            found = finder.inside([words[i] for i in part])
            ahead, behind = _forward(found, rows), _backward(found, rows)
            weight = counts[part] / ahead[-1]
            for n, f in found.items():
                for start in range(f.shape[1]):
                    use = ahead[start] * rows[f[:, start]] * behind[start + n] * weight
                    for language in range(rows.shape[1]):
                        column = np.bincount(f[:, start], use[:, language], minlength=finder.size + 2)
                        total[:, language] += column
    return total[: finder.size]


def train(
    docs: DataFrame,
    language: str = "lang",
    text: str = "text",
    key: str = "doc_id",
    per_language: int = PER_LANGUAGE,
    rounds: int = ROUNDS,
    path: str = VOCABULARY,
) -> Model:
    """Learn from the rows that have a language; the driver gets languages x pieces numbers a round."""
    pieces = pieces_of(path)
    labelled = docs.select(quoted(key).alias("key"), quoted(language).cast("string").alias("lang"), quoted(text).alias("text"))
    labelled = labelled.where(F.col("lang").isNotNull())
    sizes = dict(labelled.groupBy("lang").count().collect())
    languages = sorted(sizes)
    prior = np.array([sizes[x] for x in languages], float)
    if not languages:
        return Model([], prior, pieces, np.empty((len(pieces), 0)))
    share = F.create_map(*(F.lit(x) for pair in sizes.items() for x in (pair[0], per_language / pair[1])))
    part = F.least(F.lit(0.25), share[F.col("lang")] * (JUDGED / per_language))
    judging = F.coalesce(spread(F.concat(F.lit("limit "), F.col("key").cast("string"))) <= part, F.lit(False))
    sampled = materialize(
        labelled.withColumn("judging", judging).where(F.col("judging") | (spread(F.col("key")) <= share[F.col("lang")]))
    )
    chosen = sampled.where("not judging")

    def count() -> Kernel:
        return lambda texts: [[list(words_of(t).items()) for t in texts]]

    counted = annotate(chosen, count, "words array<struct<word:string,n:bigint>>", carry=["lang"])
    single = counted.select(F.col("row.lang").alias("lang"), F.inline("out.words"))
    per = [F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).cast("double") for x in languages]
    words = materialize(single.groupBy("word").agg(F.array(*per).alias("counts")))
    finder = Pieces(pieces)
    probability = np.full((len(pieces), len(languages)), 1 / len(pieces))
    for _ in range(rounds):
        rows = Model(languages, prior, pieces, probability).rows()

        def expect(batches, rows=rows):
            for frame in batches:
                counts = np.stack(frame["counts"].to_numpy()) if len(frame) else np.empty((0, rows.shape[1]))
                total = expected_counts(frame["word"].tolist(), counts, finder, rows)
                piece, at = np.nonzero(total)
                yield pd.DataFrame({"piece": piece, "at": at, "n": total[piece, at]})

        summed = words.mapInPandas(expect, "piece bigint, at bigint, n double").groupBy("piece", "at").agg(F.sum("n"))
        total = np.full(probability.shape, SMOOTHING)
        for piece, at, n in summed.collect():
            total[piece, at] += n
        probability = total / total.sum(axis=0)
    model = Model(languages, prior / prior.sum(), pieces, probability)
    model.limits = _limits(sampled.where("judging"), model)
    return model


def _limits(judging: DataFrame, model: Model) -> dict[str, float]:
    """The limit of each language that has texts: halfway to the next one, and not above nearly all of its own.

    Where texts of no other language are known, only the latter counts.
    """
    judged = predict(judging, model, carry=["lang"]).where("out.letters > 0").select("row.lang", "out.*")
    means = [F.avg(F.col("fits")[i]) for i in range(len(model.languages))]
    # the allowance of short texts
    own = F.when(F.col("lang") == F.col("lang_pred"), F.col("fit") + SLACK / F.sqrt("letters"))
    found = {x: (low, means) for x, low, means in judged.groupBy("lang").agg(F.percentile_approx(own, LOWEST), F.array(*means)).collect()}
    limits = {}
    for i, language in enumerate(model.languages):
        if language in found and found[language][0] is not None:
            low, fits = found[language]
            others = [other[i] for name, (_, other) in found.items() if name != language]
            limits[language] = min(low, (fits[i] + max(others)) / 2) if others else low
    return limits


def predict(docs: DataFrame, model: Model, text: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """``(row, out)`` with ``out.lang_pred``, ``out.score``, the probability of that language given the text, and ``out.fit``.

    The fit is the mean log probability of a letter in that language; ``out.fits`` has those in all languages.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Kernel:
        model = shared.value
        finder, rows, prior = Pieces(model.pieces), model.rows(), np.log(model.prior)
        place: dict[str, int] = {}
        known = np.empty((0, len(model.languages)))

        def kernel(texts: list) -> list:
            nonlocal known
            if len(place) > KNOWN_WORDS:
                place.clear()
                known = known[:0]
            counts = [words_of(t) if model.languages else {} for t in texts]
            new = list(set().union(*counts).difference(place))
            if new:
                place.update(zip(new, range(len(place), len(place) + len(new)), strict=True))
                known = np.concatenate([known, word_scores(new, finder, rows)])
            found = []
            for count in counts:
                if not count:
                    found.append((NONE, 0.0, None, None, 0))
                    continue
                at = np.fromiter(map(place.__getitem__, count), np.int64, len(count))
                words = np.fromiter(count.values(), float, len(count)) @ known[at]
                total = prior + words
                best = int(total.argmax())
                letters = sum((len(word) - word.startswith(START)) * n for word, n in count.items())
                score = float(1 / np.exp(total - total[best]).sum())
                fits = words / letters
                found.append((model.languages[best], score, float(fits[best]), fits, letters))
            return list(zip(*found, strict=True))

        return kernel

    return annotate(docs, make, "lang_pred string, score double, fit double, fits array<double>, letters bigint", text, carry)


def reject(docs: DataFrame, model: Model, text: str = "text", sure: float = SURE, slack: float = SLACK) -> DataFrame:
    """The rows in one learned language that is likelier than all others together, with their own columns.

    Texts whose letters are less likely than the limit of the language are in none; short ones, whose means vary, may
    fall short of it by ``slack`` over the square root of their letters. A language that no text set a limit for has none.
    """
    limit = F.lit(float("-inf"))
    for language, own in model.limits.items():
        limit = F.when(F.col("out.lang_pred") == language, own).otherwise(limit)
    fits = (F.col("out.lang_pred") != NONE) & (F.col("out.fit") >= limit - slack / F.sqrt(F.greatest("out.letters", F.lit(1))))
    return predict(docs, model, text).where((F.col("out.score") >= sure) & fits).select("row.*")
