"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of whole texts are taken in one pass. Shallow trees of a random
forest, fitted on a bounded sample of labelled texts, give conjunctive rules:
each path from a root. A logistic regression with a lasso penalty over the rules
keeps a few of them, and these are compiled into one Spark column expression.

The model is fitted on about ``sample`` labelled rows at most, chosen by a hash
of their key; scoring covers every row.

Defined results: a null text counts as an empty one, whose statistics are all
zero; labels other than 0 and 1 (null too) are not learned from; without both
labels, or if the sample is too small for any rule, the score is the share of
label 1, or 0.5 if there are none; equal texts get equal scores; an empty table
gives none.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmine.llm.batches import Kernel, annotate, quoted, spread
from reviewmine.sources.shared import materialize

SAMPLE = 20_000  # labelled rows to learn from
TREES, DEPTH, SEED = 30, 3, 7
LASSO = 0.002
PASSED = 0.7  # score from which a text is predicted to be good

STATISTICS = (
    "log_words", "mean_word", "upper", "digits", "symbols", "exclaimed", "piped", "other_marks", "spaces", "foreign",
    "symbol_words", "distinct_words", "same_as_last", "top_word", "repeated_lines", "words_per_line",
)
DIGITS = b"0123456789"
SYMBOLS = b"#*$%&<>@^_~=+\\/{}[]"
MARKS = b".,;:?'\"()-"
SPACES = b" \t\n\x0b\x0c\r"
LATER = bytes(range(0x80, 0xC0))  # bytes of a UTF-8 character after its first
HIGH = bytes(range(0xC0, 0x100))


def statistics(text: str | None) -> tuple[float, ...]:
    """The values of ``STATISTICS``; shares are of characters, words or lines."""
    text = text or ""
    data = text.encode()
    words = data.split()
    if not words:
        return (0.0,) * len(STATISTICS)
    n, size = len(words), len(data)
    count = lambda of: size - len(data.translate(None, of))
    chars = size - count(LATER)
    lower = text.lower()
    upper = sum(map(str.__ne__, text, lower)) if len(lower) == len(text) else sum(map(str.isupper, text))
    lines = [line for line in data.split(b"\n") if line and not line.isspace()]
    number = Counter(words)
    ends = Counter(word[-1:] for word in words)
    spaces = count(SPACES)
    return (
        math.log(n),
        (chars - spaces) / n,
        upper / chars,
        count(DIGITS) / chars,
        count(SYMBOLS) / chars,
        count(b"!") / chars,
        count(b"|") / chars,
        count(MARKS) / chars,
        spaces / chars,
        count(HIGH) / chars,
        sum(ends[bytes([b])] for b in SYMBOLS + b"!|") / n,
        len(number) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        max(number.values()) / n,
        1 - len(set(lines)) / len(lines),
        n / len(lines),
    )


def with_statistics(docs: DataFrame, text: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """``(row, out)`` with one double per statistic."""

    def make() -> Kernel:
        return lambda texts: list(zip(*map(statistics, texts), strict=True))

    return annotate(docs, make, ", ".join(f"{name} double" for name in STATISTICS), text, carry)


Rule = tuple[tuple[int, float, float], ...]  # (statistic, above, at most), one for each statistic of the conjunction

BRANCH = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>) (\S+)\)$")


def tree_rules(described: str) -> set[Rule]:
    """The rules in a tree's description: the conditions on the way to every node but the root."""
    rules, path = set(), []
    for line in described.splitlines():
        if branch := BRANCH.match(line):
            depth = len(branch[1])
            path = [step for step in path if step[0] < depth]
            path.append((depth, int(branch[3]), branch[4], float(branch[5])))
            bounds: dict[int, tuple[float, float]] = {}
            for _, feature, sign, value in path:
                low, high = bounds.get(feature, (-math.inf, math.inf))
                bounds[feature] = (low, min(high, value)) if sign == "<=" else (max(low, value), high)
            rules.add(tuple((f, low, high) for f, (low, high) in sorted(bounds.items())))
    return rules


def holds(rule: Rule, statistic: Sequence[Column]) -> Column:
    """The conjunction as a column."""
    found = F.lit(True)
    for feature, low, high in rule:
        if low > -math.inf:
            found = found & (statistic[feature] > low)
        if high < math.inf:
            found = found & (statistic[feature] <= high)
    return found


@dataclass(frozen=True)
class Ensemble:
    """Weighted rules; ``bias`` alone is the log odds of a text that no rule holds for."""

    bias: float
    weights: dict[Rule, float]

    def score(self, statistic: Sequence[Column]) -> Column:
        """Probability of label 1 as a column of the statistics."""
        total = F.lit(self.bias)
        for rule, weight in self.weights.items():
            total = total + F.when(holds(rule, statistic), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def train(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    key: str = "doc_id",
    text: str = "text",
    sample: int = SAMPLE,
) -> Ensemble:
    """Fit on documents that ``labels`` calls 0 or 1."""
    known = labels.select(quoted(key).alias("key"), quoted(label).cast("double").alias("label"))
    known = known.where(F.col("label").isin(0.0, 1.0) & F.col("key").isNotNull())
    texts = docs.select(quoted(key).alias("key"), quoted(text).alias("text"))
    both = known.join(texts.select("key"), "key", "left_semi")
    total = both.count()
    chosen = both.where(spread(F.col("key")) <= sample / max(total, 1))
    # bounded by the sample, so it may go to every task
    found = texts.join(F.broadcast(chosen), "key").select("key", "label", "text")
    rows = with_statistics(found, carry=["key", "label"]).select("row.key", "row.label", "out.*")
    rows = materialize(rows.repartition(1).sortWithinPartitions("key", *STATISTICS))  # one order in every run
    counts = dict(rows.groupBy("label").count().collect())
    if len(counts) < 2:
        return Ensemble(math.inf if 1.0 in counts else -math.inf if counts else 0.0, {})
    vectors = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(rows)
    forest = RandomForestClassifier(
        numTrees=TREES, maxDepth=DEPTH, maxBins=64, seed=SEED, featureSubsetStrategy="onethird", minInstancesPerNode=5
    ).fit(vectors.select("label", "features"))
    rules = sorted(set().union(*(tree_rules(tree.toDebugString) for tree in forest.trees)))
    if not rules:
        return Ensemble(math.log(counts[1.0] / counts[0.0]), {})
    statistic = [F.col(name) for name in STATISTICS]
    held = F.array(*(holds(rule, statistic).cast("double") for rule in rules))
    fitted = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=100, standardization=False).fit(
        rows.select("label", array_to_vector(held).alias("features"))
    )
    weights = dict(zip(rules, fitted.coefficients.toArray().tolist(), strict=True))
    return Ensemble(float(fitted.intercept), {rule: weight for rule, weight in weights.items() if weight})


def predict(docs: DataFrame, model: Ensemble, text: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """``(row, out, score)``: statistics, and the probability of label 1."""
    statistic = [F.col(f"out.{name}") for name in STATISTICS]
    return with_statistics(docs, text, carry).withColumn("score", model.score(statistic))
