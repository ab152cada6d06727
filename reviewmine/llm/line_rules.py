"""Quality rules from line frequencies: lines that recur over many documents of a host go, depleted documents too.

One pass over the texts takes base statistics and the hash of every distinct
normalised line. Spark counts, per host and line, the distinct texts that have
the line: copies of one text count once, so a document is not held against
itself. Counting combines before its shuffle, so one line in a third of all
documents takes no single task. Only lines above the limits go back to their
documents.

Defined results: a null text has no words; rows without a host form a host of
their own; equal texts (repeated rows too) count once and get equal verdicts; an
empty table gives none.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Sequence

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmine.llm.batches import Kernel, annotate, quoted
from reviewmine.sources.shared import materialize

MIN_TEXTS = 10  # a line in fewer distinct texts of its host is never removed
SHARE = 0.005  # nor one in a smaller share of the host's distinct texts
TEXTS = 50  # unless it is in this many, so that the limit does not grow with the host
# limits of the pipeline
LONG_WORDS = 20  # words of a long line
LONG_TEXTS = 5  # distinct texts that are enough for a long line
LEFT = 0.3  # share of its words that a document must keep
MIN_WORDS = 10  # words that any document must have
BROADCAST_LINES = 1_000_000  # lines above the limits that may go to all tasks
REPEATED_WINDOW = 5  # words
REPEATS = 20  # per cent of words in repeated windows that a document may have

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
INSIDE = bytes(range(0x80, 0xC0))  # bytes of a UTF-8 character after its first
FIELDS = """n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint,
    text_hash bigint, lines array<struct<hash:bigint,words:bigint>>"""


def hash64(data: bytes) -> int:
    value = xxhash.xxh64_intdigest(data)
    return value - (1 << 64) if value >> 63 else value


def repeated_words(words: list[bytes], width: int = REPEATED_WINDOW) -> int:
    """Words inside windows of ``width`` words that occur more than once in the text."""
    grams = list(zip(*(words[i:] for i in range(width)), strict=False))
    count = Counter(grams)
    if len(count) == len(grams):
        return 0
    total, end = 0, 0
    for i, gram in enumerate(grams):
        if count[gram] > 1:
            total += i + width - max(i, end)
            end = i + width
    return total


def line_key(words: list[bytes]) -> int:
    """Lines are the same if their words are, lower-cased in A-Z."""
    return hash64(b" ".join(words).lower())


def examine(text: str | None) -> tuple:
    """The values of ``FIELDS`` for a text."""
    data = (text or "").encode()
    words, seen, repeated, lines = [], set(), 0, {}
    for line in data.split(b"\n"):
        own = line.split()
        if not own:
            continue
        words += own
        repeated += line in seen
        seen.add(line)
        key = line_key(own)
        lines[key] = lines.get(key, 0) + len(own)
    return (
        len(words),
        len(data.translate(None, SPACES + INSIDE)),
        len(data) - len(data.translate(None, SYMBOLS)),
        repeated,
        repeated_words(words),
        hash64(data),
        [{"hash": key, "words": n} for key, n in lines.items()],
    )


def passes(words: int, repeated: int) -> bool:
    """The base rules."""
    return words >= MIN_WORDS and 100 * repeated <= REPEATS * words


def _kernel() -> Kernel:
    return lambda texts: list(zip(*map(examine, texts), strict=True))


def frequent_lines(
    lines: DataFrame,
    min_texts: int = MIN_TEXTS,
    share: float = SHARE,
    enough: int | None = TEXTS,
    long_texts: int | None = None,
) -> DataFrame:
    """``(host, hash)`` of the lines above the limits, from rows ``(host, text_hash, lines)``.

    A line needs ``min_texts`` texts and the share of its host's; ``enough``
    texts do in place of the share, and ``long_texts`` in place of both if the
    line has ``LONG_WORDS`` words in every text (repeats in a text add up).
    """
    texts = lines.select("host", "text_hash").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("texts"))
    own = F.explode("lines").alias("line")
    single = lines.select("host", "text_hash", own).select("host", "text_hash", "line.hash", "line.words").distinct()
    counts = single.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n"), F.min("words").alias("words"))
    often = F.col("n") >= share * F.col("texts")
    if enough is not None:
        often |= F.col("n") >= enough
    often &= F.col("n") >= min_texts
    least = min_texts
    if long_texts is not None:
        often |= (F.col("words") >= LONG_WORDS) & (F.col("n") >= long_texts)
        least = min(min_texts, long_texts)
    return counts.where(F.col("n") >= least).join(texts, "host").where(often).select("host", "hash")


def judge(
    docs: DataFrame,
    host: str = "source",
    text: str = "text",
    carry: Sequence[str] | None = None,
    min_texts: int = MIN_TEXTS,
    share: float = SHARE,
    left: float = LEFT,
    enough: int | None = TEXTS,
    long_texts: int | None = None,
) -> DataFrame:
    """``(row, place, host, out, removed, cut, base_failed, kept)`` for every row.

    ``out`` has the base statistics, ``removed`` the hashes of the lines to
    take out, ``cut`` the words in them. The rows are written once, so that
    counting and judging read the same.
    """
    key = F.coalesce(quoted(host).cast("string"), F.lit(""))
    names = docs.columns if carry is None else carry
    source = docs.select(key.alias("host"), quoted(text).alias("text"), F.struct(*map(quoted, names)).alias("row"))
    rows = annotate(source, _kernel, FIELDS, carry=["host", "row"])
    place = F.monotonically_increasing_id().alias("place")
    rows = materialize(rows.select(F.col("row.host").alias("host"), F.col("row.row").alias("row"), "out", place))
    lines = rows.select("place", "host", F.col("out.text_hash").alias("text_hash"), F.col("out.lines").alias("lines"))
    often = materialize(frequent_lines(lines, min_texts, share, enough, long_texts))
    found = lines.select("place", "host", F.inline("lines")).join(often, ["host", "hash"])
    found = found.groupBy("place").agg(F.sum("words").alias("cut"), F.collect_list("hash").alias("removed"))
    rows = rows.join(materialize(found), "place", "left")
    words = F.col("out.n_words")
    failed = (words < MIN_WORDS) | (100 * F.col("out.n_repeat_words") > REPEATS * words)
    cut = F.coalesce("cut", F.lit(0))
    return rows.select(
        "row", "place", "host", "out", "removed", cut.alias("cut"), failed.alias("base_failed"),
        (~failed & (words - cut >= left * words)).alias("kept"),
    )


def without_lines(lines: list[str], removed: set[int]) -> str:
    """The text of the lines that are not removed; lines without words stay."""
    return "\n".join(x for x in lines if not (own := x.encode().split()) or line_key(own) not in removed)


def clean(
    docs: DataFrame,
    host: str = "source",
    text: str = "text",
    min_texts: int = MIN_TEXTS,
    share: float = SHARE,
    left: float = LEFT,
    most: int = BROADCAST_LINES,
    enough: int | None = TEXTS,
    long_texts: int | None = None,
) -> DataFrame:
    """The kept rows with their own columns, in which texts have lost the lines above the limits.

    Up to ``most`` such lines go to all tasks, and a second pass over the texts
    judges and cuts them where they are. More lines than that go to their
    documents by the joins of ``judge``.
    """
    key = F.coalesce(quoted(host).cast("string"), F.lit(""))
    named = docs.select(key.alias("host"), quoted(text).alias("text"))
    found = annotate(named, _kernel, FIELDS, carry=["host"])
    lines = materialize(found.select("row.host", "out.text_hash", "out.lines"))
    often = materialize(frequent_lines(lines, min_texts, share, enough, long_texts))
    if often.count() > most:
        limits = {"min_texts": min_texts, "share": share, "left": left, "enough": enough, "long_texts": long_texts}
        return _clean_by_joins(docs, host, text, **limits)
    table: dict[str, set[int]] = {}
    for name, line in often.toLocalIterator():
        table.setdefault(name, set()).add(line)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def make() -> Kernel:
        def kernel(packed: list) -> list:
            return list(zip(*(_judged(p, shared.value) for p in packed), strict=True))

        def _judged(packed: str, table: dict[str, set[int]]) -> tuple[bool, str | None]:
            name, _, own = packed.partition("\n")
            removed = table.get(json.loads(name)[0], set())
            words, *_, repeated, _, lines = examine(own)
            cut = sum(line["words"] for line in lines if line["hash"] in removed)
            kept = passes(words, repeated) and words - cut >= left * words
            return kept, (without_lines(own.split("\n"), removed) if cut else own) if kept else None

        return kernel

    # one column for the kernel: the host's name in a JSON array, which has no line break, and the text below it
    packed = F.concat(F.to_json(F.array(key)), F.lit("\n"), F.coalesce(quoted(text), F.lit("")))
    source = docs.select(packed.alias("packed"), F.struct(*map(quoted, docs.columns)).alias("row"))
    rows = annotate(source, make, "kept boolean, text string", "packed", carry=["row"]).where("out.kept")
    return rows.select(*((F.col("out.text") if n == text else F.col("row.row")[n]).alias(n) for n in docs.columns))


def _clean_by_joins(docs: DataFrame, host: str, text: str, **limits: float | None) -> DataFrame:
    def make() -> Kernel:
        return lambda packed: [[without_lines(p["text"].split("\n"), set(p["removed"])) for p in map(json.loads, packed)]]

    rows = judge(docs, host, text, **limits).where("kept")
    packed = F.to_json(F.struct(F.col("row")[text].alias("text"), F.coalesce("removed", F.array()).alias("removed")))
    cleaned = annotate(rows.select("row", packed.alias("packed")), make, "text string", "packed", carry=["row"])
    return cleaned.select(*((F.col("out.text") if n == text else F.col("row.row")[n]).alias(n) for n in docs.columns))
