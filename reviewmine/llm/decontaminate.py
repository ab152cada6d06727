"""Benchmark decontamination: windows of benchmark words, looked up in every window of the training texts.

The windows of the benchmark's items go to the tasks as a hash set. The set is
broadcast in slices of at most two times ``SLICE`` windows, one scan of the
documents per slice, so its size is bounded whatever the benchmark's: repeated
items are left out, long ones cut into pieces that share no window, and slices
are filled by a running total of words. A window hash that is met is verified
word by word.

Defined results: words are runs of digits, letters and non-ASCII characters,
lower-cased in A-Z; a null or wordless text has no words and is clean; a null
or wordless item has no window; an item of fewer words than a window is a window
of its own; repeated items and rows count as often as they are there, an item_id
once per document; items without an id mark words but are not named; an empty
benchmark leaves all documents clean.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmine.functions.ordering import running_total
from reviewmine.llm.batches import Kernel, annotate, quoted
from reviewmine.sources.shared import materialize

WINDOW = 10
SLICE = 200_000  # words of benchmark items from which a broadcast is full
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that all words of a window count
KEPT = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"  # the same, before lower-casing
WORD_BYTES = bytes(b if b in KEPT else 0x20 for b in bytes(range(256)).lower())


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


def window_hashes(columns: Sequence[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each window; column i has the id of every window's word i."""
    total = np.zeros(len(columns[0]), np.uint64)
    for column in columns:
        total = total * BASE + column.astype(np.uint64)
    return total ^ (total >> np.uint64(29))


class Windows:
    """The distinct windows of some items, by width, with the items that have them."""

    def __init__(self, items: Sequence[tuple], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set] = {}
        for item_id, text in items:
            numbers = tuple(self.ids.setdefault(word, len(self.ids) + 1) for word in words(text))
            width = min(window, len(numbers))
            if width:
                for i in range(len(numbers) - width + 1):
                    found.setdefault(numbers[i : i + width], set()).add(item_id)
        self.tables = []
        for width in sorted({len(window) for window in found}):
            grams = [gram for gram in found if len(gram) == width]
            numbers = np.array(grams)
            hashes = window_hashes(numbers.T)
            order = np.argsort(hashes, kind="stable")
            items_of = [found[grams[i]] for i in order.tolist()]
            self.tables.append((width, hashes[order], numbers[order], items_of))

    def hits(self, text: str | None) -> tuple[int, np.ndarray, set]:
        """``(words, hit words as a mask, items)`` of a text."""
        own = words(text)
        known = self.ids.get
        ids = np.fromiter((known(word, 0) for word in own), np.int64, len(own))
        mask, items = np.zeros(len(own), bool), set()
        for width, hashes, grams, items_of in self.tables:
            if len(own) < width:
                continue
            # a window of benchmark words only: no word outside of the vocabulary before its end
            last_unknown = np.maximum.accumulate(np.where(ids == 0, np.arange(len(ids)), -1))
            starts = np.flatnonzero(np.arange(len(ids) - width + 1) > last_unknown[width - 1 :])
            if not len(starts):
                continue
            key = window_hashes([ids[starts + i] for i in range(width)])
            low, high = np.searchsorted(hashes, key, "left"), np.searchsorted(hashes, key, "right")
            for i in np.flatnonzero(high > low).tolist():
                start = int(starts[i])
                for at in range(low[i], high[i]):
                    if (grams[at] == ids[start : start + width]).all():
                        mask[start : start + width] = True
                        items |= items_of[at]
        return len(own), mask, items


def slices(benchmark: DataFrame, size: int, window: int = WINDOW) -> list[DataFrame]:
    """``(item, text)`` in groups of at most ``2 * size`` words and a window, each small enough to be broadcast."""
    own = benchmark.distinct().select("item", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)), F.lit(size))
    cut = own.where(F.size("words") > 0).select("item", "words", F.explode(starts).alias("start"))
    part = F.slice("words", F.col("start") + 1, F.lit(size + window - 1))
    cut = cut.select("item", "start", F.array_join(part, " ").alias("text"), F.size(part).alias("n"))
    placed = materialize(running_total(cut, "n", "item", "start", "text", name="total"))
    slot = F.floor((F.col("total") - F.col("n")) / size)
    last = placed.agg(F.max(slot)).first()[0]
    return [placed.where(slot == i).select("item", "text") for i in range((last or 0) + 1)]


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    carry: Sequence[str] | None = None,
    size: int = SLICE,
) -> DataFrame:
    """``(row, out)``: ``n_words``, hit words as ``[first, end)`` pairs in ``spans``, and the ``items`` with hits.

    Spans of different slices may overlap; ``n_hit`` counts a word once.
    """
    items = benchmark.select(quoted(item).alias("item"), quoted(item_text).alias("text"))
    kind = items.schema["item"].dataType.simpleString()
    fields = f"n_words bigint, spans array<struct<first:bigint,end:bigint>>, items array<{kind}>"
    names = docs.columns if carry is None else carry
    found = docs.select(quoted(text).alias("text"), F.struct(*map(quoted, names)).alias("row"))
    groups = slices(items, size, window)
    for i, group in enumerate(groups):
        rows = [tuple(row) for row in group.toLocalIterator()]
        tables = docs.sparkSession.sparkContext.broadcast(Windows(rows, window))
        last = i == len(groups) - 1
        done = annotate(found, _kernel(tables), fields, "text", [n for n in found.columns if n != "text" or not last])
        out = F.col("out")
        if i:
            merged = {n: F.array_distinct(F.concat(f"row.out.{n}", f"out.{n}")) for n in ("spans", "items")}
            out = F.struct("out.n_words", *(column.alias(n) for n, column in merged.items()))
        found = done.select(F.col("row.row").alias("row"), out.alias("out"), *([] if last else ["row.text"]))
        found = found if last else materialize(found)
    return found


def _kernel(tables: Broadcast) -> Callable[[], Kernel]:
    def make() -> Kernel:
        def kernel(texts: list) -> list:
            counts, spans, items = [], [], []
            for text in texts:
                n, mask, hit = tables.value.hits(text)
                edges = np.flatnonzero(np.diff(mask, prepend=False, append=False)).tolist()
                counts.append(n)
                spans.append([{"first": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)])
                items.append(sorted(i for i in hit if i is not None))
            return [counts, spans, items]

        return kernel

    return make


def n_hit() -> Column:
    """How many words of a text are inside some hit."""
    places = F.transform("out.spans", lambda s: F.sequence(s["first"], s["end"] - 1))
    return F.size(F.array_distinct(F.flatten(places))).cast("bigint")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", **names: str) -> DataFrame:
    """The rows without any benchmark window, with their own columns."""
    return scan(docs, benchmark, text, **names).where(F.size("out.spans") == 0).select("row.*")
