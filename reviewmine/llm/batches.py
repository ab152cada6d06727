"""Arrow kernels over whole texts, and a few column helpers of the operators.

``annotate`` is the one way in which rows pass through Python here: no shuffle,
one task per input split, bounded pieces of a batch at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

PIECE_BYTES = 4 << 20  # text handled at a time; a longer text is a piece of its own
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_UNSET = "67108864b"  # what Spark has for it by default

Kernel = Callable[[list], Sequence]


def quoted(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def pieces(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a piece holds about ``PIECE_BYTES`` of text, or one longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0)
        group = np.cumsum(size.to_numpy(zero_copy_only=False)) // PIECE_BYTES
        starts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for start, end in zip(starts, starts[1:], strict=False):
            yield batch.slice(start, end - start)


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of no more than a piece, as a task holds each batch several times.

    A session with a limit of its own keeps it.
    """
    if spark.conf.get(_BATCH) == _UNSET:
        spark.conf.set(_BATCH, str(PIECE_BYTES))


def annotate(
    docs: DataFrame,
    make: Callable[[], Kernel],
    fields: str,
    text: str = "text",
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """``(row, out)``: the carried columns as a struct, and what the kernel says about the text.

    ``make()`` is called once per task and returns the kernel, which gets a list
    of texts (null for a missing one) and returns one list per field of the DDL
    string ``fields``. All columns are carried by default. As they stay in a
    struct of their own, their names cannot clash with the fields.
    """
    small_batches(docs.sparkSession)
    names = docs.columns if carry is None else carry
    source = docs.select(quoted(text).cast("string").alias("text"), F.struct(*map(quoted, names)).alias("row"))
    out = T.StructType.fromDDL(fields)
    schema = T.StructType([T.StructField("row", source.schema["row"].dataType), T.StructField("out", out)])
    kinds = {field.name: to_arrow_type(field.dataType) for field in out}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        for batch in pieces(batches, "text"):
            values = kernel(batch.column("text").to_pylist())
            arrays = [pa.array(v, kind) for v, kind in zip(values, kinds.values(), strict=True)]
            result = pa.StructArray.from_arrays(arrays, names=list(kinds))
            yield pa.RecordBatch.from_arrays([batch.column("row"), result], names=["row", "out"])

    return source.mapInArrow(run, schema)


def remainder(key: str, divisor: int) -> Column:
    """crc32 of a key's text modulo ``divisor``; null for a null key."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(divisor))


def held_out(key: str, divisor: int) -> Column:
    """Whether the remainder is 2; rows without a key are held out too, as nothing may be learned from them."""
    return F.coalesce(remainder(key, divisor) == 2, F.lit(True))


def spread(key: Column) -> Column:
    """A fixed number from 0 to 1 for each key, to choose a share of the rows alike in every run."""
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(1 << 30)) / float(1 << 30)
