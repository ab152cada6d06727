import pyarrow as pa
from pyspark.sql import functions as F

from reviewmine.llm import batches


def test_rows_go_to_python_in_pieces(spark):
    """Batches are small in bytes, not only in rows; a session's own limit stays."""
    spark.conf.unset(batches._BATCH)
    docs = spark.range(4000, numPartitions=1).select(F.repeat(F.lit("word "), 2000).alias("text"))
    lengths = batches.annotate(docs, lambda: lambda texts: [[len(texts)] * len(texts)], "n int")
    assert lengths.agg(F.sum("out.n") > 0).first()[0]

    def size(rows):
        return (pa.RecordBatch.from_pydict({"n": [batch.nbytes]}) for batch in rows)

    sizes = docs.mapInArrow(size, "n bigint")
    assert max(r.n for r in sizes.collect()) < 3 * batches.PIECE_BYTES
    spark.conf.set(batches._BATCH, "1m")
    batches.small_batches(spark)
    assert spark.conf.get(batches._BATCH) == "1m"
    spark.conf.unset(batches._BATCH)
