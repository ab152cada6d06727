"""A table with every awkward case: nulls, empty and long texts, repeated rows and keys, clashing column names."""

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id bigint, text string, lang string, source string, row string, out string, place bigint, host string, `key` int, `a.b` string, score double"
LONG = "lorem ipsum dolor sit amet " * 20_000

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from it.", "en", "a"),
    (1, "The quick brown fox jumps over the lazy dog and runs away from it.", "en", "a"),
    (2, None, "en", "a"),
    (3, "", "de", None),
    (4, "   \n\t ", None, "b"),
    (5, "12345 !!! ###", "en", "b"),
    (None, "A text without a key, but long enough to be counted by all of them.", "en", "a"),
    (6, LONG, "en", None),
    (7, "x" * 50_000, None, None),
    (8, "Größe und Maß der schönen Straße über dem Fluß sind für alle gut zu sehen.", "de", "b"),
    (9, "日本語 テキスト 😀 ﷽ <|endoftext|> \u0000 end", "en", "b"),
    (9, "Another text under a key that is there already, of quite different words.", "en", None),
]


def messy(spark: SparkSession, empty: bool = False) -> DataFrame:
    rows = [(*t, "row", "out", 3, "host", 4, "dot", 0.5) for t in TEXTS]
    return spark.createDataFrame([] if empty else rows, SCHEMA).coalesce(2)
