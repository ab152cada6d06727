"""Text readers with explicit schemas: reviews, businesses, pairs and ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewmine.functions.ordering import ranked, running_total
from reviewmine.sources.shared import attach, materialize

REVIEW = T.StructType(
    [
        T.StructField("review_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("business_id", T.StringType()),
        T.StructField("stars", T.DoubleType()),
        T.StructField("useful", T.IntegerType()),
        T.StructField("text", T.StringType()),
    ]
)
BUSINESS = T.StructType(
    [
        T.StructField("business_id", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("stars", T.DoubleType()),
    ]
)
PAIR = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("business_id", T.StringType())])
RATING = T.StructType(PAIR.fields + [T.StructField("rating", T.DoubleType())])


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; unused fields are not parsed and a broken line fails the job."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, REVIEW)


def read_businesses(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, BUSINESS)


def _read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).csv(
        path,
        header=True,
        enforceSchema=True,
        quote="",
        ignoreLeadingWhiteSpace=True,
        ignoreTrailingWhiteSpace=True,
        mode="FAILFAST",
    )


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """``user_id,business_id`` with one header line."""
    return _read_csv(spark, path, PAIR)


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """``user,business,rating`` with one header line and blanks around the commas allowed.

    ``seq`` is the place of the line in the input: by file name, then by place in the file. Where a cell is
    rated twice the later line counts.
    """
    # an id grows within a split; splits are packed into tasks by size, so the file and its block come first
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
    return _read_csv(spark, path, RATING).withColumn("seq", place)


def read_pieces(spark: SparkSession, path: str, last: str) -> DataFrame:
    """``(number, piece)``: running text cut after each ``last``, numbered in the order of the files.

    The folder's files follow each other by name and their blocks by position,
    so a line may go on from one row, block or file to the next.
    """
    rows = spark.read.option("lineSep", last).text(path).select(
        F.col("value").alias("piece"),
        F.col("_metadata.file_name").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )
    return ranked(rows, "_file", "_block", "_row", name="number").select("number", "piece")


def read_itemset_report(spark: SparkSession, path: str) -> DataFrame:
    """``(section, size, position, itemset)`` of a report as ``writers.write_itemset_report`` writes it."""
    text = F.concat("piece", F.lit(")"))
    rows = read_pieces(spark, path, ")").where(F.col("piece").contains("(")).select(
        "number",
        F.regexp_extract("piece", r"(\w[^\n(]*:)\n\(", 1).alias("title"),
        F.regexp_extract(text, r"(?s)\(.*", 0).alias("itemset"),
    )
    titles = rows.where("title <> ''").select(F.col("title").alias("section"), F.col("number").alias("_from"))
    until = F.lead("_from").over(Window.orderBy("_from"))  # a row for each section
    sections = titles.withColumn("_until", until)
    inside = (F.col("number") >= F.col("_from")) & (F.col("_until").isNull() | (F.col("number") < F.col("_until")))
    size = (F.length(F.regexp_replace("itemset", "[^']", "")) / 2).cast("bigint").alias("size")
    rows = rows.join(F.broadcast(sections), inside).select("section", size, "number", "itemset")
    first = rows.groupBy("section", "size").agg(F.min("number").alias("_first"))
    rows = attach(rows, first, ["section", "size"])
    return rows.select("section", "size", (F.col("number") - F.col("_first")).alias("position"), "itemset")


def read_communities(spark: SparkSession, path: str) -> DataFrame:
    """``(line, position, node)`` of a file as ``writers.write_communities`` writes it, both counted from 0."""
    rows = materialize(read_pieces(spark, path, "'"))
    # a name stands between two quotes, and in front of it what separates it from the one before
    names = rows.where(F.col("number") % 2 == 1).select((F.col("number") - 1).alias("number"), F.col("piece").alias("node"))
    rows = rows.where(F.col("number") % 2 == 0).join(names, "number").withColumn("_new", F.col("piece").contains("\n").cast("bigint"))
    lines = materialize(running_total(rows, "_new", "number", name="line"))
    first = lines.groupBy("line").agg(F.min("number").alias("_first"))
    place = ((F.col("number") - F.col("_first")) / 2).cast("bigint").alias("position")
    return attach(lines, first, "line").select("line", place, "node")


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """The profile written by ``writers.write_profile_json``; ranked entries as ``id:n`` with commas between."""
    kinds = ", ".join(f"{n} bigint" for n in ("n_review_useful", "n_review_5_star", "n_characters", "n_user", "n_business"))
    rows = spark.read.schema(f"{kinds}, top20_user array<array<string>>, top20_business array<array<string>>").json(path)
    told = lambda n: F.array_join(F.transform(n, lambda pair: F.array_join(pair, ":")), ",")
    return rows.withColumns({n: told(n) for n in ("top20_user", "top20_business")})
