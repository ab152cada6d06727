"""Review statistics, rankings and averages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmine.functions.columns import has_text, is_five_star, is_useful, rating_bucket
from reviewmine.sources.shared import materialize


def distinct_count(df: DataFrame, column: str, name: str) -> DataFrame:
    """Distinct values, and the sum of ones over them as a cross-check."""
    values = df.select(column).distinct()
    return values.agg(F.count(F.lit(1)).alias(name), F.coalesce(F.sum(F.lit(1)), F.lit(0)).alias(f"{name}_check"))


def useful_reviews(reviews: DataFrame) -> DataFrame:
    return distinct_count(reviews.where(is_useful(F.col("useful"))), "review_id", "n_review_useful")


def five_star_reviews(reviews: DataFrame) -> DataFrame:
    return distinct_count(reviews.where(is_five_star(F.col("stars"))), "review_id", "n_review_5_star")


def longest_text(reviews: DataFrame) -> DataFrame:
    return reviews.agg(F.max(F.length("text")).cast("bigint").alias("n_characters"))


def users_with_text(reviews: DataFrame) -> DataFrame:
    return reviews.where(has_text(F.col("text"))).agg(F.count_distinct("user_id").alias("n_user"))


def distinct_business(reviews: DataFrame) -> DataFrame:
    return reviews.agg(F.count_distinct("business_id").alias("n_business"))


def count_per_key(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def top_keys(reviews: DataFrame, key: str, n: int = 20) -> DataFrame:
    """The ``n`` keys with the most reviews that have a text; ties go to the smaller key."""
    counts = count_per_key(reviews.where(has_text(F.col("text"))), key)
    return counts.orderBy(F.desc("n"), key).limit(n)


def review_profile(reviews: DataFrame) -> DataFrame:
    """All seven statistics of a review table as one row.

    The texts are read once, for their length. The statistics then come from
    per-review, per-user and per-business aggregates, each of which combines
    before its shuffle, instead of one aggregate with several distincts (which
    would copy every row once per distinct column).
    """
    narrow = materialize(
        reviews.select(
            "review_id",
            "user_id",
            "business_id",
            F.when(is_useful(F.col("useful")), 1).alias("useful"),
            F.when(is_five_star(F.col("stars")), 1).alias("five"),
            F.length("text").alias("chars"),
        )
    )
    with_text = F.when(F.col("chars") > 0, 1)
    per_review = narrow.groupBy("review_id").agg(*(F.max(c).alias(c) for c in ("useful", "five", "chars")))
    scalars = per_review.agg(
        F.count("useful").alias("n_review_useful"),
        F.count("five").alias("n_review_5_star"),
        F.max("chars").cast("bigint").alias("n_characters"),
    )
    users = narrow.groupBy("user_id").agg(F.count(with_text).alias("n"))
    business = narrow.groupBy("business_id").agg(F.count(with_text).alias("n"))
    parts = [
        scalars,
        users.agg(F.count(F.when(F.col("n") > 0, F.col("user_id"))).alias("n_user")),
        business.agg(F.count("business_id").alias("n_business")),
        _top_list(users, "user_id", "top20_user"),
        _top_list(business, "business_id", "top20_business"),
    ]
    # five rows of one value set each
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.agg(*(F.max(c).alias(c) for c in rows.columns))


def _top_list(counts: DataFrame, key: str, name: str) -> DataFrame:
    top = counts.where(F.col("n") > 0).orderBy(F.desc("n"), key).limit(20)
    entry = F.struct((-F.col("n")).alias("order"), F.col(key).alias("id"), F.col("n").alias("n"))
    pairs = F.transform(
        F.array_sort(F.collect_list(entry)),
        lambda e: F.struct(e["id"].cast("string").alias("id"), e["n"].alias("n")),
    )
    return top.agg(pairs.alias(name))


def state_average(reviews: DataFrame, business: DataFrame, value: str = "stars") -> DataFrame:
    """Average over the reviews of each state; reviews of unknown businesses form a null group.

    Reviews are summed per business before the join, so the join moves one row
    per business and a business with very many reviews does no harm.
    """
    sums = reviews.groupBy("business_id").agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    return (
        sums.join(business.select("business_id", "state"), "business_id", "left")
        .groupBy("state")
        .agg((F.sum("s") / F.sum("n")).alias(value))
        .orderBy(F.desc(value), "state")
    )


def business_average(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("business_id").agg(F.avg("stars").alias("stars"))


def stars_sum(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("business_id").agg(F.sum("stars").alias("stars"))


def state_average_of_averages(reviews: DataFrame, business: DataFrame) -> DataFrame:
    """Mean of the business means of each state; businesses without reviews drop out."""
    return (
        business.select("business_id", "state")
        .join(business_average(reviews), "business_id")
        .groupBy("state")
        .agg(F.avg("stars").alias("stars"))
    )


def state_average_of_business_stars(business: DataFrame) -> DataFrame:
    return business.where(F.col("stars").isNotNull()).groupBy("state").agg(F.avg("stars").alias("stars"))


def degree(df: DataFrame, key: str, value: str) -> DataFrame:
    """Number of distinct values per key, largest first.

    Duplicates go before the count, so a key with very many rows is counted in pieces.
    """
    pairs = df.select(key, value).distinct()
    return pairs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key)


def latest_ratings(ratings: DataFrame) -> DataFrame:
    """One rating per (user, item): the one with the largest ``seq``."""
    return ratings.groupBy("user_id", "item_id").agg(F.max_by("rating", "seq").alias("rating"))


def duplicate_audit(ratings: DataFrame) -> DataFrame:
    """Rows, distinct pairs and distinct users, from counts per pair and then per user."""
    per_pair = ratings.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("n"))
    per_user = per_pair.groupBy("user_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("pairs"))
    return per_user.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum("pairs"), F.lit(0)).alias("n_pairs"),
        F.count(F.lit(1)).alias("n_users"),
    )


def zero_ratings(ratings: DataFrame) -> DataFrame:
    return ratings.where(F.col("rating") == 0).agg(F.count(F.lit(1)).alias("n_zero"))


def rating_histogram(ratings: DataFrame, rating: Column) -> DataFrame:
    return ratings.groupBy(rating_bucket(rating).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def common_values(df: DataFrame, key: str, value: str, first, second) -> DataFrame:
    """Counts of the common and of all values of two keys, and their ratio."""
    of = lambda k: df.where(F.col(key) == k).select(value)
    both = of(first).intersect(of(second)).withColumn("common", F.lit(1))
    either = of(first).unionByName(of(second)).distinct().withColumn("any", F.lit(1))
    counts = both.unionByName(either, allowMissingColumns=True).agg(
        F.count("common").alias("n_common"), F.count("any").alias("n_union")
    )
    return counts.select("*", F.try_divide("n_common", "n_union").alias("similarity"))
