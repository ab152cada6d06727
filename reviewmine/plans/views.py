"""The given tables seen as reviews, businesses, ratings, baskets, sets and graphs.

Each view exists twice: as a DataFrame and as SQL text for the check.
Every view covers its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewmine.sources.shared import fan_out


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Events as reviews: stars from the value, the business from the JSON field."""
    events = table(spark, folder, "events")
    return events.select(
        F.col("event_id").alias("review_id"),
        "user_id",
        F.from_json("props", "k bigint")["k"].alias("business_id"),
        F.least(F.lit(5.0), 1 + F.floor(F.col("value") / 20)).cast("double").alias("stars"),
        F.floor("value").cast("int").alias("useful"),
        F.col("event_type"),
    )


REVIEWS = """reviews as (
  select event_id as review_id, user_id, cast(json_extract(props, '$.k') as bigint) as business_id,
         least(5.0, 1 + floor(value / 20))::double as stars, cast(floor(value) as bigint) as useful, event_type
  from events)"""


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as reviews with a text: the source writes about the language."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("review_id"),
        F.col("source").alias("user_id"),
        F.col("lang").alias("business_id"),
        F.least(F.lit(5.0), 1 + F.floor(F.length("text") / 1000)).cast("double").alias("stars"),
        (F.length("text") - 500).alias("useful"),
        "text",
    )


TEXTS = """texts as (
  select doc_id as review_id, source as user_id, lang as business_id, least(5.0, 1 + floor(length(text) / 1000))::double as stars,
         length(text) - 500 as useful, text
  from documents)"""


def sales(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as reviews of suppliers, with the quantity as stars."""
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("business_id"), F.col("l_quantity").alias("stars")
    )


def sellers(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as businesses; the nation is the state and the balance their own stars."""
    nation = table(spark, folder, "nation").select("n_nationkey", F.col("n_name").alias("state"))
    supplier = table(spark, folder, "supplier")
    return supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(
        F.col("s_suppkey").alias("business_id"), "state", F.col("s_acctbal").alias("stars")
    )


SALES = "sales as (select l_suppkey as business_id, l_quantity as stars from lineitem)"
SELLERS = """sellers as (
  select s_suppkey as business_id, n_name as state, s_acctbal as stars
  from supplier join nation on s_nationkey = n_nationkey)"""


def ratings(spark: SparkSession, folder: str) -> DataFrame:
    """All event ratings with their order."""
    return reviews(spark, folder).select(
        "user_id",
        F.col("business_id").alias("item_id"),
        F.col("stars").alias("rating"),
        F.col("review_id").alias("seq"),
        "event_type",
    )


RATINGS = f"""{REVIEWS},
ratings as (select user_id, business_id as item_id, stars as rating, review_id as seq, event_type from reviews)"""


def rating_split(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Purchases are to be predicted from all other events."""
    rows = ratings(spark, folder)
    bought = F.col("event_type") == "purchase"
    return rows.where(~bought), rows.where(bought)


RATING_SPLIT = f"""{RATINGS},
train as (select user_id, item_id, max_by(rating, seq) as rating from ratings
          where event_type <> 'purchase' group by 1, 2),
test as (select user_id, item_id, max_by(rating, seq) as rating from ratings
         where event_type = 'purchase' group by 1, 2)"""


def order_split(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Customers rate months by their orders; finished orders train, the others test.

    Some customers have no finished order, which gives cold rows.
    """
    orders = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("user_id"),
        F.date_format("o_orderdate", "yyyy-MM").alias("item_id"),
        F.least(F.lit(5.0), 1 + F.floor(F.col("o_totalprice") / 100000)).cast("double").alias("rating"),
        F.col("o_orderkey").alias("seq"),
        "o_orderstatus",
    )
    done = F.col("o_orderstatus") == "F"
    return orders.where(done), orders.where(~done)


ORDER_SPLIT = """visits as (
  select o_custkey as user_id, strftime(o_orderdate, '%Y-%m') as item_id,
         least(5.0, 1 + floor(o_totalprice / 100000))::double as rating, o_orderkey as seq, o_orderstatus
  from orders),
train_rows as (select * from visits where o_orderstatus = 'F'),
test_rows as (select * from visits where o_orderstatus <> 'F'),
train as (select user_id, item_id, max_by(rating, seq) as rating from train_rows group by 1, 2),
seen as (select t.*, u.user_id is not null and i.item_id is not null as warm
         from test_rows t left join (select distinct user_id from train) u on t.user_id = u.user_id
         left join (select distinct item_id from train) i on t.item_id = i.item_id),
cold as (select * from seen where not warm),
test as (select user_id, item_id, max_by(rating, seq) as rating from seen where warm group by 1, 2)"""


def baskets(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as baskets of brands."""
    part = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("item"))
    return table(spark, folder, "lineitem").join(part, "l_partkey").select(F.col("l_orderkey").alias("basket"), "item")


BASKETS = """baskets as (
  select distinct l_orderkey as basket, p_brand as item from lineitem join part on l_partkey = p_partkey)"""


def shingles(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as sets of three-word shingles of their whole text.

    Shingles take many times the room of the texts, so moving the texts first
    to have them cut in many tasks costs little.
    """
    docs = fan_out(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    words = F.filter(F.split(F.lower("text"), r"[ \t\r\n\f]+"), lambda w: w != "")
    docs = docs.select(F.col("doc_id").alias("item"), words.alias("w"))
    append = lambda x, y: F.concat(x, F.lit(" "), y)
    second, third = F.slice("w", F.lit(2), F.size("w") - 1), F.slice("w", F.lit(3), F.size("w") - 2)
    # the shifted lists are shorter, which leaves nulls at the end
    grams = F.zip_with(F.zip_with("w", second, append), third, append)
    grams = F.when(F.size("w") >= 3, F.array_distinct(grams))
    # a plain explode would compute the shingles twice, once to test for empty lists
    return docs.select("item", F.explode_outer(grams).alias("value")).where(F.col("value").isNotNull())


SHINGLES = r"""words as (
  select doc_id, list_filter(string_split_regex(lower(text), '[ \t\r\n\f]+'), lambda w: w <> '') as w from documents),
sets as (
  select distinct doc_id as item, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) as value
  from words where len(w) >= 3)"""


def user_items(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct (user, business) pairs of the events."""
    return reviews(spark, folder).select(F.col("user_id").alias("key"), F.col("business_id").alias("value"))
