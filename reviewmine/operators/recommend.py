"""Rating prediction: warm and cold rows, user means, user- and item-based filtering, ALS, RMSE.

Training data is ``(user_id, item_id, rating)`` with one row per cell (see
``profile.latest_ratings``); test data has the same columns.
"""

from __future__ import annotations

from pyspark.ml.recommendation import ALS
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewmine.functions.columns import cap_rating
from reviewmine.functions.ordering import dense_index
from reviewmine.operators.correlation import pearson
from reviewmine.operators.neighbours import NEIGHBOURS, user_neighbours
from reviewmine.sources.shared import attach, materialize

FIRST_ITEMS, TOP_ITEMS = 15, 14
CELL = ["user_id", "item_id"]


def warm_rows(train: DataFrame, test: DataFrame) -> DataFrame:
    """Test rows whose user and item both occur in the training data."""
    users, items = train.select("user_id").distinct(), train.select("item_id").distinct()
    return attach(attach(test, users, "user_id", "left_semi"), items, "item_id", "left_semi").select(test.columns)


def cold_rows(train: DataFrame, test: DataFrame) -> DataFrame:
    """Test rows whose user or item does not occur in the training data."""
    users = train.select("user_id").distinct().withColumn("_u", F.lit(1))
    items = train.select("item_id").distinct().withColumn("_i", F.lit(1))
    marked = attach(attach(test, users, "user_id", "left"), items, "item_id", "left")
    return marked.where(F.col("_u").isNull() | F.col("_i").isNull()).select(test.columns)


def cold_start_mean(cold: DataFrame) -> DataFrame:
    """Sum of the cold ratings over the number of *distinct* cold rows, 0 without any.

    This reads the test ratings, as the original method does.
    """
    rows = cold.groupBy("user_id", "item_id", "rating").agg(F.count(F.lit(1)).alias("n"))
    mean = F.try_divide(F.sum(F.col("rating") * F.col("n")), F.count(F.lit(1)))
    return rows.agg(F.coalesce(mean, F.lit(0.0)).alias("prediction"))


def train_mean(train: DataFrame) -> DataFrame:
    """An alternative value for cold rows that does not look at the test ratings."""
    return train.agg(F.coalesce(F.avg("rating"), F.lit(0.0)).alias("prediction"))


def cold_predictions(cold: DataFrame, value: DataFrame) -> DataFrame:
    """All distinct cold cells with the one value."""
    return cold.select(*CELL).distinct().withColumn("prediction", F.lit(value.first()[0]))


def user_means(train: DataFrame) -> DataFrame:
    return train.groupBy("user_id").agg(F.avg("rating").alias("mean"))


def _known_and_open(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Warm cells that have a training rating (which is their prediction), and the others."""
    cells = materialize(
        warm_rows(train, test.select(*CELL).distinct()).join(train.select(*CELL, "rating"), CELL, "left")
    )
    known = cells.where(F.col("rating").isNotNull()).withColumnRenamed("rating", "prediction")
    return known, cells.where(F.col("rating").isNull()).select(*CELL)


def predict_user_mean(train: DataFrame, test: DataFrame) -> DataFrame:
    """The training rating of a cell if there is one, else the mean of its user."""
    cells = warm_rows(train, test.select(*CELL).distinct())
    joined = cells.join(train.select(*CELL, "rating"), CELL, "left")
    joined = attach(joined, user_means(train), "user_id")
    return joined.select(*CELL, F.coalesce("rating", "mean").alias("prediction"))


def open_cells(train: DataFrame, test: DataFrame) -> DataFrame:
    return _known_and_open(train, test)[1]


def predict_from_users(train: DataFrame, targets: DataFrame, neighbours: DataFrame) -> DataFrame:
    """User mean plus the weighted mean of the neighbours' distances from their own means.

    A neighbour's mean leaves the target item out. Only the upper bound is cut.
    """
    totals = train.groupBy("user_id").agg(F.sum("rating").alias("sum"), F.count(F.lit(1)).alias("n"))
    rated = train.select(F.col("user_id").alias("neighbour"), "item_id", "rating")
    votes = attach(
        neighbours.join(rated, ["neighbour", "item_id"]), totals.withColumnRenamed("user_id", "neighbour"), "neighbour"
    )
    rest = F.try_divide(F.col("sum") - F.col("rating"), F.col("n") - 1)
    sums = votes.groupBy(*CELL).agg(
        F.sum(F.col("w") * (F.col("rating") - rest)).alias("shift"), F.sum(F.abs("w")).alias("total")
    )
    shift = F.when(F.col("total") > 0, F.col("shift") / F.col("total")).otherwise(0.0)
    predicted = attach(targets.join(sums, CELL, "left"), user_means(train), "user_id")
    return predicted.select(*CELL, cap_rating(F.col("mean") + F.coalesce(shift, F.lit(0.0))).alias("prediction"))


def predict_user_based(train: DataFrame, test: DataFrame, n: int = NEIGHBOURS) -> DataFrame:
    known, targets = _known_and_open(train, test)
    neighbours = user_neighbours(train, targets, n)
    return known.unionByName(predict_from_users(train, targets, neighbours))


def _rated_items(train: DataFrame, targets: DataFrame, first: int) -> DataFrame:
    """Each target with the first items (by id) its user has rated: ``(user_id, item_id, other, rating)``."""
    order = Window.partitionBy("user_id").orderBy("item_id")
    asked = attach(train, targets.select("user_id").distinct(), "user_id", "left_semi")
    some = asked.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= first)
    return attach(targets, some.select("user_id", F.col("item_id").alias("other"), "rating"), "user_id")


def _item_pair() -> list:
    return [F.least("item_id", "other").alias("a"), F.greatest("item_id", "other").alias("b")]


def item_weights(train: DataFrame, targets: DataFrame, first: int = FIRST_ITEMS) -> DataFrame:
    """Pearson weights ``(a, b, w)`` of the item pairs needed for the targets, a few per target."""
    return _item_weights(train, _rated_items(train, targets, first))


def _item_weights(train: DataFrame, rated: DataFrame) -> DataFrame:
    return pearson(materialize(rated.select(*_item_pair()).distinct()), train, "item_id")


def predict_item_based(
    train: DataFrame, test: DataFrame, first: int = FIRST_ITEMS, top: int = TOP_ITEMS
) -> DataFrame:
    """Weighted mean of the user's own ratings of the most similar items; 0 without similar items."""
    known, targets = _known_and_open(train, test)
    rated = _rated_items(train, targets, first)
    weights = _item_weights(train, rated)
    best = Window.partitionBy(*CELL).orderBy(F.desc("w"), "other")
    votes = rated.select("*", *_item_pair()).join(weights, ["a", "b"])
    votes = votes.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= top)
    value = F.coalesce(F.try_divide(F.sum(F.col("rating") * F.col("w")), F.sum(F.abs("w"))), F.lit(0.0))
    sums = votes.groupBy(*CELL).agg(value.alias("prediction"))
    predicted = targets.join(sums, CELL, "left").select(*CELL, F.coalesce("prediction", F.lit(0.0)).alias("prediction"))
    return known.unionByName(predicted)


RANK, ROUNDS, PENALTY = 2, 10, 0.01


def _als(train: DataFrame) -> tuple:
    """A factorisation of the ratings, and the numbers of users and items in it."""
    users = materialize(dense_index(train, "user_id")).withColumnRenamed("idx", "user")
    items = materialize(dense_index(train, "item_id")).withColumnRenamed("idx", "item")
    als = ALS(
        rank=RANK, maxIter=ROUNDS, regParam=PENALTY, seed=10, userCol="user", itemCol="item", ratingCol="rating",
        coldStartStrategy="drop",
    )
    return als.fit(_numbered(train, users, items).select("user", "item", "rating")), users, items


def _numbered(cells: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    numbered = cells.join(users, "user_id").join(items, "item_id")
    return numbered.withColumns({"user": F.col("user").cast("int"), "item": F.col("item").cast("int")})


def predict_als(train: DataFrame, test: DataFrame) -> DataFrame:
    """Matrix factorisation of rank 2 for the warm cells; predictions are not cut."""
    model, users, items = _als(train)
    cells = _numbered(test.select(*CELL).distinct(), users, items)
    return model.transform(cells).select(*CELL, F.col("prediction").cast("double").alias("prediction"))


def als_residuals(train: DataFrame) -> DataFrame:
    """``(user_id, residual)``: how far each user's factors are from solving their normal equations.

    The last half step of the factorisation solves, for each user with n
    ratings, (sum of q q' + penalty * n) x = sum of r q over the factors q of
    the rated items. The residual is the length of the difference over that of
    the right side. Gram matrices are sums of products, one row for each user.
    """
    model, users, items = _als(train)
    q = [F.col("q")[i].cast("double") for i in range(RANK)]
    rated = _numbered(train, users, items).join(model.itemFactors.select(F.col("id").alias("item"), F.col("features").alias("q")), "item")
    gram = {(i, k): F.sum(q[i] * q[k]).alias(f"g{i}{k}") for i in range(RANK) for k in range(i, RANK)}
    right = [F.sum(F.col("rating") * q[i]).alias(f"r{i}") for i in range(RANK)]
    sums = rated.groupBy("user", "user_id").agg(F.count(F.lit(1)).alias("n"), *gram.values(), *right)
    solved = sums.join(model.userFactors.select(F.col("id").alias("user"), F.col("features").alias("x")), "user")
    x = [F.col("x")[i].cast("double") for i in range(RANK)]

    def difference(i: int) -> Column:
        own = F.lit(PENALTY) * F.col("n") * x[i]
        return sum((F.col(f"g{min(i, k)}{max(i, k)}") * x[k] for k in range(RANK)), own) - F.col(f"r{i}")

    length = lambda parts: F.sqrt(sum((p * p for p in parts), F.lit(0.0)))
    residual = length([difference(i) for i in range(RANK)]) / length([F.col(f"r{i}") for i in range(RANK)])
    return solved.select("user_id", F.coalesce(residual, F.lit(0.0)).alias("residual"))


def with_cold(train: DataFrame, test: DataFrame, warm_predictions: DataFrame) -> DataFrame:
    """The whole prediction table: the warm predictions and one value for all cold cells."""
    cold = cold_rows(train, test)
    return warm_predictions.unionByName(cold_predictions(cold, cold_start_mean(cold)))


def rmse(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    joined = truth.select(*CELL, "rating").join(predictions, CELL)
    return joined.agg(F.sqrt(F.avg(F.pow(F.col("rating") - F.col("prediction"), 2))).alias("rmse"))
