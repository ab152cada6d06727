"""Rating prediction over events (purchases from other events) and orders (open from finished ones)."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewmine.operators import recommend as rec
from reviewmine.operators.neighbours import NEIGHBOURS, asked_cosines, asked_weights, user_neighbours
from reviewmine.operators.profile import latest_ratings
from reviewmine.plans import views
from reviewmine.plans.views import ORDER_SPLIT, RATING_SPLIT
from reviewmine.sources.shared import materialize


def _events(spark, folder):
    """Train and test with one rating per cell."""
    train, test = views.rating_split(spark, folder)
    return materialize(latest_ratings(train)), materialize(latest_ratings(test))


def _orders(spark, folder):
    """Train with one rating per cell; test rows as they are, duplicates included."""
    train, test = views.order_split(spark, folder)
    return materialize(latest_ratings(train)), test


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def _whole(df):
    return df.withColumn("rank", F.col("rank").cast("bigint"))


def _neighbours(spark, folder):
    train, test = _events(spark, folder)
    return train, user_neighbours(train, rec.open_cells(train, test))


def _user_cf_neighbors(spark, folder):
    return _whole(_neighbours(spark, folder)[1])


def _asked(spark, folder):
    """The training ratings and the open cells, whose users are compared with each rater of their items."""
    train, test = _events(spark, folder)
    return train, materialize(rec.open_cells(train, test).select("user_id", "item_id"))


def _user_pearson(spark, folder):
    return asked_weights(*_asked(spark, folder)).toDF("a", "b", "w")


def _user_cosine(spark, folder):
    return asked_cosines(*_asked(spark, folder)).toDF("a", "b", "w")


def _user_cf(spark, folder):
    return rec.predict_user_based(*_events(spark, folder))


def _rmse_user_cf(spark, folder):
    train, test = _events(spark, folder)
    return _rounded(rec.rmse(test, rec.predict_user_based(train, test)), "rmse")


def _item_pearson(spark, folder):
    train, test = _events(spark, folder)
    return rec.item_weights(train, rec.open_cells(train, test))


def _order_predictions(spark, folder):
    train, test = _orders(spark, folder)
    return test, rec.with_cold(train, test, rec.predict_user_mean(train, test))


def _rmse_user_mean(spark, folder):
    test, predictions = _order_predictions(spark, folder)
    return _rounded(rec.rmse(test, predictions), "rmse")


def _warm(spark, folder):
    train, test = _orders(spark, folder)
    return rec.warm_rows(train, test).select("user_id", "item_id", "rating")


def _cold(spark, folder):
    train, test = _orders(spark, folder)
    return rec.cold_rows(train, test).select("user_id", "item_id", "rating")


CELLS = f"""{RATING_SPLIT},
  cells as (
    select t.user_id, t.item_id, r.rating from test t left join train r using (user_id, item_id)
    where t.user_id in (select user_id from train) and t.item_id in (select item_id from train)),
  means as (select user_id, avg(rating) as mean, sum(rating) as total, count(*) as n from train group by 1)"""


def _pearson_sql(by: str, dim: str) -> str:
    return f"""centre as (select t.*, rating - avg(rating) over (partition by {by}) as c from train t),
      sums as (select p.{by} as a, q.{by} as b, sum(p.c * q.c) as dot, sum(p.c * p.c) as x, sum(q.c * q.c) as y
               from centre p join centre q using ({dim}) where p.{by} <> q.{by} group by 1, 2),
      weights as (select a, b, round(case when x = 0 or y = 0 then 0 else dot / (sqrt(x) * sqrt(y)) end, 9) + 0.0 as w
                  from sums)"""


NEAR = f"""{CELLS}, {_pearson_sql('user_id', 'item_id')},
  near as (
    select * from (
      select c.user_id, c.item_id, r.user_id as neighbour, w, r.rating,
             row_number() over (partition by c.user_id, c.item_id order by w desc, r.user_id) as rank
      from cells c join train r on r.item_id = c.item_id join weights on a = c.user_id and b = r.user_id
      where c.rating is null) where rank <= {NEIGHBOURS})"""
ASKED = f"""{CELLS}, {_pearson_sql('user_id', 'item_id')},
  asked as (
    select distinct c.user_id as a, r.user_id as b from cells c join train r on r.item_id = c.item_id where c.rating is null)"""
USER_CF = f"""{NEAR},
  votes as (
    select v.user_id, v.item_id, sum(w * (v.rating - (total - v.rating) / (n - 1))) as shift, sum(abs(w)) as weight
    from near v join means m on m.user_id = v.neighbour group by 1, 2),
  predictions as (
    select c.user_id, c.item_id, case when c.rating is not null then c.rating
           else least(5.0, mean + case when weight > 0 then shift / weight else 0 end) end as prediction
    from cells c join means using (user_id) left join votes using (user_id, item_id))"""
ITEM_PAIRS = f"""{CELLS}, {_pearson_sql('item_id', 'user_id')},
  rated as (
    select c.user_id, c.item_id, s.item_id as other, s.rating
    from cells c join (select *, row_number() over (partition by user_id order by item_id) as k from train) s
      on s.user_id = c.user_id and k <= {rec.FIRST_ITEMS}
    where c.rating is null)"""
ITEM_CF = f"""{ITEM_PAIRS},
  best as (
    select * from (
      select r.*, w, row_number() over (partition by user_id, item_id order by w desc, other) as k
      from rated r join weights on a = item_id and b = other) where k <= {rec.TOP_ITEMS}),
  votes as (select user_id, item_id, sum(rating * w) as s, sum(abs(w)) as t from best group by 1, 2)
  select user_id, item_id,
         round(case when c.rating is not null then c.rating when t > 0 then s / t else 0 end, 6) + 0.0 as prediction
  from cells c left join votes using (user_id, item_id)"""
ORDER_PREDICTIONS = f"""{ORDER_SPLIT},
  means as (select user_id, avg(rating) as mean from train group by 1),
  predictions as (
    select user_id, item_id, coalesce(r.rating, mean) as prediction
    from test t left join train r using (user_id, item_id) join means using (user_id)
    union all
    select distinct user_id, item_id,
           (select sum(rating) / count(distinct (user_id, item_id, rating)) from cold) as prediction from cold)"""

QUERIES = {
    "user_mean": (
        lambda s, d: _rounded(rec.user_means(_events(s, d)[0]), "mean"),
        f"with {RATING_SPLIT} select user_id, round(avg(rating), 6) as mean from train group by 1",
    ),
    "warm_rows": (_warm, f"with {ORDER_SPLIT} select user_id, item_id, rating from seen where warm"),
    "cold_start_rows": (_cold, f"with {ORDER_SPLIT} select user_id, item_id, rating from cold"),
    "cold_start_mean": (
        lambda s, d: _rounded(rec.cold_start_mean(_cold(s, d)), "prediction"),
        f"""with {ORDER_SPLIT} select round(coalesce(sum(rating) / count(distinct (user_id, item_id, rating)), 0), 6)
            as prediction from cold""",
    ),
    "user_pearson": (
        _user_pearson,
        f"with {ASKED} select a, b, w from asked join weights using (a, b)",
    ),
    "user_cosine": (
        _user_cosine,
        f"""with {ASKED},
        norms as (select user_id, sqrt(sum(rating * rating)) as norm from train group by 1),
        dots as (select p.user_id as a, q.user_id as b, sum(p.rating * q.rating) as dot
                 from train p join train q using (item_id) group by 1, 2)
        select a, b, round(coalesce(dot, 0) / (x.norm * y.norm), 9) + 0.0 as w
        from asked left join dots using (a, b)
        join norms x on x.user_id = a join norms y on y.user_id = b""",
    ),
    "user_cf_neighbors": (
        _user_cf_neighbors,
        f"with {NEAR} select user_id, item_id, neighbour, w, cast(rank as bigint) as rank from near",
    ),
    "user_cf_predict": (
        lambda s, d: _rounded(_user_cf(s, d), "prediction"),
        f"with {USER_CF} select user_id, item_id, round(prediction, 6) as prediction from predictions",
    ),
    "item_pearson": (
        _item_pearson,
        f"""with {ITEM_PAIRS} select a, b, w from weights
            join (select distinct least(item_id, other) as a, greatest(item_id, other) as b from rated) using (a, b)""",
    ),
    "item_cf_predict": (
        lambda s, d: rec.predict_item_based(*_events(s, d)).withColumn(
            "prediction", F.round("prediction", 6) + F.lit(0.0)
        ),
        f"with {ITEM_CF}",
    ),
    "user_mean_predict": (
        lambda s, d: _rounded(rec.predict_user_mean(*_events(s, d)), "prediction"),
        f"""with {CELLS} select user_id, item_id, round(coalesce(rating, mean), 6) as prediction
            from cells join means using (user_id)""",
    ),
    "als_predict": (lambda s, d: rec.predict_als(*_events(s, d)), None),
    "als_coverage": (
        lambda s, d: rec.predict_als(*_events(s, d)).select(
            "user_id", "item_id", (~F.isnan("prediction") & F.col("prediction").isNotNull()).alias("predicted")
        ),
        f"with {CELLS} select user_id, item_id, true as predicted from cells",
    ),
    "als_residual": (
        lambda s, d: rec.als_residuals(_events(s, d)[0]).select("user_id", (F.col("residual") < 1e-3).alias("solved")),
        f"with {RATING_SPLIT} select distinct user_id, true as solved from train",
    ),
    "rmse_user_mean": (
        _rmse_user_mean,
        f"""with {ORDER_PREDICTIONS} select round(sqrt(avg(pow(rating - prediction, 2))), 6) as rmse
            from test_rows join predictions using (user_id, item_id)""",
    ),
    "rmse_user_cf": (
        _rmse_user_cf,
        f"""with {USER_CF} select round(sqrt(avg(pow(rating - prediction, 2))), 6) as rmse
            from test join predictions using (user_id, item_id)""",
    ),
    "predictions_all": (
        lambda s, d: _rounded(_order_predictions(s, d)[1], "prediction"),
        f"with {ORDER_PREDICTIONS} select user_id, item_id, round(prediction, 6) as prediction from predictions",
    ),
}
