"""Review statistics and averages over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewmine.functions.columns import clamp_rating
from reviewmine.functions.ordering import dense_index, listed
from reviewmine.operators import profile
from reviewmine.plans import views
from reviewmine.plans.views import RATINGS, REVIEWS, SALES, SELLERS, TEXTS


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def _top5_states(spark, folder):
    return _state_avg_stars(spark, folder).limit(5)


def _state_avg_stars(spark, folder):
    averages = profile.state_average(views.sales(spark, folder), views.sellers(spark, folder))
    return _rounded(averages, "stars").orderBy(F.desc("stars"), "state")


def _state_avg_unmatched(spark, folder):
    docs = views.table(spark, folder, "documents").select(F.col("doc_id").alias("business_id"), F.length("text").alias("chars"))
    labels = views.table(spark, folder, "labels").select(
        F.col("doc_id").alias("business_id"), F.col("quality").cast("string").alias("state")
    )
    return _rounded(profile.state_average(docs, labels, "chars"), "chars")


def _review_profile(spark, folder):
    row = profile.review_profile(views.texts(spark, folder))
    entry = lambda e: F.concat(e["id"], F.lit(":"), e["n"].cast("string"))
    return row.withColumns(
        {n: F.array_join(F.transform(n, entry), ",") for n in ("top20_user", "top20_business")}
    )


def _state_business_list(spark, folder):
    return listed(views.sellers(spark, folder), "state", "business_id")


def _user_item_sets(spark, folder):
    return listed(views.ratings(spark, folder), "user_id", "item_id")


def _rating_clamp(spark, folder):
    scaled = views.table(spark, folder, "events").select("event_id", (F.col("value") / 20).alias("x"))
    return scaled.select("event_id", F.round(clamp_rating(F.col("x")), 6).alias("rating"))


def _rating_histogram(spark, folder):
    return profile.rating_histogram(views.table(spark, folder, "events"), F.col("value") / 20)


def _json_props_scan(spark, folder):
    events = views.table(spark, folder, "events")
    return events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


def _common_items_pair(spark, folder):
    """The two users with the most ratings, compared."""
    rows = views.ratings(spark, folder)
    first, second = (r[0] for r in profile.count_per_key(rows, "user_id").orderBy(F.desc("n"), "user_id").limit(2).collect())
    return _rounded(profile.common_values(rows, "user_id", "item_id", first, second), "similarity")


def listed_sql(view: str, key: str, value: str, source: str) -> str:
    return f"""with {view}
    select {key}, row_number() over (partition by {key} order by {value}) - 1 as position, {value}
    from (select distinct {key}, {value} from {source})"""


STATE_AVG = f"""with {SALES}, {SELLERS}
  select state, round(avg(sales.stars), 6) as stars
  from sales left join sellers using (business_id) group by state order by stars desc, state"""

HAS_TEXT = "text is not null and length(text) > 0"


def _top_sql(key: str, n: int = 20) -> str:
    return f"""select {key}, cast(count(*) as bigint) as n from texts
      where {HAS_TEXT} group by 1 order by n desc, {key} limit {n}"""


QUERIES = {
    "state_avg_stars": (_state_avg_stars, STATE_AVG),
    "state_avg_unmatched": (
        _state_avg_unmatched,
        """select cast(quality as varchar) as state, round(avg(length(text)), 6) as chars
           from documents left join labels using (doc_id) group by 1""",
    ),
    "top5_states": (_top5_states, STATE_AVG + " limit 5"),
    "useful_reviews": (
        lambda s, d: profile.useful_reviews(views.reviews(s, d)),
        f"""with {REVIEWS} select cast(count(distinct review_id) as bigint) as n_review_useful,
            cast(count(distinct review_id) as bigint) as n_review_useful_check from reviews where useful > 0""",
    ),
    "five_star_reviews": (
        lambda s, d: profile.five_star_reviews(views.reviews(s, d)),
        f"""with {REVIEWS} select cast(count(distinct review_id) as bigint) as n_review_5_star,
            cast(count(distinct review_id) as bigint) as n_review_5_star_check from reviews
            where trunc(stars) >= 5""",
    ),
    "longest_text": (
        lambda s, d: profile.longest_text(views.texts(s, d)),
        f"with {TEXTS} select cast(max(length(text)) as bigint) as n_characters from texts",
    ),
    "users_with_text": (
        lambda s, d: profile.users_with_text(views.texts(s, d)),
        f"with {TEXTS} select cast(count(distinct user_id) as bigint) as n_user from texts where {HAS_TEXT}",
    ),
    "distinct_business": (
        lambda s, d: profile.distinct_business(views.reviews(s, d)),
        f"with {REVIEWS} select cast(count(distinct business_id) as bigint) as n_business from reviews",
    ),
    "top20_users": (
        lambda s, d: profile.top_keys(views.texts(s, d), "user_id"),
        f"with {TEXTS} {_top_sql('user_id')}",
    ),
    "top20_business": (
        lambda s, d: profile.top_keys(views.texts(s, d), "business_id"),
        f"with {TEXTS} {_top_sql('business_id')}",
    ),
    "review_profile": (
        _review_profile,
        f"""with {TEXTS},
        u as ({_top_sql('user_id')}), b as ({_top_sql('business_id')})
        select cast(count(distinct case when useful > 0 then review_id end) as bigint) as n_review_useful,
               cast(count(distinct case when trunc(stars) >= 5 then review_id end) as bigint) as n_review_5_star,
               cast(max(length(text)) as bigint) as n_characters,
               cast(count(distinct case when {HAS_TEXT} then user_id end) as bigint) as n_user,
               cast(count(distinct business_id) as bigint) as n_business,
               (select string_agg(user_id || ':' || n, ',' order by n desc, user_id) from u) as top20_user,
               (select string_agg(business_id || ':' || n, ',' order by n desc, business_id) from b) as top20_business
        from texts""",
    ),
    "state_avg_of_business_avg": (
        lambda s, d: _rounded(profile.state_average_of_averages(views.sales(s, d), views.sellers(s, d)), "stars"),
        f"""with {SALES}, {SELLERS}
        select state, round(avg(m.stars), 6) as stars from sellers
        join (select business_id, avg(stars) as stars from sales group by 1) m using (business_id) group by 1""",
    ),
    "state_avg_business_stars": (
        lambda s, d: _rounded(profile.state_average_of_business_stars(views.sellers(s, d)), "stars"),
        f"with {SELLERS} select state, round(avg(stars), 6) as stars from sellers group by 1",
    ),
    "business_avg_stars": (
        lambda s, d: _rounded(profile.business_average(views.sales(s, d)), "stars"),
        f"with {SALES} select business_id, round(avg(stars), 6) as stars from sales group by 1",
    ),
    "stars_sum_per_business": (
        lambda s, d: _rounded(profile.stars_sum(views.sales(s, d)), "stars"),
        f"with {SALES} select business_id, round(sum(stars), 6) as stars from sales group by 1",
    ),
    "state_business_list": (_state_business_list, listed_sql(SELLERS, "state", "business_id", "sellers")),
    "user_item_sets": (_user_item_sets, listed_sql(RATINGS, "user_id", "item_id", "ratings")),
    "user_degree": (
        lambda s, d: profile.degree(views.ratings(s, d), "user_id", "item_id"),
        f"with {RATINGS} select user_id, cast(count(distinct item_id) as bigint) as n from ratings group by 1",
    ),
    "item_degree": (
        lambda s, d: profile.degree(views.ratings(s, d), "item_id", "user_id"),
        f"with {RATINGS} select item_id, cast(count(distinct user_id) as bigint) as n from ratings group by 1",
    ),
    "ratings_dedup": (
        lambda s, d: profile.latest_ratings(views.ratings(s, d)),
        f"with {RATINGS} select user_id, item_id, max_by(rating, seq) as rating from ratings group by 1, 2",
    ),
    "duplicate_audit": (
        lambda s, d: profile.duplicate_audit(views.ratings(s, d)),
        f"""with {RATINGS} select cast(count(*) as bigint) as n_rows,
            cast(count(distinct (user_id, item_id)) as bigint) as n_pairs,
            cast(count(distinct user_id) as bigint) as n_users from ratings""",
    ),
    "zero_rating_audit": (
        lambda s, d: profile.zero_ratings(views.table(s, d, "lineitem").select(F.col("l_discount").alias("rating"))),
        "select cast(count(*) as bigint) as n_zero from lineitem where l_discount = 0",
    ),
    "rating_histogram": (
        _rating_histogram,
        """select case when x >= 0 and x < 1 then '0 <= x < 1' when x >= 1 and x < 2 then '1 <= x < 2'
                       when x >= 2 and x < 3 then '2 <= x < 3' when x >= 3 and x < 4 then '3 <= x < 4'
                       else '4 <= x' end as bucket, cast(count(*) as bigint) as n
           from (select value / 20 as x from events) group by 1""",
    ),
    "rating_clamp": (
        _rating_clamp,
        "select event_id, round(greatest(1.0, least(value / 20, 5.0))::double, 6) as rating from events",
    ),
    "dense_index": (
        lambda s, d: dense_index(views.table(s, d, "orders").select(F.col("o_orderkey").alias("id")), "id"),
        """select id, cast(dense_rank() over (order by id) - 1 as bigint) as idx
           from (select distinct o_orderkey as id from orders)""",
    ),
    "json_props_scan": (
        _json_props_scan,
        "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events",
    ),
    "common_items_pair": (
        _common_items_pair,
        f"""with {RATINGS},
        two as (select user_id from ratings group by 1 order by count(*) desc, user_id limit 2),
        per as (select item_id, count(distinct user_id) as u from ratings
                where user_id in (select user_id from two) group by 1)
        select cast(count(*) filter (u = 2) as bigint) as n_common, cast(count(*) as bigint) as n_union,
               round(count(*) filter (u = 2) / count(*)::double, 6) as similarity from per""",
    ),
}
