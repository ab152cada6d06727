"""Frequent itemsets over orders and brands."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from reviewmine.functions.ordering import listed
from reviewmine.operators import itemsets
from reviewmine.plans import views
from reviewmine.plans.profile_queries import listed_sql
from reviewmine.plans.views import BASKETS
from reviewmine.sources.shared import materialize
from reviewmine.sources.writers import itemset_report

SHARE = 0.004  # a set is frequent in at least this share of the baskets
CHUNKS = 4
LARGE = 4  # baskets of more items than this for the filtered query
DEPTH = 7  # brands per order at most, since an order has at most seven lines


def _baskets(spark, folder):
    return materialize(itemsets.make_baskets(views.baskets(spark, folder)))


def _support(baskets) -> int:
    return math.ceil(SHARE * itemsets.basket_count(baskets))


def _shown(found):
    return found.withColumns(
        {"size": F.col("size").cast("bigint"), "items": F.array_join("items", ",")}
    )


def _mined(spark, folder, max_size=None):
    baskets = _baskets(spark, folder)
    return itemsets.frequent_itemsets(baskets, _support(baskets), max_size)


def _frequent_items(spark, folder):
    baskets = _baskets(spark, folder)
    return itemsets.frequent_items(baskets, _support(baskets))


def _level(size):
    return lambda s, d: _shown(_mined(s, d, size)).where(F.col("size") == size).drop("size")


def _son(spark, folder):
    baskets = _baskets(spark, folder)
    support = _support(baskets)
    candidates = materialize(itemsets.son_candidates(baskets, support, F.pmod("basket", F.lit(CHUNKS))))
    return candidates, itemsets.son_frequent(baskets, candidates, support)


def _filtered(spark, folder):
    baskets = materialize(itemsets.baskets_over(_baskets(spark, folder), LARGE))
    return _shown(itemsets.frequent_itemsets(baskets, _support(baskets)))


SUPPORT = f"support as (select cast(ceil({SHARE} * count(distinct basket)) as bigint) as s from baskets)"


def _sets_sql(size: int, extra: str = "") -> str:
    """All itemsets of one size with their basket counts, by self-joins of the baskets."""
    items = " || ',' || ".join(f"b{i}.item" for i in range(size))
    joins = " ".join(
        f"join baskets b{i} on b{i}.basket = b0.basket and b{i}.item > b{i - 1}.item" for i in range(1, size)
    )
    return f"""select cast({size} as bigint) as size, {items} as items{extra}, cast(count(*) as bigint) as freq
      from baskets b0 {joins} group by all"""


ALL_SETS = " union all ".join(_sets_sql(k) for k in range(1, DEPTH + 1))
CHUNK_SETS = " union all ".join(_sets_sql(k, f", b0.basket % {CHUNKS} as chunk") for k in range(1, DEPTH + 1))
FREQUENT = f"frequent as (select size, items, freq from ({ALL_SETS}), support where freq >= s)"
CANDIDATES = f"""parts as (select basket % {CHUNKS} as chunk, count(distinct basket) as part from baskets group by 1),
  candidates as (
    select distinct size, items from ({CHUNK_SETS}) join parts using (chunk), support
    where freq * (select sum(part) from parts) >= s * part)"""
LARGE_BASKETS = f"""{BASKETS.replace('baskets as', 'every as')},
  baskets as (select * from every where basket in (select basket from every group by 1 having count(*) > {LARGE}))"""


def _level_sql(size: int) -> str:
    return f"with {BASKETS}, {SUPPORT} select items, freq from ({_sets_sql(size)}), support where freq >= s"


def _line(kind: str, view: str) -> str:
    text = "'(' || list_aggr(list_transform(string_split(items, ','), lambda i: '''' || i || ''''), 'string_agg', ', ') || ')'"
    return f"""select '{kind}' as section, size,
        row_number() over (partition by size order by string_split(items, ',')) - 1 as position, {text} as itemset
      from {view}"""


QUERIES = {
    "baskets_by_key": (
        lambda s, d: listed(itemsets.make_baskets(views.baskets(s, d), 1), "basket", "item"),
        listed_sql(BASKETS, "basket", "item", "baskets"),
    ),
    "baskets_by_item": (
        lambda s, d: listed(itemsets.make_baskets(views.baskets(s, d), 2), "basket", "item"),
        listed_sql(
            BASKETS + ", turned as (select item as basket, basket as item from baskets)", "basket", "item", "turned"
        ),
    ),
    "baskets_over_k": (
        lambda s, d: itemsets.baskets_over(itemsets.make_baskets(views.baskets(s, d)), LARGE),
        f"with {LARGE_BASKETS} select basket, item from baskets",
    ),
    "frequent_items": (
        _frequent_items,
        f"""with {BASKETS}, {SUPPORT} select item, cast(count(*) as bigint) as freq from baskets
            group by 1 having count(*) >= (select s from support)""",
    ),
    "frequent_pairs": (_level(2), _level_sql(2)),
    "frequent_triples": (_level(3), _level_sql(3)),
    "frequent_itemsets_all": (
        lambda s, d: _shown(_mined(s, d)),
        f"with {BASKETS}, {SUPPORT}, {FREQUENT} select * from frequent",
    ),
    "son_candidates": (
        lambda s, d: _shown(_son(s, d)[0]),
        f"with {BASKETS}, {SUPPORT}, {CANDIDATES} select * from candidates",
    ),
    "son_frequent": (
        lambda s, d: _shown(_son(s, d)[1]),
        f"with {BASKETS}, {SUPPORT}, {FREQUENT} select * from frequent",
    ),
    "filtered_itemsets": (
        _filtered,
        f"with {LARGE_BASKETS}, {SUPPORT}, {FREQUENT} select * from frequent",
    ),
    "itemset_report": (
        lambda s, d: itemset_report(*_son(s, d)),
        f"""with {BASKETS}, {SUPPORT}, {FREQUENT}, {CANDIDATES}
            {_line('Candidates:', 'candidates')} union all {_line('Frequent Itemsets:', 'frequent')}""",
    ),
}
