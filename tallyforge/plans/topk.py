"""The k patterns of smallest p-value, over closed sets or over all sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.dataset import Dataset
from tallyforge.functions.stats import TESTS
from tallyforge.operators.closed import Search
from tallyforge.plans.significance import named, order, score


def members(items: list[int], sup: int, k: int, supports: Callable[[list[tuple[int, ...]]], list[int]]) -> list[tuple[int, ...]]:
    """The first k sets whose closure is the closed set `items`: more items first, then by number.

    A set whose support is the closed set's has that closure, and so has every
    set between the two; so each level is made of the one before.
    """
    level, found = [tuple(items)], [tuple(items)]
    while level and len(found) < k:
        below = sorted({s[:i] + s[i + 1 :] for s in level for i in range(len(s)) if len(s) > 1})
        level = [s for s, n in zip(below, supports(below), strict=True) if n == sup] if below else []
        found += level
    return found[:k]


def _supports(search: Search) -> Callable[[list[tuple[int, ...]]], list[int]]:
    if search.shared:
        m = search.shared.value
        return lambda sets: [int(m.n[m.has[:, list(s)].all(1)].sum()) for s in sets]

    def counted(sets: list[tuple[int, ...]]) -> list[int]:
        out = dict(enumerate([0] * len(sets)))
        for k, sup, *_ in search._counted(sets):
            out[k] = sup
        return list(out.values())

    return counted


def topk_itemsets(data: Dataset, k: int = 3, test: str = "fisher", alternative: str = "greater", closed: bool = True, broadcast: bool | None = None) -> DataFrame:
    """rank, pval, sup, pos_sup, n_items, items of the k best.

    Supports whose least p-value is above the kth so far are not searched. The k
    best of all sets have their closures among the k best closed sets, as a
    closure comes before its other members; so only k closed sets are taken apart.
    """
    if k < 1:
        raise ValueError("k must be positive")
    data = data.cached()
    total, n = data.counts()
    kind = TESTS[test]
    reverse = kind(total, n, alternative).complements
    data = data.complemented() if reverse else data
    tester = kind(total, total - n if reverse else n, alternative)
    spark, n_items = data.items.sparkSession, data.items.count()
    search = Search(data.merged(ranks=tester.uses_ranks), n_items, broadcast)
    top = int(data.baskets.groupBy("item_id").count().agg(F.max("count")).first()[0] or 0)
    least = max(1, top)
    while True:
        best = score(search.closed(least), tester).withColumn("ids", F.col("items")).orderBy(*order()).limit(k).persist()
        row = best.agg(F.count("*").alias("n"), F.max("pval").alias("worst")).first()
        matter = tester.pmin(F.col("id")) <= (row["worst"] if row["n"] == k else 1.0)
        lower = spark.range(1, least).filter(matter).agg(F.min("id").alias("min"), F.max("id").alias("max")).first()
        if lower["min"] is None:
            break
        # too few yet: half the support; else every support that could still matter
        least = max(1, min(lower["max"], least // 2)) if row["n"] < k else lower["min"]
    if not closed:
        supports = _supports(search)
        rows = [(list(s), len(s), r["sup"], r["pos_sup"], r["rank_sum"], r["pval"], list(s)) for r in best.collect() for s in members(r["items"], r["sup"], k, supports)]  # k closed sets
        best = spark.createDataFrame(rows, best.schema).orderBy(*order()).limit(k)
    if reverse:
        best = best.withColumn("pos_sup", F.col("sup") - F.col("pos_sup"))
    ranked = named(best.drop("ids"), data.items).withColumn("rank", F.row_number().over(Window.orderBy(*order())))
    return ranked.select("rank", "pval", "sup", "pos_sup", "n_items", "items")
