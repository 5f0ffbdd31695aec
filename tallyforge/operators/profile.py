"""Counts that describe a dataset, all as aggregations with partial sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.dataset import Dataset


def item_support(data: Dataset) -> DataFrame:
    """item_id, item, sup, pos_sup of every item, also those in no transaction."""
    rows = data.baskets
    if data.labels is not None:
        rows = rows.join(data.labels.select("tid", "is_pos"), "tid")
    else:
        rows = rows.withColumn("is_pos", F.lit(False))
    counts = rows.groupBy("item_id").agg(F.count("*").alias("sup"), F.sum(F.col("is_pos").cast("long")).alias("pos_sup"))
    zero = F.lit(0).cast("long")
    return data.items.join(counts, "item_id", "left").select("item_id", "item", F.coalesce("sup", zero).alias("sup"), F.coalesce("pos_sup", zero).alias("pos_sup"))


def support_histogram(data: Dataset) -> DataFrame:
    """sup, items, cumulative: items of each support, and of that support or more. One row a support."""
    hist = item_support(data).groupBy("sup").agg(F.count("*").alias("items"))
    return hist.withColumn("cumulative", F.sum("items").over(Window.orderBy(F.desc("sup")).rowsBetween(Window.unboundedPreceding, 0)))


def reduced_items(data: Dataset, least: int) -> DataFrame:
    """The items of support at least `least`."""
    return item_support(data).filter(F.col("sup") >= least)


def reduced_item_counts(data: Dataset) -> DataFrame:
    """least, items: how many items remain at each least support from 1 to the largest. Between two supports the count stays, so each support fills the gap below it."""
    steps = support_histogram(data).filter("sup > 0")
    below = F.coalesce(F.lag("sup").over(Window.orderBy("sup")), F.lit(0))
    return steps.select("sup", F.col("cumulative").alias("items"), below.alias("below")).select(F.explode(F.sequence(F.col("below") + 1, F.col("sup"))).alias("least"), "items")


def zero_transactions(data: Dataset) -> DataFrame:
    """The transactions without items."""
    return data.transactions.join(data.baskets.select("tid").distinct(), "tid", "left_anti")


def summary(data: Dataset) -> DataFrame:
    """n_trans, n_items, n_pos, max_x, max_t (-1 without labels), max_items_in_trans, ones, zero_trans, zero_items, density (ones over cells of the transactions that have items)."""
    total, positive = data.counts()
    support = item_support(data).agg(F.count("*").alias("n_items"), F.coalesce(F.max("sup"), F.lit(0)).alias("max_x"), F.coalesce(F.max("pos_sup"), F.lit(0)).alias("max_t"), F.coalesce(F.sum("sup"), F.lit(0)).alias("ones"), F.coalesce(F.sum((F.col("sup") == 0).cast("long")), F.lit(0)).alias("zero_items"))
    sizes = data.baskets.groupBy("tid").count().agg(F.count("*").alias("filled"), F.coalesce(F.max("count"), F.lit(0)).alias("max_items_in_trans"))
    both = support.crossJoin(F.broadcast(sizes))  # a row each
    density = F.when(F.col("filled") * F.col("n_items") > 0, F.col("ones") / (F.col("filled") * F.col("n_items"))).otherwise(0.0)
    return both.select(
        F.lit(total).cast("long").alias("n_trans"), "n_items", F.lit(positive).cast("long").alias("n_pos"), "max_x", (F.col("max_t") if data.labels is not None else F.lit(-1).cast("long")).alias("max_t"),
        "max_items_in_trans", "ones", (F.lit(total) - F.col("filled")).alias("zero_trans"), "zero_items", density.alias("density"),
    )


def support_set(data: Dataset, items: list[int]) -> DataFrame:
    """tid of the transactions that hold all the items."""
    wanted = sorted(set(items))
    if not wanted:
        return data.transactions.select("tid")
    return data.baskets.filter(F.col("item_id").isin(wanted)).groupBy("tid").agg(F.countDistinct("item_id").alias("n")).filter(F.col("n") == len(wanted)).select("tid")


def closure(data: Dataset, items: list[int]) -> DataFrame:
    """item_id, item of all items that are in every transaction that holds the given ones."""
    held = support_set(data, items)
    size = held.count()
    return data.baskets.join(held, "tid", "left_semi").groupBy("item_id").count().filter(F.col("count") == size).join(data.items, "item_id").select("item_id", "item")


def core_index(data: Dataset, items: list[int]) -> int:
    """The smallest item up to which the set's own items already have the set's support; -1 for the empty set. The set should be closed."""
    wanted = sorted(set(items))
    if not wanted:
        return -1
    whole = support_set(data, wanted).count()
    rows = data.baskets.filter(F.col("item_id").isin(wanted)).groupBy("tid").agg(F.collect_set("item_id").alias("has"))
    # for each transaction the number of leading items that it holds
    lead = F.aggregate(F.array(*[F.array_contains("has", i) for i in wanted]), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, x: F.struct((a["n"] + (a["on"] & x).cast("int")).alias("n"), (a["on"] & x).alias("on")), lambda a: a["n"])
    counts = {r["n"]: r["count"] for r in rows.select(lead.alias("n")).groupBy("n").count().collect()}
    for k, item in enumerate(wanted, 1):
        if sum(c for n, c in counts.items() if n >= k) == whole:
            return item
    return wanted[-1]


def prefix_preserving(data: Dataset, items: list[int], new: int) -> list[int] | None:
    """The closure of items with `new`, or None if it brings an item below `new` that the set lacks."""
    got = sorted(r["item_id"] for r in closure(data, [*items, new]).collect())
    return None if any(i < new and i not in items for i in got) else got
