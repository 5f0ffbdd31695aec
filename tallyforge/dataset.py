"""The data model: baskets of items and a label for each transaction.

baskets: tid, item (string), distinct. labels: tid, is_pos (boolean), value
(double). N and n always come from labels, so a transaction without items still
counts. item order: items by `item_id`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dataset:
    """transactions: tid, name; items: item_id, item; baskets: tid, item_id; labels: tid, is_pos, value (None without labels)."""

    transactions: DataFrame
    items: DataFrame
    baskets: DataFrame
    labels: DataFrame | None = None

    @classmethod
    def of(cls, baskets: DataFrame, labels: DataFrame | None = None, tid: str = "tid", item: str = "item") -> Dataset:
        """From (tid, item) rows and optionally (tid, is_pos and/or value) rows. Null items are none; items get numbers by their text's order."""
        rows = baskets.select(F.col(tid).alias("tid"), F.col(item).cast("string").alias("item"))
        found = rows.filter("item IS NOT NULL").distinct()
        items = found.select("item").distinct().select((F.row_number().over(Window.orderBy("item")) - 1).cast("int").alias("item_id"), "item")  # the item universe
        if labels is not None:
            value = F.col("value").cast("double") if "value" in labels.columns else F.col("is_pos").cast("double")
            is_pos = F.col("is_pos").cast("boolean") if "is_pos" in labels.columns else F.col("value") != 0
            labels = labels.select(F.col(tid).alias("tid"), F.coalesce(is_pos, F.lit(False)).alias("is_pos"), F.coalesce(value, F.lit(0.0)).alias("value"))
        transactions = (labels if labels is not None else rows).select("tid").distinct().select("tid", F.col("tid").cast("string").alias("name"))
        return cls(transactions, items, found.join(items, "item").select("tid", "item_id"), labels)

    def with_labels(self, labels: DataFrame) -> Dataset:
        return Dataset(self.transactions, self.items, self.baskets, labels)

    def cached(self) -> Dataset:
        """The same, with items, baskets and labels kept (in memory, else on disk) for plans that read them several times."""
        return Dataset(self.transactions, self.items.persist(), self.baskets.persist(), self.labels if self.labels is None else self.labels.persist())

    def complemented(self) -> Dataset:
        """Labels turned round: negatives become positives."""
        return self.with_labels(self.labels.withColumn("is_pos", ~F.col("is_pos")))

    def counts(self) -> tuple[int, int]:
        """(N, n)."""
        source = self.labels if self.labels is not None else self.transactions.withColumn("is_pos", F.lit(False))
        row = source.agg(F.count("*").alias("total"), F.coalesce(F.sum(F.col("is_pos").cast("long")), F.lit(0)).alias("positive")).first()
        return int(row["total"]), int(row["positive"])

    def mid_ranks(self) -> DataFrame:
        """tid, rank: the mean rank of a transaction's value among all, from counts of the distinct values, so that no window holds all rows."""
        values = self.labels.groupBy("value").agg(F.count("*").alias("same"))
        parts = values.withColumn("part", F.spark_partition_id())
        from tallyforge.operators.ordering import running_total

        ranked = running_total(parts.drop("part"), "value", "same")
        return self.labels.join(ranked.select("value", (F.col("before") + (F.col("same") + 1) / 2).alias("rank")), "value").select("tid", "rank")

    def merged(self, ranks: bool = False) -> DataFrame:
        """items (sorted array of item_id), n, n_pos, rank_sum for each distinct transaction, with partial sums before the shuffle. Empty transactions are left out."""
        sets = self.baskets.groupBy("tid").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
        if self.labels is None:
            sets = sets.withColumn("is_pos", F.lit(False))
        else:
            sets = sets.join(self.labels.select("tid", "is_pos"), "tid")
        sets = sets.join(self.mid_ranks(), "tid") if ranks else sets.withColumn("rank", F.lit(0.0))
        return sets.groupBy("items").agg(F.count("*").alias("n"), F.sum(F.col("is_pos").cast("long")).alias("n_pos"), F.sum("rank").alias("rank_sum"))
