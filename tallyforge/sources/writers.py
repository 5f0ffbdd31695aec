"""Datasets and results as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.dataset import Dataset


def to_sparse(data: Dataset, names: bool = False) -> DataFrame:
    """tid, value: a line for each transaction, of its items' numbers from 1 (or their names); empty for an empty transaction."""
    rows = data.baskets.join(data.items, "item_id") if names else data.baskets.withColumn("item", (F.col("item_id") + 1).cast("string"))
    packed = rows.groupBy("tid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "item"))), lambda x: x["item"]), " ").alias("value"))
    return data.transactions.select("tid").join(packed, "tid", "left").select("tid", F.coalesce("value", F.lit("")).alias("value"))


def to_matrix(data: Dataset) -> DataFrame:
    """tid, value: a header with tid -1, then the number of each transaction and a 0 or 1 for each item."""
    spark = data.transactions.sparkSession
    names = [r["item"] for r in data.items.orderBy("item_id").collect()]  # the item universe, one line of the result
    sets = data.baskets.groupBy("tid").agg(F.collect_set("item_id").alias("has"))
    cells = F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda i: F.when(F.array_contains("has", i), "1").otherwise("0")) if names else F.array().cast("array<string>")
    body = data.transactions.select("tid").join(sets, "tid", "left").select("tid", F.coalesce("has", F.array().cast("array<int>")).alias("has")).select(F.col("tid").cast("long").alias("tid"), F.concat_ws(",", F.col("tid").cast("string"), F.array_join(cells, ",")).alias("value"))
    return spark.createDataFrame([(-1, ",".join(["#i", *names]))], "tid long, value string").unionByName(body)


def write_lines(lines: DataFrame, path: str) -> None:
    """Write tid, value as text files in the order of tid, without tid."""
    lines.repartitionByRange("tid").sortWithinPartitions("tid").select("value").write.text(path)


def result_lines(result: DataFrame) -> DataFrame:
    """rank, value: the result table as tab-separated text with a star after rows that are not significant; rank 0 is the header."""

    def short(c: str):
        """Six significant digits without closing zeros."""
        return F.regexp_replace(F.regexp_replace(F.format_string("%.6g", c), r"(\.\d*?)0+(?=e|$)", "$1"), r"\.(?=e|$)", "")

    line = F.concat(F.concat_ws("\t", short("pval"), short("pval_corr"), "sup", "pos_sup", "n_items", F.array_join("items", "\t")), F.when(F.col("significant"), "").otherwise("\t*"))
    head = result.sparkSession.createDataFrame([(0, "\t".join(("pval (raw)", "pval (corr)", "freq", "pos", "# items", "items")))], "rank int, value string")
    return head.unionByName(result.select("rank", line.alias("value")))


def dump_items(data: Dataset) -> DataFrame:
    """item, bits: each item's transactions as text of 0 and 1, the last transaction first, transactions without items left out."""
    from tallyforge.functions.bitset import bits_of, bits_to_string
    from tallyforge.operators.ordering import running_total

    filled = running_total(data.baskets.select("tid").distinct().withColumn("one", F.lit(1)), "tid", "one").select("tid", F.col("before").alias("place"))
    n = filled.count()
    sets = bits_of(data.baskets.join(filled, "tid"), "item_id", "place", n)
    return data.items.join(sets, "item_id").select("item_id", "item", bits_to_string(F.col("words"), n).alias("bits"))


def dump_labels(data: Dataset) -> DataFrame:
    """bits: the positives as text, laid out as in dump_items."""
    filled = data.baskets.select("tid").distinct().join(data.labels, "tid")
    return filled.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("tid", "is_pos")), asc=False), lambda x: x["is_pos"].cast("int").cast("string")), "").alias("bits"))
