"""Order statistics without a window over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_total(rows: DataFrame, order: str, amount: str) -> DataFrame:
    """rows with `before`: the sum of amount over rows with a smaller `order` value (which must be distinct).

    Rows are dealt by range, summed in each range, and only the ranges' sums are
    added up in one place. The ranges come from a sample and may be merged by
    size, so they are kept: drawn anew for the sums, they could be others.
    """
    dealt = rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id()).persist()
    inside = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn("_local", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    sums = dealt.groupBy("_part").agg(F.sum(amount).alias("_sum"))
    bases = sums.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return local.join(F.broadcast(bases), "_part").withColumn("before", F.col("_base") + F.col("_local")).drop("_part", "_local", "_base")


def line_numbers(rows: DataFrame, name: str = "tid") -> DataFrame:
    """rows with consecutive numbers from 0 in the order in which the source gives them, from counts of each partition."""
    marked = rows.withColumn("_m", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_m", 33))
    sums = marked.groupBy("_part").agg(F.count("*").alias("_n"))
    bases = sums.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return marked.join(F.broadcast(bases), "_part").withColumn(name, F.col("_base") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m", "_part", "_base")
