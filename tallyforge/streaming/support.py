"""Item supports over a stream of baskets, with late rows bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_support(rows: DataFrame, time: str, tid: str, item: str, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """window, item, sup (distinct transactions in the window) for a batch or streaming DataFrame. Repeated (transaction, item) rows of a window count once."""
    marked = rows.withWatermark(time, late) if rows.isStreaming else rows
    each = marked.select(F.window(time, window).alias("window"), F.col(tid).alias("tid"), F.col(item).cast("string").alias("item"))
    once = each.dropDuplicates(["window", "tid", "item"])  # on a stream the watermark on the window clears this state
    return once.groupBy("window", "item").agg(F.count("*").alias("sup"))
