"""Transaction files as datasets.

Two formats: a matrix with a header, whose cells count as present unless they
are the text 0; and sparse lines, one transaction each, of item names. Labels
are a name and a text for each transaction. A line's place in its file is its
transaction's number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.dataset import Dataset
from tallyforge.operators.ordering import line_numbers


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return line_numbers(spark.read.text(path), "line").select("line", F.col("value"))


def _cells(line, separators: str):
    return F.filter(F.split(F.trim(F.regexp_replace(line, "[\r\n]", "")), separators), lambda c: c != "")


def read_matrix(spark: SparkSession, path: str) -> Dataset:
    """From a matrix: `#name,item,...` first, then a name and cells in each line, split at commas and spaces. Lines with another number of cells raise an error."""
    rows = _lines(spark, path).select("line", _cells(F.col("value"), "[, ]+").alias("cells")).filter("size(cells) > 0")
    head = rows.filter("line = 0").first()
    if head is None:
        raise ValueError(f"{path} has no header")
    names = head["cells"][1:]
    body = rows.filter("line > 0").select((F.col("line") - 1).alias("tid"), "cells")
    wrong = F.assert_true(F.size("cells") == len(names) + 1, F.concat(F.lit("a line of another length: "), F.array_join("cells", ",")))
    body = body.select("tid", F.when(F.isnull(wrong), F.col("cells")).alias("cells"))
    items = spark.createDataFrame(list(enumerate(names)), "item_id int, item string")
    long = body.select("tid", F.posexplode(F.slice("cells", 2, max(1, len(names)))).alias("item_id", "cell"))
    return Dataset(body.select("tid", F.col("cells")[0].alias("name")), items, long.filter("cell <> '0'").select("tid", "item_id"))


def read_sparse(spark: SparkSession, path: str) -> Dataset:
    """From lines of item names, split at spaces and tabs; an empty line is an empty transaction. Items are numbered in their texts' order."""
    rows = _lines(spark, path).select(F.col("line").alias("tid"), _cells(F.col("value"), "[ \t]+").alias("cells"))
    baskets = rows.select("tid", F.explode("cells").alias("item"))
    whole = Dataset.of(baskets)
    return Dataset(rows.select("tid", F.col("tid").cast("string").alias("name")), whole.items, whole.baskets)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """tid, name, is_pos, value from lines of a name and a text; the first line is a header. Any text but 0 is positive; text that is no number has value 0."""
    rows = _lines(spark, path).filter("line > 0").select((F.col("line") - 1).alias("tid"), _cells(F.col("value"), "[, ]+").alias("cells")).filter("size(cells) > 0")
    text = F.coalesce(F.get("cells", F.lit(1)), F.lit("0"))
    number = F.regexp_extract(text, r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", 0)
    return rows.select("tid", F.col("cells")[0].alias("name"), (text != "0").alias("is_pos"), F.coalesce(number.try_cast("double"), F.lit(0.0)).alias("value"))


def labelled(data: Dataset, labels: DataFrame, by_name: bool = True) -> Dataset:
    """data with labels. Each transaction needs exactly one of its number, and of its name too if by_name."""
    same = data.transactions.join(labels.withColumnRenamed("name", "label_name"), "tid", "full")
    wrong = same.filter(F.col("name").isNull() | F.col("is_pos").isNull() | ((F.col("name") != F.col("label_name")) if by_name else F.lit(False)))
    bad = wrong.limit(1).collect()
    if bad:
        raise ValueError(f"labels and transactions differ: {bad[0].asDict()}")
    return data.with_labels(labels.select("tid", "is_pos", "value"))


def read_dataset(spark: SparkSession, items: str, labels: str | None = None, sparse: bool = False) -> Dataset:
    data = read_sparse(spark, items) if sparse else read_matrix(spark, items)
    return labelled(data, read_labels(spark, labels), by_name=not sparse) if labels else data
