"""Itemsets as sorted arrays of item numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def push(items: Column, item: Column | int) -> Column:
    """items with one more, sorted, each item once."""
    return F.array_sort(F.array_union(items, F.array(F.lit(item) if isinstance(item, int) else item)))


def merge(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def remove(items: Column, item: Column | int) -> Column:
    return F.array_remove(items, item)


def contains(items: Column, item: Column | int) -> Column:
    return F.array_contains(items, item)


def children(items: Column, n_items: int) -> Column:
    """The items that are not in the set."""
    return F.array_except(F.sequence(F.lit(0), F.lit(n_items - 1)), items) if n_items else F.array().cast("array<int>")
