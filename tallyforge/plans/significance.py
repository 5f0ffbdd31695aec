"""Significant patterns with a family-wise error bound.

Only closed sets whose least possible p-value is small enough can be
significant, so only those count as tests. CS(l) is the number of closed sets of
support l or more, thr(l) the number of tests up to which a set of support l - 1
could still pass. The least support is the largest l at which CS(l) exceeds
thr(l); the correction factor is CS there; a pattern is significant if its
p-value is at most alpha over that factor.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.dataset import Dataset
from tallyforge.functions.stats import TESTS, Test
from tallyforge.operators.closed import Search
from tallyforge.operators.profile import item_support

#: Thresholds are cut off here.
MOST_TESTS = float(1 << 52)


def pmin_table(spark: SparkSession, test: Test, top: int, alpha: float = 0.05) -> DataFrame:
    """x, pmin, log_pmin, thr for supports 0 to top: thr(x) = floor(alpha / pmin(x - 1)) and thr(0) = 0."""
    grid = spark.range(0, top + 1).select(F.col("id").alias("x"), test.pmin(F.col("id")).alias("pmin"), F.when(F.col("id") > 0, F.least(F.coalesce(F.floor(F.try_divide(F.lit(alpha), test.pmin(F.col("id") - 1))).cast("double"), F.lit(MOST_TESTS)), F.lit(MOST_TESTS))).otherwise(0.0).alias("thr"))
    return grid.select("x", "pmin", F.when(F.col("pmin") > 0, F.log("pmin")).otherwise(float("-inf")).alias("log_pmin"), "thr")


def pvalue_table(spark: SparkSession, test: Test, top: int) -> DataFrame:
    """x, t, pval for supports 1 to top and the numbers of positives that they allow."""
    low = F.greatest(F.lit(0).cast("long"), F.col("x") + (test.positive - test.total))
    grid = spark.range(1, top + 1).select(F.col("id").alias("x")).withColumn("t", F.explode(F.sequence(low, F.least("x", F.lit(test.positive).cast("long")))))
    return grid.withColumn("pval", test.pvalue(F.col("x"), F.col("t")))


def item_info(data: Dataset, test: Test) -> DataFrame:
    """item_id, item, sup, pos_sup, pmin, pval of single items, for tests of counts; orderBy("pmin") gives the order of search."""
    return item_support(data).withColumn("pmin", test.pmin(F.col("sup"))).withColumn("pval", F.when(F.col("sup") > 0, test.pvalue(F.col("sup"), F.col("pos_sup"))).otherwise(1.0))


def cumulative(closed: DataFrame) -> DataFrame:
    """sup, sets, cs of closed sets: of each support, and of that support or more. One row a support."""
    hist = closed.groupBy("sup").agg(F.count("*").alias("sets"))
    return hist.withColumn("cs", F.sum("sets").over(Window.orderBy(F.desc("sup")).rowsBetween(Window.unboundedPreceding, 0)))


@dataclass(frozen=True)
class Thresholds:
    """thr as runs of equal values: thr(l) is value[i] for l from first[i] to last[i]. Supports are as many as transactions; runs are few."""

    first: np.ndarray
    last: np.ndarray
    value: np.ndarray

    def exceeded(self, histogram: dict[int, int]) -> int:
        """The largest l >= 1 with CS(l) > thr(l), or 0, from the numbers of closed sets by support."""
        if not histogram:
            return 0
        sups = np.array(sorted(histogram, reverse=True), np.int64)
        cs = np.cumsum([histogram[int(s)] for s in sups])
        # CS falls as l grows, so CS(l) > v holds up to the support at which CS first passes v
        at = np.searchsorted(cs, self.value, "right")
        some = at < len(cs)
        found = np.minimum(self.last[some], sups[at[some]])
        return int(found[found >= self.first[some]].max(initial=0))


def run_starts(spark: SparkSession, test: Test, top: int, alpha: float, n_items: int) -> DataFrame:
    """x, thr where thr differs from that of x - 1, for x from 1 to top. Values are cut off at 2 ** n_items, which no number of sets reaches."""
    most = F.lit(min(MOST_TESTS, float(1 << min(n_items, 52))))

    def thr(x: Column) -> Column:
        return F.least(F.coalesce(F.floor(F.try_divide(F.lit(alpha), test.pmin(x - 1))).cast("double"), most), most)

    x = F.col("id")
    grid = spark.range(1, top + 1).select(x.alias("x"), thr(x).alias("thr"), F.when(x > 1, thr(x - 1)).alias("before"))
    return grid.filter("before IS NULL OR thr <> before").select("x", "thr")


def thresholds(spark: SparkSession, test: Test, top: int, alpha: float, n_items: int) -> Thresholds:
    """Of supports 1 to top; only the runs reach the driver."""
    rows = sorted((r["x"], r["thr"]) for r in run_starts(spark, test, top, alpha, n_items).collect())
    first, value = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float)
    return Thresholds(first, np.append(first[1:] - 1, top)[: len(first)], value)


@dataclass
class Result:
    """patterns: pval, pval_corr, sup, pos_sup, n_items, items, significant, rank. summary: a row of the run's figures. scored: every closed set of the least support or more, with pval."""

    patterns: DataFrame
    summary: DataFrame
    scored: DataFrame
    min_sup: int
    factor: int
    level: float


def score(closed: DataFrame, test: Test) -> DataFrame:
    """closed with pval. Sets of equal counts share one evaluation, except where ranks tell them apart."""
    if test.uses_ranks:
        return closed.withColumn("pval", test.pvalue(F.col("sup"), F.col("pos_sup"), F.col("rank_sum")))
    pairs = closed.select("sup", "pos_sup").distinct().repartition(closed.sparkSession.sparkContext.defaultParallelism)  # few rows, much work each
    pairs = pairs.withColumn("pval", test.pvalue(F.col("sup"), F.col("pos_sup")))
    return closed.join(pairs, ["sup", "pos_sup"]).select("items", "n_items", "sup", "pos_sup", "rank_sum", "pval")


def named(rows: DataFrame, items: DataFrame) -> DataFrame:
    """rows with item names, and the numbers kept as `ids`, for ties."""
    names = items.agg(F.map_from_entries(F.collect_list(F.struct("item_id", "item"))).alias("names"))  # the item universe
    return rows.crossJoin(F.broadcast(names)).withColumn("ids", F.col("items")).withColumn("items", F.transform("items", lambda i: F.col("names")[i])).drop("names")


def order() -> list[Column]:
    """p ascending, more items first, then by item number."""
    return [F.col("pval").asc(), F.col("n_items").desc(), F.col("ids").asc()]


def select_results(scored: DataFrame, level: float, min_results: int = 0, max_results: int = 0) -> DataFrame:
    """scored rows at or below level, in order with rank and significant.

    min_results: the best others follow until there are so many. max_results: no
    more than so many. Both may be given; 0 is no bound.
    """
    if min_results < 0 or max_results < 0 or (max_results and min_results > max_results):
        raise ValueError("bounds must not be negative, nor the lower above the upper")
    flagged = scored.withColumn("significant", F.col("pval") <= level)
    chosen = flagged.filter("significant")
    if min_results:
        rest = flagged.filter("NOT significant").orderBy(*order()).limit(min_results)
        chosen = chosen.unionByName(rest)
    if max_results:
        chosen = chosen.orderBy(*order()).limit(max_results)
    ranked = chosen.withColumn("rank", F.row_number().over(Window.orderBy(*order())))
    return ranked.filter(F.col("significant") | (F.col("rank") <= min_results)) if min_results else ranked


def mine_significant(data: Dataset, test: str = "fisher", alternative: str = "greater", alpha: float = 0.05, min_results: int = 0, max_results: int = 0, broadcast: bool | None = None) -> Result:
    """The whole procedure on labelled transactions."""
    if test not in TESTS:
        raise ValueError(f"test must be one of {sorted(TESTS)}")
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie between 0 and 1")
    if data.labels is None:
        raise ValueError("labels are needed")
    select_results(data.items.sparkSession.createDataFrame([], "pval double, n_items int, ids array<int>"), alpha, min_results, max_results)  # the bounds' check
    data = data.cached()
    total, n = data.counts()
    kind = TESTS[test]
    reverse = kind(total, n, alternative).complements
    data = data.complemented() if reverse else data
    tester = kind(total, total - n if reverse else n, alternative)
    spark = data.items.sparkSession
    n_items = data.items.count()
    search = Search(data.merged(ranks=tester.uses_ranks), n_items, broadcast)
    top = int(data.baskets.groupBy("item_id").count().agg(F.max("count")).first()[0] or 0)
    exceeded = thresholds(spark, tester, top, alpha, n_items).exceeded
    least = exceeded(search.histogram(exceeded))
    closed = search.closed(max(1, least)).persist()
    factor = closed.count() if least else 0
    level = alpha / factor if factor else alpha
    scored = score(closed, tester)
    if reverse:
        scored = scored.withColumn("pos_sup", F.col("sup") - F.col("pos_sup"))
    scored = named(scored, data.items).withColumn("pval_corr", F.col("pval") * max(1, factor))
    patterns = select_results(scored, level, min_results, max_results).select("rank", "pval", "pval_corr", "sup", "pos_sup", "n_items", "items", "significant")
    summary = spark.createDataFrame([(total, n_items, n, top, least, factor, level, test, alternative)], "n_trans long, n_items int, n_pos long, max_x long, min_sup int, correction_factor long, sig_level double, test string, alternative string")
    return Result(patterns, summary, scored, least, factor, level)
