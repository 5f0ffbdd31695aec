"""What grows with the number of transactions stays off the driver, and ranks do not hang on how rows are dealt."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from tallyforge.dataset import Dataset
from tallyforge.functions.stats import TESTS
from tallyforge.operators.ordering import running_total
from tallyforge.plans import significance
from tallyforge.plans.topk import topk_itemsets


@pytest.fixture
def collected(monkeypatch):
    """The number of rows of each collect()."""
    sizes, collect = [0], DataFrame.collect

    def spy(self):
        rows = collect(self)
        sizes.append(len(rows))
        return rows

    monkeypatch.setattr(DataFrame, "collect", spy)
    return sizes


@pytest.fixture(scope="module")
def many(spark):
    rows = spark.range(3000).select(F.col("id").alias("tid"), F.explode(F.array(F.lit("all"), F.concat(F.lit("i"), F.col("id") % 3))).alias("item")).filter("item <> 'all' OR tid > 2")
    return Dataset.of(rows, spark.range(3000).select(F.col("id").alias("tid"), (F.col("id") % 7 < 3).alias("is_pos")))


def test_thresholds_reach_the_driver_as_runs(many, collected):
    assert significance.mine_significant(many).summary.first().max_x == 2997
    assert max(collected) < 100


def test_topk_reaches_the_driver_as_rows_of_k(many, collected):
    assert topk_itemsets(many, 2).count() == 2
    assert max(collected) < 100


@pytest.mark.parametrize("test", sorted(TESTS))
def test_runs_of_thresholds(spark, test):
    """Runs against every single threshold, with the definition of the least support."""
    tester, rng = TESTS[test](300, 120), random.Random(3)
    table = significance.pmin_table(spark, tester, 300, 0.05).orderBy("x").toPandas().thr.to_numpy()
    runs = significance.thresholds(spark, tester, 300, 0.05, 12)
    for _ in range(200):
        hist = {rng.randint(1, 300): rng.randint(1, 200) for _ in range(rng.randint(0, 12))}
        cs = np.array([sum(n for s, n in hist.items() if s >= l) for l in range(301)])
        over = np.flatnonzero(cs[1:] > table[1:]) + 1
        assert runs.exceeded(hist) == max(over, default=0)


def test_exact_test_of_millions(spark):
    total, n, x = 9_000_000, 4_000_000, 2_000_000
    lf = lambda k: math.lgamma(k + 1)
    pmf = lambda a: math.exp(lf(n) - lf(a) - lf(n - a) + lf(total - n) - lf(x - a) - lf(total - n - x + a) - lf(total) + lf(x) + lf(total - x))
    mean = x * n // total
    one = spark.range(1).select(TESTS["fisher"](total, n).pvalue(F.lit(x).cast("long"), F.lit(mean + 900).cast("long")), TESTS["fisher"](total, n).pvalue(F.lit(x).cast("long"), F.lit(mean + 200_000).cast("long")), TESTS["fisher"](total, n).pvalue(F.lit(x).cast("long"), F.lit(0).cast("long")))
    some, none, whole = one.first()
    assert some == pytest.approx(sum(pmf(a) for a in range(mean + 900, mean + 30_000)), rel=1e-5)
    assert none == 0 and whole == pytest.approx(1, rel=1e-6)


def test_running_total_when_ranges_are_drawn_twice(spark):
    conf = {"spark.sql.exchange.reuse": "false", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = spark.range(200_000).select((F.xxhash64("id") % F.lit(10**12)).alias("v")).groupBy("v").agg(F.count("*").alias("same"))
        got = running_total(rows, "v", "same").select("v", "before").toPandas().sort_values("v")
        assert (got.before.to_numpy() == range(len(got))).all()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
