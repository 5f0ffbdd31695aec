"""Hypothesis tests as column expressions.

A test knows N transactions, n of which are positive. For a pattern of support
x with t positives it gives a p-value, and for x alone the least p-value that
any pattern of that support could have. `alternative` is "greater", "less" or
"two.sided"; for "less" the first two tests count negatives instead.

A pattern present in every transaction cannot be tested: its p-value and bound
are 1. "less" of the rank test is the lower tail, one minus "greater".
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

ALTERNATIVES = ("greater", "less", "two.sided")


def log_gamma(z: Column) -> Column:
    """ln Γ(z) for z >= 1: Stirling's series at z + 8, and down by the recurrence."""
    y = z + 8.0
    # Bernoulli numbers over 2k (2k - 1).
    series = sum((F.lit(c) / F.pow(y, F.lit(float(p))) for c, p in ((1 / 12, 1), (-1 / 360, 3), (1 / 1260, 5), (-1 / 1680, 7), (1 / 1188, 9))), F.lit(0.0))
    steps = F.lit(0.0)
    for k in range(8):
        steps = steps + F.log(z + float(k))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - steps


def log_factorial(k: Column) -> Column:
    return log_gamma(k.cast("double") + 1.0)


def log_hypergeometric(a: Column, x: Column, total: int, positive: int) -> Column:
    """ln of the probability that x of `total` transactions hold a of the `positive` ones."""
    lf = log_factorial
    n, m = F.lit(positive), F.lit(total - positive)
    return lf(n) - lf(a) - lf(n - a) + lf(m) - lf(x - a) - lf(m - x + a) - lf(F.lit(total)) + lf(x) + lf(F.lit(total) - x)


def normal_tail(z: Column) -> Column:
    """P(Z > |z|): below 3 a half less the Taylor series of the distribution function over the density, from there Laplace's continued fraction. From 39 on the density is below the least double, so 0."""
    y = F.abs(z)
    density = F.exp(-y * y / 2) / math.sqrt(2 * math.pi)
    zero = F.struct(y.alias("term"), y.alias("sum"))

    def add(acc: Column, k: Column) -> Column:
        term = acc["term"] * y * y / (2.0 * k + 1)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(50)), zero, add, lambda acc: acc["sum"])
    fraction = F.aggregate(F.sequence(F.lit(80), F.lit(1), F.lit(-1)), y, lambda x, k: y + k / x)
    return F.when(y < 3, 0.5 - density * series).when(y < 39, density / fraction).otherwise(0.0)


@dataclass(frozen=True)
class Test:
    """total, positive: N and n. Positives are already complemented where the test counts negatives."""

    total: int
    positive: int
    alternative: str = "greater"
    name = ""
    uses_ranks = False

    def __post_init__(self):
        if self.alternative not in ALTERNATIVES:
            raise ValueError(f"alternative must be one of {ALTERNATIVES}")

    @property
    def complements(self) -> bool:
        """Whether negatives are counted as positives."""
        return self.alternative == "less" and not self.uses_ranks

    def pmin(self, x: Column) -> Column:
        raise NotImplementedError

    def pvalue(self, x: Column, t: Column, rank_sum: Column | None = None) -> Column:
        raise NotImplementedError


class Fisher(Test):
    """Fisher's exact test."""

    name = "fisher"

    def pmin(self, x: Column) -> Column:
        k = F.least(x, F.lit(self.positive))
        bound = F.exp(log_factorial(F.lit(self.positive)) - log_factorial(F.lit(self.positive) - k) - log_factorial(F.lit(self.total)) + log_factorial(F.lit(self.total) - k))
        return F.when((x <= 0) | (x >= self.total), 1.0).otherwise(F.least(bound, F.lit(1.0)))

    def pvalue(self, x: Column, t: Column, rank_sum: Column | None = None) -> Column:
        """The first table's logarithm comes from factorials, each next one's from its ratio to the one before.

        Tables further than `reach` from the mean have a probability below
        exp(-800) by Hoeffding's bound, which as a double is 0; they are not
        visited, as with millions of transactions nearly all are such.
        """
        mean, reach = x * (self.positive / max(1, self.total)), 20 * F.sqrt(F.least(x, F.lit(self.positive)).cast("double"))
        low = F.greatest(F.lit(0), x + (self.positive - self.total), F.floor(mean - reach))
        high = F.least(x, F.lit(self.positive), F.ceil(mean + reach))
        first = low if self.alternative == "two.sided" else F.greatest(t, low)
        own = log_hypergeometric(t, x, self.total, self.positive)
        # tables up to 1e-16 likelier than the own one count as no likelier, as results have to follow that rule
        most = F.log(F.exp(own) * (1 + 1e-7) + 1e-16) if self.alternative == "two.sided" else F.lit(math.inf)
        lead = F.struct(log_hypergeometric(first, x, self.total, self.positive).alias("log"), most.alias("most"))

        def tail(start: Column) -> Column:
            begin = F.struct(start["log"].alias("log"), F.when(start["log"] <= start["most"], F.exp(start["log"])).otherwise(0.0).alias("sum"))

            def step(acc: Column, a: Column) -> Column:
                ratio = F.log((self.positive - a + 1.0) * (x - a + 1.0) / (a * (self.total - self.positive - x + a * 1.0)))
                now = acc["log"] + ratio
                return F.struct(now.alias("log"), (acc["sum"] + F.when(now <= start["most"], F.exp(now)).otherwise(0.0)).alias("sum"))

            steps = F.when(first < high, F.sequence(first + 1, high)).otherwise(F.array().cast("array<bigint>"))
            return F.aggregate(steps, begin, step, lambda acc: acc["sum"])

        total = F.transform(F.array(lead), tail)[0]
        return F.when(x >= self.total, 1.0).otherwise(F.least(total, F.lit(1.0)))


class ChiSquared(Test):
    """Pearson's test of the 2 x 2 table with one degree of freedom; where an expected count is under 5, every cell's deviation is reduced by a half."""

    name = "chi"

    def _tail(self, x: Column, t: Column) -> Column:
        n, m, total = float(self.positive), float(self.total - self.positive), float(self.total)
        x, t = x.cast("double"), t.cast("double")
        cells = [(t, x * n / total), (x - t, x * m / total), (n - t, (total - x) * n / total), (m - x + t, (total - x) * m / total)]
        few = cells[0][1] < 5
        for _, expected in cells[1:]:
            few = few | (expected < 5)
        chi = F.lit(0.0)
        for seen, expected in cells:
            chi = chi + F.pow(F.abs(seen - expected) - F.when(few, 0.5).otherwise(0.0), F.lit(2.0)) / expected
        return F.when(chi == 0, 1.0).otherwise(normal_tail(F.sqrt(chi)))

    def _fits(self, x: Column, t: Column) -> Column:
        return (x <= 0) | (x >= self.total) | (F.lit(self.positive) <= 0) | (F.lit(self.positive) >= self.total)

    def pmin(self, x: Column) -> Column:
        most = F.least(x, F.lit(self.positive))
        p = F.least(self._tail(x, most), self._tail(x, F.lit(0)))
        p = F.least(2 * p, F.lit(1.0)) if self.alternative == "two.sided" else p
        return F.when(self._fits(x, most), 1.0).otherwise(p)

    def pvalue(self, x: Column, t: Column, rank_sum: Column | None = None) -> Column:
        p = self._tail(x, t)
        p = F.least(2 * p, F.lit(1.0)) if self.alternative == "two.sided" else F.when(t < F.least(x, F.lit(self.positive)) / 2, 1 - p).otherwise(p)
        return F.when(self._fits(x, t), 1.0).otherwise(p)


class RankSum(Test):
    """Mann-Whitney's U by mid-ranks, normal approximation without corrections. rank_sum: of the transactions that hold the pattern."""

    name = "u_test"
    uses_ranks = True

    def _moments(self, x: Column) -> tuple[Column, Column]:
        rest = F.lit(float(self.total)) - x
        return x * rest / 2, x * rest * (self.total + 1.0) / 12

    def pmin(self, x: Column) -> Column:
        mean, variance = self._moments(x.cast("double"))
        return F.when((x <= 0) | (x >= self.total), 1.0).otherwise(normal_tail(mean / F.sqrt(variance)))

    def pvalue(self, x: Column, t: Column, rank_sum: Column | None = None) -> Column:
        mean, variance = self._moments(x.cast("double"))
        z = (rank_sum - x * (x + 1.0) / 2 - mean) / F.sqrt(variance)
        tail = normal_tail(z)
        if self.alternative == "two.sided":
            p = F.least(2 * tail, F.lit(1.0))
        else:
            p = F.when(z < 0, 1 - tail).otherwise(tail)
            p = 1 - p if self.alternative == "less" else p
        return F.when((x <= 0) | (x >= self.total), 1.0).otherwise(p)


TESTS = {t.name: t for t in (Fisher, ChiSquared, RankSum)}
