"""Closed itemsets by prefix-preserving extension.

A set is closed if no further item is in all its transactions. Every closed set
is reached once: from its parent by one item above the parent's core, if the
closure brings no item below that one.

Transactions with equal items are merged first, with their counts, positives and
rank sums, so one kernel serves every test. Where the merged table is small
(checked), it is broadcast and subtrees are searched in parallel tasks. Beyond
that the table stays where it is: level by level, a block of candidate sets goes
to all partitions, each returns its counts, and these are summed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows, and cells (rows x items, one byte each), up to which the merged table is broadcast.
MOST_ROWS, MOST_CELLS = 500_000, 64 << 20
#: Candidate sets that go to the partitions at once.
BLOCK = 4096
SCHEMA = "items array<int>, n_items int, sup long, pos_sup long, rank_sum double"
NAMES = ["items", "n_items", "sup", "pos_sup", "rank_sum"]


class Matrix:
    """Merged transactions: has[row, item], and the sums of each row."""

    def __init__(self, n_items: int, sets: list[list[int]], n, n_pos, rank_sum):
        self.has = np.zeros((len(sets), n_items), bool)
        if sets:
            self.has[np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate([np.asarray(s, np.int64) for s in sets])] = True
        self.n, self.n_pos, self.rank_sum = np.asarray(n, np.int64), np.asarray(n_pos, np.int64), np.asarray(rank_sum, float)

    def counts(self, rows: np.ndarray) -> np.ndarray:
        """The support of each item within some rows."""
        return self.n[rows] @ self.has[rows]

    def search(self, least: int, roots: list[int], visit: Callable, bound: Callable[[], int] | None = None) -> None:
        """Depth-first over the subtrees of `roots`. visit(items, sup, pos_sup, rank_sum) is called for each closed set; bound() may raise the least support as the search goes."""
        n_items = self.has.shape[1]
        low = bound or (lambda: least)
        stack = [(np.arange(len(self.n)), np.zeros(n_items, bool), int(i)) for i in roots]
        while stack:
            rows, prefix, item = stack.pop()
            rows = rows[self.has[rows, item]]
            sup = int(self.n[rows].sum())
            if sup < low() or sup < 1:
                continue
            counts = self.counts(rows)
            closure = counts == sup
            if (closure[:item] & ~prefix[:item]).any():
                continue
            visit(np.flatnonzero(closure).tolist(), sup, int(self.n_pos[rows].sum()), float(self.rank_sum[rows].sum()))
            for j in np.flatnonzero(~closure & (counts >= max(1, low()))):
                if j > item:
                    stack.append((rows, closure, int(j)))


def _collected(merged: DataFrame, n_items: int) -> Matrix | None:
    """The matrix, if it is within MOST_CELLS."""
    most = min(MOST_ROWS, MOST_CELLS // max(1, n_items))
    rows = merged.limit(most + 1).toPandas()
    if len(rows) > most:
        return None
    return Matrix(n_items, [list(x) for x in rows["items"]], rows["n"], rows["n_pos"], rows["rank_sum"])


class Seen:
    """Numbers of closed sets by support, and the least support that can still matter, which rises as sets come."""

    def __init__(self, low: int, exceeds: Callable[[dict[int, int]], int] | None = None):
        self.low, self.exceeds, self.held, self.due = low, exceeds, {}, 1

    def add(self, sup: int) -> None:
        self.held[sup] = self.held.get(sup, 0) + 1
        self.due -= 1
        if not self.due:
            self.raised()

    def raised(self) -> None:
        """Asked again after a sixteenth more sets: a low bound that comes late only leaves more sets in."""
        if self.exceeds:
            self.low = max(self.low, self.exceeds(self.held))
            self.held = {s: n for s, n in self.held.items() if s >= self.low}
        self.due = 1 + sum(self.held.values()) // 16

    def counts(self) -> dict[int, int]:
        self.raised()
        return self.held


class Search:
    """Searches over one merged table."""

    def __init__(self, merged: DataFrame, n_items: int, broadcast: bool | None = None):
        self.spark, self.n_items = merged.sparkSession, n_items
        self.merged = merged.persist()
        matrix = _collected(self.merged, n_items) if broadcast is not False else None
        self.shared = self.spark.sparkContext.broadcast(matrix) if matrix else None
        self.roots = self.spark.createDataFrame([(i,) for i in range(n_items)], "item int").repartition(max(1, min(n_items, 4 * self.spark.sparkContext.defaultParallelism)), "item")

    def histogram(self, exceeds: Callable[[dict[int, int]], int] | None = None) -> dict[int, int]:
        """How many closed sets have each support.

        exceeds(counts by support) gives the highest support at which the number
        of sets is already too large, or 0; sets below it may then be left out.
        Counts at and above the highest such support are exact.
        """
        if not self.shared:
            return self._by_level(1, lambda *a: None, Seen(1, exceeds))
        shared = self.shared

        def work(batches):
            roots = [i for b in batches for i in b.column(0).to_pylist()]
            if roots:
                seen = Seen(1, exceeds)
                shared.value.search(1, roots, lambda items, sup, pos, ranks: seen.add(sup), lambda: seen.low)
                sets = seen.counts()
                yield pa.RecordBatch.from_pydict({"sup": pa.array([*sets, 0], pa.int64()), "sets": pa.array([*sets.values(), 0], pa.int64()), "low": pa.array([seen.low] * (len(sets) + 1), pa.int64())})

        found = self.roots.mapInArrow(work, "sup long, sets long, low long").groupBy("sup").agg(F.sum("sets").alias("sets"), F.max("low").alias("low")).collect()  # one row a support
        low = max((r["low"] for r in found), default=1)
        return {r["sup"]: r["sets"] for r in found if r["sup"] >= low}

    def closed(self, least: int) -> DataFrame:
        """All closed sets of at least one item with support >= least."""
        if not self.shared:
            return self._levels(least)
        shared = self.shared

        def work(batches):
            roots = [i for b in batches for i in b.column(0).to_pylist()]
            out: list[tuple] = []
            for root in roots:
                shared.value.search(least, [root], lambda items, sup, pos, ranks: out.append((items, len(items), sup, pos, ranks)))
                while len(out) >= 10_000:
                    yield _batch(out[:10_000])
                    del out[:10_000]
            if out:
                yield _batch(out)

        return self.roots.mapInArrow(work, SCHEMA)

    # the distributed way

    def _counted(self, block: list[tuple[int, ...]]) -> Iterator[tuple]:
        """(number in block, sup, pos, ranks, counts of all items) of candidate sets, summed over the partitions."""
        n_items = self.n_items
        sets = self.spark.sparkContext.broadcast(block)

        def work(batches):
            total = None
            for b in batches:
                m = Matrix(n_items, b.column(0).to_pylist(), *(b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3)))
                if total is None:
                    total = np.zeros((len(sets.value), n_items + 3))
                for k, s in enumerate(sets.value):
                    rows = np.flatnonzero(m.has[:, list(s)].all(1))
                    if len(rows):
                        total[k, :n_items] += m.counts(rows)
                        total[k, n_items:] += m.n[rows].sum(), m.n_pos[rows].sum(), m.rank_sum[rows].sum()
            if total is not None:
                k, i = np.nonzero(total)
                yield pa.RecordBatch.from_pydict({"k": k.astype(np.int32), "i": i.astype(np.int32), "c": total[k, i]})

        sums = self.merged.mapInArrow(work, "k int, i int, c double").groupBy("k", "i").agg(F.sum("c").alias("c"))
        packed = sums.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("i", "c"))).alias("m"))
        for r in packed.toLocalIterator():  # a block
            row = np.zeros(n_items + 3)
            row[list(r["m"])] = list(r["m"].values())
            yield r["k"], int(row[n_items]), int(row[n_items + 1]), float(row[n_items + 2]), row[:n_items].astype(np.int64)

    def _by_level(self, least: int, visit: Callable, seen: Seen | None = None) -> dict[int, int]:
        low = least
        stack = [((i,), (), i) for i in range(self.n_items - 1, -1, -1)]
        while stack:
            block, stack = stack[-BLOCK:], stack[:-BLOCK]
            for k, sup, pos, ranks, counts in self._counted([b[0] for b in block]):
                candidate, prefix, item = block[k]
                closure = np.flatnonzero(counts == sup).tolist()
                if sup < max(1, low) or any(c < item and c not in prefix for c in closure):
                    continue
                visit(closure, sup, pos, ranks)
                if seen:
                    seen.add(sup)
                    low = seen.low
                stack += [((*closure, int(j)), tuple(closure), int(j)) for j in np.flatnonzero(counts >= low)[::-1] if j > item and j not in closure]
        return seen.counts() if seen else {}

    def _levels(self, least: int) -> DataFrame:
        """The sets of the level-wise search, kept in blocks so that the driver holds no more than a block and its frontier."""
        parts, held = [], []

        def visit(items, sup, pos, ranks):
            held.append((items, len(items), sup, pos, ranks))
            if len(held) >= 100_000:
                parts.append(self._frame(held))
                held.clear()

        self._by_level(least, visit)
        out = self._frame(held)
        for p in parts:
            out = out.unionByName(p)
        return out

    def _frame(self, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(pa.Table.from_batches([_batch(rows)])).select(*[F.col(c).cast(t) for c, t in zip(NAMES, ("array<int>", "int", "long", "long", "double"), strict=True)]) if rows else self.spark.createDataFrame([], SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.list_(pa.int32()), pa.int32(), pa.int64(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], NAMES)


def closed_itemsets(merged: DataFrame, n_items: int, least: int = 1, broadcast: bool | None = None) -> DataFrame:
    """items, n_items, sup, pos_sup, rank_sum of all closed sets of at least one item with support >= least."""
    return Search(merged, n_items, broadcast).closed(least)
