"""Connected components of a link table.

Every partition first reduces its own links to a spanning forest of stars. Up to
MOST_IN_TASK links that remain, a checked number, one task joins those; beyond
that they are joined by alternating large and small stars. There, each step is an aggregation to a minimum, with partial minima before the shuffle,
and a join; a node that holds a large share of all links is dealt to many parts
of that join. The links never leave the cluster. Every step is written to the
shared folder. Links without one of their nodes are left out.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import stored

#: Links that one task joins at most: 16 MB.
MOST_IN_TASK = 1_000_000
#: Parts to which a node's links are dealt if they are more than that fraction of all.
PARTS = 64


def _joined(links: DataFrame, least: DataFrame, node: str) -> DataFrame:
    """links with the `least` of their node; least: node, least, n (its links)."""
    least = stored(least, "least")
    total = least.agg(F.sum("n")).first()[0] or 0
    hot = [r[0] for r in least.filter(F.col("n") * PARTS > total).select(node).collect()]  # fewer than PARTS, as each holds more than a PARTS-th
    if not hot:
        return links.join(least.drop("n"), node)
    of_hot = F.col(node).isin(hot)
    dealt = links.withColumn("part", F.when(of_hot, F.pmod(F.xxhash64("high", "low"), F.lit(PARTS)).cast("int")).otherwise(0))
    copies = least.drop("n").withColumn("part", F.explode(F.when(of_hot, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(copies, [node, "part"]).drop("part")


def _large(links: DataFrame) -> DataFrame:
    """Join every larger neighbour of a node to the smallest node around it."""
    both = links.unionByName(links.select(F.col("low").alias("high"), F.col("high").alias("low")))
    least = both.groupBy(F.col("high").alias("low")).agg(F.min(F.least("high", "low")).alias("least"), F.count("*").alias("n"))
    return _joined(links, least, "low").select("high", F.col("least").alias("low")).distinct()


def _small(links: DataFrame) -> DataFrame:
    """Join a node and its smaller neighbours to the smallest of them."""
    least = links.groupBy("high").agg(F.min("low").alias("least"), F.count("*").alias("n"))
    moved = _joined(links, least, "high").filter("low <> least").select(F.col("low").alias("high"), F.col("least").alias("low"))
    return moved.unionByName(least.select("high", F.col("least").alias("low"))).distinct()


def _forest(batches):
    """The links of a task as stars: every linked node but the smallest of its group, with that smallest."""
    root: dict = {}

    def find(x):
        top = x
        while root.get(top, top) != top:
            top = root[top]
        while root.get(x, x) != top:
            root[x], x = top, root[x]
        return top

    names, kinds = ["high", "low"], None
    for batch in batches:
        kinds = [batch.schema.field(n).type for n in names]
        for pair in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
            a, b = map(find, pair)
            if a != b:
                root[max(a, b)] = min(a, b)
    nodes = list(root)
    for at in range(0, len(nodes), 10_000):
        part = nodes[at : at + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, kinds[0]), pa.array([find(x) for x in part], kinds[1])], names)


def components(links: DataFrame) -> DataFrame:
    """(high, low): every linked node but the smallest of its component, with that smallest.

    links: (high, low) of one orderable type with high > low; repeated links and
    an empty table are allowed.
    """
    sound = links.select("high", "low").filter("high IS NOT NULL AND low IS NOT NULL")
    links = stored(sound.mapInArrow(_forest, sound.schema), "links")
    if links.count() <= MOST_IN_TASK:
        return stored(links.coalesce(1).mapInArrow(_forest, links.schema), "links")
    seen = None
    while True:
        links = stored(_small(stored(_large(links), "links")), "links")
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64("high", "low"))).first()
        if now == seen or not now[0]:
            return links
        seen = now
