"""URL filtering by dated lists: validity intervals and an as-of join.

A list entry adds a key to a list, or removes it, from a day on, until the next
entry for that list and key. Keys are host names, which cover their subdomains,
or whole URLs without query and fragment. A capture is blocked if any of its
keys is active in any list on the day it was fetched.

Intervals are cut by month, so that the join is on key and month and a capture
meets only the few intervals of its month, however long a key's history is; the
range condition decides. Everything is DataFrame operations.

Of entries of one list, key and day an addition wins. Entries without list, key
or day, or with another action than add and remove, are ignored. A capture
without day or URL is not blocked. Repeated captures each have their row, and
either table may be empty. Columns of captures may have any name; one that is
named like a column of the result gives way to it. A host of over HOST_MOST
characters is no host name, so that such a URL only has itself as key, however
long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAR = "9999-12-31"
#: Characters of the longest host name (a limit of the name system).
HOST_MOST = 253
#: Columns that evaluate() adds.
ADDED = ("blocked", "n_active", "matched_key", "matched_list")


def host_of(url: Column) -> Column:
    """The host in lower case, without user, port and closing dot; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"\.$", "")


def keys_of(url: Column) -> Column:
    """The URL without query and fragment, the host, and each parent domain of two labels or more."""
    host = host_of(url)
    labels = F.split(F.when(F.char_length(host) <= HOST_MOST, host).otherwise(""), r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.array_distinct(F.filter(F.concat(F.array(F.regexp_replace(url, r"[?#].*$", "")), parents), lambda k: F.length(k) > 0))


def intervals(entries: DataFrame) -> DataFrame:
    """list, key, since, until (exclusive; FAR while no entry follows) from list, key, action, day."""
    sound = entries.filter("list IS NOT NULL AND key IS NOT NULL AND day IS NOT NULL AND action IN ('add', 'remove')")
    days = sound.groupBy("list", F.lower("key").alias("key"), F.col("day").cast("date").alias("since")).agg(F.max(F.when(F.col("action") == "add", 1).otherwise(0)).alias("added"))
    until = F.lead("since").over(Window.partitionBy("list", "key").orderBy("since"))  # a row a day at most
    return days.withColumn("until", F.coalesce(until, F.lit(FAR).cast("date"))).filter("added = 1").drop("added")


def evaluate(captures: DataFrame, entries: DataFrame, url_col: str = "url", day_col: str = "day") -> DataFrame:
    """captures with blocked, n_active (active list entries that cover it), matched_key and matched_list (the longest key; ties: first by name)."""
    month = lambda c: (F.year(c) * 12 + F.month(c)).cast("int")
    bounds = captures.agg(F.min(F.col(day_col).cast("date")).alias("first"), F.max(F.col(day_col).cast("date")).alias("last"))
    asked = captures.select(F.col(url_col).alias("u"), F.col(day_col).cast("date").alias("d")).filter("u IS NOT NULL AND d IS NOT NULL").distinct()
    asked = asked.select("u", "d", month(F.col("d")).alias("month"), F.explode(F.transform(keys_of(F.col("u")), F.lower)).alias("key"))
    valid = intervals(entries).crossJoin(F.broadcast(bounds)).filter("since <= last AND until > first")  # one row of bounds
    cut = valid.select("list", "key", "since", "until", F.explode(F.sequence(month(F.greatest("since", "first")), month(F.least(F.date_sub("until", 1), F.col("last"))))).alias("month"))
    met = asked.join(cut, ["key", "month"]).filter("since <= d AND d < until")
    best = F.min(F.struct((-F.length("key")).alias("n"), "key", "list")).alias("best")
    verdict = met.groupBy("u", "d").agg(F.count("*").alias("n_active"), best)
    kept = [c for c in captures.columns if c.lower() not in ADDED]
    rows = captures.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row") if kept else F.lit(None).alias("row"), F.col(url_col).alias("u"), F.col(day_col).cast("date").alias("d"))
    joined = rows.join(verdict, ["u", "d"], "left")
    return joined.select(*[F.col("row")[c].alias(c) for c in kept], F.col("n_active").isNotNull().alias("blocked"), F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), F.col("best.key").alias("matched_key"), F.col("best.list").alias("matched_list"))
