"""What ended steps of the corpus operators leave on disk: no shuffle files, and of tables only those that the result reads."""

import os
import threading
import time

from pyspark.sql import functions as F

from tallyforge.llm import common, exacthash, simhash


def _shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {name for top in dirs for _, _, names in os.walk(top) for name in names if name.startswith("shuffle_")}


def _tables(spark):
    return set(os.listdir(common.shared_root(spark).removeprefix("file:").replace("//", "/")))


def test_stored_leaves_no_shuffle_files(spark):
    before, setting = _shuffle_files(spark), spark.conf.get(common.CLEANUP, None)
    rows = spark.range(20_000).select(F.xxhash64("id").alias("h"), "id").repartition(4, "h")
    table = common.stored(rows.join(rows.groupBy("h").count(), "h"), "rows")
    for _ in range(50):  # executors delete them on their own time
        if not (left := _shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left and table.count() == 20_000
    assert spark.conf.get(common.CLEANUP, None) == setting


def test_stages_leave_only_what_their_result_reads(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("one two three four five six seven eight nine t"), F.col("id") % 200).alias("text"))
    with common.workspace(spark):
        for stage in (exacthash.without_duplicates, lambda d: simhash.without_near_duplicates(d, simhash.similar_documents(d))):
            before = _tables(spark)
            out = stage(docs)
            left = {x.rpartition("-")[0] for x in _tables(spark) - before}
            assert left <= {"decided", "similar", "keys", "distinct", "large", "proposed"}  # one narrow row for each document
            assert out.count() == 200
    twice = docs.union(docs).withColumn("text", F.concat("text", F.lit(" "), F.col("doc_id") % 2))  # identifiers repeat
    with common.workspace(spark):
        before = _tables(spark)
        assert exacthash.without_duplicates(twice).count() == 200
        assert {x.rpartition("-")[0] for x in _tables(spark) - before} == {"decided", "numbered", "best"}


def test_release_leaves_other_threads_tables(spark):
    held = []
    since = common.mark()
    thread = threading.Thread(target=lambda: held.append(common.stored(spark.range(5), "other")))
    thread.start()
    thread.join()
    common.release(spark, since)
    assert held[0].count() == 5


def test_pairs_that_sketches_rule_out_deal_no_sets(spark, monkeypatch):
    apart = [" ".join(f"x{i}y{j}" for j in range(60)) for i in range(10)]
    alike = [" ".join(f"w{j}" for j in range(60)), " ".join(f"w{j}" for j in range(61))]
    docs = spark.createDataFrame([(t,) for t in apart + alike], "text string")
    keys = [simhash._key(simhash._set_of(t.encode(), 5, 42)) for t in apart + alike]
    proposed = spark.createDataFrame([(max(x), min(x)) for x in zip(keys, keys[1:])], "high long, low long")
    seen, made = {}, simhash._made
    monkeypatch.setattr(simhash, "_made", lambda *a: seen.setdefault(a[3], made(*a)))
    found = simhash.similar_links(docs, 12, proposed=proposed)
    assert [set(r) for r in found.collect()] == [set(keys[10:])]
    assert seen["sketch"].count() == 12 and {r.key for r in seen["hashes"].collect()} == set(keys[10:])


def test_roomy_keeps_every_alike_pair(spark):
    import numpy as np

    rng, sets = np.random.default_rng(5), []
    for n in (1, 5, 40, 900, 20_000):
        base = np.unique(rng.integers(0, 1 << 63, 2 * n, np.int64).astype(np.uint64))
        sets += [base[:n], base[n // 9 : n], base[n // 5 : n], base[n // 2 : n + n // 2]]
    rows = [(i, len(h), bytearray(simhash._sketch(h))) for i, h in enumerate(sets) if len(h)]
    sketches = spark.createDataFrame(rows, "key long, n long, sketch binary")
    pairs = [(a, b) for a, *_ in rows for b, *_ in rows if a > b]
    left = {tuple(r) for r in simhash._roomy(spark.createDataFrame(pairs, "high long, low long"), sketches, 0.8).collect()}
    both = {(a, b): len(np.intersect1d(sets[a], sets[b])) for a, b in pairs}
    alike = {(a, b) for (a, b), k in both.items() if k >= 0.8 * (len(sets[a]) + len(sets[b]) - k) - 1e-9}
    assert alike and alike <= left and len(left) < len(pairs) / 2
