"""The near-copy stage takes its first pairs from SimHash and its BK-trees; no join broadcasts a row for each text."""

from pyspark.sql import functions as F

from tallyforge.llm import exacthash, simhash


def test_fingerprints_propose_pairs(spark, monkeypatch):
    base = [" ".join(f"w{g}x{i}" for i in range(60)) for g in range(5)]
    texts = [t for b in base for t in (b, b + " w", b.upper())]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen, near = [], simhash.neighbour_roots
    propose = simhash._proposed
    monkeypatch.setattr(simhash, "_proposed", lambda *a: seen.append(propose(*a)) or seen[-1])
    got = {r.id: r.component_id for r in simhash.similar_documents(docs).collect()}
    assert got == {i: i - i % 3 for i in range(15)} and len(seen) == 1
    fps = [simhash.fingerprint(simhash.shingle_hashes(t.encode(), 3)) for t in texts]
    want = sum(0 < (fps[3 * g] ^ fps[3 * g + 1]).bit_count() <= 2 or fps[3 * g] == fps[3 * g + 1] for g in range(5))
    assert seen[0].count() == want and near is simhash.neighbour_roots


def test_classes_are_not_broadcast(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 400).alias("text"))
    found = exacthash.duplicates(docs)
    assert found.filter("kept").count() == 400
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
