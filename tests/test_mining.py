"""The worked examples, brute force over random tables, and the queries against DuckDB."""

import itertools
import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyforge.dataset import Dataset
from tallyforge.functions import bitset, itemset
from tallyforge.functions.stats import TESTS, normal_tail
from tallyforge.operators import profile
from tallyforge.operators.closed import closed_itemsets
from tallyforge.plans.significance import mine_significant, select_results
from tallyforge.plans.topk import topk_itemsets
from tallyforge.sources import readers, writers
from tallyforge.streaming.support import windowed_support

# The toy table, its labels and its results.
TOY = {"A": "1110", "B": "1110", "C": "1001", "D": "0000", "E": "1110", "F": "1000", "G": "1111", "H": "0000", "I": "0101", "J": "0010", "K": "0001", "L": "0001", "M": "0001", "N": "1110", "O": "0000"}
POSITIVE = "ABEGHMN"
PIPELINE = {
    ("fisher", "greater"): (5, 5, [0.00699301]), ("fisher", "two.sided"): (5, 5, [0.00699301]), ("fisher", "less"): (6, 4, []),
    ("chi", "greater"): (5, 5, [0.00868558]), ("chi", "two.sided"): (6, 4, []), ("chi", "less"): (5, 5, []),
    ("u_test", "greater"): (3, 5, [0.00715294]), ("u_test", "two.sided"): (3, 5, []), ("u_test", "less"): (3, 5, []),
}
# The seven transactions of the closure example.
SEVEN = ["123456", "235", "25", "12456", "24", "146", "346"]


@pytest.fixture(scope="module")
def toy(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("toy")
    (d / "items.csv").write_text("#gene,TF1,TF2,TF3,TF4\n" + "".join(f"{k}, {','.join(v)}\n" for k, v in TOY.items()))
    (d / "labels.csv").write_text("#gene,expression\n" + "\n".join(f"{k},{int(k in POSITIVE)}" for k in TOY))
    return readers.read_dataset(spark, str(d / "items.csv"), str(d / "labels.csv"))


def test_profile(toy):
    row = profile.summary(toy).first()
    assert (row.n_trans, row.n_items, row.n_pos, row.max_x, row.max_t, row.max_items_in_trans, row.ones, row.zero_trans, row.zero_items) == (15, 4, 7, 7, 5, 4, 25, 3, 0)
    assert row.density == pytest.approx(25 / 48)
    assert [(r.sup, r.pos_sup) for r in profile.item_support(toy).orderBy("item_id").collect()] == [(7, 5), (6, 5), (6, 5), (6, 2)]
    assert {r.least: r["items"] for r in profile.reduced_item_counts(toy).collect()} == dict.fromkeys(range(1, 7), 4) | {7: 1}
    assert profile.reduced_items(toy, 7).count() == 1
    assert sorted(r.name for r in profile.zero_transactions(toy).collect()) == ["D", "H", "O"]
    assert profile.support_set(toy, [0, 1, 2]).count() == 5
    assert profile.prefix_preserving(toy, [0], 2) is None
    assert [r.bits for r in writers.dump_items(toy).orderBy("item_id").collect()] == ["100000111111", "100001101011", "100010101011", "011101100100"]
    assert writers.dump_labels(toy).first().bits == "110000101011"


@pytest.mark.parametrize("broadcast", [None, False])
def test_toy_pipeline(toy, broadcast):
    for (test, alternative), (least, factor, values) in PIPELINE.items() if broadcast is None else [(("fisher", "greater"), PIPELINE["fisher", "greater"])]:
        r = mine_significant(toy, test, alternative, broadcast=broadcast)
        assert (r.min_sup, r.factor) == (least, factor), (test, alternative)
        got = r.patterns.collect()
        assert [x.pval for x in got] == pytest.approx(values, abs=1e-7)
        if got:
            assert (got[0]["items"], got[0].sup, got[0].pos_sup) == (["TF1", "TF2", "TF3"], 5, 5)
            assert got[0].pval_corr == pytest.approx(values[0] * factor, abs=1e-6)


def test_policies(toy, spark):
    found = mine_significant(toy, min_results=3).patterns.orderBy("rank").collect()
    assert [x.significant for x in found] == [True, False, False]
    assert [r.value.endswith("*") for r in writers.result_lines(mine_significant(toy, min_results=2).patterns).orderBy("rank").collect()] == [False, False, True]
    assert mine_significant(toy, alpha=0.9, max_results=2).patterns.count() == 2
    for low, high in ((-1, 0), (0, -1), (3, 2)):
        with pytest.raises(ValueError):
            select_results(spark.createDataFrame([], "pval double, n_items int, ids array<int>"), 0.1, low, high)
    for bad in ({"test": "t"}, {"alternative": "up"}, {"alpha": 1.5}):
        with pytest.raises(ValueError):
            mine_significant(toy, **bad)


def test_topk(toy):
    assert [x["items"] for x in topk_itemsets(toy, 3).orderBy("rank").collect()] == [["TF1", "TF2", "TF3"], ["TF2"], ["TF3"]]
    for broadcast in (None, False):
        got = topk_itemsets(toy, 5, closed=False, broadcast=broadcast).orderBy("rank").collect()
        assert [x["items"] for x in got] == [["TF1", "TF2", "TF3"], ["TF1", "TF2"], ["TF1", "TF3"], ["TF2", "TF3"], ["TF2"]]


def test_round_trip(spark, toy, tmp_path):
    writers.write_lines(writers.to_sparse(toy), str(tmp_path / "sparse"))
    again = readers.read_sparse(spark, str(tmp_path / "sparse"))
    row = profile.summary(again).first()
    assert (row.n_trans, row.n_items, row.max_items_in_trans, row.zero_trans) == (15, 4, 4, 3)
    lines = [r.value for r in writers.to_matrix(again).orderBy("tid").collect()]
    assert lines[0] == "#i,1,2,3,4" and lines[1:] == [f"{i},{','.join(v)}" for i, v in enumerate(TOY.values())]
    labels = readers.read_labels(spark, str(tmp_path.parent / next(p.name for p in tmp_path.parent.iterdir() if p.name.startswith("toy")) / "labels.csv"))
    assert mine_significant(readers.labelled(again, labels, by_name=False)).factor == 5
    with pytest.raises(ValueError):
        readers.labelled(again, labels.filter("tid < 9"), by_name=False)


def test_reader_text(spark, tmp_path):
    (tmp_path / "m.csv").write_text("#g a,b\nx 0,0.0\ny,00 ,0\n")
    (tmp_path / "l.csv").write_text("#g,v\nx,3.5abc\ny,text\n")
    data = readers.read_dataset(spark, str(tmp_path / "m.csv"), str(tmp_path / "l.csv"))
    assert sorted(map(tuple, data.baskets.collect())) == [(0, 1), (1, 0)]
    assert [(r.is_pos, r.value) for r in data.labels.orderBy("tid").collect()] == [(True, 3.5), (True, 0.0)]
    (tmp_path / "bad.csv").write_text("#g a,b\nx 0\n")
    with pytest.raises(Exception, match="another length"):
        readers.read_matrix(spark, str(tmp_path / "bad.csv")).baskets.collect()


def test_closures(spark):
    data = Dataset.of(spark.createDataFrame([(t, i) for t, row in enumerate(SEVEN) for i in row], "tid int, item string"))
    close = lambda s: "".join(sorted(r["item"] for r in profile.closure(data, [int(c) - 1 for c in s]).collect()))
    assert {s: close(s) for s in ("1", "1246", "2", "23", "34", "5", "6")} == {"1": "146", "1246": "12456", "2": "2", "23": "235", "34": "346", "5": "25", "6": "46"}
    assert {s: profile.core_index(data, [int(c) - 1 for c in s]) + 1 for s in ("146", "12456", "123456", "2", "235", "24", "25")} == {"146": 1, "12456": 2, "123456": 3, "2": 2, "235": 3, "24": 4, "25": 5}
    assert profile.core_index(data, []) == -1


def brute(rows, positive, n_items):
    out = {}
    for m in range(1, n_items + 1):
        for s in itertools.combinations(range(n_items), m):
            held = [t for t, r in enumerate(rows) if set(s) <= r]
            if held and not any(all(i in rows[t] for t in held) for i in range(n_items) if i not in s):
                out[s] = (len(held), sum(positive[t] for t in held))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_closed_against_brute_force(spark, seed):
    rng = random.Random(seed)
    n_items, n = 5 + seed % 3, 14
    rows = [{i for i in range(n_items) if rng.random() < 0.5} for _ in range(n)]
    if seed == 1:
        rows = [r | {0} for r in rows]  # an item in every transaction
    positive = [rng.random() < 0.4 for _ in range(n)]
    baskets = spark.createDataFrame([(t, chr(97 + i)) for t, r in enumerate(rows) for i in r], "tid int, item string")
    labels = spark.createDataFrame([(t, p, rng.choice([0.0, 1.0, 2.5])) for t, p in enumerate(positive)], "tid int, is_pos boolean, value double")
    data = Dataset.of(baskets, labels)
    names = {r.item_id: ord(r["item"]) - 97 for r in data.items.collect()}
    want = brute(rows, positive, n_items)
    for broadcast in (None, False):
        got = {tuple(sorted(names[i] for i in r["items"])): (r.sup, r.pos_sup) for r in closed_itemsets(data.merged(), len(names), broadcast=broadcast).collect()}
        assert got == want
    r = mine_significant(data, alpha=0.3)
    # the definition, straight
    n_pos = sum(positive)
    pmin = lambda x: 1.0 if x <= 0 or x >= n else math.comb(n_pos, min(x, n_pos)) / math.comb(n, min(x, n_pos)) if x <= n_pos else 1 / math.comb(n, n_pos)
    cs = lambda s: sum(v[0] >= s for v in want.values())
    over = [s for s in range(1, max(v[0] for v in want.values()) + 1) if cs(s) > math.floor(0.3 / pmin(s - 1) + 1e-9)]
    assert (r.min_sup, r.factor) == (max(over), cs(max(over)))


def test_tests(spark):
    one = spark.range(1)
    for n, total in ((7, 15), (30, 80)):
        for x in (1, total // 2, total - 1):
            for t in range(max(0, x + n - total), min(x, n) + 1, 5):
                pmf = {a: math.comb(n, a) * math.comb(total - n, x - a) / math.comb(total, x) for a in range(max(0, x + n - total), min(x, n) + 1)}
                got = one.select(TESTS["fisher"](total, n).pvalue(F.lit(x), F.lit(t)).alias("g"), TESTS["fisher"](total, n, "two.sided").pvalue(F.lit(x), F.lit(t)).alias("t")).first()
                assert got.g == pytest.approx(sum(p for a, p in pmf.items() if a >= t), rel=1e-8)
                assert got.t == pytest.approx(min(1, sum(p for p in pmf.values() if p <= pmf[t] * (1 + 1e-7))), rel=1e-7)
        got = [r[0] for r in spark.createDataFrame([(5,), (6,), (7,)], "x int").select(TESTS["fisher"](15, 7).pmin(F.col("x"))).collect()]
        assert got == pytest.approx([0.006993, 0.0013986, 0.0001554], abs=1e-6)
    for z in (0.0, 0.3, 1.96, 2.6, 5.0):
        assert one.select(normal_tail(F.lit(-z))).first()[0] == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), rel=1e-5, abs=1e-12)
    for kind in TESTS.values():  # what cannot be tested
        assert one.select(kind(9, 4).pmin(F.lit(9)), kind(9, 4).pvalue(F.lit(9), F.lit(4), F.lit(45.0))).first() == (1.0, 1.0)


def test_bitsets(spark):
    rng = random.Random(5)
    for n in (3, 64, 130):
        a, b = ({i for i in range(n) if rng.random() < 0.5} for _ in range(2))
        text = lambda s: "".join("1" if i in s else "0" for i in range(n - 1, -1, -1))
        row = spark.createDataFrame([(text(a), text(b))], "a string, b string").select(bitset.bits_from_string(F.col("a")).alias("a"), bitset.bits_from_string(F.col("b")).alias("b"))
        x, y = F.col("a"), F.col("b")
        back = lambda c: bitset.bits_to_string(c, n)
        got = row.select(
            back(bitset.bits_and(x, y)), back(bitset.bits_or(x, y)), back(bitset.bits_xor(x, y)), back(bitset.bits_and_not(x, y)), back(bitset.bits_flip(x, n)), bitset.and_count(x, y), bitset.or_count(x, y), bitset.xor_count(x, y), bitset.and_not_count(x, y), bitset.flip_count(x, n),
            bitset.is_subset(bitset.bits_and(x, y), x), bitset.is_superset(x, bitset.bits_and(x, y)), bitset.and_equals(x, y, bitset.bits_and(y, x)), bitset.find_first(x), bitset.find_next(x, 1), bitset.bit_positions(x), back(bitset.bit_set(x, n - 1)), back(bitset.bit_set(x, 0, False)), bitset.bits_count(bitset.bits_all(n)), bitset.bit_test(x, n - 1),
        ).first()
        after = [i for i in sorted(a) if i > 1]
        want = (text(a & b), text(a | b), text(a ^ b), text(a - b), text(set(range(n)) - a), len(a & b), len(a | b), len(a ^ b), len(a - b), n - len(a), True, True, True, min(a, default=-1), after[0] if after else -1, sorted(a), text(a | {n - 1}), text(a - {0}), n, n - 1 in a)
        assert tuple(got) == want


def test_itemsets(spark):
    a, b = F.array(F.lit(1), F.lit(4)), F.array(F.lit(0), F.lit(4))
    got = spark.range(1).select(itemset.push(a, 2), itemset.push(a, 4), itemset.merge(a, b), itemset.remove(a, 4), itemset.contains(a, 4), itemset.children(a, 5)).first()
    assert tuple(got) == ([1, 2, 4], [1, 4], [0, 1, 4], [1], True, [0, 2, 3])


def test_command_line(spark, tmp_path, capsys):
    from tallyforge.__main__ import main

    (tmp_path / "i.csv").write_text("#gene,TF1,TF2,TF3,TF4\n" + "".join(f"{k},{','.join(v)}\n" for k, v in TOY.items()))
    (tmp_path / "l.csv").write_text("#gene,expression\n" + "".join(f"{k},{int(k in POSITIVE)}\n" for k in TOY))
    files = ["--items", str(tmp_path / "i.csv"), "--labels", str(tmp_path / "l.csv")]
    main(["mine", *files])
    assert capsys.readouterr().out.splitlines() == ["# min. sup=5\tcorrection factor=5\tlevel=0.01", "pval (raw)\tpval (corr)\tfreq\tpos\t# items\titems", "0.00699301\t0.034965\t5\t5\t3\tTF1\tTF2\tTF3"]
    main(["to-sparse", *files, "--out", str(tmp_path / "out")])
    assert readers.read_sparse(spark, str(tmp_path / "out")).transactions.count() == 15
    with pytest.raises(SystemExit):
        main(["mine", *files[:2]])


def test_streaming_support(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 01:00:00", 1, "a"), ("2024-01-01 02:00:00", 1, "a"), ("2024-01-01 03:00:00", 2, "a"), ("2024-01-02 01:00:00", 1, "b")], "t string, u long, i string").withColumn("t", F.to_timestamp("t"))
    late = spark.createDataFrame([("2024-03-01 01:00:00", 3, "a")], "t string, u long, i string").withColumn("t", F.to_timestamp("t"))
    rows.unionByName(late).coalesce(1).write.parquet(str(tmp_path / "in"))
    key = lambda df: sorted((str(r.window.start), r["item"], r["sup"]) for r in df.collect())
    want = key(windowed_support(rows, "t", "u", "i"))
    assert [x[2] for x in want] == [2, 1]
    stream = windowed_support(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "t", "u", "i")
    q = stream.writeStream.outputMode("append").format("memory").queryName("sups").start()
    q.processAllAvailable()
    q.stop()
    assert key(spark.table("sups")) == want  # the last row's window is still open


def _norm(df):
    df = df[sorted(df.columns)]
    return sorted(repr([None if x is None or (not isinstance(x, (list, np.ndarray)) and pd.isna(x)) else x.item() if hasattr(x, "item") else x for x in r]) for r in df.astype(object).values.tolist())


QUICK = ("summary", "bitset_algebra", "closed_sets", "fisher_two_sided", "utest_two_sided", "pmin_chi", "significant_patterns", "topk_itemsets", "windowed_item_support")


@pytest.mark.parametrize("name", QUICK)
def test_queries_against_sql(spark, name):
    from tallyforge.plans import queries

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("part", "orders", "lineitem", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    assert _norm(queries.QUERIES[name](spark, d).toPandas()) == _norm(con.sql(queries.ORACLES[name]).df())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
