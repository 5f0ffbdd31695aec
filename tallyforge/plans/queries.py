"""The pattern-mining operators over the standard tables, and the same in SQL.

Baskets: an order's part types (six items), or the column and row of its brands'
numbers, laid out five in a row (ten items, two for each line). Labels: an order's
status, its priority or whether it has five lines or more, or its total price for
the rank test. All rows of the tables count. The SQL enumerates all item sets as
bit masks, which so few items allow.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.dataset import Dataset
from tallyforge.functions import bitset
from tallyforge.functions.stats import TESTS
from tallyforge.operators import profile
from tallyforge.operators.closed import closed_itemsets
from tallyforge.plans import significance, topk
from tallyforge.sources import writers
from tallyforge.streaming.support import windowed_support

ALPHA = 0.05
#: Of Brand#1 to Brand#25.
_BRAND = ("concat('c', (cast(substr(p_brand, 7) AS int) - 1) % 5)", "concat('r', cast(floor((cast(substr(p_brand, 7) AS int) - 1) / 5) AS int))")
#: basket: (items of a part, number of all items, SQL of the positive label)
BASKETS = {"types": (("p_type",), 6, "o_orderstatus = 'F'"), "brands": (_BRAND, 10, "o_orderpriority = '1-URGENT'"), "large": (_BRAND, 10, "lines >= 5")}


def dataset(spark: SparkSession, sf_dir: str, basket: str = "types") -> Dataset:
    items, _, positive = BASKETS[basket]
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.explode(F.array(*map(F.expr, items))).alias("item"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    sizes = lines.groupBy("l_orderkey").agg(F.count("*").alias("lines"))
    if "lines" in positive:
        orders = orders.join(sizes, orders["o_orderkey"] == sizes["l_orderkey"], "left").fillna(0, ["lines"])
    labels = orders.select(F.col("o_orderkey").alias("tid"), F.expr(positive).alias("is_pos"), F.col("o_totalprice").alias("value"))
    rows = lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).select(F.col("l_orderkey").alias("tid"), "item")
    return Dataset.of(rows, labels)


def _ctes(basket: str) -> str:
    items, k, positive = BASKETS[basket]
    return f"""
WITH b AS (SELECT DISTINCT l_orderkey AS tid, item FROM lineitem JOIN (SELECT p_partkey, unnest([{", ".join(items)}]) AS item FROM part) ON l_partkey = p_partkey),
items AS (SELECT item, (row_number() OVER (ORDER BY item) - 1)::INT AS i FROM (SELECT DISTINCT item FROM b)),
lab AS (SELECT o_orderkey AS tid, coalesce({positive}, FALSE)::INT AS pos, o_totalprice AS v, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS r FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey),
tot AS (SELECT count(*) AS nn, sum(pos)::BIGINT AS np FROM lab),
tm AS (SELECT tid, bit_or((1 << i)::BIGINT) AS m FROM b JOIN items USING (item) GROUP BY tid),
mg AS (SELECT m, count(*) AS n, sum(pos) AS p, sum(r) AS r FROM tm JOIN lab USING (tid) GROUP BY m),
sups AS (SELECT s AS mask, bit_count(s)::INT AS n_items, sum(n)::BIGINT AS sup, sum(p)::BIGINT AS pos_sup, sum(r) AS rank_sum FROM range(1, {1 << k}) t(s) JOIN mg ON (m & s) = s GROUP BY s),
closed AS (SELECT * FROM sups a WHERE NOT EXISTS (SELECT 1 FROM items JOIN sups c ON c.mask = (a.mask | (1 << i)) WHERE (a.mask & (1 << i)) = 0 AND c.sup = a.sup))"""


_NAMES = "(SELECT string_agg(item, ',' ORDER BY i) FROM items WHERE (mask & (1 << i)) <> 0)"


def _names(c: str = "items"):
    return F.array_join(c, ",").alias("items")


def _rounded(df: DataFrame, **columns: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in columns.items()})


def normal_tail_sql(z: str) -> str:
    """The density at |z| times the integral of exp(-yt - t^2 / 2) over t from 0 to where nothing is left, by Simpson's rule."""
    weight = "CASE WHEN i = 0 OR i = 1600 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"(SELECT exp(-y * y / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 1601), lambda i: {weight} * exp(-(y * i * h) - (i * h) * (i * h) / 2))) * h / 3 FROM (SELECT y, least(9.0, 40 / (y + 1)) / 1600 AS h FROM (SELECT abs({z})::DOUBLE AS y)))"


def _chi_sql(x: str, t: str, n: str, nn: str) -> str:
    cells = [(t, f"{x}*{n}"), (f"({x}-{t})", f"{x}*({nn}-{n})"), (f"({n}-{t})", f"({nn}-{x})*{n}"), (f"({nn}-{n}-{x}+{t})", f"({nn}-{x})*({nn}-{n})")]
    few = "(CASE WHEN " + " OR ".join(f"({e})/{nn}::DOUBLE < 5" for _, e in cells) + " THEN 0.5 ELSE 0.0 END)"
    chi = " + ".join(f"pow(abs({o} - ({e})/{nn}::DOUBLE) - {few}, 2) / (({e})/{nn}::DOUBLE)" for o, e in cells)
    return f"(SELECT CASE WHEN chi = 0 THEN 1.0 ELSE {normal_tail_sql('sqrt(chi)')} END FROM (SELECT {chi} AS chi))"


def _pmf_sql(a: str, x: str, n: str, nn: str) -> str:
    lf = lambda k: f"lgamma(({k}) + 1.0)"
    return f"exp({lf(n)} - {lf(a)} - {lf(f'{n}-{a}')} + {lf(f'{nn}-{n}')} - {lf(f'{x}-{a}')} - {lf(f'{nn}-{n}-{x}+{a}')} - {lf(nn)} + {lf(x)} + {lf(f'{nn}-{x}')})"


def pvalue_sql(test: str, alternative: str) -> str:
    """Of x, t, n, nn and rank_sum; for "less", t and n are already of negatives in the first two tests."""
    if test == "fisher":
        p = _pmf_sql("a", "x", "n", "nn")
        if alternative == "two.sided":
            own = _pmf_sql("t", "x", "n", "nn")
            value = f"(SELECT sum(q) FROM (SELECT {p} AS q FROM (SELECT unnest(range(greatest(0, x + n - nn), least(x, n) + 1)) AS a)) WHERE q <= {own} * (1 + 1e-7) + 1e-16)"
        else:
            value = f"(SELECT sum({p}) FROM (SELECT unnest(range(t, least(x, n) + 1)) AS a))"
        return f"CASE WHEN x >= nn THEN 1.0 ELSE least({value}, 1.0) END"
    if test == "chi":
        p = _chi_sql("x", "t", "n", "nn")
        p = f"least(2 * {p}, 1.0)" if alternative == "two.sided" else f"CASE WHEN t < least(x, n) / 2.0 THEN 1 - {p} ELSE {p} END"
        return f"CASE WHEN x >= nn OR n <= 0 OR n >= nn THEN 1.0 ELSE {p} END"
    z = "((rank_sum - x * (x + 1) / 2.0 - x * (nn - x) / 2.0) / sqrt(x * (nn - x) * (nn + 1.0) / 12))"
    p = normal_tail_sql(z)
    if alternative == "two.sided":
        value = f"least(2 * {p}, 1.0)"
    else:
        value = f"CASE WHEN {z} < 0 THEN 1 - {p} ELSE {p} END"
        value = f"1 - ({value})" if alternative == "less" else value
    return f"CASE WHEN x >= nn THEN 1.0 ELSE {value} END"


def pmin_sql(test: str, alternative: str) -> str:
    """Of x, n, nn."""
    if test == "fisher":
        lf = lambda k: f"lgamma(({k}) + 1.0)"
        return f"CASE WHEN x <= 0 OR x >= nn THEN 1.0 ELSE least(1.0, exp({lf('n')} - {lf('n - least(x, n)')} - {lf('nn')} + {lf('nn - least(x, n)')})) END"
    if test == "chi":
        p = f"least({_chi_sql('x', 'least(x, n)', 'n', 'nn')}, {_chi_sql('x', '0', 'n', 'nn')})"
        p = f"least(2 * {p}, 1.0)" if alternative == "two.sided" else p
        return f"CASE WHEN x <= 0 OR x >= nn OR n <= 0 OR n >= nn THEN 1.0 ELSE {p} END"
    return f"CASE WHEN x <= 0 OR x >= nn THEN 1.0 ELSE {normal_tail_sql('x * (nn - x) / 2.0 / sqrt(x * (nn - x) * (nn + 1.0) / 12)')} END"


def _complements(test: str, alternative: str) -> bool:
    return alternative == "less" and test != "u_test"


def _pipeline_sql(basket: str, test: str, alternative: str, tail: str) -> str:
    """CTEs up to `scored` (closed sets of the least support or more, with pval) and `lvl` (min_sup, k), then tail."""
    turned = _complements(test, alternative)
    n = "nn - np" if turned else "np"
    t = "sup - pos_sup" if turned else "pos_sup"
    return f"""{_ctes(basket)},
hist AS (SELECT sup, count(*) AS sets FROM closed GROUP BY sup),
grid AS (SELECT x, {pmin_sql(test, alternative)} AS pmin FROM (SELECT unnest(range(0, (SELECT max(sup) + 1 FROM closed))) AS x, {n} AS n, nn FROM tot)),
thr AS (SELECT x + 1 AS l, CASE WHEN pmin > 0 THEN least(floor({ALPHA} / pmin), 4503599627370496.0) ELSE 4503599627370496.0 END AS thr FROM grid),
cs AS (SELECT l, thr, (SELECT coalesce(sum(sets), 0) FROM hist WHERE sup >= l) AS c FROM thr WHERE l <= (SELECT max(sup) FROM closed)),
lvl0 AS (SELECT max(l) AS min_sup FROM cs WHERE c > thr),
lvl AS (SELECT min_sup, (SELECT count(*) FROM closed WHERE sup >= min_sup) AS k FROM lvl0),
scored AS (SELECT mask, n_items, sup, pos_sup, {pvalue_sql(test, alternative)} AS pval FROM (SELECT closed.*, sup AS x, {t} AS t, {n} AS n, nn FROM closed, tot, lvl WHERE sup >= min_sup)),
ranked AS (SELECT *, {_NAMES} AS items, row_number() OVER (ORDER BY pval, n_items DESC, {_IDS}) AS rn FROM scored)
{tail}"""


_IDS = "(SELECT list(i ORDER BY i) FROM items WHERE (mask & (1 << i)) <> 0)"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


# profile


@query(_ctes("brands") + " SELECT item, count(*)::BIGINT AS sup, sum(pos)::BIGINT AS pos_sup FROM b JOIN lab USING (tid) GROUP BY item")
def item_support(spark, d):
    return profile.item_support(dataset(spark, d, "brands")).select("item", "sup", "pos_sup")


@query(_ctes("brands") + """, s AS (SELECT item, count(*) AS c, sum(pos) AS p FROM b JOIN lab USING (tid) GROUP BY item)
SELECT (SELECT nn FROM tot)::BIGINT AS n_trans, count(*)::BIGINT AS n_items, (SELECT np FROM tot)::BIGINT AS n_pos, max(c)::BIGINT AS max_x, max(p)::BIGINT AS max_t,
(SELECT max(z) FROM (SELECT count(*) AS z FROM b GROUP BY tid))::BIGINT AS max_items_in_trans, sum(c)::BIGINT AS ones, ((SELECT nn FROM tot) - (SELECT count(DISTINCT tid) FROM b))::BIGINT AS zero_trans, 0::BIGINT AS zero_items,
round(sum(c) / ((SELECT count(DISTINCT tid) FROM b) * count(*)), 10)::DOUBLE AS density FROM s""")  # fmt: skip
def summary(spark, d):
    return _rounded(profile.summary(dataset(spark, d, "brands")), density=10)


@query(_ctes("brands") + ", s AS (SELECT item, count(*) AS sup FROM b GROUP BY item) SELECT sup::BIGINT AS sup, count(*)::BIGINT AS items, sum(count(*)) OVER (ORDER BY sup DESC)::BIGINT AS cumulative FROM s GROUP BY sup")
def support_histogram(spark, d):
    return profile.support_histogram(dataset(spark, d, "brands"))


@query(_ctes("types") + ", s AS (SELECT item, count(*) AS sup FROM b GROUP BY item) SELECT l::BIGINT AS least, (SELECT count(*) FROM s WHERE sup >= l)::BIGINT AS items FROM range(1, (SELECT max(sup) + 1 FROM s)) t(l)")
def reduced_items_by_lambda(spark, d):
    return profile.reduced_item_counts(dataset(spark, d))


@query(_ctes("types") + " SELECT tid FROM lab WHERE tid NOT IN (SELECT tid FROM b)")
def zero_transactions(spark, d):
    return profile.zero_transactions(dataset(spark, d)).select("tid")


@query(_ctes("brands") + " SELECT tid FROM tm WHERE (m & 5) = 5")
def support_set_of_items(spark, d):
    return profile.support_set(dataset(spark, d, "brands"), [0, 2])


@query(_ctes("types") + " SELECT item FROM items, (SELECT bit_and(m) AS c FROM tm WHERE (m & 3) = 3) WHERE (c & (1 << i)) <> 0")
def closure_of_items(spark, d):
    return profile.closure(dataset(spark, d), [0, 1]).select("item")


@query("SELECT o_orderkey AS tid, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0::DOUBLE AS rank FROM orders")
def mid_ranks(spark, d):
    return dataset(spark, d).mid_ranks()


# bit sets over the users of an event type: those of even and of odd hours


def _users(parity: int) -> str:
    return f"(SELECT k, u, EXISTS (SELECT 1 FROM e WHERE e.k = kk.k AND e.u = uu.u AND e.odd = {parity}) AS has FROM (SELECT DISTINCT k FROM e) kk, (SELECT unnest(range(0, (SELECT n FROM n))) AS u) uu)"


@query(f"""WITH e AS (SELECT DISTINCT event_type AS k, user_id AS u, hour(ts) % 2 AS odd FROM events), n AS (SELECT coalesce(max(u) + 1, 0) AS n FROM e)
SELECT a.k AS k, count(*) FILTER (a.has AND c.has)::BIGINT AS both, count(*) FILTER (a.has OR c.has)::BIGINT AS either, count(*) FILTER (a.has <> c.has)::BIGINT AS one, count(*) FILTER (a.has AND NOT c.has)::BIGINT AS only_a, count(*) FILTER (NOT a.has)::BIGINT AS not_a,
coalesce(min(a.u) FILTER (a.has), -1)::INT AS first, coalesce(min(a.u) FILTER (a.has AND a.u > 70), -1)::INT AS next, coalesce(bool_or(a.has AND a.u = 65), FALSE)::INT AS has_65, bool_and(NOT a.has OR c.has)::INT AS subset, bool_and(NOT c.has OR a.has)::INT AS superset,
string_agg(CASE WHEN a.has THEN '1' ELSE '0' END, '' ORDER BY a.u DESC) AS bits
FROM {_users(0)} a JOIN {_users(1)} c ON a.k = c.k AND a.u = c.u GROUP BY a.k""")
def bitset_algebra(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("k"), F.col("user_id").alias("u"), (F.hour("ts") % 2).alias("odd")).distinct()
    n = int(events.agg(F.coalesce(F.max("u") + 1, F.lit(0))).first()[0])
    even, odd = (bitset.bits_of(events.filter(F.col("odd") == o), "k", "u", n).withColumnRenamed("words", name) for o, name in ((0, "a"), (1, "b")))
    none = bitset.bits_all(n, False)
    sets = even.join(odd, "k", "full").select("k", F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))
    a, b = F.col("a"), F.col("b")
    return sets.select(
        "k", bitset.and_count(a, b).alias("both"), bitset.or_count(a, b).alias("either"), bitset.xor_count(a, b).alias("one"), bitset.and_not_count(a, b).alias("only_a"), bitset.bits_count(bitset.bits_flip(a, n)).alias("not_a"),
        bitset.find_first(a).cast("int").alias("first"), bitset.find_next(a, 70).cast("int").alias("next"), bitset.bit_test(a, 65).cast("int").alias("has_65"), bitset.is_subset(a, b).cast("int").alias("subset"), bitset.is_superset(a, b).cast("int").alias("superset"),
        bitset.bits_to_string(a, n).alias("bits"),
    )


# closed sets


@query(_ctes("brands") + f" SELECT {_NAMES} AS items, n_items, sup, pos_sup, round(rank_sum, 1)::DOUBLE AS rank_sum FROM closed")
def closed_sets(spark, d):
    data = dataset(spark, d, "brands")
    found = closed_itemsets(data.merged(ranks=True), 10)
    return significance.named(found, data.items).select(_names(), "n_items", "sup", "pos_sup", F.round("rank_sum", 1).alias("rank_sum"))


@query(_ctes("brands") + f" SELECT {_NAMES} AS items, n_items, sup, pos_sup FROM closed WHERE sup >= 20")
def closed_sets_distributed(spark, d):
    """The same by the way that leaves the table in its partitions."""
    data = dataset(spark, d, "brands")
    found = closed_itemsets(data.merged(), 10, 20, broadcast=False)
    return significance.named(found, data.items).select(_names(), "n_items", "sup", "pos_sup")


@query(_ctes("brands") + " SELECT sup, count(*)::BIGINT AS sets, sum(count(*)) OVER (ORDER BY sup DESC)::BIGINT AS cs FROM closed GROUP BY sup")
def closed_cumulative(spark, d):
    return significance.cumulative(closed_itemsets(dataset(spark, d, "brands").merged(), 10))


# tests


def _pmin(test: str, alternative: str) -> Query:
    def run(spark, d):
        total, n = dataset(spark, d).counts()
        tester = TESTS[test](total, n, alternative)
        table = significance.pmin_table(spark, tester, 400, ALPHA)
        return table.select("x", F.round("pmin", 6).alias("pmin"), F.round("log_pmin", 5).alias("log_pmin"))

    return run


def _scores(test: str, alternative: str) -> Query:
    def run(spark, d):
        data = dataset(spark, d)
        total, n = data.counts()
        kind = TESTS[test]
        turned = kind(total, n, alternative).complements
        data = data.complemented() if turned else data
        tester = kind(total, total - n if turned else n, alternative)
        scored = significance.named(significance.score(closed_itemsets(data.merged(ranks=tester.uses_ranks), 6), tester), data.items)
        pos = F.col("sup") - F.col("pos_sup") if turned else F.col("pos_sup")
        return scored.select(_names(), "sup", pos.alias("pos_sup"), F.round("pval", 6).alias("pval"))

    return run


for _test in TESTS:
    for _alt in ("greater", "less", "two.sided"):
        _label = f"{_test.replace('_', '')}_{_alt.replace('.', '_')}"
        _turned = _complements(_test, _alt)
        _n, _t = ("nn - np", "sup - pos_sup") if _turned else ("np", "pos_sup")
        query(_ctes("types") + f" SELECT {_NAMES} AS items, sup, pos_sup, round({pvalue_sql(_test, _alt)}, 6) AS pval FROM (SELECT closed.*, sup AS x, {_t} AS t, {_n} AS n, nn FROM closed, tot)", _label)(_scores(_test, _alt))
    query(_ctes("types") + f" SELECT x::BIGINT AS x, round(pmin, 6) AS pmin, round(ln(pmin), 5) AS log_pmin FROM (SELECT x, {pmin_sql(_test, 'greater')} AS pmin FROM (SELECT unnest(range(0, 401)) AS x, np AS n, nn FROM tot))", f"pmin_{_test.replace('_', '')}")(_pmin(_test, "greater"))


@query(_ctes("types") + f" SELECT x, t, round({pvalue_sql('fisher', 'greater')}, 6) AS pval FROM (SELECT x, unnest(range(0, x + 1)) AS t, np AS n, nn FROM (SELECT unnest(range(1, 21)) AS x), tot)")
def pvalue_table(spark, d):
    total, n = dataset(spark, d).counts()
    return _rounded(significance.pvalue_table(spark, TESTS["fisher"](total, n), 20), pval=6)


@query(_ctes("brands") + f", s AS (SELECT item, count(*)::BIGINT AS sup, sum(pos)::BIGINT AS pos_sup FROM b JOIN lab USING (tid) GROUP BY item) SELECT item, sup, pos_sup, round({pvalue_sql('fisher', 'greater')}, 6) AS pval FROM (SELECT s.*, sup AS x, pos_sup AS t, np AS n, nn FROM s, tot)")
def item_info(spark, d):
    data = dataset(spark, d, "brands")
    return _rounded(significance.item_info(data, TESTS["fisher"](*data.counts())).select("item", "sup", "pos_sup", "pval"), pval=6)


# the whole procedure

_ROWS = "SELECT rn::INT AS rank, items, n_items, sup, pos_sup, round(pval, 6) AS pval, (pval <= {alpha} / k)::INT AS significant FROM ranked, lvl WHERE {keep}"


def _patterns(basket: str, test: str, alternative: str, low: int, high: int) -> Query:
    def run(spark, d):
        found = significance.mine_significant(dataset(spark, d, basket), test, alternative, ALPHA, low, high).patterns
        return found.select("rank", _names(), "n_items", "sup", "pos_sup", F.round("pval", 6).alias("pval"), F.col("significant").cast("int").alias("significant"))

    return run


def _kept(low: int, high: int) -> str:
    keep = f"(pval <= {ALPHA} / k" + (f" OR rn <= {low})" if low else ")")
    return keep + (f" AND rn <= {high}" if high else "")


for _label, _args in {
    "significant_patterns": ("large", "fisher", "greater", 0, 0), "significant_chi": ("large", "chi", "greater", 0, 0), "best_significant": ("large", "fisher", "two.sided", 0, 7), "at_least_m": ("brands", "fisher", "greater", 12, 0), "at_most_n": ("large", "fisher", "greater", 0, 3), "m_to_n": ("large", "chi", "greater", 5, 8),
    "mine_chi_two_sided": ("brands", "chi", "two.sided", 10, 0), "mine_fisher_less": ("types", "fisher", "less", 10, 0), "mine_utest_two_sided": ("brands", "u_test", "two.sided", 10, 0),
}.items():
    query(_pipeline_sql(*_args[:3], _ROWS.format(alpha=ALPHA, keep=_kept(*_args[3:]))), _label)(_patterns(*_args))


@query(_pipeline_sql("brands", "fisher", "greater", f"SELECT min_sup::INT AS min_sup, k::BIGINT AS correction_factor, round({ALPHA} / k, 12) AS sig_level, nn::BIGINT AS n_trans, np::BIGINT AS n_pos, (SELECT max(sup) FROM closed)::BIGINT AS max_x FROM lvl, tot"))
def tarone_min_sup(spark, d):
    found = significance.mine_significant(dataset(spark, d, "brands"), alpha=ALPHA).summary
    return _rounded(found, sig_level=12).select("min_sup", "correction_factor", "sig_level", "n_trans", "n_pos", "max_x")


def _top(closed: bool) -> str:
    return _ctes("types") + f""", scored AS (SELECT mask, n_items, sup, pos_sup, {pvalue_sql("fisher", "greater")} AS pval FROM (SELECT s.*, sup AS x, pos_sup AS t, np AS n, nn FROM {"closed" if closed else "sups"} s, tot)),
ranked AS (SELECT *, {_NAMES} AS items, row_number() OVER (ORDER BY round(pval, 12), n_items DESC, {_IDS}) AS rn FROM scored)
SELECT rn::INT AS rank, items, n_items, sup, pos_sup, round(pval, 6) AS pval FROM ranked WHERE rn <= 10"""


@query(_top(True))
def topk_closed(spark, d):
    return topk.topk_itemsets(dataset(spark, d), 10).select("rank", _names(), "n_items", "sup", "pos_sup", F.round("pval", 6).alias("pval"))


@query(_top(False))
def topk_itemsets(spark, d):
    return topk.topk_itemsets(dataset(spark, d), 10, closed=False).select("rank", _names(), "n_items", "sup", "pos_sup", F.round("pval", 6).alias("pval"))


# sinks


@query(_ctes("types") + " SELECT tid, coalesce((SELECT string_agg((i + 1)::VARCHAR, ' ' ORDER BY i) FROM items WHERE (m & (1 << i)) <> 0), '') AS value FROM lab LEFT JOIN tm USING (tid)")
def to_sparse(spark, d):
    return writers.to_sparse(dataset(spark, d))


@query(_ctes("types") + " SELECT -1::BIGINT AS tid, '#i,' || (SELECT string_agg(item, ',' ORDER BY i) FROM items) AS value UNION ALL SELECT tid, tid::VARCHAR || ',' || (SELECT string_agg(CASE WHEN (coalesce(m, 0) & (1 << i)) <> 0 THEN '1' ELSE '0' END, ',' ORDER BY i) FROM items) FROM lab LEFT JOIN tm USING (tid)")
def to_matrix(spark, d):
    return writers.to_matrix(dataset(spark, d))


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type AS item, count(DISTINCT user_id)::BIGINT AS sup FROM events GROUP BY ALL")
def windowed_item_support(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").select("ts", "user_id", "event_type")
    found = windowed_support(events, "ts", "user_id", "event_type")
    return found.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "item", "sup")
