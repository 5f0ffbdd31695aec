"""The corpus operators over the standard tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import decontam, exacthash, langid, packing, secrets, simhash, sstable, toxicity, urllist, warc


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Exponent of the sources' sizes in the mixture's targets: small sources are served above their size, as is usual for mixtures.
TEMPERATURE = 0.7


def packed(docs: DataFrame) -> DataFrame:
    pieces = packing.pack(docs, vocabulary("byte_bpe_50k.json"), end_id=1, temperature=TEMPERATURE)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padded_length", "queue")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir))


def op2_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = sstable.write_shards(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), end_id=2)
    return sstable.read_shards(manifest).select(F.col("id").alias("doc_id"), "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that classifiers don't learn from: crc32 of the identifier as text, modulo 4, is 2. Rows without identifier aren't learnt from either."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.fit(docs.filter(~held_out() & F.col("doc_id").isNotNull()), vocabulary("piece_bpe_32k.model"), order=F.col("doc_id"))
    found = langid.identify(docs, model)
    return found.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score")


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    return toxicity.fit(docs, labels, ~held_out())


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = toxicity.score(docs, toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated entries for the hosts of pages and their parent domains, by the digest of the name: added, mostly removed again, in part added anew."""
    names = pages.select(urllist.host_of(F.col("url")).alias("host")).filter("host <> ''").distinct()
    labels = F.split("host", r"\.")
    keys = names.select(F.explode(F.array("host", F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.size(labels)), "."))).alias("key")).distinct()
    number = lambda at: F.conv(F.substring(F.md5("key"), at, 4), 16, 10).cast("int")
    n = keys.select("key", number(1).alias("a"), number(5).alias("b"), number(9).alias("c")).filter("a % 3 <> 0")
    first = F.date_add(F.lit("2024-01-01").cast("date"), F.col("a") % 300)
    steps = F.array(
        F.struct(F.lit("add").alias("action"), first.alias("day"), F.lit(True).alias("there")),
        F.struct(F.lit("remove").alias("action"), F.date_add(first, 1 + F.col("b") % 60).alias("day"), (F.col("b") % 4 != 0).alias("there")),
        F.struct(F.lit("add").alias("action"), F.date_add(first, 80 + F.col("c") % 60).alias("day"), (F.col("c") % 2 == 0).alias("there")),
    )
    each = n.select("key", F.when(F.col("b") % 2 == 0, "spam").otherwise("malware").alias("list"), F.explode(steps).alias("s"))
    return each.filter("s.there").select("list", "key", "s.action", "s.day")


def op6_urllist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages has no fetch day, so page_id gives one within 2024."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    captures = pages.withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int")))
    found = urllist.evaluate(captures, list_entries(pages))
    return found.select("page_id", "url", F.col("day").cast("string").alias("fetch_day"), F.col("blocked").cast("int").alias("blocked"), "n_active", "matched_key", "matched_list")


OP6_SQL = """
WITH hosts AS (SELECT DISTINCT rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '.') AS host FROM pages),
keys AS (SELECT DISTINCT unnest([host, array_to_string(string_split(host, '.')[-2:], '.')]) AS key FROM hosts WHERE host <> ''),
n AS (SELECT key, ('0x' || substr(md5(key), 1, 4))::INT AS a, ('0x' || substr(md5(key), 5, 4))::INT AS b, ('0x' || substr(md5(key), 9, 4))::INT AS c FROM keys),
entries AS (
  SELECT CASE WHEN b % 2 = 0 THEN 'spam' ELSE 'malware' END AS list, key, action, day FROM (
    SELECT *, 'add' AS action, DATE '2024-01-01' + (a % 300)::INT AS day FROM n
    UNION ALL SELECT *, 'remove', DATE '2024-01-01' + (a % 300 + 1 + b % 60)::INT FROM n WHERE b % 4 <> 0
    UNION ALL SELECT *, 'add', DATE '2024-01-01' + (a % 300 + 80 + c % 60)::INT FROM n WHERE c % 2 = 0) WHERE a % 3 <> 0),
spans AS (SELECT list, key, action, day AS since, coalesce(lead(day) OVER (PARTITION BY list, key ORDER BY day), DATE '9999-12-31') AS until FROM (SELECT list, key, day, min(action) AS action FROM entries GROUP BY ALL)),
captures AS (SELECT page_id, url, DATE '2024-01-01' + (page_id % 366)::INT AS day, string_split(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '.'), '.') AS labels FROM pages),
asked AS (SELECT page_id, day, unnest(list_distinct(list_concat([lower(regexp_replace(url, '[?#].*$', ''))], list_transform(range(1, greatest(len(labels), 2)), lambda i: array_to_string(labels[i:], '.'))))) AS key FROM captures),
met AS (SELECT page_id, count(*) AS n_active, min((-length(a.key), a.key, list)) AS best FROM asked a JOIN spans s ON a.key = s.key AND s.action = 'add' AND a.day >= s.since AND a.day < s.until GROUP BY page_id)
SELECT c.page_id, url, CAST(day AS VARCHAR) AS fetch_day, (n_active IS NOT NULL)::INT AS blocked, coalesce(n_active, 0) AS n_active, best[2] AS matched_key, best[3] AS matched_list FROM captures c LEFT JOIN met USING (page_id)
"""


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir))
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    names = (*secrets.KINDS, *(c.name for c in secrets.CLASSES))
    return found.select(F.col("id").alias("doc_id"), of_kind(0).alias("n_assign"), of_kind(1).alias("n_access"), of_kind(2).alias("n_hex"), F.sha2(secrets.written(F.col("base"), names), 256).alias("base_sha256"), secrets.written(F.col("spans"), names).alias("spans"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exacthash.duplicates(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha256").alias("text_sha256"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    records = warc.read_archives(warc.write_archives(warc.with_references(pages, "page_id", "url", "html")))
    return records.select(F.col("id").alias("page_id"), F.coalesce(F.octet_length("payload").cast("long"), F.col("http_bytes")).alias("payload_bytes"), "payload_digest", F.col("type").alias("record_type"), "refers_to")


QUERIES = {f.__name__: f for f in (op1_packing, op2_sstable, op3_decontamination, op4_language, op5_toxicity, op6_urllist, op7_secrets, op8_exact_dedup, op9_simhash, op10_warc)}
ORACLES: dict[str, str] = {"op6_urllist": OP6_SQL}
