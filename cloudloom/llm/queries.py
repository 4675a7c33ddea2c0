"""The queries over the synthetic tables, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudloom.llm import decontaminate, langid, licenses, neardup, packing, sharding, token_counts, topk, toxicity, warc
from cloudloom.llm.common import id_crc32, scratch

VOCABULARY = "byte_bpe_50k.json"
TOXIC_FROM = 0.7


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole document."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary())


def lang_held_out(id_col: str = "doc_id") -> Column:
    """Rows that language ID never learns from; a null id is one of them."""
    return F.coalesce(F.pmod(id_crc32(F.col(id_col)), F.lit(4)) == 2, F.lit(True))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(~lang_held_out()))
    answered = docs.select("doc_id", lang_held_out().alias("held_out"), langid.predict(docs, model).alias("p"))
    return answered.select("doc_id", "held_out", "p.lang_pred", "p.score")


def toxic_held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels toxicity never learns from; a null id is one of them."""
    return F.coalesce(F.pmod(id_crc32(F.col(id_col)), F.lit(3)) == 1, F.lit(True))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every whole document, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    machine = toxicity.fit(table(spark, sf_dir, "labels").filter(~toxic_held_out()), docs)
    scored = docs.select("doc_id", toxic_held_out().alias("held_out"), toxicity.score(docs, machine).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= TOXIC_FROM).cast("int"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it holds."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows for every vector whose id is divisible by 50."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document, on shingles of four words."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every licence template that a document holds."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut into power-of-two sequences."""
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(), with_ids=False)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 40 equal shards, and its place among 41."""
    return sharding.shard(table(spark, sf_dir, "documents"), [1.0] * 40)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    path = scratch(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_decontamination, op2_token_counts, op3_language_id, op4_top_k, op5_near_duplicates, op6_packing, op7_toxicity, op8_sharding, op9_warc, op10_license_scan)
}

ORACLE: dict[str, str] = {}
ORACLE["op4_top_k"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
ORACLE["op5_near_duplicates"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] || ' ' || ws[i+3]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.reach),
c AS (SELECT id AS doc_id, min(reach) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
ORACLE["op8_sharding"] = r"""
WITH t AS (SELECT list_transform(range(0, 256), lambda b: list_reduce(list_prepend(b, range(0, 8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS key, coalesce(text, '') AS text FROM documents),
crcs AS (SELECT r, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(list_filter(string_split(regexp_replace(hex(encode(text)), '(..)', '\1 ', 'g'), ' '), lambda h: h <> ''), lambda h: CAST('0x' || h AS BIGINT))),
  lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295::BIGINT) AS text_crc32 FROM docs, t),
s AS (SELECT r, CAST(shard AS INT) AS shard, -ln((CAST('0x' || substr(md5(key || ':' || shard), 1, 13) AS BIGINT) + 1.0::DOUBLE) / 4503599627370496.0::DOUBLE) AS score FROM docs, (SELECT unnest(range(0, 41)) AS shard)),
p AS (SELECT r, arg_min(shard, row(score, shard)) FILTER (WHERE shard < 40) AS shard, arg_min(shard, row(score, shard)) AS grown_shard FROM s GROUP BY r)
SELECT doc_id, CAST(strlen(text) + 16 AS BIGINT) AS size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY md5(key), key, text_crc32, strlen(text)) - 1 AS slot, grown_shard FROM docs JOIN crcs USING (r) JOIN p USING (r)
"""
ORACLE["op9_warc"] = """
WITH d AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, max(page_id) AS top FROM d WHERE payload_bytes >= 1000 GROUP BY 1),
j AS (SELECT d.*, CASE WHEN top <> page_id THEN top END AS refers_to FROM d LEFT JOIN m USING (payload_digest))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM j
"""
