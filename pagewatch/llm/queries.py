"""The driver's queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewatch.llm import centroids, decontaminate, exact_dedup, language_model, packing, quality, simhash, suffix_dedup, token_counts, toxicity, url_filter, warc, whitening
from pagewatch.llm.shared import read


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.dedup(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


OP1_SQL = """
WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, t.text_sha256 FROM t JOIN g ON t.text_sha256 = g.text_sha256
"""


#: Tokens of a document that is over the limit.
TOKEN_LIMIT = 2048


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_counts.token_counts(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return rows.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(read(spark, sf_dir, "pages"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(read(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


#: Words are runs of letters, digits and non-ASCII; a window is found as a substring of space-joined words.
OP10_SQL = """
WITH item AS (
    SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w
    FROM benchmark),
pattern AS (
    SELECT DISTINCT item_id, list_slice(w, i, i + 9) AS p
    FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM item WHERE len(w) > 0)),
doc AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w
    FROM documents),
size AS (SELECT DISTINCT len(p) AS k FROM pattern),
win AS (
    SELECT doc_id, i, k, list_slice(w, i, i + k - 1) AS p
    FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc, size WHERE len(w) >= k)),
hit AS (SELECT doc_id, i, k, item_id FROM win JOIN pattern USING (p)),
covered AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS at FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS list FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


def op11_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(read(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deviation is null where it is beyond a long."""
    return whitening.whiten(read(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read(spark, sf_dir, "embeddings"))


def _op13_sql(rounds: int = centroids.ROUNDS, k: int = centroids.CLUSTERS, seed: int = centroids.SEED) -> str:
    """Plain Lloyd, a round after the other, each comparing every vector with every centroid."""
    nearest = """a{0} AS MATERIALIZED (SELECT vec_id, x, cluster, distance FROM (
        SELECT vec_id, x, cluster, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS distance, row_number() OVER (PARTITION BY row_no ORDER BY distance, cluster) AS best
        FROM v, c{0}) WHERE best = 1)"""
    moved = """s{1} AS (SELECT cluster, dim, sum(x[dim]) AS s, count(*) AS n FROM a{0}, (SELECT unnest(range(1, 65)) AS dim) GROUP BY cluster, dim),
    m{1} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY dim) AS c FROM s{1} GROUP BY cluster),
    c{1} AS MATERIALIZED (SELECT c{0}.cluster, coalesce(m{1}.c, c{0}.c) AS c FROM c{0} LEFT JOIN m{1} ON c{0}.cluster = m{1}.cluster)"""
    parts = [f"""v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS row_no, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
    c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), x) - 1 AS cluster, x AS c FROM v QUALIFY cluster < {k})"""]
    for i in range(rounds):
        parts += [nearest.format(i), moved.format(i, i + 1)]
    parts.append(nearest.format(rounds))
    return "WITH " + ", ".join(parts) + f"""
    SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
        CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
    FROM a{rounds} JOIN c{rounds} USING (cluster)"""


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup, "op2_token_counts": op2_token_counts, "op3_packing": op3_packing, "op4_toxicity": op4_toxicity,
    "op5_quality": op5_quality, "op6_url_filter": op6_url_filter, "op7_simhash": op7_simhash, "op8_warc": op8_warc, "op9_suffix_dedup": op9_suffix_dedup,
    "op10_decontamination": op10_decontamination, "op11_language_model": op11_language_model, "op12_whitening": op12_whitening, "op13_centroids": op13_centroids,
}
ORACLE_SQL = {"op1_exact_dedup": OP1_SQL, "op10_decontamination": OP10_SQL, "op13_centroids": _op13_sql()}
