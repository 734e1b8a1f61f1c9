"""One query per operator, each over its whole table, with the columns that the corpus contracts name."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, html_extraction, local_descriptors, mixing, near_duplicates, pii, quality, repeats, secrets, toxicity
from .shared import ship, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated", "n_near")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_docs(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_entities", "entity_kinds", "text")


def remainder(modulus: int) -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def classified(scores: DataFrame, held_out: F.Column) -> DataFrame:
    return scores.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).cast("int").alias("predicted"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), remainder(5) == 0
    model = quality.train(docs, table(spark, sf_dir, "labels"), ~fold)
    return classified(quality.score(docs, model), fold)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`draws` tells the pass, shard, words and place of each time that the document is taken."""
    return mixed(table(spark, sf_dir, "documents"))


def mixed(docs: DataFrame) -> DataFrame:
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda s, d: s + d["words"])
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "draws")


def op5_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test tables have no images: their vectors are drawn as smooth grey images."""
    got = local_descriptors.matched(F.col("id") % 100 == 0, local_descriptors.drawn(table(spark, sf_dir, "embeddings")))
    return got.select(F.col("id").alias("vec_id"), "class_id", "n_matches", F.col("matches.class_id").alias("query_classes"), F.col("matches.inliers").alias("inliers"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), remainder(4) == 2
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~fold)
    return classified(toxicity.score(docs, model), fold)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = secrets.scan_docs(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    digest = F.sha2(secrets.joined_column("base").cast("binary"), 256)
    return got.select("doc_id", *map(count, secrets.KINDS), digest.alias("base_sha256"), secrets.joined_column("spans").alias("spans"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, after the workers have this package."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_decontamination, op2_pii, op3_quality, op4_mixing, op5_image_copies, op6_toxicity, op7_secrets, op8_html_extraction, op9_jaccard_join, op10_repeats)
    return {f.__name__: shipped(f) for f in every}


#: SQL of what SQL can express on whole tables. The classifiers, the searches and what parses or decodes are tested against brute force.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OP1 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[k:k + least(len(w), 13) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 11, 2))) AS k FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d CROSS JOIN (SELECT DISTINCT n FROM bw))),
h AS (SELECT doc_id, item_id, dw.n AS n, p FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id),
t AS (SELECT item_id, len(list_distinct(w)) AS n, unnest(list_distinct(w)) AS term FROM b),
o AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS p FROM d),
c AS (SELECT doc_id, item_id, n, count(DISTINCT o.term) OVER (PARTITION BY doc_id, item_id ORDER BY p RANGE BETWEEN CURRENT ROW AND n + 4 FOLLOWING) AS got FROM o JOIN t ON o.term = t.term),
near AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM c WHERE got = n GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN pos ON pos.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id LEFT JOIN near ON near.doc_id = d.doc_id"""
_OP10 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
w13 AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d)),
f AS (SELECT g, min(doc_id) AS least FROM w13 GROUP BY g),
x AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS q FROM w13 JOIN f ON w13.g = f.g WHERE least < doc_id),
v AS (SELECT doc_id, unnest(w) AS v, generate_subscripts(w, 1) AS q FROM d),
k AS (SELECT v.doc_id, count(*) AS n, count(x.q) AS r, string_agg(v.v, ' ' ORDER BY v.q) FILTER (WHERE x.q IS NULL) AS kept FROM v LEFT JOIN x ON x.doc_id = v.doc_id AND x.q = v.q GROUP BY v.doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, CAST(coalesce(r, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": _OP1, "op10_repeats": _OP10}
