"""The corpus operators as queries: each takes (spark, sf_dir) and runs over its whole tables."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, decontamination, langid, lm, packing, pieces, quality, simhash, tokenfiles, toxicity, urls, variants
from .common import fold, shared_folder, table


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


#: The rules of the url query, as verdict and rule.
URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [urls.prefix_rule(*r) for r in URL_RULES] + list(urls.PATTERNS)
    return urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), "toxic", fold("doc_id", 4) != 2)
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.profiles(docs, training=fold("doc_id", 4) != 2)
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs, path, verify=True).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "lossless", "ids")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"), "quality", fold("doc_id", 5) != 0)
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = lm.score(docs, lm.train(docs, fold("doc_id", 5) != 1))
    return scored.withColumn("held_out", fold("doc_id", 5) == 1)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    tokenfiles.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return tokenfiles.read_tokens(spark, path, with_ids=False)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return variants.spelling_variants(variants.count_words(docs, slips_every=199))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    path_a, path_b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align(table(spark, sf_dir, "documents"), path_a, path_b)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_nearest_neighbours,
        op2_url_filter,
        op3_toxicity,
        op4_language_id,
        op5_decontamination,
        op6_quality,
        op7_language_model,
        op8_token_files,
        op9_simhash,
        op10_pieces,
        op11_spelling_variants,
        op12_alignment,
        op13_packing,
    )
}

_PLACED = r"""
    SELECT page_id,
        coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
    FROM pages"""

ORACLE_SQL = {
    "op2_url_filter": f"""
WITH placed AS ({_PLACED}),
matched AS (
    SELECT *,
        host = 'example.org' OR host LIKE '%.example.org' AS at_example_org,
        host = 'org' OR host LIKE '%.org' AS at_org,
        host = 'com' OR host LIKE '%.com' AS at_com
    FROM placed),
ruled AS (
    SELECT *, CASE
        WHEN at_example_org AND path LIKE '/en/1%' THEN 'example.org/en/1'
        WHEN at_example_org AND path LIKE '/es/%' THEN 'example.org/es/'
        WHEN at_com AND path LIKE '/fr/%' THEN 'com/fr/'
        WHEN at_com AND path LIKE '/de/%' THEN 'com/de/'
        WHEN at_org AND path LIKE '/%' THEN 'org/' END AS rule
    FROM matched)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches(host, '(^|[.-])(spam|ads|pills|casino)([.-]|$)') OR regexp_matches(host || path, '(?i)(^|[^a-z0-9])(free[_/-]trial|buy[_/-]now|click[_/-]here)([^a-z0-9]|$)') THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled""",
}
