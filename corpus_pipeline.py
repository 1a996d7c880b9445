"""A training-corpus pipeline over `documents`, in stages that are each written and read again.

1. language: documents without letters, or far from every language's profile, go;
2. toxicity: documents that score as toxic go;
3. near_duplicates: one document of each group of near copies stays;
4. decontamination: documents that leak a benchmark item go;
5. pieces: the rest is encoded with merge-dropout, and decoded again as a check.

Each stage learns from and judges all that its predecessor kept. Nulls, empty tables and repeated
rows are defined by the operators: a null text has no letters and so goes at the first stage.

Two settings of the session stay. Rows go to Python workers in small batches (`small_batches`): the
executor and its workers hold each of them several times. The files of a query's shuffles go when it
ends (`short_shuffles`): a stage has many, and each step is written before the next reads it.
"""

import functools
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookmill.llm import decontamination, langid, pieces, simhash, toxicity
from brookmill.llm.common import shared_folder, short_shuffles, small_batches, table, whole_rows

#: Texts nearer than this to no language's profile are junk.
LEAST_LANGUAGE = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = langid.identify(whole_rows(docs), langid.profiles(docs), text="row.text")
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE)).select("row.*")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), "toxic")
    return toxicity.score_toxicity(whole_rows(docs), model, text="row.text").where("predicted = 0").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    out = pieces.encode(docs.select("doc_id", "text"), path, verify=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "lossless", "ids")


def _set_up(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        short_shuffles(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [(name, _set_up(stage)) for name, stage in (("language", language), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("decontamination", decontaminated), ("pieces", encoded))]

#: SQL can express neither the learned models nor the fingerprints and segmentations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
