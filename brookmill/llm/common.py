"""Helpers shared by the corpus operators: folds, checkpoints, Arrow tokenising."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task turns into tokens at once.
SLICE_BYTES = 8 << 20
#: Bytes of rows that travel to a Python worker at once in the pipeline; Spark's default is 64 MB.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % parts


def fresh(name: str, df: DataFrame) -> str:
    """A column name that df doesn't have yet: the given one, after underscores if need be."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def whole_rows(df: DataFrame) -> DataFrame:
    """df as one struct column `row`, so that columns put beside it clash with none of its own."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the cluster's spark.checkpoint.dir.

    Only in local mode, as in tests, a temporary one is made where none is set.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="brookmill-"))
    return context.getCheckpointDir()


def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """From now on at most about so many bytes go to a Python worker at once; a session that asks for less keeps that.

    A batch stands in the executor, in the worker, and in the worker's answer. No row is left out: a
    row that is larger travels alone.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = int(spark.conf.get(name).removesuffix("b"))
    if held <= 0 or held > most:
        spark.conf.set(name, str(most))


def short_shuffles(spark: SparkSession) -> None:
    """From now on the files of a query's shuffles go when it ends, not when the driver happens to collect its garbage.

    Each step is written or checkpointed once, so nothing reads them again.
    """
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def saved(df: DataFrame) -> DataFrame:
    """df with its lineage cut by files in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@functools.cache
def _trim():
    """glibc's malloc_trim; elsewhere nothing."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: 0)


def give_back() -> None:
    """Give memory that is free again back to the system: a worker serves one task after another, and several stand side by side."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def slices(batches, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each piece holds about limit bytes of text, one row at least."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
        give_back()


def words_of(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of all texts in a row, and where each text's words start and end.

    With lower, A-Z are lower-cased. A null text has no words.
    """
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = pc.list_flatten(lists)
    keep = pc.not_equal(flat, "")
    parents = pc.list_parent_indices(lists).to_numpy()
    counts = np.bincount(parents[keep.to_numpy(zero_copy_only=False)], minlength=len(texts))
    return flat.filter(keep), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 over an array of uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def sample_of_labels(docs: DataFrame, labels: DataFrame, label: str, training: Column | None, rows: int) -> DataFrame:
    """doc_id, text, y (double), at (a hash of the id) of at most `rows` labelled documents.

    The ids with the smallest hashes are taken, so the sample is the same in every run. It is
    bounded, and so may be broadcast to the documents, whose texts then need no shuffle. Of
    repeated documents the smallest text counts, of several labels the largest.
    """
    ids = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    if training is not None:
        ids = ids.where(training)
    ids = ids.groupBy("doc_id").agg(F.max(label).cast("double").alias("y")).withColumn("at", F.xxhash64("doc_id", F.lit("sample")))
    ids = ids.orderBy("at", "doc_id").limit(rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"), F.first("at").alias("at"))
