"""Files as sources and sinks: JSON lines, JSON documents, CSV with checks, texts and attachments."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookmill.functions.text import clean_url, corporate_domain
from brookmill.operators.relational import insert_new, top_per_key

# What an attachment may be.
ATTACHMENT_TYPES = {"pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "txt": "text/plain", "md": "text/markdown"}
ATTACHMENT_BYTES = 10 * 1024 * 1024
COMPANY_COLUMNS = ("company_name", "domain", "source", "source_url", "location", "careers_url")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; a malformed line is a row of nulls with the line in `_corrupt_record`."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def append_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for each file that holds one JSON document."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def import_json_lines(spark: SparkSession, path: str, schema: str, state: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of JSON lines whose key the state lacks, the first of each."""
    rows = read_json_lines(spark, path, schema).where("_corrupt_record is null").drop("_corrupt_record")
    return insert_new(state, rows, keys, [F.asc(c) for c in order])


def read_companies(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of companies, each row with an error or null: columns by header, a leading byte-order mark ignored.

    Of rows with the same domain, source and url the first (by name) stays, the others are
    `duplicate_in_file`. Raises ValueError if a column is missing.
    """
    rows = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    rows = rows.toDF(*[c.lstrip("﻿").strip() for c in rows.columns])
    if missing := [c for c in COMPANY_COLUMNS if c not in rows.columns]:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    rows = rows.select(*[F.trim(c).alias(c) for c in COMPANY_COLUMNS])
    rows = rows.withColumn("identity", corporate_domain(F.col("domain"))).withColumn("url", clean_url(F.col("source_url")))
    error = F.when(F.coalesce("company_name", F.lit("")) == "", "name_missing").when(F.col("identity").isNull(), "domain_invalid").when(F.col("url").isNull(), "url_invalid")
    rows = rows.withColumn("error", error)
    sound = rows.where("error is null")
    keys = ["identity", "source", "url"]
    first = top_per_key(sound, keys, [F.asc("company_name"), F.asc("location"), F.asc("careers_url")])
    rest = sound.exceptAll(first).withColumn("error", F.lit("duplicate_in_file"))
    return first.unionByName(rest).unionByName(rows.where("error is not null"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path and text of whole text files."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_attachments(spark: SparkSession, path: str) -> DataFrame:
    """path, extension, size, checksum, content and error (null if it may be taken) of files.

    Spark's file sources pass over files without content, so an empty attachment has no row.
    """
    files = spark.read.format("binaryFile").load(path)
    extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    error = F.when(~extension.isin(*ATTACHMENT_TYPES), "extension_not_allowed").when(F.col("length") > ATTACHMENT_BYTES, "too_large")
    return files.select("path", extension.alias("extension"), F.col("length").alias("size"), F.sha2("content", 256).alias("checksum"), "content", error.alias("error"))


def attachment_texts(files: DataFrame) -> DataFrame:
    """Text of accepted text files; others are left to an extractor of the user's, with null."""
    plain = F.col("extension").isin("txt", "md") & F.col("error").isNull()
    return files.select("path", "checksum", F.when(plain, F.decode("content", "UTF-8")).alias("text"), "error")


def daily_costs(rows: DataFrame, first: str, last: str) -> DataFrame:
    """date, cost, traces of metric rows within two dates (as text, both included)."""
    kept = rows.where(F.col("date").between(first, last))
    return kept.groupBy("date").agg(F.sum(F.coalesce("totalCost", F.lit(0.0))).alias("cost"), F.sum(F.coalesce("countTraces", F.lit(0))).alias("traces"))
