"""Tables written in numbered batches: readers see a batch in all its tables or in none.

A batch writes its rows to a folder of its own in each table and is committed after the last of them,
so one that runs again replaces what it left behind. Folders must be on storage that the driver and
all executors share.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(root: str, name: str, number: int) -> str:
    return f"{root}/{name}/_batch={number}"


def put(rows: DataFrame, root: str, name: str, number: int) -> DataFrame:
    """Write a table's rows of a batch; the rows as written, which cost nothing to read twice."""
    rows.write.mode("overwrite").parquet(_path(root, name, number))
    return rows.sparkSession.read.schema(rows.schema).parquet(_path(root, name, number))


def commit(spark: SparkSession, root: str, number: int) -> None:
    """Let readers see the batch."""
    spark.range(1).select(F.lit(number).cast("long").alias("number")).write.mode("overwrite").parquet(_path(root, "committed", number))


def last(spark: SparkSession, root: str) -> int:
    """The number of the last committed batch, -1 before the first."""
    found = _if_there(lambda: spark.read.parquet(f"{root}/committed").agg(F.max("number")).first()[0])
    return -1 if found is None else found


def committed(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """All rows of a table's committed batches with their `_batch`; of no row before the first."""
    done = last(spark, root)
    if done < 0:
        return spark.createDataFrame([], f"{schema}, _batch int")
    return spark.read.schema(f"{schema}, _batch int").parquet(f"{root}/{name}").where(F.col("_batch") <= done)


def _if_there(read: Callable):
    """What is read, None where its folder isn't there yet."""
    try:
        return read()
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return None


def of(spark: SparkSession, root: str, name: str, schema: str, number: int) -> DataFrame:
    """A table's rows of one batch."""
    return spark.read.schema(schema).parquet(_path(root, name, number))
