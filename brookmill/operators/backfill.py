"""Long changes of many rows in bounded batches: a frozen list, outcomes by row, pause, resume and cancel between batches.

Everything is kept in tables below a root that the driver and all executors share, so that a job
which died goes on from its last committed batch.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brookmill.sources import batches

#: What an action makes of a job, and in which states it may be taken.
ACTIONS = {"pause": ("paused", ("queued", "running")), "resume": ("queued", ("paused",)), "cancel": ("cancelled", ("queued", "running", "paused"))}
OUTCOMES = ("changed", "unchanged", "skipped", "failed")


def numbered(rows: DataFrame, order: list[str], folder: str) -> DataFrame:
    """rows with place, their number from 0 in the order, which must tell all rows apart.

    Rows are dealt to ranges and written once; each range is numbered by itself, from how many rows lie
    in the ranges before it, so no task sees more than a range.
    """
    dealt = rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    dealt = batches.put(dealt, folder, "ranges", 0)
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))  # one row a range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    out = dealt.join(F.broadcast(counts.select("_range", before.alias("_before"))), "_range")
    return out.withColumn("place", (F.col("_before") + within).cast("long")).drop("_range", "_before")


def create(rows: DataFrame, root: str, order: list[str], size: int, dry_run: bool = True) -> None:
    """Freeze the list of a job: rows (id, version and the order's columns), `size` rows a batch. A list that is there stays as it is, if its terms are the same."""
    if size < 1:
        raise ValueError("size must be positive")
    spark = rows.sparkSession
    if batches.last(spark, f"{root}/list") >= 0:
        kept = spark.read.parquet(f"{root}/list/terms").first()
        if (kept["size"], kept["dry_run"]) != (size, dry_run):
            raise ValueError("the job is there already, with other terms")
        return
    items = numbered(rows, [*order, "id"], root).select("id", "version", "place", F.floor(F.col("place") / size).cast("long").alias("batch"))
    batches.put(items.repartitionByRange("batch", "place").sortWithinPartitions("place"), f"{root}/list", "items", 0)
    batches.put(spark.createDataFrame([(size, dry_run)], "size long, dry_run boolean"), f"{root}/list", "terms", 0)
    batches.commit(spark, f"{root}/list", 0)


def items(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/list/items").drop("_batch")


def _state(spark: SparkSession, root: str) -> str:
    at = batches.last(spark, f"{root}/control")
    return spark.read.parquet(f"{root}/control/states/_batch={at}").first()["state"] if at >= 0 else "queued"


def control(spark: SparkSession, root: str, action: str) -> bool:
    """Pause, resume or cancel a job; whether it was in a state that allows it."""
    if action not in ACTIONS:
        raise ValueError(f"unknown action: {action}")
    target, allowed = ACTIONS[action]
    if status(spark, root)["state"] not in allowed:
        return False
    number = batches.last(spark, f"{root}/control") + 1
    batches.put(spark.createDataFrame([(target,)], "state string"), f"{root}/control", "states", number)
    batches.commit(spark, f"{root}/control", number)
    return True


def outcomes(spark: SparkSession, root: str) -> DataFrame:
    """id, batch and outcome (and error) of every row that was looked at."""
    schema = f"id {dict(items(spark, root).dtypes)['id']}, outcome string, error string"
    return batches.committed(spark, root, "outcomes", schema).withColumnRenamed("_batch", "batch")


def status(spark: SparkSession, root: str) -> dict:
    """The job's state, and how many rows it has, looked at, changed, left, skipped and failed."""
    total = items(spark, root).count()
    counts = dict.fromkeys(OUTCOMES, 0) | {r.outcome: r["count"] for r in outcomes(spark, root).groupBy("outcome").count().collect()}  # four rows at most
    processed, state = sum(counts.values()), _state(spark, root)
    if processed >= total and state != "cancelled":
        state = "completed_with_errors" if counts["failed"] else "completed"
    elif state == "queued" and processed:
        state = "running"
    return {"state": state, "total": total, "processed": processed} | counts


def run(spark: SparkSession, root: str, current: Callable[[], DataFrame], prepare: Callable[[DataFrame], DataFrame], most: int | None = None) -> dict:
    """Work off the job's next batches (all, or `most`), as long as nobody pauses or cancels it; its status.

    current gives the rows as they are now: id, version, value and open (whether they may be changed).
    prepare makes id, value and error (null, or why there is none) of such rows. A row that is gone,
    not open or of another version than when the list was frozen is skipped.
    """
    terms = spark.read.parquet(f"{root}/list/terms").first()
    end = items(spark, root).agg(F.max("batch")).first()[0]
    number, stop = batches.last(spark, root) + 1, None if most is None else batches.last(spark, root) + 1 + most
    while end is not None and number <= end and (stop is None or number < stop) and _state(spark, root) == "queued":
        listed = items(spark, root).where(F.col("batch") == number).select("id", F.col("version").alias("_frozen"))
        held = listed.join(current(), "id", "left")
        ready = F.col("version").eqNullSafe(F.col("_frozen")) & F.col("version").isNotNull() & F.coalesce("open", F.lit(False))
        made = prepare(held.where(ready).drop("_frozen")).select("id", F.col("value").alias("_new"), F.col("error").alias("_error"), F.lit(True).alias("_made"))
        both = held.join(made, "id", "left")
        outcome = F.when(F.col("_made").isNull(), "skipped").when(F.col("_error").isNotNull(), "failed").when(F.col("_new").eqNullSafe(F.col("value")), "unchanged").otherwise("changed")
        both = batches.put(both.select("id", "_frozen", "_new", outcome.alias("outcome"), F.col("_error").alias("error")), root, "prepared", number)
        batches.put(both.select("id", "outcome", "error"), root, "outcomes", number)
        batches.put(both.where((F.col("outcome") == "changed") & F.lit(not terms["dry_run"])).select("id", F.col("_frozen").alias("version"), F.col("_new").alias("value")), root, "updates", number)
        batches.commit(spark, root, number)
        number += 1
    return status(spark, root)


def updates(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """id, version and new value of the rows that committed batches change; none in a dry run."""
    return batches.committed(spark, root, "updates", schema).drop("_batch")


def applied(target: DataFrame, changes: DataFrame) -> DataFrame:
    """target (id, version, value, ...) with the new values of rows that still have the version which the change was made from; these count one version on."""
    new = changes.select("id", F.col("version").alias("_from"), F.col("value").alias("_value"), F.lit(True).alias("_new"))
    out = target.join(new, "id", "left")
    hit = F.col("_new").isNotNull() & (F.col("_from") == F.col("version"))
    return out.withColumns({"value": F.when(hit, F.col("_value")).otherwise(F.col("value")), "version": F.col("version") + hit.cast("long")}).select(*target.columns)
