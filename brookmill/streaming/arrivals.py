"""Intake as one stream: each message once, into several tables that are committed together.

Keys are remembered in Spark's state store, which a batch asks for its own keys only; the state of a
batch that failed isn't kept, so the batch that runs again finds the same keys new.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookmill.functions.text import body_hash
from brookmill.operators import mails
from brookmill.sources import batches

from . import intake

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MESSAGE = "id string, sender string, kind string, text string, attempt int, status int, retry_after int"
#: The tables of an intake and their columns.
TABLES = {
    "messages": f"body string, {MESSAGE}, poison string",
    "drafts": f"draft_id string, kind string, body_hash string, record_count int, confidence double, requires_review boolean, warnings array<string>, consultants array<struct<{mails.as_fields(mails.CONSULTANT)}>>, positions array<struct<{mails.as_fields(mails.JOB)}>>",
    "provenance": "draft_id string, record int, field string, value string",
    "retries": "id string, attempt int, wait int",
    "dead_letters": "id string, body string, reason string",
    "log": "id string, route string",
}


def first_arrivals(stream: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows of keys that no batch before held, of several in one batch the first by the order columns (and then all others).

    Null keys are keys like others. Start the query in update mode. State grows with distinct keys and
    belongs on RocksDB (`on_rocksdb`), which keeps it on the executors' disks.
    """
    rest = [c for c in stream.columns if c not in keys]
    timed = stream.withColumn("_now", F.current_timestamp())  # one time for a batch, also when it runs again
    ties = F.struct("_now", *order, *[F.col(c) for c in rest if c not in order])
    kept = timed.groupBy(*keys).agg(F.min_by(F.struct(*rest), ties).alias("_row"), F.min("_now").alias("_first"), F.max("_now").alias("_last"))
    return kept.where("_first = _last").select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*stream.columns)


def on_rocksdb(stream: DataFrame) -> DataFrame:
    """The stream; queries that its session starts from now on keep their state on RocksDB."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return stream


def routes(messages: DataFrame) -> DataFrame:
    """messages with route (draft, retry or dead_letter), reason and wait: what can't be read is dead, a failed attempt is tried again or given up."""
    plan = intake.retry_plan(F.coalesce("attempt", F.lit(0)), F.col("status"), F.col("retry_after"))
    out = messages.withColumn("_plan", F.when(F.col("status").isNotNull(), plan))
    poison, given_up = F.col("poison").isNotNull(), F.col("_plan.route") == "dead_letter"
    route = F.when(poison | F.coalesce(given_up, F.lit(False)), "dead_letter").when(F.col("_plan.route") == "retry", "retry").otherwise("draft")
    reason = F.coalesce("poison", F.when(given_up, F.concat(F.lit("status_"), "status")))
    return out.withColumns({"route": route, "reason": reason, "wait": F.col("_plan.wait")}).drop("_plan")


def drafts_of(messages: DataFrame) -> DataFrame:
    """A draft of each message (id, kind, text): what its kind's parser reads."""
    made = messages.select(F.col("id").alias("draft_id"), "kind", body_hash(F.col("text")).alias("body_hash"), mails.business_records(F.col("text"), F.col("kind")).alias("m"))
    return made.select("draft_id", "kind", "body_hash", *[f"m.{c}" for c in ("record_count", "confidence", "requires_review", "warnings", "consultants", "positions")])


def provenance_of(drafts: DataFrame) -> DataFrame:
    """One row for each field of a draft's records that has a value; lists as JSON."""

    def values(records: str, fields: list[str]) -> Column:
        one = lambda r, f: F.struct(F.lit(f).alias("field"), (F.to_json(r[f]) if f == "skills" else r[f].cast("string")).alias("value"))
        held = lambda r: F.filter(F.array(*[one(r, f) for f in fields]), lambda x: x["value"].isNotNull() & (x["value"] != "[]"))
        return F.flatten(F.transform(records, lambda r: F.transform(held(r), lambda x: F.struct(r["source"].alias("record"), x["field"].alias("field"), x["value"].alias("value")))))

    consultant = ["name", "email", "phone", "title", "skills", "years", "location", "work_authorization", "availability", "rate"]
    job = ["job_title", "company", "skills", "years", "location", "work_authorization", "employment_type", "rate"]
    return drafts.select("draft_id", F.explode(F.concat(values("consultants", consultant), values("positions", job))).alias("p")).select("draft_id", "p.record", "p.field", "p.value")


def write_batch(batch: DataFrame, root: str, number: int) -> None:
    """The tables of one batch of messages (columns of TABLES["messages"]); the same tables if it runs again."""
    routed = routes(batches.put(batch.select(*batch.columns), root, "messages", number))
    drafts = batches.put(drafts_of(routed.where("route = 'draft'")), root, "drafts", number)
    batches.put(provenance_of(drafts), root, "provenance", number)
    batches.put(routed.where("route = 'retry'").select("id", (F.coalesce("attempt", F.lit(0)) + 1).alias("attempt"), "wait"), root, "retries", number)
    batches.put(routed.where("route = 'dead_letter'").select("id", "body", "reason"), root, "dead_letters", number)
    batches.put(routed.select("id", "route"), root, "log", number)
    batches.commit(batch.sparkSession, root, number)


def messages_of(raw: DataFrame) -> DataFrame:
    """Messages of raw rows (column body, JSON of MESSAGE), with poison where one can't be read."""
    read = intake.routed(raw, MESSAGE, ("id",))
    fields = [f.split()[0] for f in MESSAGE.split(", ")]
    return read.select("body", *[F.col(f"message.{f}").alias(f) for f in fields], "poison")


def run(raw: DataFrame, root: str, checkpoint: str):
    """Start the intake of a stream of raw rows: of every id and attempt the first arrival, unreadable rows by their text."""
    keyed = messages_of(raw).withColumn("_key", F.when(F.col("poison").isNull(), F.to_json(F.struct("id", F.coalesce("attempt", F.lit(0)).alias("attempt")))).otherwise(F.col("body")))
    fresh = on_rocksdb(first_arrivals(keyed, ["_key"], ["body"])).drop("_key")
    return fresh.writeStream.outputMode("update").foreachBatch(lambda batch, number: write_batch(batch, root, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
