"""Message intake as a stream: poison messages, idempotent effects, retries and sessions."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Seconds before each further attempt, and statuses that are never tried again.
RETRY_SECONDS = (5, 15, 60, 300, 900)
GONE = (404, 410)
SESSION_SECONDS = 1800


def routed(raw: DataFrame, schema: str, required: tuple[str, ...]) -> DataFrame:
    """raw (column body) with message (a struct or null) and poison (why it can't be read, or null)."""
    parsed = raw.withColumn("message", F.from_json("body", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    missing = F.coalesce(*[F.when(F.col(f"message.{c}").isNull(), F.lit(f"missing_{c}")) for c in required])
    poison = F.when(F.try_parse_json("body").isNull(), "bad_json").when(~F.trim("body").startswith("{"), "wrong_root")
    poison = poison.when(F.col("message").isNull() | F.col("message._corrupt").isNotNull(), "bad_json").otherwise(missing)
    return parsed.withColumn("poison", poison)


def retry_plan(attempt: Column, status: Column, retry_after: Column) -> Column:
    """Struct of route (done, retry or dead_letter) and wait in seconds, for a failed or finished attempt (from 0)."""
    waits = F.array(*[F.lit(s) for s in RETRY_SECONDS])
    wait = F.coalesce(retry_after, F.get(waits, attempt))
    route = F.when(status.between(200, 299), "done").when(status.isin(*GONE) | (attempt >= len(RETRY_SECONDS)), "dead_letter").otherwise("retry")
    return F.struct(route.alias("route"), F.when(route == "retry", wait).alias("wait"))


def write_new(stream: DataFrame, state_path: str, keys: list[str], order: list[str], checkpoint: str):
    """Append each message's first arrival to the table at state_path; keys are remembered for good, in the state store.

    A batch that runs again after a failure finds the same keys new and replaces its own folder, so its
    effect happens once.
    """
    from .arrivals import first_arrivals, on_rocksdb

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{state_path}/_batch={number}")

    fresh = on_rocksdb(first_arrivals(stream, keys, order))
    return fresh.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(stream: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """The first row of each key, with state that a watermark bounds."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, at: str, key: str, width: str, delay: str) -> DataFrame:
    return stream.withWatermark(at, delay).groupBy(F.window(at, width), key).agg(F.count("*").alias("n")).select("window.start", key, "n")


def sessions(stream: DataFrame, seconds: int = SESSION_SECONDS) -> DataFrame:
    """The state of each user's conversation (columns channel, user_id, action or null, text, at).

    An action makes the session wait for input, the next input finishes it; a session without
    messages for the given time expires. One row for each change. Messages of one batch are taken in
    the order of `at`, those of one time with actions first.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        channel, user = key
        if state.hasTimedOut:
            (action,) = state.get
            state.remove()
            yield pd.DataFrame({"channel": [channel], "user_id": [user], "action": [action], "status": ["expired"]})
            return
        out = []
        rows = pd.concat(list(batches))
        rows = rows.assign(after=rows.action.isna()).sort_values(["at", "after", "action", "text"])
        for action, text in zip(rows.action, rows.text):
            if isinstance(action, str) and action:
                state.update((action,))
                out.append((action, "waiting"))
            elif state.exists and isinstance(text, str) and text:
                out.append((state.get[0], "received"))
                state.remove()
            else:
                out.append((None, "idle"))
        if state.exists:
            state.setTimeoutDuration(1000 * seconds)
        yield pd.DataFrame({"channel": channel, "user_id": user, "action": [a for a, _ in out], "status": [s for _, s in out]})

    return stream.groupBy("channel", "user_id").applyInPandasWithState(step, "channel string, user_id string, action string, status string", "action string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def read_json_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)
