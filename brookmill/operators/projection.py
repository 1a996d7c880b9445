"""Companies seen in drafts, kept up to date by looking at changed drafts only.

The tables of a state: observations (draft_id, domain, label, method, observed_at), companies (domain,
name, verified) and seen (draft_id, updated_at, version, reason).
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookmill.sources import batches

# How a person's own correction is called, and the weakest method.
CORRECTIONS, WEAKEST = ("human_edited", "reviewer_correction", "recruiter_correction"), "sender_domain"
OBSERVATIONS = "draft_id long, domain string, label string, method string, observed_at timestamp"
COMPANIES = "domain string, name string, verified boolean"
SEEN = "draft_id long, updated_at timestamp, version string, reason string"
TABLES = {"observations": OBSERVATIONS, "companies": COMPANIES, "seen": SEEN}


@dataclass
class State:
    observations: DataFrame
    companies: DataFrame
    seen: DataFrame


def empty(spark: SparkSession) -> State:
    return State(*[spark.createDataFrame([], schema) for schema in TABLES.values()])


def names(observations: DataFrame) -> DataFrame:
    """domain and name: its label that someone corrected, else of a better method, else the commonest, the latest, the first by name."""
    corrected, own = F.max(F.col("method").isin(*CORRECTIONS)), F.max(F.col("method") != WEAKEST)
    labels = observations.where("domain is not null").groupBy("domain", "label").agg(corrected.alias("corrected"), own.alias("own"), F.count("*").alias("n"), F.max(F.unix_micros("observed_at")).alias("at"))
    order = F.struct(~F.col("corrected"), ~F.col("own"), -F.col("n"), -F.coalesce("at", F.lit(0)), "label")
    return labels.groupBy("domain").agg(F.min_by("label", order).alias("name"))


def due(source: DataFrame, seen: DataFrame, version: str) -> DataFrame:
    """draft_id and gone: drafts that are new, of another time, seen by another version, or no more in the source."""
    now = source.select("draft_id", "updated_at", F.lit(True).alias("_here"))
    before = seen.select("draft_id", F.col("updated_at").alias("_then"), F.col("version").alias("_by"))
    both = now.join(before, "draft_id", "full")
    fresh = F.col("_here").isNull() | ~F.col("updated_at").eqNullSafe(F.col("_then")) | ~F.col("_by").eqNullSafe(F.lit(version))
    return both.where(fresh).select("draft_id", F.col("_here").isNull().alias("gone"))


def step(source: DataFrame, state: State, observe: Callable[[DataFrame], DataFrame], version: str) -> State:
    """The state after the source's changes.

    observe gives draft_id, domain (null without a company), label, method, observed_at and reason of
    drafts. Only due drafts are observed, and only companies that these name, before or after, get their
    name again. A verified company keeps its name, and one that no draft names any more keeps its last.
    Drafts have one row each in the source.
    """
    todo = due(source, state.seen, version)
    seen_now = observe(source.join(todo.where("not gone"), "draft_id", "left_semi"))
    found = seen_now.where("domain is not null").select(*state.observations.columns)
    observations = state.observations.join(todo, "draft_id", "left_anti").unionByName(found)
    left = state.observations.join(todo, "draft_id", "left_semi").select("domain")
    touched = left.union(found.select("domain")).distinct()
    renamed = names(observations.join(touched, "domain", "left_semi"))
    companies = state.companies.join(renamed.withColumnRenamed("name", "_name"), "domain", "full").select(
        "domain", F.when(F.coalesce("verified", F.lit(False)), F.col("name")).otherwise(F.coalesce("_name", "name")).alias("name"), F.coalesce("verified", F.lit(False)).alias("verified"))
    times = source.select("draft_id", "updated_at")
    noted = seen_now.select("draft_id", "reason").join(times, "draft_id").select("draft_id", "updated_at", F.lit(version).alias("version"), "reason")
    return State(observations, companies, state.seen.join(todo, "draft_id", "left_anti").unionByName(noted))


def current(spark: SparkSession, root: str) -> State:
    """The last committed state below root."""
    number = batches.last(spark, root)
    return State(*[batches.of(spark, root, t, schema, number) for t, schema in TABLES.items()]) if number >= 0 else empty(spark)


def advance(source: DataFrame, root: str, observe: Callable[[DataFrame], DataFrame], version: str) -> State:
    """Take the source's changes into the state below root. What was seen is written last, and readers see all or nothing of it."""
    spark, number = source.sparkSession, batches.last(source.sparkSession, root) + 1
    state = step(source, current(spark, root), observe, version)
    for name in TABLES:
        batches.put(getattr(state, name), root, name, number)
    batches.commit(spark, root, number)
    return current(spark, root)
