"""Deduplication, upserts and merges over the driver's tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookmill.functions.text import body_hash
from brookmill.operators import relational, taxonomy
from brookmill.sources.tables import table

from .registry import query


@query("""
WITH h AS (SELECT doc_id, sha256(text) AS body_hash FROM documents)
SELECT doc_id, body_hash, CAST(CASE WHEN min(doc_id) OVER (PARTITION BY body_hash) != doc_id THEN min(doc_id) OVER (PARTITION BY body_hash) END AS VARCHAR) AS duplicate_of FROM h""")
def content_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the first one of the same text; duplicates are linked, not dropped."""
    docs = table(spark, sf_dir, "documents").select("doc_id", body_hash(F.col("text")).alias("body_hash"))
    return relational.first_seen(docs, "body_hash", ["doc_id"], "doc_id").select("doc_id", "body_hash", F.col("duplicate_of").cast("string").alias("duplicate_of"))


@query("SELECT user_id, event_id, ts, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def upsert_last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after all events: each user's last."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value")
    half = events.agg(F.avg("event_id")).scalar()
    state = relational.latest(events.where(F.col("event_id") < half), ["user_id"], ["ts", "event_id"])
    return relational.upsert(state, events.where(F.col("event_id") >= half), ["user_id"], ["ts", "event_id"])


@query("SELECT coalesce(c_custkey, s_suppkey) AS key, coalesce(s_nationkey, c_nationkey) AS nation, coalesce(CASE WHEN s_acctbal >= 0 THEN s_acctbal END, c_acctbal) AS balance FROM customer FULL JOIN supplier ON s_suppkey = c_custkey")
def upsert_keep_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers written over customers of the same key; a missing balance keeps the old one."""
    state = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    changes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"), F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")).alias("balance"))
    return relational.upsert_keeping(state, changes, ["key"])


@query("SELECT c_nationkey, min(c_custkey) AS c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) GROUP BY 1")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first customer of each nation that the state doesn't hold."""
    state = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("c_nationkey"))
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey")
    return relational.insert_new(state, rows, ["c_nationkey"], [F.asc("c_custkey")])


@query("SELECT event_type, props, count(*) AS n FROM events GROUP BY 1, 2")
def usage_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of two halves of the events, added up."""
    events = table(spark, sf_dir, "events")
    keys, half = ["event_type", "props"], events.agg(F.avg("event_id")).scalar()
    return relational.add_counters(relational.counters(events.where(F.col("event_id") < half), keys), relational.counters(events.where(F.col("event_id") >= half), keys), keys)


@query("""
WITH k AS (SELECT regexp_replace(lower(p_name), '[^a-z0-9+#]', '', 'g') AS identity, p_name, p_partkey, p_brand, p_size FROM part), s AS (SELECT identity, list(p_partkey ORDER BY p_partkey)[1:10] AS ids FROM k GROUP BY 1)
SELECT identity, arg_min(p_name, p_partkey) AS term, count(*) AS occurrences, count(DISTINCT p_brand) AS sources, min(p_partkey) AS first_seen, max(p_partkey) AS last_seen, array_to_string(any_value(ids), ',') AS sample_ids FROM k JOIN s USING (identity) GROUP BY 1""")
def candidate_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as candidate terms: counts, sources and ten sample ids (a bounded list is the feature)."""
    parts = table(spark, sf_dir, "part").withColumn("at", F.col("p_partkey"))
    found = taxonomy.candidates(parts, "p_name", "p_partkey", "p_brand", "at")
    return found.withColumn("sample_ids", F.array_join(F.col("sample_ids").cast("array<string>"), ","))


@query("""
WITH r AS (SELECT *, regexp_replace(lower(p_name), '[^a-z0-9+#]', '', 'g') AS identity FROM part)
SELECT identity, arg_min(p_partkey, p_size * 100000000::BIGINT + p_partkey) AS p_partkey, CAST(sum(p_size) AS BIGINT) AS p_size, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS brands, min(p_retailprice) AS cheapest, max(p_retailprice) AS dearest, count(*) AS merged FROM r GROUP BY 1 HAVING count(*) > 1""")
def candidate_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings of one identity merged: the smallest part leads, sizes add up, brands unite."""
    parts = table(spark, sf_dir, "part").select(taxonomy.identity_key(F.col("p_name")).alias("identity"), "p_partkey", "p_size", F.array("p_brand").alias("brands"), F.col("p_retailprice").alias("cheapest"), F.col("p_retailprice").alias("dearest"))
    merged = relational.merged_groups(parts, "identity", F.col("p_size"), "p_size", ["brands"], "cheapest", "dearest", "p_partkey").where("merged > 1")
    return merged.withColumn("brands", F.array_join("brands", ","))


@query("""
UNPIVOT (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, o_orderpriority FROM orders) ON o_custkey, o_orderstatus, o_orderpriority INTO NAME field VALUE value""")
def provenance_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each field of each order."""
    return relational.unpivoted(table(spark, sf_dir, "orders"), ["o_orderkey"], ["o_custkey", "o_orderstatus", "o_orderpriority"])


@query("""
WITH j AS (SELECT c_custkey AS key, c_name, s_name, CAST(c_nationkey AS VARCHAR) AS c_nation, CAST(s_nationkey AS VARCHAR) AS s_nation FROM customer JOIN supplier ON s_suppkey = c_custkey)
SELECT key, 'name' AS field, c_name AS before, s_name AS after FROM j WHERE c_name IS DISTINCT FROM s_name UNION ALL SELECT key, 'nation', c_nation, s_nation FROM j WHERE c_nation IS DISTINCT FROM s_nation""")
def field_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What would change if suppliers replaced customers of the same key."""
    before = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    after = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return relational.differences(before, after, ["key"], ["name", "nation"])


@query("""
WITH f AS (SELECT l_orderkey, arg_min(l_shipdate, l_linenumber * 1000000000::BIGINT + l_partkey) FILTER (l_returnflag = 'R') AS first_return FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN l_shipdate ELSE first_return END AS returned FROM lineitem JOIN f USING (l_orderkey)""")
def filled_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that were not returned take the first return date of their order; of lines of the same place the first in the file counts.

    As in the SQL, a returned line keeps its own date, null or not, a line without a date, number or part is no first
    one, and lines without an order go.
    """
    is_return = F.col("l_returnflag") == "R"
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_orderkey").isNotNull()).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_shipdate", F.when(is_return, F.col("l_shipdate")).alias("first_return"),
        (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey")).alias("_place"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"),
    )
    filled = relational.filled_both_ways(lines, "l_orderkey", ["_place", "_file", "_row"], ["first_return"])
    return filled.select("l_orderkey", "l_linenumber", "l_partkey", F.when(is_return, F.col("l_shipdate")).otherwise(F.col("first_return")).alias("returned"))
