"""Upkeep of a dictionary made of parts, and company observations, over the driver's tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookmill.functions import text as X
from brookmill.operators import relational, taxonomy, upkeep
from brookmill.sources.tables import table

from .registry import query


def _entries(spark: SparkSession, sf_dir: str, condition: str) -> DataFrame:
    """Part types that meet a condition as entries: brands as aliases, the smallest name as description."""
    return table(spark, sf_dir, "part").where(condition).groupBy(F.col("p_type").alias("canonical")).agg(F.array_sort(F.collect_set("p_brand")).alias("aliases"), F.lit("part").alias("category"), F.min("p_name").alias("description"))


def _shown(entries: DataFrame) -> DataFrame:
    return entries.withColumn("aliases", F.array_join("aliases", ","))


_OLD = "SELECT p_type AS canonical, list(DISTINCT p_brand) AS b, min(p_name) AS description FROM part WHERE p_size <= 25 AND p_type < 'PROMO' GROUP BY 1"


@query("""
SELECT p_type AS canonical, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS aliases, 'part' AS category, coalesce(min(p_name) FILTER (p_size <= 25 AND p_type < 'PROMO'), min(p_name) FILTER (p_size > 25)) AS description
FROM part WHERE p_size > 25 OR p_type < 'PROMO' GROUP BY 1""")
def entries_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New entries beside the old; equal names (whatever their case and marks) are united."""
    old = _entries(spark, sf_dir, "p_size <= 25 and p_type < 'PROMO'")
    new = _entries(spark, sf_dir, "p_size > 25")
    shouted = new.withColumn("canonical", F.concat(F.lower("canonical"), F.lit("!")))
    return _shown(upkeep.with_entries(old, shouted).withColumn("canonical", F.upper(F.translate("canonical", "!", ""))))


@query(f"""
WITH o AS ({_OLD})
SELECT CASE WHEN canonical < 'LARGE' THEN 'new ' || canonical ELSE canonical END AS canonical, array_to_string(list_sort(CASE WHEN canonical < 'LARGE' THEN list_append(b, canonical) ELSE b END), ',') AS aliases, CASE WHEN canonical < 'MEDIUM' THEN 'moved' ELSE 'part' END AS category, description FROM o WHERE canonical NOT LIKE 'M%'""")
def entries_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries renamed, moved to another category, and deleted."""
    old = _entries(spark, sf_dir, "p_size <= 25 and p_type < 'PROMO'")
    changes = old.where("canonical < 'MEDIUM'").select(F.lower("canonical").alias("canonical"), F.when(F.col("canonical") < "LARGE", F.concat(F.lit("new "), "canonical")).alias("new_name"), F.lit("moved").alias("category"))
    gone = old.where("canonical like 'M%'").select(F.concat(F.lit(" "), "canonical", F.lit(".")).alias("canonical")).withColumn("canonical", F.translate("canonical", ".", "-"))
    return _shown(upkeep.without_entries(upkeep.renamed(old, changes), gone))


@query("""
SELECT p_type AS canonical, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS aliases, CASE WHEN p_type < 'MEDIUM' THEN 'found' ELSE 'part' END AS category, CASE WHEN p_type < 'LARGE' THEN 'about ' || p_type ELSE min(p_name) END AS description FROM part GROUP BY 1""")
def entries_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty descriptions and generic categories filled, others left."""
    old = _entries(spark, sf_dir, "true").withColumns({"category": F.when(F.col("canonical") < "MEDIUM", "Uncategorized").otherwise(F.col("category")), "description": F.when(F.col("canonical") < "LARGE", "").otherwise(F.col("description"))})
    found = old.select("canonical", F.lit("found").alias("category"), F.concat(F.lit("about "), "canonical").alias("description"))
    return _shown(upkeep.enriched(old, found))


@query("""
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'own_name' WHEN 2 THEN 'unknown_target' WHEN 3 THEN 'self_relation' END AS problem FROM part""")
def flagged_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed aliases and relations, and what is wrong with them."""
    parts, k = table(spark, sf_dir, "part"), F.col("p_partkey") % 5
    index = taxonomy.alias_index(_entries(spark, sf_dir, "true"))
    value = F.when(k == 0, F.lower("p_type")).when(k == 1, F.concat(F.lit("fresh "), "p_partkey")).when(k == 2, "nowhere").when(k == 3, F.col("p_type")).otherwise(F.concat(F.lit("also new "), "p_partkey"))
    kind = F.when(k.isin(2, 3), "relation").otherwise("alias")
    return upkeep.flagged_proposals(parts.select("p_partkey", F.col("p_type").alias("canonical"), kind.alias("kind"), value.alias("value")), index).select("p_partkey", "problem")


@query("""
SELECT event_type AS kind, 'k' || (user_id % 10) AS key, array_to_string(list_sort(list(DISTINCT CASE WHEN event_id % 2 = 0 THEN 'aliases' ELSE 'definition' END)), ',') AS fields, count(DISTINCT user_id) AS evidence, max(event_id) AS last_at FROM events GROUP BY 1, 2""")
def merged_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions of one term as one request."""
    term = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("K"), F.col("user_id") % 10)).otherwise(F.concat(F.lit("k"), F.col("user_id") % 10, F.lit("!")))
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), term.alias("term"), F.array(F.when(F.col("event_id") % 2 == 0, "aliases").otherwise("definition")).alias("fields"), F.col("user_id").alias("evidence"), F.col("event_id").alias("at"))
    return upkeep.merged_requests(rows).select("kind", "key", F.array_join("fields", ",").alias("fields"), "evidence", "last_at")


@query("""
SELECT p_partkey, p_name AS title, CASE WHEN p_size % 4 = 3 THEN 'approve' WHEN p_size % 4 = 2 THEN 'review' ELSE 'reject' END AS decision FROM part""")
def titles_and_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles without the place of work, and lines judged as boilerplate."""
    k = F.col("p_size") % 4
    title = F.when(k == 0, F.concat("p_name", F.lit(" - NY Onsite"))).when(k == 1, F.concat("p_name", F.lit(" (Remote)"))).when(k == 2, F.concat("p_name", F.lit(" in Brooklyn"))).otherwise(F.col("p_name"))
    line = F.when(k == 0, "Location: Austin").when(k == 1, F.concat(F.lit("needs "), "p_size", F.lit("+ years of it"))).when(k == 2, "our office is nice").otherwise("Click  HERE to leave")
    return table(spark, sf_dir, "part").select("p_partkey", upkeep.bare_title(title).alias("title"), upkeep.boilerplate_decision(line).alias("decision"))


@query("""
SELECT o_orderkey, s.canonical, CASE WHEN s.canonical = 'sql' THEN 'required' WHEN s.canonical = 'java' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'preferred' ELSE 'mentioned' END ELSE 'excluded' END AS context FROM orders, (VALUES ('sql'), ('java'), ('cobol')) s(canonical)""")
def cued_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which skills a requirement asks for, welcomes, rules out, or only names."""
    parts = F.array(F.lit("We use sql and java."), F.when(F.col("o_orderkey") % 2 == 0, "Java is nice to have;").otherwise("Java is known;"), F.lit("SQL is a must-have."), F.lit("without cobol"))
    clauses = table(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(parts).alias("at", "clause"))
    names = F.array(F.lit("sql"), F.lit("java"), F.lit("cobol"))
    terms = clauses.select("o_orderkey", "at", F.explode(F.filter(names, lambda n: X.has_phrase(F.col("clause"), n))).alias("canonical"))
    return upkeep.cued_skills(clauses, terms, "o_orderkey", "clause")


@query("""
SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'acme.io' WHEN 1 THEN 'web.io' WHEN 2 THEN 'sender.io' WHEN 3 THEN 'sender.io' END AS domain, CASE c_custkey % 5 WHEN 3 THEN 'sender.io' WHEN 4 THEN NULL ELSE c_name END AS name,
CASE c_custkey % 5 WHEN 0 THEN 'signature' WHEN 1 THEN 'signature' WHEN 4 THEN 'none' ELSE 'sender_domain' END AS method, CASE c_custkey % 5 WHEN 0 THEN 'linked_signature' WHEN 1 THEN 'linked_signature' WHEN 4 THEN 'corporate_signature_email_missing' ELSE 'linked_sender_domain' END AS reason FROM customer""")
def company_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The company behind each message, by signature, website or sender."""
    k = F.col("c_custkey") % 5
    contact = F.when(k == 0, "Ann@Acme.io").otherwise("ann@gmail.com")
    website = F.when(k == 1, "https://www.web.io/about")
    sender = F.when(k == 4, "x@groups.google.com").otherwise("y@Sender.io")
    found = upkeep.company_observation(X.company_name(F.when(k != 3, F.concat("c_name", F.lit(" | Dallas")))), contact, website, sender)
    return table(spark, sf_dir, "customer").select("c_custkey", found.alias("o")).select("c_custkey", "o.domain", "o.name", "o.method", "o.reason")


@query("""
SELECT p_type, count(*) AS n, count(*) FILTER (p_size > 40) AS corrected FROM part WHERE p_brand != 'Brand#11' GROUP BY 1""")
def corrections_of_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineage rows and reviewers' corrections by run, without blocked brands."""
    parts = table(spark, sf_dir, "part")
    blocked = parts.where("p_brand = 'Brand#11'").select("p_brand").distinct()
    kept = parts.join(blocked, "p_brand", "left_anti")
    corrected = relational.unpivoted(kept.select("p_partkey", "p_type", F.when(F.col("p_size") > 40, "reviewer").alias("reviewer_correction")), ["p_partkey", "p_type"], ["reviewer_correction"])
    totals = relational.counters(kept, ["p_type"])
    return totals.join(corrected.groupBy("p_type").agg(F.count("*").alias("corrected")), "p_type", "left").withColumn("corrected", F.coalesce("corrected", F.lit(0)))
