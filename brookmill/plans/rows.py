"""Pages, searches, joins and windows over the driver's tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brookmill.functions.text import has_literal
from brookmill.operators import matching, relational
from brookmill.sources.tables import table

from .registry import query

#: Event types as stages of a submission.
STAGES = {"view": "discovered", "click": "matched", "signup": "submitted", "purchase": "placed", "error": "rejected"}


@query("SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 50")
def draft_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of 50, newest first; a page is the feature here."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    return relational.page(orders, [F.desc("o_orderdate"), F.asc("o_orderkey")], 2, 50)


@query("SELECT doc_id, lang, n_chars FROM documents WHERE contains(text, '%%%')")
def search_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold `%%%`, each sign standing for itself."""
    return table(spark, sf_dir, "documents").where(has_literal(F.col("text"), "%%%")).select("doc_id", "lang", "n_chars")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def uncorrected_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(returned, "o_orderkey", "left_anti")


@query("SELECT c_custkey, c_name, c_nationkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%')")
def observed_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").startswith("1")).select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey").join(urgent, "c_custkey", "left_semi")


@query("""
SELECT o_orderkey, o_orderstatus, seen FROM (SELECT o_orderkey, o_orderstatus, (SELECT max(l_linestatus) FROM lineitem WHERE l_orderkey = o_orderkey) AS seen FROM orders) WHERE o_orderstatus IS DISTINCT FROM seen""")
def changed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose status isn't the last one seen on their lines, or that have no lines."""
    seen = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linestatus").alias("seen"))
    joined = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(seen, "o_orderkey", "left")
    return joined.where(~F.col("o_orderstatus").eqNullSafe(F.col("seen")))


@query("""
SELECT user_id, event_type, support, total, support::DOUBLE / total AS agreement FROM (SELECT user_id, event_type, count(*) AS support, CAST(sum(count(*)) OVER (PARTITION BY user_id) AS BIGINT) AS total, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY 1, 2) WHERE r = 1 AND total >= 2""")
def domain_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's commonest type, where there are two events at least."""
    return relational.majority(table(spark, sf_dir, "events"), "user_id", "event_type")


@query("""
WITH s AS (SELECT user_id, event_id, CASE event_type """ + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STAGES.items()) + """ END AS to_stage FROM events),
p AS (SELECT *, lag(to_stage) OVER (PARTITION BY user_id ORDER BY ts, s.event_id) AS from_stage FROM s JOIN (SELECT event_id, ts FROM events) USING (event_id)),
t AS (SELECT * FROM (VALUES """ + ", ".join(f"('{a}', '{b}')" for a, after in matching.TRANSITIONS.items() for b in (a, *after)) + """) v(f, g))
SELECT from_stage, to_stage, count(*) AS n, count(f) > 0 AS allowed FROM p LEFT JOIN t ON f = from_stage AND g = to_stage WHERE from_stage IS NOT NULL GROUP BY 1, 2""")
def stage_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps between each user's consecutive events, and whether the workflow allows them."""
    names = F.create_map(*[F.lit(x) for kv in STAGES.items() for x in kv])
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.try_element_at(names, F.col("event_type")).alias("to_stage"))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = events.withColumn("from_stage", F.lag("to_stage").over(order)).where("from_stage is not null").groupBy("from_stage", "to_stage").agg(F.count("*").alias("n"))
    return matching.with_allowed(steps, matching.transitions(spark), "from_stage", "to_stage")


@query("""
SELECT user_id, count(*) FILTER (event_type IS DISTINCT FROM before) AS runs, max(date_diff('second', ts, after)) AS longest_gap FROM (SELECT *, lag(event_type) OVER w AS before, lead(ts) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) GROUP BY 1""")
def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal types and the longest span to the next event, for each user."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = table(spark, sf_dir, "events").withColumn("before", F.lag("event_type").over(order)).withColumn("after", F.lead("ts").over(order))
    gap = F.unix_timestamp("after") - F.unix_timestamp("ts")
    return events.groupBy("user_id").agg(F.count_if(~F.col("event_type").eqNullSafe(F.col("before"))).alias("runs"), F.max(gap).alias("longest_gap"))


@query("""
SELECT o_custkey, o_orderkey, o_totalprice, runner_up, o_totalprice - runner_up AS margin FROM (SELECT *, row_number() OVER w AS r, lead(o_totalprice) OVER w AS runner_up FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)) WHERE r = 1""")
def best_with_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return relational.with_margin(orders, "o_custkey", "o_totalprice", "o_orderkey")


@query("""
WITH r AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS skills, string_split(lower(p_type), ' ') AS wanted, [lower(p_brand)] AS preferred, p_size AS have, 25 AS want, CASE WHEN p_size > 40 THEN 'GC' END AS auth, p_type AS place FROM part),
s AS (SELECT p_partkey, CASE WHEN len(list_distinct(wanted)) > 0 THEN 100.0::DOUBLE * len(list_intersect(list_distinct(wanted), skills)) / len(list_distinct(wanted)) ELSE 100 END AS required_skill_score, 100.0::DOUBLE * len(list_intersect(preferred, skills)) AS preferred_skill_score, CASE WHEN have >= want THEN 100.0 ELSE 100.0::DOUBLE * have / want END AS years_score, CASE WHEN auth IS NULL THEN 50.0 ELSE 100.0 END AS work_authorization_score, 100.0::DOUBLE AS location_score FROM r),
m AS (SELECT *, required_skill_score * 0.55::DOUBLE + preferred_skill_score * 0.15::DOUBLE + years_score * 0.15::DOUBLE + work_authorization_score * 0.1::DOUBLE + location_score * 0.05::DOUBLE AS match_score FROM s)
SELECT p_partkey, required_skill_score, preferred_skill_score, years_score::DOUBLE AS years_score, work_authorization_score::DOUBLE AS work_authorization_score, round(match_score, 6) AS match_score, CASE WHEN round(match_score, 9) >= 80 AND required_skill_score >= 100 AND years_score >= 80 AND work_authorization_score > 0 THEN 'submit' WHEN round(match_score, 9) >= 60 AND required_skill_score >= 60 AND work_authorization_score > 0 THEN 'review' ELSE 'reject' END AS decision FROM m""")
def match_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's name as a resume's skills against its type as a job's: overlap, years, authorisation, place."""
    part = table(spark, sf_dir, "part")
    resume = F.struct(F.split("p_name", " ").alias("skills"), F.col("p_size").cast("double").alias("years_experience"), F.when(F.col("p_size") > 40, "GC").alias("work_authorization"), F.lit("remote").alias("location"))
    job = F.struct(F.split("p_type", " ").alias("required_skills"), F.array("p_brand").alias("preferred_skills"), F.lit(25.0).alias("years_experience"), F.lit("gc").alias("work_authorization"), F.col("p_type").alias("location"))
    scored = matching.scored_pairs(part.select("p_partkey", resume.alias("resume"), job.alias("job")))
    sure = matching.decision(F.round("match_score", 9), F.col("required_skill_score"), F.col("years_score"), F.col("work_authorization_score"))
    return scored.select("p_partkey", "required_skill_score", "preferred_skill_score", "years_score", "work_authorization_score", F.round("match_score", 6).alias("match_score"), sure.alias("decision"))


@query("SELECT s_nationkey, n_name, r_name, count(*) AS suppliers, count(*) FILTER (s_acctbal < 0) AS in_debt FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2, 3")
def resolved_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges resolved to the names of their nodes."""
    supplier, nation, region = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = supplier.join(nation, F.col("n_nationkey") == F.col("s_nationkey")).join(region, F.col("r_regionkey") == F.col("n_regionkey"))
    return joined.groupBy("s_nationkey", "n_name", "r_name").agg(F.count("*").alias("suppliers"), F.count_if(F.col("s_acctbal") < 0).alias("in_debt"))


@query("SELECT c_custkey, c_name, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS finished, EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey) AS supplied FROM customer")
def correction_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Existence as columns."""
    finished = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("_f", F.lit(True))
    supplied = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("c_nationkey")).distinct().withColumn("_s", F.lit(True))
    joined = table(spark, sf_dir, "customer").join(finished, "c_custkey", "left").join(supplied, "c_nationkey", "left")
    return joined.select("c_custkey", "c_name", F.coalesce("_f", F.lit(False)).alias("finished"), F.coalesce("_s", F.lit(False)).alias("supplied"))
