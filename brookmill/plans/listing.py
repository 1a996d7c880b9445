"""Lists, look-ups, sets and JSON over the driver's tables, and the dictionary's own reports."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookmill.functions.numbers import percent, within_days
from brookmill.operators import listing, relational, taxonomy, understanding
from brookmill.sources.tables import table

from .registry import query
from .reports import newest


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = 42")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row by its key; the filter reaches the scan."""
    return table(spark, sf_dir, "customer").where("c_custkey = 42").select("c_custkey", "c_name", "c_mktsegment")


@query("""
SELECT c_custkey, c_name, last_seen FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_seen FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey ORDER BY last_seen DESC NULLS LAST, lower(c_name), c_custkey LIMIT 40""")
def company_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forty customers seen last, those never seen at the end; a page is the feature."""
    seen = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last_seen"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(seen, "c_custkey", "left")
    return relational.page(rows, listing.sorted_list(rows, ("last_seen", "desc_last"), ("c_name", "asc_fold"), ("c_custkey", "asc")), 1, 40)


@query("""
WITH n AS (SELECT DISTINCT p_type AS name, lower(p_type) AS k FROM part), s AS (SELECT name, CASE WHEN starts_with(k, 'pro') THEN 300 - length(k) WHEN contains(k, 'pro') THEN 201 - instr(k, 'pro') ELSE 0 END AS rank_score FROM n)
SELECT name, rank_score FROM s WHERE rank_score >= 75 ORDER BY rank_score DESC, lower(name), name LIMIT 50""")
def search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty types that fit a search best; the cap is the feature."""
    return listing.search_rank(table(spark, sf_dir, "part").select(F.col("p_type").alias("name")).distinct(), "name", " Pro ")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderdate END NULLS FIRST, o_orderkey LIMIT 25")
def oldest_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch to take up next: never touched, then longest ago. The size is the feature."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("touched"))
    return listing.oldest_batch(orders, "touched", "o_orderkey", 25).select("o_orderkey", "o_orderdate")


@query("""
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_concat(string_split(lower(p_name), ' '), string_split(lower(p_type), ' ')), lambda x: x != lower(p_brand)))), ',') AS united,
array_to_string(list_sort(list_filter(list_distinct(string_split(lower(p_type), ' ')), lambda x: NOT list_contains(string_split(lower(p_name), ' '), x))), ',') AS missing,
CASE WHEN p_size > 40 THEN '' WHEN p_size > 20 THEN 'write' ELSE 'read,write' END AS lacking, CASE WHEN p_size % 2 = 0 THEN 'SQL,Java' ELSE 'java' END AS once FROM part""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unions, differences and missing permissions of small sets, and values once whatever their case."""
    words = lambda c: F.split(F.lower(c), " ")
    granted = F.when(F.col("p_size") > 40, F.array(F.lit("*"))).when(F.col("p_size") > 20, F.array(F.lit("read")))
    spelled = F.when(F.col("p_size") % 2 == 0, F.array(F.lit(" SQL"), F.lit("Java"), F.lit("sql "), F.lit(""))).otherwise(F.array(F.lit("java"), F.lit("JAVA")))
    missing = listing.still_missing(words("p_type"), F.array().cast("array<string>"), words("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(listing.other_names(words("p_name"), words("p_type"), F.lower("p_brand")), ",").alias("united"), F.array_join(F.array_sort(missing), ",").alias("missing"), F.array_join(listing.lacking(F.array(F.lit("write"), F.lit("read")), granted), ",").alias("lacking"), F.array_join(listing.folded_once(spelled), ",").alias("once"))


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'object' WHEN 1 THEN 'array' WHEN 2 THEN 'string' END AS kind, CASE WHEN event_id % 4 = 1 THEN 2 ELSE 0 END AS items, event_type || '/' || CASE WHEN event_id % 2 = 0 THEN 'new' ELSE 'old' END || '/' || CAST(user_id AS VARCHAR) AS merged FROM events""")
def json_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds and lengths of JSON texts, and objects merged."""
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.col("props")).when(k == 1, "[1, [2]]").when(k == 2, '"x"').otherwise("{oops")
    old = F.create_map(F.lit("type"), F.col("event_type"), F.lit("state"), F.lit("old"))
    new = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("state"), F.lit("new"), F.lit("user"), F.col("user_id").cast("string"))).otherwise(F.create_map(F.lit("user"), F.col("user_id").cast("string")))
    rows = table(spark, sf_dir, "events").select("event_id", text.alias("t"), listing.merged(old, new).alias("m"))
    return rows.select("event_id", listing.json_kind(F.col("t")).alias("kind"), listing.json_length(F.col("t")).alias("items"), F.concat_ws("/", F.col("m")["type"], F.col("m")["state"], F.col("m")["user"]).alias("merged"))


@query("""
SELECT event_id, event_type, '{"user_id":' || user_id || ',"props":' || to_json(props) || '}' AS detail FROM events""")
def intake_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed columns, and the rest of each row as JSON."""
    return listing.with_rest(table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "props"), ["event_id", "event_type"])


@query("SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem JOIN orders ON CAST(o_orderkey AS VARCHAR) = CAST(l_orderkey AS VARCHAR) WHERE l_returnflag = 'R'")
def cast_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provenance rows whose run is the text of a draft's key."""
    runs = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", F.col("l_orderkey").cast("string").alias("run"))
    drafts = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return runs.join(drafts, F.col("o_orderkey").cast("string") == F.col("run")).select("l_orderkey", "l_linenumber", "o_orderstatus")


_AGE = "(SELECT max(o_orderdate) FROM orders) - INTERVAL {} DAY"


@query(f"""
SELECT o_orderpriority AS signal_type, count(*) FILTER (o_orderdate >= {_AGE.format(7)}) AS added_7d, count(*) FILTER (o_orderdate >= {_AGE.format(30)}) AS added_30d, (SELECT count(*) FROM part) AS total_skills, (SELECT count(DISTINCT p_type) FROM part) AS total_titles FROM orders WHERE o_orderstatus = 'F' GROUP BY 1""")
def taxonomy_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was added to the dictionary in the last week and month, and its size."""
    orders, parts = table(spark, sf_dir, "orders"), table(spark, sf_dir, "part")
    since = lambda days: F.count_if(within_days(F.col("o_orderdate"), newest(orders, "o_orderdate"), days))
    added = orders.where("o_orderstatus = 'F'").groupBy(F.col("o_orderpriority").alias("signal_type")).agg(since(7).alias("added_7d"), since(30).alias("added_30d"))
    return added.withColumns({"total_skills": parts.agg(F.count("*")).scalar(), "total_titles": parts.agg(F.countDistinct("p_type")).scalar()})


@query("""
SELECT event_type, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total, round(sum(coalesce(value, 0)) / count(*), 6)::DOUBLE AS avg_confidence, 100.0::DOUBLE * count(*) FILTER (user_id % 3 = 0) / count(*) AS needs_review_pct FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1""")
def parsing_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume and confidence of a week's drafts by type; the total is of all types."""
    events = table(spark, sf_dir, "events")
    recent = events.where(within_days(F.col("ts"), newest(events, "ts"), 7))
    types = recent.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum(F.coalesce("value", F.lit(0.0))) / F.count("*"), 6).alias("avg_confidence"), percent(F.count_if(F.col("user_id") % 3 == 0), F.count("*")).alias("needs_review_pct"))
    return types.withColumn("total", recent.agg(F.count("*")).scalar())


@query("""
WITH f AS (SELECT l_linestatus || l_returnflag AS field, count(*) AS filled, count(*) FILTER (l_quantity > 49) AS wrong, 100.0::DOUBLE * sum(1 - l_discount) / count(*) AS avg_confidence FROM lineitem GROUP BY 1)
SELECT field, filled, wrong, round(avg_confidence, 6)::DOUBLE AS avg_confidence, 100.0::DOUBLE * (filled - wrong) / filled AS precision, filled >= 100 AND wrong = 0 AND avg_confidence < 85 AS needs_spot_check FROM f""")
def signature_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision of each field, and which fields nobody corrects although they are unsure."""
    lines = table(spark, sf_dir, "lineitem")
    fields = lines.groupBy(F.concat("l_linestatus", "l_returnflag").alias("field")).agg(F.count("*").alias("filled"), F.count_if(F.col("l_quantity") > 49).alias("wrong"), percent(F.sum(1 - F.col("l_discount")), F.count("*")).alias("avg"))
    return fields.select("field", "filled", "wrong", F.round("avg", 6).alias("avg_confidence"), percent(F.col("filled") - F.col("wrong"), F.col("filled")).alias("precision"), ((F.col("filled") >= 100) & (F.col("wrong") == 0) & (F.col("avg") < 85)).alias("needs_spot_check"))


@query("""
SELECT 'events' AS section, event_type AS name, count(*) AS n FROM events GROUP BY 1, 2 UNION ALL SELECT 'orders', o_orderstatus, count(*) FROM orders GROUP BY 1, 2 UNION ALL SELECT 'segments', c_mktsegment, count(*) FROM customer GROUP BY 1, 2 UNION ALL SELECT 'languages', coalesce(lang, '?'), count(*) FROM documents GROUP BY 1, 2""")
def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections of an overview as rows of one table."""
    of = lambda section, name, column: relational.counters(table(spark, sf_dir, name).select(F.lit(section).alias("section"), F.coalesce(F.col(column).cast("string"), F.lit("?")).alias("name")), ["section", "name"])
    return of("events", "events", "event_type").unionByName(of("orders", "orders", "o_orderstatus")).unionByName(of("segments", "customer", "c_mktsegment")).unionByName(of("languages", "documents", "lang"))


@query("""
WITH u AS (SELECT l_partkey, count(*) AS uses, max(l_shipdate) AS last_seen FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT p_partkey, p_name, coalesce(uses, 0) AS uses, last_seen FROM part LEFT JOIN u ON l_partkey = p_partkey WHERE p_type LIKE '%TIN%' OR p_size > 45 ORDER BY last_seen NULLS LAST, lower(p_name), p_partkey LIMIT 30""")
def browse_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the dictionary with its use, least recent first; a page is the feature."""
    uses = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("uses"), F.max("l_shipdate").alias("last_seen"))
    parts = table(spark, sf_dir, "part").where(F.col("p_type").contains("TIN") | (F.col("p_size") > 45)).select("p_partkey", "p_name")
    rows = parts.join(uses, "p_partkey", "left").withColumn("uses", F.coalesce("uses", F.lit(0)))
    return relational.page(rows, listing.sorted_list(rows, ("last_seen", "asc_last"), ("p_name", "asc_fold"), ("p_partkey", "asc")), 1, 30)


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_acctbal > 0 AND lower(s_name) LIKE '%supplier%' ORDER BY s_acctbal DESC, s_suppkey LIMIT 20")
def pending_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty candidates met most often that hold a text; the cap is the feature."""
    rows = table(spark, sf_dir, "supplier").where((F.col("s_acctbal") > 0) & F.col("s_name").ilike("%supplier%"))
    return rows.orderBy(F.desc("s_acctbal"), "s_suppkey").limit(20).select("s_suppkey", "s_name", "s_acctbal")


@query("""
WITH k AS (SELECT regexp_replace(lower(p_name), '[^a-z0-9+#]', '', 'g') AS identity, p_name FROM part)
SELECT identity, min(p_name) AS term, count(*) AS n FROM k WHERE identity NOT IN (SELECT regexp_replace(lower(p_name), '[^a-z0-9+#]', '', 'g') FROM part WHERE p_size > 45) GROUP BY 1""")
def unknown_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that no entry of the dictionary spells, whatever marks stand between their words."""
    parts = table(spark, sf_dir, "part")
    known = parts.where("p_size > 45").select(F.translate("p_name", " ", "-").alias("canonical")).distinct().withColumn("aliases", F.array().cast("array<string>"))
    return taxonomy.unknown_terms(parts, taxonomy.alias_index(known), "p_name")


@query("SELECT 'canonical' AS kind, count(DISTINCT p_type) AS n, max(p_type) AS last FROM part UNION ALL SELECT 'alias', count(DISTINCT p_brand || ' ' || p_type), max(p_brand || ' ' || p_type) FROM part")
def taxonomy_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the dictionary by kind of name."""
    parts = table(spark, sf_dir, "part")
    entries = parts.groupBy(F.col("p_type").alias("canonical")).agg(F.collect_set(F.concat("p_brand", F.lit(" "), "p_type")).alias("aliases"))
    spelled = entries.select("canonical", F.explode(F.concat(F.array(F.struct(F.lit("canonical").alias("kind"), F.col("canonical").alias("name"))), F.transform("aliases", lambda a: F.struct(F.lit("alias").alias("kind"), a.alias("name"))))).alias("x"))
    return spelled.groupBy("x.kind").agg(F.count("*").alias("n"), F.max("x.name").alias("last"))


@query("SELECT p_type AS canonical, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS aliases, count(DISTINCT p_size) AS sizes, arg_max(p_name, length(p_name) * 100000000::BIGINT - p_partkey) AS longest FROM part GROUP BY 1")
def skill_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card for each entry: its names, its relations, and its longest phrase."""
    cards = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("canonical")).agg(F.array_sort(F.collect_set("p_brand")).alias("aliases"), F.countDistinct("p_size").alias("sizes"), F.max_by("p_name", F.struct(F.length("p_name"), -F.col("p_partkey"))).alias("longest"))
    return cards.withColumn("aliases", F.array_join("aliases", ","))


@query("""
SELECT doc_id, CASE WHEN length(trim(text)) < 20 THEN true ELSE false END AS short FROM documents""")
def short_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts too short for a language to be told."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", understanding.language(F.col("text")).alias("lang"))
    return docs.select("doc_id", ((F.length(F.trim("text")) < 20) & (F.col("lang") == "unknown")).alias("short"))
