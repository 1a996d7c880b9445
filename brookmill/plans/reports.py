"""Operational reports over the event log, orders and labels."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brookmill.functions.numbers import percent, whole_days, within_days
from brookmill.functions.text import url_host
from brookmill.operators import matching, relational
from brookmill.operators.extract import is_automated
from brookmill.sources.tables import table

from .registry import query

TYPES = ("click", "error", "purchase", "signup", "view")


def newest(df: DataFrame, column: str) -> Column:
    """The greatest value of a column, as a scalar subquery of the same plan: the time that a report is as of."""
    return df.agg(F.max(column)).scalar()


@query("""
WITH d AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) FILTER (event_type = 'view') AS received, count(*) FILTER (event_type = 'click') AS parsed, count(*) FILTER (event_type = 'error') AS duplicate FROM events GROUP BY 1)
SELECT *, greatest(0, received - parsed - duplicate) AS unaccounted, CASE WHEN received > 0 THEN 100.0::DOUBLE * parsed / received END AS processing_rate_pct, received / 24.0::DOUBLE AS received_per_hour FROM d""")
def ingestion_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What arrived each day and what became of it: views as received, clicks as parsed, errors as duplicates."""
    is_type = lambda t: F.count_if(F.col("event_type") == t)
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(is_type("view").alias("received"), is_type("click").alias("parsed"), is_type("error").alias("duplicate"))
    return days.select("*", F.greatest(F.lit(0), F.expr("received - parsed - duplicate")).alias("unaccounted"), percent(F.col("parsed"), F.col("received")).alias("processing_rate_pct"), (F.col("received") / 24.0).alias("received_per_hour"))


@query("SELECT json_extract_string(props, '$.k') AS channel, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1")
def ingestion_by_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only received rows count towards a channel's volume."""
    events = table(spark, sf_dir, "events").where("event_type = 'view'")
    return events.groupBy(F.get_json_object("props", "$.k").alias("channel")).agg(F.count("*").alias("n"))


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS {t}" for t in TYPES) + ", count(*) AS total FROM events GROUP BY 1")
def classification_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").cast("string").alias("day"))
    counts = days.pivot("event_type", list(TYPES)).count().na.fill(0)
    return counts.withColumn("total", sum((F.col(t) for t in TYPES), F.lit(0)))


@query("""
SELECT event_type, count(*) AS n, 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS pct_of_total, round(sum(coalesce(value, 0)) / count(*), 6) AS avg_value
FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1""")
def classification_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of the last seven days; a null value counts as 0 in the average."""
    events = table(spark, sf_dir, "events")
    recent = events.where(within_days(F.col("ts"), newest(events, "ts"), 7))
    types = recent.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum(F.coalesce("value", F.lit(0.0))) / F.count("*"), 6).alias("avg_value"))
    return types.withColumn("pct_of_total", percent(F.col("n"), F.sum("n").over(Window.partitionBy())))


@query("""
SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n, count(DISTINCT o_custkey) AS customers, count(*) FILTER (o_totalprice > 200000) AS needs_review
FROM orders WHERE o_totalprice >= 1000 AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 365 DAY GROUP BY 1, 2""")
def filtered_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slice by optional filters, those unset left out."""
    orders = table(spark, sf_dir, "orders")
    status = None
    kept = relational.where_all(
        orders,
        F.col("o_totalprice") >= 1000,
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"),
        within_days(F.col("o_orderdate"), newest(orders, "o_orderdate"), 365),
        F.col("o_orderstatus") == status if status else None,
    )
    return kept.groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"), F.count_if(F.col("o_totalprice") > 200000).alias("needs_review"))


@query("""
SELECT event_type, count(*) AS pending, min(ts) AS oldest, CAST(floor((epoch((SELECT max(ts) FROM events)) - epoch(min(ts))) / 86400) AS BIGINT) AS oldest_days
FROM events GROUP BY 1 HAVING event_type != 'error' OR count(DISTINCT user_id) >= 8""")
def queue_health_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backlog and age of each queue; errors only where eight users at least met them."""
    events = table(spark, sf_dir, "events")
    queues = events.groupBy("event_type").agg(F.count("*").alias("pending"), F.min("ts").alias("oldest"), F.countDistinct("user_id").alias("users"))
    seen = queues.where((F.col("event_type") != "error") | (F.col("users") >= 8)).drop("users")
    as_of = events.agg(F.date_trunc("second", F.max("ts"))).scalar()
    return seen.withColumn("oldest_days", whole_days(F.col("oldest"), as_of))


@query("""
WITH d AS (SELECT o_orderkey, bool_or(l_returnflag = 'R') AS ai_used FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 90 DAY GROUP BY 1)
SELECT count(*) AS total, count(*) FILTER (ai_used) AS assisted, count(*) - count(*) FILTER (ai_used) AS parser_only, CASE WHEN count(*) > 0 THEN 100.0::DOUBLE * count(*) FILTER (ai_used) / count(*) END AS assisted_pct FROM d""")
def ai_dependency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of recent orders with a returned line; orders without lines count as not."""
    orders = table(spark, sf_dir, "orders")
    recent = orders.where(within_days(F.col("o_orderdate"), newest(orders, "o_orderdate"), 90)).select("o_orderkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag")
    used = recent.join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy("o_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("ai_used"))
    totals = used.agg(F.count("*").alias("total"), F.count_if("ai_used").alias("assisted"))
    return totals.select("total", "assisted", F.expr("total - assisted").alias("parser_only"), percent(F.col("assisted"), F.col("total")).alias("assisted_pct"))


@query("SELECT line AS reason, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line != '' GROUP BY 1 ORDER BY n DESC, reason LIMIT 20")
def review_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 commonest lines of all documents."""
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("reason")).where("reason != ''")
    return lines.groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(20)


@query("""
WITH t AS (SELECT count(*) AS total FROM documents),
f AS (SELECT lang AS field, count(*) FILTER (quality = 1) AS filled, count(*) FILTER (quality = 1 AND toxic = 1) AS corrected_wrong, count(*) FILTER (quality = 0) AS corrected_missing, coalesce(sum(CASE WHEN quality = 1 THEN 0.5 + 0.5 * toxic END), 0)::DOUBLE AS s FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT field, filled, corrected_wrong, corrected_missing, CASE WHEN filled > 0 THEN 100.0::DOUBLE * greatest(0, filled - corrected_wrong) / filled END AS precision, 100.0::DOUBLE * filled / total AS fill_rate, CASE WHEN filled > 0 THEN 100.0::DOUBLE * s / filled END AS avg_confidence, CASE WHEN filled > 0 THEN 100.0::DOUBLE * s / filled - 100.0::DOUBLE * greatest(0, filled - corrected_wrong) / filled END AS calibration_gap, filled >= 20 AS reliable FROM f, t""")
def accuracy_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, fill rate and calibration by language: quality as filled, toxicity as corrected."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("field"))
    rows = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    good, bad = F.col("quality") == 1, F.col("toxic") == 1
    return matching.accuracy(rows, "field", good, good & bad, F.col("quality") == 0, 0.5 + 0.5 * F.col("toxic"), docs.count())


@query("""
WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host FROM pages),
g AS (SELECT 'host' AS grain, host AS value, page_id FROM h UNION ALL SELECT 'domain', regexp_extract(host, '[^.]+[.][^.]+$', 0), page_id FROM h)
SELECT grain, value, count(*) AS n, min(page_id) AS first_page FROM g GROUP BY 1, 2""")
def sender_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two grains in one pass: whole hosts and their last two labels."""
    host = table(spark, sf_dir, "pages").select("page_id", url_host(F.col("url")).alias("host"))
    grains = F.array(F.struct(F.lit("host").alias("grain"), F.col("host").alias("value")), F.struct(F.lit("domain").alias("grain"), F.regexp_extract("host", r"[^.]+\.[^.]+$", 0).alias("value")))
    return host.select("page_id", F.inline(grains)).groupBy("grain", "value").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


@query("""
WITH s AS (SELECT o_custkey, count(*) AS sources, count(DISTINCT o_orderpriority) AS kinds, max(o_orderdate) AS last_seen FROM orders GROUP BY 1)
SELECT c_custkey, c_name, coalesce(sources, 0) AS sources, coalesce(kinds, 0) AS kinds, last_seen FROM customer LEFT JOIN s ON o_custkey = c_custkey WHERE c_name ILIKE '%customer%' OR EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c_custkey AND o.o_orderstatus = 'P')""")
def company_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer with its statistics (zero without orders), by name or by an order of a status."""
    orders = table(spark, sf_dir, "orders")
    stats = orders.groupBy("o_custkey").agg(F.count("*").alias("sources"), F.countDistinct("o_orderpriority").alias("kinds"), F.max("o_orderdate").alias("last_seen"), F.bool_or(F.col("o_orderstatus") == "P").alias("pending"))
    joined = table(spark, sf_dir, "customer").join(stats, F.col("o_custkey") == F.col("c_custkey"), "left")
    kept = joined.where(F.col("c_name").ilike("%customer%") | F.coalesce("pending", F.lit(False)))
    return kept.select("c_custkey", "c_name", F.coalesce("sources", F.lit(0)).alias("sources"), F.coalesce("kinds", F.lit(0)).alias("kinds"), "last_seen")


@query("""
SELECT c_nationkey, c_mktsegment AS label, n FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n, row_number() OVER (PARTITION BY c_nationkey ORDER BY bool_or(c_acctbal < 0) DESC, count(*) DESC, c_mktsegment) AS r FROM customer GROUP BY 1, 2) WHERE r = 1""")
def best_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's best segment: one with a negative balance first, then the commonest, then by name."""
    labels = table(spark, sf_dir, "customer").groupBy("c_nationkey", F.col("c_mktsegment").alias("label")).agg(F.count("*").alias("n"), F.bool_or(F.col("c_acctbal") < 0).alias("edited"))
    return relational.top_per_key(labels, ["c_nationkey"], [F.desc("edited"), F.desc("n"), F.asc("label")]).drop("edited")


@query("""
WITH r AS (SELECT o_custkey, count(DISTINCT CASE WHEN w THEN o_orderkey END) AS jobs, count(DISTINCT CASE WHEN w THEN o_orderpriority END) AS contacts, count(*) FILTER (w) AS sources FROM (SELECT *, o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY AS w FROM orders) GROUP BY 1)
SELECT *, least(60, jobs * 3) + least(25, contacts * 5) + CASE WHEN sources > 0 THEN 15 ELSE 0 END AS score FROM r""")
def activity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return matching.activity(orders, "o_custkey", "o_orderkey", "o_orderpriority", "o_orderdate", newest(orders, "o_orderdate"))


@query("""
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) FILTER (event_type = 'purchase' AND a) AS approved_automated, count(*) FILTER (event_type = 'purchase' AND NOT a) AS approved_human, count(*) FILTER (event_type = 'error' AND a) AS rejected_automated, count(*) FILTER (event_type = 'error' AND NOT a) AS rejected_human
FROM (SELECT *, CAST(user_id AS VARCHAR) LIKE '1%' AS a FROM events) WHERE event_type IN ('purchase', 'error') GROUP BY 1""")
def triage_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily decisions, automated or not; the reviewers whose name starts with 1 are automated."""
    events = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "error")).withColumn("a", is_automated(F.col("user_id").cast("string"), ("1",)))
    count = lambda t, a: F.count_if((F.col("event_type") == t) & (F.col("a") == a))
    return events.groupBy(F.to_date("ts").cast("string").alias("day")).agg(count("purchase", True).alias("approved_automated"), count("purchase", False).alias("approved_human"), count("error", True).alias("rejected_automated"), count("error", False).alias("rejected_human"))


@query("""
WITH x AS (SELECT CAST(max(ts) AS DATE) AS today FROM events)
SELECT CAST(today AS VARCHAR) AS today, (SELECT count(*) FROM events WHERE CAST(ts AS DATE) = today) AS arrived, (SELECT count(DISTINCT user_id) FROM events WHERE CAST(ts AS DATE) = today) AS senders, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS open_orders, (SELECT count(*) FROM labels WHERE quality = 0) AS needs_review FROM x""")
def today_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of headline figures, each from its own aggregate."""
    events = table(spark, sf_dir, "events").select(F.to_date("ts").cast("string").alias("today"), "user_id")
    last = events.groupBy("today").agg(F.count("*").alias("arrived"), F.countDistinct("user_id").alias("senders")).orderBy(F.desc("today")).limit(1)
    single = [table(spark, sf_dir, "orders").agg(F.count_if(F.col("o_orderstatus") == "O").alias("open_orders")), table(spark, sf_dir, "labels").agg(F.count_if(F.col("quality") == 0).alias("needs_review"))]
    for df in single:
        last = last.withColumn("_one", F.lit(1)).join(df.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return last


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_discount FROM lineitem WHERE l_shipdate <= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 90 DAY GROUP BY 1, 2""")
def market_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    kept = lines.where(F.col("l_shipdate") <= newest(lines, "l_shipdate") - F.make_dt_interval(F.lit(90)))
    return kept.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_discount"))


@query("""
SELECT p_brand AS title, count(*) AS lines, count(DISTINCT l_orderkey) AS orders, count(DISTINCT s_nationkey) AS nations FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE p_size >= 10 GROUP BY 1 ORDER BY lines DESC, title LIMIT 10""")
def market_intelligence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten brands asked for most; filters come before the top rows are taken."""
    parts = table(spark, sf_dir, "part").where("p_size >= 10").select("p_partkey", F.col("p_brand").alias("title"))
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey")
    joined = lines.join(parts, F.col("p_partkey") == F.col("l_partkey")).join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("s_suppkey") == F.col("l_suppkey"))
    return joined.groupBy("title").agg(F.count("*").alias("lines"), F.countDistinct("l_orderkey").alias("orders"), F.countDistinct("s_nationkey").alias("nations")).orderBy(F.desc("lines"), "title").limit(10)
