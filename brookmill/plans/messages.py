"""Messages made of the driver's rows, and read again.

Each query writes rows of a table as messages (payloads, lists, tables, signatures, resumes) and
parses them. The SQL states what the rows hold, so it knows nothing of the parsers' patterns.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brookmill.functions import text as X
from brookmill.operators import extract, parsers, relational, taxonomy
from brookmill.sources import messages as M
from brookmill.sources.tables import spread, table
from brookmill.streaming import intake

from .registry import query

#: A time for each key, as seconds since 1970.
BEGAN = 1_700_000_000


def _lines(*parts: Column) -> Column:
    return F.concat_ws("\n", *parts)


def _said(text: str) -> Column:
    return F.lit(text)


def _payload(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def _base64url(x: Column) -> Column:
    return F.translate(F.base64(F.encode(x, "UTF-8")), "+/", "-_")


_NAMED = "'user' || c_custkey || '@example.com' AS sender_email, c_name AS sender_name"


@query(f"""
WITH c AS (SELECT c_custkey, {_NAMED}, c_mktsegment || ' needs ' || c_custkey || '?' AS said, strftime(make_timestamp((c_custkey + {BEGAN}) * 1000000), '%Y-%m-%d %H:%M:%S') AS received_at FROM customer)
SELECT k.channel, 'm' || c_custkey AS source_message_id, sender_email, sender_name, CASE WHEN k.channel IN ('email', 'outlook') THEN 'Subject: ' || c_custkey || chr(10) || said ELSE said END AS text, received_at
FROM c, (VALUES ('email'), ('gmail'), ('outlook'), ('slack'), ('teams'), ('google_chat'), ('whatsapp'), ('telegram')) k(channel)""")
def provider_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of eight providers, read into one schema."""
    c = table(spark, sf_dir, "customer").withColumns({"mail": F.concat(F.lit("User"), "c_custkey", F.lit("@Example.com")), "id": F.concat(F.lit("m"), "c_custkey"), "said": F.concat("c_mktsegment", F.lit(" needs "), "c_custkey", F.lit("?")), "s": F.col("c_custkey") + BEGAN, "subject": F.col("c_custkey").cast("string")})
    at = F.date_format(F.timestamp_seconds("s"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    full = F.concat("c_name", F.lit(" <"), "mail", F.lit(">"))
    header = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    plain = F.struct(F.lit("text/plain").alias("mimeType"), F.struct(_base64url(F.col("said")).alias("data")).alias("body"))
    html = F.struct(F.lit("text/html").alias("mimeType"), F.struct(_base64url(F.lit("<p>no</p>")).alias("data")).alias("body"))
    made = {
        "email": _payload(**{"from": full, "subject": F.col("subject"), "text": F.col("said"), "message_id": F.col("id"), "date": at}),
        "gmail": _payload(id=F.col("id"), internalDate=(F.col("s") * 1000).cast("string"), payload=F.struct(F.array(header("From", full), header("To", F.lit("a@b.c"))).alias("headers"), F.array(html, plain).alias("parts"))),
        "graph": _payload(**{"id": F.col("id"), "subject": F.col("subject"), "from": F.struct(F.struct(F.col("mail").alias("address"), F.col("c_name").alias("name")).alias("emailAddress")), "body": F.struct(F.lit("html").alias("contentType"), F.concat(F.lit("<div>"), F.col("said"), F.lit("</div>")).alias("content")), "receivedDateTime": at}),
        "slack": _payload(event=F.struct(F.col("id").alias("client_msg_id"), F.col("mail").alias("user_email"), F.col("c_name").alias("user"), F.col("said").alias("text"), F.col("s").cast("string").alias("ts"))),
        "teams": _payload(**{"id": F.col("id"), "from": F.struct(F.struct(F.col("mail").alias("email"), F.col("c_name").alias("displayName")).alias("user")), "body": F.struct(F.col("said").alias("content")), "createdDateTime": at}),
        "google_chat": _payload(message=F.struct(F.col("id").alias("name"), F.struct(F.col("mail").alias("email"), F.col("c_name").alias("displayName")).alias("sender"), F.col("said").alias("text"), at.alias("createTime"))),
        "whatsapp": _payload(messages=F.array(F.struct(F.col("id"), F.struct(F.col("said").alias("body")).alias("text"), F.col("s").cast("string").alias("timestamp"))), contacts=F.array(F.struct(F.col("mail").alias("email"), F.struct(F.col("c_name").alias("name")).alias("profile")))),
        "telegram": _payload(message=F.struct(F.col("id").alias("message_id"), F.struct(F.col("mail").alias("email"), F.col("c_name").alias("username")).alias("from"), F.col("said").alias("text"), F.col("s").alias("date"))),
    }
    readers = {"email": M.email_webhook, "gmail": M.gmail, "graph": M.graph, "slack": M.slack, "teams": M.teams, "google_chat": M.google_chat, "whatsapp": M.whatsapp, "telegram": M.telegram}
    read = M.together(*[readers[k](c.select(v.alias("payload"))) for k, v in made.items()])
    return read.withColumn("received_at", F.date_format("received_at", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT 'user' || c_custkey || '@example.com' AS email, c_custkey * 7 AS history_id FROM customer")
def push_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _payload(emailAddress=F.concat(F.lit("user"), "c_custkey", F.lit("@example.com")), historyId=F.col("c_custkey") * 7)
    return M.push_envelope(table(spark, sf_dir, "customer").select(_payload(message=F.struct(_base64url(data).alias("data"))).alias("payload")))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'hotlist' WHEN 1 THEN 'job_description' END AS kind, 'email:m' || c_custkey AS duplicate_key FROM customer")
def mailbox_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipients of one kind of mailbox, of both, or of none."""
    boxes = {"bench@example.com": "hotlist", "jobs@example.com": "job_description"}
    to = F.get(F.array(F.lit("Bench Desk <Bench@example.com>; x@y.z"), F.lit("JOBS@example.com,jobs@example.com"), F.lit("bench@example.com, Jobs <jobs@example.com>"), F.lit("other@example.com")), (F.col("c_custkey") % 4).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", M.mailbox_kind(to, boxes).alias("kind"), M.duplicate_key(F.lit("email"), F.concat(F.lit("m"), "c_custkey")).alias("duplicate_key"))


@query("""
SELECT c_custkey, CASE c_custkey % 4 WHEN 3 THEN NULL WHEN 0 THEN 'fwd' || c_custkey || '@example.com' WHEN 1 THEN 'reply' || c_custkey || '@example.com' ELSE 'body' || c_custkey || '@example.com' END AS address,
CASE c_custkey % 4 WHEN 0 THEN 'forwarded_header' WHEN 1 THEN 'reply_to' WHEN 2 THEN 'body' END AS method, CASE c_custkey % 4 WHEN 0 THEN 0.95 WHEN 1 THEN 0.85 WHEN 2 THEN 0.6 END::DOUBLE AS confidence,
CASE WHEN c_custkey % 4 != 3 THEN 'example.com' END AS domain FROM customer""")
def original_senders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who wrote a message: by a forwarded header, the reply-to address, or the body."""
    k, kind = F.col("c_custkey"), F.col("c_custkey") % 4
    body = F.concat(F.lit("write to Body"), k, F.lit("@Example.com please"))
    forwarded = _lines(_said("see below"), _said("---------- Forwarded message ---------"), F.concat(F.lit("From: Ann <Fwd"), k, F.lit("@Example.com>")), body)
    text = F.when(kind == 0, forwarded).when(kind == 3, "nobody").otherwise(body)
    found = table(spark, sf_dir, "customer").select("c_custkey", extract.sender(text, F.when(kind == 1, F.concat(F.lit("Reply"), k, F.lit("@Example.com")))).alias("s"))
    return found.select("c_custkey", "s.address", "s.method", F.col("s.confidence").cast("double").alias("confidence"), X.email_domain(F.col("s.address")).alias("domain"))


@query("""
SELECT s_suppkey, CASE WHEN s_suppkey % 3 < 2 THEN 'Ann Bee' END AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'Lead Recruiter' END AS title, CASE WHEN s_suppkey % 3 = 0 THEN 'Acme Group Inc' END AS company, CASE WHEN s_suppkey % 3 < 2 THEN '512-555-' || lpad(CAST(s_suppkey % 10000 AS VARCHAR), 4, '0') END AS phone,
CASE WHEN s_suppkey % 3 = 0 THEN 's' || s_suppkey || '@acme.io' END AS email, CASE s_suppkey % 3 WHEN 0 THEN 0.92 WHEN 1 THEN 0.7 ELSE 0 END::DOUBLE AS confidence, CASE WHEN s_suppkey % 3 < 2 THEN 'Bee' END AS last_name, CASE WHEN s_suppkey % 3 < 2 THEN '+1512555' || lpad(CAST(s_suppkey % 10000 AS VARCHAR), 4, '0') END AS e164 FROM supplier""")
def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contact details below a sign-off, not those of the quoted message."""
    k, kind = F.col("s_suppkey"), F.col("s_suppkey") % 3
    phone = F.concat(F.lit("512-555-"), F.lpad((k % 10000).cast("string"), 4, "0"))
    whole = _lines(_said("We need a developer."), _said("Thanks,"), _said("Ann Bee"), _said("Lead Recruiter"), _said("Acme Group Inc"), phone, F.concat(F.lit("s"), k, F.lit("@acme.io")), _said(""), _said("From: old"), _said("Regards,"), _said("Old Name"))
    part = _lines(_said("Hello"), _said("Best regards"), _said("Ann Bee"), phone)
    text = F.when(kind == 0, whole).when(kind == 1, part).otherwise("no sign off here")
    found = parsers.signature(table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("text")), "s_suppkey", "text")
    return found.select("s_suppkey", "name", "title", "company", "phone", "email", F.col("confidence").cast("double").alias("confidence"), F.col("parts.last").alias("last_name"), extract.e164(F.col("phone")).alias("e164"))


@query("""
SELECT o_custkey, o_orderpriority AS name, CASE WHEN o_orderstatus != 'F' THEN o_orderstatus END AS title, CAST(o_orderkey AS VARCHAR) AS rate, CASE WHEN o_orderstatus != 'F' THEN 0.92 ELSE 0.62 END::DOUBLE AS confidence, CASE WHEN o_orderstatus = 'F' THEN 'title_missing' ELSE '' END AS warnings FROM orders""")
def hotlist_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as a table in a message, and its records read from there."""
    line = F.concat(F.lit("| "), "o_orderpriority", F.lit(" | "), F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).otherwise(" "), F.lit(" | "), "o_orderkey", F.lit(" |"))
    mail = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(line)).alias("rows"))
    text = F.concat(F.lit("Hello\nmy list | of today\nConsultant Name | Technology | Rate\n"), F.array_join("rows", "\n"), F.lit("\nBye | now"))
    found = parsers.hotlist_table(mail.select("o_custkey", text.alias("text")), "o_custkey", "text")
    return found.select("o_custkey", "name", "title", "rate", F.col("parse_confidence").cast("double").alias("confidence"), F.array_join("warnings", ",").alias("warnings"))


@query("""
WITH p AS (SELECT p_partkey, unnest([1, 2])::INT AS position, p_name, p_type, p_size FROM part)
SELECT p_partkey, position, CASE position WHEN 1 THEN p_name ELSE p_type END AS title, CASE position WHEN 1 THEN 'Austin, TX' ELSE 'Remote' END AS location, CASE position WHEN 1 THEN 'W2' END AS employment_type, CASE position WHEN 1 THEN 'H1B' END AS work_authorization, CASE position WHEN 1 THEN CAST(p_size AS VARCHAR) END AS years, CASE position WHEN 1 THEN 'java,sql' ELSE '' END AS skills, CASE position WHEN 1 THEN 0.92 ELSE 0.62 END::DOUBLE AS confidence FROM p""")
def requirement_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two positions in one requirement."""
    text = _lines(_said("Hello all"), F.concat(F.lit("Job Title: "), "p_name"), _said("Location: Austin, TX"), _said("Required Skills: java, sql"), F.concat("p_size", F.lit("+ years, W2, H-1B only")), _said(""), F.concat(F.lit("Job Title - "), "p_type"), _said("this one is remote"))
    found = parsers.positions(spread(table(spark, sf_dir, "part")).select("p_partkey", text.alias("text")), "p_partkey", "text")
    return found.select("p_partkey", "position", "title", "location", "employment_type", "work_authorization", F.col("years").cast("string").alias("years"), F.array_join("skills", ",").alias("skills"), F.col("confidence").cast("double").alias("confidence"))


@query("SELECT p_partkey, section, lines FROM (SELECT p_partkey, unnest(['header', 'experience', 'education']) AS section, unnest([p_name, p_brand || '/' || p_type, p_name]) AS lines FROM part)")
def resume_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _lines(F.col("p_name"), _said("WORK EXPERIENCE:"), F.col("p_brand"), _said(""), F.col("p_type"), _said("Education"), F.col("p_name"))
    found = parsers.sections(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")), "p_partkey", "text")
    return found.select("p_partkey", "section", F.array_join("lines", "/").alias("lines"))


@query("SELECT o_orderkey, o_orderpriority AS role, CAST(o_custkey AS VARCHAR) AS pay_rate, 2 AS fields FROM orders")
def broadcast_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key and value lines; the last of equal keys stays."""
    text = _lines(_said("Role: first"), F.concat(F.lit("Pay-Rate:  "), "o_custkey"), _said("no value here"), F.concat(F.lit("ROLE: "), "o_orderpriority"))
    pairs = table(spark, sf_dir, "orders").select("o_orderkey", parsers.key_values(text).alias("m"))
    return pairs.select("o_orderkey", F.col("m")["role"].alias("role"), F.col("m")["pay rate"].alias("pay_rate"), F.size("m").alias("fields"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name || chr(10) || 'keep' ELSE 'Sent from  my phone' END AS text FROM supplier")
def cleaned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without approved lines; a text of nothing else stays."""
    approved = spark.createDataFrame([("sent from my phone",), ("no longer sent",)], "line string")
    text = F.when(F.col("s_suppkey") % 2 == 0, _lines(F.col("s_name"), _said("SENT from my   phone"), _said("keep"))).otherwise("Sent from  my phone")
    return parsers.without_boilerplate(table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("text")), "s_suppkey", "text", approved)


@query("""
SELECT event_id, CASE WHEN event_type = 'view' THEN 'done' WHEN event_type = 'error' THEN 'dead_letter' WHEN event_id % 7 >= 5 THEN 'dead_letter' ELSE 'retry' END AS route,
CASE WHEN event_type NOT IN ('view', 'error') AND event_id % 7 < 5 THEN CAST(CASE WHEN event_type = 'click' THEN 42 ELSE [5, 15, 60, 300, 900][event_id % 7 + 1] END AS VARCHAR) END AS wait FROM events""")
def retry_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each attempt goes next: done, a later attempt, or the dead letters."""
    kind = F.col("event_type")
    status = F.when(kind == "view", 204).when(kind == "error", 410).when(kind == "click", 429).otherwise(500)
    plan = intake.retry_plan((F.col("event_id") % 7).cast("int"), status, F.when(kind == "click", 42))
    return table(spark, sf_dir, "events").select("event_id", plan.alias("p")).select("event_id", "p.route", F.col("p.wait").cast("string").alias("wait"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'bad_json' WHEN 1 THEN 'wrong_root' WHEN 2 THEN 'missing_user' END AS poison, CASE WHEN event_id % 5 > 2 THEN CAST(user_id AS VARCHAR) END AS user FROM events")
def poison_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 5
    good = _payload(user=F.col("user_id").cast("string"), retry_count=F.lit(0))
    body = F.when(k == 0, '{"user": ').when(k == 1, "[1, 2]").when(k == 2, '{"retry_count": 1}').otherwise(good)
    routed = intake.routed(table(spark, sf_dir, "events").select("event_id", body.alias("body")), "user string, retry_count int", ("user",))
    return routed.select("event_id", "poison", F.when(F.col("poison").isNull(), F.col("message.user")).alias("user"))


@query("""
SELECT c_custkey, CASE WHEN c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) THEN 'domain' WHEN c_custkey IN (SELECT s_suppkey FROM supplier) THEN 'email' END AS blocked_by FROM customer""")
def blocked_senders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers blocked by nation (as domain) or by their own key (as address); a domain wins."""
    domains = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.lit("domain").alias("match_type"), F.concat(F.lit("n"), "n_nationkey", F.lit(".com")).alias("value"))
    emails = table(spark, sf_dir, "supplier").select(F.lit("email").alias("match_type"), F.concat(F.lit("c"), "s_suppkey").alias("value"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("c"), "c_custkey").alias("email"), F.concat(F.lit("n"), "c_nationkey", F.lit(".com")).alias("domain"))
    return relational.blocked(rows, domains.union(emails), "email", "domain").select("c_custkey", "blocked_by")


@query("""
WITH l AS (SELECT s_nationkey, min(s_name) AS company FROM supplier WHERE s_nationkey % 5 != 0 GROUP BY 1)
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE company END AS company FROM customer LEFT JOIN l ON s_nationkey = c_nationkey""")
def filled_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty companies filled with what was learned of the sender's domain, shared providers aside."""
    domain = lambda k: F.when(F.col(k) % 5 == 0, "gmail.com").otherwise(F.concat(F.lit("n"), k, F.lit(".com"))).alias("domain")
    learned = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.min("s_name").alias("company")).select(domain("s_nationkey"), "company")
    learned = learned.where(X.corporate_domain(F.col("domain")).isNotNull())
    rows = table(spark, sf_dir, "customer").select("c_custkey", domain("c_nationkey"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).when(F.col("c_custkey") % 3 == 1, "").alias("company"))
    return relational.fill_gaps(rows, learned, ["domain"], ["company"]).select("c_custkey", "company")


@query("""
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN p_type ELSE 'no ' || p_type END AS normalized, CASE p_partkey % 3 WHEN 0 THEN 'canonical' WHEN 1 THEN 'alias' ELSE 'unknown' END AS match_type, CASE p_partkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence FROM part""")
def resolved_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types as terms: by their own name, by an alias, or unknown."""
    parts = table(spark, sf_dir, "part")
    names = parts.select(F.col("p_type").alias("canonical")).distinct()
    dictionary = taxonomy.alias_index(names.select("canonical", F.array(F.concat(F.lit("the "), "canonical")).alias("aliases")))
    term = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_type")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("The-"), "p_type")).otherwise(F.concat(F.lit("no "), "p_type"))
    return taxonomy.normalized(parts.select("p_partkey", term.alias("term")), dictionary, "term").select("p_partkey", "normalized", "match_type", "confidence")


@query("""
WITH n AS (SELECT DISTINCT p_type || ' component part' AS name FROM part)
SELECT left(name, 3) || 'x' || substr(name, 4) AS term, name AS canonical FROM n UNION ALL SELECT left(name, length(name) - 5), NULL FROM n""")
def fuzzy_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with one more letter find their entry; those with the last word cut off find none."""
    names = table(spark, sf_dir, "part").select(F.concat("p_type", F.lit(" component part")).alias("canonical")).distinct()
    dictionary = names.select("canonical", F.col("canonical").alias("alias"))
    longer = F.concat(F.substring("canonical", 1, 3), F.lit("x"), F.expr("substr(canonical, 4)"))
    terms = names.select(F.explode(F.array(longer, F.expr("left(canonical, length(canonical) - 5)"))).alias("term"))
    return taxonomy.resolve_fuzzy(terms, dictionary, "term").select("term", "canonical")


@query("""
SELECT p_partkey, CASE WHEN p_size > 25 THEN 'data' WHEN p_size > 10 THEN 'cloud' END AS category FROM part""")
def first_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule with a word of the name decides."""
    rules = spark.createDataFrame([(1, "spark", "data"), (2, "aws", "cloud"), (3, "sql", "data")], "rank int, word string, category string")
    name = F.when(F.col("p_size") > 25, "AWS and Spark").when(F.col("p_size") > 10, "aws, SQL").otherwise("none of these")
    found = taxonomy.first_rule_wins(table(spark, sf_dir, "part").select("p_partkey", name.alias("name")), rules, "name", "p_partkey")
    return found.select("p_partkey", "category")


@query("""
SELECT p_partkey, 'Austin' AS city_of, CASE WHEN p_size % 2 = 0 THEN p_size * 1000 ELSE p_size END::DOUBLE AS amount, CASE WHEN p_size % 2 = 0 THEN 'year' ELSE 'hour' END AS unit, 'https://linkedin.com/in/p' || p_partkey AS linkedin, true AS public, p_name AS subject, CASE WHEN p_size > 25 THEN 'Green Card' ELSE 'OPT' END AS work_authorization FROM part""")
def posting_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates, profiles, subjects and authorisations of postings."""
    rate = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("$"), "p_size", F.lit("k per year"))).otherwise(F.concat(F.lit("$ "), "p_size", F.lit(".00/hr")))
    text = _lines(F.concat(F.lit("Subject: RE: Fwd: "), "p_name"), F.concat(F.lit("see linkedin.com/in/p"), "p_partkey", F.lit("/")), _said("Location: Austin"), F.when(F.col("p_size") > 25, "GC or better").otherwise("OPT or CPT"))
    rows = table(spark, sf_dir, "part").select("p_partkey", text.alias("text"), extract.rate(rate).alias("rate"))
    link = extract.linkedin(F.col("text"))
    return rows.select("p_partkey", extract.location(F.col("text")).alias("city_of"), "rate.amount", "rate.unit", link.alias("linkedin"), extract.is_public_profile(link).alias("public"), extract.subject(F.col("text")).alias("subject"), extract.work_authorization(F.col("text")).alias("work_authorization"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Order ' || o_orderkey WHEN o_orderstatus = 'P' THEN o_orderpriority ELSE 'Draft Hotlist' END AS title, CASE WHEN o_totalprice > 200000 THEN 'job_description' WHEN o_totalprice > 100000 THEN 'unknown' ELSE 'hotlist' END AS kind FROM orders""")
def display_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles with fallbacks, and the kind by two parsers' confidence."""
    title = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit(" Order "), "o_orderkey")).when(F.col("o_orderstatus") == "P", " ")
    job = F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority"))
    high, low = F.col("o_totalprice") > 200000, F.col("o_totalprice") <= 100000
    kind = extract.document_kind(F.when(high, 0.92).when(low, 0.3).otherwise(0.8), F.when(high, 0.62).when(low, 0.92).otherwise(0.75))
    return table(spark, sf_dir, "orders").select("o_orderkey", extract.display_title(title, job, F.lit("draft_hotlist")).alias("title"), kind.alias("kind"))
