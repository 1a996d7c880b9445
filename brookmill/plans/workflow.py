"""Submissions, drafts, reviews, resumes and readings over the driver's tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookmill.operators import extract, listing, relational, resumes, understanding, workflow
from brookmill.operators.matching import TRANSITIONS
from brookmill.sources.tables import table

from .registry import query

#: Stages by the remainder of an order's key.
STAGES = tuple(TRANSITIONS)
_STAGE = "[" + ", ".join(f"'{s}'" for s in STAGES) + "]"
_ALLOWED = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, after in TRANSITIONS.items() for b in (a, *after)) + ") t(f, g)"


@query(f"""
WITH o AS (SELECT o_orderkey, o_custkey, {_STAGE}[o_orderkey % 14 + 1] AS current_stage, o_orderkey % 6 AS e, o_custkey % 10 = 0 AND o_orderkey % 2 = 0 AS dup FROM orders),
w AS (SELECT *, CASE WHEN current_stage IN ('placed', 'rejected', 'withdrawn', 'closed_lost') THEN current_stage WHEN dup THEN 'duplicate_risk' WHEN e = 0 THEN 'interview' WHEN e = 1 THEN 'rejected' WHEN e = 2 THEN 'submitted' WHEN e = 3 THEN 'matched' WHEN e = 4 THEN 'matched' ELSE current_stage END AS wanted FROM o),
r AS (SELECT w.*, f IS NOT NULL AS ok, CASE WHEN f IS NOT NULL THEN wanted ELSE current_stage END AS recommended_stage FROM w LEFT JOIN {_ALLOWED} ON f = current_stage AND g = wanted),
c AS (SELECT *, CASE WHEN dup THEN 'possible_duplicate_submission' WHEN NOT ok THEN 'invalid_stage_transition' END AS conflict FROM r)
SELECT o_orderkey, current_stage, recommended_stage, recommended_stage != current_stage AS stage_changed, conflict,
CASE WHEN recommended_stage IN ('placed', 'rejected', 'withdrawn', 'closed_lost', 'submitted', 'screening', 'client_submitted', 'interview', 'offer') THEN recommended_stage ELSE 'none' END AS outcome,
CASE WHEN conflict IS NOT NULL OR recommended_stage IN ('intro_accepted', 'interview', 'offer') THEN 'high' WHEN recommended_stage IN ('matched', 'intro_requested', 'submitted', 'screening', 'client_submitted') THEN 'medium' END AS follow_up FROM c""")
def submission_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stage recommended for each order as a submission, its conflicts and what follows."""
    k, e = F.col("o_orderkey"), F.col("o_orderkey") % 6
    orders = table(spark, sf_dir, "orders")
    rows = orders.select(
        "o_orderkey",
        F.col("o_custkey").alias("consultant_id"),
        (k % 2).alias("job_id"),
        F.get(F.array(*[F.lit(s) for s in STAGES]), (k % 14).cast("int")).alias("current_stage"),
        F.when(e == 1, "outcome_recorded").when(e == 2, "submitted").alias("event_type"),
        F.when(e == 0, "interview").alias("to_stage"),
        F.when(e == 1, " Rejected").alias("outcome_type"),
        F.when(e == 3, "Manual_Review").when(e == 5, "reject").alias("decision"),
        F.when(e == 4, 75.0).when(e == 5, 74.9).alias("match_score"),
    )
    existing = table(spark, sf_dir, "customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("consultant_id"), F.lit(0).cast("long").alias("job_id"))
    found = workflow.recommended(rows, existing)
    return found.select("o_orderkey", "current_stage", "recommended_stage", "stage_changed", "conflict", "outcome", "follow_up")


_RECORDS = "SELECT l_orderkey, list(l_returnflag ORDER BY l_linenumber, l_partkey) AS flags, bool_and(l_returnflag != 'R') AS clean, min(l_discount) AS least FROM lineitem GROUP BY 1"


@query(f"""
WITH l AS ({_RECORDS})
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL WHEN l_orderkey IS NULL THEN 'job_requirement_missing_records' WHEN flags[1] = 'R' THEN 'job_requirement_missing_job_title' END AS block,
coalesce(clean AND o_orderstatus = 'O' AND least >= 0.02, false) AS ready, NOT coalesce(clean, true) AS any_returned, coalesce(least, 0)::DOUBLE AS least_confidence FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""")
def draft_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as drafts and their lines as records: what stops their publication, and whether they need no review."""
    warning = F.when(F.col("l_returnflag") == "R", F.array(F.lit("returned"))).otherwise(F.array().cast("array<string>"))
    record = F.struct("l_linenumber", "l_partkey", F.when(F.col("l_returnflag") != "R", "title").alias("job_title"), (F.col("l_returnflag") == "R").alias("requires_review"), warning.alias("warnings"), F.col("l_discount").alias("parse_confidence"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(record)).alias("records"))
    drafts = table(spark, sf_dir, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    parsing = F.struct(F.lit("hotlist").alias("document_kind"), F.lit(0.9).alias("confidence"), F.lit(False).alias("requires_review"), F.array().cast("array<string>").alias("warnings"), "records")
    drafts = drafts.withColumn("parsing", parsing)
    ready = extract.parser_ready(F.when(F.col("o_orderstatus") == "O", "hotlist").otherwise("job_description"), F.lit(0.9), F.array(), least=0.02)
    return drafts.select(
        "o_orderkey",
        workflow.publish_block(F.lit("draft_job_requirement"), F.col("o_orderstatus") != "P", F.col("records")).alias("block"),
        ready.alias("ready"),
        listing.holds_any(F.col("records"), "warnings", "returned").alias("any_returned"),
        listing.least_confidence(F.col("records")).alias("least_confidence"),
    )


@query("""
WITH d AS (SELECT l_orderkey AS o_orderkey, arg_max(l_linenumber % 4, l_linenumber * 1000000000::BIGINT + l_partkey) AS act, max(l_linenumber) AS line FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN act = 0 AND o_totalprice <= 150000 THEN 'published' WHEN act = 1 THEN 'rejected' ELSE o_orderstatus END AS status, CASE WHEN act = 2 THEN 'note' || line ELSE o_orderpriority END AS draft_type, CASE WHEN act = 0 AND o_totalprice > 150000 THEN 'too_dear' END AS error, CASE WHEN act = 1 THEN 'note' || line END AS rejection_reason
FROM orders LEFT JOIN d USING (o_orderkey) WHERE act IS DISTINCT FROM 3""")
def draft_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as drafts after the actions that their lines stand for: publish, reject, reclassify, delete."""
    names = F.array(*[F.lit(a) for a in ("publish", "reject", "reclassify", "delete")])
    actions = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("draft_id"), F.get(names, F.col("l_linenumber") % 4).alias("action"), (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey")).alias("at"), F.concat(F.lit("note"), "l_linenumber").alias("note"))
    drafts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("draft_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("draft_type"), F.when(F.col("o_totalprice") > 150000, "too_dear").alias("block"))
    return workflow.decided(drafts, actions).withColumnRenamed("draft_id", "o_orderkey")


@query("""
WITH d AS (SELECT o_custkey AS c_custkey, arg_min(CASE WHEN o_totalprice > 150000 THEN 'approved' ELSE 'rejected' END, o_orderkey) AS decision, arg_min(o_orderpriority, o_orderkey) AS reviewer FROM orders GROUP BY 1)
SELECT c_custkey, CASE WHEN c_acctbal > 0 AND decision IS NOT NULL THEN decision WHEN c_acctbal > 0 THEN 'pending' ELSE 'approved' END AS status, CASE WHEN c_acctbal > 0 THEN reviewer END AS reviewed_by FROM customer LEFT JOIN d USING (c_custkey)""")
def review_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as candidates: pending ones take their first decision, others are final."""
    candidates = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") > 0, "pending").otherwise("approved").alias("status"))
    decisions = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.when(F.col("o_totalprice") > 150000, "approved").otherwise("rejected").alias("decision"), F.col("o_orderpriority").alias("reviewer"), F.col("o_orderkey").alias("at"))
    return workflow.reviewed(candidates, decisions).select(F.col("id").alias("c_custkey"), "status", "reviewed_by")


@query("""
SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 1000 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') ORDER BY o_orderdate, o_orderkey LIMIT 100""")
def reconciled_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred oldest drafts in review that are ready and uncorrected; the batch is the feature."""
    drafts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("draft_id"), F.when(F.col("o_orderstatus") == "O", "needs_review").alias("status"), F.col("o_orderdate").alias("created_at"), "o_totalprice")
    corrected = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("draft_id"))
    return workflow.reconciled(drafts, F.col("o_totalprice") >= 1000, corrected, 100).select(F.col("draft_id").alias("o_orderkey"))


@query("SELECT e.event_id, e.event_type AS predicted, b.corrected FROM events e JOIN (SELECT user_id, max(event_type) AS corrected FROM events GROUP BY 1) b USING (user_id) WHERE e.event_type != b.corrected")
def feedback_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions that differ from what they were corrected to."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("predicted"))
    corrected = events.groupBy("user_id").agg(F.max("predicted").alias("corrected"))
    return workflow.feedback(events.join(corrected, "user_id"), "predicted", "corrected").select("event_id", "predicted", "corrected")


@query("""
WITH i AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS place FROM customer)
SELECT CAST(place // 50 AS BIGINT) AS batch, CASE WHEN s_suppkey IS NULL THEN 'missing' WHEN s_suppkey % 4 = 0 THEN 'changed' WHEN s_suppkey % 4 = 1 THEN 'same' ELSE 'updated' END AS outcome, count(*) AS n FROM i LEFT JOIN supplier ON s_suppkey = c_custkey GROUP BY 1, 2""")
def backfill_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes by batch of a frozen list of drafts (the keys are dense, so they number the list)."""
    items = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("draft_id"), F.col("c_custkey").alias("place"), F.lit(1).alias("version"))
    k = F.col("s_suppkey") % 4
    drafts = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("draft_id"), F.when(k == 0, 2).otherwise(1).alias("version"), F.col("s_name").alias("old_value"), F.when(k == 1, F.col("s_name")).alias("new_value"))
    return relational.counters(workflow.backfilled(items, drafts, 50), ["batch", "outcome"])


@query("""
SELECT event_id, CASE WHEN event_id % 5 >= 3 OR event_type = 'error' OR event_type = 'view' THEN 'do_not_retry' WHEN event_type IN ('click', 'purchase') THEN 'retry' ELSE 'needs_review' END AS decision, CASE WHEN event_id % 5 < 3 AND event_type IN ('click', 'purchase') THEN CAST(30 * (event_id % 5 + 1) AS VARCHAR) END AS wait FROM events""")
def retry_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "error", 404).when(kind == "click", 503)
    error = F.when(kind == "view", "duplicate").when(kind == "purchase", "timeout").when(kind == "signup", "odd")
    found = table(spark, sf_dir, "events").select("event_id", workflow.retry_decision((F.col("event_id") % 5), F.lit(3), status, error).alias("d"))
    return found.select("event_id", "d.decision", F.col("d.wait").cast("string").alias("wait"))


@query("""
SELECT conv_id, turn, role, CASE WHEN turn % 3 = 0 THEN 'follow_up' WHEN turn % 3 = 1 THEN 'placed' END AS label, CASE WHEN turn % 3 < 2 THEN 0.85 ELSE 0.2 END::DOUBLE AS confidence, CASE WHEN turn % 3 = 0 THEN 'matched_phrase:any update' WHEN turn % 3 = 1 THEN 'matched_phrase:joined' ELSE 'message_too_short' END AS reason FROM conversations""")
def phrase_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a message asks for, by the first label with a phrase in it."""
    phrases = {"follow_up": ("circling back", "any update"), "placed": ("joined",)}
    said = F.when(F.col("turn") % 3 == 0, "Joined? ANY UPDATE on this").when(F.col("turn") % 3 == 1, "the candidate Joined today").otherwise(" thanks ")
    found = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", workflow.first_phrase(said, phrases).alias("p"))
    return found.select("conv_id", "turn", "role", "p.label", F.col("p.confidence").cast("double").alias("confidence"), "p.reason")


@query("""
WITH t AS (SELECT o_custkey, list(o_orderpriority ORDER BY o_orderpriority)[1:3] AS topics FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders) GROUP BY 1)
SELECT o_custkey, count(*) AS interaction_count, arg_max(CAST(o_orderkey AS VARCHAR), strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || lpad(CAST(o_orderkey AS VARCHAR), 12, '0')) AS last_interaction_summary, array_to_string(any_value(topics), ',') AS shared_context FROM orders JOIN t USING (o_custkey) GROUP BY 1""")
def relationship_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card for each customer: orders, the last one, and three priorities at most (the bound is the feature)."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("at"), F.col("o_orderkey").cast("string").alias("summary"), "o_orderpriority")
    cards = workflow.relationship_cards(orders, "o_custkey", "at", "summary", "o_orderpriority", 3)
    return cards.withColumn("shared_context", F.array_join("shared_context", ","))


@query("""
WITH q AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 50.0 ELSE 100.0 END AS completeness, CASE WHEN p_size % 2 = 0 THEN 50.0 ELSE 100.0 END AS content, CASE WHEN p_size > 25 THEN 100.0 ELSE 50.0 END AS provenance FROM part WHERE p_size % 5 != 0)
SELECT p_partkey, completeness::DOUBLE AS completeness, content::DOUBLE AS content, provenance::DOUBLE AS provenance, round(completeness * 0.45 + content * 0.30 + provenance * 0.25, 6)::DOUBLE AS quality, CASE WHEN completeness < 100 THEN 'skills' ELSE '' END AS missing, CASE WHEN completeness + content + provenance = 300 THEN 'completed' ELSE 'needs_review' END AS decision FROM q
UNION ALL SELECT p_partkey, 0, 100, 100, 55, 'experience,skills', 'blocked' FROM part WHERE p_size % 5 = 0""")
def resume_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as resumes of two sections, some of another kind, empty, or unproven; some without any."""
    n = F.col("p_size")
    section = lambda kind, content, verified: F.struct(kind.alias("kind"), content.alias("content"), verified.alias("verified"))
    two = F.array(section(F.lit("experience"), F.lit("built it"), F.lit(True)), section(F.when(n % 3 == 0, "other").otherwise("skills"), F.when(n % 2 == 0, " ").otherwise("sql"), n > 25))
    required = F.array(F.lit("experience"), F.lit("skills"))
    rows = table(spark, sf_dir, "part").select("p_partkey", resumes.quality(F.when(n % 5 != 0, two), required).alias("q"))
    return rows.select("p_partkey", "q.completeness", "q.content", "q.provenance", F.round("q.quality", 6).alias("quality"), F.array_join(F.array_sort("q.missing"), ",").alias("missing"), "q.decision")


@query("""
SELECT p_partkey, 'unquantified_impact' AS category, 'medium' AS severity, 'led the whole team of ' || p_name AS current FROM part WHERE p_size % 2 = 0 AND length(p_name) >= 3
UNION ALL SELECT p_partkey, 'weak_language', 'low', 'worked on' FROM part WHERE p_size % 3 != 0""")
def resume_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bullets without figures, and weak openings."""
    bullet = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" - led the whole team of "), "p_name")).otherwise(F.concat(F.lit("* cut the cost of all parts by "), "p_size"))
    kind = F.when(F.col("p_size") % 3 == 0, "skills").otherwise("summary")
    parts = table(spark, sf_dir, "part")
    sections = parts.select("p_partkey", F.lit("experience").alias("kind"), F.concat(bullet, F.lit("\nshort 1")).alias("content")).unionByName(parts.select("p_partkey", kind.alias("kind"), F.lit("Tasked with it; Worked On all").alias("content")))
    return resumes.feedback(sections, "p_partkey", "kind", "content")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'Data-Flow' ELSE 'Data-Flow,SQL' END AS missing FROM part")
def missing_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    required = F.array(F.lit("Node_JS"), F.lit("Data-Flow"), F.lit("SQL"), F.lit("SQL"))
    held = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("node js"), F.lit("sql"))).otherwise(F.array(F.lit("Node-js")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(resumes.missing_keywords(required, held), ",").alias("missing"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'hotlist' WHEN 1 THEN 'job_description' WHEN 2 THEN 'resume' WHEN 3 THEN 'vendor_list' WHEN 4 THEN 'resume' WHEN 5 THEN 'plain_message' ELSE 'unknown' END AS kind,
CASE o_orderkey % 7 WHEN 0 THEN 'draft_hotlist' WHEN 1 THEN 'draft_job_requirement' WHEN 2 THEN 'draft_consultant_profile' WHEN 3 THEN 'draft_vendor_list' WHEN 4 THEN 'draft_consultant_profile' ELSE 'draft_channel_note' END AS draft_type,
CASE o_orderkey % 7 WHEN 0 THEN 'message' WHEN 1 THEN 'job_description' WHEN 2 THEN 'resume' WHEN 3 THEN 'message' WHEN 4 THEN 'resume' WHEN 5 THEN 'message' ELSE 'unknown' END AS reading_kind,
CASE o_orderkey % 7 WHEN 5 THEN 0.6 WHEN 6 THEN 0.2 ELSE 0.75 END::DOUBLE AS confidence FROM orders""")
def document_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds by the mailbox, by the surer parser, by the sender's corrections and by markers, in this order."""
    k = F.col("o_orderkey") % 7
    text = F.when(k == 3, "our prime vendor has a resume").when(k == 4, "Education and other things").when(k == 5, "hello there").when(k == 6, "  ").otherwise("hotlist")
    channel = F.when(k <= 2, "email").otherwise("slack")
    kind = understanding.kind_of(text, channel, F.when(k == 0, "hotlist").otherwise("resume"), F.when(k == 1, 0.92).otherwise(0.5), F.lit(0.6), F.when(k == 2, "resume").otherwise("hotlist"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", kind.alias("kind"))
    return rows.select("o_orderkey", "kind", understanding.draft_type(F.col("kind")).alias("draft_type"), understanding.reading_kind(F.col("kind")).alias("reading_kind"), understanding.confidence_or_usual(F.lit(None).cast("double"), F.col("kind")).cast("double").alias("confidence"))


@query("""
WITH q AS (SELECT doc_id, length(trim(text)) < 40 OR NOT regexp_matches(text, '\\p{L}') AS bad, len(list_filter(string_split_regex(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w != '')) < 5 OR length(trim(text)) < 20 AS poor FROM documents),
w AS (SELECT doc_id, bad OR poor AS weak FROM q)
SELECT doc_id, weak AS weak_resume, bad_message, CASE WHEN NOT weak THEN 'none' WHEN doc_id % 3 = 0 THEN 'local_retry' WHEN doc_id % 3 = 1 THEN 'llm_structuring_candidate' ELSE 'manual_review' END AS fallback,
CASE WHEN doc_id % 2 = 1 THEN 'structured_document_kind_mismatch' ELSE '' END AS errors, array_to_string(list_filter([CASE WHEN weak THEN 'extraction_quality_requires_fallback' END, CASE WHEN doc_id % 5 = 0 THEN 'no_skills_extracted' END, CASE WHEN doc_id % 7 != 0 THEN 'resume_contact_not_found' END], lambda x: x IS NOT NULL), ',') AS warnings
FROM (SELECT w.doc_id, weak, bad OR poor AS bad_message FROM w JOIN q USING (doc_id))""")
def validated_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well documents were read, what to try next, and what is wrong with what was read."""
    k = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select("doc_id", extract.text_quality(F.col("text")).alias("q"))
    weak = understanding.needs_fallback(F.col("q.confidence"), F.lit("resume"))
    source = F.when(k % 3 == 0, "markitdown").otherwise("plain")
    check = understanding.validation(F.lit("resume"), F.when(k % 2 == 1, "message").otherwise("resume"), weak, F.when(k % 5 != 0, F.array(F.lit("sql"))), k % 7 == 0, F.lit(True))
    rows = rows.withColumns({"weak_resume": weak, "bad_message": understanding.needs_fallback(F.col("q.confidence"), F.lit("message")), "fallback": understanding.fallback(weak, source, F.array(F.lit("text")), k % 3 == 1, model=True), "v": check})
    return rows.select("doc_id", "weak_resume", "bad_message", "fallback", F.array_join("v.errors", ",").alias("errors"), F.array_join("v.warnings", ",").alias("warnings"))


@query("""
SELECT p_partkey, round(1 - CASE WHEN p_size % 2 = 0 THEN 0.15 ELSE 0 END - CASE WHEN p_size % 3 = 0 THEN 0.25 ELSE 0 END - CASE WHEN p_size <= 10 THEN 0.35 ELSE 0 END, 6)::DOUBLE AS consultant, round(1 - CASE WHEN p_size % 3 = 0 THEN 0.2 ELSE 0 END - 0.05 - CASE WHEN p_size <= 10 THEN 0.35 ELSE 0 END, 6)::DOUBLE AS job,
array_to_string(list_filter([CASE WHEN p_size <= 10 THEN 'text_too_short' END, CASE WHEN p_size % 2 = 0 THEN 'name_not_found' END, CASE WHEN p_size % 3 = 0 THEN 'no_skills_found' END], lambda x: x IS NOT NULL), ',') AS reasons FROM part""")
def parse_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence in parsed consultants and jobs by what is missing."""
    n, no = F.col("p_size"), F.lit(False)
    text = F.when(n <= 10, " a short text ").otherwise("a text that is long enough to be judged")
    consultant = understanding.parse_confidence(text, {"name": n % 2 == 0, "title": no, "skills": n % 3 == 0, "experience": no}, understanding.CONSULTANT_PARTS)
    job = understanding.parse_confidence(text, {"title": no, "skills": n % 3 == 0, "location": no, "employment_type": F.lit(True)}, understanding.JOB_PARTS)
    rows = table(spark, sf_dir, "part").select("p_partkey", consultant.alias("c"), job.alias("j"))
    return rows.select("p_partkey", F.col("c.score").cast("double").alias("consultant"), F.col("j.score").cast("double").alias("job"), F.array_join("c.reasons", ",").alias("reasons"))
