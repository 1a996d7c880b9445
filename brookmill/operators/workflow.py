"""Submissions, drafts and review queues as state: what is recommended, what is allowed, and the next snapshot."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import relational
from .matching import TRANSITIONS

# Stages that an event asks for, outcomes, the end, and the action that follows each stage.
EVENT_STAGES = {"match_detected": "matched", "intro_requested": "intro_requested", "intro_accepted": "intro_accepted", "submitted": "submitted", "duplicate_risk_detected": "duplicate_risk"}
OUTCOMES = ("placed", "rejected", "withdrawn", "closed_lost", "offer", "interview")
TERMINAL = ("placed", "rejected", "withdrawn", "closed_lost")
MATCHED_SCORE = 75
FOLLOW_UPS = {"matched": "medium", "intro_requested": "medium", "intro_accepted": "high", "submitted": "medium", "screening": "medium", "client_submitted": "medium", "interview": "high", "offer": "high"}
MATCHING_DECISIONS = ("submit", "strong_submit", "recommended_submit", "review", "manual_review", "needs_review")
# What is tried again after a failure, what is not, and the seconds to wait.
RETRY_STATUS, NEVER_RETRY_STATUS = (408, 429, 500, 502, 503, 504), (400, 401, 403, 404, 409, 422)
RETRY_ERRORS, NEVER_RETRY_ERRORS = ("timeout", "rate_limited", "temporary_network", "server_error"), ("validation_error", "authentication_error", "permission_error", "not_found", "duplicate")
RETRY_STEP, RETRY_MOST = 30, 300


def _of(names: dict[str, str], x: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(v) for kv in names.items() for v in kv]), x)


def recommended(df: DataFrame, existing: DataFrame) -> DataFrame:
    """Submissions with conflict, recommended_stage, stage_changed, outcome, follow_up (priority or null).

    df: consultant_id, job_id, current_stage, event_type, to_stage, outcome_type, decision, match_score.
    existing: consultant_id, job_id of tracked submissions. A terminal stage stays; then a duplicate
    is flagged, then the event decides, then the match. A step that isn't allowed is a conflict and
    leaves the stage as it is.
    """
    keys = ["consultant_id", "job_id"]
    held = existing.select(*keys).where("consultant_id is not null and job_id is not null").distinct().withColumn("_held", F.lit(True))
    out = df.join(held, keys, "left").withColumn("_duplicate", F.coalesce("_held", F.lit(False)))
    outcome = F.lower(F.trim("outcome_type"))
    asked = F.coalesce(F.nullif(F.col("to_stage"), F.lit("")), F.when((F.col("event_type") == "outcome_recorded") & outcome.isin(*OUTCOMES), outcome), _of(EVENT_STAGES, F.col("event_type")))
    by_match = F.when(F.lower(F.trim("decision")).isin(*MATCHING_DECISIONS) | (F.col("match_score") >= MATCHED_SCORE), F.lit("matched"))
    wanted = F.when(F.col("current_stage").isin(*TERMINAL), F.col("current_stage")).when(F.col("_duplicate"), "duplicate_risk").otherwise(F.coalesce(asked, by_match, F.col("current_stage")))
    steps = F.create_map(*[x for a, after in TRANSITIONS.items() for x in (F.lit(a), F.array(*[F.lit(b) for b in (a, *after)]))])
    allowed = F.coalesce(F.array_contains(F.try_element_at(steps, F.col("current_stage")), F.col("_wanted")), F.col("_wanted") == F.col("current_stage"))
    conflict = F.when(F.col("_duplicate"), "possible_duplicate_submission").when(~F.col("_allowed"), "invalid_stage_transition")
    out = out.withColumn("_wanted", wanted).withColumn("_allowed", allowed)
    out = out.withColumn("conflict", conflict).withColumn("recommended_stage", F.when(F.col("_allowed"), F.col("_wanted")).otherwise(F.col("current_stage")))
    reached = F.when(F.col("recommended_stage").isin(*TERMINAL, "submitted", "screening", "client_submitted", "interview", "offer"), F.col("recommended_stage")).otherwise("none")
    follow = F.when(F.col("conflict").isNotNull(), "high").otherwise(_of(FOLLOW_UPS, F.col("recommended_stage")))
    return out.withColumns({"stage_changed": F.col("recommended_stage") != F.col("current_stage"), "outcome": reached, "follow_up": follow}).drop("_held", "_duplicate", "_wanted", "_allowed")


def publish_block(draft_type: Column, requires_review: Column, records: Column) -> Column:
    """Why a draft can't be published, or null: a job that still asks for review needs a record with a title."""
    title = F.trim(F.coalesce(F.get(records, F.lit(0))["job_title"], F.lit("")))
    asks = (draft_type == "draft_job_requirement") & requires_review
    return F.when(asks & (F.coalesce(F.size(records), F.lit(0)) == 0), "job_requirement_missing_records").when(asks & (title == ""), "job_requirement_missing_job_title")


def decided(drafts: DataFrame, actions: DataFrame) -> DataFrame:
    """The drafts after actions (draft_id, action, at, note): each draft's last action decides.

    publish makes a draft published unless its column `block` says why not, reject makes it rejected
    with the note as reason, reclassify sets draft_type to the note, delete removes it. Columns error
    and rejection_reason say what happened; a draft that isn't there gets no row.
    """
    last = actions.groupBy("draft_id").agg(F.max_by(F.struct("action", "note"), F.struct("at", "action", "note")).alias("_last"))
    out = drafts.join(last, "draft_id", "left")
    act, note = F.coalesce(F.col("_last.action"), F.lit("")), F.col("_last.note")
    out = out.where(act != "delete")
    stopped = (act == "publish") & F.col("block").isNotNull()
    return out.withColumns({
        "status": F.when((act == "publish") & ~stopped, "published").when(act == "reject", "rejected").otherwise(F.col("status")),
        "draft_type": F.when(act == "reclassify", note).otherwise(F.col("draft_type")),
        "error": F.when(stopped, F.col("block")),
        "rejection_reason": F.when(act == "reject", note),
    }).drop("_last", "block")


def reviewed(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates (id, status, ...) after decisions (id, decision, reviewer, at): only pending ones move, by their first decision."""
    first = decisions.groupBy("id").agg(F.min_by(F.struct("decision", "reviewer", "at"), F.struct("at", "decision", "reviewer")).alias("_d"))
    out = candidates.join(first, "id", "left")
    moves = (F.col("status") == "pending") & F.col("_d.decision").isin("approved", "rejected")
    return out.withColumns({"status": F.when(moves, F.col("_d.decision")).otherwise(F.col("status")), "reviewed_by": F.when(moves, F.col("_d.reviewer")), "reviewed_at": F.when(moves, F.col("_d.at"))}).drop("_d")


def reconciled(drafts: DataFrame, ready: Column, corrected: DataFrame, size: int) -> DataFrame:
    """draft_id of the `size` oldest drafts in review that are ready and that nobody corrected. A bounded batch is the feature."""
    waiting = drafts.where((F.col("status") == "needs_review") & ready).join(corrected.select("draft_id"), "draft_id", "left_anti")
    return relational.page(waiting.select("draft_id", "created_at"), [F.asc("created_at"), F.asc("draft_id")], 1, size)


def feedback(rows: DataFrame, predicted: str, corrected: str) -> DataFrame:
    """Corrections worth learning from: those that differ from what was predicted."""
    return rows.where(F.col(corrected).isNotNull() & ~F.col(predicted).eqNullSafe(F.col(corrected)))


def backfilled(items: DataFrame, drafts: DataFrame, size: int) -> DataFrame:
    """Items (draft_id, place, version) of a frozen list in batches of `size`, each with an outcome.

    A draft that is gone is `missing`; one of another version than when the list was frozen is
    `changed`; one whose new value equals its old is `same`; others are `updated`.
    """
    now = drafts.select("draft_id", F.col("version").alias("_now"), "old_value", "new_value")
    out = items.join(now, "draft_id", "left")
    outcome = F.when(F.col("_now").isNull(), "missing").when(F.col("_now") != F.col("version"), "changed").when(F.col("old_value").eqNullSafe(F.col("new_value")), "same").otherwise("updated")
    return out.select("draft_id", F.floor(F.col("place") / size).cast("long").alias("batch"), outcome.alias("outcome"))


def retry_decision(retries: Column, most: Column, status: Column, error: Column) -> Column:
    """Struct of decision (retry, do_not_retry or needs_review) and seconds to wait, for a failed call's status and kind of error."""
    either = lambda codes, kinds: F.coalesce(status.isin(*codes), F.lit(False)) | F.coalesce(error.isin(*kinds), F.lit(False))
    stop = (retries >= most) | either(NEVER_RETRY_STATUS, NEVER_RETRY_ERRORS)
    go = either(RETRY_STATUS, RETRY_ERRORS)
    decision = F.when(stop, "do_not_retry").when(go, "retry").otherwise("needs_review")
    return F.struct(decision.alias("decision"), F.when(~stop & go, F.least(F.lit(RETRY_MOST), RETRY_STEP * (retries + 1))).alias("wait"))


def first_phrase(message: Column, phrases: dict[str, tuple[str, ...]]) -> Column:
    """Struct of label, confidence and reason: the first label (in the given order) of which a phrase stands in the message."""
    low = F.lower(F.coalesce(message, F.lit("")))
    hit = F.coalesce(*[F.when(low.contains(p), F.struct(F.lit(label).alias("label"), F.lit(0.85).alias("confidence"), F.lit(f"matched_phrase:{p}").alias("reason"))) for label, own in phrases.items() for p in own])
    short = F.length(F.trim(low)) < 15
    none = F.struct(F.lit(None).cast("string").alias("label"), F.when(short, 0.2).otherwise(0.35).alias("confidence"), F.when(short, "message_too_short").otherwise("no_known_phrase_matched").alias("reason"))
    return F.coalesce(hit, none)


def relationship_cards(interactions: DataFrame, contact: str, date: str, summary: str, topic: str, most: int = 10) -> DataFrame:
    """One card for each contact: how many interactions, the summary of the last, and up to `most` topics by name (a bounded list is the feature)."""
    totals = interactions.groupBy(contact).agg(F.count("*").alias("interaction_count"), F.max_by(summary, F.struct(F.coalesce(F.col(date).cast("string"), F.lit("")), F.col(summary))).alias("last_interaction_summary"))
    topics = interactions.select(contact, topic).distinct().where(F.col(topic).isNotNull())
    ranked = topics.withColumn("_r", F.row_number().over(Window.partitionBy(contact).orderBy(topic))).where(F.col("_r") <= most)
    shared = ranked.groupBy(contact).agg(F.array_sort(F.collect_list(topic)).alias("shared_context"))
    return totals.join(shared, contact, "left")
