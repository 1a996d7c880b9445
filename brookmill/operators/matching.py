"""Resume and job pairs, submission stages, accuracy of fields and activity of companies."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brookmill.functions.numbers import clamp, percent, within_days
from brookmill.functions.text import match_text

# Weights and thresholds of the match score.
WEIGHTS = {"required_skill": 0.55, "preferred_skill": 0.15, "years": 0.15, "work_authorization": 0.10, "location": 0.05}
SUBMIT_SCORE, SUBMIT_YEARS, REVIEW_SCORE, REVIEW_SKILL = 80.0, 80.0, 60.0, 60.0
# Spellings of a work authorisation.
AUTHORIZATIONS = {"h1b": ("h1b", "h 1b", "h1 b"), "green card": ("gc", "green card", "greencard"), "us citizen": ("usc", "us citizen", "citizen", "us citizenship")}
# Stages of a submission and where each may lead.
TRANSITIONS = {
    "discovered": ("matched", "intro_requested", "submitted", "duplicate_risk", "closed_lost"),
    "matched": ("intro_requested", "submitted", "duplicate_risk", "closed_lost"),
    "intro_requested": ("intro_accepted", "rejected", "withdrawn", "duplicate_risk"),
    "intro_accepted": ("submitted", "screening", "withdrawn", "duplicate_risk"),
    "submitted": ("screening", "client_submitted", "interview", "rejected", "withdrawn", "duplicate_risk"),
    "screening": ("client_submitted", "interview", "rejected", "withdrawn"),
    "client_submitted": ("interview", "offer", "rejected", "withdrawn"),
    "interview": ("offer", "placed", "rejected", "withdrawn"),
    "offer": ("placed", "rejected", "withdrawn"),
    "duplicate_risk": ("matched", "intro_requested", "submitted", "closed_lost", "withdrawn"),
    "placed": (),
    "rejected": (),
    "withdrawn": (),
    "closed_lost": (),
}


def overlap_percent(wanted: Column, held: Column, if_none: float) -> Column:
    """Share of the wanted set that is held, in percent to 2 decimals; if_none where nothing is wanted."""
    wanted = F.array_distinct(F.coalesce(wanted, F.array().cast("array<string>")))
    both = F.size(F.array_intersect(wanted, F.coalesce(held, F.array().cast("array<string>"))))
    return F.coalesce(F.bround(percent(both, F.size(wanted)), 2), F.lit(if_none))


def years_score(have: Column, want: Column) -> Column:
    return F.when(want.isNull() | (want <= 0), 100.0).when(have.isNull(), 50.0).when(have >= want, 100.0).otherwise(F.bround(clamp(100.0 * have / want, 0.0, 100.0), 2))


def authorization_key(x: Column) -> Column:
    """One spelling of a work authorisation; empty for null."""
    key = match_text(x)
    same = F.create_map(*[F.lit(v) for k, vs in AUTHORIZATIONS.items() for w in vs for v in (w, k)])
    return F.coalesce(F.try_element_at(same, key), key, F.lit(""))


def authorization_score(have: Column, want: Column, keyed: bool = False) -> Column:
    """100 where nothing is wanted or either contains the other, 50 where unknown, else 0. keyed: they are keys already."""
    have, want = (have, want) if keyed else (authorization_key(have), authorization_key(want))
    return F.when((want == "") | want.isin("any", "open", "all"), 100.0).when(have == "", 50.0).when(want.contains(have) | have.contains(want), 100.0).otherwise(0.0)


def location_score(have: Column, want: Column, keyed: bool = False) -> Column:
    have, want = (have, want) if keyed else (F.coalesce(match_text(x), F.lit("")) for x in (have, want))
    near = want.contains("remote") | have.contains("remote") | want.contains(have) | have.contains(want)
    return F.when(want == "", 100.0).when(have == "", 70.0).when(near, 100.0).otherwise(60.0)


def match_score(required: Column, preferred: Column, years: Column, authorization: Column, place: Column) -> Column:
    return required * WEIGHTS["required_skill"] + preferred * WEIGHTS["preferred_skill"] + years * WEIGHTS["years"] + authorization * WEIGHTS["work_authorization"] + place * WEIGHTS["location"]


def decision(score: Column, required: Column, years: Column, authorization: Column) -> Column:
    submit = (score >= SUBMIT_SCORE) & (required >= 100) & (years >= SUBMIT_YEARS) & (authorization > 0)
    return F.when(submit, "submit").when((score >= REVIEW_SCORE) & (required >= REVIEW_SKILL) & (authorization > 0), "review").otherwise("reject")


def scored_pairs(pairs: DataFrame, keyed: bool = False) -> DataFrame:
    """Pairs of structs resume and job with the part scores, the score and the decision. keyed: skills, authorisations and places are keys already."""
    r, j = (lambda name: F.col(f"resume.{name}")), (lambda name: F.col(f"job.{name}"))
    keys = lambda x: x if keyed else F.transform(x, match_text)
    out = pairs.withColumns({
        "required_skill_score": overlap_percent(keys(j("required_skills")), keys(r("skills")), 100.0),
        "preferred_skill_score": overlap_percent(keys(j("preferred_skills")), keys(r("skills")), 0.0),
        "years_score": years_score(r("years_experience"), j("years_experience")),
        "work_authorization_score": authorization_score(r("work_authorization"), j("work_authorization"), keyed),
        "location_score": location_score(r("location"), j("location"), keyed),
        "missing_required": F.array_sort(F.array_except(keys(j("required_skills")), F.coalesce(keys(r("skills")), F.array().cast("array<string>")))),
    })
    out = out.withColumn("match_score", F.bround(match_score(*[F.col(f"{k}_score") for k in WEIGHTS]), 2))
    return out.withColumn("decision", decision(F.col("match_score"), F.col("required_skill_score"), F.col("years_score"), F.col("work_authorization_score")))


def transitions(spark: SparkSession) -> DataFrame:
    """from_stage, to_stage: the allowed steps, staying included."""
    return spark.createDataFrame([(a, b) for a, after in TRANSITIONS.items() for b in (a, *after)], "from_stage string, to_stage string")


def with_allowed(df: DataFrame, steps: DataFrame, from_stage: str, to_stage: str) -> DataFrame:
    """df with allowed: whether the step is in the table of steps."""
    known = steps.select(F.col("from_stage").alias("_f"), F.col("to_stage").alias("_t"), F.lit(True).alias("_ok"))
    out = df.join(known, (F.col(from_stage) == F.col("_f")) & (F.col(to_stage) == F.col("_t")), "left")
    return out.withColumn("allowed", F.coalesce("_ok", F.lit(False))).drop("_f", "_t", "_ok")


def activity(observations: DataFrame, company: str, job: str, contact: str, at: str, as_of: Column, days: int = 30) -> DataFrame:
    """Each company's score from distinct recent jobs (3 each, 60 at most), contacts (5 each, 25 at most) and 15 for any."""
    recent = within_days(F.col(at), as_of, days)
    out = observations.groupBy(company).agg(F.countDistinct(F.when(recent, F.col(job))).alias("jobs"), F.countDistinct(F.when(recent, F.col(contact))).alias("contacts"), F.count_if(recent).alias("sources"))
    return out.withColumn("score", F.least(F.lit(60), F.col("jobs") * 3) + F.least(F.lit(25), F.col("contacts") * 5) + F.when(F.col("sources") > 0, 15).otherwise(0))


def accuracy(rows: DataFrame, field: str, filled: Column, wrong: Column, missing: Column, confidence: Column, total: int, least: int = 20) -> DataFrame:
    """Fill rate, precision, stated confidence, calibration gap and reliability of each field."""
    out = rows.groupBy(field).agg(F.count_if(filled).alias("filled"), F.count_if(wrong).alias("corrected_wrong"), F.count_if(missing).alias("corrected_missing"), F.coalesce(F.sum(F.when(filled, confidence)), F.lit(0.0)).alias("_sum"))
    out = out.withColumns({
        "precision": percent(F.greatest(F.lit(0), F.col("filled") - F.col("corrected_wrong")), F.col("filled")),
        "fill_rate": percent(F.col("filled"), F.lit(total)),
        "avg_confidence": percent(F.col("_sum"), F.col("filled")),
    })
    return out.withColumn("calibration_gap", F.col("avg_confidence") - F.col("precision")).withColumn("reliable", F.col("filled") >= least).drop("_sum")
