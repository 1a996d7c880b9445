"""What kind of document a text is, how well it was read, and what follows from that."""

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from brookmill.functions.text import once

from . import extract

# Words that tell a document's kind, in the order in which kinds are tried.
KIND_MARKERS = {
    "hotlist": ("hotlist", "available consultants", "bench list"),
    "vendor_list": ("vendor list", "implementation partner", "prime vendor"),
    "job_description": ("job description", "required skills", "mandatory skills", "responsibilities", "requirements", "rate", "duration:", "interview process", "location"),
    "resume": ("resume", "curriculum vitae", "professional summary", "work experience", "education"),
    "bench_sales_profile": ("bench sales",),
    "recruiter_profile": ("recruiter",),
}
# The draft of each kind, least confidence by kind, and confidence where nothing was measured.
DRAFTS = {"resume": "draft_consultant_profile", "job_description": "draft_job_requirement", "hotlist": "draft_hotlist", "recruiter_profile": "draft_recruiter_profile", "bench_sales_profile": "draft_bench_sales_profile", "consultant_profile": "draft_consultant_profile", "vendor_list": "draft_vendor_list", "plain_message": "draft_channel_note", "unknown": "draft_channel_note"}
LEAST_QUALITY = {"resume": 0.70, "job_description": 0.70, "message": 0.60, "unknown": 0.70}
UNMEASURED = {"unknown": 0.2, "plain_message": 0.6}
# Frequent words of languages; a word counts for every language that has it.
FREQUENT = {
    "en": "the of and to a in is that it for was on with be by as this are at from we you your our have has not but or will can they their which who an",
    "es": "el la los las de del que y en un una por con no se su sus al lo es son para como más pero este esta nuestro nuestra usted tiene hay muy ya o",
    "fr": "le la les de des du et en un une est sont que qui pour dans sur par pas au aux avec ce cette nous vous votre notre il elle avons ne se plus ou",
    "de": "der die das den dem des und in ist sind nicht mit ein eine einen einem einer zu von für auf sich im wir sie ihr ich es als auch haben hat bei nach oder",
}


def _mapped(x: Column, names: dict, otherwise) -> Column:
    known = F.create_map(*[F.lit(v) for kv in names.items() for v in kv])
    return F.coalesce(F.try_element_at(known, x), F.lit(otherwise))


def marked_kind(text: Column) -> Column:
    """The first kind that has a marker in the text; plain_message without one, unknown for a blank text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    kinds = [F.when(functools.reduce(operator.or_, [low.contains(m) for m in markers]), F.lit(kind)) for kind, markers in KIND_MARKERS.items()]
    return F.coalesce(*kinds, F.when(F.trim(low) != "", F.lit("plain_message")), F.lit("unknown"))


def kind_of(text: Column, channel: Column, intended: Column, job: Column, hotlist: Column, leaning: Column) -> Column:
    """A document's kind: of mail what its mailbox intends, else what one parser is sure of, else what
    its sender's corrections lean to; of all other texts what their markers say.
    """
    sure = F.nullif(extract.document_kind(job, hotlist), F.lit("unknown"))
    by_mail = F.coalesce(F.when(intended.isin("hotlist", "job_description"), intended), sure, leaning)
    return F.coalesce(F.when(channel == "email", by_mail), marked_kind(text))


def draft_type(kind: Column) -> Column:
    return _mapped(kind, DRAFTS, "draft_channel_note")


def reading_kind(kind: Column) -> Column:
    """The kind that is read as such: resumes, jobs and the unknown; all others are messages."""
    return F.when(kind.isin("resume", "job_description", "unknown"), kind).otherwise("message")


def confidence_or_usual(confidence: Column, kind: Column) -> Column:
    return F.coalesce(confidence, _mapped(kind, UNMEASURED, 0.75))


def needs_fallback(confidence: Column, kind: Column) -> Column:
    return confidence < _mapped(kind, LEAST_QUALITY, 0.70)


def language(text: Column) -> Column:
    """The language whose frequent words occur most often (ties: the first by name), unknown for short texts and those without any."""

    def of(words: Column) -> Column:
        held = lambda own: F.size(F.filter(words, lambda w: w.isin(*own.split())))
        best = F.array_min(F.array(*[F.struct((-held(own)).alias("n"), F.lit(k).alias("lang")) for k, own in sorted(FREQUENT.items())]))
        return once(best, lambda b: F.when(b["n"] < 0, b["lang"]).otherwise("unknown"))

    words = F.split(F.lower(text), r"[^\p{L}]+")
    return F.when(F.length(F.trim(text)) >= 20, once(words, of)).otherwise("unknown")


def fallback(weak: Column, source: Column, attempted: Column, has_text: Column, cloud: bool = False, model: bool = False) -> Column:
    """What to try after a weak reading: none, local_retry, cloud_extraction_candidate, llm_structuring_candidate or manual_review."""
    retry = (source == "markitdown") & ~F.coalesce(F.array_contains(attempted, "pdfplumber"), F.lit(False))
    rest = F.lit("cloud_extraction_candidate") if cloud else F.when(F.lit(model) & has_text, "llm_structuring_candidate").otherwise("manual_review")
    return F.when(~weak, "none").when(F.coalesce(retry, F.lit(False)), "local_retry").otherwise(rest)


def validation(kind: Column, found_kind: Column, weak: Column, skills: Column, contact: Column, title: Column) -> Column:
    """Struct of errors and warnings about what was read. contact, title: whether there is one."""
    mismatch = kind.isin("resume", "job_description", "message") & ~found_kind.eqNullSafe(kind)
    bare = kind.isin("resume", "job_description") & (F.coalesce(F.size(skills), F.lit(0)) == 0)
    warnings = F.array(F.when(weak, F.lit("extraction_quality_requires_fallback")), F.when(bare, F.lit("no_skills_extracted")), F.when((kind == "resume") & ~contact, F.lit("resume_contact_not_found")), F.when((kind == "job_description") & ~title, F.lit("job_title_not_found")))
    return F.struct(F.array_compact(F.array(F.when(mismatch, F.lit("structured_document_kind_mismatch")))).alias("errors"), F.array_compact(warnings).alias("warnings"))


# What a missing part takes from the confidence in a parsed consultant or job.
CONSULTANT_PARTS = {"name": (0.15, "name_not_found"), "title": (0.20, "title_not_found"), "skills": (0.25, "no_skills_found"), "experience": (0.10, "experience_not_found")}
JOB_PARTS = {"title": (0.30, "title_not_found"), "skills": (0.20, "no_skills_found"), "location": (0.10, "location_not_found"), "employment_type": (0.05, "employment_type_not_found")}


def parse_confidence(text: Column, missing: dict[str, Column], parts: dict[str, tuple[float, str]]) -> Column:
    """Struct of score and reasons: 1 less the share of each part that is missing, and less 0.35 for a text of under 20 characters."""
    short = F.length(F.trim(F.coalesce(text, F.lit("")))) < 20
    lost = [(short, 0.35, "text_too_short"), *[(missing[k], share, reason) for k, (share, reason) in parts.items()]]
    score = functools.reduce(operator.sub, [F.when(c, F.lit(s)).otherwise(0.0) for c, s, _ in lost], F.lit(1.0))
    return F.struct(F.greatest(F.lit(0.0), F.round(score, 6)).alias("score"), F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, _, r in lost])).alias("reasons"))
