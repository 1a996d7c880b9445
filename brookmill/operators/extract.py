"""Row-wise extraction and classification of messages, as Column expressions.

Regular expressions use explicit ASCII classes, so that other engines read them alike.
"""

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from brookmill.functions.text import once, url_host, words_in

# Vocabularies of the message classifiers.
JOB_WORDS = ("need", "hiring", "looking for", "requirement", "position", "contract", "full-time", "full time", "location", "job", "opening", "urgent requirement", "client requirement")
RESUME_WORDS = ("resume", "cv", "candidate", "profile", "experience", "years")
HOTLIST_WORDS = ("hotlist", "available consultant", "available candidates", "available candidate", "consultants available", "consultant available", "candidate available", "resource available", "resources available", "bench", "on the bench", "on bench", "rolling off", "immediately available")
QUESTION_WORDS = ("?", "can you", "please share", "any update", "status", "feedback")
MARKETING_MARKERS = ("unsubscribe", "view in browser", "you are receiving this email because", "click here to", "limited time offer", "act now", "% off", "manage your subscription", "this is a promotional email")
JOB_MARKERS = ("required skill", "required skills", "job title", "position", "location", "hotlist", "consultant", "rate", "contract", "visa", "resume", "experience", "responsibilities", "qualifications", "client", "w2", "c2c", "1099")
WORK_AUTHORIZATIONS = (("US Citizen", "us citizen|u\\.s\\. citizen|citizen"), ("Green Card", "green card|gc|permanent resident"), ("H1B", "h1b|h-1b"), ("H4 EAD", "h4 ead|h-4 ead"), ("L2 EAD", "l2 ead|l-2 ead"), ("OPT", "opt|cpt|stem opt"), ("TN Visa", "tn visa|tn"), ("Any Visa", "any visa|all visa types? (?:ok|accepted|allowed)"), ("No Sponsorship", "no sponsorship|without sponsorship|sponsorship not (?:available|provided)"), ("EAD", "ead|work authorization|work authorised|work authorized"))
EMPLOYMENT_TYPES = (("Full-time", "full[- ]?time|permanent"), ("Contract to hire", "contract[- ]to[- ]hire|c2h"), ("Corp-to-Corp", "corp[- ]to[- ]corp|c2c"), ("W2", "w2"), ("Contract", "contract"))
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?:\+?1[ .-]?)?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}"


def _any(x: Column, parts: tuple[str, ...]) -> Column:
    return functools.reduce(operator.or_, [x.contains(p) for p in parts])


def _bounded(x: Column, pattern: str) -> Column:
    return F.lower(x).rlike(f"(^|[^a-z0-9_])(?:{pattern})([^a-z0-9_]|$)")


def first_rule(x: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The label of the first rule whose pattern stands as words in the text; null if none."""
    return F.coalesce(*[F.when(_bounded(x, pattern), F.lit(label)) for label, pattern in rules])


def text_quality(x: Column) -> Column:
    """Struct of reasons, confidence and needs_fallback."""
    text = F.trim(F.coalesce(x, F.lit("")))
    short, few, bare = F.length(text) < 40, ~text.rlike(r"^\s*(?:\S+\s+){4}\S"), ~text.rlike(r"\p{L}")
    reasons = F.array_compact(F.array(F.when(short, F.lit("text_too_short")), F.when(few, F.lit("too_few_words")), F.when(bare, F.lit("no_alpha_text")), F.when(F.length(text) < 20, F.lit("language_unknown"))))
    confidence = F.when(short | bare, F.lit(0.35)).when(F.size(reasons) > 0, F.lit(0.55)).otherwise(F.lit(0.9))
    return F.struct(reasons.alias("reasons"), confidence.alias("confidence"), (confidence < 0.7).alias("needs_fallback"))


def intent(x: Column) -> Column:
    """HOTLIST, RESUME, JOB, QUESTION or UNKNOWN, by the first vocabulary that the text holds a word of."""
    return once(F.lower(F.coalesce(x, F.lit(""))), _intent)


def _intent(low: Column) -> Column:
    available = low.rlike(r"(^|[^a-z0-9_])(developer|engineer|consultant|candidate|resources?|profiles?)([^a-z0-9_.][^.]{0,23}|)[^a-z0-9_.]available([^a-z0-9_]|$)")
    return F.when(_any(low, HOTLIST_WORDS) | available, "HOTLIST").when(_any(low, RESUME_WORDS), "RESUME").when(_any(low, JOB_WORDS), "JOB").when(_any(low, QUESTION_WORDS), "QUESTION").otherwise("UNKNOWN")


def intent_confidence(kind: Column) -> Column:
    return F.when(kind == "HOTLIST", F.lit(0.85)).when(kind == "RESUME", F.lit(0.80)).when(kind == "JOB", F.lit(0.90)).when(kind == "QUESTION", F.lit(0.70)).otherwise(F.lit(0.40))


def spam_reasons(x: Column, kind: Column, confidence: Column) -> Column:
    """Reasons to flag a message; empty if there are none. A nearly empty one has no other reason."""
    weak = kind.isin("unknown", "plain_message") & (confidence < 0.35)

    def of(low: Column) -> Column:
        hits = functools.reduce(operator.add, [low.contains(m).cast("int") for m in MARKETING_MARKERS])
        marketing = (hits >= 2) & ~low.rlike(f"(^|[^a-z0-9_])(?:{'|'.join(JOB_MARKERS)})([^a-z0-9_]|$)")
        others = F.array_compact(F.array(F.when(weak, F.lit("no_hotlist_or_requirement_signal")), F.when(marketing, F.lit("marketing_footer_markers_without_job_content"))))
        return F.when(F.length(low) < 25, F.array(F.lit("empty_or_near_empty_content"))).otherwise(others)

    return once(F.lower(F.trim(F.coalesce(x, F.lit("")))), of)


def email(x: Column) -> Column:
    # a match starts where its characters start, and gives none of them back
    return F.nullif(F.regexp_extract(x, "(?<![A-Za-z0-9._%+-])" + EMAIL.replace("+@", "++@"), 0), F.lit(""))


def phone(x: Column) -> Column:
    """A labelled number first, else the first that looks like one of North America."""
    labelled = F.trim(F.regexp_replace(F.regexp_extract(x, r"(?i)(?:mobile|phone|tel|cell|whatsapp)[: \t]+(\+?[0-9][0-9 ().-]{7,18}[0-9])", 1), r"\s+", " "))
    return F.coalesce(F.nullif(labelled, F.lit("")), F.nullif(F.regexp_extract(x, PHONE, 0), F.lit("")))


def e164(x: Column) -> Column:
    """+1 and ten digits, for numbers of ten, or of eleven that start with 1; else null."""
    digits = F.regexp_replace(x, "[^0-9]", "")
    return F.when(F.length(digits) == 10, F.concat(F.lit("+1"), digits)).when((F.length(digits) == 11) & digits.startswith("1"), F.concat(F.lit("+"), digits))


def linkedin(x: Column) -> Column:
    found = F.regexp_replace(F.regexp_extract(x, r"(?i)(?:https?://)?(?:www\.)?linkedin\.com/in/[A-Za-z0-9_%-]+", 0), "/+$", "")
    return F.when(found != "", F.when(F.lower(found).startswith("http"), found).otherwise(F.concat(F.lit("https://"), found)))


def is_public_profile(url: Column) -> Column:
    """Whether it is the https address of a public profile page."""
    return F.coalesce(url.rlike(r"^https://") & url_host(url).isin("linkedin.com", "www.linkedin.com") & url.rlike(r"^https://[^/]+/in/[^/?#]+"), F.lit(False))


def work_authorization(x: Column) -> Column:
    return first_rule(F.coalesce(x, F.lit("")), WORK_AUTHORIZATIONS)


def employment_type(x: Column) -> Column:
    return first_rule(F.coalesce(x, F.lit("")), EMPLOYMENT_TYPES)


def location(x: Column) -> Column:
    """`Remote` if the word is anywhere, else a labelled location, else `City, ST`."""
    labelled = F.nullif(F.regexp_extract(x, r"(?im)^[ \t]*location[ \t]*[:-][ \t]*(\S.*?)[ \t]*$", 1), F.lit(""))
    city = F.nullif(F.regexp_extract(x, r"\b([A-Z][a-z]+(?: [A-Z][a-z]+)*, [A-Z]{2})\b", 1), F.lit(""))
    return F.when(_bounded(x, "remote"), F.lit("Remote")).otherwise(F.coalesce(labelled, city))


def years_of_experience(x: Column) -> Column:
    return F.regexp_extract(F.lower(x), r"([0-9]{1,2})\+?[ \t]*(?:years|yrs|year)", 1).try_cast("int")


def rate(x: Column) -> Column:
    """Struct of amount and unit (hour, year or null) of a pay rate such as `$65/hr`."""
    amount = F.replace(F.regexp_extract(x, r"\$?[ \t]*([0-9][0-9,]*(?:\.[0-9]+)?)", 1), F.lit(","), F.lit("")).try_cast("double")
    low = F.lower(x)
    unit = F.when(low.rlike("/ *h|per hour|hourly|/hr"), "hour").when(low.rlike("/ *y|per year|annual|per annum|[0-9]k"), "year")
    return F.struct((amount * F.when(low.rlike("[0-9]k"), 1000).otherwise(1)).alias("amount"), unit.alias("unit"))


def subject(x: Column) -> Column:
    """The subject line without `Re:` and `Fwd:`."""
    line = F.regexp_extract(x, r"(?im)^subject:[ \t]*(\S.*?)[ \t]*$", 1)
    return F.nullif(F.trim(F.regexp_replace(line, r"(?i)^(?:(?:re|fw|fwd)[ \t]*:[ \t]*)+", "")), F.lit(""))


def looks_forwarded(x: Column) -> Column:
    return F.coalesce(x.rlike(r"(?im)^-+ ?(?:forwarded message|original message) ?-+|^begin forwarded message:"), F.lit(False))


def sender(text: Column, reply_to: Column) -> Column:
    """Struct of address, method and confidence: of a forwarded header, else reply-to, else the body."""
    header = F.lower(F.nullif(F.regexp_extract(text, rf"(?im)^from:[^\n]*?({EMAIL})", 1), F.lit("")))
    pick = lambda address, method, sure: F.when(address.isNotNull(), F.struct(address.alias("address"), F.lit(method).alias("method"), F.lit(sure).alias("confidence")))
    return F.coalesce(pick(F.when(looks_forwarded(text), header), "forwarded_header", 0.95), pick(F.lower(F.nullif(reply_to, F.lit(""))), "reply_to", 0.85), pick(F.lower(email(text)), "body", 0.6))


def document_kind(job: Column, hotlist: Column, least: float = 0.70, margin: float = 0.15) -> Column:
    """The kind whose parser is sure enough, and surer than the other by the margin; else unknown."""
    return F.when((job >= least) & (job - hotlist >= margin), "job_description").when((hotlist >= least) & (hotlist - job >= margin), "hotlist").otherwise("unknown")


def requirement_confidence(has_title: Column, has_evidence: Column, has_company: Column) -> Column:
    return F.when(has_title & has_evidence & has_company, 0.92).when(has_title & has_evidence, 0.65).when(has_title | has_evidence, 0.62).otherwise(0.35)


def display_title(title: Column, job_title: Column, kind: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(title), F.lit("")), F.nullif(F.trim(job_title), F.lit("")), F.initcap(F.replace(kind, F.lit("_"), F.lit(" "))))


def is_automated(reviewer: Column, prefixes: tuple[str, ...] = ("auto:", "system:", "bulk:", "daily-")) -> Column:
    return F.coalesce(functools.reduce(operator.or_, [reviewer.startswith(p) for p in prefixes]), F.lit(False))


def parser_ready(expected: Column, confidence: Column, errors: Column, parsing: str = "parsing", least: float = 0.7) -> Column:
    """Whether a draft's parse agrees with its kind and nothing in it asks for review."""
    p = lambda name: F.col(f"{parsing}.{name}")
    sound = F.forall(p("records"), lambda r: (r["requires_review"] == F.lit(False)) & (F.coalesce(F.size(r["warnings"]), F.lit(0)) == 0) & (F.coalesce(r["parse_confidence"], F.lit(0.0)) >= least))
    ready = (p("document_kind") == expected) & (F.size(p("records")) > 0) & (confidence >= least) & (F.coalesce(F.size(errors), F.lit(0)) == 0) & (p("requires_review") == F.lit(False)) & (F.coalesce(F.size(p("warnings")), F.lit(0)) == 0) & (F.coalesce(p("confidence"), F.lit(0.0)) >= least) & sound
    return F.coalesce(ready, F.lit(False))
